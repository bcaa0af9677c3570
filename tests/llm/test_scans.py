"""Decontamination and licence scans against brute force; the archive against its own round trip."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import random
import re

from tallymill.llm.decontamination import contaminated_spans, cut, folded, summary
from tallymill.llm.license_scan import PHRASES, TEMPLATES, Scanner, chains, scan_licenses, templates_of
from tallymill.llm.queries import op2_decontamination, op3_license_scan, op9_warc
from tallymill.llm.warc import archive_pages, headers, reconstruct

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, n=10):
    doc, hit, found = words(text), set(), set()
    index = {}
    for item, of in items:
        own = words(of)
        for k in range(max(1, len(own) - n + 1) if own else 0):
            index.setdefault(tuple(own[k:k + n]), set()).add(str(item))
    for size in {len(w) for w in index}:
        for k in range(len(doc) - size + 1):
            if who := index.get(tuple(doc[k:k + size])):
                found |= who
                hit |= set(range(k, k + size))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_of_the_table(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op2_decontamination(spark, SF).collect()}
    assert got == {doc: brute_hits(text, items) for doc, text in texts.items()}
    assert any(x[-1] for x in got.values())


def test_decontamination_edges(spark, frame):
    items = [(1, "What is the answer"), (2, "ÉCOLE é"), (10, None), (11, "..."), (12, " ".join(f"w{k}" for k in range(25))), (2, "ÉCOLE é"), (13, "é")]
    docs = [(1, None), (2, ""), (3, "so What is -- THE answer?"), (4, "école é"), (5, "x ÉCOLE é"), (6, " ".join(f"w{k}" for k in range(30))),
            (6, "the answer is what"), (None, "é"), (7, "a" * 300000 + " what is the answer " * 3)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1, 1 << 24):  # an automaton for each item, or for all
        found = contaminated_spans(frame(docs), bench, block_bytes=block)
        got = sorted(map(tuple, summary(found).collect()), key=str)
        assert got == sorted([(i, *brute_hits(t, items)) for i, t in docs], key=str)
        span = found.where("doc_id = 3").first().found.spans[0]
        assert docs[2][1][span.start:span.end] == "What is -- THE answer"
    clash = frame(docs).withColumnRenamed("n_words", "_found0")
    for block in (1, 1 << 24):
        out = contaminated_spans(clash, bench, block_bytes=block)
        assert out.columns == ["doc_id", "text", "_found0", "n_words", "found"] and {r["_found0"] for r in out.collect()} == {"x"}
    assert summary(contaminated_spans(frame([]), bench)).count() == 0
    assert not any(r.contaminated for r in summary(contaminated_spans(frame(docs), bench.limit(0))).collect())


def test_long_items_are_cut_into_runs_of_windows():
    for n in (1, 9, 10, 11, 60):
        text = " ".join(f"Word{k}" for k in range(n)).encode()
        for limit in (1, 300, 2000, 1 << 20):
            parts = list(cut(text, 10, limit))
            windows = lambda t: [tuple(folded(t)[k:k + 10]) for k in range(max(1, len(folded(t)) - 9))]
            assert [w for p in parts for w in windows(p)] == windows(text)
            assert limit > 300 or n < 60 or len(parts) > 1


def brute_phrases(text):
    own, at = words(text), []
    for phrase in PHRASES:
        p = phrase.split()
        at += [(k, PHRASES[phrase]) for k in range(len(own) - len(p) + 1) if own[k:k + len(p)] == p]
    starts = [k for k, _ in at]
    return len(own), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_phrases_of_the_table(spark, texts):
    got = {r.doc_id: r for r in op3_license_scan(spark, SF).collect()}
    for doc, text in texts.items():
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_templates(frame):
    mit = TEMPLATES[0][1]
    rows = [(1, None), (2, "the MIT License mit license MIT-LICENSE"), (3, f"words before {mit} and after"), (4, mit.replace("without limitation", "with no limits")),
            (5, "of the gnu general public license"), (6, "permission is granted to nobody"), (7, "Licensed under CC BY-NC 4.0."), (8, "mit " * 50000 + "license")]
    got = {r.doc_id: r for r in scan_licenses(frame(rows)).collect()}
    for doc, text in rows:
        assert tuple(got[doc])[1:6] == brute_phrases(text)
    span = next(s for s in got[3].spans if s.cover == 1.0)
    assert (span.label, span.first, span.last) == ("mit", 2, 1 + len(words(mit))) and got[3].labels == "mit" and got[3].score == 1.0
    assert got[4].labels == "mit" and 0.8 <= got[4].score < 1
    assert got[5].labels == "gpl" and got[5].score >= 0.5
    assert got[6].labels == "" and got[6].score == 0 and got[7].labels == "cc-by-nc"
    assert scan_licenses(frame([])).count() == 0


def test_chains_cover_most(spark):
    """Against every chain of few anchors, with wrong places among them."""
    rng = random.Random(12)
    for _ in range(400):
        anchors = []
        for _ in range(rng.randrange(1, 8)):
            first, t_first, n = rng.randrange(40), rng.randrange(25), rng.randrange(4, 12)
            anchors.append((first, first + n - 1, t_first, t_first + n - 1))
        most = {}

        def grow(chain, covered):
            key = chain[-1][1]
            most[key] = max(most.get(key, 0), covered)
            for x in anchors:
                a = chain[-1]
                if a[1] < x[1] and a[3] < x[3] and a[0] <= x[0] <= a[1] + 5:
                    grow([*chain, x], covered + x[3] - max(x[2], a[3] + 1) + 1)

        for x in anchors:
            grow([x], x[3] - x[2] + 1)
        got = {}
        for n, _, last in chains(anchors, 5):
            got[last] = max(got.get(last, 0), n)
        assert got == most


def test_a_wrong_place_does_not_spoil_a_chain(frame):
    """The first words stand twice in the template; the file has the second place."""
    template = "one two three four five six seven eight one two three four nine ten eleven twelve"
    scanner = Scanner(templates=[("own", template)], phrases={}, least_cover=0.5)
    assert scanner.scan(b"x one two three four nine ten eleven twelve y")[2] == [("own", 1, 8, 0.5)]
    assert scanner.scan(f"{template} z {template}".encode())[2] == [("own", 0, 15, 1.0), ("own", 17, 32, 1.0)]


def test_whole_licences_are_spans(frame, tmp_path):
    whole = " ".join(f"clause{k} says that {k} and no more" for k in range(400))
    (tmp_path / "MPL-2.0").write_text(whole)
    pool = templates_of(str(tmp_path))
    assert pool[-1] == ("mpl", whole) and templates_of(str(tmp_path / "none")) == TEMPLATES == templates_of(None)
    mit = TEMPLATES[-3][1]
    edited = whole.replace("clause77 says", "CLAUSE 77 reads").replace("clause200 says that", "")
    got = {r.doc_id: r for r in scan_licenses(frame([(1, f"intro {edited} end"), (2, mit.upper())]), templates=pool).collect()}
    span = max(got[1].spans, key=lambda s: s.last - s.first)
    assert got[1].labels == "mpl" and span.cover > 0.99 and (span.first, span.last) == (1, len(words(edited)))
    assert max(s.last - s.first for s in got[2].spans) == len(words(mit)) - 1 and got[2].score == 1.0


def sha1_32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archive_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in op9_warc(spark, SF).collect()}
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        raw = (p.html or "").encode()
        r, home = got[p.page_id], first.setdefault(raw, p.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), sha1_32(raw))
        assert (r.record_type, r.refers_to) == (("response", None) if home == p.page_id else ("revisit", home))


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "same é"), (1, "http://b/", "same é"), (2, None, None), (5, "u", ""), (9, "x\r\nWARC-Type: evil", "z" * 200000), (9, "y", "z" * 200000)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id bigint, url string, html string, sha256 string")
    index = archive_pages(pages, str(tmp_path / "a"))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in index.collect())
    assert got == [(1, "response", None, 7), (2, "response", None, 0), (3, "revisit", 1, 7), (5, "revisit", 2, 0), (9, "response", None, 200000), (9, "response", None, 200000)]
    back = {}
    for r in reconstruct(spark, str(tmp_path / "a")).collect():
        head, _, rest = bytes(r.warc).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest == rest[:length] + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        back[r.record] = bytes(r.payload)
    assert back == {i: (t or "").encode() for i, _, t in rows}
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    kinds = archive_pages(pages, str(tmp_path / "b"), least_bytes=100).where("page_id = 3").first()
    assert kinds.record_type == "response" and kinds.refers_to is None
    assert archive_pages(pages.limit(0), str(tmp_path / "c")).count() == 0
    said = headers(spark, str(tmp_path / "a")).collect()
    assert len({r.record_id for r in said}) == len(rows) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.date) for r in said)
    names = {r.record_id: r for r in said}
    for r in said:
        if r.kind == "revisit":
            target = names[re.search(r"WARC-Refers-To: (\S+)", r.header)[1]]
            assert target.kind == "response" and target.record == r.refers_to and target.sha256 == r.sha256


def test_archive_of_odd_ids(spark, tmp_path):
    rows = [("null", "a"), (None, "a"), (None, "b"), (None, "b"), ("x:1> \n", "c"), ("y", "c"), ("", "d")]
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id string, url string, html string")
    day = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc)
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in archive_pages(pages, str(tmp_path / "a"), date=day).collect())
    assert got == sorted([("null", "response", None), ("None", "revisit", "null"), ("None", "response", None), ("None", "response", None),
                          ("x:1> \n", "response", None), ("y", "revisit", "x:1> \n"), ("", "response", None)])
    said = headers(spark, str(tmp_path / "a"), "string").collect()
    assert {r.date for r in said} == {"2024-05-06T07:08:09Z"} and len({r.record_id for r in said}) == len(rows)
