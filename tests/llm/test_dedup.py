"""Suffix dedup, SimHash and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tallymill.llm import suffix_dedup
from tallymill.llm.components import connected
from tallymill.llm.fingerprints import Sketch, fingerprint_documents, merged, sketch
from tallymill.llm.queries import op1_fingerprints, op4_suffix_dedup, op6_simhash
from tallymill.llm.simhash import near_duplicates, without_copies
from tallymill.llm.suffix_dedup import difference_cover, remove_repeats, suffix_order, with_removals

from .conftest import SF


def brute_removal(rows, length=100):
    """rows: (key, text) in order. kept bytes, removed, spans by key."""
    seen, out = set(), {}
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            piece = raw[k:k + length]
            if piece in seen:
                gone[k:k + length] = True
            seen.add(piece)
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum())
        out[key] = len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()
    return out


def test_removal_of_the_table(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in op4_suffix_dedup(spark, SF).collect()}
    assert got == brute_removal(sorted(texts.items()))
    assert sum(x[1] > 0 for x in got.values()) > 10


def odd_documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 90))) for _ in range(6)] + ["ab " * 90, "x" * 400]
    return [(k, "".join(rng.choice(passages) + word() for _ in range(rng.randrange(0, 6)))) for k in range(40)] + [(40, ""), (41, None)]


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 300}, {"bucket_records": 1}])
def test_removal_of_odd_texts(frame, limits):
    rows = odd_documents(3)
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(frame(rows), **limits).collect()}
    assert got == brute_removal(rows)


def test_removal_of_repeated_rows_and_null_ids(frame):
    one, two, three = (" ".join(f"{p}{k}" for k in range(60)) for p in "abc")
    rows = [(1, one), (1, one), (2, two + one), (2, three), (None, three), (None, one)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(frame(rows)).collect())
    n = len(one)
    assert got == sorted([(False, 1, n, 0), (False, 1, n, 0), (False, 2, 2 * n, n), (False, 2, n, 0), (True, 0, n, n), (True, 0, n, n)])
    assert remove_repeats(frame([])).count() == 0


def test_whole_characters_stay(frame):
    text = "é" * 300
    row = with_removals(frame([(1, "a" + text), (2, text)]), whole_characters=True).where("doc_id = 1").first()
    assert bytes(row.removal.kept).decode("utf-8").startswith("a") and row.n_words == "x"


def test_difference_cover_and_order():
    for modulus in (7, 32):
        cover = difference_cover(modulus)
        assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))
    rng = np.random.default_rng(5)
    for data in (rng.integers(97, 99, 3000), np.tile([97, 98, 99], 700), np.concatenate([np.full(500, 97), rng.integers(97, 100, 900)])):
        data = data.astype(np.uint8)
        raw = data.tobytes() + b"\0" * 300
        places = np.arange(len(data) - 100)
        order, _ = suffix_order(data, places.copy(), 100)
        assert sorted(order) == list(places)
        prefixes = [raw[p:p + 100] for p in order]
        assert prefixes == sorted(prefixes)


def test_records_meet_whatever_surrounds_them():
    rng = random.Random(2)
    middle = bytes(rng.choice(b"abcd ") for _ in range(100))
    for _ in range(50):
        sides = [bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(300))) for _ in range(4)]
        found = []
        for a, b in (sides[:2], sides[2:]):
            anchor, _, first, windows = suffix_dedup.records_of(np.frombuffer(a + middle + b, np.uint8))
            assert windows.sum() == len(a + b) + 1
            found.append(anchor[np.searchsorted(first, len(a), "right") - 1])
        assert found[0] == found[1]


# --- SimHash -----------------------------------------------------------------------------------------------------------

def brute_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints, most=2):
    group = {i: i for i in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bin(prints[a] ^ prints[b]).count("1") <= most:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_of_the_table(spark, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    parts = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", parts[i]) for i in prints}


@pytest.mark.parametrize("paired", [256, 1])
def test_links_of_dense_fingerprints(spark, paired):
    """Few bits apart, with every variant above the limit in the second case."""
    from tallymill.llm.simhash import links

    rng = random.Random(9)
    prints, centre = {0}, rng.getrandbits(64)
    for _ in range(60):
        x = centre
        for _ in range(rng.randrange(0, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")
    found = connected(links(nodes, paired)).collect()
    want = brute_components(dict(zip(signed.values(), signed)))
    named = {r.node: r.component for r in found}
    got = {s: named.get(s, s) for s in signed.values()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_simhash_edges(frame):
    rows = [(5, None), (4, ""), (9, " \n"), (1, "One two"), (2, "one TWO"), (2, "one TWO"), (None, "one two"), (7, "é É"), (8, "word " * 70000)]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_duplicates(frame(rows)).collect())
    names = {None: 1, 5: 4, 4: 4, 9: 4, 1: 1, 2: 1, 7: 7, 8: 8}
    assert got == sorted((str(i), f"{brute_fingerprint(t):016x}", names[i]) for i, t in rows)
    assert near_duplicates(frame([])).count() == 0


def jaccard(a, b, n=5):
    sets = [{tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_row_of_each_component_stays(frame):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = []
    for g in range(40):
        base = [word() for _ in range(150)]
        rows += [(g * 10, " ".join(base)), (g * 10 + 1, " ".join(base).upper()), (g * 10 + 2, " ".join(base + [word()]))]
    rng.shuffle(rows)
    want = {i for i, c in brute_components({i: brute_fingerprint(t) for i, t in rows}).items() if i == c}
    left = without_copies(frame(rows))
    assert {r.doc_id for r in left.collect()} == want and 40 <= len(want) < 80 and left.columns == ["doc_id", "text", "n_words"]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, frame):
    a, b, c = (" ".join(f"{p}{k}" for k in range(80)) for p in "abc")
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in without_copies(frame(rows)).collect())
    assert kept([(1, a), (2, a), (2, b), (3, c)]) == [("1", a), ("2", b), ("3", c)]
    assert kept([(5, a), (5, a), (5, b)]) == [("5", a), ("5", b)]
    assert kept([(None, "a b c"), (None, "a b c"), (9, "a b c"), (1, None), (2, " ")]) == [("1", None), ("9", "a b c")]
    assert kept([]) == []
    texts = spark.createDataFrame([("x2", a), ("x10", a), (None, b)], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in without_copies(texts).collect()) == ["None", "x10"]


# --- fingerprints ------------------------------------------------------------------------------------------------------

def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_edit(rows):
    """rows: (id, text), any order."""
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((i, text, text[:len(text) - half] + after[:half], after))
    return out


def check_fingerprints(got, rows):
    assert len(got) == len(rows)
    by_text = {}
    for r, (i, text, edited, after) in zip(sorted(got, key=lambda r: (-r.doc_id, r.n_chars)), sorted(brute_edit(rows), key=lambda r: (-r[0], len(r[1])))):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < (1e-9 if max(len(a), len(b)) < 100 and len(a | b) < 128 else 0.22), (i, near, true)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_fingerprints_of_the_table(spark, texts):
    check_fingerprints(op1_fingerprints(spark, SF).collect(), list(texts.items()))


def test_fingerprint_edges(frame):
    rows = [(3, None), (2, ""), (9, "one"), (8, "a é 日本 " * 3000), (7, "a é 日本 " * 2999), (1, "x y z " * 100), (4, "One")]
    for parts in (1, 3, 20):
        check_fingerprints(fingerprint_documents(frame(rows), parts=parts).collect(), rows)
    one = fingerprint_documents(frame([(1, "single row here")])).first()
    assert one.near_next == 1.0 and one.n_chars == 15
    odd = fingerprint_documents(frame([(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "c")])).collect()
    assert sorted(str(r.doc_id) for r in odd) == ["1", "1", "2", "None", "None"]
    assert fingerprint_documents(frame([])).count() == 0


def test_fingerprints_of_other_ids(spark):
    """Text ids, in their own order, null ones last."""
    rows = [(f"doc {k % 37:02d}{k}", f"words of text {k} " * (k % 5 + 1)) for k in range(60)] + [("", "x"), ("é", "y")]
    for parts in (1, 4, 90):
        got = fingerprint_documents(spark.createDataFrame(rows, "doc_id string, text string"), parts=parts).collect()
        ordered = sorted(rows, reverse=True)
        want = {i: hashlib.sha256((t[:len(t) - len(t) // 2] + ordered[(k + 1) % len(ordered)][1][:len(t) // 2]).encode()).hexdigest() for k, (i, t) in enumerate(ordered)}
        assert {r.doc_id: r.edited_sha256 for r in got} == want and len(got) == len(rows)
    odd = fingerprint_documents(spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, "a")], "doc_id string, text string"), parts=3)
    assert sorted(str(r.doc_id) for r in odd.collect()) == ["None", "None", "a", "a"]


def test_sketches(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(6000)]
    text = " ".join(words).encode()
    whole = Sketch.of(text)
    assert abs(whole.distinct() / 5996 - 1) < 0.3
    assert str(Sketch.of(text, part=5000)) == str(whole)
    parts = [" ".join(words[k:k + 1004]).encode() for k in range(0, 6000, 1000)]
    union = Sketch.of(parts[0])
    for p in parts[1:]:
        union = union.merge(Sketch.of(p))
    assert str(union) == str(whole) and str(Sketch.read(str(whole))) == str(whole)
    half = Sketch.of(" ".join(words[:3000]).encode())
    assert abs(whole.resemblance(half) - 0.5) < 0.15 and abs(half.containment(whole) - 1) < 0.1 and abs(whole.containment(half) - 0.5) < 0.2
    small = Sketch.of(b"a b c d e f")
    assert small.distinct() == 2 and Sketch.of(b"").resemblance(Sketch.of(b"")) == 1.0 and Sketch.of(b"").resemblance(small) == 0.0
    rows = spark.createDataFrame([(1, p.decode()) for p in parts] + [(2, "a b"), (None, None)], "k int, text string")
    got = {r.k: r.s for r in merged(rows.select("k", sketch("text").alias("s")), "k", "s").collect()}
    assert got[1] == str(whole) and len(got) == 3
