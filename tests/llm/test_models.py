"""The two trained operators on held-out rows, and their parts against plain calculations."""

from __future__ import annotations

import html
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallymill.llm import html_blocks, html_extraction
from tallymill.llm.common import Texts
from tallymill.llm.html_blocks import blocks_of, vectors
from tallymill.llm.html_extraction import Labeller, Layouts, extract_pages, texts_of, train_on
from tallymill.llm.quality import Ftrl, features, fit_rows, score_documents, scored, train
from tallymill.llm.queries import op7_html_extraction, op10_quality

from .conftest import SF


# --- quality -----------------------------------------------------------------------------------------------------------

def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) > 0.97


def test_quality_edges(spark, frame):
    docs = frame([(i, f"some plain words here number {i}") for i in range(40)] + [(100 + i, "LOUD!! LOUD!! LOUD!!") for i in range(40)]
                 + [(500, None), (501, ""), (None, "words"), (3, "again"), (502, "word " * 60000), (503, "é 日本")])
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(5, 0), (6, None), (None, 1), (3, 1), (3, 1)], "doc_id bigint, quality int")
    rows = score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[500].score == by[501].score and by[None].held_out
    assert all(by[i].predicted == 1 for i in range(40)) and all(by[100 + i].predicted == 0 for i in range(40))
    untrained = score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in untrained} == {0.5}
    assert score_documents(frame([]), labels).count() == 0
    assert np.array_equal(train(docs, labels, max_rows=10), train(docs.repartition(7), labels.repartition(3), max_rows=10))


def test_scores_are_dot_products():
    texts = pa.array(["a b a B!", "", "x", "one TWO three four " * 50])
    weights = np.random.default_rng(0).normal(size=(1 << 18) + 1)
    got = scored(Texts(texts), weights, 18)
    for _, _, numbers, shares, bounds in features(Texts(texts)):
        for i in range(4):
            part = slice(bounds[i], bounds[i + 1])
            assert got[i] == pytest.approx(1 / (1 + np.exp(-(weights[numbers[part]] @ shares[part] + weights[-1]))))
    assert scored(Texts(texts.slice(2, 1)), weights, 18)[0] == pytest.approx(got[2])


def test_ftrl_learns_and_keeps_unused_weights_at_zero():
    model = Ftrl(4)
    for _ in range(200):
        model.update(np.array([0, 4]), np.array([1.0, 0.25]), 1.0)
        model.update(np.array([1, 4]), np.array([1.0, 0.25]), 0.0)
    w = model.weights()
    assert w[0] > 1 and w[1] < -1 and w[2] == w[3] == 0
    assert len(fit_rows(pa.array([], pa.string()), np.array([]))) == (1 << 18) + 1


# --- pages -------------------------------------------------------------------------------------------------------------

def test_blocks():
    page = """<!DOCTYPE html><title>t &lt;</title><style>p{}</style><script>var t="</p><p>x";</script><!-- <p>no</p> -->
    <div class="a b"><p>One &amp; two\n  <b>bold</b>&nbsp;x<p>Three<br>four <a href="x>y">link</a></div><ul><li>i<li>j</ul>tail < 3"""
    found = blocks_of(page)
    assert [b.text for b in found] == ["One & two bold x", "Three", "four link", "i", "j", "tail < 3"]
    assert found[0].path == ("div", "a", "b", "p") and found[1].path == ("div", "a", "b", "p") and found[3].path == ("ul", "li")
    assert found[2].linked == 4 and blocks_of("") == [] and blocks_of("<p> </p>") == []
    assert [b.text for b in blocks_of("plain &eacute;")] == ["plain é"]
    assert [b.text for b in blocks_of("<p>a</p></div></b><p>b")] == ["a", "b"]
    assert len(blocks_of("<div>" * 3000 + "x")) == 1


def test_elements_without_end_tag_lose_no_text():
    head = "<html><head><meta charset=u><title>t</title><script>x</script>\n"
    for page in (head + "<body><p>One<p>Two", head + "<p>One</p><p>Two</p>", head + "One<p>Two", head + "</head><body><p>One<p>Two"):
        assert [b.text for b in blocks_of(page)] == ["One", "Two"]
    for tag in "svg math iframe canvas object select noscript template".split():
        for start in (f"<{tag}/>", f'<{tag} a="b" />', f"<{tag} class=x>"):
            assert [b.text for b in blocks_of(f"<div>{start}<p>One</p></div><p>Two</p>")] == ["One", "Two"], start
        assert [b.text for b in blocks_of(f"<p>One</p><{tag} a=b/>no</{tag}><p>Two</p>")] == ["One", "Two"]
    assert [b.text for b in blocks_of("<p>One</p><script src='a'/><p>Two</p><style>no <p>no</p>")] == ["One", "Two"]
    assert len(blocks_of("<canvas>" * 100000 + "<p>One")) == 1


@pytest.mark.parametrize("page", [
    "<a " * 500_000, "<a " * 500_000 + '">', "<a '\"" * 200_000 + ">", "<!x" * 400_000, "</x " * 300_000, "<div>x" * 150_000, "<div>" * 200_000 + "</p>" * 100_000,
    "<p><li>" + "<b>" * 100_000 + "<div>x</div>" * 30_000, "<li><ul>" + "<div>" * 100_000 + "<li></li>" * 50_000,
], ids=range(9))
def test_any_page_is_read_in_one_pass(page):
    start = time.process_time()
    blocks_of(page)
    assert time.process_time() - start < 5


def test_ends_of_tags_are_those_of_the_pattern():
    """Tags with and without end, against trying each of them; texts come out whole."""
    rng = random.Random(3)
    for _ in range(300):
        page = "".join(rng.choice(["<a ", "<b", ">", '"', "'", "x", " ", "</p", "<!d", "<", "é"]) for _ in range(40))
        at, want = 0, []
        while at < len(page):
            token = html_blocks._TOKEN.match(page, at)
            want.append((token["text"], (token["tag"] or "").lower(), token["end"] or "", token["attributes"] or ""))
            at = token.end()
        assert list(html_blocks.tokens_of(page)) == want


def test_slices_do_not_change_a_page(model, monkeypatch):
    pages = ["".join(f'<p class="c{k % 7}">word{k} text</p><nav>menu {k}</nav>' for k in range(n)) for n in (1, 40, 90)]
    whole = texts_of(model, pages)
    monkeypatch.setattr(html_extraction, "SLICE_BLOCKS", 16)
    assert texts_of(model, pages) == whole
    monkeypatch.setattr(html_extraction, "KEPT_BLOCKS", 0)
    assert texts_of(model, pages) == whole and texts_of(model, pages, 1) == whole


def test_a_large_page_is_held_once(model):
    import tracemalloc

    page = "".join(f'<p class="c{k % 9}">word {k}</p>' for k in range(80_000))
    tracemalloc.start()
    texts_of(model, [page])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(page)  # 550 floats a block would be 80 times the page


def test_gradients():
    rng = np.random.default_rng(1)
    model = Labeller(width=5, units=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pages = [rng.normal(size=(n, 5)) for n in (4, 2, 6)]
    labels = [rng.integers(0, 2, len(p)).astype(float) for p in pages]
    _, grads = model.step(pages, labels)
    for name in model.w:
        flat, g = model.w[name].reshape(-1), grads[name].reshape(-1)
        for k in rng.permutation(len(flat))[:6]:
            held = flat[k]
            flat[k] = held + 1e-3
            up = model.step(pages, labels)[0]
            flat[k] = held - 1e-3
            down = model.step(pages, labels)[0]
            flat[k] = held
            assert g[k] == pytest.approx((up - down) / 2e-3, abs=2e-3, rel=0.05)


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(120).collect()
    return train_on([r.html for r in rows], layouts=900, epochs=6)


def test_layouts_never_seen(model):
    made = Layouts(["Some words of a story that goes on and on, with signs. And more of it, much more."] * 3, ["Home", "About us and more"], seed=77)
    right = [((model.chances([b])[0] >= 0.5) == y) for b, y in (made.page() for _ in range(250)) if b]
    assert np.mean(np.concatenate(right)) > 0.93


def test_a_page_of_another_kind(model):
    page = """<html><body><header class="site-header"><h1>My site</h1></header><nav><a href=a>One</a> <a href=b>Two</a></nav>
    <div class="cookie-notice">We use cookies. <button>OK</button></div><div id="content"><h1>The big title</h1><p>First paragraph of text,
    with words &amp; things that go on for a while.</p><div class="advertisement">Buy our stuff now, cheap.</div><p>Second paragraph that is
    also long and tells more.</p></div><aside class="sidebar"><ul><li><a href=x>Other story</a></li></ul></aside><section id="comments">
    <div class="comment"><p>I think this is great, thank you.</p></div></section><footer>me</footer></body></html>"""
    text = texts_of(model, [page, "", page])[2]
    assert text == "The big title\nFirst paragraph of text, with words & things that go on for a while.\nSecond paragraph that is also long and tells more."


def test_articles_of_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op7_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = "\n".join(b.text for b in blocks_of(pages[r.page_id].html) if "article" in b.path)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_page_edges(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article><p>" + html.escape("word & " * 40000) + "</p></article>"), (None, "v", "<p>"), (4, "u", "<nav>x</nav>"), (4, "u", "<nav>x</nav>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    got = extract_pages(pages, parameters=model.save()).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "" and by[2].n_chars == 0 and by[3].n_chars == 7 * 40000 - 1 and by[None].text == "" and by[4].text == ""
    assert extract_pages(pages.limit(0)).count() == 0
