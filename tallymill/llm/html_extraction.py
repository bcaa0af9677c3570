"""Main text of web pages with a recurrent block labeller.

A page is a sequence of leaf blocks. A bidirectional LSTM in numpy reads each block's tag-path and hashed-word vector in
both directions, so every block is judged with the whole page in view; blocks judged to be content make the text.

The model is trained on a bounded sample of the pages themselves. Where a page says what its article is (`article` or
`main`), its texts are taken as content, the rest as surroundings; both are set anew in random layouts with many ways to
mark menus, headers, footers, sidebars, notices, adverts, forms and comments, so the model learns marks, not one template.
"""

from __future__ import annotations

import html
import io
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import struct_of, text_or_empty, tuned
from tallymill.llm.html_blocks import WIDTH, Block, blocks_of, vectors

#: Most pages of the training sample, layouts made from them, units per direction, passes.
MAX_PAGES, LAYOUTS, UNITS, EPOCHS = 256, 2400, 16, 8
BATCH = 16
#: Bytes of the largest page, and most blocks of one, that the sample takes.
MAX_PAGE_BYTES, MAX_BLOCKS = 1 << 20, 400
#: Blocks whose vectors are held at once, and whose gate inputs are.
SLICE_BLOCKS, KEPT_BLOCKS = 1024, 20_000

# Words that mark the parts of a page, as the layouts use them.
MARKS = {
    "menu": "nav navigation navbar menu menubar topnav breadcrumb breadcrumbs links tabs toc",
    "header": "header masthead banner topbar branding logo site-header page-header",
    "footer": "footer bottom colophon copyright legal site-footer page-footer credits",
    "sidebar": "sidebar aside side related widget rail secondary trending popular recommended more-stories tags",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall disclaimer warning",
    "advert": "ad ads advert advertisement adbox ad-slot sponsor sponsored promo promotion dfp",
    "form": "form search login signup contact subscribe-form search-form",
    "comment": "comment comments comment-list replies respond discussion reader-comments disqus responses feedback",
    "share": "share social sharing buttons follow byline-share",
}
CONTENT_MARKS = "content post entry story article body text main-content article-body post-content entry-content page-content prose story-text"
NEUTRAL_MARKS = "wrap wrapper container row col inner outer block box page layout grid section group"
ELEMENTS = {"menu": "nav div ul", "header": "header div", "footer": "footer div", "sidebar": "aside aside div section", "notice": "div section aside",
            "advert": "div aside section", "form": "form div", "comment": "section div ol ul", "share": "div ul"}
SURROUND = frozenset("nav header footer aside form button".split())
_MARKED = frozenset(word for words in MARKS.values() for word in words.split())


# --- the network -----------------------------------------------------------------------------------------------------

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over padded batches; `w` holds all parameters by name."""

    def __init__(self, w: dict[str, np.ndarray] | None = None, width: int = WIDTH, units: int = UNITS, seed: int = 3):
        if w is None:
            rng, w = np.random.default_rng(seed), {}
            for side in "fb":
                w[f"x{side}"] = rng.normal(0, 0.1, (width, 4 * units))
                w[f"h{side}"] = rng.normal(0, 0.2, (units, 4 * units))
                w[f"c{side}"] = np.concatenate([np.zeros(units), np.ones(units), np.zeros(2 * units)])
            w["o"], w["b"] = rng.normal(0, 0.2, (2 * units, 1)), np.zeros(1)
        self.w = {k: np.asarray(v, np.float32) for k, v in w.items()}
        self.units = len(self.w["o"]) // 2

    def save(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, **self.w)
        return file.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Labeller:
        with np.load(io.BytesIO(raw)) as file:
            return cls(dict(file))

    def _run(self, side: str, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of one direction; x: steps, pages, width."""
        u, wx = self.units, x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        h = c = np.zeros((x.shape[1], u), np.float32)
        out = np.empty((*x.shape[:2], u), np.float32)
        for t in range(len(x)):
            before = h, c
            h, c, *parts = self._cell(side, wx[t], h, c)
            out[t] = h
            if trace is not None:
                trace.append((*parts, *before))
        return out

    def _cell(self, side: str, wx: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """h and c after one step, and the gates i, f, o, the input g and the squashed state."""
        u, z = self.units, wx + h @ self.w[f"h{side}"]
        gates, g = sigmoid(z[:, :3 * u]), np.tanh(z[:, 3 * u:])
        i, f, o = gates[:, :u], gates[:, u:2 * u], gates[:, 2 * u:]
        c = f * c + i * g
        s = np.tanh(c)
        return o * s, c, i, f, o, g, s

    def _back(self, side: str, x: np.ndarray, trace: list, dh_out: np.ndarray) -> dict[str, np.ndarray]:
        u, wh = self.units, self.w[f"h{side}"]
        dz_all = np.empty((*x.shape[:2], 4 * u), np.float32)
        dwh, dh, dc = np.zeros_like(wh), 0.0, 0.0
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, s, h_before, c_before = trace[t]
            dh = dh_out[t] + dh
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[t] = dz
            dwh += h_before.T @ dz
            dh, dc = dz @ wh.T, dc * f
        flat = dz_all.reshape(-1, 4 * u)
        return {f"x{side}": x.reshape(-1, x.shape[2]).T @ flat, f"h{side}": dwh, f"c{side}": flat.sum(0)}

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pages side by side, forwards and backwards, and which places are blocks."""
        longest = max(map(len, pages))
        ahead = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
        back, mask = np.zeros_like(ahead), np.zeros((longest, len(pages)), bool)
        for k, page in enumerate(pages):
            ahead[:len(page), k], back[:len(page), k], mask[:len(page), k] = page, page[::-1], True
        return ahead, back, mask

    @staticmethod
    def turned(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Backward states in the order of the blocks (and the other way round)."""
        lengths = mask.sum(0)
        step = np.arange(len(mask))[:, None]
        at = np.where(mask, lengths[None, :] - 1 - step, step)
        return np.take_along_axis(states, at[:, :, None], 0)

    def _gates(self, page: list[Block], first: int, end: int, columns: slice = slice(None)) -> np.ndarray:
        """Gate inputs of the page's blocks, both directions side by side; block vectors are made a slice at a time."""
        w, c = self._input
        return np.concatenate([vectors(page, k, min(k + SLICE_BLOCKS, end)) @ w[:, columns] + c[columns] for k in range(first, end, SLICE_BLOCKS)])

    def chances(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Every block's chance to be content. Each direction goes over the pages side by side in slices, and leaves one
        number per block; gate inputs of up to KEPT_BLOCKS blocks are kept for the second direction, others made anew."""
        self._input = [np.concatenate([self.w[f"{kind}f"], self.w[f"{kind}b"]], -1) for kind in "xc"]
        u, sizes = self.units, np.array([len(p) for p in pages])
        known = [self._gates(p, 0, len(p)) for p in pages] if sizes.sum() <= KEPT_BLOCKS else None
        sums = [np.full(n, self.w["b"][0], np.float32) for n in sizes]
        for side in "fb":
            columns = slice(0, 4 * u) if side == "f" else slice(4 * u, 8 * u)
            out = self.w["o"][:u, 0] if side == "f" else self.w["o"][u:, 0]
            h = c = np.zeros((len(pages), u), np.float32)
            for first in range(0, sizes.max(), SLICE_BLOCKS):
                steps = min(SLICE_BLOCKS, sizes.max() - first)
                wx = np.zeros((steps, len(pages), 4 * u), np.float32)
                for k, n in enumerate(sizes):
                    m = min(steps, n - first)
                    if m > 0:
                        low, high = (first, first + m) if side == "f" else (n - first - m, n - first)
                        part = known[k][low:high, columns] if known else self._gates(pages[k], low, high, columns)
                        wx[:m, k] = part[::1 if side == "f" else -1]
                states = np.empty((steps, len(pages), u), np.float32)
                for t in range(steps):
                    h, c, *_ = self._cell(side, wx[t], h, c)
                    states[t] = h
                added = states @ out
                for k, n in enumerate(sizes):
                    m = min(steps, n - first)
                    if m > 0:
                        low, high = (first, first + m) if side == "f" else (n - first - m, n - first)
                        sums[k][low:high] += added[:m, k][::1 if side == "f" else -1]
        return [sigmoid(s) for s in sums]

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        ahead, back, mask = self.padded(pages)
        y = np.zeros(mask.shape, np.float32)
        for k, own in enumerate(labels):
            y[:len(own), k] = own
        trace_f, trace_b = [], []
        states = np.concatenate([self._run("f", ahead, trace_f), self.turned(self._run("b", back, trace_b), mask)], 2)
        p = sigmoid(states @ self.w["o"] + self.w["b"])[:, :, 0]
        n = mask.sum()
        loss = -np.log(np.where(y > 0, p, 1 - p).clip(1e-7))[mask].sum() / n
        d = ((p - y) * mask / n)[:, :, None].astype(np.float32)
        grads = {"o": states.reshape(-1, states.shape[2]).T @ d.reshape(-1, 1), "b": d.sum((0, 1))}
        dstates = d @ self.w["o"].T
        grads |= self._back("f", ahead, trace_f, dstates[:, :, :self.units])
        grads |= self._back("b", back, trace_b, self.turned(dstates[:, :, self.units:], mask))
        return float(loss), grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for epoch in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i]) // 8)  # alike lengths pad little
            batches = [order[k:k + BATCH] for k in range(0, len(order), BATCH)]
            for k in rng.permutation(len(batches)):
                _, grads = self.step([pages[i] for i in batches[k]], [labels[i] for i in batches[k]])
                t += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / max(size, 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.w[name] -= np.float32(rate * (1 - epoch / epochs * 0.8)) * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        return self


# --- training pages --------------------------------------------------------------------------------------------------

def told(block: Block) -> int | None:
    """1: its page calls it the article; 0: its page calls it something else; None: it doesn't say."""
    unsaid, path = [], block.where
    while path and path.told is None:
        unsaid.append(path)
        path = path.outer
    for path in reversed(unsaid):  # each element is looked at once, however many blocks it is around
        outer = path.outer.told if path.outer else ""
        around = outer == "around" or any(x in SURROUND or x in _MARKED for x in path.own)
        path.told = "around" if around else "inside" if outer == "inside" or "article" in path.own or "main" in path.own else ""
    return {"around": 0, "inside": 1}.get(block.where.told) if block.where else None


class Layouts:
    """Random pages of real texts; a block's label says whether it was set as content."""

    def __init__(self, content: list[str], around: list[str], seed: int = 1):
        self.rng = random.Random(seed)
        self.content, self.around = content or ["Some text of a page, not long."], around or ["More", "About us"]
        self.label: dict[str, int] = {}

    def _text(self, label: int, short: bool = False) -> str:
        rng = self.rng
        # Surroundings borrow from articles too, or the words alone would give the label away.
        source = self.content if label or rng.random() < 0.6 else self.around
        words = rng.choice(source).split()
        size = rng.randrange(1, 6) if short else rng.choice([rng.randrange(3, 15), rng.randrange(10, 80), rng.randrange(60, 200)] if label else [rng.randrange(2, 12), rng.randrange(8, 60)])
        at = rng.randrange(max(1, len(words) - size))
        self.n += 1
        mark = f"q{label}n{self.n}q"  # taken out again when the page has been read
        return html.escape(" ".join([*words[at:at + size], mark]), quote=False)

    def _open(self, elements: str, marks: str, certain: bool = False) -> tuple[str, str]:
        rng, tag = self.rng, self.rng.choice(elements.split())
        named = certain or tag == "div" or rng.random() < 0.5
        attribute = ""
        if named:
            words = marks.split()
            name = (words[0] if rng.random() < 0.25 else rng.choice(words)) + rng.choice(["", "", "-1", "-wrap", " box", " widget-area", "__inner"])
            attribute = rng.choice([f' class="{name}"', f' id="{name}"', f" class='{rng.choice(NEUTRAL_MARKS.split())} {name}'"])
        return f"<{tag}{attribute}>", f"</{tag}>"

    def _around(self, kind: str) -> str:
        rng = self.rng
        if kind in ("notice", "advert", "comment", "sidebar") and rng.random() < 0.15:
            start, end = self._open("p", MARKS[kind], certain=True)
            return start + self._text(0) + end
        start, end = self._open(ELEMENTS[kind], MARKS[kind])
        if kind in ("menu", "share", "sidebar") and rng.random() < (0.4 if kind == "sidebar" else 0.7):
            items = "".join(f'<li><a href="/x">{self._text(0, True)}</a></li>' for _ in range(rng.randrange(2, 8)))
            body = items if start.startswith(("<ul", "<ol")) else f"<ul>{items}</ul>"
        elif kind == "form":
            lead = rng.choice(["", f"<p>{self._text(0)}</p>", f"<h3>{self._text(0, True)}</h3>", self._text(0)])
            body = lead + "".join(f"<label>{self._text(0, True)}</label><input>" for _ in range(rng.randrange(0, 4))) + f"<button>{self._text(0, True)}</button>"
        elif kind == "comment":
            body = "".join(rng.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li><p>{1}</p></li>", "<p>{1}</p>", "<div>{1}</div>", "<article class='comment'><p>{1}</p></article>"]).format(self._text(0, True), self._text(0)) for _ in range(rng.randrange(1, 6)))
        else:
            body = "".join(rng.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>", "<p><a href='/y'>{}</a></p>", "<h3>{}</h3>"]).format(self._text(0)) for _ in range(rng.randrange(1, 4)))
        if rng.random() < 0.3:
            body = f"<div class='{rng.choice(NEUTRAL_MARKS.split())}'>{body}</div>"
        return start + body + end

    def _content(self, inner: list[str]) -> str:
        rng, parts = self.rng, []
        if rng.random() < 0.8:
            parts.append(f"<h1>{self._text(1, True)}</h1>")
        for _ in range(rng.choice([1, 2, rng.randrange(2, 10), rng.randrange(5, 25)])):
            form = rng.choice(["<p>{}</p>"] * 8 + ["<p><b>{}</b></p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<p>{}<br>", "<p>{}", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<p>{} <a href='/z'>link</a></p>"])
            parts.append(form.format(self._text(1)))
        for extra in inner:
            parts.insert(rng.randrange(1, len(parts) + 1), extra)
        return "".join(parts)

    def page(self) -> tuple[list[Block], np.ndarray]:
        rng, self.n = self.rng, 0
        pick = lambda kinds, most: [self._around(rng.choice(kinds)) for _ in range(rng.randrange(0, most + 1))]
        inner = pick(["advert", "share", "notice", "sidebar", "form", "comment"], 2)
        tail = pick(["comment", "share", "form"], 1)
        style = rng.random()
        if style < 0.4:
            start, end = self._open("article main", CONTENT_MARKS)
        elif style < 0.85:
            start, end = self._open("div section", CONTENT_MARKS, certain=True)
        else:
            start, end = self._open("div section td", NEUTRAL_MARKS)
        body = start + self._content(inner) + ("" if rng.random() < 0.5 else "".join(tail)) + end
        if rng.random() < 0.3:
            body = f"<div class='{rng.choice(NEUTRAL_MARKS.split())}'>{body}</div>"
        page = "".join(pick(["header", "menu", "notice", "advert"], 4)) + body + "".join(tail) + "".join(pick(["sidebar", "comment", "form", "advert", "menu", "notice"], 3)) + "".join(pick(["footer"], 1))
        if rng.random() < 0.04:
            page = self._text(1)
        blocks, labels = [], []
        for block in blocks_of(page):
            words = block.text.split()
            marks = [w for w in words if w[:2] in ("q0", "q1") and w.endswith("q")]
            if not marks:
                continue
            text = " ".join(w for w in words if w not in marks) or "text"
            blocks.append(Block(text, block.where, min(block.linked, len(text))))
            labels.append(int(marks[0][1]))
        return blocks, np.array(labels, np.float32)


def train_on(pages: list[str], layouts: int = LAYOUTS, epochs: int = EPOCHS, max_blocks: int = MAX_BLOCKS) -> Labeller:
    """A model of these pages: half layouts of their texts, half the pages that say what their article is. Of a page with
    more than max_blocks blocks the sample has that many; every page is labelled whole."""
    content, around, real = [], [], []
    for page in pages:
        blocks = blocks_of(page)
        labels = [told(b) for b in blocks]
        for block, label in zip(blocks, labels):
            (around if label == 0 else content).append(block.text)
        if blocks and None not in labels and 1 in labels:
            real.append((blocks, np.array(labels, np.float32)))
    made = Layouts(content, around)
    examples = [x for x in (made.page() for _ in range(layouts)) if x[0]] + real
    examples = [(b[:max_blocks], y[:max_blocks]) for b, y in examples]
    return Labeller().fit([vectors(b) for b, _ in examples], [y for _, y in examples], epochs)


def train(pages: DataFrame, html_column: str = "html", id_column: str = "page_id", max_pages: int = MAX_PAGES,
          max_page_bytes: int = MAX_PAGE_BYTES) -> bytes:
    """Parameters of a model trained on the max_pages pages with the smallest hash of their id, of max_page_bytes at most.
    Of rows with one id the one with the least text counts."""
    pages = pages.where(F.octet_length(text_or_empty(html_column)) <= max_page_bytes)
    ids = pages.select(F.col(f"`{id_column}`").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_pages)
    sample = pages.select(F.col(f"`{id_column}`").alias("_id"), text_or_empty(html_column).alias("_html")).join(F.broadcast(ids), "_id")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_html"]).drop_duplicates("_id")
        return pd.DataFrame({"w": [train_on(list(rows["_html"])).save()]})

    found = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "w binary").first()  # max_pages rows at most
    return bytes(found["w"]) if found else Labeller().save()


# --- extraction ------------------------------------------------------------------------------------------------------

def texts_of(model: Labeller, pages: list[str], batch_blocks: int = KEPT_BLOCKS) -> list[str]:
    parsed = [blocks_of(page) for page in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and (end == at or len(parsed[order[end]]) * (end - at + 1) <= batch_blocks):
            end += 1
        for k, chances in zip(order[at:end], model.chances([parsed[k] for k in order[at:end]])):
            out[k] = "\n".join(b.text for b, p in zip(parsed[k], chances) if p >= 0.5)
        at = end
    return out


def main_text(page: Column, parameters: bytes) -> Column:
    """The main text of each page; the parameters have a fixed size."""
    shared = SparkSession.active().sparkContext.broadcast(parameters)

    @F.arrow_udf("struct<text:string,n_chars:bigint>")
    def extract(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Labeller.load(shared.value)
        for column in columns:
            texts = texts_of(model, [p or "" for p in column.to_pylist()])
            yield struct_of({"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return extract(page)


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
                  parameters: bytes | None = None, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per row of pages: id, url, text (empty if none), n_chars (its code points).

    Null and empty pages have an empty text; text without any markup is a single block. Repeated rows and null ids keep
    their rows; further columns are ignored, whatever their names; an empty table gives an empty one.
    """
    tuned(pages.sparkSession)
    parameters = parameters or train(pages, html_column, id_column, max_pages)
    rows = pages.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{url_column}`").alias("_url"), main_text(text_or_empty(html_column), parameters).alias("t"))
    return rows.select(F.col("_id").alias(id_column), F.col("_url").alias(url_column), "t.text", "t.n_chars")
