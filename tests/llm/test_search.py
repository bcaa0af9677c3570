"""Lexical search against every pair of item and document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallymill.llm import lexical_search
from tallymill.llm.lexical_search import Items, Sparse, search, search_chunk

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEM, DOC = "item_id bigint, text string, rank string", "doc_id bigint, text string, row string, score int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(items, docs, top=10):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    out = []
    for item, text in items:
        wanted, scores = Counter(terms(text)), []
        for i, w in bags:
            tf, score = Counter(w), 0
            for t, often in wanted.items():
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += often * weight * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * (25 + 75 * len(w) * n_docs // total)))
            if score > 0:
                scores.append((-score, i is None, i, score))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n_docs=700, n_items=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.choice([1, 1, 2, 3]) + rng.choice(["", "", "x", "É", "7"])
    docs = [(k, " ".join(word() for _ in range(rng.choice([1, 5, 30, 100])))) for k in rng.sample(range(5000), n_docs)]
    docs += [(6000 + k, docs[3][1]) for k in range(30)]  # equal scores
    return [(k, "; ".join(word() for _ in range(rng.randrange(1, 12)))) for k in range(n_items)], docs


@pytest.mark.parametrize("block", [1 << 15, 300])
def test_search_equals_every_pair(spark, block):
    items, docs = corpus(1)
    frames = spark.createDataFrame([(*r, "r") for r in items], ITEM), spark.createDataFrame([(*r, "r", 0) for r in docs], DOC).repartition(5)
    found = search(*frames, block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and rows_of(found) == brute_search(items, docs)


def test_odd_tables(spark, monkeypatch):
    items = [(1, "alpha Beta"), (2, None), (3, ""), (4, "no such term9"), (1, "gamma"), (None, "alpha"), (5, ". , !"), (6, "alpha " * 3000)]
    docs = [(3, "alpha"), (3, "ALPHA"), (2, "alpha!"), (None, "alpha"), (None, "beta"), (4, None), (5, ""), (6, "--"), (7, "é gamma " + "long " * 90_000), (8, "alpha beta")]
    frames = lambda i, d: (spark.createDataFrame([(*r, "r") for r in i], ITEM), spark.createDataFrame([(*r, "r", 0) for r in d], DOC))
    assert rows_of(search(*frames(items, docs))) == brute_search(items, docs)
    for i, d in (([], docs), (items, []), ([], []), (items, [(1, None), (2, "")])):
        found = search(*frames(i, d))
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]
    strings = search(spark.createDataFrame([("q", "alpha")], "item_id string, text string"), spark.createDataFrame([("b", "alpha"), ("a", "alpha")], "doc_id string, text string"))
    assert [(r.item_id, r.rank, r.doc_id) for r in strings.orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


def random_rows(rng, n, width, most):
    columns = [np.sort(rng.choice(width, rng.integers(1, most), replace=False)) for _ in range(n)]
    return [[(int(c), int(rng.integers(1, 5))) for c in own] for own in columns]


def sparse(rows, scale=1):
    flat = [x for r in rows for x in r]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return Sparse(starts, np.array([c for c, _ in flat]), np.array([v * scale for _, v in flat]))


@pytest.mark.parametrize("scale", [1, 10**12])
def test_pruned_pairs_hold_no_best_one(scale, monkeypatch):
    """Both trees over rows without any pattern, also with products that doubles don't hold."""
    rng = np.random.default_rng(5)
    wanted, docs, weight = random_rows(rng, 37, 60, 9), random_rows(rng, 333, 60, 12), rng.integers(1, 9000, 60)
    scored, score = [0], lexical_search._score
    monkeypatch.setattr(lexical_search, "_score", lambda *a: scored.__setitem__(0, scored[0] + 1) or score(*a))
    items = Items(wanted, weight * scale, 5)
    for k in range(0, 333, 100):
        search_chunk(items, sparse(docs[k:k + 100]), [(k + j) * 7 % 333 for j in range(len(docs[k:k + 100]))])
    dense = np.zeros((333, 60), object)
    for k, r in enumerate(docs):
        for c, v in r:
            dense[k, c] = v
    for place, own in enumerate(items.order):
        scores = [(-sum(n * int(weight[c]) * scale * int(dense[k, c]) for c, n in wanted[own]), k * 7 % 333 if k < 100 else None, k) for k in range(333)]
        want = sorted((s, ((k - k // 100 * 100) + k // 100 * 100) * 7 % 333) for s, _, k in scores if s < 0)[:5]
        assert items.best[place] == [(-s, key) for s, key in want]
    assert scored[0] < 5 * 13 * 4
