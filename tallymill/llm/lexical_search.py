"""Ranked lexical search with two trees: one over items, one over documents.

Items are taken in blocks of bounded size, GROUP blocks together. For each such group documents are read once and become
sparse vectors over its terms, which are written. Counts over all of them give each term's weight. Then, block by block,
tasks take the vectors in chunks. A chunk's documents are ordered by the terms that
weigh most for them and become the leaves of a tree, FAN to a node; the block's items form another. A node of documents
holds for every term the greatest impact that one of its documents has, a node of items the greatest weight that one of its
items gives the term. The product of both is no less than the score of any pair of theirs. From the roots down, a pair of
nodes is dropped, with all documents and items below, where this bound is less than the weakest kth score among its items so
far: exactly, as no pair in it can be among the best. Leaves that meet are scored in whole numbers.

Chunks with the best bounds raise the kth scores first; a task keeps them from chunk to chunk, and hands on k rows of each
item at most. The best of those, over all tasks, are the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import FOLD, Texts, kept, ranked, text_or_empty, tuned

TOP = 10
#: Size of a block of items: each counts as its distinct terms and ITEM more. A block is what every task is given.
BLOCK_TERMS, ITEM = 1 << 15, 64
#: Blocks for which documents are read together; what the driver holds at a time.
GROUP = 8
#: Children of a node, and documents whose vectors a tree is built of.
FAN, CHUNK_DOCS = 8, 1024
#: Fixed values of the score: impact = SCALE * tf div (TF * tf + LENGTH * m), m = 100 - B + (B * n * N) div L.
SCALE, TF, LENGTH, B = 1_000_000_000, 1000, 8, 75


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters (lower-cased), digits and other characters than ASCII, as UTF-8."""
    return text.translate(FOLD).split()


# --- vectors ---------------------------------------------------------------------------------------------------------

def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, item, term, often): the terms of every row of items. `row` numbers the rows in the order of their ids."""

    @F.arrow_udf("array<struct<term:binary,often:bigint>>")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = Texts(column)
            yield pa.array([[{"term": t, "often": n} for t, n in Counter(terms_of(texts[i])).items()] for i in range(len(texts))],
                           pa.list_(pa.struct([("term", pa.binary()), ("often", pa.int64())])))

    rows = ranked(items.select(F.col(f"`{id_column}`").alias("item"), text_or_empty(text_column).alias("text")), ["item", "text"], "row")
    return rows.select("row", "item", F.inline(count(F.col("text"))))


def blocks_of(terms: DataFrame, limit: int) -> Iterator[dict[int, list]]:
    """Blocks {row: [(term, often), ...]} of whole items of `limit` in size, or of one item, in the order of rows."""
    sizes = kept(terms.groupBy("row").agg((F.count(F.lit(1)) + ITEM).alias("size")), "item-sizes")
    last = -1
    while True:
        block, total, more = [], 0, False
        for r in sizes.where(F.col("row") > last).orderBy("row").limit(limit).collect():
            if block and total + r["size"] > limit:
                more = True
                break
            block.append(r["row"])
            total += r["size"]
        if not block:
            return
        found: dict[int, list] = {}
        for r in terms.where(F.col("row").between(block[0], block[-1])).collect():
            found.setdefault(r["row"], []).append((bytes(r["term"]), r["often"]))
        yield found
        last = block[-1]
        if not more and len(block) < limit:
            return


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc, n, ids, often) of docs (doc, text): the number of terms, and those among `terms`, by place there.

    Texts without any term are left out: they count for nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            texts, kind = Texts(batch.column(1)), batch.schema.types[0]
            where, n, ids, often = [], [], [], []
            for i in range(len(texts)):
                words = terms_of(texts[i])
                if words:
                    own = [(k, c) for t, c in Counter(words).items() if (k := number(t)) is not None]
                    where.append(i)
                    n.append(len(words))
                    ids.append([k for k, _ in own])
                    often.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())).cast(kind), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(often, pa.list_(pa.int64()))], names=["doc", "n", "ids", "often"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "text").mapInArrow(read, f"doc {kind}, n bigint, ids array<int>, often array<bigint>")


def weights(found: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Each term's weight (0 for terms of no document), the number of documents, and of all their terms."""
    docs, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    out = np.zeros(n_terms, np.int64)
    for r in each.select("id", weight.cast("bigint").alias("w")).collect():  # as many rows as the block has terms
        out[r["id"]] = r["w"]
    return out, docs, total


# --- trees -----------------------------------------------------------------------------------------------------------

class Sparse:
    """Rows of (column, value), one after another, and dense parts of them."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.starts, self.columns, self.values = starts, columns, values

    def dense(self, first: int, end: int, place: np.ndarray, width: int) -> np.ndarray:
        """Rows first to end over the columns c with place[c] >= 0, which stand at place[c]."""
        a, b = self.starts[first], self.starts[end]
        to = place[self.columns[a:b]]
        row = np.repeat(np.arange(end - first), np.diff(self.starts[first:end + 1]))
        out = np.zeros((end - first, width))
        out[row[to >= 0], to[to >= 0]] = self.values[a:b][to >= 0]
        return out

    def taken(self, order: np.ndarray) -> "Sparse":
        sizes = np.diff(self.starts)[order]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.starts[:-1][order] - starts[:-1], sizes) + np.arange(starts[-1])
        return Sparse(starts, self.columns[at], self.values[at])

    def by_strongest(self) -> np.ndarray:
        """An order that brings rows with the same strongest columns together."""
        n = len(self.starts) - 1
        row = np.repeat(np.arange(n), np.diff(self.starts))
        order = np.lexsort((self.columns, -self.values, row))
        columns = np.append(self.columns[order], -1)
        full = np.diff(self.starts)
        at = [np.where(full > k, columns[np.minimum(self.starts[:-1] + k, len(columns) - 1)], -1) for k in range(3)]
        return np.lexsort(at[::-1])


def levels_of(rows: Sparse, width: int) -> list[np.ndarray]:
    """Coordinate maxima of the tree over rows: leaves of FAN rows first, the root last."""
    every, n = np.arange(width), len(rows.starts) - 1
    leaves = np.array([rows.dense(k, min(k + FAN, n), every, width).max(axis=0) for k in range(0, n, FAN)])
    out = [leaves.reshape(-1, width)]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append(np.array([below[k:k + FAN].max(axis=0) for k in range(0, len(below), FAN)]))
    return out


class Items:
    """The tree over a block's items, and the best scores found for each so far."""

    def __init__(self, rows: list[list[tuple[int, int]]], weight: np.ndarray, top: int):
        sizes = [len(r) for r in rows]
        columns = np.array([k for r in rows for k, _ in r], np.int64)
        values = np.array([n for r in rows for _, n in r], np.int64) * weight[columns]
        plain = Sparse(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), columns, values)
        self.order = plain.by_strongest()
        self.rows, self.width, self.top = plain.taken(self.order), len(weight), top
        self.levels = levels_of(self.rows, self.width)
        self.n = len(rows)
        #: The most a score can be is the sum of an item's weights times SCALE / TF.
        self.whole = float(np.add.reduceat(np.append(values, 0), plain.starts[:-1]).max(initial=0)) * (SCALE // TF) < 2**53 if len(values) else True
        self.best: list[list[tuple[int, tuple]]] = [[] for _ in rows]  # (score, key of the document), best first
        self.kth = np.zeros(self.n)
        self._leaves: dict[int, tuple] = {}

    def leaf(self, node: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Where the leaf's columns stand among themselves (others: -1), their number, and its items over them."""
        if node not in self._leaves:
            first, end = node * FAN, min(node * FAN + FAN, self.n)
            columns = np.unique(self.rows.columns[self.rows.starts[first]:self.rows.starts[end]])
            place = np.full(self.width, -1, np.int32)
            place[columns] = np.arange(len(columns))
            self._leaves[node] = place, len(columns), self.rows.dense(first, end, place, len(columns))
        return self._leaves[node]

    def weakest(self, level: int, node: int) -> float:
        span = FAN ** (level + 1)
        return self.kth[node * span:(node + 1) * span].min()

    def offer(self, item: int, scores: np.ndarray, docs: list) -> None:
        """Scores of documents (sort keys, ascending: better) for an item; ties go to the smaller key."""
        held = sorted([*self.best[item], *((int(s), d) for s, d in zip(scores, docs))], key=lambda x: (-x[0], x[1]))[:self.top]
        self.best[item] = held
        if len(held) == self.top:
            self.kth[item] = held[-1][0]


def search_chunk(items: Items, docs: Sparse, keys: list) -> None:
    """Offer every document of the chunk that can be among an item's best. docs: impacts; keys: what orders equal scores."""
    order = docs.by_strongest()
    docs, keys = docs.taken(order), [keys[k] for k in order]
    levels, n = levels_of(docs, items.width), len(keys)
    top_i, top_d = len(items.levels) - 1, len(levels) - 1
    # Bounds are products of doubles: a little is added for what they may have lost.
    bound = lambda li, i, ld, d: float(items.levels[li][i] @ levels[ld][d]) * (1 + 1e-9)
    stack = [(bound(top_i, 0, top_d, 0), top_i, 0, top_d, 0)]
    while stack:
        most, li, i, ld, d = stack.pop()
        if most <= 0 or most < items.weakest(li, i):
            continue
        if li == 0 and ld == 0:
            _score(items, i, docs, keys, d * FAN, min(d * FAN + FAN, n))
            continue
        # The tree that has more levels left is opened; the pair with the greatest bound is looked at first.
        if ld >= li:
            children = range(d * FAN, min(d * FAN + FAN, len(levels[ld - 1])))
            bounds = (levels[ld - 1][children.start:children.stop] @ items.levels[li][i]) * (1 + 1e-9)
            found = [(float(b), li, i, ld - 1, c) for b, c in zip(bounds, children)]
        else:
            children = range(i * FAN, min(i * FAN + FAN, len(items.levels[li - 1])))
            bounds = (items.levels[li - 1][children.start:children.stop] @ levels[ld][d]) * (1 + 1e-9)
            found = [(float(b), li - 1, c, ld, d) for b, c in zip(bounds, children)]
        stack += sorted(found)


def _score(items: Items, leaf: int, docs: Sparse, keys: list, low: int, high: int) -> None:
    place, width, left = items.leaf(leaf)
    right = docs.dense(low, high, place, width)
    if not items.whole:  # products beyond what doubles hold exactly
        left, right = left.astype(np.int64), right.astype(np.int64)
    scores, first = left @ right.T, leaf * FAN
    for k in range(len(left)):
        good = np.flatnonzero((scores[k] > 0) & (scores[k] >= items.kth[first + k]))
        if len(good):
            items.offer(first + k, scores[k][good], [keys[low + g] for g in good])


# --- the job ---------------------------------------------------------------------------------------------------------

def candidates(found: DataFrame, block: dict[int, list], terms: dict[bytes, int], weight: np.ndarray, n_docs: int, total: int, top: int) -> DataFrame:
    """(row, doc, place, score): the best documents of every item of the block among those of each task, `top` at most."""
    own = sorted({terms[t] for r in block.values() for t, _ in r})
    here = np.full(len(weight), -1, np.int32)
    here[own] = np.arange(len(own))
    order = sorted(block)
    rows = [[(int(here[terms[t]]), n) for t, n in block[k]] for k in order]
    shared = found.sparkSession.sparkContext.broadcast((order, rows, here, weight[own]))
    kind = found.schema["doc"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, rows, here, weight = shared.value
        items, kind = Items(rows, weight, top), None
        for batch in batches:
            kind = batch.schema.field("doc").type
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(at, CHUNK_DOCS)
                row = np.repeat(np.arange(part.num_rows), np.asarray(part["ids"].value_lengths(), np.int64))
                columns, tf = here[np.asarray(part["ids"].flatten())], np.asarray(part["often"].flatten(), np.int64)
                row, columns, tf = row[columns >= 0], columns[columns >= 0], tf[columns >= 0]
                m = 100 - B + (B * np.asarray(part["n"], np.int64) * n_docs) // total
                impact = (SCALE * tf) // (TF * tf + LENGTH * m[row])
                chunk = Sparse(np.searchsorted(row, np.arange(part.num_rows + 1)), columns, impact)
                docs, places = part["doc"].to_pylist(), part["place"].to_pylist()
                search_chunk(items, chunk, [(d is None, d, p) for d, p in zip(docs, places)])
        out = [(order[items.order[k]], d, p, s) for k in range(items.n) for s, (_, d, p) in items.best[k]]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), kind, pa.int64(), pa.int64()))], names=["row", "doc", "place", "score"])

    return found.select("doc", "place", "n", "ids", "often").mapInArrow(find, f"row bigint, doc {kind}, place bigint, score bigint")


def search(items: DataFrame, docs: DataFrame, item_column: str = "item_id", id_column: str = "doc_id", text_column: str = "text",
           top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each item's `top` documents of the highest score above 0: item id, rank (from 1), document id, score.

    Equal scores are ordered by ascending document id (null ids last), those of equal ids by the rows' order. Every row of
    docs is a document and every row of items an item, whatever their ids. Null and empty texts have no terms, so items
    without any have no rows, and nor has any item where no document has a term. Further columns are ignored; empty tables
    give an empty result.
    """
    spark = tuned(docs.sparkSession)
    terms = kept(item_terms(items, item_column, text_column), "item-terms")
    numbered = docs.select(F.col(f"`{id_column}`").alias("doc"), text_or_empty(text_column).alias("text"))
    kinds = (terms.schema["item"].dataType.simpleString(), numbered.schema["doc"].dataType.simpleString())
    out = spark.createDataFrame([], f"`{item_column}` {kinds[0]}, rank int, `{id_column}` {kinds[1]}, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "place")
    for group in batched(blocks_of(terms, block_terms), GROUP):
        number = {t: k for k, t in enumerate(sorted({t for block in group for r in block.values() for t, _ in r}))}
        found = kept(vectors(numbered, list(number)).withColumn("place", F.monotonically_increasing_id()), "vectors")
        weight, n_docs, total = weights(found, len(number))
        for block in group:
            near = candidates(found, block, number, weight, n_docs, total, top)
            near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            names = terms.where(F.col("row").between(min(block), max(block))).select("row", "item").distinct()
            out = out.union(kept(near.join(names, "row").select("item", "rank", "doc", "score"), "ranks"))
    return out
