"""Benchmark decontamination with one Aho-Corasick automaton.

The items' words, lower-cased, are cut into windows; each window is a pattern " w1 w2 ... wn " of the automaton. A
document's words, written in the same way, are scanned once; a match gives word numbers, and these the places in the
original text. An automaton holds windows of up to `block_bytes`, and a long item's windows may be in several; a larger
benchmark is scanned block by block, in jobs one after another, and the spans of the blocks are united.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import FOLD, Texts, kept, release, struct_of, text_or_empty, tuned

WINDOW_WORDS = 10
BLOCK_BYTES = 16 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOUND = "struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>,items:array<string>>"


def folded(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def spaced(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def automaton(items: list[tuple[str, bytes]], window: int):
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, text in items:
        words = folded(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(spaced(words[k:k + window]), set()).add(item)
    machine = ahocorasick.Automaton()
    for pattern, of in owners.items():
        machine.add_word(pattern, (len(pattern), pattern.count(" ") - 1, tuple(of)))
    if owners:
        machine.make_automaton()
    return machine if owners else None


def scan(machine, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, merged runs of hit words (first, last), items found."""
    words = folded(text)
    if not words or machine is None:
        return len(words), [], []
    line, hits, items, gaps = spaced(words), [], set(), None
    for end, (_, n, of) in machine.iter(line):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(gaps, end)) - 1
        hits.append((last - n + 1, last))
        items.update(x for x in of if x is not None)
    runs: list[tuple[int, int]] = []
    for first, last in sorted(hits):
        if runs and first <= runs[-1][1] + 1:
            runs[-1] = runs[-1][0], max(last, runs[-1][1])
        else:
            runs.append((first, last))
    return len(words), runs, sorted(items)


def places(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """The runs with their code points in the original text."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"first": a, "last": b, "start": int(points[at[a][0]]), "end": int(points[at[b][1]])} for a, b in runs]


def found(text: Column, items: list[tuple[str, bytes]], window: int) -> Column:
    # At most `block_bytes` of windows, whatever the benchmark's size.
    shared = SparkSession.active().sparkContext.broadcast(items)

    @F.arrow_udf(_FOUND)
    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(shared.value, window)
        for column in columns:
            texts, counts, spans, names = Texts(column), [], [], []
            for i in range(len(texts)):
                raw = texts[i]
                n, runs, which = scan(machine, raw)
                counts.append(n)
                spans.append(places(raw, runs))
                names.append(which)
            place = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])
            yield struct_of({
                "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(place)),
                "items": pa.array(names, pa.list_(pa.string())),
            })

    return search(text)


def cut(text: bytes, window: int, limit: int) -> Iterator[bytes]:
    """A long item as runs of its windows: every window is in one of them, and none is new."""
    words = folded(text)
    step = max(1, limit * len(words) // max(1, len(text) * window))
    if len(words) <= step + window - 1:
        yield text
    else:
        for k in range(0, len(words) - window + 1, step):
            yield b" ".join(words[k:k + step + window - 1])


def blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks that fit one automaton; the driver holds one block at a time."""
    rows = benchmark.select(F.col(f"`{item_column}`").cast("string").alias("_i"), text_or_empty(text_column).alias("_t"))
    block, held = [], 0
    for row in rows.toLocalIterator():
        for part in cut(row["_t"].encode(), window, block_bytes):
            block.append((row["_i"], part))
            held += len(part) * window
            if held >= block_bytes:
                yield block
                block, held = [], 0
    if block:
        yield block


def contaminated_spans(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
                       item_text: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df and two more columns: n_words, and `found` with the hit spans (words, and code points of the original text) and
    the items they come from.

    A window is `window` consecutive words of an item; an item of fewer words is one window, one without words is none.
    Null texts have no words; items with equal ids are one item; an item without id is found but not counted; columns
    named n_words or found are replaced. Empty tables give no hits, or no rows. Each block of items is a job of its own
    over the written result of the one before, so a worker holds one automaton.
    """
    spark = tuned(df.sparkSession)
    columns = [c for c in df.columns if c not in ("n_words", "found")]
    text = F.coalesce(F.col(f"row.`{text_column}`").cast("string"), F.lit(""))
    rows, before = df.select(F.struct("*").alias("row")), []
    for k, block in enumerate(blocks(benchmark, item_column, item_text, block_bytes, window)):
        if not k:
            rows = rows.withColumn("found", found(text, block, window))
            continue
        written: list[str] = []
        rows = kept(rows, "spans", written)
        release(spark, before)
        before = written
        both = united([F.col("found"), F.col("more")])
        rows = rows.withColumn("more", found(text, block, window)).select(
            "row", F.struct(F.col("found.n_words").alias("n_words"), both["spans"].alias("spans"), both["items"].alias("items")).alias("found"))
    if "found" not in rows.columns:
        rows = rows.withColumn("found", found(text, [], window))
    merged = F.struct(F.col("found.spans").alias("spans"), F.col("found.items").alias("items"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("found.n_words").alias("n_words"), merged.alias("found"))


def united(parts: list[Column]) -> Column:
    """The spans and items of several blocks as one."""
    spans = F.array_sort(F.flatten(F.array(*[p["spans"] for p in parts])))
    grown = F.aggregate(
        spans, F.slice(spans, 1, 0),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"),
                F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"),
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
            ))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in parts]))))
    return F.struct(grown.alias("spans"), items.alias("items"))


def summary(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per row of `contaminated_spans`: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans, items = F.col("found.spans"), F.col("found.items")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return df.select(
        F.col(f"`{id_column}`").alias(id_column), "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
