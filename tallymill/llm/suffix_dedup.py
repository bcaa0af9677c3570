"""Removal of repeated byte strings with suffix arrays, built bucket by bucket with a difference cover.

Which suffixes can be equal for `LENGTH` bytes? Every window of that length has a smallest `GRAM`-byte piece, its anchor;
equal windows have equal anchors at equal places. Windows are therefore gathered by anchor: neighbouring windows with the
same anchor are one record. Anchors that occur once are done with. Records equal to the last byte are all repeats of the
first of them. What is left, different records of one anchor, goes to that anchor's bucket.

Buckets are sorted in blocks of bounded size, one after another. In a block the suffixes at places of a difference cover
(mod `COVER`) are ranked first, by doubling. All suffixes of the block are then ordered by their first `COVER` bytes, and
ties, however long, by the ranks at the nearest two places that the cover holds for both. Neighbours in this order that
agree on `LENGTH` bytes are equal windows; all but the first of each group, in the order of documents, are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallymill.llm.common import SLICE, Texts, kept, mixed, prefix_hash, ranked, release, span_hash, struct_of, text_or_empty, tuned

LENGTH, GRAM, COVER = 100, 24, 32
#: Bytes of a block that is sorted at once, and records beyond which an anchor's windows are split further.
BLOCK_BYTES, BUCKET_RECORDS = 1 << 20, 4096


# --- records ---------------------------------------------------------------------------------------------------------

def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    held, size = values, 1
    while 2 * size <= width:
        held = np.minimum(held[:-size], held[size:])
        size *= 2
    rest = width - size
    return np.minimum(held[:len(held) - rest], held[rest:]) if rest else held


def records_of(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Records of one text: anchor hash, record hash, first window, number of windows."""
    gram = min(GRAM, length)
    width = length - gram + 1
    found = []
    for at in range(0, max(len(text) - length + 1, 0), SLICE // 2):
        part = text[at:at + SLICE // 2 + length - 1]
        sums = prefix_hash(part)
        starts = np.arange(len(part) - gram + 1)
        hashes = span_hash(sums, starts, starts + gram)
        # The place in the lower bits: of equal pieces the first is the smallest, and the minimum says where it is.
        least = sliding_least((hashes & ~np.uint64(SLICE - 1)) | starts.astype(np.uint64), width)
        anchors = (least & np.uint64(SLICE - 1)).astype(np.int64)
        edges = np.flatnonzero(np.diff(anchors)) + 1
        first, last = np.concatenate(([0], edges)), np.concatenate((edges, [len(anchors)]))
        at_anchor = anchors[first]
        shape = ((at_anchor - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
        content = mixed(span_hash(sums, first, last - 1 + length) ^ mixed(shape))
        found.append((hashes[at_anchor], content, first + at, last - first))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def records(docs: DataFrame, length: int) -> DataFrame:
    """anchor, content, doc, first, windows of all records of docs (doc, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = Texts(batch.column(1)), np.asarray(batch.column(0))
            held, rows = [], 0
            for i in range(len(texts) + 1):
                if held and (i == len(texts) or rows > 100_000):
                    columns = [np.concatenate(c) for c in zip(*held)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "doc", "first", "windows"])
                    held, rows = [], 0
                if i < len(texts):
                    anchor, content, first, windows = records_of(texts.data[texts.offsets[i]:texts.offsets[i + 1]], length)
                    held.append((anchor.view(np.int64), content.view(np.int64), np.full(len(first), ids[i], np.int64), first, windows.astype(np.int32)))
                    rows += len(first)

    return docs.mapInArrow(cut, "anchor bigint, content bigint, doc bigint, first bigint, windows int")


# --- blocks ----------------------------------------------------------------------------------------------------------

def difference_cover(modulus: int) -> list[int]:
    """Residues among which every difference modulo `modulus` occurs; each is chosen for the most new differences."""
    cover, missing = [0], set(range(1, modulus))
    while missing:
        best = max(range(1, modulus), key=lambda c: len(missing & ({(c - d) % modulus for d in cover} | {(d - c) % modulus for d in cover})))
        missing -= {(best - d) % modulus for d in cover} | {(d - best) % modulus for d in cover}
        cover.append(best)
    return sorted(cover)


def shifts(cover: list[int], modulus: int) -> np.ndarray:
    """[a, b]: the least shift that takes places of residues a and b into the cover together."""
    inside = np.isin(np.arange(2 * modulus) % modulus, cover)
    return np.array([[next(d for d in range(modulus) if inside[a + d] and inside[b + d]) for b in range(modulus)] for a in range(modulus)])


_COVER = difference_cover(COVER)
_SHIFTS = shifts(_COVER, COVER)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each place is in."""
    change = np.zeros(len(keys[0]), bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.cumsum(change)


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at places of the cover by their first `depth` bytes or more; words: 8 bytes at each place."""
    places = np.flatnonzero(np.isin(np.arange(n) % COVER, _COVER))
    rank = np.zeros(n + COVER + 1, np.int64)
    keys = [words[places + 8 * k] for k in range(COVER // 8)]
    reach = COVER
    while True:
        order = np.lexsort(keys[::-1])
        numbers = runs(*[k[order] for k in keys]) + 1
        rank[places[order]] = numbers
        if reach >= depth or numbers[-1] == len(places):
            return rank
        # The suffix `reach` bytes on is at a place of the cover, too; past the end it ranks before all.
        keys = [rank[places], rank[np.minimum(places + reach, n + COVER)]]
        reach *= 2


def suffix_order(data: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their suffixes (exact for `depth` bytes), and the 8 bytes at each place of data."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(depth + 2 * COVER + 8, np.uint8)))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)
    keys = [words[places + 8 * k] for k in range(COVER // 8)]
    order = np.lexsort(keys[::-1])
    group = runs(*[k[order] for k in keys])
    places = places[order]
    size = np.bincount(group)
    active = np.flatnonzero(size[group] > 1)
    if len(active):
        rank = cover_ranks(words, n, depth)
        bounds = group[active]
        while len(active):
            own = places[active]
            starts = np.flatnonzero(np.concatenate(([True], bounds[1:] != bounds[:-1])))
            counts = np.diff(np.concatenate((starts, [len(bounds)])))
            pivot = np.repeat(own[starts + counts // 2], counts)
            shift = _SHIFTS[own % COVER, pivot % COVER]
            side = np.sign(rank[np.minimum(own + shift, n)] - rank[np.minimum(pivot + shift, n)])
            key = bounds * 3 + side + 1
            by = np.argsort(key, kind="stable")
            places[active] = own[by]
            key, side = key[by], side[by]
            numbers = runs(key)
            again = (side != 0) & (np.bincount(numbers)[numbers] > 1)
            active, bounds = active[again], numbers[again]
    return places, words


def repeats_of_block(data: np.ndarray, at: np.ndarray, windows: np.ndarray, docs: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows (doc, first, last) that start earlier elsewhere in the block. Record i lies at data[at[i]:]."""
    record = np.repeat(np.arange(len(at)), windows)
    step = np.arange(len(record)) - np.repeat(np.cumsum(windows) - windows, windows)
    where = at[record] + step
    owner = np.full(len(data), -1, np.int64)
    owner[where] = np.arange(len(where))
    places, words = suffix_order(data, where, length)
    same = np.ones(len(places) - 1, bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= words[places[1:] + k] == words[places[:-1] + k]
    group = np.cumsum(np.concatenate(([True], ~same)))
    which = owner[places]
    doc, start = docs[record[which]], firsts[record[which]] + step[which]
    order = np.lexsort((start, doc, group))
    later = np.ones(len(order), bool)
    later[0] = False
    g, d, s = group[order], doc[order], start[order]
    head = np.concatenate(([True], g[1:] != g[:-1]))
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (d != d[lead]) | (s != s[lead])
    d, s = d[later], s[later]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1))) if len(d) else np.zeros(0, bool)
    firsts_of = np.flatnonzero(new)
    return d[firsts_of], s[firsts_of], s[np.concatenate((firsts_of[1:], [len(s)]))[:len(firsts_of)] - 1]


def sorted_buckets(rows: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Repeats (doc, first, last) among rows (anchor, doc, first, windows, piece), which come bucket by bucket."""

    def flush(held: list) -> pa.RecordBatch:
        pieces = [h[4] for h in held]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        doc, first, last = repeats_of_block(
            np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, np.array([h[3] for h in held], np.int64),
            np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), length)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(last)], names=["doc", "first", "last"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= block_bytes and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    return rows.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "doc", "first", "windows", "piece").mapInArrow(
        block, "doc bigint, first bigint, last bigint")


# --- the job ---------------------------------------------------------------------------------------------------------

def with_pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (anchor, hot, doc, first, windows) with the bytes of each record."""

    @F.arrow_udf("array<struct<anchor:bigint,hot:boolean,first:bigint,windows:int,piece:binary>>")
    def pieces(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("anchor", pa.int64()), ("hot", pa.bool_()), ("first", pa.int64()), ("windows", pa.int32()), ("piece", pa.binary())]))
        for text, lists in columns:
            texts = Texts(text)
            yield pa.array([
                [{**r, "piece": texts.data[texts.offsets[i] + r["first"]:texts.offsets[i] + r["first"] + r["windows"] - 1 + length].tobytes()} for r in found]
                for i, found in enumerate(lists.to_pylist())
            ], kind)

    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "hot", "first", "windows")).alias("r"))
    return docs.join(lists, "doc").select("doc", F.explode(pieces(F.col("text"), F.col("r"))).alias("r")).select("doc", "r.*")


def split_windows(rows: DataFrame, length: int) -> DataFrame:
    """Repeats among the records of hot anchors: every window is a key of its own, taken together before the shuffle."""

    @F.arrow_udf("array<struct<start:bigint,a:bigint,b:bigint>>")
    def windows(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))
        for pieces, firsts, counts in columns:
            out = []
            for piece, first, n in zip(pieces.to_pylist(), firsts.to_pylist(), counts.to_pylist()):
                at = [hashlib.blake2b(piece[k:k + length], digest_size=16).digest() for k in range(n)]
                out.append([{"start": first + k, "a": int.from_bytes(x[:8], "little", signed=True), "b": int.from_bytes(x[8:], "little", signed=True)} for k, x in enumerate(at)])
            yield pa.array(out, kind)

    each = rows.select("doc", F.explode(windows(F.col("piece"), F.col("first"), F.col("windows"))).alias("w")).select("doc", "w.*")
    lead = each.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("lead"))
    return each.join(lead, ["a", "b"]).where((F.col("doc") != F.col("lead.doc")) | (F.col("start") != F.col("lead.start"))).select(
        "doc", F.col("start").alias("first"), F.col("start").alias("last"))


def finished(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """Kept, and the shuffle files of what led to it released."""
    out = kept(df, label, scratch)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_records: int = BUCKET_RECORDS) -> DataFrame:
    """Runs (doc, first, last) of the starts of all windows that start earlier too. docs: doc (bigint, ordered), text."""
    own, scratch = records(docs, length), []
    often = finished(
        own.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
        .where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("differ")), "anchors", scratch)
    found = finished(own.join(often, "anchor"), "records", scratch)
    # Equal records: every one but the first repeats it. One row per task and record is shuffled here.
    lead = found.groupBy("anchor", "content").agg(F.min(F.struct("doc", "first", "windows")).alias("lead"), F.first("differ").alias("differ"))
    lead = finished(lead, "leads", scratch)
    again = found.join(lead.select("anchor", "content", "lead"), ["anchor", "content"]).where(
        (F.col("doc") != F.col("lead.doc")) | (F.col("first") != F.col("lead.first")))
    same = finished(again.select("doc", "first", (F.col("first") + F.col("windows") - 1).alias("last")), "same", scratch)
    # Different records of one anchor: the first of each kind goes to the anchor's bucket.
    kinds = lead.where("differ").select("anchor", "lead.*")
    hot = kinds.groupBy("anchor").count().where(F.col("count") > bucket_records).select("anchor", F.lit(True).alias("hot"))
    wanted = kinds.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    pieces = finished(with_pieces(docs, wanted, length), "pieces", scratch)
    blocks = sorted_buckets(pieces.where("not hot"), length, block_bytes)
    out = finished(same.union(blocks).union(split_windows(pieces.where("hot"), length)), "repeats")
    release(docs.sparkSession, scratch)
    return out


def removed(text: Column, ranges: Column, length: int = LENGTH, whole_characters: bool = False) -> Column:
    """n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept; `ranges` are runs of window starts, or null.

    With `whole_characters`, a character stays unless all its bytes are to go, so the rest is text again.
    """
    kind = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>"

    @F.arrow_udf(kind)
    def remove(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, lists in columns:
            texts, rows = Texts(column), []
            for i, found in enumerate(lists.to_pylist()):
                data = texts.data[texts.offsets[i]:texts.offsets[i + 1]]
                edge = np.zeros(len(data) + 1, np.int64)
                for r in found or ():
                    edge[r["first"]] += 1
                    edge[r["last"] + length] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                if whole_characters and gone.any():
                    heads = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.concatenate((heads, [len(data)]))))
                left = data[~gone].tobytes()
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
            yield struct_of({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(zip(names, types))})

    return remove(text, ranges)


def numbered(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    """df with a non-null number `_doc` that has the order of the ids, and is the id itself where ids are there once each.

    Elsewhere rows are numbered by id (nulls last) and text hash; equal rows have one number and so count as one document.
    """
    own = F.col(f"`{id_column}`")
    doubtful = df.groupBy(own.alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null").limit(1)
    if isinstance(df.schema[id_column].dataType, IntegralType) and doubtful.isEmpty():
        return df.withColumn("_doc", own.cast("bigint"))
    rows = df.withColumn("_sha", F.sha2(text_or_empty(text_column), 256)).withColumn("_key", own)
    numbers = ranked(rows.select("_key", "_sha").distinct(), [F.asc_nulls_last("_key"), F.asc("_sha")], "_doc")
    numbers = numbers.select(F.col("_key").alias("_k"), F.col("_sha").alias("_s"), "_doc")
    return rows.join(numbers, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s"))).drop("_k", "_s", "_key", "_sha")


def with_removals(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
                  whole_characters: bool = False, **limits) -> DataFrame:
    """df with a column `removal`: n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte goes if it is in a string of `length` bytes that also starts earlier: in a row with a smaller id, or earlier in
    the same text. Strings are judged on the input. Null texts are empty; texts shorter than `length` stay whole. Equal
    rows count as one document, rows with one id and different texts as several, and rows without id come last. A column
    named removal is replaced; an empty table gives an empty one.
    """
    tuned(df.sparkSession)
    columns = [c for c in df.columns if c != "removal"]
    rest = [c for c in columns if c not in (id_column, text_column)]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    rows = numbered(df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"), packed.alias("_rest")), "_id", "_text")
    docs = rows.select(F.col("_doc").alias("doc"), text_or_empty("_text").alias("text"))
    found = repeats(docs, length, **limits)
    lists = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first", "last")).alias("_ranges"))
    out = rows.join(lists, "_doc", "left").withColumn("removal", removed(text_or_empty("_text"), F.col("_ranges"), length, whole_characters))
    own = {id_column: "_id", text_column: "_text"}
    return out.select(*[F.col(own.get(c, f"_rest.`{c}`")).alias(c) for c in columns], "removal")


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, **limits) -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans, kept_sha256; see `with_removals` for odd rows."""
    rows = with_removals(df.select(id_column, text_column), id_column, text_column, length, **limits)
    return rows.select(id_column, "removal.n_bytes", "removal.n_removed", "removal.n_spans", "removal.kept_sha256")
