"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the k smallest distinct hashes of a text's shingles, and whether these are all. Sketches of parts merge to the
sketch of the whole by taking the k smallest of their union. From two sketches come resemblance and containment, from one
the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallymill.llm.common import SLICE, Texts, mixed, prefix_hash, span_hash, text_or_empty, tuned, word_spans

SHINGLE_WORDS, SIZE = 5, 128
_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and where each text's begin. ASCII case does not count; a text of fewer
    words is one shingle, a text without words has none."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, bounds = word_spans(lower, offsets)
    own = span_hash(prefix_hash(lower), starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    last = bounds[1:][owner]
    rolled, at = np.zeros(len(own), np.uint64), np.arange(len(own))
    for j in range(words):
        inside = at + j < last
        rolled = np.where(inside, rolled * _STEP + own[np.minimum(at + j, len(own) - 1)], rolled) if len(own) else rolled
    whole = (at + words <= last) | (at == bounds[:-1][owner])
    kept = np.concatenate(([0], np.cumsum(whole)))
    return mixed(rolled[whole]), kept[bounds]


def smallest(hashes: np.ndarray, size: int) -> np.ndarray:
    if len(hashes) > 8 * size:
        # Repeats may fill the first cut; then all are looked at.
        first = np.unique(np.partition(hashes, 2 * size)[:2 * size])
        if len(first) >= size:
            return first[:size]
    return np.unique(hashes)[:size]


class Sketch:
    """Sorted distinct hashes; `whole` if no shingle of the text is missing."""

    def __init__(self, hashes: np.ndarray, size: int = SIZE, whole: bool | None = None):
        self.size, self.hashes = size, hashes[:size]
        self.whole = len(hashes) < size if whole is None else whole and len(hashes) <= size

    @classmethod
    def of(cls, text: bytes, size: int = SIZE, words: int = SHINGLE_WORDS, part: int = SLICE) -> Sketch:
        """The sketch of one text; longer texts than `part` bytes are sketched in parts that share words - 1 words."""
        data = np.frombuffer(text, np.uint8)
        if len(data) <= part:
            return cls(smallest(shingle_hashes(data, np.array([0, len(data)]), words)[0], size), size)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        if len(starts) <= words:
            return cls(smallest(shingle_hashes(data, np.array([0, len(data)]), words)[0], size), size)
        merged, first = np.zeros(0, np.uint64), 0
        while first + words <= len(starts):
            last = max(int(np.searchsorted(starts, starts[first] + part)), first + words)
            last = min(last, len(starts))
            piece = data[starts[first]:ends[last - 1]]
            merged = smallest(np.concatenate((merged, smallest(shingle_hashes(piece, np.array([0, len(piece)]), words)[0], size))), size)
            first = last - words + 1
        return cls(merged, size)

    def merge(self, other: Sketch) -> Sketch:
        size = min(self.size, other.size)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(both, size, self.whole and other.whole)

    def _joint(self, other: Sketch) -> tuple[int, int, int, int]:
        """Of the smallest hashes of the union: how many, how many in both, in self, in other."""
        both = np.union1d(self.hashes, other.hashes)
        if not (self.whole and other.whole):
            both = both[:min(self.size, other.size)]
            ends = [s.hashes[-1] for s in (self, other) if not s.whole and len(s.hashes)]
            both = both[both <= min(ends)] if ends else both
        a, b = np.isin(both, self.hashes), np.isin(both, other.hashes)
        return len(both), int((a & b).sum()), int(a.sum()), int(b.sum())

    def resemblance(self, other: Sketch) -> float:
        """Share of the distinct shingles of either that both have; 1 for two empty texts."""
        n, both, _, _ = self._joint(other)
        return both / n if n else 1.0

    def containment(self, other: Sketch) -> float:
        """Share of self's distinct shingles that other has; 1 if self has none."""
        _, both, own, _ = self._joint(other)
        return both / own if own else float(not len(self.hashes))

    def distinct(self) -> float:
        """Number of distinct shingles: exact if the sketch is whole, else from how dense its hashes lie."""
        return float(len(self.hashes)) if self.whole else (self.size - 1) / ((int(self.hashes[-1]) + 1) / 2.0**64)

    def __str__(self) -> str:
        head = bytes([1, self.size >> 8, self.size & 255, self.whole])
        return base64.b64encode(head + self.hashes.astype("<u8").tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Sketch:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[4:], "<u8"), raw[1] << 8 | raw[2], bool(raw[3]))


def sketch(text: Column, size: int = SIZE, words: int = SHINGLE_WORDS) -> Column:
    """The sketch of each text as a string; equal texts have equal ones."""

    @F.arrow_udf("string")
    def sketches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = Texts(column)
            yield pa.array([str(Sketch.of(texts[i], size, words)) for i in range(len(texts))], pa.string())

    return sketches(text)


def compared(a: Column, b: Column) -> Column:
    """resemblance, containment (of a in b) and the distinct shingles of a, for pairs of sketches; null if one is null."""

    @F.arrow_udf("struct<resemblance:double,containment:double,distinct:double>")
    def compare(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([(k, pa.float64()) for k in ("resemblance", "containment", "distinct")])
        for left, right in columns:
            rows = []
            for x, y in zip(left.to_pylist(), right.to_pylist()):
                if x is None or y is None:
                    rows.append(None)
                    continue
                x, y = Sketch.read(x), Sketch.read(y)
                rows.append({"resemblance": x.resemblance(y), "containment": x.containment(y), "distinct": x.distinct()})
            yield pa.array(rows, kind)

    return compare(a, b)


def merged(df: DataFrame, key: str, sketch_column: str) -> DataFrame:
    """(key, sketch) with the sketches of each key's parts merged, in two steps, so a hot key is no hot task."""

    def union(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [Sketch.read(s) for s in rows[sketch_column] if s is not None]
        whole = parts[0] if parts else Sketch(np.zeros(0, np.uint64))
        for part in parts[1:]:
            whole = whole.merge(part)
        return pd.DataFrame({key: rows[key].iloc[:1], sketch_column: [str(whole)]})

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield from (union(g) for _, g in rows.groupby(key, dropna=False))

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{sketch_column}` string"
    rows = df.select(key, sketch_column)
    for salts in (4096, 64):
        rows = rows.mapInPandas(per_batch, schema)
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(sketch_column), F.lit(salts))).groupBy(key, "_salt").applyInPandas(
            lambda g: union(g), schema)
    return rows.groupBy(key).applyInPandas(union, schema)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _fingerprint_rows(size: int):
    """Rows come part by part in the order of the documents, own rows before the copied head of the part that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, None

        def row(current, text, mark, following):
            new = _edited(text, following[1])
            edited = Sketch.of(new.encode(), size)
            return {
                "id": current, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
                "fingerprint": str(mark), "edited_fingerprint": str(edited), "near_edited": mark.resemblance(edited),
                "near_next": mark.resemblance(following[2]),
            }

        names = {"id": None, "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
        for batch in batches:
            out, kind = [], batch.schema.field("_id").type
            for current, text, place, own in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "_part", "_own"))):
                mark = Sketch.of(text.encode(), size)
                if held is not None and place == part:
                    out.append(row(*held, (current, text, mark)))
                held, part = ((current, text, mark) if own else None), place
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t or kind) for k, t in names.items()], names=list(names))

    return run


def _cuts(rows: DataFrame, parts: int) -> list:
    """Up to parts - 1 ids that split the rows about evenly: quantiles of numbers, of others those of a sample of the ids,
    64 for each part at most."""
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    if isinstance(rows.schema["_id"].dataType, NumericType):
        return sorted(set(rows.agg(F.percentile_approx("_id", shares, 10_000)).first()[0] or []))
    bucket = F.pmod(F.xxhash64("_id"), F.lit(64 * parts))
    sample = rows.where(F.col("_id").isNotNull()).groupBy(bucket.alias("b")).agg(F.min("_id").alias("i")).orderBy("i").collect()
    return [sample[k]["i"] for k in sorted({len(sample) * j // parts for j in range(1, parts)})] if sample else []


def fingerprint_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE,
                          parts: int | None = None) -> DataFrame:
    """One row per row of df: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one after this in descending id, the first after the last. Rows with equal ids come in the
    order of their texts, null ids last. Null texts are empty; a single row is next to itself; further columns are
    ignored; an empty table gives an empty one. Ids may be of any type that Spark orders.
    """
    spark = tuned(df.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), text_or_empty(text_column).alias("_text"))
    cut = _cuts(rows, parts)
    # Part 0 has the largest ids, the last but one the smallest, the last those without id.
    larger = F.size(F.filter(F.array(*map(F.lit, cut)), lambda c: c > F.col("_id"))) if cut else F.lit(0)
    placed = rows.withColumn("_part", F.when(F.col("_id").isNull(), len(cut) + 1).otherwise(larger))
    # A part is led by its largest id; the part before it gets a copy of the rows with that id.
    leads = placed.groupBy("_part").agg(F.max("_id").alias("lead")).orderBy("_part").collect()
    before = {leads[k]["lead"]: leads[k - 1]["_part"] for k in range(len(leads))}
    copy_to = F.lit(None).cast("int")
    if named := [(k, v) for k, v in before.items() if k is not None]:
        copy_to = F.create_map(*[F.lit(x) for pair in named for x in pair])[F.col("_id")]
    if None in before:
        copy_to = F.when(F.col("_id").isNull(), before[None]).otherwise(copy_to)
    own = F.struct(F.col("_part").cast("int").alias("_part"), F.lit(True).alias("_own"))
    copied = F.struct(copy_to.cast("int").alias("_part"), F.lit(False).alias("_own"))
    spread = placed.select("_id", "_text", F.explode(F.when(copy_to.isNull(), F.array(own)).otherwise(F.array(own, copied))).alias("_to"))
    dealt = spread.select("_id", "_text", "_to.*").repartitionById(len(cut) + 2, F.col("_part")).sortWithinPartitions(
        "_part", F.desc("_own"), F.desc_nulls_last("_id"), "_text")
    kind = df.schema[id_column].dataType.simpleString()
    out = dealt.mapInArrow(_fingerprint_rows(size), (
        f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
    return out.withColumnRenamed("id", id_column)
