"""Helpers shared by the operators: inputs, kept results, and byte-wise text work in numpy.

Texts reach Python as Arrow arrays. A null text counts as empty everywhere in this package unless an operator's docstring
says otherwise. Work on a batch is done in slices of about a megabyte, so arrays stay small whatever the batch holds; one
text longer than that is a slice of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on.
SLICE = 1 << 20
#: Words of the contracts that split at punctuation: ASCII letters (lower-cased), digits and every non-ASCII character.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: their memory is bounded by bytes, not by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one in local runs."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallymill-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read again: computed once, and safe when executors are lost.

    The folder's path is added to `scratch`, for `release` once what follows from these rows is written.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scratch: list[str]) -> None:
    """Delete folders that `kept` wrote."""
    for path in scratch:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    scratch.clear()


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a number that grows in the given order: from a range sort, so no task sees more than its share."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(rows.withColumn(name, F.monotonically_increasing_id()), "ranked")


def text_or_empty(name: str):
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


class Texts:
    """The bytes of an Arrow string array, one after another, and where each text begins."""

    def __init__(self, array: pa.Array):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        array = pc.fill_null(array, "").cast(pa.large_string())
        _, offsets, data = array.buffers()
        self.offsets = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def slices(self, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, bytes, offsets from 0) of runs of texts of up to `limit` bytes."""
        first, n = 0, len(self)
        while first < n:
            end = int(np.searchsorted(self.offsets, self.offsets[first] + limit, "right")) - 1
            end = min(n, max(first + 1, end))
            at = self.offsets[first:end + 1]
            yield first, end, self.data[at[0]:at[-1]], at - at[0]
            first = end


def powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    found = _POWERS.get(name)
    if found is None or len(found) < n:
        with np.errstate(over="ignore"):
            found = np.full(max(n, SLICE + 2), np.uint64(base), np.uint64)
            found[0] = 1
            found = np.cumprod(found)
        if n <= 2 * SLICE:
            _POWERS[name] = found
    return found[:n]


_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (the finaliser of splitmix64)."""
    x = x + ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hash` takes the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers("base", _BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes have equal hashes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * powers("unbase", _UNBASE, len(sums))[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the first word of each text (one more at the end)."""
    inside = is_word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def struct_of(fields: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
