"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint is cut into so few segments that, of two linked ones, some segment differs by one bit at most: two segments
for two bits. Each segment is indexed with every single bit left out, so such segments share a variant. An equality join on
variants gives candidates, and the distance of the whole fingerprints decides. Equal fingerprints are one node.

Where very many different fingerprints share a variant, its members are not paired but indexed again with the bits of the
other segment left out as well. Members of such a group differ in the bits left out only, so all of them are linked, there
are four at most, and linking each to the least loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import Texts, kept, release, text_or_empty, tuned
from tallymill.llm.components import connected

SHINGLE_WORDS = 3
#: Most fingerprints that share a variant and are still compared pair by pair.
PAIRED = 256
HALF = 32


def bits_set(hashes: np.ndarray, ones: np.ndarray) -> None:
    """Add to `ones` how many of the 64-bit hashes have each bit set (bit 0 first)."""
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)


def packed(ones: np.ndarray, n: int) -> int:
    """The bits set in over half of n hashes, as a signed 64-bit number."""
    value = int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def fingerprint_of(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(shingle_words, len(words)) - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), 1 << 16):
        part = [digest(line[a:b], 42) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])]
        bits_set(np.array(part, np.uint64), ones)
    return packed(ones, len(ends))


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """64-bit SimHash of word shingles (XXH64, seed 42) as a signed number; 0 for texts without words."""

    @F.arrow_udf("bigint")
    def hashes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = Texts(column)
            yield pa.array([fingerprint_of(texts[i], shingle_words) for i in range(len(texts))], pa.int64())

    return hashes(text)


def without_each_bit(part: Column, bits: int) -> list[Column]:
    return [part.bitwiseAND(F.lit(~(1 << b) & ((1 << bits) - 1))) for b in range(bits)]


def halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, HALF), fp.bitwiseAND(F.lit((1 << HALF) - 1))


def variants(fp: Column) -> Column:
    """Keys of both segments with each bit left out: segment and bit in the upper bits, what is left in the lower."""
    return F.array(*[
        masked.bitwiseOR(F.lit((which * HALF + b) << HALF))
        for which, half in enumerate(halves(fp)) for b, masked in enumerate(without_each_bit(half, HALF))
    ])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, paired: int = PAIRED, scratch: list[str] | None = None) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column fp, distinct) at two or fewer differing bits."""
    index = nodes.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    # Counted before the shuffle and joined back: no task meets all members of a variant. Sizes are estimated without the
    # 64 variants of a fingerprint, so a broadcast is ruled out here.
    often = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = kept(index.join(often.hint("merge"), "key"), "variants", scratch)
    few, many = shared.where(F.col("n") <= paired).select("key", "fp"), shared.where(F.col("n") > paired).select("key", "fp")
    left, right = few.withColumnRenamed("fp", "u"), few.withColumnRenamed("fp", "v")
    pairs = left.join(right, "key").where((F.col("u") < F.col("v")) & (distance(F.col("u"), F.col("v")) <= 2)).select("u", "v")
    bit = F.shiftrightunsigned("key", HALF).cast("int")
    upper, lower = halves(F.col("fp"))
    other = F.when(bit < HALF, lower).otherwise(upper)
    own = F.when(bit < HALF, upper).otherwise(lower)
    # One bit of this segment and one of the other; two of the other where this segment is equal (asked for once, at bit 0).
    one = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(-1).cast("bigint").alias("own"), m.alias("rest")) for b, m in enumerate(without_each_bit(other, HALF))])
    twos = [(a, b) for a in range(HALF) for b in range(a + 1, HALF)]
    masks = F.array(*[F.struct(F.lit(HALF + k).alias("b"), F.lit(~(1 << a) & ~(1 << b) & ((1 << HALF) - 1)).cast("bigint").alias("m")) for k, (a, b) in enumerate(twos)])
    two = F.transform(masks, lambda x: F.struct(x["b"].alias("b"), own.alias("own"), other.bitwiseAND(x["m"]).alias("rest")))
    again = many.select("key", "fp", F.explode(F.when(bit % HALF == 0, F.concat(one, two)).otherwise(one)).alias("x"))
    stars = again.groupBy("key", "x").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("vs")).where(F.size("vs") > 1)
    return pairs.union(stars.select("u", F.explode("vs").alias("v")).where("u != v")).distinct()


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = SHINGLE_WORDS,
                    paired: int = PAIRED) -> DataFrame:
    """One row per row of df: id, fingerprint (16 hexadecimal digits), component_id (least id that links lead to).

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Repeated rows keep
    their rows; a null id is never a component's id unless it has no other. Further columns are ignored; an empty table
    gives an empty one.
    """
    tuned(df.sparkSession)
    rows = kept(df.select(F.col(f"`{id_column}`").alias("_id"), fingerprint(text_or_empty(text_column), shingle_words).alias("fp")), "fingerprints")
    nodes = kept(rows.groupBy("fp").agg(F.min("_id").alias("least")), "nodes")
    scratch: list[str] = []
    found = kept(connected(links(nodes, paired, scratch), scratch), "components")
    release(df.sparkSession, scratch)
    joined = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "c").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("_id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """df with one row of each component that `near_duplicates` finds: the one with the smallest id.

    Rows are told apart by a number of their own, so rows that only share an id are judged by their texts. Rows without
    an id come after all others. Of equal ids in one component the first row in df's order stays. Columns keep their names
    and order; an empty table gives an empty one.
    """
    rows = kept(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
    own = F.col(f"row.`{id_column}`")
    place = F.struct(own.isNull().alias("none"), own.alias("id"), "number").alias("place")
    found = near_duplicates(rows.select(place, F.col(f"row.`{text_column}`").alias("text")), "place", "text", shingle_words)
    stay = found.where("place.number = component_id.number").select("place.number")
    return rows.join(stay, "number", "left_semi").select("row.*")
