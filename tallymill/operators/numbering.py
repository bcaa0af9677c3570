"""Gap-free numbers for rows in a given order, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import KEY_STEP
from ..sources.store import materialise
from .joins import lookup


def number_rows(
    df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "rowNumber", keep: list[str] | None = None
) -> DataFrame:
    """Number rows 1, 2, ... by `order`, per `within` group or over the whole frame.

    A range sort cuts even one huge group into many partitions. Each row keeps its slot in the written, sorted copy; a
    group's run in a partition starts where its runs in earlier partitions end. The table of runs has at most
    partitions + groups rows. `order` must be total. Columns that only the order needs are not written: `keep` names the
    others, by default all.
    """
    within, keep = within or [], keep or df.columns
    slotted = (
        df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
        .select(*dict.fromkeys([*within, *keep]), F.monotonically_increasing_id().alias("_slot"))
    )
    slotted = materialise(slotted, "numbered").withColumn("_part", F.shiftright("_slot", 33))
    runs = slotted.groupBy(*within, "_part").agg(F.min("_slot").alias("_first"), F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Written out, so that Spark sees how small it is and leaves the rows where they are.
    runs = materialise(runs.select(
        *[F.col(c).alias(f"_g_{c}") for c in within], F.col("_part").alias("_run"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    ), "runs")
    same = slotted["_part"] == runs["_run"]
    for c in within:
        same = same & slotted[c].eqNullSafe(runs[f"_g_{c}"])
    number = (F.col("_slot") - F.col("_first") + F.col("_before") + 1).cast("long")
    return slotted.join(runs, same).select(*[slotted[c] for c in keep], number.alias(name))


def last_key(table: DataFrame, key: str) -> int:
    return table.agg(F.max(key)).first()[0] or 0


def assign_keys(new: DataFrame, key: str, order: list[str], last: int) -> DataFrame:
    """Surrogate keys in natural order, continuing a sequence that starts at 100 and steps by 100."""
    start = max(last, 0)
    numbered = number_rows(new, order, name=key)
    return numbered.withColumn(key, F.col(key) * F.lit(KEY_STEP) + F.lit(start))


def file_offsets(rows: DataFrame, by: str) -> DataFrame:
    """(by, _before): per file, the row numbers taken by the files before it. One row per file.

    Files are range-sorted into a written copy; sums run within a partition, and over the partitions' sums.
    """
    sizes = rows.groupBy(by).agg(F.max("sourceRowNumber").alias("_size"))
    placed = sizes.repartitionByRange(by).sortWithinPartitions(by).withColumn("_slot", F.monotonically_increasing_id())
    placed = materialise(placed, "file-sizes").withColumn("_part", F.shiftright("_slot", 33))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(F.col("_part").alias("_run")).agg(F.sum("_size").alias("_n"))
    parts = parts.select("_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return placed.join(parts, F.col("_part") == F.col("_run")).select(by, (F.col("_first") + F.col("_inside")).alias("_before"))


def keys_by_file(rows: DataFrame, key: str, by: str, offsets: DataFrame, last: int) -> DataFrame:
    """Surrogate keys in (file, row number) order, from the numbers that rows have in their file already: no sort
    and no shuffle of rows."""
    placed = lookup(rows, offsets, [by], ["sourceRowNumber"], how="inner")
    place = F.col("_before") + F.col("sourceRowNumber")
    return placed.withColumn(key, (place * KEY_STEP + max(last, 0)).cast("long")).drop("_before")


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key by `order`, as one aggregate: each task keeps a single row per key before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.struct(o.alias("v")).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(keys).agg(F.min_by(F.struct(*rest), ranked).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(df.columns)
