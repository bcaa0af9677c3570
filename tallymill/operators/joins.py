"""Lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one key that a single task may join; more are spread over several tasks.
HOT_ROWS = 2_000_000


def spread_join(
    facts: DataFrame, dim: DataFrame, on: list[str], spread: list[str], how: str = "left", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Equi-join in which each hot key is split over as many tasks as its row count asks for.

    `spread` names fact columns that differ within a key. The table of hot keys has at most rows / hot_rows
    entries, so it may be broadcast; only the dimension rows of hot keys are repeated.
    """
    hot = (
        facts.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_parts"))
    )
    hot = F.broadcast(hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    # NULL keys, which meet no dimension row, are spread like any hot key.
    renamed = hot.select(*[F.col(c).alias(f"_hot_{c}") for c in on], "_parts")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on])
    facts_salted = (
        facts.join(F.broadcast(renamed), same, "left").drop(*[f"_hot_{c}" for c in on])
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    )
    dim_salted = (
        dim.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    )
    return facts_salted.join(dim_salted, [*on, "_salt"], how).drop("_salt")


def lookup(
    facts: DataFrame, dim: DataFrame, on: list[str], spread: list[str], defaults: dict[str, object] | None = None,
    how: str = "left",
) -> DataFrame:
    """Add a dimension's columns; `defaults` fills the ones of rows without a partner.

    Catalyst chooses the join by the sizes it measures, and splits the partitions of hot keys (see `session.tune`).
    Where adaptive execution is off, the keys are spread over `spread`.
    """
    adaptive = facts.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    joined = facts.join(dim, on, how) if adaptive else spread_join(facts, dim, on, spread, how)
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def fits_everywhere(*dims: DataFrame) -> bool:
    """Whether Catalyst would send each of these written tables whole to all tasks, so that a join leaves the facts in place."""
    spark = dims[0].sparkSession
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    sizes = [int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for dim in dims]
    return spark.conf.get("spark.sql.adaptive.enabled") == "true" and max(sizes) <= limit


def orphan_counts(facts: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per fact key column: rows whose key is missing from the referenced table. (keyColumn, orphanRowCount)

    One scan of the facts: keys are counted first, so a frequent key is one row by the time of the anti join.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("keyColumn"), F.col(name).cast("long").alias("keyValue")) for name in references
    ])).alias("pair")
    used = facts.select(pairs).select("pair.*").groupBy("keyColumn", "keyValue").agg(F.count("*").alias("rowCount"))
    return unknown_keys(used, references)


def unknown_keys(used: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(keyColumn, orphanRowCount) of counted keys (keyColumn, keyValue, rowCount)."""
    known = None
    for name, (dim, dim_key) in references.items():
        keys = dim.select(F.lit(name).alias("keyColumn"), F.col(dim_key).cast("long").alias("keyValue"))
        known = keys if known is None else known.unionByName(keys)
    found = used.filter(F.col("keyColumn").isin(*references)).join(known.withColumn("_known", F.lit(1)), ["keyColumn", "keyValue"], "left")
    return found.groupBy("keyColumn").agg(
        F.sum(F.when(F.col("_known").isNull(), F.col("rowCount")).otherwise(0)).alias("orphanRowCount")
    )


def one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row aggregates side by side."""
    return one_row_beside(left, right)


def one_row_beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Rows with the columns of a one-row frame."""
    key = F.lit(1).alias("_row")
    return rows.select("*", key).join(F.broadcast(one.select("*", key)), "_row").drop("_row")


def names_like(names: DataFrame, name_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """Pairs where the name contains the pattern, ignoring case. Names and patterns are schema-sized lists."""
    return names.join(
        patterns, F.lower(F.col(name_col)).contains(F.lower(F.col(pattern_col)))
    )


def remove_processed(queue: DataFrame, done: DataFrame, grain: list[str]) -> DataFrame:
    """Queue rows whose grain was not processed yet."""
    return queue.join(done.select(grain), grain, "left_anti")


def update_where_key(facts: DataFrame, keys: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Set columns on the rows whose (unique) key is listed; the other rows pass through."""
    flagged = facts.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    return flagged.withColumns(
        {name: F.when(hit, value).otherwise(F.col(name)) for name, value in changes.items()}
    ).select(facts.columns)
