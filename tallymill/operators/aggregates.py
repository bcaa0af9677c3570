"""Aggregate columns and small aggregate frames used across Gold, dashboard and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sum_if(amount: Column, condition: Column) -> Column:
    """Sum over the rows that meet the condition, 0 when there are none."""
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0).cast("decimal(28,2)"))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_or_zero(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations held by more than one row."""
    return df.groupBy(keys).agg(F.count("*").alias("rowCount")).filter(F.col("rowCount") > 1)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def last_n(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n largest values of `by`, in ascending order."""
    return df.orderBy(F.desc(by)).limit(n).orderBy(by)


def with_previous(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Value of the preceding row per key. Meant for period-level frames, which hold one row per key and period."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def unpivot_metrics(totals: DataFrame, metrics: list[tuple], names: list[str]) -> DataFrame:
    """One row per metric from a one-row frame of totals, so that a report needs a single pass over the data."""
    rows = F.array(*[
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, metric)])
        for metric in metrics
    ])
    return totals.select(F.inline(rows))
