"""Unfiltered dashboard queries over Gold views. Ties in a top list are ordered by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.display import currency_text
from ..operators.aggregates import sum_or_zero, top_k, unpivot_metrics
from ..operators.joins import one_row_join
from .gold import CATEGORY, MONEY

TOP = 8


def _sum(name: str):
    return F.sum(name).cast(MONEY).alias(name)


def selectable_categories(categories: DataFrame) -> DataFrame:
    return (
        categories.filter(F.col("isActive") & ~F.col("spendingCategoryName").isin("Unknown", "Uncategorized"))
        .select("spendingCategoryKey", "spendingCategoryName", "parentSpendingCategoryName")
        .orderBy("parentSpendingCategoryName", "spendingCategoryName")
    )


def summary_metrics(spending: DataFrame, cashflow: DataFrame, uncategorized: DataFrame) -> DataFrame:
    """One row: spending, income, net cashflow and the number of uncategorised transactions."""
    parts = [
        spending.agg(sum_or_zero(F.col("netSpendingAmount")).cast(MONEY).alias("totalSpendingAmount")),
        cashflow.agg(
            sum_or_zero(F.col("incomeAmount")).cast(MONEY).alias("totalIncomeAmount"),
            sum_or_zero(F.col("netCashflowAmount")).cast(MONEY).alias("netCashflowAmount"),
        ),
        uncategorized.agg(sum_or_zero(F.col("transactionCount")).cast("long").alias("uncategorizedTransactionCount")),
    ]
    return reduce(one_row_join, parts)


def summary_cards(metrics: DataFrame) -> DataFrame:
    """The four metrics as (label, value) with formatted values, in card order."""
    return unpivot_metrics(metrics, [
        (1, "Spending", currency_text(F.col("totalSpendingAmount"))),
        (2, "Income", currency_text(F.col("totalIncomeAmount"))),
        (3, "Net Cashflow", currency_text(F.col("netCashflowAmount"))),
        (4, "Uncategorized", F.col("uncategorizedTransactionCount").cast("string")),
    ], ["cardOrder", "label", "value"])


def cashflow_months(cashflow: DataFrame) -> DataFrame:
    return cashflow.groupBy("yearMonth").agg(
        F.min("monthStartDate").alias("monthStartDate"), _sum("inflowAmount"), _sum("outflowAmount"),
        _sum("netCashflowAmount"),
    ).orderBy("monthStartDate")


def category_top8(spending: DataFrame) -> DataFrame:
    rows = spending.groupBy(*CATEGORY).agg(
        F.sum("purchaseTransactionCount").alias("purchaseTransactionCount"), _sum("netSpendingAmount")
    )
    return top_k(rows, [F.desc("netSpendingAmount"), F.asc("spendingCategoryName")], TOP)


def merchant_top8(merchants: DataFrame) -> DataFrame:
    """The average is taken over the view's groups, each counting once, groups without purchases as 0."""
    rows = merchants.groupBy("merchantDisplayName").agg(
        F.sum("purchaseTransactionCount").alias("purchaseTransactionCount"), _sum("totalSpendingAmount"),
        F.avg("averagePurchaseAmount").alias("averagePurchaseAmount"),
    )
    return top_k(rows, [F.desc("totalSpendingAmount"), F.asc("merchantDisplayName")], TOP)


def uncategorized_top8(uncategorized: DataFrame) -> DataFrame:
    rows = uncategorized.groupBy("yearMonth", "accountType", "transactionEventType").agg(
        F.sum("transactionCount").alias("transactionCount"), _sum("netTransactionAmount")
    )
    order = [F.desc("yearMonth"), F.desc("transactionCount"), F.asc("accountType"), F.asc("transactionEventType")]
    return top_k(rows, order, TOP)


def ledger_ordered(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("transactionDate"), F.desc("transactionKey"))
