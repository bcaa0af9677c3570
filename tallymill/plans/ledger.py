"""Analytics over a filtered slice of the ledger."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.classify import OPEN_CATEGORIES
from ..functions.display import account_label, currency_text, month_label, percent_text, plain_number, whole_percent
from ..operators.aggregates import count_if, last_n, sum_if, top_k, unpivot_metrics
from .gold import LEDGER_COLUMNS, MONEY, transaction_ledger

TOP, RECENT = 8, 6


def _event(name: str) -> Column:
    return F.col("transactionEventType") == name


def _absolute(event: str) -> Column:
    return sum_if(F.abs("transactionAmount"), _event(event)).cast(MONEY)


def _net() -> Column:
    return (_absolute("purchase") - _absolute("refund")).cast(MONEY)


def _income() -> Column:
    return sum_if(F.col("transactionAmount"), _event("income")).cast(MONEY)


def _open() -> Column:
    return F.col("spendingCategoryName").isin(OPEN_CATEGORIES)


def date_window(day: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """Inside the window, ends included; a reversed window is turned round, one with an end missing is open.
    Rows without a date never match."""
    if start is None or end is None:
        return day.isNotNull()
    return day.between(min(start, end), max(start, end))


def search_condition(text: str) -> Column:
    """The text occurs, ignoring case, in one of the seven fields a reader sees."""
    fields = [
        F.date_format("transactionDate", "yyyy-MM-dd"), account_label(F.col("accountType")),
        F.col("merchantDisplayName"), F.col("spendingCategoryName"), F.col("transactionType"),
        F.col("transactionEventType"), plain_number(F.col("transactionAmount")),
    ]
    return reduce(or_, [F.coalesce(F.lower(f).contains(text), F.lit(False)) for f in fields])


def filter_ledger(
    ledger: DataFrame, account: str = "all", category: str = "all", start: dt.date | None = None,
    end: dt.date | None = None, text: str = "",
) -> DataFrame:
    """Only the conditions asked for enter the plan, so Catalyst can push them down."""
    rows = ledger.filter(date_window(F.col("transactionDate"), start, end))
    if account != "all":
        rows = rows.filter(F.col("accountType") == account)
    if category != "all":
        rows = rows.filter(F.col("spendingCategoryName") == category)
    wanted = text.strip().lower()
    return rows.filter(search_condition(wanted)) if wanted else rows


# What each analysis reads of the ledger, besides the columns a filter needs.
SLICE = ["transactionDate", "yearMonth", "accountType", "spendingCategoryName", "transactionEventType", "transactionAmount"]


def open_slice(
    tables: dict[str, DataFrame], account: str = "all", category: str = "all", start: dt.date | None = None,
    end: dt.date | None = None, text: str = "", columns: list[str] | None = None,
) -> DataFrame:
    """A filtered ledger straight from Silver: the date window reaches the fact scan, and dimensions that neither
    the columns (default SLICE) nor a search need are not joined."""
    wanted = list(dict.fromkeys([*(columns or SLICE), *SLICE]))
    if text.strip():
        wanted = LEDGER_COLUMNS
    rows = transaction_ledger(tables, wanted, start, end)
    return filter_ledger(rows, account, category, start, end, text)


def date_bounds(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.min("transactionDate").alias("earliestDate"), F.max("transactionDate").alias("latestDate"))


def category_options(ledger: DataFrame) -> DataFrame:
    named = F.col("spendingCategoryName").isNotNull() & (F.col("spendingCategoryName") != "")
    return ledger.filter(named).select("spendingCategoryName").distinct().orderBy("spendingCategoryName")


def slice_totals(ledger: DataFrame) -> DataFrame:
    """One row with every figure the cards need, in one pass."""
    return ledger.agg(
        F.count("*").alias("rowCount"), _net().alias("spendingAmount"), _income().alias("incomeAmount"),
        (_income() - (_net() + _absolute("fee"))).cast(MONEY).alias("netCashflowAmount"),
        count_if(_open()).alias("uncategorizedCount"), count_if(_event("purchase")).alias("purchaseCount"),
        _absolute("purchase").alias("purchaseAmount"), F.count_distinct("yearMonth").alias("monthCount"),
    )


def metric_cards(ledger: DataFrame) -> DataFrame:
    return slice_totals(ledger).select(
        "spendingAmount", "incomeAmount", "netCashflowAmount", "uncategorizedCount"
    )


def metric_card_texts(ledger: DataFrame) -> DataFrame:
    return unpivot_metrics(metric_cards(ledger), [
        (1, "Spending", currency_text(F.col("spendingAmount"))),
        (2, "Income", currency_text(F.col("incomeAmount"))),
        (3, "Net Cashflow", currency_text(F.col("netCashflowAmount"))),
        (4, "Uncategorized", F.col("uncategorizedCount").cast("string")),
    ], ["cardOrder", "label", "value"])


def largest_purchase(ledger: DataFrame) -> Column:
    """Aggregate column: (merchant, amount) of the purchase with the largest absolute amount.

    Of equals the first in ledger order counts: latest date, then largest key.
    """
    rank = F.struct(F.abs("transactionAmount"), "transactionDate", "transactionKey")
    chosen = F.struct(F.col("merchantDisplayName").alias("merchant"), F.abs("transactionAmount").alias("amount"))
    return F.max_by(F.when(_event("purchase"), chosen), F.when(_event("purchase"), rank))


def insights(ledger: DataFrame) -> DataFrame:
    """One row: average purchase, monthly pace, largest purchase and its merchant, categorised share in percent."""
    totals = ledger.agg(
        F.count("*").alias("rowCount"), count_if(_open()).alias("openCount"),
        count_if(_event("purchase")).alias("purchaseCount"), _absolute("purchase").alias("purchaseAmount"),
        F.count_distinct("yearMonth").alias("monthCount"), largest_purchase(ledger).alias("largest"),
    )
    spent = F.col("purchaseAmount").cast("double")
    rows, months = F.col("rowCount").cast("double"), F.greatest(F.col("monthCount"), F.lit(1))
    share = whole_percent((rows - F.col("openCount")) / F.nullif(rows, F.lit(0.0)))
    return totals.select(
        F.when(F.col("purchaseCount") > 0, spent / F.col("purchaseCount")).otherwise(0.0).alias("averagePurchaseAmount"),
        "purchaseCount",
        (spent / months).alias("monthlyPaceAmount"),
        F.coalesce("largest.amount", F.lit(0).cast("decimal(18,2)")).alias("largestPurchaseAmount"),
        F.coalesce("largest.merchant", F.lit("No purchases")).alias("largestPurchaseMerchant"),
        F.coalesce(share, F.lit(0)).alias("categorizedPercent"),
    )


def insight_cards(ledger: DataFrame) -> DataFrame:
    return unpivot_metrics(insights(ledger), [
        (1, "Avg Purchase", currency_text(F.col("averagePurchaseAmount").cast("decimal(38,2)")),
         F.concat(F.col("purchaseCount").cast("string"), F.lit(" purchases"))),
        (2, "Monthly Pace", currency_text(F.col("monthlyPaceAmount").cast("decimal(38,2)")), F.lit("Average spending")),
        (3, "Largest Purchase", currency_text(F.col("largestPurchaseAmount")), F.col("largestPurchaseMerchant")),
        (4, "Categorized", percent_text(F.col("categorizedPercent")), F.lit("Rules coverage")),
    ], ["cardOrder", "label", "value", "helper"])


def cashflow_by_period(ledger: DataFrame, period: str = "month") -> DataFrame:
    """Inflow, outflow and net per month or year, with the label shown for it."""
    if period == "year":
        key = F.coalesce(F.date_format("transactionDate", "yyyy"), F.lit("Unknown"))
    else:
        key = F.coalesce("yearMonth", F.date_format("transactionDate", "yyyy-MM"))
    rows = ledger.groupBy(key.alias("periodKey")).agg(
        _income().alias("inflowAmount"), (_net() + _absolute("fee")).cast(MONEY).alias("outflowAmount")
    )
    label = F.col("periodKey") if period == "year" else month_label(F.col("periodKey"))
    return rows.select(
        "periodKey", label.alias("periodLabel"), "inflowAmount", "outflowAmount",
        (F.col("inflowAmount") - F.col("outflowAmount")).cast(MONEY).alias("netCashflowAmount"),
    ).orderBy("periodKey")


def recent_cashflow(ledger: DataFrame, period: str = "month", n: int = RECENT) -> DataFrame:
    return last_n(cashflow_by_period(ledger, period), "periodKey", n)


def top_categories(ledger: DataFrame) -> DataFrame:
    rows = (
        ledger.filter(F.col("transactionEventType").isin("purchase", "refund"))
        .groupBy(F.coalesce("spendingCategoryName", F.lit("Unknown")).alias("spendingCategoryName"))
        .agg(_net().alias("netSpendingAmount")).filter(F.col("netSpendingAmount") != 0)
    )
    return top_k(rows, [F.desc("netSpendingAmount"), F.asc("spendingCategoryName")], TOP)


def top_merchants(ledger: DataFrame) -> DataFrame:
    rows = (
        ledger.filter(_event("purchase"))
        .groupBy(F.coalesce("merchantDisplayName", F.lit("Unknown")).alias("merchantDisplayName"))
        .agg(F.sum(F.abs("transactionAmount")).cast(MONEY).alias("totalSpendingAmount"))
    )
    return top_k(rows, [F.desc("totalSpendingAmount"), F.asc("merchantDisplayName")], TOP)


def account_mix(ledger: DataFrame) -> DataFrame:
    rows = (
        ledger.filter(F.col("transactionEventType").isin("purchase", "refund"))
        .groupBy(F.coalesce("accountType", F.lit("Unknown")).alias("accountType"))
        .agg(_net().alias("spendingAmount"))
    )
    return rows.filter(F.col("spendingAmount") > 0).orderBy(F.desc("spendingAmount"), "accountType")


def account_share(ledger: DataFrame) -> DataFrame:
    """Each account type's share of the mix in whole percent; the frame has one row per account type."""
    mix = account_mix(ledger)
    total = F.sum("spendingAmount").over(Window.partitionBy(F.lit(1))).cast("double")
    return mix.withColumn("sharePercent", whole_percent(F.col("spendingAmount").cast("double") / total))
