"""Gold views over Silver tables.

The aggregating views sum the fact by its own keys first and join the few resulting rows to the dimensions, so no
fact row is shuffled for a dimension join and a frequent merchant or account is one row before any join. All but the
merchant view take those sums from the summaries that the store keeps, and read no fact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import OPEN_CATEGORIES
from ..functions.text import key_date
from ..operators.aggregates import with_previous
from ..operators.joins import lookup
from ..operators.summaries import MONEY, SUMMARIES

MONTH = ["yearMonth", "monthStartDate"]
CATEGORY = ["parentSpendingCategoryName", "spendingCategoryName"]


def _total(name: str):
    return F.sum(name).cast(MONEY).alias(name)


def summary_of(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """A summary of the fact as the store keeps it (see sources/store.py), or counted from the rows where it has none."""
    kept = getattr(tables, "sums", {}).get(name)
    return SUMMARIES[name].of(tables["factTransaction"]) if kept is None else kept


def event_totals(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Per key combination and event type: rows (n), signed sum, sum of absolute amounts."""
    return summary_of(tables, "totals").groupBy(*keys, "transactionEventType").agg(
        F.sum("n").alias("n"), F.sum("signed").cast(MONEY).alias("signed"), F.sum("absolute").cast(MONEY).alias("absolute"),
    )


def _months(totals: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    days = tables["dimCalendarDate"].select(F.col("calendarDateKey").alias("transactionDateKey"), *MONTH)
    return totals.join(days, "transactionDateKey")


def _accounts(totals: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return totals.join(tables["dimFinancialAccount"].select("financialAccountKey", "accountType"), "financialAccountKey")


def _categories(totals: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return totals.join(tables["dimSpendingCategory"].select("spendingCategoryKey", *CATEGORY), "spendingCategoryKey")


def _count(event: str):
    return F.sum(F.when(F.col("transactionEventType") == event, F.col("n")).otherwise(0))


def _amount(event: str, column: str = "absolute"):
    zero = F.lit(0).cast(MONEY)
    return F.sum(F.when(F.col("transactionEventType") == event, F.col(column)).otherwise(zero)).cast(MONEY)


def monthly_spending(tables: dict[str, DataFrame]) -> DataFrame:
    """Purchases, refunds and their difference per month, account type and category. A group that holds other
    events only has zeros."""
    totals = event_totals(tables, ["transactionDateKey", "financialAccountKey", "spendingCategoryKey"])
    rows = _categories(_accounts(_months(totals, tables), tables), tables)
    return rows.groupBy(*MONTH, "accountType", *CATEGORY).agg(
        _count("purchase").alias("purchaseTransactionCount"), _count("refund").alias("refundTransactionCount"),
        _amount("purchase").alias("grossSpendingAmount"), _amount("refund").alias("refundAmount"),
    ).withColumn("netSpendingAmount", (F.col("grossSpendingAmount") - F.col("refundAmount")).cast(MONEY))


def monthly_cashflow(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts and amounts per event type, month and account type. Income and transfers are signed sums, the rest
    sums of absolute amounts; payments, debt payments and transfers are no outflow."""
    totals = event_totals(tables, ["transactionDateKey", "financialAccountKey"])
    events = {
        "income": "income", "purchase": "purchase", "refund": "refund", "fee": "fee", "payment": "internalPayment",
        "debtPayment": "debtPayment", "transfer": "transfer",
    }
    amounts = {
        "incomeAmount": _amount("income", "signed"), "grossPurchaseAmount": _amount("purchase"),
        "refundAmount": _amount("refund"), "feeAmount": _amount("fee"), "internalPaymentAmount": _amount("payment"),
        "debtPaymentAmount": _amount("debtPayment"), "netTransferAmount": _amount("transfer", "signed"),
    }
    rows = _accounts(_months(totals, tables), tables).groupBy(*MONTH, "accountType").agg(
        F.sum("n").alias("transactionCount"),
        *[_count(event).alias(f"{name}TransactionCount") for event, name in events.items()],
        *[column.alias(name) for name, column in amounts.items()],
    )
    outflow = F.col("grossPurchaseAmount") - F.col("refundAmount") + F.col("feeAmount")
    return rows.withColumns({
        "inflowAmount": F.col("incomeAmount"),
        "outflowAmount": outflow.cast(MONEY),
        "netCashflowAmount": (F.col("incomeAmount") - outflow).cast(MONEY),
    })


def top_merchants(tables: dict[str, DataFrame]) -> DataFrame:
    """Purchases per merchant, account type and category; the dates span all events of the group."""
    purchase = F.col("transactionEventType") == "purchase"
    amount = F.abs("transactionAmount")
    totals = tables["factTransaction"].groupBy("merchantKey", "financialAccountKey", "spendingCategoryKey").agg(
        F.count_if(purchase).alias("n"), F.sum(F.when(purchase, amount)).alias("total"),
        F.min("transactionDateKey").alias("first"), F.max("transactionDateKey").alias("last"),
    )
    names = tables["dimMerchant"].select("merchantKey", "merchantDisplayName")
    rows = _categories(_accounts(totals.join(names, "merchantKey"), tables), tables)
    zero = F.lit(0).cast(MONEY)
    total = F.coalesce(F.sum("total"), zero).cast(MONEY)
    return rows.groupBy("merchantDisplayName", "accountType", *CATEGORY).agg(
        F.sum("n").alias("purchaseTransactionCount"),
        total.alias("totalSpendingAmount"),
        F.when(F.sum("n") > 0, total.cast("double") / F.sum("n").cast("double")).otherwise(F.lit(0.0))
        .alias("averagePurchaseAmount"),
        key_date(F.min("first")).alias("firstTransactionDate"),
        key_date(F.max("last")).alias("lastTransactionDate"),
    )


def uncategorized_summary(tables: dict[str, DataFrame]) -> DataFrame:
    open_keys = tables["dimSpendingCategory"].filter(F.col("spendingCategoryName").isin(OPEN_CATEGORIES))
    totals = event_totals(tables, ["transactionDateKey", "financialAccountKey", "spendingCategoryKey", "transactionType"])
    rows = totals.join(open_keys.select("spendingCategoryKey"), "spendingCategoryKey")
    return _accounts(_months(rows, tables), tables).groupBy(
        *MONTH, "accountType", "transactionType", "transactionEventType"
    ).agg(F.sum("n").alias("transactionCount"), F.sum("signed").cast(MONEY).alias("netTransactionAmount"))


def category_trend(tables: dict[str, DataFrame]) -> DataFrame:
    """Net spending per month and category with the preceding listed month; months without rows are not filled in."""
    totals = event_totals(tables, ["transactionDateKey", "spendingCategoryKey"])
    monthly = _categories(_months(totals, tables), tables).groupBy(*MONTH, *CATEGORY).agg(
        (_amount("purchase") - _amount("refund")).cast(MONEY).alias("netSpendingAmount")
    )
    trend = with_previous(monthly, CATEGORY, "monthStartDate", "netSpendingAmount", "previousMonthNetSpendingAmount")
    change = F.col("netSpendingAmount") - F.coalesce("previousMonthNetSpendingAmount", F.lit(0).cast(MONEY))
    return trend.withColumn("monthOverMonthChangeAmount", change.cast(MONEY))


LEDGER_COLUMNS = [
    "transactionKey", "transactionDate", "postedDate", *MONTH, "accountType", "merchantDisplayName", *CATEGORY,
    "transactionType", "transactionEventType", "transactionAmount",
]


def transaction_ledger(
    tables: dict[str, DataFrame], columns: list[str] | None = None, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """One safe row per transaction.

    With `columns`, only the dimensions that those columns come from are joined: every fact key has its dimension
    row (the load sees to it, check 9 verifies it), so leaving a join out drops no row. `start` and `end` become a
    range of date keys on the fact scan, which Parquet statistics can skip files by.
    """
    columns = columns or LEDGER_COLUMNS
    fact, spread = tables["factTransaction"], ["transactionKey"]
    if start is not None and end is not None:
        first, last = [int(d.strftime("%Y%m%d")) for d in sorted((start, end))]
        fact = fact.filter(F.col("transactionDateKey").between(first, last))
    days = tables["dimCalendarDate"]
    moved = days.select(
        F.col("calendarDateKey").alias("transactionDateKey"), F.col("calendarDate").alias("transactionDate"), *MONTH
    )
    posted = days.select(F.col("calendarDateKey").alias("postedDateKey"), F.col("calendarDate").alias("postedDate"))
    dimensions = {
        "transactionDateKey": moved,
        "postedDateKey": posted,
        "financialAccountKey": tables["dimFinancialAccount"].select("financialAccountKey", "accountType"),
        "merchantKey": tables["dimMerchant"].select("merchantKey", "merchantDisplayName"),
        "spendingCategoryKey": tables["dimSpendingCategory"].select("spendingCategoryKey", *CATEGORY),
    }
    rows = fact
    for key, dimension in dimensions.items():
        if set(dimension.columns) & set(columns):
            rows = lookup(rows, dimension, [key], spread, how="inner")
    return rows.select(columns)


VIEWS = {
    "vw_MonthlySpendingByCategory": monthly_spending,
    "vw_MonthlyCashflow": monthly_cashflow,
    "vw_TopMerchantsBySpending": top_merchants,
    "vw_UncategorizedTransactionSummary": uncategorized_summary,
    "vw_SpendingCategoryTrend": category_trend,
    "vw_TransactionLedger": transaction_ledger,
}


def merchant_groups(tables: dict[str, DataFrame]) -> DataFrame:
    """The groups of `top_merchants`, without their figures: from the summaries."""
    used = summary_of(tables, "merchants").join(tables["dimMerchant"].select("merchantKey", "merchantDisplayName"), "merchantKey")
    return _categories(_accounts(used, tables), tables).select("merchantDisplayName", "accountType", *CATEGORY).distinct()


def register_views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All Gold views as temporary views named gold_<view>."""
    views = {name: build(tables) for name, build in VIEWS.items()}
    for name, view in views.items():
        view.createOrReplaceTempView(f"gold_{name}")
    return views
