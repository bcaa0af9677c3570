"""Rule suggestions from uncategorised ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import OPEN_CATEGORIES, hint_category
from ..functions.text import suggested_match_text
from ..operators.aggregates import top_k
from .gold import MONEY

SHOWN = 6
GROUP = ["accountType", "transactionType", "transactionEventType", "descriptionMatchText"]


def confidence(text: Column, count: Column) -> Column:
    short = F.size(F.split(text, " ")) <= 2
    return F.when((count >= 5) & short, "High").when(count >= 2, "Medium").otherwise("Review")


def suggestion_key() -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in GROUP]
    return F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2], F.lit("|"), parts[3])


def suggest_rules(ledger: DataFrame, available: list[str]) -> DataFrame:
    """One suggestion per account, type, event and suggested text, over uncategorised purchases and refunds.

    `available` are the selectable category names in their listed order. The example is the group's first row in
    ledger order (latest date, then largest key). Rows are summed per merchant first: the text is derived once
    per merchant and group, not once per transaction.
    """
    open_rows = ledger.filter(
        F.col("spendingCategoryName").isin(OPEN_CATEGORIES)
        & F.col("transactionEventType").isin("purchase", "refund")
    )
    place = F.struct("transactionDate", "transactionKey")
    per_merchant = open_rows.groupBy("accountType", "transactionType", "transactionEventType", "merchantDisplayName").agg(
        F.count("*").alias("n"), F.sum(F.abs("transactionAmount")).cast(MONEY).alias("total"), F.max(place).alias("place")
    ).withColumn("descriptionMatchText", suggested_match_text(F.col("merchantDisplayName")))
    groups = per_merchant.filter(F.col("descriptionMatchText") != "").groupBy(GROUP).agg(
        F.sum("n").alias("transactionCount"), F.sum("total").cast(MONEY).alias("totalAmount"),
        F.max_by("merchantDisplayName", "place").alias("exampleMerchant"),
    )
    text = F.col("descriptionMatchText")
    return groups.select(
        suggestion_key().alias("suggestionKey"),
        F.col("accountType").alias("sourceAccountType"),
        "transactionType", "transactionEventType",
        F.lit("contains").alias("descriptionMatchType"),
        "descriptionMatchText",
        hint_category(text, available).alias("suggestedCategoryName"),
        "exampleMerchant", "transactionCount", "totalAmount",
        confidence(text, F.col("transactionCount")).alias("confidenceLabel"),
    )


def exclude_approved(suggestions: DataFrame, approved: DataFrame) -> DataFrame:
    return suggestions.join(approved.select("suggestionKey"), "suggestionKey", "left_anti").select(suggestions.columns)


def top_suggestions(suggestions: DataFrame, k: int = SHOWN) -> DataFrame:
    order = [F.desc("transactionCount"), F.desc("totalAmount"), F.asc("suggestionKey")]
    return top_k(suggestions, order, k)
