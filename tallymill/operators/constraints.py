"""Declared constraints of the tables, and the violations a frame has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import ASSIGNMENT_SOURCES, EVENT_TYPES
from .aggregates import unpivot_metrics
from .joins import orphan_counts, unknown_keys
from .summaries import key_use

# Closed domains of the columns.
MATCH_TYPES = ["exact", "startsWith", "contains"]
_FILE_TYPES = ["chaseCheckingCsv", "chaseCreditCsv", "unknown"]
_SYSTEMS = ["chase", "unknown"]
_ACCOUNTS = ["checking", "creditCard", "unknown"]


def _required(*names: str) -> dict[str, Column]:
    return {f"{name} not null": F.col(name).isNotNull() for name in names}


def _in(name: str, values: list[str]) -> dict[str, Column]:
    return {f"{name} domain": F.col(name).isin(values)}


def _between(name: str, low: int, high: int) -> dict[str, Column]:
    return {f"{name} range": F.col(name).between(low, high)}


def row_rules(table: str) -> dict[str, Column]:
    """Name -> condition every row has to meet; NULL counts as met, as in SQL CHECK."""
    if table in ("rawChaseCheckingTransaction", "rawChaseCreditTransaction"):
        return {
            **_required("recordKey", "sourceFileName", "sourceFileHash", "sourceRowNumber"),
            "sourceRowNumber positive": F.col("sourceRowNumber") > 0,
        }
    if table == "dimSourceFile":
        return {
            **_required("sourceFileKey", "sourceFileName", "sourceFileHash", "sourceFileType", "rowCount"),
            **_in("sourceFileType", _FILE_TYPES), **_in("sourceSystemName", _SYSTEMS),
            "rowCount not negative": F.col("rowCount") >= 0,
        }
    if table == "dimFinancialAccount":
        return {
            **_required("financialAccountKey", "institutionName", "accountType", "accountLastFour", "accountDisplayName"),
            **_in("institutionName", _SYSTEMS), **_in("accountType", _ACCOUNTS),
            "accountLastFour length": (F.length("accountLastFour") == 4) | (F.col("accountLastFour") == "unknown"),
        }
    if table == "dimSpendingCategory":
        return _required("spendingCategoryKey", "spendingCategoryName", "parentSpendingCategoryName", "isActive")
    if table == "dimMerchant":
        return _required("merchantKey", "merchantNormalizedName", "merchantDisplayName", "isActive")
    if table == "dimCalendarDate":
        return {
            **_required("calendarDateKey", "calendarDate", "yearMonth", "monthStartDate", "monthEndDate"),
            **_between("calendarMonth", 1, 12), **_between("calendarMonthNumber", 1, 12),
            **_between("calendarQuarter", 1, 4), **_between("calendarDayOfMonth", 1, 31),
        }
    if table == "mapMerchantRule":
        return {
            **_required("merchantRuleKey", "ruleName", "descriptionMatchType", "descriptionMatchText", "merchantKey"),
            **_in("descriptionMatchType", MATCH_TYPES),
        }
    if table == "mapCategoryRule":
        return {
            **_required("categoryRuleKey", "ruleName", "spendingCategoryKey", "rulePriority", "isActive"),
            **_in("sourceAccountType", ["checking", "creditCard"]), **_in("descriptionMatchType", MATCH_TYPES),
            "match type and text paired":
                F.col("descriptionMatchType").isNull() == F.col("descriptionMatchText").isNull(),
            **_in("transactionEventType", EVENT_TYPES), **_in("categoryAssignmentSource", ASSIGNMENT_SOURCES),
        }
    return {
        **_required(
            "transactionKey", "sourceFileKey", "financialAccountKey", "transactionDateKey", "postedDateKey",
            "merchantKey", "merchantRuleKey", "spendingCategoryKey", "categoryRuleKey", "sourceRowNumber",
            "sourceRowIdentifier", "transactionNaturalKey", "transactionType", "transactionAmount",
        ),
        "sourceRowNumber positive": F.col("sourceRowNumber") > 0,
        **_in("transactionEventType", EVENT_TYPES),
    }


UNIQUE = {
    "rawChaseCheckingTransaction": [["recordKey"], ["sourceFileHash", "sourceRowNumber"]],
    "rawChaseCreditTransaction": [["recordKey"], ["sourceFileHash", "sourceRowNumber"]],
    "dimSourceFile": [["sourceFileKey"], ["sourceFileHash"]],
    "dimFinancialAccount": [["financialAccountKey"], ["institutionName", "accountType", "accountLastFour"]],
    "dimSpendingCategory": [["spendingCategoryKey"], ["spendingCategoryName"]],
    "dimMerchant": [["merchantKey"], ["merchantNormalizedName"]],
    "dimCalendarDate": [["calendarDateKey"], ["calendarDate"]],
    "mapMerchantRule": [
        ["merchantRuleKey"], ["ruleName"], ["descriptionMatchType", "descriptionMatchText", "merchantKey"],
    ],
    "mapCategoryRule": [["categoryRuleKey"], ["ruleName"]],
    "factTransaction": [["transactionKey"], ["sourceRowIdentifier"], ["sourceFileKey", "sourceRowNumber"]],
}
FACT_REFERENCES = {
    "sourceFileKey": ("dimSourceFile", "sourceFileKey"),
    "financialAccountKey": ("dimFinancialAccount", "financialAccountKey"),
    "transactionDateKey": ("dimCalendarDate", "calendarDateKey"),
    "postedDateKey": ("dimCalendarDate", "calendarDateKey"),
    "merchantKey": ("dimMerchant", "merchantKey"),
    "merchantRuleKey": ("mapMerchantRule", "merchantRuleKey"),
    "spendingCategoryKey": ("dimSpendingCategory", "spendingCategoryKey"),
    "categoryRuleKey": ("mapCategoryRule", "categoryRuleKey"),
}
MAP_REFERENCES = {
    "mapMerchantRule": {"merchantKey": ("dimMerchant", "merchantKey")},
    "mapCategoryRule": {"spendingCategoryKey": ("dimSpendingCategory", "spendingCategoryKey")},
}


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """(tableName, constraintName, violationCount): one pass for the row rules, one count per unique key."""
    rules = row_rules(table)
    counts = df.agg(*[
        F.count_if(F.coalesce(~condition, F.lit(False))).alias(f"c{i}") for i, condition in enumerate(rules.values())
    ])
    frames = [unpivot_metrics(
        counts, [(table, name, F.col(f"c{i}")) for i, name in enumerate(rules)],
        ["tableName", "constraintName", "violationCount"],
    )]
    for keys in UNIQUE[table]:
        repeated = df.groupBy(keys).agg(F.count("*").alias("n")).filter("n > 1")
        frames.append(repeated.agg(F.count("*").alias("violationCount")).select(
            F.lit(table).alias("tableName"), F.lit(f"{', '.join(keys)} unique").alias("constraintName"),
            "violationCount",
        ))
    return reduce(DataFrame.unionByName, frames)


def check_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(tableName, constraintName, violationCount) for the eight keys of the fact and the two of the rule maps."""
    frames = []
    for table, references in {"factTransaction": FACT_REFERENCES, **MAP_REFERENCES}.items():
        known = {k: (tables[t], key) for k, (t, key) in references.items()}
        sums = getattr(tables, "sums", None) if table == "factTransaction" else None
        found = unknown_keys(key_use(sums), known) if sums else orphan_counts(tables[table], known)
        frames.append(found.select(
            F.lit(table).alias("tableName"), F.concat(F.col("keyColumn"), F.lit(" known")).alias("constraintName"),
            F.col("orphanRowCount").alias("violationCount"),
        ))
    return reduce(DataFrame.unionByName, frames)
