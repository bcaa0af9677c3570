"""Approval of manual category rules: check requests, store the rules, update the matching open transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import EVENT_TYPES, OPEN_CATEGORIES
from ..functions.text import hash16, match_text
from ..operators.constraints import MATCH_TYPES
from ..operators.joins import lookup
from ..operators.numbering import dedupe
from ..operators.rules import text_matches
from ..sources.store import Store, materialise, temporary
from .silver import upsert_rules

# Fixed values.
MANUAL_RULE = "Manual Category Rule "
MANUAL_PRIORITY = 120
FIELDS = [
    "sourceAccountType", "transactionType", "transactionEventType", "descriptionMatchType", "descriptionMatchText",
    "spendingCategoryName",
]


def prepare_manual_rules(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """Requests with normalised text, category key, rule name and `rejectReason` (NULL for a valid one).

    `requests` has FIELDS and `requestOrder`, a distinct number per request. A missing match type means contains.
    """
    active = categories.filter("isActive").select(
        F.col("spendingCategoryName"), F.col("spendingCategoryKey")
    )
    kind = F.coalesce("descriptionMatchType", F.lit("contains"))
    rows = requests.withColumns({
        "descriptionMatchType": kind, "ruleText": match_text(F.col("descriptionMatchText")),
    }).join(active, "spendingCategoryName", "left")
    empty = F.lit(False)
    for name in FIELDS:
        empty = empty | (F.coalesce(F.col(name), F.lit("")) == "")
    reason = (
        F.when(empty, "a field is empty")
        .when(~F.col("sourceAccountType").isin("checking", "creditCard"), "account type")
        .when(~F.col("descriptionMatchType").isin(MATCH_TYPES), "match type")
        .when(~F.col("transactionEventType").isin(EVENT_TYPES), "event type")
        .when(F.col("ruleText") == "", "blank match text")
        .when(F.col("spendingCategoryKey").isNull(), "unknown or inactive category")
    )
    name = F.concat(F.lit(MANUAL_RULE), hash16(
        F.col("sourceAccountType"), F.col("transactionType"), F.col("transactionEventType"),
        F.col("descriptionMatchType"), F.col("ruleText"), F.col("spendingCategoryKey"),
    ))
    return rows.withColumn("rejectReason", reason).withColumn(
        "ruleName", F.when(F.col("rejectReason").isNull(), name)
    )


def manual_rules(prepared: DataFrame) -> DataFrame:
    """The valid requests as rules, one per name; the first request's place decides the order of new keys."""
    valid = prepared.filter("rejectReason IS NULL")
    return dedupe(valid, ["ruleName"], [F.col("requestOrder")]).select(
        "requestOrder", "ruleName", "sourceAccountType", F.lit(None).cast("string").alias("sourceCategoryName"),
        "transactionType", "descriptionMatchType", F.col("ruleText").alias("descriptionMatchText"),
        "spendingCategoryKey", "transactionEventType", F.lit("manual").alias("categoryAssignmentSource"),
        F.lit(MANUAL_PRIORITY).alias("rulePriority"),
    )


# What decides whether a request matches an open fact.
OPEN_EVIDENCE = ["financialAccountKey", "transactionType", "transactionEventType", "transactionDescriptionClean"]


def open_evidence(fact: DataFrame, accounts: DataFrame, categories: DataFrame) -> DataFrame:
    """The distinct OPEN_EVIDENCE of facts without a real category, with `facts` (how many), `accountType` and match `text`."""
    open_keys = categories.filter(F.col("spendingCategoryName").isin(OPEN_CATEGORIES)).select("spendingCategoryKey")
    rows = lookup(fact, open_keys, ["spendingCategoryKey"], ["transactionKey"], how="left_semi")
    seen = rows.groupBy(OPEN_EVIDENCE).agg(F.count("*").alias("facts"))
    return seen.join(accounts.select("financialAccountKey", "accountType"), "financialAccountKey").withColumn(
        "text", match_text(F.col("transactionDescriptionClean")))


def applied_requests(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Evidence rows with each request that updates their facts: `rules` are valid prepared requests.

    Requests act one after another. A fact stays open, and later requests can match it again, until one gives it a real
    category; so a fact is updated by its matches up to and including the first with a real category. Requests meet the
    distinct texts, all of them in one pass.
    """
    known = rules.select(
        F.col("requestOrder").alias("ruleId"), "requestOrder", "descriptionMatchType", "ruleText", "ruleName", "spendingCategoryKey",
        "sourceAccountType", F.col("transactionType").alias("_type"), F.col("transactionEventType").alias("_event"),
        F.col("spendingCategoryName").isin(OPEN_CATEGORIES).alias("staysOpen"),
    )
    found = text_matches(evidence.select("text").distinct(), known, whole_if_short=True)
    same = (
        (F.col("accountType") == F.col("sourceAccountType")) & (F.col("transactionType") == F.col("_type"))
        & (F.col("transactionEventType") == F.col("_event"))
    )
    matched = materialise(evidence.join(found, "text").filter(same).select(
        *OPEN_EVIDENCE, "facts", "requestOrder", "ruleName", "spendingCategoryKey", "staysOpen"), "matched")
    closing = matched.filter(~F.col("staysOpen")).groupBy(OPEN_EVIDENCE).agg(F.min("requestOrder").alias("_closing"))
    both = matched.join(closing, OPEN_EVIDENCE, "left")
    return both.filter(F.col("_closing").isNull() | (F.col("requestOrder") <= F.col("_closing"))).drop("_closing")


def update_counts(applied: DataFrame) -> DataFrame:
    """(requestOrder, updatedTransactionCount) of the requests that updated anything."""
    return applied.groupBy("requestOrder").agg(F.sum("facts").alias("updatedTransactionCount"))


def changed_facts(fact: DataFrame, categories: DataFrame, applied: DataFrame, rules: DataFrame) -> DataFrame:
    """New values of the open facts that requests update: category and rule of the one that acts last. Event types stay."""
    keys = rules.select("ruleName", "categoryRuleKey")
    last = applied.groupBy(OPEN_EVIDENCE).agg(F.max_by(F.struct("spendingCategoryKey", "ruleName"), F.col("requestOrder")).alias("last"))
    last = materialise(last.select(*OPEN_EVIDENCE, "last.*").join(keys, "ruleName").drop("ruleName"), "last")
    open_keys = categories.filter(F.col("spendingCategoryName").isin(OPEN_CATEGORIES)).select("spendingCategoryKey")
    rows = lookup(fact.select("transactionKey", "spendingCategoryKey", *OPEN_EVIDENCE), open_keys, ["spendingCategoryKey"], ["transactionKey"], how="left_semi")
    return lookup(rows.drop("spendingCategoryKey"), last, OPEN_EVIDENCE, ["transactionKey"], how="inner").select(
        "transactionKey", "spendingCategoryKey", "categoryRuleKey", "transactionEventType", F.current_timestamp().alias("modifiedDatetime"))


def approve_rules(store: Store, requests: DataFrame) -> DataFrame:
    """Store the rules and update the facts, published together; returns one row per request.

    (requestOrder, ruleName, categoryRuleKey, rejectReason, updatedTransactionCount). Facts get their new values through a
    change file; no part of the fact is rewritten. Orders that are missing or shared by requests fail, as nothing would
    say which of them acts first.
    """
    odd = requests.groupBy("requestOrder").count().filter("count > 1 OR requestOrder IS NULL").limit(1).collect()
    if odd:
        raise ValueError(f"requestOrder {odd[0].requestOrder} is missing or not distinct")
    with temporary(store.spark):
        return materialise(_approve(store, requests), "approvals", keep=True)


def _approve(store: Store, requests: DataFrame) -> DataFrame:
    change = store.begin()
    categories, accounts, fact = (store.table(t) for t in ("dimSpendingCategory", "dimFinancialAccount", "factTransaction"))
    prepared = materialise(prepare_manual_rules(requests, categories), "requests")
    rules = change.put("mapCategoryRule", upsert_rules(
        store.table("mapCategoryRule"), manual_rules(prepared), order=["requestOrder"], unconditional=True
    ))
    evidence = materialise(open_evidence(fact, accounts, categories), "open-evidence")
    applied = materialise(applied_requests(evidence, prepared.filter("rejectReason IS NULL")), "applied")
    if not applied.isEmpty():
        change.alter("factTransaction", changed_facts(fact, categories, applied, rules))
    change.commit()
    keys = rules.select("ruleName", "categoryRuleKey")
    result = lookup(prepared.select("requestOrder", "ruleName", "rejectReason"), keys, ["ruleName"], ["requestOrder"]).select(
        "requestOrder", "ruleName", "categoryRuleKey", "rejectReason")
    return result.join(update_counts(applied), "requestOrder", "left").withColumn(
        "updatedTransactionCount", F.coalesce("updatedTransactionCount", F.lit(0)))
