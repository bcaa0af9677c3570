from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import rules

RULE = (
    "categoryRuleKey long, sourceAccountType string, sourceCategoryName string, transactionType string, "
    "descriptionMatchType string, descriptionMatchText string, spendingCategoryKey long, transactionEventType string, "
    "categoryAssignmentSource string, rulePriority int, isActive boolean"
)
TXN = (
    "sourceRowIdentifier string, sourceAccountType string, sourceCategoryName string, transactionType string, "
    "transactionRuleMatchText string"
)


def rule(key, kind, text, priority=90, account=None, category=None, type_=None, source="rule", active=True):
    return (key, account, category, type_, kind, text, key * 10, "fee", source, priority, active)


def normal(text):
    import re

    return re.sub("[^A-Z0-9]+", " ", text.upper()).strip()


def brute_force(txn, table):
    """Rule by rule, as written down in the survey."""
    _, account, category, type_, text = txn
    best = None
    for key, r_account, r_category, r_type, kind, wanted, _, _, source, priority, active in table:
        if not active or source not in ("rule", "manual", "ai") or kind is None:
            continue
        if (r_account and r_account != account) or (r_category and r_category != category) or (r_type and r_type != type_):
            continue
        wanted = normal(wanted or "")
        words = [w for w in wanted.split(" ") if len(w) > 1]
        hit = {
            "exact": text == wanted, "startsWith": text.startswith(wanted),
            "contains": bool(words) and all(w in text for w in words),
        }[kind]
        if hit and (best is None or (priority, key) > best):
            best = (priority, key)
    return best and best[1]


def run(spark, txns, table):
    t = spark.createDataFrame(txns, TXN)
    known = rules.classifying_rules(spark.createDataFrame(table, RULE))
    rows = rules.match_rules(t, known).select("sourceRowIdentifier", "winner.categoryRuleKey").collect()
    assert len(rows) == len(txns)
    return {r.sourceRowIdentifier: r.categoryRuleKey for r in rows}


CASES = [
    ("any order", [rule(1, "contains", "payment zelle")], "ZELLE PAYMENT TO 7", 1),
    ("substring, not word", [rule(1, "contains", "EPAY")], "PREPAY CARD", 1),
    ("one-letter words never match", [rule(1, "contains", "X")], "X", None),
    ("one-letter words are ignored beside others", [rule(1, "contains", "Q bus")], "THE BUSINESS", 1),
    ("prefix", [rule(1, "startsWith", "red w")], "RED WIDGET", 1),
    ("prefix only at the start", [rule(1, "startsWith", "widget")], "RED WIDGET", None),
    ("empty prefix matches all", [rule(1, "startsWith", "!")], "ANY", 1),
    ("exact after normalising", [rule(1, "exact", "Trader Joe's #12")], "TRADER JOE S 12", 1),
    ("larger key wins a tie", [rule(1, "contains", "OLD"), rule(2, "contains", "BOLT")], "OLD BOLT", 2),
    ("priority wins", [rule(1, "contains", "OLD", 95), rule(2, "contains", "BOLT", 94)], "OLD BOLT", 1),
    ("inactive", [rule(1, "contains", "OLD", active=False)], "OLD BOLT", None),
    ("mapped source does not classify", [rule(1, "contains", "OLD", source="chaseMapped")], "OLD BOLT", None),
    ("wildcards", [rule(1, "contains", "OLD", account="creditCard")], "OLD BOLT", None),
    ("type condition", [rule(1, "contains", "OLD", type_="T")], "OLD BOLT", 1),
    ("category condition on a row without one", [rule(1, "contains", "OLD", category="Gas")], "OLD BOLT", None),
]


def test_cases(spark):
    for name, table, text, expected in CASES:
        txn = ("t", "checking", None, "T", text)
        assert brute_force(txn, table) == expected, name
        assert run(spark, [txn], table)["t"] == expected, name


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_brute_force(spark, seed):
    random.seed(seed)
    words = ["OLD", "RED", "BOLT", "ROD", "BRAND", "A", "X1", "EPAY", "PREPAY", "GAS", "12", "7"]
    pick = lambda n: " ".join(random.choices(words, k=random.randint(0, n)))
    txns = [
        (f"t{i}", random.choice(["checking", "creditCard"]), random.choice([None, "Gas", "Home"]), random.choice(["S", "T"]),
         normal(pick(5)) if i % 3 else "OLD BOLT BRAND 12")
        for i in range(300)
    ]
    table = [
        rule(i, random.choice(["exact", "startsWith", "contains", None]), pick(3), random.choice([80, 90]),
             random.choice([None, "checking"]), random.choice([None, None, "Gas"]), random.choice([None, None, "T"]),
             random.choice(["rule", "manual", "ai", "fallback"]), random.random() > 0.1)
        for i in range(1, 60)
    ]
    expected = {t[0]: brute_force(t, table) for t in txns}
    assert run(spark, txns, table) == expected


def test_unknown_match_types_and_missing_priorities(spark):
    txn = ("t", "checking", None, "T", "OLD BOLT")
    assert run(spark, [txn], [rule(1, "regex", "OLD"), rule(2, "contains", "OLD", None), rule(3, "contains", "OLD", 1)]) == {"t": 3}
    assert run(spark, [txn], [rule(1, "regex", "OLD"), rule(2, "contains", "OLD", None)]) == {"t": 2}


def test_no_rules(spark):
    txn = ("t", "checking", None, "T", "OLD")
    assert run(spark, [txn], [rule(1, None, None)]) == {"t": None}


def test_token_contains(column):
    words = lambda: F.array(F.lit("OLD"), F.lit("BRAND"))
    assert column(lambda c: rules.token_contains(c, words()), ["MY BRANDOLD", "OLD"]) == [True, False]
    assert column(lambda c: rules.token_contains(c, F.array().cast("array<string>")), ["X"]) == [False]
