from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.operators import aggregates, constraints, joins, numbering, upsert
from tallymill.sources.literals import literal_rows
from tallymill.sources.seeds import seed_unknown_members

LONG_AGO = dt.datetime(2001, 1, 1)


def test_number_rows_with_a_hot_group(spark):
    random.seed(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", random.random(), i) for i in range(3000)] + [(None, 0.5, 5000), (None, 0.1, 5001)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    found = {r.i: r.n for r in numbering.number_rows(df, ["v", "i"], ["g"], "n").collect()}
    expected = {}
    for group in {r[0] for r in rows}:
        for place, row in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == group), 1):
            expected[row[1]] = place
    assert found == expected


def test_number_rows_over_the_whole_frame_and_of_nothing(spark):
    df = spark.range(500).repartition(7)
    assert all(r.n == r.id + 1 for r in numbering.number_rows(df, ["id"], name="n").collect())
    assert numbering.number_rows(df.filter("id < 0"), ["id"], name="n").count() == 0


def test_assign_keys_continue_the_sequence(spark):
    names = spark.createDataFrame([(c,) for c in "dacb"], "name string")
    found = {r.name: r.k for r in numbering.assign_keys(names, "k", ["name"], 500).collect()}
    assert found == {"a": 600, "b": 700, "c": 800, "d": 900}
    # The unknown member's -1 does not count.
    assert {r.k for r in numbering.assign_keys(names, "k", ["name"], -1).collect()} == {100, 200, 300, 400}


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 3, "w")], "k string, o int, v string")
    found = numbering.dedupe(df, ["k"], [F.col("o")])
    assert {(r.k, r.v) for r in found.collect()} == {("a", "y"), ("b", "z")}
    assert found.columns == ["k", "o", "v"]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    facts = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4)], "k string, v int")
    plain = facts.join(dim, "k", how)
    spread = joins.spread_join(facts, dim, ["k"], ["id"], how, hot_rows=20)
    assert sorted(map(tuple, spread.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    # The hot key really is spread.
    parts = facts.groupBy("k").count().filter("count > 20").count()
    assert parts >= 1


def test_lookup_spreads_where_adaptive_execution_is_off(spark):
    facts = spark.range(100).select("id", (F.col("id") % 4).alias("k"))
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    adaptive = joins.lookup(facts, dim, ["k"], ["id"], {"v": "none"}).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = joins.lookup(facts, dim, ["k"], ["id"], {"v": "none"}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r.id, r.v) for r in adaptive) == sorted((r.id, r.v) for r in spread)


def test_null_keys_are_spread(spark):
    facts = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, 1).cast("long").alias("k"))
    dim = spark.createDataFrame([(1, "a")], "k long, v string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = joins.spread_join(facts, dim, ["k"], ["id"], hot_rows=100)
        sizes = [r["n"] for r in joined.where("k IS NULL").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 1800 and max(sizes) < 900
        assert joined.where("v = 'a'").count() == 200
        assert joins.spread_join(facts, dim, ["k"], ["id"], how="inner", hot_rows=100).count() == 200
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_orphans_and_updates_by_key(spark):
    facts = spark.createDataFrame([(1, 10, 7), (2, 11, 7), (3, 10, 8)], "id long, a long, b long")
    a, b = spark.createDataFrame([(10,)], "k long"), spark.createDataFrame([(7,), (8,)], "k long")
    found = joins.orphan_counts(facts, {"a": (a, "k"), "b": (b, "k")})
    assert {(r.keyColumn, r.orphanRowCount) for r in found.collect()} == {("a", 1), ("b", 0)}
    listed = spark.createDataFrame([(1,), (3,), (3,)], "id long")
    changed = joins.update_where_key(facts, listed, "id", {"b": F.lit(0).cast("long")})
    assert sorted(map(tuple, changed.collect())) == [(1, 10, 0), (2, 11, 7), (3, 10, 0)]


def _merchants(spark, rows):
    ddl = schemas.TABLES["dimMerchant"]
    return literal_rows(spark, [(k, n, d, a, LONG_AGO, LONG_AGO) for k, n, d, a in rows], ddl)


def test_merge_updates_only_changes_and_inserts_the_rest(spark):
    target = seed_unknown_members(spark, "dimMerchant").unionByName(
        _merchants(spark, [(100, "A", "a", True), (200, "B", "b", True), (300, "C", "c", True)])
    )
    source = spark.createDataFrame([("A", "a"), ("B", "b2"), ("E", "e"), ("D", "d")], "merchantNormalizedName string, merchantDisplayName string")
    merged = upsert.merge_upsert(
        "dimMerchant", target, source, ["merchantNormalizedName"], ["merchantDisplayName"],
        when=upsert.changed(["merchantDisplayName"]),
    )
    found = {r.merchantNormalizedName: r for r in merged.collect()}
    assert {n: (r.merchantKey, r.merchantDisplayName) for n, r in found.items()} == {
        "unknown": (-1, "Unknown Merchant"), "A": (100, "a"), "B": (200, "b2"), "C": (300, "c"), "D": (400, "d"), "E": (500, "e"),
    }
    assert found["A"].modifiedDatetime == LONG_AGO and found["B"].modifiedDatetime > LONG_AGO
    assert found["B"].createdDatetime == LONG_AGO and found["D"].createdDatetime > LONG_AGO and found["D"].isActive


def test_merge_without_condition_touches_every_match(spark):
    target = _merchants(spark, [(100, "A", "a", True)])
    source = spark.createDataFrame([("A", "a")], "merchantNormalizedName string, merchantDisplayName string")
    merged = upsert.merge_upsert("dimMerchant", target, source, ["merchantNormalizedName"], ["merchantDisplayName"])
    assert merged.first().modifiedDatetime > LONG_AGO


def test_changed_treats_null_texts_as_empty(spark):
    rows = spark.createDataFrame([(1, "", None), (2, None, "x"), (3, "x", "x"), (4, None, None)], "id int, a string, b string")
    pairs = rows.select("id", F.struct(F.col("a").alias("c")).alias("t"), F.struct(F.col("b").alias("c")).alias("s"))
    assert [r[0] for r in pairs.orderBy("id").select(upsert.changed(["c"], nullable=["c"])).collect()] == [False, True, False, False]
    assert [r[0] for r in pairs.orderBy("id").select(upsert.changed(["c"])).collect()] == [False, False, False, False]


def test_constraints_count_each_fault(spark):
    good = dict(categoryRuleKey=1, ruleName="r", spendingCategoryKey=1, transactionEventType="fee",
                categoryAssignmentSource="rule", rulePriority=1, isActive=True)
    faults = [
        good, {**good, "categoryRuleKey": 2, "ruleName": "s", "descriptionMatchType": "exact"},
        {**good, "categoryRuleKey": 3, "ruleName": "r"}, {**good, "categoryRuleKey": 4, "ruleName": "t", "transactionEventType": "gift"},
        {**good, "categoryRuleKey": 5, "ruleName": None},
    ]
    names = schemas.columns("mapCategoryRule")
    df = literal_rows(spark, [tuple(f.get(n) for n in names) for f in faults], schemas.TABLES["mapCategoryRule"])
    found = {r.constraintName: r.violationCount for r in constraints.check_constraints(df, "mapCategoryRule").collect()}
    assert {k: v for k, v in found.items() if v} == {
        "match type and text paired": 1, "ruleName unique": 1, "transactionEventType domain": 1, "ruleName not null": 1,
    }


def test_small_aggregates(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, None)], "p int, v double")
    assert [r.p for r in aggregates.last_n(df, "p", 2).collect()] == [2, 3]
    assert df.agg(aggregates.count_if(F.col("v") > 5)).first()[0] == 1
    assert df.filter("p > 9").agg(aggregates.sum_or_zero(F.col("v"))).first()[0] == 0
