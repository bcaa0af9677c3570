"""What moves or is written no oftener than it must be."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from checks.fixtures import _writer
from tallymill.functions.text import parse_date
from tallymill.operators import numbering, rules, upsert
from tallymill.operators.summaries import row_bits
from tallymill.plans import approval, silver
from tallymill.sources.feed import checking_feed, credit_feed
from tallymill.sources.files import Stage, stage_files
from tallymill.sources import store as store_module
from tallymill.sources.store import Store
from test_load import CREDIT, REQUEST, card, content, fill, load, recounted, write
from test_rules import RULE, TXN, rule


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = fill(tmp_path_factory.mktemp("sized"))
    return folder, *load(spark, folder)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_facts_that_are_loaded_again_are_not_rewritten(spark, loaded, tmp_path):
    folder, first, tables = loaded
    store = first.fork(str(tmp_path / "again"))
    again = silver.load(store, stage_files(spark, str(folder / "in")))
    assert store.parts("factTransaction") == first.parts("factTransaction")
    assert content(again, drop=()) == content(tables, drop=())


def test_same_rows(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", "c"), (2, "a", "b")], "file long, x string, y string")
    assert silver.same_rows(rows, rows.filter("file = 1"), "file", ["x", "y"])
    for other in ([(1, "a", None)], [(1, "a", "c"), (1, "b", None)], [(1, "a", None), (1, "b", "c"), (1, "b", "c")], [(3, "a", "b")],
                  [(2, "b", "a")], [(2, "ab", "")]):
        assert not silver.same_rows(rows, spark.createDataFrame(other, rows.schema), "file", ["x", "y"])


def test_a_fork_lists_the_same_parts_and_goes_its_own_way(spark, loaded, tmp_path):
    _, store, tables = loaded
    fork = store.fork(str(tmp_path / "fork"))
    assert fork.parts("factTransaction") == store.parts("factTransaction") and fork.last_commit() == store.last_commit()
    change = fork.begin()
    change.alter("factTransaction", fork.table("factTransaction").limit(1).withColumn("spendingCategoryKey", F.lit(700).cast("long")).select(
        "transactionKey", "spendingCategoryKey", "categoryRuleKey", "transactionEventType", "modifiedDatetime"))
    change.commit()
    assert content(store.refresh().tables()) == content(tables) != content(fork.tables())
    assert Store(spark, str(tmp_path / "nothing")).fork(str(tmp_path / "empty")).last_commit() == 0


def test_transactions_stay_in_place_when_few_texts_win(spark):
    rows = spark.createDataFrame([(f"r{i}", "checking", None, "A", f"SHOP {i}") for i in range(20)], TXN)
    known = rules.classifying_rules(spark.createDataFrame([rule(1, "contains", "shop 12")], RULE))
    found = rules.match_rules(rows, known)
    assert "SortMergeJoin" not in plan(found)
    assert {r.sourceRowIdentifier for r in found.filter("winner IS NOT NULL").collect()} == {"r12"}


def test_written_rows_are_not_copied(spark, loaded, tmp_path, monkeypatch):
    folder, _, tables = loaded
    stage = stage_files(spark, str(folder / "in"))
    named, write = [], silver.materialise
    monkeypatch.setattr(silver, "materialise", lambda rows, what: named.append(what) or write(rows, what))
    again = silver.load(Store(spark, str(tmp_path / "written")), Stage(stage.metadata, stage.checking, stage.credit, numbered=True, written=True))
    assert not {"checking", "credit", "deduped"} & set(named) and "prepared" in named
    assert content(again) == content(tables)


def test_feeds_are_sorted_as_numbers(spark, monkeypatch):
    from tallymill.sources import feed

    sorted_columns, number = [], feed.number_rows
    monkeypatch.setattr(feed, "number_rows", lambda rows, *more, **named: sorted_columns.append(rows.columns) or number(rows, *more, **named))
    for build in (checking_feed, credit_feed):
        rows = build(spark, "/root/testdata/sf0.001")
        assert rows.filter("sourceFileHash IS NULL OR sourceRowNumber IS NULL").isEmpty()
    assert not {"sourceFileHash", "sourceFileName", "description", "amount"} & {c for names in sorted_columns for c in names}


def test_landing_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a.csv", 2, "1,5", "b"), ("a.csv", 1, None, 'q"'), (None, 1, " ", "x")], "part string, sourceRowNumber long, x string, y string")
    write = _writer(str(tmp_path), {"X x": "x", "Y": "y"})
    written = rows.groupBy("part").applyInArrow(write, "part string, n long").collect()
    assert sorted(map(tuple, written), key=str) == [("a.csv", 2), (None, 1)]
    read = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "a.csv"))
    assert read.columns == ["X x", "Y"] and [tuple(r) for r in read.collect()] == [(None, 'q"'), ("1,5", "b")]


def test_rows_are_numbered_without_columns_that_only_sort(spark, monkeypatch):
    written, write = [], numbering.materialise
    monkeypatch.setattr(numbering, "materialise", lambda rows, what: written.append(rows.columns) or write(rows, what))
    rows = spark.createDataFrame([(2, "a", "x"), (1, "b", "x"), (1, "a", "y")], "v long, w string, g string")
    numbered = numbering.number_rows(rows, ["v", "w"], ["g"], "n", ["w"])
    assert sorted(map(tuple, numbered.collect())) == [("a", 1), ("a", 2), ("b", 1)] and numbered.columns == ["w", "n"]
    assert written[0] == ["g", "w", "_slot"]


def test_feeds_are_first_written_as_bronze(spark, monkeypatch):
    named, write = [], fixtures.materialise
    monkeypatch.setattr(fixtures, "materialise", lambda rows, what: named.append(what) or write(rows, what))
    monkeypatch.setattr(fixtures, "once", lambda spark, folder, what, build: build())
    stage = fixtures.staged(spark, "/root/testdata/sf0.001")
    assert named == ["feed-files"] and stage.numbered and not stage.written


def test_texts_of_the_feeds(spark):
    from tallymill.sources import feed

    days = spark.sql("SELECT d FROM VALUES (TIMESTAMP'2020-02-29 23:59:59'), (TIMESTAMP'0001-01-02'), (TIMESTAMP'12020-03-04'), (NULL) AS t(d)")
    shown = [(r.a, r.b) for r in days.select(feed._us_date(F.col("d")).alias("a"), F.date_format("d", "MM/dd/yyyy").alias("b")).collect()]
    assert all(a == b for a, b in shown) and shown[0][0] == "02/29/2020"
    sources = spark.createDataFrame([(0,), (3,), (7,), (-1,), (None,)], "s long")
    plain = F.sha2(F.concat(F.lit("x-"), F.col("s").cast("string")), 256)
    assert all(r.a == r.b for r in sources.select(feed._file_hash("x-", F.col("s"), 4).alias("a"), plain.alias("b")).collect())


def test_dates_are_read_as_by_pattern(column):
    texts = ["01/31/2024", " 02/29/2024 ", "02/29/2023", "13/01/2024", "00/10/2024", "1/2/2024", "01/02/24",
             "01-02-2024", "01/02/2024 10:00", "01/02/2024\n", "\u0661\u0662/01/2024", "", " ", None, "x", "+1/02/2024"]
    slow = lambda c: F.to_date(F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")), F.lit("M/d/y")))
    assert column(parse_date, texts) == column(slow, texts)
    assert "rlike" in parse_date(F.col("v"))._jc.toString().lower()


def test_least_spelling_is_looked_for_among_distinct_ones(spark):
    rows = spark.createDataFrame(
        [("Shop", "SHOP"), ("SHOP", "SHOP"), ("shop", "SHOP"), ("", ""), (None, None), ("Cafe", "CAFE")],
        "transactionDescription string, transactionDescriptionClean string")
    found = silver.observed_merchants(rows)
    assert sorted(map(tuple, found.collect())) == [("CAFE", "Cafe"), ("SHOP", "SHOP")]
    assert "HashAggregate" in plan(found)


def test_names_are_not_sorted_with_row_numbers(spark):
    rows = spark.createDataFrame(
        [(1, 1, "t:a:1"), (1, 2, "t:a:2"), (1, 40_000, "t:b:40000"), (2, 1, None), (2, 2, "none"), (2, 2, "a\nb:2"), (None, 5, ":5"), (2, None, "t:b:")],
        "sourceFileKey long, sourceRowNumber long, sourceRowIdentifier string")
    bits = row_bits("factTransaction", rows)
    found = {(r.file, r.bucket): (r.n, r.lowName, r.highName, r.oddNames) for r in bits.collect()}
    assert found == {("1", 1): (2, "t:a", "t:a", 0), ("1", 2): (1, "t:b", "t:b", 0), ("2", 1): (3, "", "a\nb", 2), (None, 1): (1, "", "", 0),
                     ("2", None): (1, "t:b", "t:b", 1)}
    assert bits.columns == [f.split()[0] for f in "file string, bucket long, n long, bits binary, lowName string, highName string, oddNames long".split(", ")]
    assert "HashAggregate" in plan(bits)


def test_rows_without_a_change_do_not_move(spark, loaded, tmp_path, monkeypatch):
    """Many changes are laid over as few ones are; the rows that they can't be about meet no shuffle."""
    _, first, tables = loaded
    requests = [(1, "checking", "DEBIT_CARD", "purchase", None, "shop", "Shopping"), (2, "creditCard", "Sale", "purchase", "exact", "cafe", "Dining")]
    found, written, write = {}, {}, store_module.materialise
    monkeypatch.setattr(store_module, "materialise", lambda rows, what, keep=False: written.setdefault(what, rows.schema) and write(rows, what, keep))
    for many in (1 << 40, 1):
        monkeypatch.setattr(store_module, "MANY_CHANGES", many)
        store = first.fork(str(tmp_path / f"many{many}"))
        approval.approve_rules(store, spark.createDataFrame(requests, REQUEST)).collect()
        approved = content(store.tables(), drop=("createdDatetime", "modifiedDatetime"))
        silver.reclassify(store)
        found[many] = approved, content(store.tables(), drop=("createdDatetime", "modifiedDatetime")), recounted(store)
    assert found[1] == found[1 << 40] and found[1][0] != content(tables, drop=("createdDatetime", "modifiedDatetime"))
    rows = spark.createDataFrame([(100,), (150,), (200,), (3_276_900,), (-1,), (None,)], "transactionKey long")
    told = store_module.marked(rows, rows.filter("transactionKey IN (100, 3276900)"), "transactionKey")
    assert {r.transactionKey: r["_marked"] for r in told.collect()} == {100: True, 150: True, 200: False, 3_276_900: True, -1: False, None: False}
    assert not {"SortMergeJoin", "ShuffledHashJoin"} & set(re.findall(r"\w+", plan(told.filter(~F.col("_marked")))))


def test_bronze_of_files_loaded_again_is_not_joined(spark, loaded, tmp_path, monkeypatch):
    folder, first, tables = loaded
    merged, merge = [], silver.load_bronze
    monkeypatch.setattr(silver, "load_bronze", lambda table, *more: merged.append(table) or merge(table, *more))
    named, write = [], silver.materialise
    monkeypatch.setattr(silver, "materialise", lambda rows, what: named.append(what) or write(rows, what))
    store = first.fork(str(tmp_path / "renewed"))
    again = silver.load(store, stage_files(spark, str(folder / "in")))
    assert not merged and not {"checking", "credit", "rows"} & set(named)
    drop = ("modifiedDatetime",)
    assert content(again, drop=drop) == content(tables, drop=drop)
    moved = lambda rows: rows.agg(F.min("modifiedDatetime").alias("m")).first().m
    assert all(moved(again[t]) > moved(tables[t]) for t in ("rawChaseCheckingTransaction", "rawChaseCreditTransaction"))
    # A file with a row less, or a number that is not one of n, is merged row by row.
    stage = stage_files(spark, str(folder / "in"))
    for odd in (stage.checking.filter("sourceRowNumber > 1"), stage.checking.withColumn("sourceRowNumber", F.col("sourceRowNumber") + 1)):
        merged.clear()
        silver.load(first.fork(str(tmp_path / f"odd{odd.count()}")), Stage(stage.metadata, odd, stage.credit, numbered=True))
        assert "rawChaseCheckingTransaction" in merged


def test_only_narrow_facts_are_gathered(spark, loaded, tmp_path, monkeypatch):
    """Lookups that fit everywhere come after facts are gathered by month; others before, with the same facts."""
    folder, _, tables = loaded
    moved, append = [], store_module.Change.append
    monkeypatch.setattr(store_module.Change, "append", lambda self, table, df, *more: moved.append((table, df.columns)) or append(self, table, df, *more))
    for fits in (True, False):
        monkeypatch.setattr(silver, "fits_everywhere", lambda *dims: fits)
        again = silver.load(Store(spark, str(tmp_path / f"fits{fits}")), stage_files(spark, str(folder / "in")))
        assert content(again) == content(tables)
    narrow, wide = [set(names) for table, names in moved if table == "factTransaction"]
    assert not {"sourceFileHash", "merchantKey", "spendingCategoryKey", "sourceRowNumber"} & narrow and "merchantKey" in wide


def test_whole_landing_files_do_not_move(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fixtures, "CHUNK", 3)
    written = []
    split = fixtures._whole_files(lambda rows: written.append((rows["part"][0].as_py(), rows["sourceRowNumber"].to_pylist())))
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"part": p, "sourceRowNumber": n} for p, n in rows], pa.schema([("part", pa.string()), ("sourceRowNumber", pa.int64())]))
    batches = [batch(("a", 2), ("a", 3), ("b", 4)), batch(("b", 5), ("b", 6), ("c", 7), ("c", 9), ("c", 8)), batch(), batch(("d", 10), ("d", 11), ("d", 12), ("d", 12), (None, 1), (None, 2), (None, 3), ("e", 13))]
    left = [(r["part"], r["sourceRowNumber"]) for b in split(batches) for r in b.to_pylist()]
    assert written == [("b", [4, 5, 6])]
    assert left == [("a", 2), ("a", 3), ("c", 7), ("c", 9), ("c", 8), ("d", 10), ("d", 11), ("d", 12), ("d", 12), (None, 1), (None, 2), (None, 3), ("e", 13)]


def test_merge_moves_keys_alone_to_find_new_rows(spark, monkeypatch):
    written, write = [], upsert.materialise
    monkeypatch.setattr(upsert, "materialise", lambda rows, what: written.append(rows.columns) or write(rows, what))
    ddl = silver.schemas.TABLES["rawChaseCreditTransaction"]
    row = lambda **values: tuple(values.get(f.split()[0]) for f in ddl.split(", "))
    old = spark.createDataFrame([row(recordKey=100, sourceFileHash="a", sourceRowNumber=1, memo="old")], ddl)
    new = spark.createDataFrame([("a", 1, "new"), ("a", 2, "more"), (None, 1, "none"), ("b", None, "none")], "sourceFileHash string, sourceRowNumber long, memo string")
    merged = upsert.merge_upsert("rawChaseCreditTransaction", old, new, ["sourceFileHash", "sourceRowNumber"], ["memo"])
    assert sorted(r.memo for r in merged.collect()) == ["more", "new", "none", "none"]
    assert sorted(r.recordKey for r in merged.collect()) == [100, 200, 300, 400]
    assert ["sourceFileHash", "sourceRowNumber"] in written


def test_a_micro_batch_notes_its_files_without_a_job(spark, tmp_path):
    from tallymill.streaming.drain import drain

    write(tmp_path / "in" / "Chase4444.csv", f"{CREDIT}\n" + card(amount="x"))
    with pytest.raises(Exception, match="not an amount"):
        drain(Store(spark, str(tmp_path / "store")), str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
    notes = [f for f in (tmp_path / "ck" / "noted").rglob("*") if f.is_file() and not f.name.startswith(".")]
    assert [f.name for f in notes] == ["paths.parquet"]
    assert [r.path.rsplit("/", 1)[1] for r in spark.read.schema("path string").parquet(str(tmp_path / "ck" / "noted")).collect()] == ["Chase4444.csv"]
