from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.operators import constraints
from tallymill.operators.summaries import BITS_OF, SUMMARIES, names_are_distinct, repeated_numbers, row_bits
from tallymill.plans import approval, gold, quality, silver
from tallymill.sources.files import Stage, stage_files
from tallymill.sources.literals import literal_rows
from tallymill.sources.store import Store, materialise
from tallymill.streaming.drain import drain
from test_files import CHECKING, CREDIT, write


def row(details="DEBIT", date="01/05/2026", description="Shop", amount="-1.00", kind="DEBIT_CARD"):
    return f'{details},{date},"{description}","{amount}",{kind},,\n'


def card(date="01/05/2026", description="Cafe", category="Gas", kind="Sale", amount="-2.00"):
    return f'{date},{date},"{description}",{category},{kind},"{amount}",\n'


def fill(folder):
    write(folder / "in" / "Chase1111.csv", f"{CHECKING}\n" + row(description="EPAY web") + row(description="  shop  one ")
          + row(date="13/01/2026", description="SHOP ONE") + row(description="   ", kind=" ") + row(kind="ACH_CREDIT", amount="$5.00"))
    write(folder / "in" / "Chase2222.csv", f"{CREDIT}\n" + card() + card(kind="Return", category="", amount="2.00") + card(category="Odd"))
    return folder


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """One load that several tests read; none of them writes to it."""
    folder = fill(tmp_path_factory.mktemp("loaded"))
    return folder, *load(spark, folder)


def copy_of(store, path):
    copy = Store(store.spark, str(path))
    change = copy.begin()
    for name in schemas.TABLES:
        change.put(name, store.table(name))
    change.commit()
    return copy


def load(spark, tmp_path, name="store", **options):
    store = Store(spark, str(tmp_path / name))
    return store, silver.load(store, stage_files(spark, str(tmp_path / "in")), **options)


def facts(tables):
    names = tables["dimSpendingCategory"].select("spendingCategoryKey", "spendingCategoryName")
    merchants = tables["dimMerchant"].select("merchantKey", "merchantDisplayName")
    rows = tables["factTransaction"].join(names, "spendingCategoryKey").join(merchants, "merchantKey").collect()
    return {(r.sourceRowIdentifier.split(":")[0], r.sourceRowNumber): r for r in rows}


def listed(rows):
    return sorted(map(str, rows.select(sorted(rows.columns)).collect()))


def content(tables, drop=("createdDatetime", "modifiedDatetime")):
    return listed(tables["factTransaction"].drop(*drop))


def test_edge_rows(loaded):
    tables = loaded[2]
    found = facts(tables)
    checking = lambda n: found[("chaseCheckingCsv", n)]
    assert (checking(1).spendingCategoryName, checking(1).transactionEventType) == ("DebtPayment", "debtPayment")
    # The display name is the lowest spelling of the two.
    assert checking(2).merchantKey == checking(3).merchantKey and checking(2).merchantDisplayName == "SHOP ONE"
    assert checking(3).transactionDateKey == 19000101 and checking(3).postedDateKey == 19000101
    assert (checking(4).merchantKey, checking(4).transactionType, checking(4).transactionEventType) == (-1, "unknown", "other")
    assert (checking(5).spendingCategoryName, str(checking(5).transactionAmount)) == ("Income", "5.00")
    cards = [found[("chaseCreditCsv", n)] for n in (1, 2, 3)]
    assert [c.spendingCategoryName for c in cards] == ["Gas", "Refund", "Uncategorized"]
    for table in schemas.TABLES:
        bad = constraints.check_constraints(tables[table], table).filter("violationCount > 0").collect()
        assert not bad, bad
    assert constraints.check_foreign_keys(tables).filter("violationCount > 0").isEmpty()


def test_life_of_a_store(spark, tmp_path):
    """Load, load again, load a new file, fail on a bad one, rebuild from one file."""
    fill(tmp_path)
    store, first = load(spark, tmp_path)
    before = {r.transactionKey: r.modifiedDatetime for r in first["factTransaction"].collect()}
    _, second = load(spark, tmp_path)
    assert {r.transactionKey: r.modifiedDatetime for r in second["factTransaction"].collect()} == before

    parts = store.refresh().parts("factTransaction")
    write(tmp_path / "in" / "Chase3333.csv", f"{CREDIT}\n" + card(description="New place"))
    silver.load(store, stage_files(spark, str(tmp_path / "in"), known_hashes=store.table("dimSourceFile")))
    # The rows of known files were not rewritten.
    now = store.parts("factTransaction")
    assert set(parts.items()) < set(now.items()) and len(now) == len(parts) + 1
    assert sorted(r.transactionKey for r in store.table("factTransaction").collect()) == [100 * i for i in range(1, 10)]
    assert sorted(r.recordKey for r in store.table("rawChaseCreditTransaction").collect()) == [100, 200, 300, 400]

    write(tmp_path / "in" / "Chase4444.csv", f"{CREDIT}\n" + card(amount="--5"))
    stage = stage_files(spark, str(tmp_path / "in"))
    with pytest.raises(PySparkException):
        silver.load(store, stage)
    assert store.refresh().table("factTransaction").count() == 9
    assert store.table("rawChaseCreditTransaction").count() == 4
    good, bad = silver.quarantine(silver.unify_sources(stage.checking, stage.credit))
    assert (good.count(), [r.amountText for r in bad.collect()]) == (9, ["--5"])

    only = stage_files(spark, [str(tmp_path / "in" / "Chase2222.csv")])
    tables = silver.load(store, only, fresh=True)
    assert tables["factTransaction"].count() == 3 and tables["rawChaseCheckingTransaction"].count() == 0
    assert store.table("factTransaction").count() == 3 and store.table("dimSourceFile").count() == 2


def test_changed_classification_updates_only_those_facts(spark, loaded, tmp_path):
    tables = loaded[2]
    store = copy_of(loaded[1], tmp_path / "copy")
    change = store.begin()
    ddl = schemas.TABLES["mapCategoryRule"]
    now = [None, None]
    extra = literal_rows(spark, [(90000, "Mine", None, None, None, "contains", "cafe", 100, "fee", "manual", 120, True, *now)], ddl)
    extra = extra.withColumns({c: F.current_timestamp() for c in ("createdDatetime", "modifiedDatetime")})
    change.put("mapCategoryRule", store.table("mapCategoryRule").unionByName(extra))
    change.commit()
    before = {r.transactionKey: r for r in tables["factTransaction"].collect()}
    after = {r.transactionKey: r for r in silver.reclassify(store)["factTransaction"].collect()}
    assert set(before) == set(after)
    for key, old in before.items():
        cafe = old.transactionDescriptionClean == "CAFE"
        assert (after[key].modifiedDatetime > old.modifiedDatetime) == cafe
        assert (after[key].transactionEventType == "fee") == cafe or old.transactionEventType == "fee"


def test_uncommitted_parts_stay_invisible(spark, loaded, tmp_path):
    tables = loaded[2]
    store = copy_of(loaded[1], tmp_path / "copy")
    change = store.begin()
    change.put("dimMerchant", tables["dimMerchant"].filter("false"))
    assert Store(spark, store.root).table("dimMerchant").count() == tables["dimMerchant"].count()
    change.commit()
    assert Store(spark, store.root).table("dimMerchant").count() == 0


def test_input_order_and_doubled_rows_do_not_matter(spark, loaded, tmp_path):
    folder, _, first = loaded
    stage = stage_files(spark, str(folder / "in"))
    shuffled = Stage(stage.metadata, stage.checking.unionByName(stage.checking).repartition(5, "amount"), stage.credit.orderBy(F.desc("sourceRowNumber")))
    second = silver.load(Store(spark, str(tmp_path / "other")), shuffled)
    assert content(first) == content(second)


def test_stream_equals_batch_and_is_safe_to_repeat(spark, loaded, tmp_path):
    batch, landing = loaded[2], fill(tmp_path)
    store = Store(spark, str(landing / "streamed"))
    drain(store, str(landing / "in"), str(landing / "ck1"), files_per_batch=1).awaitTermination()
    streamed = {name: store.table(name) for name in schemas.TABLES}
    keys = [c for c in schemas.columns("factTransaction") if c.endswith("Key") and c not in ("transactionDateKey", "postedDateKey", "transactionNaturalKey")]
    drop = (*keys, "createdDatetime", "modifiedDatetime")
    assert content(streamed, drop) == content(batch, drop)
    # A second stream without memory of the first hands over the same files; nothing is loaded twice.
    drain(store, str(landing / "in"), str(landing / "ck2"), files_per_batch=5).awaitTermination()
    assert store.refresh().table("factTransaction").count() == 8
    write(landing / "in" / "late" / "Chase5555.csv", f"{CREDIT}\n" + card(description="Late"))
    drain(store, str(landing / "in"), str(landing / "ck2"), files_per_batch=5).awaitTermination()
    assert store.refresh().table("factTransaction").count() == 9


def test_small_batches_are_loaded_together(spark, loaded, tmp_path):
    landing = fill(tmp_path)
    for k in range(3):
        write(landing / "in" / f"Chase{k}333.csv", f"{CREDIT}\n" + card(description=f"Shop {k}"))
    store = Store(spark, str(landing / "streamed"))
    running = drain(store, str(landing / "in"), str(landing / "ck"), files_per_batch=1)
    running.awaitTermination()
    assert not running.isActive and len(running.recentProgress) >= 5
    assert store.refresh().last_commit() == 1 and store.table("factTransaction").count() == 11
    several = Store(spark, str(landing / "several"))
    drain(several, str(landing / "in"), str(landing / "ck2"), files_per_batch=1, files_per_load=2).awaitTermination()
    assert several.refresh().last_commit() == 3 and several.table("factTransaction").count() == 11


def test_files_of_a_failed_load_are_left_to_the_next_drain(spark, tmp_path):
    landing = fill(tmp_path)
    write(landing / "in" / "Chase4444.csv", f"{CREDIT}\n" + card(amount="x"))
    store = Store(spark, str(landing / "streamed"))
    with pytest.raises(Exception, match="not an amount"):
        drain(store, str(landing / "in"), str(landing / "ck")).awaitTermination()
    assert store.refresh().last_commit() == 0
    write(landing / "in" / "Chase4444.csv", f"{CREDIT}\n" + card(description="Mended"))
    drain(store, str(landing / "in"), str(landing / "ck")).awaitTermination()
    assert store.refresh().table("factTransaction").count() == 9


# ---- approval ----------------------------------------------------------------------------------------------------

REQUEST = (
    "requestOrder long, sourceAccountType string, transactionType string, transactionEventType string, "
    "descriptionMatchType string, descriptionMatchText string, spendingCategoryName string"
)


def test_approval(spark, loaded, tmp_path):
    _, store, tables = loaded
    before = facts(tables)
    requests = spark.createDataFrame([
        (1, "checking", "DEBIT_CARD", "purchase", None, "shop", "Uncategorized"),
        (2, "checking", "DEBIT_CARD", "purchase", "contains", "one shop", "Shopping"),
        (3, "checking", "DEBIT_CARD", "purchase", "contains", "one", "Gas"),
        (4, "creditCard", "Sale", "purchase", "exact", "cafe", "Dining"),
        (5, "creditCard", "Sale", "refund", "exact", "cafe", "Dining"),
        (6, "checking", "DEBIT_CARD", "purchase", "prefix", "one", "Gas"),
        (7, "checking", "DEBIT_CARD", "purchase", "contains", "#!", "Gas"),
        (8, "checking", "DEBIT_CARD", "purchase", "contains", "one", "Yachts"),
        (9, "creditCard", "Sale", "purchase", "exact", " CAFE!", "Dining"),
    ], REQUEST)
    for order in ("requestOrder", "-requestOrder"):
        copy = copy_of(store, tmp_path / f"copy{order}")
        parts = copy.parts("factTransaction")
        result = {r.requestOrder: r for r in approval.approve_rules(copy, requests.orderBy(F.expr(order))).collect()}
        assert copy.parts("factTransaction") == parts and len(copy.parts("factTransaction.changes")) == 1
        assert {n: r.updatedTransactionCount for n, r in result.items()} == {1: 2, 2: 2, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0}
        assert {n: r.rejectReason for n, r in result.items() if r.rejectReason} == {
            6: "match type", 7: "blank match text", 8: "unknown or inactive category",
        }
        assert result[4].ruleName == result[9].ruleName
        after = facts({name: copy.table(name) for name in schemas.TABLES})
        changed = {k: r.spendingCategoryName for k, r in after.items() if r.spendingCategoryName != before[k].spendingCategoryName}
        assert changed == {("chaseCheckingCsv", 2): "Shopping", ("chaseCheckingCsv", 3): "Shopping", ("chaseCreditCsv", 3): "Dining"}
        assert all(after[k].transactionEventType == before[k].transactionEventType for k in before)
        manual = copy.table("mapCategoryRule").filter("categoryAssignmentSource = 'manual'").orderBy("categoryRuleKey").collect()
        assert len(manual) == 5 and {r.rulePriority for r in manual} == {120}
        assert manual[0].descriptionMatchText == "SHOP"
        # Rows that are rewritten take their changes in: the table stays as it is, and the change files go.
        change = copy.begin()
        change.replace("factTransaction", list(parts), copy.table("factTransaction"))
        change.commit()
        assert facts({name: copy.table(name) for name in schemas.TABLES}) == after and not copy.parts("factTransaction.changes")


def test_approval_of_one_letter_text_searches_the_whole_text(spark, loaded, tmp_path):
    store = copy_of(loaded[1], tmp_path / "copy")
    request = spark.createDataFrame([(1, "checking", "DEBIT_CARD", "purchase", "contains", "S", "Shopping")], REQUEST)
    answer = approval.approve_rules(store, request).first()
    assert answer.updatedTransactionCount == 2
    stored = {r.ruleName: r.categoryRuleKey for r in store.table("mapCategoryRule").collect()}
    assert answer.categoryRuleKey == stored[answer.ruleName]
    with pytest.raises(ValueError, match="distinct"):
        approval.approve_rules(store, request.unionByName(request))
    # At the next load such a rule matches nothing, and the default outcome returns.
    tables = silver.reclassify(store)
    assert {r.spendingCategoryName for r in facts(tables).values()} & {"Shopping"} == set()


# ---- quality -------------------------------------------------------------------------------------------------------


def failing(tables, fact=None, **changes):
    broken = {**tables, **changes}
    if fact is not None:
        broken["factTransaction"] = fact
    views = {name: view(broken) for name, view in gold.VIEWS.items()}
    return {r.checkName: r.failedRowCount for r in quality.integrity_report(broken, views).collect()}


def test_each_check_fires_on_its_fault(spark, tmp_path):
    write(tmp_path / "in" / "Chase1111.csv", f"{CHECKING}\n" + row() + row(description="Other", amount="-3"))
    write(tmp_path / "in" / "Chase2222.csv", f"{CREDIT}\n" + card() + card(kind="Return", amount="1"))
    _, tables = load(spark, tmp_path)
    fact = materialise(tables["factTransaction"], "fact")
    assert failing(tables) == {}
    n = lambda i: quality.CHECKS[i - 1]
    first = F.col("transactionKey") == 100
    set_first = lambda name, value: fact.withColumn(name, F.when(first, value).otherwise(F.col(name)))
    bronze = tables["rawChaseCheckingTransaction"]
    assert failing(tables, rawChaseCheckingTransaction=bronze.unionByName(bronze.limit(1))) == {n(1): 1, n(3): 1}
    assert failing(tables, fact=fact.unionByName(fact.filter(first))) == {n(1): 1, n(5): 1, n(6): 1}
    assert failing(tables, fact=set_first("transactionType", F.lit(None))) == {n(7): 1}
    assert failing(tables, fact=set_first("sourceFileKey", F.lit(-1).cast("long"))) == {n(8): 1}
    assert failing(tables, fact=set_first("merchantRuleKey", F.lit(5).cast("long"))) == {n(9): 1}
    assert failing(tables, fact=set_first("transactionAmount", F.abs("transactionAmount"))) == {n(10): 1}
    assert n(11) in failing(tables, fact=set_first("transactionEventType", F.lit("gift")))
    lost = failing(tables, fact=set_first("merchantKey", F.lit(7).cast("long")))
    assert lost == {n(2): 1, n(9): 1}
    # A missing account row drops facts from spending and cashflow.
    fewer = tables["dimFinancialAccount"].filter("accountType <> 'checking'")
    assert set(failing(tables, dimFinancialAccount=fewer)) == {n(2), n(9), n(12), n(13)}


def test_privacy(spark, tmp_path):
    write(tmp_path / "in" / "Chase1111.csv", f"{CHECKING}\n" + row(description="Secret  shop"))
    _, tables = load(spark, tmp_path)
    views = {name: view(tables) for name, view in gold.VIEWS.items()}
    assert quality.blocked_columns(views).isEmpty()
    renamed = {"vw": views["vw_MonthlyCashflow"].withColumnRenamed("yearMonth", "SourceFILEName")}
    assert [tuple(r) for r in quality.blocked_columns(renamed).collect()] == [("vw", "SourceFILEName", "sourceFile")]
    assert [tuple(r) for r in quality.leaked_values(views["vw_TransactionLedger"], tables).collect()] == [("merchantDisplayName", 1)]


def test_views_and_registration(spark, loaded):
    _, store, tables = loaded
    store.register()
    gold.register_views(tables)
    assert spark.sql("SELECT count(*) FROM silver_factTransaction").first()[0] == 8
    assert spark.sql("SELECT count(*) FROM gold_vw_TransactionLedger").first()[0] == 8


def test_a_date_window_reads_few_files_and_parts_are_compacted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    names = schemas.columns("factTransaction")
    ddl = {f.name: f.dataType for f in schemas.struct(schemas.TABLES["factTransaction"])}
    key = F.col("id")
    month = (key % 12 + 1).cast("long")

    def rows(start):
        filled = {"transactionKey": key, "transactionDateKey": 20260000 + month * 100 + key % 28 + 1}
        return spark.range(start, start + 6000).select(*[filled.get(n, F.lit(None)).cast(ddl[n]).alias(n) for n in names])

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        for start in (0, 6000, 12000):
            change = store.begin()
            change.append("factTransaction", rows(start))
            change.commit()
        assert len(store.parts("factTransaction")) == 3
        assert store.row_count("factTransaction") == 18000
        assert store.compact(fan=4) == {} and store.compact(fan=3, full_rows=6000) == {} and store.compact(fan=3) == {"factTransaction": 18000}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    fact = store.table("factTransaction")
    assert len(store.parts("factTransaction")) == 1 and fact.count() == 18000 and fact.select("transactionKey").distinct().count() == 18000
    file = F.input_file_name()
    everything = fact.select(file.alias("f")).distinct().count()
    window = fact.filter(F.col("transactionDateKey").between(20260301, 20260331)).select(file.alias("f")).distinct().count()
    assert everything > 4 and window <= everything / 2


def test_rows_are_rewritten_once_per_tier(spark, tmp_path):
    """Of 32 loads each row is written at most log(32) times again, and the largest parts stay."""
    store, rewritten, most = Store(spark, str(tmp_path / "store")), 0, 0
    rows = spark.range(20).select(*[
        (F.col("id") if f.name == "merchantKey" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.struct(schemas.TABLES["dimMerchant"])])
    for load in range(32):
        change = store.begin()
        change.append("dimMerchant", rows.withColumn("merchantKey", F.col("merchantKey") + 100 * load))
        change.commit()
        rewritten += sum(store.compact(fan=4, full_rows=320).values())
        most = max(most, len(store.parts("dimMerchant")))
    while more := store.compact(fan=4, full_rows=320):
        rewritten += sum(more.values())
    assert store.row_count("dimMerchant") == 640 == store.table("dimMerchant").select("merchantKey").distinct().count()
    assert sorted(store.sizes("dimMerchant").values()) == [320, 320] and most <= 8
    assert rewritten == 640 * 2


def test_change_files(spark, tmp_path):
    """The newest change counts, is merged and folded, and counts again after its row was rewritten."""
    store, names = Store(spark, str(tmp_path / "store")), schemas.columns("factTransaction")
    ddl = {f.name: f.dataType for f in schemas.struct(schemas.TABLES["factTransaction"])}

    def alter(keys, category):
        change = store.begin()
        change.alter("factTransaction", spark.createDataFrame([(k,) for k in keys], "transactionKey long").selectExpr(
            "transactionKey", f"{category}L AS spendingCategoryKey", "1L AS categoryRuleKey", "'fee' AS transactionEventType", "current_timestamp() AS modifiedDatetime"))
        change.commit()

    def categories():
        return {r.transactionKey: r.spendingCategoryKey for r in Store(spark, store.root).table("factTransaction").collect()}

    want = {}
    for part in range(3):
        change = store.begin()
        filled = {"transactionKey": F.col("id"), "spendingCategoryKey": F.lit(0), "sourceFileKey": F.lit(part)}
        change.append("factTransaction", spark.range(100 * part, 100 * part + 100).select(*[filled.get(n, F.lit(None)).cast(ddl[n]).alias(n) for n in names]))
        change.commit()
        want |= dict.fromkeys(range(100 * part, 100 * part + 100), 0)
    parts = store.parts("factTransaction")
    for keys, category in (([1, 2, 150], 7), ([2, 250], 8), ([2], 9)):
        alter(keys, category)
        want |= dict.fromkeys(keys, category)
    assert categories() == want and store.parts("factTransaction") == parts and len(store.parts("factTransaction.changes")) == 3
    assert store.table("factTransaction", parts=[p for p in parts][:1]).filter("spendingCategoryKey > 0").count() == 2
    # Three files of one size become one; nothing else is rewritten.
    assert set(store.compact(fan=3, full_rows=1)) <= {"factTransaction.changes"} and categories() == want
    # A rewritten part takes its changes in, the others keep theirs.
    first = store.parts_with("factTransaction", "transactionKey", spark.range(1, 2).withColumnRenamed("id", "transactionKey"))
    change = store.begin()
    change.replace("factTransaction", first, store.table("factTransaction", parts=first).withColumn(
        "spendingCategoryKey", F.when(F.col("transactionKey") == 2, 5).otherwise(F.col("spendingCategoryKey")).cast("long")))
    assert {r.transactionKey: r.spendingCategoryKey for r in change.table("factTransaction").collect()} == want | {2: 5}
    change.commit()
    want[2] = 5
    assert categories() == want and store.changes("factTransaction").count() == 2
    alter([2], 6)
    want[2] = 6
    assert categories() == want
    # Beyond the share, changes are folded into the parts that they are about.
    untouched = store.parts("factTransaction")
    assert store.compact(fan=50, fold_share=0.001) == {"factTransaction": 300} or len(untouched) == 3
    assert categories() == want and store.changes("factTransaction") is None and store.row_count("factTransaction") == 300


def recounted(store, reports=False):
    """What the store keeps about its rows, which must be what a count of them gives."""
    kept = Store(store.spark, store.root).tables()
    fact = kept["factTransaction"]
    for name, summary in SUMMARIES.items():
        assert listed(kept.sums[name]) == listed(summary.of(fact)), name
    for table in BITS_OF:
        assert kept.counts[table] == kept[table].count()
        merged = lambda bits: {(r.file, r.bucket, r.n, bytes(r.bits)) for r in bits.groupBy("file", "bucket").agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits")).collect()}
        assert merged(kept.bits[table]) == merged(row_bits(table, kept[table]))
    if reports:
        plain = dict(kept)
        for name, view in gold.VIEWS.items():
            if name != "vw_TransactionLedger":
                assert listed(view(kept)) == listed(view(plain)), name
        made = [[tuple(r) for r in report(t, {n: v(t) for n, v in gold.VIEWS.items()}).collect()]
                for t in (kept, plain) for report in (quality.integrity_report, quality.trust_report, quality.row_counts)]
        assert made[:3] == made[3:]
    return {name: sorted(map(str, kept.sums[name].collect())) for name in SUMMARIES}


def test_summaries_follow_every_change(spark, loaded, tmp_path):
    folder, store, _ = loaded
    store = copy_of(store, tmp_path / "copy")
    states = [recounted(store)]
    write(tmp_path / "more" / "Chase7777.csv", f"{CHECKING}\n" + row(description="Capital One pmt", amount="-9") + row(description="One shop", amount="-5"))
    silver.load(store, stage_files(spark, str(tmp_path / "more")))
    states.append(recounted(store))
    requests = [(1, "checking", "DEBIT_CARD", "purchase", None, "shop", "Shopping"), (2, "creditCard", "Sale", "purchase", "exact", "cafe", "Dining")]
    approval.approve_rules(store, spark.createDataFrame(requests, REQUEST)).collect()
    states.append(recounted(store))
    approval.approve_rules(store, spark.createDataFrame([(1, "checking", "DEBIT_CARD", "purchase", None, "capital", "Gas")], REQUEST)).collect()
    states.append(recounted(store))
    # Files loaded again are merged: the rules apply to all their rows, and one part takes its changes in.
    silver.load(store, stage_files(spark, str(tmp_path / "more")))
    states.append(recounted(store))
    silver.reclassify(store)
    states.append(recounted(store, reports=True))
    before = store.refresh().table("factTransaction").count()
    assert store.compact(fan=2, fold_share=0) and store.changes("factTransaction") is None
    assert recounted(store) == states[-1] and store.table("factTransaction").count() == before
    assert len({str(s) for s in states}) >= 4
    # A kept bitmap tells of doubled rows, and only their files are looked into.
    failed = lambda tables: {r.checkName: r.failedRowCount for r in quality.all_checks(tables, {n: v(tables) for n, v in gold.VIEWS.items()}).collect() if r.failedRowCount}
    known = failed(store.tables())
    change = store.begin()
    change.append("factTransaction", store.table("factTransaction").filter("transactionKey = 100").withColumn("transactionKey", F.lit(999_999).cast("long")))
    change.commit()
    assert failed(store.tables()) == known | {quality.CHECKS[0]: 1, quality.CHECKS[4]: 1, quality.CHECKS[5]: 1}


def test_names_shared_by_files_are_found(spark):
    rows = lambda *names: spark.createDataFrame([(f, n, name) for f, n, name in names], "sourceFileKey long, sourceRowNumber long, sourceRowIdentifier string")
    bits = lambda *names: row_bits("factTransaction", rows(*names))
    assert names_are_distinct(bits((1, 1, "t:a:1"), (1, 2, "t:a:2"), (2, 1, "t:b:1")))
    for bad in ([(1, 1, "t:a:1"), (2, 1, "t:a:1")], [(1, 1, "t:a:2")], [(1, 1, None)], [(1, 1, "t:a:1"), (1, 2, "t:b:2")]):
        assert not names_are_distinct(bits(*bad))
    assert [r.file for r in repeated_numbers(bits((1, 7, "t:a:7"), (1, 7, "t:a:7"), (2, 40_000, "t:b:40000"))).collect()] == ["1"]


def test_commit_log_faults_and_second_writers(spark, tmp_path):
    from pyspark.errors import AnalysisException

    root = str(tmp_path / "store")
    first, second = Store(spark, root), Store(spark, root)
    one, two = first.begin(), second.begin()
    rows = first.table("dimSpendingCategory")
    one.put("dimSpendingCategory", rows)
    two.put("dimSpendingCategory", rows.limit(1))
    assert one.commit() == 1
    with pytest.raises(RuntimeError, match="another writer"):
        two.commit()
    assert Store(spark, root).table("dimSpendingCategory").count() == rows.count()
    # A log that is there but can't be read is no empty store.
    broken = tmp_path / "broken" / "commits"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("no parquet at all")
    with pytest.raises(Exception) as problem:
        Store(spark, str(tmp_path / "broken")).parts("dimMerchant")
    assert not (isinstance(problem.value, AnalysisException) and problem.value.getCondition() == "PATH_NOT_FOUND")


def test_intermediate_results_go(spark, tmp_path, monkeypatch):
    from tallymill.sources import store as module

    monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path / "shared"))
    fill(tmp_path)
    stage = stage_files(spark, str(tmp_path / "in"))
    there = lambda: {p.name for p in (tmp_path / "shared").iterdir()}
    before, store = there(), Store(spark, str(tmp_path / "store"))
    tables = silver.load(store, stage)
    silver.reclassify(store)
    assert there() == before and tables["factTransaction"].count() == 8
    answer = approval.approve_rules(store, spark.createDataFrame([(1, "checking", "DEBIT_CARD", "purchase", None, "shop", "Gas")], REQUEST))
    assert len(there() - before) == 1 and answer.first().updatedTransactionCount == 2
    with module.temporary(spark):
        silver.load(store, stage)
        assert len(there() - before) == 2
    assert len(there() - before) == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tallymill.sources.store import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda name, default=None: folder),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert shared_folder(session("spark://host:7077", "hdfs:///tmp/x/")) == "hdfs:///tmp/x"
    assert shared_folder(session("local[8]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
