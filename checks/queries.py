"""One entry per operator: the Spark query and the SQL with the same result."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallymill import schemas
from tallymill.functions import classify, display, text
from tallymill.functions.calendar import calendar_columns
from tallymill.operators import aggregates, constraints, joins, numbering, rules, upsert
from tallymill.plans import approval, dashboard, gold, ledger, quality, silver, suggestions
from tallymill.sources import export, files, seeds
from tallymill.sources.literals import literal_rows
from tallymill.sources.store import Store, materialise, shared_folder
from tallymill.streaming.drain import drain

from . import prefix as sql
from .fixtures import CHUNK, landed_layers, landed_stage, landing, layers, new_store, part_name, prepared, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AMENDED = dt.datetime(2000, 1, 1)


def out(df: DataFrame) -> DataFrame:
    """Amounts as double, whole numbers as bigint, so that both engines return the same types."""
    def typed(field):
        kind = field.dataType.simpleString()
        if kind.startswith("decimal"):
            return F.col(field.name).cast("double").alias(field.name)
        return F.col(field.name).cast("long").alias(field.name) if kind in ("int", "smallint") else F.col(field.name)
    return df.select(*[typed(f) for f in df.schema.fields])


def query(name: str, oracle: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: out(build(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return build
    return add


def pick(names: str, money: str = "", count: str = "") -> str:
    return ", ".join(
        names.split() + [f"{m}::DOUBLE AS {m}" for m in money.split()] + [f"{c}::BIGINT AS {c}" for c in count.split()]
    )


# ---- sources and sinks -------------------------------------------------------------------------------------------

_part = "replace(sourceFileName, '_Activity', '_Activity_p' || lpad(((sourceRowNumber - 1) // %d)::VARCHAR, 5, '0'))" % CHUNK
_place = f"(sourceRowNumber - 1) % {CHUNK} + 1"


@query("src01_discover_files", sql.feed(f"""
SELECT DISTINCT {_part} AS fileName FROM feed_checking UNION SELECT DISTINCT {_part} FROM feed_credit"""))
def _(spark, sf):
    found = files.discover_files(spark, landing(spark, sf))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("fileName"))


@query("src02_classify_files", sql.feed(f"""
SELECT sourceFileType, count(DISTINCT part) AS fileCount
FROM (SELECT sourceFileType, {_part} AS part FROM feed_checking UNION ALL SELECT sourceFileType, {_part} FROM feed_credit)
GROUP BY 1"""))
def _(spark, sf):
    found = files.classify_files(files.file_contents(spark, landing(spark, sf)))
    return found.groupBy("sourceFileType").agg(F.count("*").alias("fileCount"))


@query("src03_file_metadata", sql.feed(f"""
SELECT {_part} AS sourceFileName, sourceFileType, count(*) AS rowCount, 64::BIGINT AS hashLength
FROM (SELECT sourceFileName, sourceFileType, sourceRowNumber FROM feed_checking
      UNION ALL SELECT sourceFileName, sourceFileType, sourceRowNumber FROM feed_credit)
GROUP BY 1, 2"""))
def _(spark, sf):
    meta = landed_stage(spark, sf).metadata
    return meta.select("sourceFileName", "sourceFileType", "rowCount", F.length("sourceFileHash").alias("hashLength"))


@query("src04_file_account", sql.feed(f"""
SELECT DISTINCT {_part} AS sourceFileName,
       CASE sourceFileType WHEN 'chaseCheckingCsv' THEN 'checking' ELSE 'creditCard' END AS accountType,
       substr(sourceFileName, 6, 4) AS accountLastFour
FROM (SELECT sourceFileName, sourceFileType, sourceRowNumber FROM feed_checking
      UNION ALL SELECT sourceFileName, sourceFileType, sourceRowNumber FROM feed_credit)"""))
def _(spark, sf):
    return landed_stage(spark, sf).metadata.select("sourceFileName", "accountType", "accountLastFour")


@query("src05_src07_src08_read_checking", sql.feed(f"""
SELECT {_part} AS sourceFileName, sourceFileType, {_place} AS sourceRowNumber, {", ".join(schemas.CHECKING_COLUMNS)}
FROM feed_checking"""))
def _(spark, sf):
    return landed_stage(spark, sf).checking.drop("sourceFileHash")


@query("src06_src07_src08_read_credit", sql.feed(f"""
SELECT {_part} AS sourceFileName, sourceFileType, {_place} AS sourceRowNumber, {", ".join(schemas.CREDIT_COLUMNS)}
FROM feed_credit"""))
def _(spark, sf):
    return landed_stage(spark, sf).credit.drop("sourceFileHash")


@query("src09_seed_usage", sql.gold("""
SELECT d.* REPLACE (d.spendingCategoryKey::BIGINT AS spendingCategoryKey), count(l.transactionKey) AS transactionCount
FROM dim_category d LEFT JOIN ledger l ON l.spendingCategoryName = d.spendingCategoryName GROUP BY ALL"""))
def _(spark, sf):
    used = layers(spark, sf).tables["factTransaction"].groupBy("spendingCategoryKey").agg(F.count("*").alias("n"))
    names = [c for c in schemas.columns("dimSpendingCategory") if c.startswith(("spending", "parent"))]
    seeded = seeds.seed_categories(spark).select(names).join(used, "spendingCategoryKey", "left")
    return seeded.select(*names, F.coalesce("n", F.lit(0)).alias("transactionCount"))


@query("src10_snapshot_roundtrip", sql.silver(
    "SELECT sourceRowIdentifier, transactionNaturalKey, transactionAmount::DOUBLE AS transactionAmount FROM fact"))
def _(spark, sf):
    rows = layers(spark, sf).store.table("factTransaction")
    return rows.select("sourceRowIdentifier", "transactionNaturalKey", "transactionAmount")


@query("src11_export_csv", sql.gold("""
SELECT '"' || strftime(transactionDate, '%Y-%m-%d') || '","'
       || CASE accountType WHEN 'checking' THEN 'Checking' ELSE 'Credit card' END || '","'
       || replace(merchantDisplayName, '"', '""') || '","' || spendingCategoryName || '","' || transactionType || '","'
       || CASE WHEN transactionAmount < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(transactionAmount)::DOUBLE) || '"' AS line
FROM ledger"""))
def _(spark, sf):
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    export.export_ledger(layers(spark, sf).gold["vw_TransactionLedger"], path)
    return spark.read.text(path).filter(~F.col("value").startswith('"Date"')).select(F.col("value").alias("line"))


# ---- projections and filters ---------------------------------------------------------------------------------------


@query("prj01_prj02_unify_sources", sql.silver("""
SELECT sourceFileHash, sourceFileType, sourceRowNumber, sourceAccountType, movedText AS transactionDateText,
       postedText AS postedDateText, description, sourceCategoryName, transactionType, amountText FROM unified"""))
def _(spark, sf):
    stage = staged(spark, sf)
    return silver.unify_sources(stage.checking, stage.credit)


@query("prj03_prj06_default_outcome", sql.silver("""
SELECT sourceAccountType, k.sourceCategoryName, transactionType, category, event, source, priority::BIGINT AS priority,
       count(*) AS transactionCount
FROM prepared p JOIN kinds k USING (sourceAccountType, transactionType)
WHERE k.sourceCategoryName IS NOT DISTINCT FROM p.sourceCategoryName
GROUP BY ALL"""))
def _(spark, sf):
    kinds = ["sourceAccountType", "sourceCategoryName", "transactionType"]
    return prepared(spark, sf).groupBy(*kinds, "outcome").agg(
        F.count("*").alias("transactionCount")
    ).select(*kinds, "outcome.*", "transactionCount")


@query("prj07_filters", sql.gold("""
SELECT transactionEventType, count(*) AS transactionCount, sum(transactionAmount)::DOUBLE AS amount FROM ledger
WHERE transactionDate BETWEEN DATE '1997-03-01' AND DATE '1999-09-30' AND spendingCategoryName IN ('Gas', 'Dining', 'Transfer')
  AND transactionEventType NOT IN ('payment', 'other') GROUP BY 1"""))
def _(spark, sf):
    rows = layers(spark, sf).gold["vw_TransactionLedger"].filter(
        F.col("transactionDate").between(dt.date(1997, 3, 1), dt.date(1999, 9, 30))
        & F.col("spendingCategoryName").isin("Gas", "Dining", "Transfer")
        & ~F.col("transactionEventType").isin("payment", "other")
    )
    return rows.groupBy("transactionEventType").agg(
        F.count("*").alias("transactionCount"), F.sum("transactionAmount").alias("amount")
    )


@query("prj08_like_predicates", sql.silver("""
SELECT count(*) FILTER (transactionDescriptionClean LIKE '%PMT%') AS containing,
       count(*) FILTER (transactionDescriptionClean LIKE 'OLD%') AS starting FROM fact"""))
def _(spark, sf):
    clean = F.col("transactionDescriptionClean")
    return layers(spark, sf).tables["factTransaction"].agg(
        F.count_if(clean.contains("PMT")).alias("containing"), F.count_if(clean.startswith("OLD")).alias("starting")
    )


@query("prj10_selectable_categories", sql.silver("""
SELECT d.spendingCategoryKey::BIGINT AS spendingCategoryKey, d.spendingCategoryName, d.parentSpendingCategoryName,
       count(f.transactionKey) AS transactionCount
FROM dim_category d LEFT JOIN fact f ON f.spendingCategoryKey = d.spendingCategoryKey
WHERE d.spendingCategoryName NOT IN ('Unknown', 'Uncategorized') GROUP BY ALL"""))
def _(spark, sf):
    tables = layers(spark, sf).tables
    used = tables["factTransaction"].groupBy("spendingCategoryKey").agg(F.count("*").alias("n"))
    listed = dashboard.selectable_categories(tables["dimSpendingCategory"]).join(used, "spendingCategoryKey", "left")
    return listed.withColumn("transactionCount", F.coalesce("n", F.lit(0))).drop("n")


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("jn03_left_lookup_default", sql.silver("""
SELECT transactionType, count(*) AS transactionCount, count(*) FILTER (category = 'none') AS withoutCategory
FROM (SELECT p.transactionType, coalesce(c.category, 'none') AS category
      FROM prepared p LEFT JOIN card_category c ON c.sourceName = p.sourceCategoryName) GROUP BY 1"""))
def _(spark, sf):
    table = literal_rows(spark, list(classify.CARD_CATEGORIES.items()), "sourceCategoryName string, category string")
    rows = joins.lookup(
        prepared(spark, sf), table, ["sourceCategoryName"], ["sourceRowIdentifier"], {"category": "none"}
    )
    return rows.groupBy("transactionType").agg(
        F.count("*").alias("transactionCount"), F.count_if(F.col("category") == "none").alias("withoutCategory")
    )


@query("jn04_composite_account_join", sql.silver("""
SELECT accountType, accountLastFour, accountDisplayName, count(*) AS transactionCount
FROM fact JOIN dim_account USING (financialAccountKey) GROUP BY ALL"""))
def _(spark, sf):
    tables = layers(spark, sf).tables
    counts = tables["factTransaction"].groupBy("financialAccountKey").agg(F.count("*").alias("transactionCount"))
    names = ["accountType", "accountLastFour", "accountDisplayName"]
    return counts.join(tables["dimFinancialAccount"], "financialAccountKey").groupBy(names).agg(
        F.sum("transactionCount").alias("transactionCount")
    )


@query("jn06_pattern_join", sql.silver("""
SELECT pattern, count(*) AS merchantCount FROM dim_merchant
JOIN (VALUES ('bolt'), ('AUTOPAY'), ('acme'), ('#1')) AS p(pattern) ON contains(lower(merchantDisplayName), lower(pattern))
GROUP BY 1"""))
def _(spark, sf):
    patterns = literal_rows(spark, [("bolt",), ("AUTOPAY",), ("acme",), ("#1",)], "pattern string")
    merchants = layers(spark, sf).tables["dimMerchant"].filter("merchantKey > 0")
    return joins.names_like(merchants, "merchantDisplayName", patterns, "pattern").groupBy("pattern").agg(
        F.count("*").alias("merchantCount")
    )


@query("jn07_orphans", sql.silver("""
SELECT 'transactionDateKey' AS keyColumn, count(*) FILTER (isodow(strptime(transactionDateKey::VARCHAR, '%Y%m%d')) >= 6) AS orphanRowCount FROM fact
UNION ALL SELECT 'spendingCategoryKey', count(*) FILTER (spendingCategoryKey IN (SELECT spendingCategoryKey FROM dim_category
  WHERE parentSpendingCategoryName = 'Food')) FROM fact"""))
def _(spark, sf):
    tables = layers(spark, sf).tables
    return joins.orphan_counts(tables["factTransaction"], {
        "transactionDateKey": (tables["dimCalendarDate"].filter(~F.col("isWeekend")), "calendarDateKey"),
        "spendingCategoryKey": (
            tables["dimSpendingCategory"].filter("parentSpendingCategoryName <> 'Food'"), "spendingCategoryKey"
        ),
    })


@query("jn10_update_where_key", sql.silver("""
SELECT sourceRowIdentifier, CASE WHEN transactionEventType = 'fee' THEN 1900 ELSE spendingCategoryKey END::BIGINT AS spendingCategoryKey FROM fact"""))
def _(spark, sf):
    fact = layers(spark, sf).tables["factTransaction"]
    fees = fact.filter("transactionEventType = 'fee'").select("transactionKey")
    changed = joins.update_where_key(fact, fees, "transactionKey", {"spendingCategoryKey": F.lit(1900).cast("long")})
    return changed.select("sourceRowIdentifier", "spendingCategoryKey")


@query("jn11_remove_processed", sql.feed("""
SELECT sourceFileHash, sourceRowNumber FROM feed_credit WHERE type <> 'Payment'"""))
def _(spark, sf):
    queue = staged(spark, sf).credit
    grain = ["sourceFileHash", "sourceRowNumber"]
    return joins.remove_processed(queue, queue.filter("type = 'Payment'"), grain).select(grain)


@query("jn_spread_join", sql.silver("""
SELECT transactionDescriptionClean, count(*) AS transactionCount, min(merchantKey) AS merchantKey FROM fact GROUP BY 1"""))
def _(spark, sf):
    """The skew-safe way of a lookup, with a threshold low enough that many merchants count as hot."""
    tables = layers(spark, sf).tables
    names = tables["dimMerchant"].select(F.col("merchantNormalizedName").alias("transactionDescriptionClean"), "merchantKey")
    rows = tables["factTransaction"].drop("merchantKey")
    joined = joins.spread_join(rows, names, ["transactionDescriptionClean"], ["transactionKey"], hot_rows=100)
    return joined.groupBy("transactionDescriptionClean").agg(
        F.count("*").alias("transactionCount"), F.min("merchantKey").alias("merchantKey")
    )


# ---- aggregates, windows, sorts, sets --------------------------------------------------------------------------------


@query("ag01_ag02_filtered_aggregates", sql.gold("""
SELECT accountType, spendingCategoryName, count(*) AS n, sum(transactionAmount)::DOUBLE AS total,
       min(transactionAmount)::DOUBLE AS lowest, max(transactionAmount)::DOUBLE AS highest,
       sum(transactionAmount)::DOUBLE / count(*) AS average,
       coalesce(sum(transactionAmount) FILTER (transactionEventType = 'refund'), 0)::DOUBLE AS refunds,
       count(*) FILTER (transactionAmount > 1000) AS large FROM ledger GROUP BY ALL"""))
def _(spark, sf):
    amount = F.col("transactionAmount")
    return layers(spark, sf).gold["vw_TransactionLedger"].groupBy("accountType", "spendingCategoryName").agg(
        F.count("*").alias("n"), F.sum(amount).alias("total"), F.min(amount).alias("lowest"), F.max(amount).alias("highest"),
        (F.sum(amount).cast("double") / F.count("*")).alias("average"),
        aggregates.sum_if(amount, F.col("transactionEventType") == "refund").alias("refunds"),
        aggregates.count_if(amount > 1000).alias("large"),
    )


@query("ag03_sum_or_zero", sql.gold("""
SELECT coalesce(sum(transactionAmount) FILTER (transactionEventType = 'nothing'), 0)::DOUBLE AS none,
       coalesce(sum(transactionAmount), 0)::DOUBLE AS every FROM ledger"""))
def _(spark, sf):
    amount = F.col("transactionAmount")
    return layers(spark, sf).tables["factTransaction"].agg(
        aggregates.sum_or_zero(F.when(F.col("transactionEventType") == "nothing", amount)).alias("none"),
        aggregates.sum_or_zero(amount).alias("every"),
    )


@query("ag05_distinct", sql.silver("SELECT DISTINCT sourceAccountType, sourceCategoryName, transactionType FROM prepared"))
def _(spark, sf):
    return prepared(spark, sf).select("sourceAccountType", "sourceCategoryName", "transactionType").distinct()


@query("ag06_duplicates", sql.silver("""
SELECT merchantKey, transactionDateKey, count(*) AS rowCount FROM fact GROUP BY ALL HAVING count(*) > 1"""))
def _(spark, sf):
    return aggregates.duplicates(layers(spark, sf).tables["factTransaction"], ["merchantKey", "transactionDateKey"])


@query("ag07_rollup_of_view", sql.gold("""
SELECT spendingCategoryName, sum(purchaseTransactionCount)::BIGINT AS purchases, sum(totalSpendingAmount)::DOUBLE AS total,
       round(avg(averagePurchaseAmount), 6) AS average FROM merchants GROUP BY 1"""))
def _(spark, sf):
    return layers(spark, sf).gold["vw_TopMerchantsBySpending"].groupBy("spendingCategoryName").agg(
        F.sum("purchaseTransactionCount").alias("purchases"), F.sum("totalSpendingAmount").alias("total"),
        F.round(F.avg("averagePurchaseAmount"), 6).alias("average"),
    )


@query("ag08_count_distinct", sql.gold("""
SELECT accountType, count(DISTINCT yearMonth) AS monthCount, count(DISTINCT merchantDisplayName) AS merchantCount FROM ledger GROUP BY 1"""))
def _(spark, sf):
    return layers(spark, sf).gold["vw_TransactionLedger"].groupBy("accountType").agg(
        F.count_distinct("yearMonth").alias("monthCount"), F.count_distinct("merchantDisplayName").alias("merchantCount")
    )


@query("ag09_argmax", sql.gold("""
SELECT DISTINCT ON (spendingCategoryName) spendingCategoryName, merchantDisplayName AS merchant, abs(transactionAmount)::DOUBLE AS amount
FROM ledger WHERE transactionEventType = 'purchase'
ORDER BY spendingCategoryName, abs(transactionAmount) DESC, transactionDate DESC, transactionKey DESC"""))
def _(spark, sf):
    rows = layers(spark, sf).gold["vw_TransactionLedger"].filter("transactionEventType = 'purchase'")
    best = rows.groupBy("spendingCategoryName").agg(ledger.largest_purchase(rows).alias("best"))
    return best.select("spendingCategoryName", "best.merchant", "best.amount")


@query("ag11_first_of_group", sql.gold("""
SELECT DISTINCT ON (yearMonth) yearMonth, merchantDisplayName AS example FROM ledger
ORDER BY yearMonth, transactionDate DESC, transactionKey DESC"""))
def _(spark, sf):
    place = F.struct("transactionDate", "transactionKey")
    return layers(spark, sf).gold["vw_TransactionLedger"].groupBy("yearMonth").agg(
        F.max_by("merchantDisplayName", place).alias("example")
    )


@query("wn01_dedupe", sql.silver("""
SELECT transactionDescriptionClean, transactionDescription, sourceRowIdentifier FROM (
  SELECT *, row_number() OVER (PARTITION BY transactionDescriptionClean ORDER BY transactionDescription, sourceRowIdentifier) AS r
  FROM prepared) WHERE r = 1"""))
def _(spark, sf):
    rows = prepared(spark, sf).select("transactionDescriptionClean", "transactionDescription", "sourceRowIdentifier")
    return numbering.dedupe(
        rows, ["transactionDescriptionClean"], [F.col("transactionDescription"), F.col("sourceRowIdentifier")]
    )


@query("wn03_previous_value", sql.gold("""
SELECT accountType, yearMonth, inflowAmount::DOUBLE AS inflowAmount,
       lag(inflowAmount) OVER (PARTITION BY accountType ORDER BY yearMonth)::DOUBLE AS previousInflow FROM cashflow"""))
def _(spark, sf):
    rows = layers(spark, sf).gold["vw_MonthlyCashflow"].select("accountType", "yearMonth", "inflowAmount")
    return aggregates.with_previous(rows, ["accountType"], "yearMonth", "inflowAmount", "previousInflow")


@query("wn_number_rows", sql.gold("""
SELECT transactionKey, row_number() OVER (PARTITION BY accountType ORDER BY transactionDate, transactionKey) AS place FROM ledger"""))
def _(spark, sf):
    rows = layers(spark, sf).gold["vw_TransactionLedger"].select("transactionKey", "accountType", "transactionDate")
    return numbering.number_rows(rows, ["transactionDate", "transactionKey"], ["accountType"], "place").select("transactionKey", "place")


@query("so01_top_k", sql.gold("""
SELECT merchantDisplayName, count(*) AS n FROM ledger GROUP BY 1 ORDER BY n DESC, merchantDisplayName LIMIT 8"""))
def _(spark, sf):
    rows = layers(spark, sf).gold["vw_TransactionLedger"].groupBy("merchantDisplayName").agg(F.count("*").alias("n"))
    return aggregates.top_k(rows, [F.desc("n"), F.asc("merchantDisplayName")], 8)


@query("se01_union_dates", sql.feed("""
SELECT d AS dateText, count(*) AS n FROM (SELECT postingDate AS d FROM feed_checking UNION ALL
SELECT transactionDate FROM feed_credit UNION ALL SELECT postDate FROM feed_credit) GROUP BY 1"""))
def _(spark, sf):
    stage = staged(spark, sf)
    dates = stage.checking.select(F.col("postingDate").alias("dateText"))
    for name in ("transactionDate", "postDate"):
        dates = dates.unionByName(stage.credit.select(F.col(name).alias("dateText")))
    return dates.groupBy("dateText").agg(F.count("*").alias("n"))


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query("sc01_sc07_text_money_hash", sql.silver("""
SELECT p.sourceRowIdentifier, p.transactionDate, p.transactionDescription, p.transactionDescriptionClean, p.transactionRuleMatchText,
       p.transactionAmount::DOUBLE AS transactionAmount, f.transactionNaturalKey
FROM prepared p JOIN fact f USING (sourceRowIdentifier)"""))
def _(spark, sf):
    return prepared(spark, sf).select(
        "sourceRowIdentifier", "transactionDate", "transactionDescription", "transactionDescriptionClean",
        "transactionRuleMatchText", "transactionAmount", text.natural_key().alias("transactionNaturalKey"),
    )


@query("sc06_hash16", sql.silver(f"""
SELECT DISTINCT {sql.key16("sourceAccountType", "coalesce(sourceCategoryName, '')", "transactionType")} AS h FROM prepared"""))
def _(spark, sf):
    return prepared(spark, sf).select(
        text.hash16(F.col("sourceAccountType"), F.col("sourceCategoryName"), F.col("transactionType")).alias("h")
    ).distinct()


@query("sc08_calendar", sql.silver("""
SELECT calendarDateKey, calendarDate, year(calendarDate)::BIGINT AS calendarYear, quarter(calendarDate)::BIGINT AS calendarQuarter,
       month(calendarDate)::BIGINT AS calendarMonth, monthname(calendarDate) AS calendarMonthName,
       month(calendarDate)::BIGINT AS calendarMonthNumber, day(calendarDate)::BIGINT AS calendarDayOfMonth,
       isodow(calendarDate)::BIGINT AS calendarDayOfWeek, dayname(calendarDate) AS calendarDayName,
       isodow(calendarDate) >= 6 AS isWeekend, yearMonth, monthStartDate, last_day(calendarDate) AS monthEndDate FROM dim_date"""))
def _(spark, sf):
    return silver.observed_dates(prepared(spark, sf))


@query("sc10_tokens", sql.silver("""
SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(string_split(transactionRuleMatchText, ' '), lambda w: length(w) > 1)) AS token
FROM prepared) GROUP BY 1"""))
def _(spark, sf):
    words = prepared(spark, sf).select(F.explode(text.tokens(F.col("transactionRuleMatchText"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


@query("sc11_sc13_display", sql.gold("""
SELECT transactionKey, CASE WHEN transactionAmount < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(transactionAmount)::DOUBLE) AS amountText,
       CASE accountType WHEN 'creditCard' THEN 'Credit card' ELSE 'Checking' END AS accountText,
       strftime(monthStartDate, '%b %y') AS monthText FROM ledger"""))
def _(spark, sf):
    return layers(spark, sf).gold["vw_TransactionLedger"].select(
        "transactionKey", display.currency_text(F.col("transactionAmount")).alias("amountText"),
        display.account_label(F.col("accountType")).alias("accountText"), display.month_label(F.col("yearMonth")).alias("monthText"),
    )


@query("sc12_account_display", sql.silver("SELECT accountType, accountLastFour, accountDisplayName FROM dim_account"))
def _(spark, sf):
    shown = display.account_display(F.col("accountType"), F.col("accountLastFour"))
    return staged(spark, sf).metadata.select("accountType", "accountLastFour", shown.alias("accountDisplayName")).distinct()


_upper = "trim(regexp_replace(upper(merchantDisplayName), '\\s+', ' ', 'g'))"
_stop = sql.listing(text.STOP_WORDS)
_words = f"""list_filter(string_split(regexp_replace(regexp_replace(coalesce(nullif(
  regexp_extract({_upper}, 'ORIG CO NAME:(.+?) CO ENTRY', 1), ''), {_upper}), '[:*#/,-]', ' ', 'g'), '\\s+', ' ', 'g'), ' '),
  lambda w: length(w) > 1 AND NOT list_contains({_stop}, w) AND NOT regexp_full_match(w, '[0-9]+'))"""
_match = f"array_to_string(({_words})[1:3], ' ')"
_offered = [name for key, name, parent, _ in sorted(seeds.CATEGORIES, key=lambda c: (c[2], c[1])) if name not in ("Unknown", "Uncategorized")]
_hint = "CASE " + " ".join(
    f"WHEN regexp_matches(t, '{pattern}') THEN '{names[0]}'" for pattern, names in classify.HINTS
) + " ELSE 'Personal' END"


@query("sc14_sc16_rule_words", sql.silver(f"""
SELECT merchantDisplayName, t AS matchText, coalesce(nullif(regexp_extract({_upper}, 'ORIG CO NAME:(.+?) CO ENTRY', 1), ''), '') AS company,
       {_hint} AS hint FROM (SELECT merchantDisplayName, {_match} AS t FROM dim_merchant)"""))
def _(spark, sf):
    merchants = layers(spark, sf).tables["dimMerchant"].filter("merchantKey > 0")
    name = F.col("merchantDisplayName")
    rows = merchants.select("merchantDisplayName", text.suggested_match_text(name).alias("matchText"))
    return rows.select(
        "merchantDisplayName", "matchText", F.coalesce(text.origin_company(name), F.lit("")).alias("company"),
        classify.hint_category(F.col("matchText"), _offered).alias("hint"),
    )


# ---- upserts and constraints -----------------------------------------------------------------------------------------


def _aged(rows: DataFrame) -> DataFrame:
    """Existing rows with audit times in the past, so that a query can show what a merge touched."""
    past = F.lit(AMENDED)
    return rows.withColumns({"createdDatetime": past, "modifiedDatetime": past})


def _touched() -> list:
    past = F.lit(AMENDED)
    return [
        (F.col("createdDatetime") != past).alias("inserted"),
        ((F.col("createdDatetime") == past) & (F.col("modifiedDatetime") != past)).alias("updated"),
    ]


@query("up01_merge_unconditional", sql.feed("""
SELECT sourceFileHash, sourceRowNumber, CASE WHEN y >= 1998 THEN 'AMENDED' ELSE details END AS details, description,
       y >= 2000 AS inserted, y BETWEEN 1998 AND 1999 AS updated
FROM (SELECT *, substr(postingDate, 7)::INT AS y FROM feed_checking)"""))
def _(spark, sf):
    bronze, year = layers(spark, sf).tables["rawChaseCheckingTransaction"], F.substring("postingDate", 7, 4).cast("int")
    old = _aged(bronze.filter(year < 2000))
    new = staged(spark, sf).checking.filter(year >= 1998).withColumn("details", F.lit("AMENDED"))
    merged = silver.load_bronze("rawChaseCheckingTransaction", old, new)
    return merged.select("sourceFileHash", "sourceRowNumber", "details", "description", *_touched())


@query("up02_up03_merge_changed", sql.silver("""
SELECT sourceRowIdentifier, transactionType,
       CASE WHEN transactionType = 'Sale' THEN NULL ELSE sourceCategoryName END AS sourceCategoryName,
       false AS inserted, transactionType = 'Sale' AND sourceCategoryName IS NOT NULL AS updated FROM fact"""))
def _(spark, sf):
    """All facts are merged again; category text is emptied for sales, so only sales that had one are updated."""
    fact = layers(spark, sf).tables["factTransaction"]
    again = fact.withColumn("sourceCategoryName", F.when(F.col("transactionType") != "Sale", F.col("sourceCategoryName")))
    merged = silver.merge_facts(_aged(fact), again.drop("transactionKey", "createdDatetime", "modifiedDatetime"))
    return merged.select("sourceRowIdentifier", "transactionType", "sourceCategoryName", *_touched())


@query("up04_insert_ignore", sql.silver("""
SELECT calendarDateKey, CASE WHEN isodow(calendarDate) >= 6 THEN 'old' ELSE 'new' END AS origin FROM dim_date"""))
def _(spark, sf):
    dates = layers(spark, sf).tables["dimCalendarDate"].filter("calendarDateKey <> 19000101")
    old = dates.filter("isWeekend").select("calendarDateKey", F.lit("old").alias("origin"))
    new = dates.select("calendarDateKey", F.lit("new").alias("origin"))
    return upsert.insert_ignore(old, new, "calendarDateKey")


@query("up05_deactivate_rules", sql.silver("""
SELECT ruleName, NOT (ruleName LIKE 'Auto Category Rule %' AND categoryAssignmentSource = 'rule') AS isActive FROM map_category_rule"""))
def _(spark, sf):
    """Every generated rule is given a description to match on, the state earlier versions left behind."""
    stored = layers(spark, sf).tables["mapCategoryRule"]
    return silver.deactivate_rules(stored.withColumn("descriptionMatchType", F.lit("contains"))).select("ruleName", "isActive")


@query("up07_surrogate_keys", sql.silver("""
SELECT merchantNormalizedName, 5000 + 100 * row_number() OVER (ORDER BY merchantNormalizedName) AS merchantKey FROM dim_merchant"""))
def _(spark, sf):
    names = silver.observed_merchants(prepared(spark, sf)).select("merchantNormalizedName")
    return numbering.assign_keys(names, "merchantKey", ["merchantNormalizedName"], 5000)


@query("up10_full_refresh", sql.silver("""
SELECT transactionEventType, count(*) AS n, sum(transactionAmount)::DOUBLE AS total, 1::BIGINT AS parts FROM fact
WHERE sourceRowIdentifier LIKE 'chaseCredit%' GROUP BY 1"""))
def _(spark, sf):
    """A loaded store is rebuilt from the card feed alone; nothing of the earlier load remains."""
    from tallymill.sources.files import Stage

    stage = staged(spark, sf)
    store = new_store(spark, "refresh")
    silver.load(store, stage)
    metadata = stage.metadata.filter("accountType = 'creditCard'")
    silver.load(store, Stage(metadata, stage.checking.filter("false"), stage.credit), fresh=True)
    return store.table("factTransaction").groupBy("transactionEventType").agg(
        F.count("*").alias("n"), F.sum("transactionAmount").alias("total"),
        F.lit(len(store.parts("factTransaction"))).alias("parts"),
    )


@query("ck01_constraints", sql.silver("""
SELECT 'factTransaction' AS tableName, 'transactionAmount above zero' AS constraintName, count(*) FILTER (transactionAmount <= 0) AS violationCount FROM fact
UNION ALL SELECT 'factTransaction', 'row rules', 0
UNION ALL SELECT 'factTransaction', 'merchantKey unique', (SELECT count(*) FROM (SELECT merchantKey FROM fact GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'factTransaction', 'keys unique', 0"""))
def _(spark, sf):
    """Declared constraints hold on the loaded fact; two more that do not hold show that violations are counted."""
    fact = layers(spark, sf).tables["factTransaction"]
    found = constraints.check_constraints(fact, "factTransaction")
    unique = F.col("constraintName").endswith(" unique")
    summed = found.groupBy("tableName", F.when(unique, "keys unique").otherwise("row rules").alias("constraintName")).agg(
        F.sum("violationCount").alias("violationCount")
    )
    extra = fact.agg(F.count_if(F.col("transactionAmount") <= 0).alias("violationCount")).select(
        F.lit("factTransaction").alias("tableName"), F.lit("transactionAmount above zero").alias("constraintName"), "violationCount"
    )
    twice = aggregates.duplicates(fact, ["merchantKey"]).agg(F.count("*").alias("violationCount")).select(
        F.lit("factTransaction").alias("tableName"), F.lit("merchantKey unique").alias("constraintName"), "violationCount"
    )
    return summed.unionByName(extra).unionByName(twice)


@query("ck02_foreign_keys", sql.silver("""
SELECT tableName, constraintName, CASE constraintName WHEN 'postedDateKey known'
  THEN (SELECT count(*) FROM fact WHERE isodow(strptime(postedDateKey::VARCHAR, '%Y%m%d')) >= 6)
  WHEN 'transactionDateKey known' THEN (SELECT count(*) FROM fact WHERE isodow(strptime(transactionDateKey::VARCHAR, '%Y%m%d')) >= 6)
  ELSE 0 END AS violationCount
FROM (VALUES ('factTransaction', 'sourceFileKey known'), ('factTransaction', 'financialAccountKey known'),
  ('factTransaction', 'transactionDateKey known'), ('factTransaction', 'postedDateKey known'), ('factTransaction', 'merchantKey known'),
  ('factTransaction', 'merchantRuleKey known'), ('factTransaction', 'spendingCategoryKey known'),
  ('factTransaction', 'categoryRuleKey known'), ('mapMerchantRule', 'merchantKey known'),
  ('mapCategoryRule', 'spendingCategoryKey known')) AS c(tableName, constraintName)"""))
def _(spark, sf):
    """With weekends taken out of the calendar, the two date keys have orphans and the other eight have none."""
    tables = layers(spark, sf).tables
    return constraints.check_foreign_keys({**tables, "dimCalendarDate": tables["dimCalendarDate"].filter(~F.col("isWeekend"))})


# ---- rules -----------------------------------------------------------------------------------------------------------

RULE_COLUMNS = (
    "categoryRuleKey, ruleName, sourceAccountType, sourceCategoryName, transactionType, descriptionMatchType, "
    "descriptionMatchText, spendingCategoryKey, transactionEventType, categoryAssignmentSource, rulePriority"
)
_rule_select = f"SELECT {RULE_COLUMNS.replace('rulePriority', 'rulePriority::BIGINT AS rulePriority').replace('categoryRuleKey', 'categoryRuleKey::BIGINT AS categoryRuleKey').replace('spendingCategoryKey', 'spendingCategoryKey::BIGINT AS spendingCategoryKey')} FROM map_category_rule"


@query("rul01_seed_rule_usage", sql.silver("""
SELECT r.ruleName, d.spendingCategoryName, r.rulePriority::BIGINT AS rulePriority, count(f.transactionKey) AS transactionCount
FROM map_category_rule r JOIN dim_category d USING (spendingCategoryKey) LEFT JOIN fact f USING (categoryRuleKey)
WHERE r.ruleName LIKE 'System%' GROUP BY ALL"""))
def _(spark, sf):
    tables = layers(spark, sf).tables
    empty = seeds.seed_unknown_members(spark, "mapCategoryRule")
    seeded = silver.seed_category_rules(empty, tables["dimSpendingCategory"]).filter("categoryRuleKey > 0")
    used = tables["factTransaction"].groupBy("categoryRuleKey").agg(F.count("*").alias("n"))
    names = tables["dimSpendingCategory"].select("spendingCategoryKey", "spendingCategoryName")
    return seeded.join(names, "spendingCategoryKey").join(used, "categoryRuleKey", "left").select(
        "ruleName", "spendingCategoryName", "rulePriority", F.coalesce("n", F.lit(0)).alias("transactionCount")
    )


@query("rul02_category_rules", sql.silver(_rule_select))
def _(spark, sf):
    return layers(spark, sf).tables["mapCategoryRule"].select(RULE_COLUMNS.split(", "))


@query("rul03_merchant_rules", sql.silver(f"""
SELECT 'Auto Merchant Rule ' || {sql.key16("merchantNormalizedName", "merchantKey")} AS ruleName, 'exact' AS descriptionMatchType,
       merchantNormalizedName AS descriptionMatchText, merchantKey, 10::BIGINT AS rulePriority, merchantKey AS merchantRuleKey FROM dim_merchant"""))
def _(spark, sf):
    return layers(spark, sf).tables["mapMerchantRule"].filter("merchantRuleKey > 0").select(
        "ruleName", "descriptionMatchType", "descriptionMatchText", "merchantKey", "rulePriority", "merchantRuleKey"
    )


_winner_sql = sql.silver("""
SELECT p.sourceRowIdentifier, h.ruleKey::BIGINT AS categoryRuleKey, w.spendingCategoryKey::BIGINT AS spendingCategoryKey, w.transactionEventType
FROM prepared p LEFT JOIN hit h ON h.sourceAccountType = p.sourceAccountType AND h.transactionType = p.transactionType
  AND h.text = p.transactionRuleMatchText LEFT JOIN map_category_rule w ON w.categoryRuleKey = h.ruleKey""")


def _winners(spark, sf) -> DataFrame:
    known = rules.classifying_rules(layers(spark, sf).tables["mapCategoryRule"])
    rows = rules.match_rules(prepared(spark, sf), known)
    return rows.select(
        "sourceRowIdentifier", "winner.categoryRuleKey", "winner.spendingCategoryKey", "winner.transactionEventType"
    )


@query("rul04_jn05_wn02_rule_match", _winner_sql)
def _(spark, sf):
    return _winners(spark, sf)


@query("rul04_rule_match_by_anchor", _winner_sql)
def _(spark, sf):
    """The table of winners by itself, joined with every transaction null-safely."""
    known = rules.classifying_rules(layers(spark, sf).tables["mapCategoryRule"])
    rows = prepared(spark, sf).select("sourceRowIdentifier", *rules.EVIDENCE)
    won = rules.winners_by_anchor(rows.select(rules.EVIDENCE).distinct(), known)
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(won[c]) for c in rules.EVIDENCE])
    return rows.join(won, same, "left").select(
        "sourceRowIdentifier", "winner.categoryRuleKey", "winner.spendingCategoryKey", "winner.transactionEventType"
    )


_many = """
many_rule AS (
  SELECT 10000 + row_number() OVER (ORDER BY p_name, p_brand) AS ruleKey, CASE p_size % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'startsWith' ELSE 'contains' END AS kind,
         {rule} AS wanted, p_size AS priority
  FROM (SELECT p_name, p_brand, min(p_size) AS p_size FROM part GROUP BY ALL)),
many_hit AS (
  SELECT t.text, arg_max(r.ruleKey, r.priority::BIGINT * 100000000 + r.ruleKey) AS ruleKey
  FROM (SELECT DISTINCT transactionRuleMatchText AS text FROM prepared WHERE sourceAccountType = 'creditCard') t JOIN many_rule r
    ON CASE r.kind WHEN 'exact' THEN t.text = r.wanted WHEN 'startsWith' THEN starts_with(t.text, r.wanted)
       ELSE len(list_filter(string_split(r.wanted, ' '), lambda w: length(w) > 1 AND NOT contains(t.text, w))) = 0 END
  GROUP BY 1)"""


@query("rul04_rule_match_many_rules", "WITH " + sql.FEED + "," + sql.SILVER + "," + _many.format(rule=sql.rule_text(
    "CASE p_size % 3 WHEN 2 THEN p_brand || ' ' || p_name ELSE p_name || CASE p_size % 3 WHEN 0 THEN ' ' || p_brand ELSE '' END END")) + """
SELECT p.sourceRowIdentifier, h.ruleKey::BIGINT AS categoryRuleKey FROM prepared p
LEFT JOIN many_hit h ON p.sourceAccountType = 'creditCard' AND h.text = p.transactionRuleMatchText""")
def _(spark, sf):
    """One rule per distinct part name, of all three match types: far more than are matched inline."""
    names = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_name", "p_brand").agg(F.min("p_size").alias("p_size"))
    numbered = numbering.number_rows(names, ["p_name", "p_brand"], name="place")
    kind = F.element_at(F.array(F.lit("exact"), F.lit("startsWith"), F.lit("contains")), F.col("p_size") % 3 + 1)
    wording = (
        F.when(F.col("p_size") % 3 == 2, F.concat_ws(" ", "p_brand", "p_name"))
        .when(F.col("p_size") % 3 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name"))
    )
    none = F.lit(None).cast("string")
    table = numbered.select(
        (F.col("place") + 10000).alias("categoryRuleKey"), F.lit("creditCard").alias("sourceAccountType"),
        none.alias("sourceCategoryName"), none.alias("transactionType"), kind.alias("descriptionMatchType"),
        wording.alias("descriptionMatchText"), F.lit(700).cast("long").alias("spendingCategoryKey"),
        F.lit("purchase").alias("transactionEventType"), F.lit("manual").alias("categoryAssignmentSource"),
        F.col("p_size").cast("int").alias("rulePriority"), F.lit(True).alias("isActive"),
    )
    known = rules.classifying_rules(materialise(table, "rules"))
    return rules.match_rules(prepared(spark, sf), known).select("sourceRowIdentifier", "winner.categoryRuleKey")


@query("rul05_jn08_token_contains", sql.silver("""
SELECT transactionRuleMatchText AS text, len(list_filter(['WIDGET', 'BRAND'], lambda w: NOT contains(transactionRuleMatchText, w))) = 0 AS matches
FROM prepared GROUP BY 1"""))
def _(spark, sf):
    words = F.filter(F.array(F.lit("WIDGET"), F.lit("B"), F.lit("BRAND")), lambda w: F.length(w) > 1)
    texts = prepared(spark, sf).select(F.col("transactionRuleMatchText").alias("text")).distinct()
    return texts.select("text", rules.token_contains(F.col("text"), words).alias("matches"))


@query("rul06_resolved_rule", sql.silver("""
SELECT r.ruleName, d.spendingCategoryName, f.transactionEventType, count(*) AS transactionCount
FROM fact f JOIN map_category_rule r USING (categoryRuleKey) JOIN dim_category d ON d.spendingCategoryKey = f.spendingCategoryKey GROUP BY ALL"""))
def _(spark, sf):
    tables = layers(spark, sf).tables
    keys = ["categoryRuleKey", "spendingCategoryKey"]
    counts = tables["factTransaction"].groupBy(*keys, "transactionEventType").agg(F.count("*").alias("transactionCount"))
    named = counts.join(tables["mapCategoryRule"].select(keys[0], "ruleName"), keys[0]).join(
        tables["dimSpendingCategory"].select(keys[1], "spendingCategoryName"), keys[1]
    )
    return named.select("ruleName", "spendingCategoryName", "transactionEventType", "transactionCount")


# Requests: order, account, type, event, match type, text, category.
REQUESTS = [
    (1, "creditCard", "Sale", "purchase", "contains", "widget brand", "Shopping"),
    (2, "creditCard", "Sale", "purchase", "startsWith", "red", "Gas"),
    (3, "checking", "ACH_DEBIT", "purchase", "contains", "Shell", "Gas"),
    (4, "checking", "DEBIT_CARD", "purchase", "exact", "trader joe's #12", "Groceries"),
    (5, "checking", "DEBIT_CARD", "purchase", "contains", "!!", "Groceries"),
    (6, "savings", "DEBIT_CARD", "purchase", "contains", "x", "Groceries"),
    (7, "checking", "unknown", "other", "contains", "s", "Personal"),
    (8, "creditCard", "Sale", "refund", "contains", "bolt", "Home"),
    (9, "creditCard", "Sale", "purchase", "contains", "bolt", "Nothing"),
    (10, "creditCard", "Sale", "purchase", "contains", "old", "Uncategorized"),
    (11, "creditCard", "Sale", "purchase", "startsWith", "old", "Home"),
]
_REQUEST_DDL = (
    "requestOrder long, sourceAccountType string, transactionType string, transactionEventType string, "
    "descriptionMatchType string, descriptionMatchText string, spendingCategoryName string"
)
_requests = f"""
request(requestOrder, sourceAccountType, transactionType, transactionEventType, kind, text, category) AS (VALUES {sql.values(REQUESTS)}),
valid AS (
  SELECT r.*, {sql.rule_text('r.text')} AS wanted, d.spendingCategoryKey, d.spendingCategoryName IN ('Uncategorized', 'Unknown') AS staysOpen,
         list_filter(string_split({sql.rule_text('r.text')}, ' '), lambda w: length(w) > 1) AS words
  FROM request r JOIN dim_category d ON d.spendingCategoryName = r.category
  WHERE r.sourceAccountType IN ('checking', 'creditCard') AND {sql.rule_text('r.text')} <> ''),
named AS MATERIALIZED (
  SELECT *, 'Manual Category Rule ' || {sql.key16("sourceAccountType", "transactionType", "transactionEventType", "kind", "wanted", "spendingCategoryKey")} AS ruleName FROM valid),
open_fact AS MATERIALIZED (
  SELECT f.sourceRowIdentifier, a.accountType, f.transactionType, f.transactionEventType, f.transactionDescriptionClean
  FROM fact f JOIN dim_account a USING (financialAccountKey) JOIN dim_category c ON c.spendingCategoryKey = f.spendingCategoryKey
  WHERE c.spendingCategoryName IN ('Uncategorized', 'Unknown')),
open_text AS MATERIALIZED (
  SELECT *, {sql.rule_text('transactionDescriptionClean')} AS text
  FROM (SELECT DISTINCT accountType, transactionType, transactionEventType, transactionDescriptionClean FROM open_fact)),
text_match AS MATERIALIZED (
  SELECT t.accountType, t.transactionType, t.transactionEventType, t.transactionDescriptionClean, v.requestOrder, v.spendingCategoryKey, v.staysOpen, v.ruleName
  FROM open_text t JOIN named v ON v.sourceAccountType = t.accountType AND v.transactionType = t.transactionType AND v.transactionEventType = t.transactionEventType
  WHERE CASE v.kind WHEN 'exact' THEN t.text = v.wanted WHEN 'startsWith' THEN starts_with(t.text, v.wanted)
        ELSE len(list_filter(CASE WHEN len(v.words) = 0 THEN [v.wanted] ELSE v.words END, lambda w: NOT contains(t.text, w))) = 0 END),
matched AS (
  SELECT f.sourceRowIdentifier, m.requestOrder, m.spendingCategoryKey, m.staysOpen, m.ruleName,
         min(CASE WHEN NOT m.staysOpen THEN m.requestOrder END) OVER (PARTITION BY f.sourceRowIdentifier) AS closing
  FROM open_fact f JOIN text_match m USING (accountType, transactionType, transactionEventType, transactionDescriptionClean)),
applied AS (SELECT * FROM matched WHERE closing IS NULL OR requestOrder <= closing)"""


def approvals(query_text: str) -> str:
    return f"WITH {sql.FEED},{sql.SILVER},{_requests}\n{query_text}"


def _approved(spark, sf):
    """A copy of the loaded store in which the requests were approved."""
    from .fixtures import once

    def build():
        store = layers(spark, sf).store.fork(new_store(spark, "approved").root)
        result = approval.approve_rules(store, literal_rows(spark, REQUESTS, _REQUEST_DDL))
        return store, materialise(result, "approvals")
    return once(spark, sf, "approved", build)


@query("rul07_prepare_manual_rules", approvals("""
SELECT r.requestOrder::BIGINT AS requestOrder, n.ruleName, n.ruleName IS NULL AS rejected, count(f.transactionKey) AS sameTypeCount
FROM request r LEFT JOIN named n USING (requestOrder) LEFT JOIN fact f ON f.transactionType = r.transactionType GROUP BY ALL"""))
def _(spark, sf):
    tables = layers(spark, sf).tables
    checked = approval.prepare_manual_rules(literal_rows(spark, REQUESTS, _REQUEST_DDL), tables["dimSpendingCategory"])
    counts = tables["factTransaction"].groupBy("transactionType").agg(F.count("*").alias("n"))
    return checked.join(counts, "transactionType", "left").select(
        "requestOrder", "ruleName", F.col("rejectReason").isNotNull().alias("rejected"),
        F.coalesce("n", F.lit(0)).alias("sameTypeCount"),
    )


@query("rul08_approve_counts", approvals("""
SELECT r.requestOrder::BIGINT AS requestOrder, count(a.sourceRowIdentifier) AS updatedTransactionCount
FROM request r LEFT JOIN applied a USING (requestOrder) GROUP BY 1"""))
def _(spark, sf):
    return _approved(spark, sf)[1].select("requestOrder", "updatedTransactionCount")


@query("rul08_up06_up09_approved_facts", approvals("""
SELECT f.sourceRowIdentifier, coalesce(w.spendingCategoryKey, f.spendingCategoryKey)::BIGINT AS spendingCategoryKey,
       coalesce(w.ruleName, r.ruleName) AS ruleName, f.transactionEventType
FROM fact f JOIN map_category_rule r USING (categoryRuleKey)
LEFT JOIN (SELECT sourceRowIdentifier, arg_max(spendingCategoryKey, requestOrder) AS spendingCategoryKey,
                  arg_max(ruleName, requestOrder) AS ruleName FROM applied GROUP BY 1) w USING (sourceRowIdentifier)"""))
def _(spark, sf):
    store = _approved(spark, sf)[0]
    names = store.table("mapCategoryRule").select("categoryRuleKey", "ruleName")
    return store.table("factTransaction").join(F.broadcast(names), "categoryRuleKey").select(
        "sourceRowIdentifier", "spendingCategoryKey", "ruleName", "transactionEventType"
    )


_suggestions = f"""
suggestion AS (
  SELECT accountType || '|' || transactionType || '|' || transactionEventType || '|' || t AS suggestionKey, accountType AS sourceAccountType,
         transactionType, transactionEventType, 'contains' AS descriptionMatchType, t AS descriptionMatchText, {_hint} AS suggestedCategoryName,
         first(merchantDisplayName ORDER BY transactionDate DESC, transactionKey DESC) AS exampleMerchant, count(*) AS transactionCount,
         sum(abs(transactionAmount))::DOUBLE AS totalAmount,
         CASE WHEN count(*) >= 5 AND len(string_split(t, ' ')) <= 2 THEN 'High' WHEN count(*) >= 2 THEN 'Medium' ELSE 'Review' END AS confidenceLabel
  FROM (SELECT *, {_match} AS t FROM ledger WHERE {sql.OPEN} AND transactionEventType IN ('purchase', 'refund'))
  WHERE t <> '' GROUP BY accountType, transactionType, transactionEventType, t)"""


def suggested(query_text: str) -> str:
    return f"WITH {sql.FEED},{sql.SILVER},{sql.GOLD},{_suggestions}\n{query_text}"


def _suggested(spark, sf) -> DataFrame:
    return suggestions.suggest_rules(layers(spark, sf).gold["vw_TransactionLedger"], _offered)


@query("rul09_rul10_suggest_rules", suggested("SELECT * FROM suggestion"))
def _(spark, sf):
    return _suggested(spark, sf)


@query("rul11_exclude_approved", suggested("SELECT * FROM suggestion WHERE confidenceLabel <> 'High'"))
def _(spark, sf):
    found = _suggested(spark, sf)
    return suggestions.exclude_approved(found, found.filter("confidenceLabel = 'High'"))


@query("so05_top_suggestions", suggested(
    "SELECT * FROM suggestion ORDER BY transactionCount DESC, totalAmount DESC, suggestionKey LIMIT 6"))
def _(spark, sf):
    return suggestions.top_suggestions(_suggested(spark, sf))


@query("rul12_reclassify", approvals(f"""
SELECT f.sourceRowIdentifier, coalesce(w.spendingCategoryKey, f.spendingCategoryKey)::BIGINT AS spendingCategoryKey,
       coalesce(w.transactionEventType, f.transactionEventType) AS transactionEventType
FROM fact f JOIN prepared p USING (sourceRowIdentifier)
LEFT JOIN (SELECT * FROM (
  SELECT q.sourceRowIdentifier, v.spendingCategoryKey, v.transactionEventType,
         row_number() OVER (PARTITION BY q.sourceRowIdentifier ORDER BY v.requestOrder DESC) AS place
  FROM prepared q JOIN named v ON v.sourceAccountType = q.sourceAccountType AND v.transactionType = q.transactionType
   AND CASE v.kind WHEN 'exact' THEN q.transactionRuleMatchText = v.wanted WHEN 'startsWith' THEN starts_with(q.transactionRuleMatchText, v.wanted)
       ELSE len(v.words) > 0 AND len(list_filter(v.words, lambda w: NOT contains(q.transactionRuleMatchText, w))) = 0 END) WHERE place = 1) w
  USING (sourceRowIdentifier)"""))
def _(spark, sf):
    """A load after approval applies the manual rules (priority 120) to every matching row, event type included."""
    def build():
        again = _approved(spark, sf)[0].fork(new_store(spark, "reclassified").root)
        return silver.reclassify(again)["factTransaction"]
    from .fixtures import once

    return once(spark, sf, "reclassified", build).select("sourceRowIdentifier", "spendingCategoryKey", "transactionEventType")


# ---- Bronze and Silver jobs ------------------------------------------------------------------------------------------


def _bronze_sql(feed: str, names: list[str]) -> str:
    return sql.feed(f"""
SELECT 100 * row_number() OVER (ORDER BY sourceFileHash, sourceRowNumber) AS recordKey, sourceFileName, sourceFileHash,
       sourceRowNumber, {", ".join(names)} FROM {feed}""")


@query("brz01_load_checking", _bronze_sql("feed_checking", schemas.CHECKING_COLUMNS))
def _(spark, sf):
    return layers(spark, sf).tables["rawChaseCheckingTransaction"].drop("createdDatetime", "modifiedDatetime")


@query("brz02_load_credit", _bronze_sql("feed_credit", schemas.CREDIT_COLUMNS))
def _(spark, sf):
    return layers(spark, sf).tables["rawChaseCreditTransaction"].drop("createdDatetime", "modifiedDatetime")


def _silver_table(name: str, key: str):
    def build(spark, sf):
        audit = ["createdDatetime", "modifiedDatetime", "isActive"]
        return layers(spark, sf).tables[name].filter(F.col(key) > 0).drop(*audit)
    return build


query("slv01_dim_source_file", sql.silver("""
SELECT sourceFileKey, sourceFileName, sourceFileHash, sourceFileType, 'chase' AS sourceSystemName, rowCount FROM dim_file"""))(
    _silver_table("dimSourceFile", "sourceFileKey"))
query("slv02_dim_account", sql.silver("""
SELECT financialAccountKey, 'chase' AS institutionName, accountType, accountLastFour, accountDisplayName FROM dim_account"""))(
    _silver_table("dimFinancialAccount", "financialAccountKey"))
query("slv04_dim_merchant", sql.silver("SELECT * FROM dim_merchant"))(_silver_table("dimMerchant", "merchantKey"))


@query("slv03_dim_calendar", sql.silver("SELECT calendarDateKey, calendarDate, yearMonth, monthStartDate FROM dim_date"))
def _(spark, sf):
    days = layers(spark, sf).tables["dimCalendarDate"].filter("calendarDateKey <> 19000101")
    return days.select("calendarDateKey", "calendarDate", "yearMonth", "monthStartDate")


@query("slv05_slv06_dim_category_usage", sql.silver("""
SELECT d.spendingCategoryName, d.parentSpendingCategoryName, count(f.transactionKey) AS transactionCount
FROM dim_category d LEFT JOIN fact f ON f.spendingCategoryKey = d.spendingCategoryKey GROUP BY ALL"""))
def _(spark, sf):
    tables = layers(spark, sf).tables
    used = tables["factTransaction"].groupBy("spendingCategoryKey").agg(F.count("*").alias("n"))
    return tables["dimSpendingCategory"].join(used, "spendingCategoryKey", "left").select(
        "spendingCategoryName", "parentSpendingCategoryName", F.coalesce("n", F.lit(0)).alias("transactionCount")
    )


@query("slv07_fact_transaction", sql.silver("""
SELECT * REPLACE (transactionAmount::DOUBLE AS transactionAmount, spendingCategoryKey::BIGINT AS spendingCategoryKey,
                  categoryRuleKey::BIGINT AS categoryRuleKey) FROM fact"""))
def _(spark, sf):
    return layers(spark, sf).tables["factTransaction"].drop("createdDatetime", "modifiedDatetime")


@query("slv07_rerun_changes_nothing", sql.silver("SELECT count(*) AS n, 0::BIGINT AS modified, count(*) * 100 AS lastKey FROM fact"))
def _(spark, sf):
    """The same input loaded twice."""
    store = new_store(spark, "rerun")
    first = silver.load(store, staged(spark, sf))["factTransaction"].select("transactionKey", F.col("modifiedDatetime").alias("before"))
    second = silver.load(store, staged(spark, sf))["factTransaction"]
    return second.join(first, "transactionKey").agg(
        F.count("*").alias("n"), F.count_if(F.col("modifiedDatetime") != F.col("before")).alias("modified"),
        F.max("transactionKey").alias("lastKey"),
    )


_table_counts = """
counted AS (
  SELECT 'rawChaseCheckingTransaction' AS item, (SELECT count(*) FROM feed_checking) AS n
  UNION ALL SELECT 'rawChaseCreditTransaction', (SELECT count(*) FROM feed_credit)
  UNION ALL SELECT 'dimSourceFile', (SELECT count(*) + 1 FROM dim_file)
  UNION ALL SELECT 'dimFinancialAccount', (SELECT count(*) + 1 FROM dim_account)
  UNION ALL SELECT 'dimSpendingCategory', (SELECT count(*) FROM dim_category)
  UNION ALL SELECT 'dimMerchant', (SELECT count(*) + 1 FROM dim_merchant)
  UNION ALL SELECT 'dimCalendarDate', (SELECT count(*) + 1 FROM dim_date)
  UNION ALL SELECT 'mapMerchantRule', (SELECT count(*) + 1 FROM dim_merchant)
  UNION ALL SELECT 'mapCategoryRule', (SELECT count(*) FROM map_category_rule)
  UNION ALL SELECT 'factTransaction', (SELECT count(*) FROM fact))"""


@query("slv09_population_summary", f"WITH {sql.FEED},{sql.SILVER},{_table_counts}" + """
SELECT item, n AS rowCount FROM counted WHERE item <> 'dimSpendingCategory'
UNION ALL SELECT 'source files read', count(*) FROM feed_files UNION ALL SELECT 'source rows read', sum(rowCount)::BIGINT FROM feed_files""")
def _(spark, sf):
    loaded = layers(spark, sf)
    return silver.population_summary(loaded.stage.metadata, loaded.tables)


# ---- Gold and dashboard ----------------------------------------------------------------------------------------------


def _view(name: str):
    return lambda spark, sf: layers(spark, sf).gold[name]


_category = "parentSpendingCategoryName spendingCategoryName"
query("gld01_monthly_spending", sql.gold("SELECT " + pick(
    f"yearMonth monthStartDate accountType {_category} purchaseTransactionCount refundTransactionCount",
    "grossSpendingAmount refundAmount netSpendingAmount") + " FROM spending"))(_view("vw_MonthlySpendingByCategory"))
query("gld02_monthly_cashflow", sql.gold("SELECT " + pick(
    "yearMonth monthStartDate accountType transactionCount incomeTransactionCount purchaseTransactionCount refundTransactionCount "
    "feeTransactionCount internalPaymentTransactionCount debtPaymentTransactionCount transferTransactionCount",
    "incomeAmount grossPurchaseAmount refundAmount feeAmount internalPaymentAmount debtPaymentAmount netTransferAmount "
    "inflowAmount outflowAmount netCashflowAmount") + " FROM cashflow"))(_view("vw_MonthlyCashflow"))
query("gld03_top_merchants", sql.gold("SELECT " + pick(
    f"merchantDisplayName accountType {_category} purchaseTransactionCount averagePurchaseAmount firstTransactionDate lastTransactionDate",
    "totalSpendingAmount") + " FROM merchants"))(_view("vw_TopMerchantsBySpending"))
query("gld04_uncategorized_summary", sql.gold("SELECT " + pick(
    "yearMonth monthStartDate accountType transactionType transactionEventType transactionCount", "netTransactionAmount")
    + " FROM uncategorized"))(_view("vw_UncategorizedTransactionSummary"))
query("gld05_category_trend", sql.gold("SELECT " + pick(
    f"yearMonth monthStartDate {_category}", "netSpendingAmount previousMonthNetSpendingAmount monthOverMonthChangeAmount")
    + " FROM trend"))(_view("vw_SpendingCategoryTrend"))
_ledger = pick(" ".join(gold.LEDGER_COLUMNS[:-1]), "transactionAmount")
query("gld06_jn01_jn02_transaction_ledger", sql.gold(f"SELECT {_ledger} FROM ledger"))(_view("vw_TransactionLedger"))


@query("dsh01_ag04_summary_metrics", sql.gold("""
SELECT (SELECT sum(netSpendingAmount) FROM spending)::DOUBLE AS totalSpendingAmount, (SELECT sum(incomeAmount) FROM cashflow)::DOUBLE AS totalIncomeAmount,
       (SELECT sum(netCashflowAmount) FROM cashflow)::DOUBLE AS netCashflowAmount,
       (SELECT sum(transactionCount) FROM uncategorized)::BIGINT AS uncategorizedTransactionCount"""))
def _(spark, sf):
    g = layers(spark, sf).gold
    return dashboard.summary_metrics(
        g["vw_MonthlySpendingByCategory"], g["vw_MonthlyCashflow"], g["vw_UncategorizedTransactionSummary"]
    )


def _dollars(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN '-$' ELSE '$' END || format('{{:,.2f}}', abs({c})::DOUBLE)"


@query("dsh01_summary_cards", sql.gold(f"""
SELECT 1::BIGINT AS cardOrder, 'Spending' AS label, {_dollars('sum(netSpendingAmount)')} AS value FROM spending
UNION ALL SELECT 2, 'Income', {_dollars('sum(incomeAmount)')} FROM cashflow
UNION ALL SELECT 3, 'Net Cashflow', {_dollars('sum(netCashflowAmount)')} FROM cashflow
UNION ALL SELECT 4, 'Uncategorized', sum(transactionCount)::VARCHAR FROM uncategorized"""))
def _(spark, sf):
    g = layers(spark, sf).gold
    return dashboard.summary_cards(dashboard.summary_metrics(
        g["vw_MonthlySpendingByCategory"], g["vw_MonthlyCashflow"], g["vw_UncategorizedTransactionSummary"]
    ))


query("dsh02_cashflow_months", sql.gold("""
SELECT yearMonth, min(monthStartDate) AS monthStartDate, sum(inflowAmount)::DOUBLE AS inflowAmount, sum(outflowAmount)::DOUBLE AS outflowAmount,
       sum(netCashflowAmount)::DOUBLE AS netCashflowAmount FROM cashflow GROUP BY 1"""))(
    lambda spark, sf: dashboard.cashflow_months(layers(spark, sf).gold["vw_MonthlyCashflow"]))
query("dsh03_category_top8", sql.gold("""
SELECT parentSpendingCategoryName, spendingCategoryName, sum(purchaseTransactionCount)::BIGINT AS purchaseTransactionCount,
       sum(netSpendingAmount)::DOUBLE AS netSpendingAmount FROM spending GROUP BY 1, 2 ORDER BY 4 DESC, 2 LIMIT 8"""))(
    lambda spark, sf: dashboard.category_top8(layers(spark, sf).gold["vw_MonthlySpendingByCategory"]))
query("dsh04_merchant_top8", sql.gold("""
SELECT merchantDisplayName, sum(purchaseTransactionCount)::BIGINT AS purchaseTransactionCount, sum(totalSpendingAmount)::DOUBLE AS totalSpendingAmount,
       round(avg(averagePurchaseAmount), 6) AS averagePurchaseAmount FROM merchants GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 8"""))(
    lambda spark, sf: dashboard.merchant_top8(layers(spark, sf).gold["vw_TopMerchantsBySpending"]).withColumn(
        "averagePurchaseAmount", F.round("averagePurchaseAmount", 6)))
query("dsh05_uncategorized_top8", sql.gold("""
SELECT yearMonth, accountType, transactionEventType, sum(transactionCount)::BIGINT AS transactionCount, sum(netTransactionAmount)::DOUBLE AS netTransactionAmount
FROM uncategorized GROUP BY 1, 2, 3 ORDER BY 1 DESC, 4 DESC, 2, 3 LIMIT 8"""))(
    lambda spark, sf: dashboard.uncategorized_top8(layers(spark, sf).gold["vw_UncategorizedTransactionSummary"]))
query("dsh06_so02_ledger_ordered", sql.gold(f"SELECT {_ledger} FROM ledger ORDER BY transactionDate DESC, transactionKey DESC"))(
    lambda spark, sf: dashboard.ledger_ordered(layers(spark, sf).gold["vw_TransactionLedger"]))

# ---- ledger analytics --------------------------------------------------------------------------------------------------

WINDOW = dict(start=dt.date(1999, 12, 31), end=dt.date(1996, 1, 1))
_in_window = "transactionDate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"


def _slice(spark, sf, columns=None, **conditions) -> DataFrame:
    return ledger.open_slice(layers(spark, sf).tables, columns=columns, **(conditions or WINDOW))


query("led01_led02_filter", sql.gold(f"""
SELECT {_ledger} FROM ledger WHERE {_in_window} AND accountType = 'creditCard' AND spendingCategoryName = 'Gas'"""))(
    lambda spark, sf: _slice(spark, sf, gold.LEDGER_COLUMNS, account="creditCard", category="Gas", **WINDOW).select(gold.LEDGER_COLUMNS))


def _search(needle: str) -> str:
    fields = [
        "strftime(transactionDate, '%Y-%m-%d')", "CASE accountType WHEN 'checking' THEN 'Checking' ELSE 'Credit card' END",
        "merchantDisplayName", "spendingCategoryName", "transactionType", "transactionEventType",
        "rtrim(rtrim(transactionAmount::VARCHAR, '0'), '.')",
    ]
    return "(" + " OR ".join(f"contains(lower({f}), '{needle}')" for f in fields) + ")"


query("led03_search_text", sql.gold(f"SELECT {_ledger} FROM ledger WHERE {_search('brand#1')}"))(
    lambda spark, sf: _slice(spark, sf, text="  BRAND#1 "))
query("led03_search_amount", sql.gold(f"SELECT {_ledger} FROM ledger WHERE {_search('50.5')}"))(
    lambda spark, sf: _slice(spark, sf, text="50.5"))
query("led04_ag10_date_bounds", sql.gold("SELECT min(transactionDate) AS earliestDate, max(transactionDate) AS latestDate FROM ledger"))(
    lambda spark, sf: ledger.date_bounds(layers(spark, sf).gold["vw_TransactionLedger"]))
query("led05_category_options", sql.gold("SELECT DISTINCT spendingCategoryName FROM ledger"))(
    lambda spark, sf: ledger.category_options(layers(spark, sf).gold["vw_TransactionLedger"]))
query("led06_metric_cards", sql.gold(f"""
SELECT {sql.NET}::DOUBLE AS spendingAmount, {sql.INCOME}::DOUBLE AS incomeAmount, ({sql.INCOME} - {sql.OUTFLOW})::DOUBLE AS netCashflowAmount,
       count(*) FILTER ({sql.OPEN}) AS uncategorizedCount FROM ledger WHERE {_in_window}"""))(
    lambda spark, sf: ledger.metric_cards(_slice(spark, sf)))
query("led06_metric_card_texts", sql.gold(f"""
SELECT unnest([1, 2, 3, 4])::BIGINT AS cardOrder, unnest(['Spending', 'Income', 'Net Cashflow', 'Uncategorized']) AS label, unnest([{_dollars('s')}, {_dollars('i')}, {_dollars('n')}, u::VARCHAR]) AS value
FROM (SELECT {sql.NET} AS s, {sql.INCOME} AS i, {sql.INCOME} - {sql.OUTFLOW} AS n, count(*) FILTER ({sql.OPEN}) AS u FROM ledger WHERE {_in_window})"""))(
    lambda spark, sf: ledger.metric_card_texts(_slice(spark, sf)))
query("led07_insights", sql.gold(f"""
SELECT {sql.event_sum('purchase')}::DOUBLE / {sql.event_count('purchase')} AS averagePurchaseAmount, {sql.event_count('purchase')} AS purchaseCount,
       {sql.event_sum('purchase')}::DOUBLE / count(DISTINCT yearMonth) AS monthlyPaceAmount,
       max(abs(transactionAmount)) FILTER (transactionEventType = 'purchase')::DOUBLE AS largestPurchaseAmount,
       first(merchantDisplayName ORDER BY abs(transactionAmount) DESC, transactionDate DESC, transactionKey DESC)
         FILTER (transactionEventType = 'purchase') AS largestPurchaseMerchant,
       floor((count(*) - count(*) FILTER ({sql.OPEN})) / count(*) * 100 + 0.5)::BIGINT AS categorizedPercent FROM ledger WHERE {_in_window}"""))(
    lambda spark, sf: ledger.insights(_slice(spark, sf, ["transactionKey", "merchantDisplayName"])))


def _period(period: str) -> str:
    key, label = ("strftime(transactionDate, '%Y')",) * 2 if period == "year" else ("yearMonth", "strftime(monthStartDate, '%b %y')")
    return f"""SELECT {key} AS periodKey, {label} AS periodLabel, {sql.INCOME}::DOUBLE AS inflowAmount, {sql.OUTFLOW}::DOUBLE AS outflowAmount,
       ({sql.INCOME} - {sql.OUTFLOW})::DOUBLE AS netCashflowAmount FROM ledger WHERE {_in_window} GROUP BY 1, 2"""


query("led08_cashflow_by_month", sql.gold(_period("month")))(lambda spark, sf: ledger.cashflow_by_period(_slice(spark, sf), "month"))
query("led08_cashflow_by_year", sql.gold(_period("year")))(lambda spark, sf: ledger.cashflow_by_period(_slice(spark, sf), "year"))
query("led09_so03_recent_cashflow", sql.gold(_period("month") + " ORDER BY periodKey DESC LIMIT 6"))(
    lambda spark, sf: ledger.recent_cashflow(_slice(spark, sf)))
query("led10_top_categories", sql.gold(f"""
SELECT spendingCategoryName, {sql.NET}::DOUBLE AS netSpendingAmount FROM ledger WHERE {_in_window} AND transactionEventType IN ('purchase', 'refund')
GROUP BY 1 HAVING {sql.NET} <> 0 ORDER BY 2 DESC, 1 LIMIT 8"""))(lambda spark, sf: ledger.top_categories(_slice(spark, sf)))
query("led11_top_merchants", sql.gold(f"""
SELECT merchantDisplayName, sum(abs(transactionAmount))::DOUBLE AS totalSpendingAmount FROM ledger
WHERE {_in_window} AND transactionEventType = 'purchase' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"""))(
    lambda spark, sf: ledger.top_merchants(_slice(spark, sf, ["merchantDisplayName"])))
query("led12_account_mix", sql.gold(f"""
SELECT accountType, {sql.NET}::DOUBLE AS spendingAmount FROM ledger WHERE {_in_window} GROUP BY 1 HAVING {sql.NET} > 0"""))(
    lambda spark, sf: ledger.account_mix(_slice(spark, sf)))
query("led13_account_share", sql.gold(f"""
SELECT accountType, s::DOUBLE AS spendingAmount, floor(s::DOUBLE / sum(s) OVER ()::DOUBLE * 100 + 0.5)::BIGINT AS sharePercent
FROM (SELECT accountType, {sql.NET} AS s FROM ledger WHERE {_in_window} GROUP BY 1) WHERE s > 0"""))(
    lambda spark, sf: ledger.account_share(_slice(spark, sf)))

# ---- quality -----------------------------------------------------------------------------------------------------------

_sign_issue = """(transactionEventType IN ('purchase', 'fee', 'debtPayment') AND transactionAmount >= 0)
  OR (transactionEventType IN ('income', 'payment', 'refund') AND transactionAmount <= 0)"""
_twice = "(SELECT count(*) FROM (SELECT 1 FROM {0} GROUP BY {1} HAVING count(*) > 1))"
_CHECK_SQL = {
    1: "SELECT (((SELECT count(*) FROM feed_checking) + (SELECT count(*) FROM feed_credit)) <> (SELECT count(*) FROM fact))::BIGINT",
    2: "SELECT ((SELECT count(*) FROM ledger) <> (SELECT count(*) FROM fact))::BIGINT",
    3: "SELECT " + _twice.format("feed_checking", "sourceFileHash, sourceRowNumber"),
    4: "SELECT " + _twice.format("feed_credit", "sourceFileHash, sourceRowNumber"),
    5: "SELECT " + _twice.format("fact", "sourceRowIdentifier"),
    6: "SELECT " + _twice.format("fact", "sourceFileKey, sourceRowNumber"),
    7: """SELECT count(*) FROM fact WHERE sourceFileKey IS NULL OR financialAccountKey IS NULL OR transactionDateKey IS NULL OR postedDateKey IS NULL
        OR merchantKey IS NULL OR spendingCategoryKey IS NULL OR sourceRowIdentifier IS NULL OR transactionType IS NULL
        OR transactionEventType IS NULL OR transactionAmount IS NULL""",
    8: """SELECT count(*) FROM fact WHERE sourceFileKey = -1 OR financialAccountKey = -1 OR transactionDateKey = 19000101 OR postedDateKey = 19000101
        OR merchantKey = -1 OR spendingCategoryKey = -1""",
    9: """SELECT (SELECT count(*) FROM fact WHERE transactionDateKey NOT IN (SELECT calendarDateKey FROM dim_date)
        OR sourceFileKey NOT IN (SELECT sourceFileKey FROM dim_file) OR financialAccountKey NOT IN (SELECT financialAccountKey FROM dim_account)
        OR postedDateKey NOT IN (SELECT calendarDateKey FROM dim_date) OR merchantKey NOT IN (SELECT merchantKey FROM dim_merchant)
        OR merchantRuleKey NOT IN (SELECT merchantKey FROM dim_merchant)
        OR spendingCategoryKey NOT IN (SELECT spendingCategoryKey FROM dim_category)
        OR categoryRuleKey NOT IN (SELECT categoryRuleKey FROM map_category_rule))""",
    10: f"SELECT count(*) FROM fact WHERE {_sign_issue}",
    11: f"SELECT count(*) FROM fact WHERE transactionEventType NOT IN ({', '.join(sql.lit(e) for e in classify.EVENT_TYPES)})",
    12: f"SELECT ((SELECT sum(netSpendingAmount) FROM spending) <> (SELECT {sql.NET} FROM fact))::BIGINT",
    13: f"""SELECT ((SELECT (sum(incomeAmount), sum(outflowAmount), sum(netCashflowAmount)) FROM cashflow)
        <> (SELECT ({sql.INCOME}, {sql.OUTFLOW}, {sql.INCOME} - {sql.OUTFLOW}) FROM fact))::BIGINT""",
    14: "SELECT 0 * (SELECT count(*) FROM ledger)",
}
_checks = {n: f"SELECT {sql.lit(quality.CHECKS[n - 1])} AS checkName, ({body})::BIGINT AS failedRowCount" for n, body in _CHECK_SQL.items()}


def _check(number: int):
    def build(spark, sf):
        loaded = layers(spark, sf)
        return quality.check(number, loaded.tables, loaded.gold)
    return build


for _number, _body in _checks.items():
    if _number == 14:  # looks at column names only; dq14_value_leaks reads the values, tests look at the names
        continue
    query(f"dq{_number:02d}_check", sql.gold(_body))(_check(_number))
_all = " UNION ALL ".join(_checks.values())
query("dq01_dq14_all_checks", sql.gold(_all))(
    lambda spark, sf: quality.all_checks(layers(spark, sf).tables, layers(spark, sf).gold))
_details = sql.values(zip(quality.CHECKS, quality.DETAILS))
query("dq15_integrity_report", sql.gold(
    f"SELECT * FROM ({_all}) JOIN (VALUES {_details}) AS meaning(checkName, detail) USING (checkName) WHERE failedRowCount <> 0"))(
    lambda spark, sf: quality.integrity_report(layers(spark, sf).tables, layers(spark, sf).gold))


@query("dq14_value_leaks", sql.gold(f"""
SELECT 'merchantDisplayName' AS columnName, count(DISTINCT merchantDisplayName) AS leakedValueCount FROM ledger
WHERE merchantDisplayName IN (SELECT {sql.squeeze('description')} FROM unified)"""))
def _(spark, sf):
    loaded = layers(spark, sf)
    return quality.leaked_values(loaded.gold["vw_TransactionLedger"], loaded.tables)


def _pattern(name: str, condition: str) -> str:
    where = f"transactionEventType = 'purchase' AND {sql.OPEN} AND ({condition})"
    return f"count(*) FILTER ({where}) AS {name}Count, coalesce(sum(abs(transactionAmount)) FILTER ({where}), 0)::DOUBLE AS {name}Amount"


_like = lambda *patterns: " OR ".join(f"transactionDescriptionClean LIKE '%{p}%'" for p in patterns)
_debt = ("CAPITAL ONE", "CREDIT CARD", "PAYMNT", " PMT ")
query("dq17_review_patterns", sql.gold(
    f"SELECT {_pattern('possibleInvestmentTransfer', _like('ROBINHOOD'))}, {_pattern('possibleDebtPayment', _like(*_debt))} FROM ledger"))(
    lambda spark, sf: quality.review_report(layers(spark, sf).tables, layers(spark, sf).gold))


@query("dq17_review_patterns_before_rules", sql.gold(
    f"SELECT {_pattern('possibleInvestmentTransfer', _like('ROBINHOOD'))}, {_pattern('possibleDebtPayment', _like(*_debt))} "
    "FROM (SELECT * REPLACE ('purchase' AS transactionEventType, 'Unknown' AS spendingCategoryName) FROM ledger)"))
def _(spark, sf):
    """As if no transaction had been classified, so that the patterns have something to find."""
    loaded = layers(spark, sf)
    rows = quality.described_ledger(loaded.tables, loaded.gold).withColumns(
        {"transactionEventType": F.lit("purchase"), "spendingCategoryName": F.lit("Unknown")}
    )
    return rows.agg(*quality.review_patterns(rows))


_sum_of = lambda *events: " + ".join(sql.event_sum(e) for e in events)
_open_purchase = f"transactionEventType = 'purchase' AND {sql.OPEN}"
_trust = [
    (10, 10, "Row reconciliation", "Bronze checking rows", "(SELECT count(*) FROM feed_checking)::VARCHAR"),
    (10, 20, "Row reconciliation", "Bronze credit rows", "(SELECT count(*) FROM feed_credit)::VARCHAR"),
    (10, 30, "Row reconciliation", "Silver fact rows", "(SELECT count(*) FROM fact)::VARCHAR"),
    (10, 40, "Row reconciliation", "Gold ledger rows", "count(*)::VARCHAR"),
    (10, 50, "Row reconciliation", "Bronze to Silver row difference",
     "((SELECT count(*) FROM feed_checking) + (SELECT count(*) FROM feed_credit) - (SELECT count(*) FROM fact))::VARCHAR"),
    (20, 10, "Hard integrity checks", "Duplicate fact grain rows", _twice.format("fact", "sourceRowIdentifier") + "::VARCHAR"),
    (20, 20, "Hard integrity checks", "Unknown core dimension keys", f"({_CHECK_SQL[8]})::VARCHAR"),
    (20, 30, "Hard integrity checks", "Event sign issues", f"({_CHECK_SQL[10]})::VARCHAR"),
    (30, 10, "Dashboard amount definitions", "Total spending", f"'$' || round({sql.NET}, 2)"),
    (30, 20, "Dashboard amount definitions", "Total income", f"'$' || round({sql.INCOME}, 2)"),
    (30, 30, "Dashboard amount definitions", "Total fees", f"'$' || round({sql.event_sum('fee')}, 2)"),
    (30, 40, "Dashboard amount definitions", "Excluded payment activity",
     f"'$' || round({_sum_of('payment', 'debtPayment', 'transfer')}, 2)"),
    (40, 10, "Review risk", "Uncategorized purchase count", f"(count(*) FILTER ({_open_purchase}))::VARCHAR"),
    (40, 20, "Review risk", "Uncategorized purchase amount", f"'$' || round(sum(abs(transactionAmount)) FILTER ({_open_purchase}), 2)"),
    (40, 30, "Review risk", "Uncategorized share of spending",
     f"round(100 * (sum(abs(transactionAmount)) FILTER ({_open_purchase}))::DOUBLE / {sql.NET}::DOUBLE, 1) || '%'"),
    (40, 40, "Review risk", "Possible investment transfers counted as spending",
     f"(count(*) FILTER ({_open_purchase} AND ({_like('ROBINHOOD')}))) || ' rows / $' || coalesce(sum(abs(transactionAmount)) FILTER ({_open_purchase} AND ({_like('ROBINHOOD')})), 0.00)"),
    (40, 50, "Review risk", "Possible debt payments counted as spending",
     f"(count(*) FILTER ({_open_purchase} AND ({_like(*_debt)}))) || ' rows / $' || coalesce(sum(abs(transactionAmount)) FILTER ({_open_purchase} AND ({_like(*_debt)})), 0.00)"),
]
query("dq16_se02_trust_report", sql.gold(" UNION ALL ".join(
    f"SELECT {a}::BIGINT AS sectionOrder, {b}::BIGINT AS metricOrder, '{c}' AS sectionName, '{d}' AS metricName, "
    f"{'any_value(' + e + ')' if 'SELECT' in e else e} AS metricValue, {sql.lit(quality.METRIC_DETAILS[d])} AS detail FROM ledger"
    for a, b, c, d, e in _trust)))(lambda spark, sf: quality.trust_report(layers(spark, sf).tables, layers(spark, sf).gold))


@query("dq18_row_counts", f"WITH {sql.FEED},{sql.SILVER},{sql.GOLD},{_table_counts}" + """
SELECT CASE WHEN item LIKE 'raw%' THEN 'Bronze' ELSE 'Silver' END AS schemaName, item AS objectName, 'BASE TABLE' AS objectType, n AS rowCount FROM counted
UNION ALL SELECT 'Gold', 'vw_MonthlySpendingByCategory', 'VIEW', count(*) FROM spending
UNION ALL SELECT 'Gold', 'vw_MonthlyCashflow', 'VIEW', count(*) FROM cashflow
UNION ALL SELECT 'Gold', 'vw_TopMerchantsBySpending', 'VIEW', count(*) FROM merchants
UNION ALL SELECT 'Gold', 'vw_UncategorizedTransactionSummary', 'VIEW', count(*) FROM uncategorized
UNION ALL SELECT 'Gold', 'vw_SpendingCategoryTrend', 'VIEW', count(*) FROM trend
UNION ALL SELECT 'Gold', 'vw_TransactionLedger', 'VIEW', count(*) FROM ledger""")
def _(spark, sf):
    return quality.row_counts(layers(spark, sf).tables, layers(spark, sf).gold)


# ---- incremental loading -----------------------------------------------------------------------------------------------

_landed = sql.gold("""
SELECT transactionDate, postedDate, accountType, merchantDisplayName, spendingCategoryName, transactionType, transactionEventType,
       transactionAmount::DOUBLE AS transactionAmount, count(*) AS n FROM ledger GROUP BY ALL""")


def _landed_content(tables: dict[str, DataFrame]) -> DataFrame:
    names = [
        "transactionDate", "postedDate", "accountType", "merchantDisplayName", "spendingCategoryName", "transactionType",
        "transactionEventType", "transactionAmount",
    ]
    return gold.transaction_ledger(tables).groupBy(names).agg(F.count("*").alias("n"))


@query("src_batch_load_from_files", _landed)
def _(spark, sf):
    return _landed_content(landed_layers(spark, sf).tables)


@query("st01_drain_files", _landed)
def _(spark, sf):
    """The same files loaded by a stream, ten per micro-batch."""
    store = new_store(spark, "drained")
    checkpoint = f"{shared_folder(spark)}/drain-{uuid.uuid4().hex}"
    drain(store, landing(spark, sf), checkpoint, files_per_batch=10).awaitTermination()
    return _landed_content({name: store.table(name) for name in schemas.TABLES})


@query("st02_new_files_only", sql.feed(f"SELECT DISTINCT {_part} AS sourceFileName FROM feed_credit"))
def _(spark, sf):
    """Files left to load once all checking files are known."""
    found = files.classify_files(files.file_contents(spark, landing(spark, sf)))
    loaded = landed_layers(spark, sf).tables["dimSourceFile"].filter(F.col("sourceFileType") == schemas.CHECKING_TYPE)
    return files.new_files(found, loaded).select("sourceFileName")
