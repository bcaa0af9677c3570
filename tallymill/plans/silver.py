"""Bronze and Silver jobs: from staged text rows to the star schema."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_, or_

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.calendar import calendar_columns
from ..functions.classify import default_outcome
from ..functions.display import account_display
from ..functions.text import (
    blank_to_null, clean_text, collapse, date_key, hash16, match_text, money_or_null, natural_key, parse_date,
    parse_money, row_identifier, type_or_unknown,
)
from ..operators.aggregates import duplicates
from ..operators.joins import fits_everywhere, lookup
from ..operators.numbering import dedupe, file_offsets, keys_by_file
from ..operators.rules import classifying_rules, winners_of, with_winner
from ..operators.summaries import repeated_numbers
from ..operators.upsert import changed, insert_ignore, merge_upsert, new_rows
from ..sources.files import Stage
from ..sources.literals import literal_rows
from ..sources.seeds import INSTITUTION, seed_categories, seed_rule_rows
from ..sources.store import Change, Store, materialise, temporary

AUTO_CATEGORY, AUTO_MERCHANT = "Auto Category Rule ", "Auto Merchant Rule "
GRAIN = ["sourceFileHash", "sourceRowNumber"]
CHECKING, CREDIT = schemas.BRONZE_TABLES


# ---- shaping -------------------------------------------------------------------------------------------------


def unify_sources(checking: DataFrame, credit: DataFrame) -> DataFrame:
    """Both source shapes as one; dates and amounts are still text."""
    def shape(rows: DataFrame, account: str, moved: str, posted: str, category) -> DataFrame:
        return rows.select(
            "sourceFileHash", "sourceFileType", F.col("sourceRowNumber").cast("long").alias("sourceRowNumber"),
            F.lit(account).alias("sourceAccountType"), F.col(moved).alias("transactionDateText"),
            F.col(posted).alias("postedDateText"), "description", category.alias("sourceCategoryName"),
            type_or_unknown(F.col("type")).alias("transactionType"), F.col("amount").alias("amountText"),
        )
    no_category = F.lit(None).cast("string")
    return shape(checking, "checking", "postingDate", "postingDate", no_category).unionByName(
        shape(credit, "creditCard", "transactionDate", "postDate", blank_to_null(F.col("category")))
    )


def quarantine(unified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a readable amount, rows without): an alternative to failing the load on the latter."""
    readable = money_or_null(F.col("amountText")).isNotNull()
    return unified.filter(readable), unified.filter(~readable)


def prepare(unified: DataFrame) -> DataFrame:
    """Parsed dates and amounts, cleaned text, the source row's identifier and the default outcome."""
    description = F.col("description")
    kind = [F.col("sourceAccountType"), F.col("transactionType"), F.col("sourceCategoryName")]
    return unified.withColumns({
        "sourceRowIdentifier": row_identifier(),
        "transactionDate": parse_date(F.col("transactionDateText")),
        "postedDate": parse_date(F.col("postedDateText")),
        "transactionDescription": collapse(description),
        "transactionDescriptionClean": clean_text(description),
        "transactionRuleMatchText": match_text(description),
        "transactionAmount": parse_money(F.col("amountText")),
        "outcome": default_outcome(*kind),
    }).drop("transactionDateText", "postedDateText", "description", "amountText")


# ---- dimensions and rule maps ----------------------------------------------------------------------------------


def bronze_columns(table: str) -> list[str]:
    return ["sourceFileName", *(schemas.CHECKING_COLUMNS if "Checking" in table else schemas.CREDIT_COLUMNS)]


def load_bronze(table: str, target: DataFrame, staged: DataFrame, last: int | None = None) -> DataFrame:
    """Every row seen again is updated, every new one added; the grain is (file hash, row number)."""
    names = bronze_columns(table)
    return merge_upsert(table, target, staged.select(*GRAIN, *names), GRAIN, names, last=last)


def dim_source_file(target: DataFrame, metadata: DataFrame) -> DataFrame:
    names = ["sourceFileName", "sourceFileType", "rowCount"]
    files = dedupe(metadata.select("sourceFileHash", *names), ["sourceFileHash"], [F.col("sourceFileName")])
    return merge_upsert(
        "dimSourceFile", target, files, ["sourceFileHash"], names, when=changed(names),
        inserts={"sourceSystemName": F.lit(INSTITUTION)},
    )


def dim_account(target: DataFrame, metadata: DataFrame) -> DataFrame:
    name = account_display(F.col("accountType"), F.col("accountLastFour"))
    accounts = metadata.select("accountType", "accountLastFour").distinct().select(
        F.lit(INSTITUTION).alias("institutionName"), "*", name.alias("accountDisplayName")
    )
    return merge_upsert(
        "dimFinancialAccount", target, accounts, ["institutionName", "accountType", "accountLastFour"],
        ["accountDisplayName"], when=changed(["accountDisplayName"]),
    )


def observed_dates(prepared: DataFrame) -> DataFrame:
    both = F.explode(F.array("transactionDate", "postedDate")).alias("d")
    dates = prepared.select(both).filter(F.col("d").isNotNull()).distinct()
    return dates.select(*calendar_columns(F.col("d")))


def dim_calendar(target: DataFrame, prepared: DataFrame) -> DataFrame:
    dates = observed_dates(prepared)
    return merge_upsert(
        "dimCalendarDate", target, dates, ["calendarDateKey"],
        [c for c in dates.columns if c != "calendarDateKey"], when=changed(["calendarDate", "yearMonth"]),
    )


def observed_merchants(prepared: DataFrame) -> DataFrame:
    # Repeated spellings go by hash before the least one is looked for, which sorts; dealt out in between, as the optimizer
    # would make one step of both.
    name, spelling = F.col("transactionDescriptionClean"), F.col("transactionDescription")
    spellings = prepared.filter(spelling != "").select(
        name.alias("merchantNormalizedName"), spelling.alias("merchantDisplayName")).distinct().repartition("merchantNormalizedName")
    return spellings.groupBy("merchantNormalizedName").agg(F.min("merchantDisplayName").alias("merchantDisplayName"))


def merchant_source(target: DataFrame, prepared: DataFrame) -> DataFrame:
    """One row per cleaned description of this load; the lowest spelling is displayed, over all loads so far."""
    seen = target.filter(F.col("merchantKey") > 0).select("merchantNormalizedName", "merchantDisplayName")
    known = materialise(observed_merchants(prepared), "merchants").withColumnRenamed("merchantDisplayName", "_new")
    return known.join(seen, "merchantNormalizedName", "left").select(
        "merchantNormalizedName", F.least("_new", "merchantDisplayName").alias("merchantDisplayName")
    )


def merchant_rule_source(merchants: DataFrame) -> DataFrame:
    """One exact rule per merchant."""
    name = F.concat(F.lit(AUTO_MERCHANT), hash16(F.col("merchantNormalizedName"), F.col("merchantKey")))
    return merchants.filter(F.col("merchantKey") > 0).select(
        name.alias("ruleName"), F.lit("exact").alias("descriptionMatchType"),
        F.col("merchantNormalizedName").alias("descriptionMatchText"), "merchantKey",
        F.lit(10).alias("rulePriority"),
    )


def upsert_growing(
    change: Change, current: Store, table: str, source: DataFrame, keys: list[str], update: list[str],
    order: list[str], reactivate: bool = False,
) -> None:
    """Upsert into a table that grows with the data: new rows become a new part, and of the existing parts only
    those with a row that changes are rewritten."""
    target = current.table(table)
    options = dict(update=update, when=changed(update), reactivate=reactivate, order=order)
    if not current.parts(table):
        change.put(table, merge_upsert(table, target, source, keys, **options))
        return
    same = reduce(and_, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    stale = changed(update) | ~F.col("t.isActive") if reactivate else changed(update)
    differing = materialise(
        target.alias("t").join(source.alias("s"), same).filter(stale).select(*[f"t.{k}" for k in keys]), "differing"
    )
    parts = current.parts_with(table, keys[-1], differing)
    if parts:
        again = source.join(differing, keys, "left_semi")
        change.replace(table, parts, merge_upsert(table, current.table(table, parts=parts), again, keys, **options))
    fresh = materialise(source.join(target.select(keys), keys, "left_anti"), "fresh")
    if not fresh.isEmpty():
        change.append(table, new_rows(table, fresh, order, change.last_key(table)))


RULE_TEXTS = [
    "sourceAccountType", "sourceCategoryName", "transactionType", "descriptionMatchType", "descriptionMatchText",
]
RULE_VALUES = [*RULE_TEXTS, "spendingCategoryKey", "transactionEventType", "categoryAssignmentSource", "rulePriority"]


def upsert_rules(target: DataFrame, rules: DataFrame, order: list[str], unconditional: bool = False) -> DataFrame:
    """Rules are identified by name; a matched rule is switched on again."""
    when = F.lit(True) if unconditional else changed(RULE_VALUES, nullable=RULE_TEXTS)
    return merge_upsert(
        "mapCategoryRule", target, rules, ["ruleName"], RULE_VALUES, when=when, reactivate=True, order=order
    )


def deactivate_rules(rules: DataFrame) -> DataFrame:
    """Switch off generated rules that match on descriptions, which later versions no longer generate."""
    old = (
        F.col("ruleName").startswith(AUTO_CATEGORY) & (F.col("categoryAssignmentSource") == "rule")
        & F.col("descriptionMatchType").isNotNull()
    )
    return rules.withColumns({
        "isActive": F.when(old, False).otherwise(F.col("isActive")),
        "modifiedDatetime": F.when(old, F.current_timestamp()).otherwise(F.col("modifiedDatetime")),
    })


def seed_category_rules(target: DataFrame, categories: DataFrame) -> DataFrame:
    """The system rules, with category names resolved; they get the first keys in seed order."""
    keys = categories.select("spendingCategoryName", "spendingCategoryKey")
    rules = seed_rule_rows(target.sparkSession).join(keys, "spendingCategoryName").drop("spendingCategoryName")
    return upsert_rules(deactivate_rules(target), rules, order=["seedOrder"])


def category_keys(categories: DataFrame) -> DataFrame:
    return categories.select(
        F.col("spendingCategoryName").alias("defaultCategory"), F.col("spendingCategoryKey").alias("defaultCategoryKey")
    )


def auto_rule_name() -> Column:
    empty = F.lit(None).cast("string")
    return F.concat(F.lit(AUTO_CATEGORY), hash16(
        F.col("sourceAccountType"), F.col("sourceCategoryName"), F.col("transactionType"), empty, empty,
        F.col("defaultCategoryKey"), F.col("outcome.event"), F.col("outcome.source"),
    ))


def observed_kinds(prepared: DataFrame, categories: DataFrame) -> DataFrame:
    """The distinct (account, category, type) combinations with their default outcome and auto rule name."""
    kinds = prepared.select("sourceAccountType", "sourceCategoryName", "transactionType").distinct()
    outcome = default_outcome(F.col("sourceAccountType"), F.col("transactionType"), F.col("sourceCategoryName"))
    kinds = kinds.withColumn("outcome", outcome).withColumn("defaultCategory", F.col("outcome.category"))
    return (
        kinds.join(category_keys(categories), "defaultCategory", "left")
        .withColumn("defaultCategoryKey", F.coalesce("defaultCategoryKey", F.lit(-1)))
        .withColumn("ruleName", auto_rule_name())
    )


def derive_category_rules(target: DataFrame, kinds: DataFrame) -> DataFrame:
    """One rule per observed kind, so that every default outcome can be traced to a rule."""
    none = F.lit(None).cast("string")
    rules = kinds.select(
        "ruleName", "sourceAccountType", "sourceCategoryName", "transactionType",
        none.alias("descriptionMatchType"), none.alias("descriptionMatchText"),
        F.col("defaultCategoryKey").alias("spendingCategoryKey"), F.col("outcome.event").alias("transactionEventType"),
        F.col("outcome.source").alias("categoryAssignmentSource"), F.col("outcome.priority").alias("rulePriority"),
    )
    order = [-F.col("rulePriority"), F.col("transactionEventType"), F.col("categoryAssignmentSource")]
    return upsert_rules(target, dedupe(rules, ["ruleName"], order), order=["ruleName"])


# ---- fact ------------------------------------------------------------------------------------------------------


def _file_keys(files: DataFrame, metadata: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per file hash: file key, and the account key for rows of either account type."""
    last_four = dedupe(
        metadata.select("sourceFileHash", "accountLastFour", "sourceFileName"), ["sourceFileHash"],
        [F.col("sourceFileName")],
    ).select("sourceFileHash", "accountLastFour")
    of_bank = accounts.filter(F.col("institutionName") == INSTITUTION).groupBy("accountLastFour").agg(
        F.max(F.when(F.col("accountType") == "checking", F.col("financialAccountKey"))).alias("_checking"),
        F.max(F.when(F.col("accountType") == "creditCard", F.col("financialAccountKey"))).alias("_card"),
    )
    known = last_four.join(of_bank, "accountLastFour", "left").drop("accountLastFour")
    return files.select("sourceFileHash", "sourceFileKey").join(known, "sourceFileHash", "left")


def auto_outcomes(kinds: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (account, category, type) its auto rule's key and category, written out, so that a join sees the true size."""
    auto = rules.select("ruleName", F.col("categoryRuleKey").alias("_autoRule"), F.col("spendingCategoryKey").alias("_autoCategory"))
    return materialise(kinds.join(auto, "ruleName", "left").select(
        "sourceAccountType", F.coalesce("sourceCategoryName", F.lit("")).alias("_category"), "transactionType",
        "defaultCategoryKey", "_autoRule", "_autoCategory", F.col("outcome.event").alias("_defaultEvent"),
    ), "kinds")


def classified(rows: DataFrame, kinds: DataFrame, winners: DataFrame, spread: list[str], whole: bool = False) -> DataFrame:
    """Rows of the unified shape with the category, rule and event that `winners_of` and `auto_outcomes` give them."""
    unknown = F.lit(-1).cast("long")
    rows = with_winner(rows, winners, spread, whole).withColumn("_category", F.coalesce("sourceCategoryName", F.lit("")))
    kinds = F.broadcast(kinds) if whole else kinds
    return lookup(rows, kinds, ["sourceAccountType", "_category", "transactionType"], spread).withColumns({
        "spendingCategoryKey": F.coalesce("winner.spendingCategoryKey", "_autoCategory", "defaultCategoryKey", unknown),
        "categoryRuleKey": F.coalesce("winner.categoryRuleKey", "_autoRule", unknown),
        "transactionEventType": F.coalesce("winner.transactionEventType", "_defaultEvent"),
    }).drop("winner", "_category", "defaultCategoryKey", "_autoRule", "_autoCategory", "_defaultEvent")


def fact_lookups(
    prepared: DataFrame, metadata: DataFrame, kinds: DataFrame, tables: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """What facts are looked up in: outcomes by kind, winners of the rules, files and merchants. Every table has one row
    per key, so there is one fact per prepared row."""
    rules = tables["mapCategoryRule"]
    # One row per (account, category, type): the auto rule is resolved here instead of once per transaction.
    # Lookup tables are written out first, so that the broadcast decision sees their true size.
    kinds = auto_outcomes(kinds, rules)
    files = materialise(_file_keys(tables["dimSourceFile"], metadata, tables["dimFinancialAccount"]), "file-keys")
    merchant_rules = tables["mapMerchantRule"].filter(F.col("descriptionMatchType") == "exact").select(
        F.col("descriptionMatchText").alias("merchantNormalizedName"), "merchantKey", "merchantRuleKey"
    )
    # A merchant has at most one exact rule for its own name, so both keys come with one lookup; so does the text that
    # rules are compared with, which depends on the letters and digits of the upper-case text alone.
    merchants = materialise(
        tables["dimMerchant"].select("merchantNormalizedName", "merchantKey")
        .join(merchant_rules, ["merchantNormalizedName", "merchantKey"], "left")
        .withColumn("_text", match_text(F.col("merchantNormalizedName")))
        .withColumnRenamed("merchantNormalizedName", "transactionDescriptionClean"), "merchant-keys"
    )
    winners = winners_of(prepared, classifying_rules(rules))
    return {"kinds": kinds, "winners": winners, "files": files, "merchants": merchants}


# `_later`: the key of the posting date less that of the transaction's.
NARROW = [
    "sourceRowNumber", "transactionDateKey", "_later", "transactionAmount", "sourceFileKey", "sourceAccountType",
    "sourceFileType", "transactionType", "sourceCategoryName", "transactionDescription",
]


def narrow_facts(prepared: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """What a fact is made of, with its file's key, the file's hash and accounts; `fact_rows` looks up all else."""
    day, posted = date_key(F.col("transactionDate")), date_key(F.col("postedDate"))
    rows = prepared.withColumns({"transactionDateKey": day, "postedDateKey": posted, "_later": posted - day})
    return lookup(rows, found["files"], ["sourceFileHash"], GRAIN, how="inner").select(
        *NARROW, "postedDateKey", "sourceFileHash", "_checking", "_card")


def fact_rows(narrow: DataFrame, found: dict[str, DataFrame], whole: bool = False) -> DataFrame:
    """Staged facts: all keys resolved, final category and event chosen, but without the columns that
    `with_texts` adds. `whole`: rows have the NARROW columns alone, and all lookup tables are sent to them."""
    spread = ["sourceRowNumber"] if whole else GRAIN
    if whole:
        narrow = narrow.withColumn("postedDateKey", F.col("transactionDateKey") + F.col("_later"))
        narrow = lookup(narrow, F.broadcast(found["files"]), ["sourceFileKey"], spread, how="inner")
    rows = narrow.withColumn("transactionDescriptionClean", F.upper("transactionDescription"))
    merchants = F.broadcast(found["merchants"]) if whole else found["merchants"]
    rows = lookup(rows, merchants, ["transactionDescriptionClean"], spread, {"merchantKey": -1, "merchantRuleKey": -1})
    rows = rows.withColumn("transactionRuleMatchText", F.coalesce("_text", match_text(F.col("transactionDescription"))))
    rows = classified(rows, found["kinds"], found["winners"], spread, whole)

    account = F.when(F.col("sourceAccountType") == "checking", F.col("_checking")).otherwise(F.col("_card"))
    unknown = F.lit(-1).cast("long")
    return rows.select(
        *[c for c in ("transactionKey",) if c in rows.columns],
        "sourceFileKey",
        F.coalesce(account, unknown).alias("financialAccountKey"),
        "transactionDateKey",
        "postedDateKey",
        "merchantKey",
        "merchantRuleKey",
        "spendingCategoryKey",
        "categoryRuleKey",
        *GRAIN,
        "sourceFileType",
        "transactionDescription",
        "sourceCategoryName",
        "transactionType",
        "transactionEventType",
        "transactionAmount",
    )


def with_texts(staged: DataFrame) -> DataFrame:
    """Staged facts with the long texts that are made of their other columns. New facts get them where they are written."""
    return staged.withColumns({
        "transactionDescriptionClean": F.upper("transactionDescription"), "sourceRowIdentifier": row_identifier(),
    }).withColumn("transactionNaturalKey", natural_key())


FACT_TEXTS = ["transactionDescription", "transactionDescriptionClean", "sourceCategoryName"]
FACT_VALUES = [
    "sourceFileKey", "financialAccountKey", "transactionDateKey", "postedDateKey", "merchantKey", "merchantRuleKey",
    "spendingCategoryKey", "categoryRuleKey", "transactionNaturalKey", *FACT_TEXTS, "transactionType",
    "transactionEventType", "transactionAmount",
]


def merge_facts(target: DataFrame, rows: DataFrame, last: int | None = None) -> DataFrame:
    return merge_upsert(
        "factTransaction", target, rows, ["sourceRowIdentifier"], FACT_VALUES,
        when=changed(FACT_VALUES, nullable=FACT_TEXTS), last=last,
    )


def append_new(
    change: Change, table: str, rows: DataFrame, by: str, offsets: DataFrame, late: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Append rows of files never seen, with keys by file; returns them as written. What `widen` and `late` add,
    constants and audit columns come to the rows where they are written."""
    key, last = schemas.GENERATED_KEYS[table], change.last_key(table)
    placed, number, restored = keys_by_file(rows, key, by, offsets, last), "sourceRowNumber", None
    if widen:
        # The row's number stays behind, too; it follows from the key.
        place = (F.col(key) - max(last, 0)) / schemas.KEY_STEP - F.col("_before")
        restored = lambda moved: widen(lookup(moved, F.broadcast(offsets), [by], [], how="inner").withColumn(number, place.cast("long")).drop("_before"))
        placed = placed.drop(number)
    return change.append(table, placed, lambda rows: new_rows(table, late(rows), [], last), restored)


def same_rows(old: DataFrame, new: DataFrame, by: str, names: list[str]) -> bool:
    """Whether every file of `new` has the same rows in `old`: their number and the sums of two 64-bit hashes of their
    values, NULL as empty text. Rows are not moved. Runs a job."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    hashes = [F.xxhash64(*texts), F.xxhash64(F.lit(by), *reversed(texts))]
    sums = [F.count("*").alias("n"), *[F.sum(h.cast("decimal(20,0)")).alias(f"h{k}") for k, h in enumerate(hashes)]]
    return new.groupBy(by).agg(*sums).join(old.groupBy(by).agg(*sums), [by, "n", "h0", "h1"], "left_anti").isEmpty()


def upsert_by_file(
    change: Change, table: str, rows: DataFrame, by: str, known: DataFrame | None, offsets: DataFrame,
    merge: Callable[[DataFrame, DataFrame, int], DataFrame], late: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    compared: list[str] | None = None, none_new: bool = False,
) -> None:
    """Upsert rows whose grain lies within a file. Rows of files never seen are appended, untouched by any join
    with the table; rows of known files (`known` has their `by` values) are merged into the parts that hold those
    files, and only these parts are rewritten. `none_new`: all files are known; rows that are as they were are not written."""
    if known is not None:
        parts = change.store.parts_with(table, by, known)
        if none_new and compared is not None:
            if same_rows(change.store.table(table, parts=parts), late(rows), by, compared):
                return
            compared = None
        rows = materialise(rows, "rows")
        again = lookup(rows, known.select(by), [by], ["sourceRowNumber"], how="left_semi")
        old, again = change.store.table(table, parts=parts), late(again)
        if compared is None or not same_rows(old, again, by, compared):
            change.replace(table, parts, merge(old, again, change.last_key(table)))
        rows = lookup(rows, known.select(by), [by], ["sourceRowNumber"], how="left_anti")
        if rows.isEmpty():
            return
    append_new(change, table, rows, by, offsets, late)


def files_as_before(current: Store, table: str, staged: DataFrame, known: DataFrame) -> tuple[DataFrame, list[str]] | None:
    """(sourceFileHash, _base, createdDatetime) of the staged files, and the parts that hold them, if each of these files has
    the row numbers 1 to n both here and in the table, and keys that go by them from a base. None if any is otherwise.

    `staged` has no row number twice in a file; that the table has none is told by its bitmaps. Rows are not moved."""
    number, key = F.col("sourceRowNumber"), schemas.GENERATED_KEYS[table]
    now = staged.groupBy("sourceFileHash").agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"))
    files, parts = known.select("sourceFileHash"), current.parts_with(table, "sourceFileHash", known)
    bits = current.tables().bits.get(table)
    if parts and (bits is None or not repeated_numbers(bits).join(files, F.col("file").isNull() | (F.col("file") == F.col("sourceFileHash")), "left_semi").isEmpty()):
        return None
    base = F.col(key) - number * schemas.KEY_STEP
    before = lookup(current.table(table, parts=parts), files, ["sourceFileHash"], ["sourceRowNumber"], how="left_semi")
    before = before.groupBy("sourceFileHash").agg(
        F.count("*").alias("_n"), F.min(number).alias("_low"), F.max(number).alias("_high"), F.min(base).alias("_base"),
        F.max(base).alias("_top"), F.min("createdDatetime").alias("createdDatetime"), F.max("createdDatetime").alias("_last"))
    both = materialise(now.join(before, "sourceFileHash", "full"), "bases")
    same = "low = 1 AND n = high AND _low = 1 AND _n = _high AND n = _n AND _base = _top AND createdDatetime = _last"
    return (both, parts) if both.filter(f"NOT coalesce({same}, false)").isEmpty() else None


def renew(change: Change, table: str, rows: DataFrame, bases: DataFrame, parts: list[str]) -> DataFrame:
    """Bronze rows of files that are as before take the place of those that are there, with their keys and time of creation;
    the other rows of the parts stay. Nothing is joined row by row. Returns the new rows."""
    kept = bases.select("sourceFileHash", "_base", "createdDatetime")
    key = (F.col("_base") + F.col("sourceRowNumber") * schemas.KEY_STEP).cast("long")
    rows = lookup(rows, kept, ["sourceFileHash"], ["sourceRowNumber"], how="inner").withColumn(schemas.GENERATED_KEYS[table], key)
    old = lookup(change.store.table(table, parts=parts), kept.select("sourceFileHash"), ["sourceFileHash"], ["sourceRowNumber"], how="left_anti")
    written = change.replace(table, parts, old.unionByName(new_rows(table, rows, [], None)))
    return lookup(written, kept.select("sourceFileHash"), ["sourceFileHash"], ["sourceRowNumber"], how="left_semi")


def unique_grain(staged: DataFrame) -> DataFrame:
    """Staged rows, one per file and row number. Only the two grain columns are shuffled unless a row is doubled."""
    if duplicates(staged, GRAIN).isEmpty():
        return staged
    return materialise(dedupe(staged, GRAIN, [F.col("sourceFileName")]), "deduped")


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Run independent Spark jobs side by side, so that small ones do not leave the cluster idle."""
    threaded = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [running.result() for running in [pool.submit(job) for job in threaded]]


def load(store: Store, stage: Stage, fresh: bool = False) -> dict[str, DataFrame]:
    """Load staged input into all Bronze and Silver tables and commit them together.

    Rerunning with the same input changes nothing. `fresh` rebuilds every table from this input alone (full
    refresh); readers keep seeing the old tables until the commit. Intermediate results go when it is made.
    """
    with temporary(store.spark):
        return _load(store, stage, fresh)


def _load(store: Store, stage: Stage, fresh: bool) -> dict[str, DataFrame]:
    change = store.begin()
    current = Store(store.spark, f"{store.root}/none") if fresh else store
    if fresh:
        for table in schemas.TABLES:
            change.drop(table)
    metadata = materialise(stage.metadata, "metadata")
    seen = current.table("dimSourceFile").filter(F.col("sourceFileKey") > 0)
    known = seen.join(metadata.select("sourceFileHash"), "sourceFileHash", "left_semi")
    known = materialise(known.select("sourceFileHash", "sourceFileKey"), "known")
    if known.isEmpty():
        known = None
    # New rows that are numbered go into Bronze as they are, and its new part is the copy that all else reads, unless
    # they come from a copy already.
    straight = known is None and stage.numbered and not stage.written
    checking, credit = stage.checking, stage.credit
    # So do rows of known files, where all are as they were.
    bases, none_new = None, False
    if known is not None:
        none_new = metadata.join(known, "sourceFileHash", "left_anti").isEmpty()
        if stage.numbered and not stage.written and none_new:
            found = together(
                store.spark, lambda: files_as_before(current, CHECKING, checking, known), lambda: files_as_before(current, CREDIT, credit, known))
            bases = None if None in found else dict(zip((CHECKING, CREDIT), found))
    if not straight and bases is None:
        one_per_row = (lambda rows: rows) if stage.numbered else unique_grain
        copy = (lambda rows, what: rows) if stage.written else materialise
        checking, credit = together(
            store.spark, lambda: one_per_row(copy(checking, "checking")), lambda: one_per_row(copy(credit, "credit")))

    def bronze(name: str, staged: DataFrame) -> DataFrame | None:
        rows = staged.select(*GRAIN, *bronze_columns(name))
        if bases:
            return renew(change, name, rows, *bases[name])
        offsets = materialise(file_offsets(staged, "sourceFileHash"), "offsets")
        if straight:
            return append_new(change, name, rows, "sourceFileHash", offsets)
        upsert_by_file(change, name, rows, "sourceFileHash", known, offsets, lambda old, new, last: load_bronze(name, old, new, last))

    def prepared_from(checking: DataFrame, credit: DataFrame) -> DataFrame:
        # The outcome is worked out per kind, the identifier when facts are written; the cleaned text is quickly made.
        rows = prepare(unify_sources(checking, credit)).drop("outcome", "sourceRowIdentifier", "transactionDescriptionClean")
        return materialise(rows, "prepared").withColumn("transactionDescriptionClean", F.upper("transactionDescription"))

    def seeds() -> DataFrame:
        categories = change.put("dimSpendingCategory", insert_ignore(
            current.table("dimSpendingCategory"), seed_categories(store.spark), "spendingCategoryKey"
        ))
        return materialise(seed_category_rules(current.table("mapCategoryRule"), categories), "rules")

    def files() -> None:
        change.put("dimSourceFile", dim_source_file(current.table("dimSourceFile"), metadata))
        change.put("dimFinancialAccount", dim_account(current.table("dimFinancialAccount"), metadata))

    def transactions() -> DataFrame:
        kinds = {CHECKING: schemas.CHECKING_TYPE, CREDIT: schemas.CREDIT_TYPE}
        jobs = [lambda: bronze(CHECKING, checking), lambda: bronze(CREDIT, credit)]
        if not straight and not bases:
            return together(store.spark, lambda: prepared_from(checking, credit), *jobs)[0]
        written = together(store.spark, *jobs)
        return prepared_from(*[rows.withColumn("sourceFileType", F.lit(kind)) for rows, kind in zip(written, kinds.values())])

    prepared, rules, _ = together(store.spark, transactions, seeds, files)
    _transform(change, current, prepared, metadata, known, rules, none_new)
    tables = change.tables()
    change.commit()
    return tables


def _transform(
    change: Change, current: Store, prepared: DataFrame, metadata: DataFrame, known: DataFrame | None, rules: DataFrame,
    none_new: bool = False,
) -> None:
    """What follows from prepared rows: calendar, merchants and rule maps side by side, then the facts."""
    def merchants() -> None:
        upsert_growing(
            change, current, "dimMerchant", merchant_source(current.table("dimMerchant"), prepared),
            ["merchantNormalizedName"], ["merchantDisplayName"], ["merchantNormalizedName"],
        )
        upsert_growing(
            change, current, "mapMerchantRule", merchant_rule_source(change.table("dimMerchant")),
            ["descriptionMatchType", "descriptionMatchText", "merchantKey"], ["ruleName", "rulePriority"],
            ["descriptionMatchText"], reactivate=True,
        )

    def calendar() -> None:
        change.put("dimCalendarDate", dim_calendar(current.table("dimCalendarDate"), prepared))

    def category_rules() -> DataFrame:
        kinds = materialise(observed_kinds(prepared, change.table("dimSpendingCategory")), "kinds")
        change.put("mapCategoryRule", derive_category_rules(rules, kinds))
        return kinds

    def offsets() -> DataFrame:
        keys = change.table("dimSourceFile").select("sourceFileHash", "sourceFileKey")
        longest = prepared.groupBy("sourceFileHash").agg(F.max("sourceRowNumber").alias("sourceRowNumber"))
        return materialise(file_offsets(longest.join(keys, "sourceFileHash"), "sourceFileKey"), "offsets")

    kinds, before, *_ = together(current.spark, category_rules, offsets, merchants, calendar)
    tables = {name: change.table(name) for name in schemas.SILVER_TABLES if name != "factTransaction"}
    found = fact_lookups(prepared, metadata, kinds, tables)
    narrow = narrow_facts(prepared, found)
    if known is None and fits_everywhere(before, *found.values()):
        # Facts are gathered by month before the rest of them is looked up.
        append_new(change, "factTransaction", narrow.select(NARROW), "sourceFileKey", before, with_texts, lambda rows: fact_rows(rows, found, whole=True))
        return
    upsert_by_file(
        change, "factTransaction", fact_rows(narrow, found), "sourceFileKey", known, before, merge_facts, with_texts,
        ["sourceRowIdentifier", *FACT_VALUES], none_new)


# What decides a fact's classification, and what it is now.
DECIDES = ["sourceFileType", "sourceCategoryName", "transactionType", "transactionDescription"]
DECIDED = ["spendingCategoryKey", "categoryRuleKey", "transactionEventType"]


def reclassify(store: Store) -> dict[str, DataFrame]:
    """Classify all facts again, after rules have changed.

    The rules meet the distinct combinations of what decides and what was decided. Facts of the combinations that come
    out otherwise than they are get their new values through a change file; no part of the fact is rewritten.
    """
    with temporary(store.spark):
        return _reclassify(store)


def _reclassify(store: Store) -> dict[str, DataFrame]:
    change = store.begin()
    kinds_of = store.table("dimSourceFile").select("sourceFileKey", "sourceFileType")
    fact = lookup(store.table("factTransaction"), kinds_of, ["sourceFileKey"], ["transactionKey"])
    now = {f"_{c}": F.col(c) for c in DECIDED}
    account = F.when(F.col("sourceFileType") == schemas.CREDIT_TYPE, "creditCard").otherwise("checking")
    seen = fact.groupBy(*DECIDES, *DECIDED).agg(F.count("*").alias("facts"))
    seen = materialise(seen.withColumns({
        "sourceAccountType": account, "transactionRuleMatchText": match_text(F.col("transactionDescription")), **now,
    }).drop(*DECIDED), "combinations")
    kinds = materialise(observed_kinds(seen, store.table("dimSpendingCategory")), "kinds")
    rules = change.put("mapCategoryRule", derive_category_rules(store.table("mapCategoryRule"), kinds))
    again = classified(seen, auto_outcomes(kinds, rules), winners_of(seen, classifying_rules(rules)), ["transactionDescription"])
    other = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DECIDED])
    differing = materialise(again.filter(other).select(*DECIDES, *now, *DECIDED), "differing")
    if not differing.isEmpty():
        keys = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in DECIDES}
        plain = differing.withColumns(keys)
        rows = fact.select("transactionKey", *[F.col(c).alias(f"_{c}") for c in DECIDED], *[value.alias(c) for c, value in keys.items()])
        rows = lookup(rows, plain, [*DECIDES, *now], ["transactionKey"], how="inner")
        change.alter("factTransaction", rows.withColumn("modifiedDatetime", F.current_timestamp()))
    tables = change.tables()
    change.commit()
    return tables


def population_summary(metadata: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(item, rowCount): files and rows read, then rows per loaded table."""
    summary = metadata.agg(F.count("*").alias("f"), F.coalesce(F.sum("rowCount"), F.lit(0)).alias("r")).select(
        F.inline(F.array(
            F.struct(F.lit("source files read").alias("item"), F.col("f").alias("rowCount")),
            F.struct(F.lit("source rows read").alias("item"), F.col("r").alias("rowCount")),
        ))
    )
    for name in schemas.TABLES:
        if name != "dimSpendingCategory":
            known = getattr(tables, "counts", {}).get(name)
            rows = tables[name].agg(F.count("*").alias("rowCount")) if known is None else literal_rows(metadata.sparkSession, [(known,)], "rowCount long")
            summary = summary.unionByName(rows.select(F.lit(name).alias("item"), "rowCount"))
    return summary
