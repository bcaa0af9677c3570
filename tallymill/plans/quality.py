"""Trust, integrity and privacy checks over the three layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.classify import EVENT_TYPES, OPEN_CATEGORIES
from ..functions.text import collapse
from ..operators.aggregates import count_if, sum_if, unpivot_metrics
from ..operators.constraints import FACT_REFERENCES
from ..operators.joins import lookup, names_like, one_row_join, orphan_counts, unknown_keys
from ..operators.summaries import (
    BITS_OF, DEBT_PATTERNS, INVESTMENT_PATTERNS, MONEY, has_any, key_use, names_are_distinct, repeated_numbers,
)
from ..sources.literals import literal_rows
from .gold import merchant_groups, summary_of

CHECKING, CREDIT, FACT = "rawChaseCheckingTransaction", "rawChaseCreditTransaction", "factTransaction"
# Names of the checks, in their order.
CHECKS = [
    "Bronze total equals Silver.factTransaction",
    "Silver.factTransaction equals Gold.vw_TransactionLedger",
    "Bronze checking source grain has no duplicates",
    "Bronze credit source grain has no duplicates",
    "Silver fact sourceRowIdentifier has no duplicates",
    "Silver fact sourceFileKey/sourceRowNumber has no duplicates",
    "Silver fact required columns have no nulls",
    "Silver fact has no unknown core dimension keys",
    "Silver fact foreign-key joins are complete",
    "Transaction event sign rules hold",
    "Transaction event types are valid",
    "Gold spending reconciles to Silver purchase minus refund",
    "Gold cashflow reconciles to Silver event totals",
    "Gold views do not expose blocked private/raw columns",
]
# Own wording: what a failed check means, in the order of CHECKS.
DETAILS = [
    "Rows were lost or doubled between the Bronze tables and the fact.",
    "A dimension join drops or repeats facts in the ledger.",
    "A checking file and row number occurs more than once.",
    "A card file and row number occurs more than once.",
    "Two facts share a row identifier.",
    "Two facts share a file and row number.",
    "A fact lacks a value that every fact must have.",
    "A fact points at the unknown member of a core dimension.",
    "A fact has a key that its dimension does not know.",
    "An amount has the wrong sign for its event type.",
    "A fact has an event type outside the fixed list.",
    "Monthly spending does not add up to the facts.",
    "Monthly inflow, outflow or net does not add up to the facts.",
    "A reporting view has a column whose name is not meant to leave Silver.",
]
# Blocked name parts.
BLOCKED_PATTERNS = [
    "description", "sourceFile", "accountLastFour", "accountDisplayName", "memo", "balance", "checkOrSlip",
]


# Own wording: what each metric of the trust report says.
METRIC_DETAILS = {
    "Bronze checking rows": "Checking rows that were read from files.",
    "Bronze credit rows": "Card rows that were read from files.",
    "Silver fact rows": "Transactions that came out of the Silver load.",
    "Gold ledger rows": "Transactions that the ledger shows.",
    "Bronze to Silver row difference": "Zero, as every row read makes one transaction.",
    "Duplicate fact grain rows": "Zero: row identifiers that more than one transaction has.",
    "Unknown core dimension keys": "Zero: transactions without a file, account, date, merchant or category of their own.",
    "Event sign issues": "Zero: money that moves the wrong way for its event.",
    "Total spending": "What was bought less what was given back; no transfers between own accounts.",
    "Total income": "Events of type income alone.",
    "Total fees": "Counted with the outflow, not with the spending.",
    "Excluded payment activity": "Payments, debt payments and transfers, which are no spending.",
    "Uncategorized purchase count": "Purchases that no rule has given a category; they do count as spending.",
    "Uncategorized purchase amount": "The part of the spending that nobody has looked at yet.",
    "Uncategorized share of spending": "The larger it is, the less the categories tell.",
    "Possible investment transfers counted as spending": "Open purchases whose text names a broker; a rule may be missing.",
    "Possible debt payments counted as spending": "Open purchases whose text looks like a card payment; a rule may be missing.",
}


def domain_issue() -> Column:
    return ~F.col("transactionEventType").isin(EVENT_TYPES)


def _event(name: str) -> Column:
    return F.col("transactionEventType") == name


def fact_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with what the checks need to know about the fact, from its totals."""
    event = lambda name, column: F.coalesce(F.sum(F.when(_event(name), F.col(column))), F.lit(0)).cast(MONEY)
    number = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("long")
    purchase, refund = event("purchase", "absolute"), event("refund", "absolute")
    return summary_of(tables, "totals").agg(
        number(F.col("n")).alias("factRows"), number(F.col("nullIssues")).alias("nullIssues"),
        number(F.col("unknownKeys")).alias("unknownKeys"), number(F.col("signIssues")).alias("signIssues"),
        number(F.when(domain_issue(), F.col("n"))).alias("domainIssues"),
        event("income", "signed").alias("income"), (purchase - refund).cast(MONEY).alias("spending"),
        (purchase - refund + event("fee", "absolute")).cast(MONEY).alias("outflow"),
    )


def _rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def rows_of(tables: dict[str, DataFrame], table: str, name: str) -> DataFrame:
    """Number of a table's rows as one row: from the commit log where that tells."""
    known = getattr(tables, "counts", {}).get(table)
    return _rows(tables[table], name) if known is None else literal_rows(tables[table].sparkSession, [(known,)], f"{name} long")


LEDGER_KEYS = ["transactionDateKey", "postedDateKey", "financialAccountKey", "merchantKey", "spendingCategoryKey"]


def ledger_rows(tables: dict[str, DataFrame], gold: dict[str, DataFrame], name: str) -> DataFrame:
    """Number of ledger rows as one row. The ledger joins the fact with dimensions of distinct keys, so where every key that
    facts have is in its dimension, it has as many rows as the fact; only otherwise it is computed."""
    sums = getattr(tables, "sums", None)
    if sums and "factTransaction" in tables.counts:
        references = {key: (tables[FACT_REFERENCES[key][0]], FACT_REFERENCES[key][1]) for key in LEDGER_KEYS}
        if unknown_keys(key_use(sums), references).filter("orphanRowCount > 0").isEmpty():
            return rows_of(tables, "factTransaction", name)
    return _rows(gold["vw_TransactionLedger"], name)


def duplicate_groups(df: DataFrame, keys: list[str], name: str = "failedRowCount") -> DataFrame:
    repeated = df.groupBy(keys).agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg(F.count("*").alias(name))


def repeated_rows(tables: dict[str, DataFrame], table: str, keys: list[str], name: str = "failedRowCount") -> DataFrame:
    """Groups of `keys` (a file and row number, or a row's name) with more than one row, as one row.

    Bitmaps of the row numbers tell which files can have such groups; only their rows are grouped. Names are as distinct as
    row numbers where each is its file's own and the number.
    """
    rows, bits = tables[table], getattr(tables, "bits", {}).get(table)
    if bits is None or ("sourceRowNumber" not in keys and not names_are_distinct(bits)):
        return duplicate_groups(rows, keys, name)
    suspects = repeated_numbers(bits)
    if suspects.isEmpty():
        return literal_rows(rows.sparkSession, [(0,)], f"{name} long")
    of_file = F.col(BITS_OF[table][0]).cast("string").eqNullSafe(F.col("file"))
    return duplicate_groups(rows.join(suspects, of_file, "left_semi"), keys, name)


def _failed(column: Column) -> Column:
    return column.cast("long").alias("failedRowCount")


def _differs(same: Column) -> Column:
    return _failed(F.when(same, 0).otherwise(1))


def check(number: int, tables: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """One check (1 to 14) as a single row (checkName, failedRowCount); it reads only what it needs."""
    if number == 1:
        counts = reduce(one_row_join, [rows_of(tables, CHECKING, "b"), rows_of(tables, CREDIT, "c"), rows_of(tables, FACT, "f")])
        result = counts.select(_differs(F.col("b") + F.col("c") == F.col("f")))
    elif number == 2:
        both = one_row_join(rows_of(tables, FACT, "f"), ledger_rows(tables, gold, "g"))
        result = both.select(_differs(F.col("f") == F.col("g")))
    elif number in (3, 4):
        result = repeated_rows(tables, CHECKING if number == 3 else CREDIT, ["sourceFileHash", "sourceRowNumber"])
    elif number in (5, 6):
        result = repeated_rows(tables, FACT, ["sourceRowIdentifier"] if number == 5 else ["sourceFileKey", "sourceRowNumber"])
    elif number in (7, 8, 10, 11):
        issue = {7: "nullIssues", 8: "unknownKeys", 10: "signIssues", 11: "domainIssues"}[number]
        result = fact_totals(tables).select(_failed(F.col(issue)))
    elif number == 9:
        references = {key: (tables[name], dim_key) for key, (name, dim_key) in FACT_REFERENCES.items()}
        sums = getattr(tables, "sums", None)
        found = unknown_keys(key_use(sums), references) if sums else orphan_counts(tables[FACT], references)
        result = found.agg(_failed(F.coalesce(F.sum("orphanRowCount"), F.lit(0))))
    elif number == 12:
        shown = gold["vw_MonthlySpendingByCategory"].agg(F.coalesce(F.sum("netSpendingAmount"), F.lit(0)).cast(MONEY).alias("g"))
        result = one_row_join(shown, fact_totals(tables).select("spending")).select(_differs(F.col("g") == F.col("spending")))
    elif number == 13:
        names = ["incomeAmount", "outflowAmount", "netCashflowAmount"]
        shown = gold["vw_MonthlyCashflow"].agg(*[F.coalesce(F.sum(n), F.lit(0)).cast(MONEY).alias(n) for n in names])
        both = one_row_join(shown, fact_totals(tables).select("income", "outflow"))
        result = both.select(_differs(
            (F.col("incomeAmount") == F.col("income")) & (F.col("outflowAmount") == F.col("outflow"))
            & (F.col("netCashflowAmount") == F.col("income") - F.col("outflow"))
        ))
    else:
        result = blocked_columns(gold).agg(_failed(F.count("*")))
    return result.select(F.lit(CHECKS[number - 1]).alias("checkName"), "failedRowCount")


def all_checks(tables: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """The fourteen checks. Those on fact rows share the fact's totals."""
    names = ["incomeAmount", "outflowAmount", "netCashflowAmount"]
    parts = [
        fact_totals(tables),
        rows_of(tables, CHECKING, "checkingRows"), rows_of(tables, CREDIT, "creditRows"),
        ledger_rows(tables, gold, "ledgerRows"),
        gold["vw_MonthlySpendingByCategory"].agg(F.coalesce(F.sum("netSpendingAmount"), F.lit(0)).cast(MONEY).alias("goldSpending")),
        gold["vw_MonthlyCashflow"].agg(*[F.coalesce(F.sum(n), F.lit(0)).cast(MONEY).alias(n) for n in names]),
    ]
    totals = reduce(one_row_join, parts)
    flag = lambda same: F.when(same, 0).otherwise(1).cast("long")
    cashflow = (
        (F.col("incomeAmount") == F.col("income")) & (F.col("outflowAmount") == F.col("outflow"))
        & (F.col("netCashflowAmount") == F.col("income") - F.col("outflow"))
    )
    values = {
        1: flag(F.col("checkingRows") + F.col("creditRows") == F.col("factRows")),
        2: flag(F.col("factRows") == F.col("ledgerRows")),
        7: F.col("nullIssues"), 8: F.col("unknownKeys"), 10: F.col("signIssues"), 11: F.col("domainIssues"),
        12: flag(F.col("goldSpending") == F.col("spending")), 13: flag(cashflow),
    }
    shared = unpivot_metrics(
        totals, [(CHECKS[n - 1], value) for n, value in values.items()], ["checkName", "failedRowCount"]
    )
    single = [check(n, tables, gold) for n in (3, 4, 5, 6, 9, 14)]
    return reduce(DataFrame.unionByName, [shared, *single])


def integrity_report(tables: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """Failed checks only, with what each means; an empty report means all passed."""
    meaning = F.create_map(*[F.lit(x) for pair in zip(CHECKS, DETAILS) for x in pair])
    failed = all_checks(tables, gold).filter(F.col("failedRowCount") != 0)
    return failed.withColumn("detail", meaning[F.col("checkName")]).orderBy("checkName")


# ---- privacy ---------------------------------------------------------------------------------------------------


def blocked_columns(gold: dict[str, DataFrame]) -> DataFrame:
    """(viewName, columnName, blockedPattern): Gold columns whose name contains a blocked pattern."""
    spark = next(iter(gold.values())).sparkSession
    names = literal_rows(
        spark, [(view, column) for view, df in gold.items() for column in df.columns], "viewName string, columnName string"
    )
    return blocked_names(spark, names)


def blocked_names(spark: SparkSession, names: DataFrame) -> DataFrame:
    patterns = literal_rows(spark, [(p,) for p in BLOCKED_PATTERNS], "blockedPattern string")
    return names_like(names, "columnName", patterns, "blockedPattern").orderBy("viewName", "columnName")


def leaked_values(ledger: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(columnName, leakedValueCount): distinct Gold texts that equal a Bronze description or memo, spaces collapsed."""
    texts = ["merchantDisplayName", "accountType", "spendingCategoryName", "parentSpendingCategoryName", "transactionType"]
    shown = ledger.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("columnName"), F.col(name).alias("value")) for name in texts
    ])).alias("v")).select("v.*").distinct()
    raw = tables[CHECKING].select("description").unionByName(tables[CREDIT].select("description")).unionByName(
        tables[CREDIT].select(F.col("memo").alias("description"))
    ).select(collapse(F.col("description")).alias("value")).filter("value <> ''").distinct()
    leaked = shown.join(raw, "value", "left_semi")
    return leaked.groupBy("columnName").agg(F.count("*").alias("leakedValueCount")).orderBy("columnName")


# ---- reports ---------------------------------------------------------------------------------------------------


def review_patterns(rows: DataFrame) -> list[Column]:
    """Aggregate columns: uncategorised purchases that look like investment transfers or debt payments."""
    columns = []
    for name, patterns in {"possibleInvestmentTransfer": INVESTMENT_PATTERNS, "possibleDebtPayment": DEBT_PATTERNS}.items():
        condition = open_purchase() & has_any(F.col("transactionDescriptionClean"), patterns)
        columns += [
            count_if(condition).alias(f"{name}Count"),
            sum_if(F.abs("transactionAmount"), condition).cast(MONEY).alias(f"{name}Amount"),
        ]
    return columns


def open_purchase() -> Column:
    return _event("purchase") & F.col("spendingCategoryName").isin(OPEN_CATEGORIES)


def described_ledger(tables: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """Ledger figures with the cleaned description. The ledger is the fact plus dimension columns, so the description
    is taken along with the category in one pass instead of joining the ledger back to the fact."""
    names = tables["dimSpendingCategory"].select("spendingCategoryKey", "spendingCategoryName")
    return lookup(tables["factTransaction"], names, ["spendingCategoryKey"], ["transactionKey"], how="inner")


def review_report(tables: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    rows = described_ledger(tables, gold)
    return rows.agg(*review_patterns(rows))


def trust_report(tables: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """Seventeen metrics in four sections: (sectionOrder, metricOrder, sectionName, metricName, metricValue, detail)."""
    names = tables["dimSpendingCategory"].select("spendingCategoryKey", "spendingCategoryName")
    rows = summary_of(tables, "totals").join(names, "spendingCategoryKey")
    absolute = lambda *events: sum_if(F.col("absolute"), F.col("transactionEventType").isin(*events)).cast(MONEY)
    listed = lambda column: F.coalesce(F.sum(F.when(open_purchase(), F.col(column))), F.lit(0))
    amounts = rows.agg(
        (absolute("purchase") - absolute("refund")).cast(MONEY).alias("spending"),
        sum_if(F.col("signed"), _event("income")).cast(MONEY).alias("income"),
        absolute("fee").alias("fees"), absolute("payment", "debtPayment", "transfer").alias("movement"),
        listed("absolute").cast(MONEY).alias("openAmount"), listed("n").cast("long").alias("openCount"),
        *[listed(f"{short}{what}").cast(kind).alias(f"{name}{shown}")
          for short, name in (("investment", "possibleInvestmentTransfer"), ("debt", "possibleDebtPayment"))
          for what, shown, kind in (("Rows", "Count", "long"), ("Amount", "Amount", MONEY))],
    )
    parts = [
        amounts, fact_totals(tables).select("factRows", "unknownKeys", "signIssues"),
        rows_of(tables, CHECKING, "checkingRows"), rows_of(tables, CREDIT, "creditRows"),
        ledger_rows(tables, gold, "ledgerRows"), repeated_rows(tables, FACT, ["sourceRowIdentifier"], "duplicates"),
    ]
    text = lambda c: c.cast("string")
    money = lambda name: F.concat(F.lit("$"), text(F.col(name)))
    share = F.round(F.lit(100.0) * F.col("openAmount").cast("double") / F.nullif(F.col("spending").cast("double"), F.lit(0.0)), 1)
    listed = lambda name: F.concat(text(F.col(f"{name}Count")), F.lit(" rows / $"), text(F.col(f"{name}Amount")))
    # Section and metric names of the trust report.
    counted, hard, defined, risk = (
        "Row reconciliation", "Hard integrity checks", "Dashboard amount definitions", "Review risk",
    )
    metrics = [
        (10, 10, counted, "Bronze checking rows", text(F.col("checkingRows"))),
        (10, 20, counted, "Bronze credit rows", text(F.col("creditRows"))),
        (10, 30, counted, "Silver fact rows", text(F.col("factRows"))),
        (10, 40, counted, "Gold ledger rows", text(F.col("ledgerRows"))),
        (10, 50, counted, "Bronze to Silver row difference",
         text(F.col("checkingRows") + F.col("creditRows") - F.col("factRows"))),
        (20, 10, hard, "Duplicate fact grain rows", text(F.col("duplicates"))),
        (20, 20, hard, "Unknown core dimension keys", text(F.col("unknownKeys"))),
        (20, 30, hard, "Event sign issues", text(F.col("signIssues"))),
        (30, 10, defined, "Total spending", money("spending")),
        (30, 20, defined, "Total income", money("income")),
        (30, 30, defined, "Total fees", money("fees")),
        (30, 40, defined, "Excluded payment activity", money("movement")),
        (40, 10, risk, "Uncategorized purchase count", text(F.col("openCount"))),
        (40, 20, risk, "Uncategorized purchase amount", money("openAmount")),
        (40, 30, risk, "Uncategorized share of spending", F.concat(text(share), F.lit("%"))),
        (40, 40, risk, "Possible investment transfers counted as spending", listed("possibleInvestmentTransfer")),
        (40, 50, risk, "Possible debt payments counted as spending", listed("possibleDebtPayment")),
    ]
    names = ["sectionOrder", "metricOrder", "sectionName", "metricName", "metricValue"]
    meaning = F.create_map(*[F.lit(x) for pair in METRIC_DETAILS.items() for x in pair])
    rows = unpivot_metrics(reduce(one_row_join, parts), metrics, names)
    return rows.withColumn("detail", meaning[F.col("metricName")]).orderBy("sectionOrder", "metricOrder")


def row_counts(tables: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """(schemaName, objectName, objectType, rowCount) for every table and view.

    Tables are counted by the commit log, the ledger by the keys that facts have, the merchant view by its groups; the
    other views are a few sums each. Nothing reads the fact.
    """
    known = {"vw_TransactionLedger": lambda: ledger_rows(tables, gold, "rowCount")}
    if getattr(tables, "sums", None):
        known["vw_TopMerchantsBySpending"] = lambda: _rows(merchant_groups(tables), "rowCount")
    objects = [("Bronze" if n in (CHECKING, CREDIT) else "Silver", n, "BASE TABLE", rows_of(tables, n, "rowCount")) for n in tables]
    objects += [("Gold", n, "VIEW", known[n]() if n in known else _rows(df, "rowCount")) for n, df in gold.items()]
    counted = [
        count.select(F.lit(schema).alias("schemaName"), F.lit(name).alias("objectName"), F.lit(kind).alias("objectType"), "rowCount")
        for schema, name, kind, count in objects
    ]
    return reduce(DataFrame.unionByName, counted).orderBy("schemaName", "objectName")
