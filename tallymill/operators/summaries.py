"""What is kept about the rows of a part, so that totals, counts and checks need no scan of the rows.

Additive summaries are sums by some columns: those of two sets of rows add up, and rows that change are one sum less and
another one more. Row bits are a bitmap of the row numbers of each file, 32,768 to a bitmap, which prove that none is there
twice. All are aggregates with partial sums before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.seeds import UNKNOWN_DATE_KEY, UNKNOWN_KEY

MONEY = "decimal(38,2)"
# Columns that must be filled, keys of unknown members, and events by sign.
REQUIRED = [
    "sourceFileKey", "financialAccountKey", "transactionDateKey", "postedDateKey", "merchantKey",
    "spendingCategoryKey", "sourceRowIdentifier", "transactionType", "transactionEventType", "transactionAmount",
]
UNKNOWN = {
    "sourceFileKey": UNKNOWN_KEY, "financialAccountKey": UNKNOWN_KEY, "transactionDateKey": UNKNOWN_DATE_KEY,
    "postedDateKey": UNKNOWN_DATE_KEY, "merchantKey": UNKNOWN_KEY, "spendingCategoryKey": UNKNOWN_KEY,
}
NEGATIVE_EVENTS, POSITIVE_EVENTS = ["purchase", "fee", "debtPayment"], ["income", "payment", "refund"]
# Texts of investment transfers and debt payments.
INVESTMENT_PATTERNS, DEBT_PATTERNS = ["ROBINHOOD"], ["CAPITAL ONE", "CREDIT CARD", "PAYMNT", " PMT "]
# Fact keys whose use is counted by themselves; the others are among the columns of the sums.
COUNTED_KEYS = ["sourceFileKey", "postedDateKey", "merchantRuleKey", "categoryRuleKey"]

# All columns that the sums are made of.
SUMMARISED = [*REQUIRED, *COUNTED_KEYS, "transactionDescriptionClean"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def null_issue() -> Column:
    return any_of([F.col(name).isNull() for name in REQUIRED])


def unknown_issue() -> Column:
    return any_of([F.col(name) == value for name, value in UNKNOWN.items()])


def sign_issue() -> Column:
    event, amount = F.col("transactionEventType"), F.col("transactionAmount")
    return (event.isin(NEGATIVE_EVENTS) & (amount >= 0)) | (event.isin(POSITIVE_EVENTS) & (amount <= 0))


def has_any(text: Column, patterns: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in patterns])


@dataclass(frozen=True)
class Summary:
    """Sums of `measures` (name, type) by the columns `by` (name, type); `shape` turns rows into those columns."""

    by: dict[str, str]
    measures: dict[str, str]
    shape: Callable[[DataFrame], DataFrame]

    @property
    def ddl(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in {**self.by, **self.measures}.items())

    def added(self, shaped: DataFrame) -> DataFrame:
        return shaped.groupBy(*self.by).agg(*[F.sum(m).cast(kind).alias(m) for m, kind in self.measures.items()])

    def of(self, rows: DataFrame) -> DataFrame:
        return self.added(self.shape(rows))

    def moved(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """What a change of rows from `old` to `new` adds: sums that are all zero are left out."""
        less = self.of(old).withColumns({m: (-F.col(m)).cast(kind) for m, kind in self.measures.items()})
        both = self.added(self.of(new).unionByName(less))
        return both.filter(any_of([F.col(m) != 0 for m in self.measures]))


def _totals(rows: DataFrame) -> DataFrame:
    amount = F.coalesce("transactionAmount", F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    looks = {name: F.coalesce(has_any(F.col("transactionDescriptionClean"), patterns), F.lit(False)) for name, patterns in (
        ("investment", INVESTMENT_PATTERNS), ("debt", DEBT_PATTERNS))}
    return rows.select(
        "transactionDateKey", "financialAccountKey", "spendingCategoryKey", "transactionType", "transactionEventType",
        F.lit(1).cast("long").alias("n"), amount.cast(MONEY).alias("signed"), F.abs(amount).cast(MONEY).alias("absolute"),
        flag(null_issue()).alias("nullIssues"), flag(unknown_issue()).alias("unknownKeys"), flag(sign_issue()).alias("signIssues"),
        *[c.cast("long").alias(f"{name}Rows") for name, c in looks.items()],
        *[F.when(c, F.abs(amount)).otherwise(0).cast(MONEY).alias(f"{name}Amount") for name, c in looks.items()],
    )


def _merchants(rows: DataFrame) -> DataFrame:
    return rows.select("merchantKey", "financialAccountKey", "spendingCategoryKey", F.lit(1).cast("long").alias("n"))


def _keys(rows: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("keyColumn"), F.col(k).alias("key")) for k in COUNTED_KEYS])
    return rows.select(F.inline(pairs)).withColumn("n", F.lit(1).cast("long"))


# Kept for every part of the fact, and for its change files.
SUMMARIES = {
    "totals": Summary(
        {"transactionDateKey": "long", "financialAccountKey": "long", "spendingCategoryKey": "long", "transactionType": "string",
         "transactionEventType": "string"},
        {"n": "long", "signed": MONEY, "absolute": MONEY, "nullIssues": "long", "unknownKeys": "long", "signIssues": "long",
         "investmentRows": "long", "debtRows": "long", "investmentAmount": MONEY, "debtAmount": MONEY}, _totals),
    "merchants": Summary({"merchantKey": "long", "financialAccountKey": "long", "spendingCategoryKey": "long"}, {"n": "long"}, _merchants),
    "keys": Summary({"keyColumn": "string", "key": "long"}, {"n": "long"}, _keys),
}

def key_use(sums: dict[str, DataFrame]) -> DataFrame:
    """(keyColumn, keyValue, rowCount): how many facts have each key, from the summaries."""
    def of(sum_name: str, key: str) -> DataFrame:
        return sums[sum_name].groupBy(F.lit(key).alias("keyColumn"), F.col(key).alias("keyValue")).agg(F.sum("n").alias("rowCount"))

    parts = [of("totals", k) for k in ("transactionDateKey", "financialAccountKey", "spendingCategoryKey")]
    parts += [of("merchants", "merchantKey"), sums["keys"].select("keyColumn", F.col("key").alias("keyValue"), F.col("n").alias("rowCount"))]
    return reduce(DataFrame.unionByName, parts)


# ---- row numbers ------------------------------------------------------------------------------------------------------

BITS_DDL = "file string, bucket long, n long, bits binary, lowName string, highName string, oddNames long"
# The columns that name a row's file, and the row itself (one that no other row of any file has).
BITS_OF = {
    "rawChaseCheckingTransaction": ("sourceFileHash", None), "rawChaseCreditTransaction": ("sourceFileHash", None),
    "factTransaction": ("sourceFileKey", "sourceRowIdentifier"),
}


def row_bits(table: str, rows: DataFrame) -> DataFrame:
    """(file, bucket, n, bits, ...): rows and distinct row numbers per file. A row's name should be one per file, a colon,
    and the row number: lowName and highName are the least and greatest of the first part, oddNames counts other rows."""
    file, name = BITS_OF[table]
    number = F.col("sourceRowNumber")
    place = [F.col(file).alias("file"), F.bitmap_bucket_number(number).alias("bucket")]
    # Bitmaps are made in sorted order; the names, which are wide, are not sorted along but counted by hash before.
    bits = rows.select(*place, F.bitmap_bit_position(number).alias("p")).groupBy("file", "bucket").agg(
        F.count("*").alias("n"), F.bitmap_construct_agg("p").alias("bits"))
    if name:
        # Nothing is before the colon where there is none.
        first = F.left(F.col(name), F.length(name) - F.length(F.substring_index(name, ":", -1)) - 1)
        odd = F.coalesce(F.col(name) != F.concat(first, F.lit(":"), number.cast("string")), F.lit(True))
        named = rows.select(*place, first.alias("name"), odd.alias("odd")).groupBy("file", "bucket", "name").agg(F.count_if("odd").alias("odd"))
        named = named.groupBy("file", "bucket").agg(
            F.min("name").alias("lowName"), F.max("name").alias("highName"), F.sum("odd").alias("oddNames"))
        same = [F.col(f"b.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("file", "bucket")]
        bits = bits.alias("b").join(named.alias("n"), same).select("b.*", "lowName", "highName", "oddNames")
    else:
        none = F.lit(None).cast("string")
        bits = bits.select("*", none.alias("lowName"), none.alias("highName"), F.lit(0).cast("long").alias("oddNames"))
    return bits.withColumn("file", F.col("file").cast("string"))


def repeated_numbers(bits: DataFrame) -> DataFrame:
    """(file): files in which a row number is there twice, or missing."""
    merged = bits.groupBy("file", "bucket").agg(F.sum("n").alias("n"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("distinct"))
    return merged.filter("n <> distinct OR file IS NULL").select("file").distinct()


def names_are_distinct(bits: DataFrame) -> Column | bool:
    """Whether distinct row numbers prove distinct names: every file has a first part of its own. Runs a job."""
    files = bits.groupBy("file").agg(F.min("lowName").alias("low"), F.max("highName").alias("high"), F.sum("oddNames").alias("odd"))
    shared = files.groupBy("low").agg(F.count("*").alias("files"), F.max("high").alias("high"), F.sum("odd").alias("odd"))
    return shared.filter("files > 1 OR low <> high OR odd > 0 OR low IS NULL").isEmpty()
