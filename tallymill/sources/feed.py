"""The two transaction shapes derived from order tables, row for row: input for checks and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators.numbering import number_rows
from .files import account_columns

# Fixed values, by position.
CHECKING_DESCRIPTIONS = [
    "CHASE CREDIT CRD  AUTOPAY", "ROBINHOOD   Funds #88", "Zelle payment to  J. Doe", "CAPITAL ONE MOBILE PMT 123",
    "AMAZON CORP SYF PAYMNT", "EPAY *web", "ORIG CO NAME:Acme Water CO ENTRY DESCR:WEB", " Uber  Trip ",
    "Shell Oil 0042", "Trader Joe's #12",
]
CHECKING_KINDS = [
    "ACCT_XFER", "CHASE_TO_PARTNERFI", "ACH_CREDIT", "MISC_CREDIT", "QUICKPAY_CREDIT", "LOAN_PMT",
    "FEE_TRANSACTION", "BILLPAY", "ACH_DEBIT", "DEBIT_CARD", "MISC_DEBIT", " ",
]
CARD_KINDS = ["Sale", "Return", "Payment"]
CARD_CATEGORY_OF_TYPE = {
    "ECONOMY": "Groceries", "SMALL": "Food & Drink", "MEDIUM": "Shopping", "PROMO": "Gas",
    "LARGE": "Fees & Adjustments",
}
LINE_ORDER = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity",
    "l_discount", "l_tax",
]


def _pick(values: list[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _us_date(d: Column) -> Column:
    """MM/dd/yyyy, put together from the ISO text, which is cheaper to make. Years beyond four digits are formatted."""
    iso = F.to_date(d).cast("string")
    turned = F.concat(F.substring(iso, 6, 2), F.lit("/"), F.substring(iso, 9, 2), F.lit("/"), F.substring(iso, 1, 4))
    return F.when(F.length(iso) == 10, turned).otherwise(F.date_format(d, "MM/dd/yyyy"))


def _file_hash(head: str, source: Column, files: int) -> Column:
    """Hash of a source's name; those of the usual sources are literals."""
    hashed = lambda n: F.sha2(F.concat(F.lit(head), n.cast("string")), 256)
    known = F.when(source == 0, hashed(F.lit(0)))
    for n in range(1, files):
        known = known.when(source == n, hashed(F.lit(n)))
    return known.otherwise(hashed(source))


def checking_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, source = F.col("o_orderkey"), F.col("o_custkey") % 4
    value, place = F.format_number("o_totalprice", 2), F.col("o_orderkey") % 12
    incoming = place.between(2, 4)
    # Rows are sorted and numbered as they are; texts are made of them afterwards.
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", source.alias("_source"), "o_totalprice", "o_orderdate")
    numbered = number_rows(orders, ["o_orderkey"], ["_source"], "sourceRowNumber")
    source = F.col("_source")
    rows = numbered.select(
        F.concat(F.lit("Chase"), (source + 1000).cast("string"), F.lit("_Activity.CSV")).alias("sourceFileName"),
        _file_hash("checking-", source, 4).alias("sourceFileHash"),
        F.lit(schemas.CHECKING_TYPE).alias("sourceFileType"),
        F.when(incoming, "CREDIT").otherwise("DEBIT").alias("details"),
        _us_date(F.col("o_orderdate")).alias("postingDate"),
        _pick(CHECKING_DESCRIPTIONS, F.floor(key / 12) % 10).alias("description"),
        F.when(incoming, F.concat(F.lit("$"), value))
        .when(key % 3 == 0, F.concat(F.lit("($"), value, F.lit(")")))
        .otherwise(F.concat(F.lit("-"), value)).alias("amount"),
        _pick(CHECKING_KINDS, place).alias("type"),
        value.alias("balance"),
        F.lit(None).cast("string").alias("checkOrSlipNumber"),
        "sourceRowNumber",
    )
    return rows.select(schemas.struct(schemas.STAGED_CHECKING).names)


def credit_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("_source")
    kind_place = (
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1)
        .when(F.col("l_linenumber") % 2 == 0, 2).otherwise(0)
    )
    lines = _read(spark, sf_dir, "lineitem").select(*LINE_ORDER, kind_place.cast("byte").alias("_kind"))
    category_place = F.lit(0)
    for place, part_type in enumerate(CARD_CATEGORY_OF_TYPE, 1):
        category_place = F.when(F.col("p_type") == part_type, place).otherwise(category_place)
    kind, category = _pick(CARD_KINDS, F.col("_kind")), _pick([" ", *CARD_CATEGORY_OF_TYPE.values()], F.col("_category"))
    value = F.format_number("l_extendedprice", 2)
    parts = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), category_place.cast("byte").alias("_category"), F.concat("p_name", F.lit("  "), "p_brand").alias("_text"))
    # Rows are sorted and numbered with places in lists; texts are made of them afterwards.
    lines = lines.join(parts, "l_partkey").select(*LINE_ORDER, (F.col("l_suppkey") % 3).alias("_source"), "_kind", "_category", "_text")
    numbered = number_rows(lines, LINE_ORDER, ["_source"], "sourceRowNumber", [
        "l_linenumber", "l_shipdate", "l_extendedprice", "_source", "_kind", "_category", "_text"])
    rows = numbered.select(
        F.concat(F.lit("Chase"), (source + 2000).cast("string"), F.lit("_Activity.csv")).alias("sourceFileName"),
        _file_hash("credit-", source, 3).alias("sourceFileHash"),
        F.lit(schemas.CREDIT_TYPE).alias("sourceFileType"),
        _us_date(F.col("l_shipdate")).alias("transactionDate"),
        _us_date(F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber"))).alias("postDate"),
        F.col("_text").alias("description"), category.alias("category"), kind.alias("type"),
        F.concat(F.when(F.col("_kind") == CARD_KINDS.index("Sale"), "-").otherwise(""), value).alias("amount"),
        F.lit(None).cast("string").alias("memo"),
        "sourceRowNumber",
    )
    return rows.select(schemas.struct(schemas.STAGED_CREDIT).names)


def feed_metadata(checking: DataFrame, credit: DataFrame) -> DataFrame:
    lineage = ["sourceFileName", "sourceFileHash", "sourceFileType"]
    files = checking.select(lineage).unionByName(credit.select(lineage)).groupBy(lineage).agg(
        F.count("*").alias("rowCount")
    )
    return files.withColumn("sourceFilePath", F.col("sourceFileName")).withColumns(
        account_columns(F.col("sourceFileName"), F.col("sourceFileType"))
    ).select(schemas.struct(schemas.FILE_METADATA).names)
