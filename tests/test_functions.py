from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymill.functions import classify, display, text
from tallymill.functions.calendar import calendar_columns


@pytest.mark.parametrize("given, expected", [
    ("($1,234.56)", "-1234.56"), ("$900.00", "900.00"), ("-42.10", "-42.10"), (" 1 000.5 ", "1000.50"),
    ("1.005", "1.01"), ("-1.005", "-1.01"), (".5", "0.50"), ("+3", "3.00"), ("1.5e2", "150.00"), ("(5)", "-5.00"),
])
def test_money(column, given, expected):
    assert column(text.parse_money, [given]) == [Decimal(expected)]


@pytest.mark.parametrize("bad", ["--5", "", "abc", None])
def test_bad_money_fails_the_load_even_without_ansi(spark, column, bad):
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(PySparkException):
                column(text.parse_money, [bad])
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_dates(column):
    given = ["01/15/2026", "1/2/2024", "1/2/24", "13/01/2024", "02/30/2024", "01/15/2026x", "", "  ", None]
    found = column(text.parse_date, given)
    assert found[:3] == [dt.date(2026, 1, 15), dt.date(2024, 1, 2), dt.date(24, 1, 2)]
    assert found[3:] == [None] * 6
    assert column(lambda c: text.date_key(text.parse_date(c)), ["01/15/2026", "nonsense"]) == [20260115, 19000101]


def test_cleaning(column):
    given = [" Uber  Trip ", "a\t\nb", "x\x0by", "Trader Joe's #12", None]
    assert column(text.collapse, given) == ["Uber Trip", "a b", "x\x0by", "Trader Joe's #12", None]
    assert column(text.clean_text, given)[0] == "UBER TRIP"
    assert column(text.match_text, given) == ["UBER TRIP", "A B", "X Y", "TRADER JOE S 12", ""]


def test_hash_keeps_the_place_of_nulls(spark):
    import hashlib

    row = spark.range(1).select(text.hash16(F.lit("a"), F.lit(None), F.lit("b")).alias("h")).first()
    assert row.h == hashlib.sha256(b"a||b").hexdigest()[:16]


@pytest.mark.parametrize("merchant, expected", [
    ("ORIG CO NAME:Acme Water CO ENTRY DESCR:WEB", "ACME WATER"),
    ("City Tacos #12", "CITY TACOS"),
    ("ORIG CO NAME:ACH CO ENTRY DESCR:BILL", ""),
    ("a b 12 shop*online/market,food-court extra", "SHOP ONLINE MARKET"),
    ("Café Roma", "CAFÉ ROMA"),
    ("", ""),
])
def test_suggested_text(column, merchant, expected):
    assert column(text.suggested_match_text, [merchant]) == [expected]


def test_default_outcome(spark):
    rows = spark.createDataFrame([
        ("checking", "BILLPAY", None), ("checking", "unknown", None), ("creditCard", "Sale", "Gas"),
        ("creditCard", "Sale", "Fees & Adjustments"), ("creditCard", "Return", None), ("creditCard", "Return", "Travel"),
        ("creditCard", "Payment", "Gas"), ("creditCard", "Fee", "Gas"), ("checking", "Sale", "Gas"),
    ], "a string, k string, c string")
    found = rows.select(classify.default_outcome(F.col("a"), F.col("k"), F.col("c")).alias("o")).select("o.*").collect()
    assert [tuple(r) for r in found] == [
        ("BillsAndUtilities", "purchase", "rule", 70), ("Uncategorized", "other", "fallback", 0),
        ("Gas", "purchase", "chaseMapped", 100), ("Uncategorized", "purchase", "chaseMapped", 100),
        ("Refund", "refund", "fallback", 0), ("Travel", "refund", "chaseMapped", 100),
        ("DebtPayment", "payment", "rule", 50), ("Uncategorized", "other", "fallback", 0),
        ("Uncategorized", "other", "fallback", 0),
    ]


def test_hints(column):
    every = ["Dining", "Gas", "Groceries", "Investments", "Personal", "Transfer", "Transportation"]
    given = ["SCHWAB BROKERAGE", "SHELL OIL", "BUSINESS SUPPLY", "GAS BILL", "PHARMACY", "NOTHING"]
    assert column(lambda c: classify.hint_category(c, every), given) == [
        "Investments", "Gas", "Transportation", "Gas", "Personal", "Personal",
    ]
    assert column(lambda c: classify.hint_category(c, ["Transfer", "Gas"]), ["SCHWAB", "PHARMACY"]) == ["Transfer", "Transfer"]
    # Neither brokerage category is offered: the other patterns are tried.
    assert column(lambda c: classify.hint_category(c, ["Gas", "Dining"]), ["SCHWAB GAS", "X"]) == ["Gas", "Gas"]
    assert column(lambda c: classify.hint_category(c, []), ["X"]) == [""]


def test_display(column):
    amounts = [Decimal("-1234.56"), Decimal("0.00"), Decimal("900.00"), None]
    assert column(display.currency_text, amounts, "decimal(18,2)") == ["-$1,234.56", "$0.00", "$900.00", "$0.00"]
    assert column(display.plain_number, [Decimal("-42.10"), Decimal("900.00"), Decimal("0.00"), Decimal("100.05")],
                  "decimal(18,2)") == ["-42.1", "900", "0", "100.05"]
    assert column(display.month_label, ["2026-01", "odd"]) == ["Jan 26", "odd"]
    assert column(display.whole_percent, [0.125, 0.505, -0.005, 0.9949], "double") == [13, 51, 0, 99]
    assert column(display.account_label, ["creditCard", "checking", "x", None]) == ["Credit card", "Checking", "x", "Unknown"]


def test_calendar(spark):
    row = spark.createDataFrame([(dt.date(2024, 2, 4),)], "d date").select(*calendar_columns(F.col("d"))).first()
    assert tuple(row) == (
        20240204, dt.date(2024, 2, 4), 2024, 1, 2, "February", 2, 4, 7, "Sunday", True, "2024-02",
        dt.date(2024, 2, 1), dt.date(2024, 2, 29),
    )
