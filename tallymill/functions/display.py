"""Labels and formatted values shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def currency_text(c: Column) -> Column:
    """`$1,234.56`, `-$1,234.56`; NULL counts as zero."""
    value = F.coalesce(c, F.lit(0).cast("decimal(18,2)"))
    return F.concat(F.when(value < 0, "-$").otherwise("$"), F.format_number(F.abs(value), 2))


def account_display(kind: Column, last_four: Column) -> Column:
    return (
        F.when((kind == "checking") & (last_four != "unknown"), F.concat(F.lit("Chase Checking "), last_four))
        .when(kind == "creditCard", "Chase Credit Card")
        .otherwise("Chase Checking")
    )


def account_label(kind: Column) -> Column:
    return (
        F.when(kind == "creditCard", "Credit card")
        .when(kind == "checking", "Checking")
        .otherwise(F.coalesce(kind, F.lit("Unknown")))
    )


def month_label(year_month: Column) -> Column:
    """`2026-01` as `Jan 26`; other text is passed through."""
    return F.coalesce(F.date_format(F.try_to_timestamp(year_month, F.lit("yyyy-MM")), "MMM yy"), year_month)


def whole_percent(ratio: Column) -> Column:
    """Half-up rounding toward plus infinity, as browsers round."""
    return F.floor(ratio.cast("double") * 100 + F.lit(0.5)).cast("long")


def percent_text(whole: Column) -> Column:
    return F.concat(F.coalesce(whole, F.lit(0)).cast("string"), F.lit("%"))


def plain_number(amount: Column) -> Column:
    """A two-decimal amount in its shortest form: `-42.1`, `900`."""
    return F.regexp_replace(amount.cast("decimal(18,2)").cast("string"), r"\.?0+$", "")
