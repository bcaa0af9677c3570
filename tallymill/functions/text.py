"""Text, money, date and hash columns shared by every layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The whitespace class the SQL layer collapses (no vertical tab), and the wider browser class.
SQL_SPACE = r"[ \t\n\f\r]+"
WIDE_SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
RULE_PUNCTUATION = r"[:*#/,-]"
ORIGIN_COMPANY = "ORIG CO NAME:(.+?) CO ENTRY"
STOP_WORDS = ["ACH", "CO", "DESCR", "ENTRY", "ID", "IND", "NAME", "ORIG", "SEC", "WEB"]

MONEY = "decimal(18,2)"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def type_or_unknown(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("unknown"))


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), SQL_SPACE, " ")


def clean_text(c: Column) -> Column:
    return F.upper(collapse(c))


def match_text(c: Column) -> Column:
    """Upper-case alphanumeric words, one space apart: the text that rules are compared with."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: F.length(t) > 1)


def money_or_null(c: Column) -> Column:
    bare = F.translate(F.trim(c), "$, ", "")
    unwrapped = F.concat(F.lit("-"), F.translate(bare, "()", ""))
    return F.when(bare.startswith("(") & bare.endswith(")"), unwrapped).otherwise(bare).try_cast(MONEY)


def parse_money(c: Column) -> Column:
    """Signed amount; text that is no amount fails the load, with or without ANSI mode."""
    complaint = F.concat(F.lit("not an amount: "), F.coalesce(c, F.lit("NULL")))
    return F.coalesce(money_or_null(c), F.raise_error(complaint).cast(MONEY))


def parse_date(c: Column) -> Column:
    """Dates of two, two and four digits are turned into ISO text, which is cheaper to read than by pattern."""
    text = blank_to_null(c)
    iso = F.concat(F.substring(text, 7, 4), F.lit("-"), F.substring(text, 1, 2), F.lit("-"), F.substring(text, 4, 2))
    plain = F.rlike(text, F.lit(r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z"))
    return F.when(plain, iso.try_cast("date")).otherwise(F.to_date(F.try_to_timestamp(text, F.lit("M/d/y"))))


def date_key(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyyMMdd").cast("long"), F.lit(19000101).cast("long"))


def key_date(k: Column) -> Column:
    return F.to_date(k.cast("string"), "yyyyMMdd")


def piped(*parts: Column) -> Column:
    """Join with '|', NULL as empty text (concat_ws would drop the NULL and its separator)."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return reduce(lambda left, right: F.concat(left, F.lit("|"), right), texts)


def hash16(*parts: Column) -> Column:
    return F.substring(F.sha2(piped(*parts), 256), 1, 16)


def row_identifier() -> Column:
    return F.concat(
        F.col("sourceFileType"), F.lit(":"), F.col("sourceFileHash"), F.lit(":"),
        F.col("sourceRowNumber").cast("string"),
    )


def natural_key() -> Column:
    return F.sha2(
        piped(
            F.col("sourceFileHash"), F.col("sourceRowNumber"), F.col("transactionDescriptionClean"),
            F.col("transactionAmount"), F.col("transactionType"),
        ),
        256,
    )


def upper_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), WIDE_SPACE, " "))


def rule_words(c: Column) -> Column:
    """Words of a merchant name worth keeping in a rule."""
    words = F.split(F.regexp_replace(upper_words(c), RULE_PUNCTUATION, " "), WIDE_SPACE)
    return F.filter(
        words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS) & ~w.rlike("^[0-9]+$")
    )


def origin_company(c: Column) -> Column:
    return F.nullif(F.regexp_extract(upper_words(c), ORIGIN_COMPANY, 1), F.lit(""))


def suggested_match_text(c: Column) -> Column:
    """First three telling words of the origin company if one is named, else of the merchant."""
    return F.array_join(F.slice(rule_words(F.coalesce(origin_company(c), c)), 1, 3), " ")
