"""CSV export of ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.display import account_label, currency_text

# Exported columns in order, with their headings.
HEADINGS = {
    "transactionDate": "Date", "accountType": "Account", "merchantDisplayName": "Merchant",
    "spendingCategoryName": "Category", "transactionType": "Type", "transactionAmount": "Amount",
}


def shown(name: str) -> Column:
    column = F.col(name)
    if name == "transactionDate":
        return F.date_format(column, "yyyy-MM-dd")
    if name == "accountType":
        return account_label(column)
    return currency_text(column) if name == "transactionAmount" else column


def export_rows(ledger: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The chosen columns as text under their headings; a missing value is empty text."""
    chosen = [name for name in HEADINGS if columns is None or name in columns]
    return ledger.select(*[F.coalesce(shown(name), F.lit("")).alias(HEADINGS[name]) for name in chosen])


def export_ledger(ledger: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A folder of CSV parts, written in parallel; every field quoted, quotes doubled, text unescaped otherwise."""
    export_rows(ledger, columns).write.options(
        header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, emptyValue='""',
    ).csv(path)
