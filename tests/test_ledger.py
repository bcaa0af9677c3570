from __future__ import annotations

import csv
import datetime as dt
import glob
from decimal import Decimal

import pytest

from tallymill.plans import dashboard, ledger, suggestions
from tallymill.sources.export import export_ledger

LEDGER = (
    "transactionKey long, transactionDate date, postedDate date, yearMonth string, monthStartDate date, accountType string, "
    "merchantDisplayName string, parentSpendingCategoryName string, spendingCategoryName string, transactionType string, "
    "transactionEventType string, transactionAmount decimal(18,2)"
)


def entry(key, day, account, merchant, category, kind, event, amount):
    d = dt.date.fromisoformat(day)
    return (key, d, d, day[:7], d.replace(day=1), account, merchant, "P", category, kind, event, Decimal(amount))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        entry(100, "2026-01-05", "checking", "Rent", "Home", "ACH_DEBIT", "purchase", "-900.00"),
        entry(200, "2026-01-06", "checking", "Pay", "Income", "ACH_CREDIT", "income", "2000.00"),
        entry(300, "2026-01-07", "creditCard", 'Tacos "12"', "Uncategorized", "Sale", "purchase", "-42.10"),
        entry(400, "2026-02-07", "creditCard", "Tacos #13", "Uncategorized", "Sale", "purchase", "-900.00"),
        entry(500, "2026-02-08", "creditCard", "Shop", "Shopping", "Return", "refund", "50.00"),
        entry(600, "2027-02-08", "checking", "Bank", "Fee", "FEE_TRANSACTION", "fee", "-15.00"),
        entry(700, "2027-02-09", "checking", "Card", "DebtPayment", "LOAN_PMT", "debtPayment", "-500.00"),
    ], LEDGER)


def keys(df):
    return sorted(r.transactionKey for r in df.collect())


def test_filters(rows):
    day = dt.date.fromisoformat
    assert keys(ledger.filter_ledger(rows, account="creditCard")) == [300, 400, 500]
    assert keys(ledger.filter_ledger(rows, category="Uncategorized")) == [300, 400]
    assert keys(ledger.filter_ledger(rows, start=day("2026-02-07"), end=day("2026-01-06"))) == [200, 300, 400]
    assert len(keys(ledger.filter_ledger(rows, start=day("2026-02-07")))) == 7
    for text, expected in [("-42.1", [300]), ("900", [100, 400]), ("-900.0", []), ("CREDIT CARD", [300, 400, 500]),
                           ("2026-02", [400, 500]), (" tacos ", [300, 400]), ("loan_pmt", [700]), ("", [100, 200, 300, 400, 500, 600, 700])]:
        assert keys(ledger.filter_ledger(rows, text=text)) == expected, text


def test_cards_and_insights(rows):
    cards = ledger.metric_cards(rows).first()
    assert (cards.spendingAmount, cards.incomeAmount, cards.netCashflowAmount, cards.uncategorizedCount) == (
        Decimal("1792.10"), Decimal("2000.00"), Decimal("192.90"), 2)
    found = ledger.insights(rows).first()
    # Of two equal purchases the later one is named.
    assert (found.largestPurchaseAmount, found.largestPurchaseMerchant) == (Decimal("900.00"), "Tacos #13")
    assert found.purchaseCount == 3 and found.categorizedPercent == 71
    assert found.monthlyPaceAmount == pytest.approx(1842.10 / 3)
    texts = [r.value for r in ledger.insight_cards(rows).orderBy("cardOrder").collect()]
    assert texts == ["$614.03", "$614.03", "$900.00", "71%"]


def test_cards_of_an_empty_slice(rows):
    none = rows.filter("false")
    found = ledger.insights(none).first()
    assert tuple(found) == (0.0, 0, 0.0, Decimal("0.00"), "No purchases", 0)
    assert [r.value for r in ledger.metric_card_texts(none).orderBy("cardOrder").collect()] == ["$0.00", "$0.00", "$0.00", "0"]
    assert ledger.date_bounds(none).first().earliestDate is None


def test_periods_and_rankings(rows):
    years = {r.periodKey: r for r in ledger.cashflow_by_period(rows, "year").collect()}
    assert {k: (r.inflowAmount, r.outflowAmount, r.netCashflowAmount) for k, r in years.items()} == {
        "2026": (Decimal("2000.00"), Decimal("1792.10"), Decimal("207.90")), "2027": (Decimal("0.00"), Decimal("15.00"), Decimal("-15.00")),
    }
    assert [r.periodKey for r in ledger.recent_cashflow(rows, n=2).collect()] == ["2026-02", "2027-02"]
    assert [r.spendingCategoryName for r in ledger.top_categories(rows).collect()] == ["Uncategorized", "Home", "Shopping"]
    assert [r.merchantDisplayName for r in ledger.top_merchants(rows).collect()] == ["Rent", "Tacos #13", 'Tacos "12"']
    assert [(r.accountType, r.sharePercent) for r in ledger.account_share(rows).collect()] == [("checking", 50), ("creditCard", 50)]
    assert [r.spendingCategoryName for r in ledger.category_options(rows).collect()][:2] == ["DebtPayment", "Fee"]
    assert [r.transactionKey for r in dashboard.ledger_ordered(rows).collect()] == [700, 600, 500, 400, 300, 200, 100]


def test_suggestions(rows):
    found = suggestions.suggest_rules(rows, ["Dining", "Personal"]).collect()
    assert {(r.suggestionKey, r.suggestedCategoryName, r.exampleMerchant, r.transactionCount, r.confidenceLabel) for r in found} == {
        ('creditCard|Sale|purchase|TACOS "12"', "Dining", 'Tacos "12"', 1, "Review"),
        ("creditCard|Sale|purchase|TACOS", "Dining", "Tacos #13", 1, "Review"),
    }


def test_export(rows, tmp_path):
    path = str(tmp_path / "out")
    export_ledger(rows, path, ["merchantDisplayName", "transactionAmount", "accountType"])
    lines = []
    for part in glob.glob(f"{path}/*.csv"):
        text = open(part).read().splitlines()
        assert text[0] == '"Account","Merchant","Amount"'
        lines += text[1:]
    assert '"Credit card","Tacos ""12""","-$42.10"' in lines
    assert len(list(csv.reader(lines))) == 7
