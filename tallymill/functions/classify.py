"""Default classification of a transaction from its account, type and source category."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Type of a checking row -> (category, event, assignment source, priority of its auto rule).
CHECKING_TYPES = {
    "ACCT_XFER": ("Transfer", "transfer", "rule", 80),
    "CHASE_TO_PARTNERFI": ("Transfer", "transfer", "rule", 80),
    "PARTNERFI_TO_CHASE": ("Transfer", "transfer", "rule", 80),
    "ACH_CREDIT": ("Income", "income", "rule", 80),
    "MISC_CREDIT": ("Income", "income", "rule", 80),
    "QUICKPAY_CREDIT": ("Income", "income", "rule", 80),
    "LOAN_PMT": ("DebtPayment", "debtPayment", "rule", 80),
    "FEE_TRANSACTION": ("Fee", "fee", "rule", 80),
    "BILLPAY": ("BillsAndUtilities", "purchase", "rule", 70),
    "ACH_DEBIT": ("Uncategorized", "purchase", "fallback", 0),
    "DEBIT_CARD": ("Uncategorized", "purchase", "fallback", 0),
    "MISC_DEBIT": ("Uncategorized", "purchase", "fallback", 0),
}
# Category column of a card row -> spending category.
CARD_CATEGORIES = {
    "Automotive": "Transportation",
    "Bills & Utilities": "BillsAndUtilities",
    "Education": "Education",
    "Entertainment": "Entertainment",
    "Food & Drink": "Dining",
    "Gas": "Gas",
    "Groceries": "Groceries",
    "Health & Wellness": "Health",
    "Home": "Home",
    "Personal": "Personal",
    "Professional Services": "ProfessionalServices",
    "Shopping": "Shopping",
    "Travel": "Travel",
}
# Card type -> (event, category when the source category is not mapped).
CARD_EVENTS = {"Sale": ("purchase", "Uncategorized"), "Return": ("refund", "Refund")}
MAPPED = "chaseMapped"
# Event types, where an assignment comes from, and the categories that are none yet.
EVENT_TYPES = ["purchase", "refund", "payment", "income", "transfer", "fee", "debtPayment", "other"]
ASSIGNMENT_SOURCES = ["chaseMapped", "rule", "fallback", "manual", "ai"]
OPEN_CATEGORIES = ["Uncategorized", "Unknown"]


def _outcome(category, event, source, priority) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(category).alias("category"), as_column(event).alias("event"),
        as_column(source).alias("source"), as_column(priority).cast("int").alias("priority"),
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def default_outcome(account: Column, kind: Column, category: Column) -> Column:
    """Struct (category, event, source, priority); the three columns are already blank-normalised."""
    checking, card = account == "checking", account == "creditCard"
    by_outcome: dict[tuple, list[str]] = {}
    for name, outcome in CHECKING_TYPES.items():
        by_outcome.setdefault(outcome, []).append(name)

    chain = F
    for outcome, names in by_outcome.items():
        chain = chain.when(checking & kind.isin(names), _outcome(*outcome))
    chain = chain.when(card & (kind == "Payment"), _outcome("DebtPayment", "payment", "rule", 50))
    for name, (event, unmapped) in CARD_EVENTS.items():
        chain = chain.when(
            card & (kind == name),
            _outcome(
                F.coalesce(_lookup(CARD_CATEGORIES, category), F.lit(unmapped)), event,
                F.when(category.isNotNull(), MAPPED).otherwise("fallback"),
                F.when(category.isNotNull(), 100).otherwise(0),
            ),
        )
    return chain.otherwise(_outcome("Uncategorized", "other", "fallback", 0))


# Patterns tried in this order on a suggested rule text, and the category each one hints at.
HINTS = [
    ("ROBINHOOD|FIDELITY|VANGUARD|SCHWAB|BROKERAGE", ["Investments", "Transfer"]),
    ("UBER|LYFT|TRANSIT|MTA|PARKING|TRAIN|BUS", ["Transportation"]),
    ("SHELL|EXXON|BP|CHEVRON|GAS", ["Gas"]),
    ("MARKET|GROCERY|SAFEWAY|KROGER|TRADER|WHOLE FOODS|COSTCO", ["Groceries"]),
    ("CAFE|COFFEE|RESTAURANT|TACO|PIZZA|STARBUCKS|DUNKIN|CHIPOTLE", ["Dining"]),
    ("AMAZON|TARGET|WALMART|SHOP|STORE", ["Shopping"]),
    ("VERIZON|TMOBILE|COMCAST|UTILITY|ELECTRIC|WATER|GAS BILL", ["BillsAndUtilities"]),
    ("PHARMACY|CVS|WALGREENS|MEDICAL|HEALTH", ["Health"]),
]
BROKERAGE = HINTS[0]
HINT_FALLBACK = "Personal"


def hint_category(text: Column, available: list[str]) -> Column:
    """Category offered for a rule text.

    A brokerage pattern falls through to the others when neither of its categories is offered; of the others
    only the first matching pattern counts. `available` is the offered vocabulary in its listed order.
    """
    offered = set(available)
    last_resort = HINT_FALLBACK if HINT_FALLBACK in offered else (available[0] if available else "")
    chain, started = F, False
    brokerage = next((c for c in BROKERAGE[1] if c in offered), None)
    if brokerage:
        chain, started = F.when(text.rlike(BROKERAGE[0]), brokerage), True
    for pattern, (category,) in HINTS[1:]:
        chain = chain.when(text.rlike(pattern), category if category in offered else last_resort)
        started = True
    return chain.otherwise(last_resort) if started else F.lit(last_resort)
