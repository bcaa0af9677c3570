"""Seed rows: categories, system rules and the unknown member of each table. All are fixed values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from .literals import literal_rows

UNKNOWN_KEY = -1
UNKNOWN_DATE_KEY = 19000101
INSTITUTION = "chase"

CATEGORIES = [
    (-1, "Unknown", "Unknown", "Missing or invalid category key"),
    (100, "Dining", "Food", "Restaurants, cafes, and prepared food"),
    (200, "Groceries", "Food", "Grocery and supermarket purchases"),
    (300, "BillsAndUtilities", "Household", "Recurring bills and utility expenses"),
    (400, "Transportation", "Transportation", "Transit, parking, rideshare, and vehicle expenses"),
    (500, "Gas", "Transportation", "Fuel purchases"),
    (600, "Travel", "Lifestyle", "Travel expenses"),
    (700, "Shopping", "Lifestyle", "Retail purchases"),
    (800, "Entertainment", "Lifestyle", "Entertainment expenses"),
    (900, "Health", "Lifestyle", "Health and wellness expenses"),
    (1000, "Education", "Lifestyle", "Education expenses"),
    (1100, "Home", "Household", "Home-related expenses"),
    (1200, "Personal", "Lifestyle", "Personal expenses"),
    (1300, "ProfessionalServices", "Lifestyle", "Professional services"),
    (1400, "Income", "Income", "Income transactions"),
    (1500, "OtherIncome", "Income", "Income that is not otherwise categorized"),
    (1600, "DebtPayment", "Financial", "Debt and loan payments"),
    (1700, "Transfer", "Financial", "Transfers and account movements"),
    (1800, "Fee", "Financial", "Fees"),
    (1900, "Refund", "Adjustment", "Refunds and returns"),
    (2000, "Uncategorized", "Uncategorized", "Needs category review"),
    (2100, "Investments", "Financial", "Investment account transfers and brokerage movements"),
]

# (rule name, transaction type, match type, match text, category, event, priority); all for checking accounts.
SYSTEM_RULES = [
    ("System Category Rule Checking Chase Credit Card Payment 1", None, "contains", "CHASE CREDIT CRD", "DebtPayment", "debtPayment", 90),
    ("System Category Rule Checking Chase Credit Card Payment 2", None, "contains", "CHASE CREDIT CARD", "DebtPayment", "debtPayment", 90),
    ("System Category Rule Checking Generic Credit Card Payment", None, "contains", "CREDIT CARD PAYMENT", "DebtPayment", "debtPayment", 90),
    ("System Category Rule Checking Credit CRD Payment", None, "contains", "CREDIT CRD", "DebtPayment", "debtPayment", 90),
    ("System Category Rule Checking Epay Payment", None, "contains", "EPAY", "DebtPayment", "debtPayment", 80),
    ("System Category Rule Checking Capital One Mobile Payment", None, "contains", "CAPITAL ONE MOBILE PMT", "DebtPayment", "debtPayment", 95),
    ("System Category Rule Checking Amazon Synchrony Payment", None, "contains", "AMAZON CORP SYF PAYMNT", "DebtPayment", "debtPayment", 95),
    ("System Category Rule Checking Robinhood Investment Transfer", None, "contains", "ROBINHOOD", "Investments", "transfer", 100),
    ("System Category Rule Checking Outgoing Zelle Spending", "CHASE_TO_PARTNERFI", "startsWith", "ZELLE PAYMENT TO", "Personal", "purchase", 95),
]

_FIRST_DAY = dt.date(1900, 1, 1)
UNKNOWN_MEMBERS = {
    "dimSourceFile": dict(
        sourceFileKey=-1, sourceFileName="Unknown", sourceFileHash="unknown", sourceFileType="unknown",
        sourceSystemName="unknown", rowCount=0,
    ),
    "dimFinancialAccount": dict(
        financialAccountKey=-1, institutionName="unknown", accountType="unknown", accountLastFour="unknown",
        accountDisplayName="Unknown Account", isActive=True,
    ),
    "dimMerchant": dict(
        merchantKey=-1, merchantNormalizedName="unknown", merchantDisplayName="Unknown Merchant", isActive=True,
    ),
    "dimCalendarDate": dict(
        calendarDateKey=UNKNOWN_DATE_KEY, calendarDate=_FIRST_DAY, calendarYear=1900, calendarQuarter=1,
        calendarMonth=1, calendarMonthName="January", calendarMonthNumber=1, calendarDayOfMonth=1,
        calendarDayOfWeek=1, calendarDayName="Monday", isWeekend=False, yearMonth="1900-01",
        monthStartDate=_FIRST_DAY, monthEndDate=dt.date(1900, 1, 31),
    ),
    "mapMerchantRule": dict(
        merchantRuleKey=-1, ruleName="Unknown Merchant Rule", descriptionMatchType="exact",
        descriptionMatchText="__NO_MERCHANT_RULE__", merchantKey=-1, rulePriority=0, isActive=True,
    ),
    "mapCategoryRule": dict(
        categoryRuleKey=-1, ruleName="Unknown Category Rule", spendingCategoryKey=-1,
        transactionEventType="other", categoryAssignmentSource="fallback", rulePriority=0, isActive=True,
    ),
}


def _frame(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    plain = [tuple(row.get(name) for name in schemas.columns(table)) for row in rows]
    now = F.current_timestamp()
    frame = literal_rows(spark, plain, schemas.TABLES[table])
    return frame.withColumns({"createdDatetime": now, "modifiedDatetime": now})


def seed_unknown_members(spark: SparkSession, table: str) -> DataFrame:
    """The table's unknown member, or no row where the table has none."""
    return _frame(spark, table, [UNKNOWN_MEMBERS[table]] if table in UNKNOWN_MEMBERS else [])


def seed_categories(spark: SparkSession) -> DataFrame:
    names = ["spendingCategoryKey", "spendingCategoryName", "parentSpendingCategoryName", "spendingCategoryDescription"]
    return _frame(spark, "dimSpendingCategory", [dict(zip(names, row), isActive=True) for row in CATEGORIES])


def seed_rule_rows(spark: SparkSession) -> DataFrame:
    """System rules with category names still to be resolved, in seed order."""
    rows = [
        (place, name, "checking", None, kind, match, text, category, event, "rule", priority)
        for place, (name, kind, match, text, category, event, priority) in enumerate(SYSTEM_RULES)
    ]
    return literal_rows(
        spark, rows,
        "seedOrder int, ruleName string, sourceAccountType string, sourceCategoryName string, "
        "transactionType string, descriptionMatchType string, descriptionMatchText string, "
        "spendingCategoryName string, transactionEventType string, categoryAssignmentSource string, "
        "rulePriority int",
    )
