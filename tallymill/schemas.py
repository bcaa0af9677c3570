"""Declared shape of every Bronze and Silver table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

AUDIT = "createdDatetime timestamp, modifiedDatetime timestamp"
LINEAGE = "sourceFileName string, sourceFileHash string, sourceFileType string, sourceRowNumber long"

# CSV header -> column, in file order.
CHECKING_HEADERS = {
    "Details": "details",
    "Posting Date": "postingDate",
    "Description": "description",
    "Amount": "amount",
    "Type": "type",
    "Balance": "balance",
    "Check or Slip #": "checkOrSlipNumber",
}
CREDIT_HEADERS = {
    "Transaction Date": "transactionDate",
    "Post Date": "postDate",
    "Description": "description",
    "Category": "category",
    "Type": "type",
    "Amount": "amount",
    "Memo": "memo",
}
CHECKING_TYPE, CREDIT_TYPE = "chaseCheckingCsv", "chaseCreditCsv"
CHECKING_COLUMNS, CREDIT_COLUMNS = list(CHECKING_HEADERS.values()), list(CREDIT_HEADERS.values())


def _texts(names: list[str]) -> str:
    return ", ".join(f"{name} string" for name in names)


STAGED_CHECKING = f"{LINEAGE}, {_texts(CHECKING_COLUMNS)}"
STAGED_CREDIT = f"{LINEAGE}, {_texts(CREDIT_COLUMNS)}"
FILE_METADATA = (
    "sourceFileName string, sourceFilePath string, sourceFileHash string, sourceFileType string, "
    "rowCount long, accountType string, accountLastFour string"
)
BRONZE_LINEAGE = "sourceFileName string, sourceFileHash string, sourceRowNumber long"

TABLES = {
    "rawChaseCheckingTransaction": f"recordKey long, {BRONZE_LINEAGE}, {AUDIT}, {_texts(CHECKING_COLUMNS)}",
    "rawChaseCreditTransaction": f"recordKey long, {BRONZE_LINEAGE}, {AUDIT}, {_texts(CREDIT_COLUMNS)}",
    "dimSourceFile": (
        "sourceFileKey long, sourceFileName string, sourceFileHash string, sourceFileType string, "
        f"sourceSystemName string, rowCount long, {AUDIT}"
    ),
    "dimFinancialAccount": (
        "financialAccountKey long, institutionName string, accountType string, accountLastFour string, "
        f"accountDisplayName string, isActive boolean, {AUDIT}"
    ),
    "dimSpendingCategory": (
        "spendingCategoryKey long, spendingCategoryName string, parentSpendingCategoryName string, "
        f"spendingCategoryDescription string, isActive boolean, {AUDIT}"
    ),
    "dimMerchant": (
        f"merchantKey long, merchantNormalizedName string, merchantDisplayName string, isActive boolean, {AUDIT}"
    ),
    "dimCalendarDate": (
        "calendarDateKey long, calendarDate date, calendarYear int, calendarQuarter int, calendarMonth int, "
        "calendarMonthName string, calendarMonthNumber int, calendarDayOfMonth int, calendarDayOfWeek int, "
        "calendarDayName string, isWeekend boolean, yearMonth string, monthStartDate date, monthEndDate date, "
        f"{AUDIT}"
    ),
    "mapMerchantRule": (
        "merchantRuleKey long, ruleName string, descriptionMatchType string, descriptionMatchText string, "
        f"merchantKey long, rulePriority int, isActive boolean, {AUDIT}"
    ),
    "mapCategoryRule": (
        "categoryRuleKey long, ruleName string, sourceAccountType string, sourceCategoryName string, "
        "transactionType string, descriptionMatchType string, descriptionMatchText string, "
        "spendingCategoryKey long, transactionEventType string, categoryAssignmentSource string, "
        f"rulePriority int, isActive boolean, {AUDIT}"
    ),
    "factTransaction": (
        "transactionKey long, sourceFileKey long, financialAccountKey long, transactionDateKey long, "
        "postedDateKey long, merchantKey long, merchantRuleKey long, spendingCategoryKey long, "
        "categoryRuleKey long, sourceRowNumber long, sourceRowIdentifier string, transactionNaturalKey string, "
        "transactionDescription string, transactionDescriptionClean string, sourceCategoryName string, "
        f"transactionType string, transactionEventType string, transactionAmount decimal(18,2), {AUDIT}"
    ),
}
BRONZE_TABLES = ["rawChaseCheckingTransaction", "rawChaseCreditTransaction"]
SILVER_TABLES = [name for name in TABLES if name not in BRONZE_TABLES]

# How the rows of a large table lie in its files: gathered by the first expression, sorted by the columns after it.
CLUSTERING = {"factTransaction": ("floor(transactionDateKey / 100)", ["transactionDateKey", "transactionKey"])}

# Columns that a change file may set anew, by generated key, without rewriting the rows (see sources/store.py).
CHANGEABLE = {"factTransaction": ["spendingCategoryKey", "categoryRuleKey", "transactionEventType", "modifiedDatetime"]}

# Column whose smallest and largest value the commit log keeps for every part.
PRUNED_BY = {
    "factTransaction": "sourceFileKey", "rawChaseCheckingTransaction": "sourceFileHash",
    "rawChaseCreditTransaction": "sourceFileHash", "dimMerchant": "merchantNormalizedName",
}

# Surrogate key of each table that has a generated one: first value and step are both 100.
GENERATED_KEYS = {
    "rawChaseCheckingTransaction": "recordKey",
    "rawChaseCreditTransaction": "recordKey",
    "dimSourceFile": "sourceFileKey",
    "dimFinancialAccount": "financialAccountKey",
    "dimMerchant": "merchantKey",
    "mapMerchantRule": "merchantRuleKey",
    "mapCategoryRule": "categoryRuleKey",
    "factTransaction": "transactionKey",
}
KEY_STEP = 100


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def columns(table: str) -> list[str]:
    return [field.split()[0] for field in TABLES[table].split(", ")]
