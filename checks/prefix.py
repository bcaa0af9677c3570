"""Common table expressions that rebuild feed, Silver and Gold in plain SQL, as the ground for every comparison."""

from __future__ import annotations

from tallymill.functions.classify import CARD_CATEGORIES, CHECKING_TYPES
from tallymill.sources.feed import CARD_CATEGORY_OF_TYPE, CHECKING_DESCRIPTIONS, CHECKING_KINDS
from tallymill.sources.seeds import CATEGORIES, SYSTEM_RULES


def lit(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def listing(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def squeeze(c: str) -> str:
    return f"regexp_replace(trim({c}), '\\s+', ' ', 'g')"


def rule_text(c: str) -> str:
    return f"trim(regexp_replace(upper(coalesce({c}, '')), '[^A-Z0-9]+', ' ', 'g'))"


def us_date(c: str) -> str:
    return f"try_strptime(nullif(trim({c}), ''), '%m/%d/%Y')::DATE"


def key16(*parts: str) -> str:
    return "substr(sha256(" + " || '|' || ".join(parts) + "), 1, 16)"


def event_sum(event: str, column: str = "abs(transactionAmount)") -> str:
    return f"coalesce(sum({column}) FILTER (transactionEventType = '{event}'), 0)"


def event_count(event: str) -> str:
    return f"count(*) FILTER (transactionEventType = '{event}')"


NET = f"({event_sum('purchase')} - {event_sum('refund')})"
OUTFLOW = f"({event_sum('purchase')} - {event_sum('refund')} + {event_sum('fee')})"
INCOME = event_sum("income", "transactionAmount")
OPEN = "spendingCategoryName IN ('Uncategorized', 'Unknown')"

_card_category = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in CARD_CATEGORY_OF_TYPE.items())
_seed_rules = values(
    (100 * (i + 1), name, "checking", kind, match, text, category, event, priority)
    for i, (name, kind, match, text, category, event, priority) in enumerate(SYSTEM_RULES)
)

FEED = f"""
feed_checking AS (
  SELECT 'Chase' || (1000 + o_custkey % 4) || '_Activity.CSV' AS sourceFileName,
         sha256('checking-' || (o_custkey % 4)) AS sourceFileHash, 'chaseCheckingCsv' AS sourceFileType,
         row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) AS sourceRowNumber,
         CASE WHEN o_orderkey % 12 BETWEEN 2 AND 4 THEN 'CREDIT' ELSE 'DEBIT' END AS details,
         strftime(o_orderdate, '%m/%d/%Y') AS postingDate,
         ({listing(CHECKING_DESCRIPTIONS)})[((o_orderkey // 12) % 10 + 1)::INT] AS description,
         CASE WHEN o_orderkey % 12 BETWEEN 2 AND 4 THEN '$' || format('{{:,.2f}}', o_totalprice)
              WHEN o_orderkey % 3 = 0 THEN '($' || format('{{:,.2f}}', o_totalprice) || ')'
              ELSE '-' || format('{{:,.2f}}', o_totalprice) END AS amount,
         ({listing(CHECKING_KINDS)})[(o_orderkey % 12 + 1)::INT] AS type,
         format('{{:,.2f}}', o_totalprice) AS balance, NULL::VARCHAR AS checkOrSlipNumber
  FROM orders),
feed_credit AS (
  SELECT 'Chase' || (2000 + l_suppkey % 3) || '_Activity.csv' AS sourceFileName,
         sha256('credit-' || (l_suppkey % 3)) AS sourceFileHash, 'chaseCreditCsv' AS sourceFileType,
         row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
                            l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS sourceRowNumber,
         strftime(l_shipdate, '%m/%d/%Y') AS transactionDate,
         strftime(l_shipdate + l_linenumber * INTERVAL 1 DAY, '%m/%d/%Y') AS postDate,
         p_name || '  ' || p_brand AS description,
         CASE p_type {_card_category} ELSE ' ' END AS category,
         CASE WHEN l_returnflag = 'A' THEN 'Sale' WHEN l_returnflag = 'R' THEN 'Return'
              WHEN l_linenumber % 2 = 0 THEN 'Payment' ELSE 'Sale' END AS type,
         CASE WHEN l_returnflag = 'A' OR (l_returnflag <> 'R' AND l_linenumber % 2 = 1) THEN '-' ELSE '' END
           || format('{{:,.2f}}', l_extendedprice) AS amount,
         NULL::VARCHAR AS memo
  FROM lineitem JOIN part ON l_partkey = p_partkey),
feed_files AS (
  SELECT sourceFileName, sourceFileHash, sourceFileType, count(*) AS rowCount,
         CASE sourceFileType WHEN 'chaseCheckingCsv' THEN 'checking' ELSE 'creditCard' END AS accountType,
         substr(sourceFileName, 6, 4) AS accountLastFour
  FROM (SELECT sourceFileName, sourceFileHash, sourceFileType FROM feed_checking
        UNION ALL SELECT sourceFileName, sourceFileHash, sourceFileType FROM feed_credit)
  GROUP BY ALL)"""

SILVER = f"""
unified AS (
  SELECT sourceFileHash, sourceFileType, sourceRowNumber, 'checking' AS sourceAccountType,
         postingDate AS movedText, postingDate AS postedText, description, NULL::VARCHAR AS sourceCategoryName,
         coalesce(nullif(trim(type), ''), 'unknown') AS transactionType, amount AS amountText
  FROM feed_checking
  UNION ALL
  SELECT sourceFileHash, sourceFileType, sourceRowNumber, 'creditCard', transactionDate, postDate, description,
         nullif(trim(category), ''), coalesce(nullif(trim(type), ''), 'unknown'), amount
  FROM feed_credit),
prepared AS (
  SELECT sourceFileHash, sourceFileType, sourceRowNumber, sourceAccountType, sourceCategoryName, transactionType,
         sourceFileType || ':' || sourceFileHash || ':' || sourceRowNumber AS sourceRowIdentifier,
         {us_date('movedText')} AS transactionDate, {us_date('postedText')} AS postedDate,
         {squeeze('description')} AS transactionDescription,
         upper({squeeze('description')}) AS transactionDescriptionClean,
         {rule_text('description')} AS transactionRuleMatchText,
         ((CASE WHEN amountText LIKE '(%' THEN '-' ELSE '' END)
           || regexp_replace(amountText, '[$,() ]', '', 'g'))::DECIMAL(18,2) AS transactionAmount
  FROM unified),
dim_category(spendingCategoryKey, spendingCategoryName, parentSpendingCategoryName, spendingCategoryDescription) AS (
  VALUES {values(CATEGORIES)}),
checking_kind(kind, category, event, source, priority) AS (
  VALUES {values((k, *v) for k, v in CHECKING_TYPES.items())}),
card_category(sourceName, category) AS (VALUES {values(CARD_CATEGORIES.items())}),
kinds AS (
  SELECT k.*, CASE WHEN k.sourceAccountType = 'checking' THEN coalesce(c.category, 'Uncategorized')
                   WHEN k.transactionType = 'Payment' THEN 'DebtPayment'
                   WHEN k.transactionType = 'Return' THEN coalesce(m.category, 'Refund')
                   WHEN k.transactionType = 'Sale' THEN coalesce(m.category, 'Uncategorized')
                   ELSE 'Uncategorized' END AS category,
         CASE WHEN k.sourceAccountType = 'checking' THEN coalesce(c.event, 'other')
              ELSE coalesce(map {{'Sale': 'purchase', 'Return': 'refund', 'Payment': 'payment'}}[k.transactionType], 'other')
         END AS event,
         CASE WHEN k.sourceAccountType = 'checking' THEN coalesce(c.source, 'fallback')
              WHEN k.transactionType = 'Payment' THEN 'rule'
              WHEN k.transactionType IN ('Sale', 'Return') AND k.sourceCategoryName IS NOT NULL THEN 'chaseMapped'
              ELSE 'fallback' END AS source,
         CASE WHEN k.sourceAccountType = 'checking' THEN coalesce(c.priority, 0)
              WHEN k.transactionType = 'Payment' THEN 50
              WHEN k.transactionType IN ('Sale', 'Return') AND k.sourceCategoryName IS NOT NULL THEN 100
              ELSE 0 END AS priority
  FROM (SELECT DISTINCT sourceAccountType, sourceCategoryName, transactionType FROM prepared) k
  LEFT JOIN checking_kind c ON k.sourceAccountType = 'checking' AND c.kind = k.transactionType
  LEFT JOIN card_category m ON m.sourceName = k.sourceCategoryName),
auto_rule AS (
  SELECT kinds.*, d.spendingCategoryKey AS autoCategoryKey,
         'Auto Category Rule ' || {key16("kinds.sourceAccountType", "coalesce(kinds.sourceCategoryName, '')", "kinds.transactionType", "''", "''", "d.spendingCategoryKey", "kinds.event", "kinds.source")} AS ruleName
  FROM kinds JOIN dim_category d ON d.spendingCategoryName = kinds.category),
seed_rule(categoryRuleKey, ruleName, sourceAccountType, transactionType, descriptionMatchType, descriptionMatchText,
          category, transactionEventType, rulePriority) AS (VALUES {_seed_rules}),
map_category_rule AS MATERIALIZED (
  SELECT r.categoryRuleKey, r.ruleName, r.sourceAccountType, NULL::VARCHAR AS sourceCategoryName, r.transactionType,
         r.descriptionMatchType, r.descriptionMatchText, d.spendingCategoryKey, r.transactionEventType,
         'rule' AS categoryAssignmentSource, r.rulePriority
  FROM seed_rule r JOIN dim_category d ON d.spendingCategoryName = r.category
  UNION ALL
  SELECT 900 + 100 * row_number() OVER (ORDER BY ruleName), ruleName, sourceAccountType, sourceCategoryName,
         transactionType, NULL, NULL, autoCategoryKey, event, source, priority
  FROM auto_rule
  UNION ALL
  SELECT -1, 'Unknown Category Rule', NULL, NULL, NULL, NULL, NULL, -1, 'other', 'fallback', 0),
hit AS MATERIALIZED (
  SELECT t.sourceAccountType, t.transactionType, t.text, arg_max(r.categoryRuleKey, r.rulePriority * 100000 + r.categoryRuleKey) AS ruleKey
  FROM (SELECT DISTINCT sourceAccountType, transactionType, transactionRuleMatchText AS text FROM prepared) t
  JOIN (SELECT *, {rule_text('descriptionMatchText')} AS wanted,
               list_filter(string_split({rule_text('descriptionMatchText')}, ' '), lambda w: length(w) > 1) AS words
        FROM map_category_rule WHERE descriptionMatchType IS NOT NULL) r
    ON r.sourceAccountType = t.sourceAccountType AND coalesce(r.transactionType, t.transactionType) = t.transactionType
   AND CASE r.descriptionMatchType
         WHEN 'exact' THEN t.text = r.wanted WHEN 'startsWith' THEN starts_with(t.text, r.wanted)
         ELSE len(r.words) > 0 AND len(list_filter(r.words, lambda w: NOT contains(t.text, w))) = 0 END
  GROUP BY ALL),
dim_file AS (
  SELECT 100 * row_number() OVER (ORDER BY sourceFileHash) AS sourceFileKey, * FROM feed_files),
dim_account AS (
  SELECT 100 * row_number() OVER (ORDER BY accountType, accountLastFour) AS financialAccountKey, accountType, accountLastFour,
         CASE accountType WHEN 'checking' THEN 'Chase Checking ' || accountLastFour ELSE 'Chase Credit Card' END AS accountDisplayName
  FROM (SELECT DISTINCT accountType, accountLastFour FROM feed_files)),
dim_merchant AS (
  SELECT 100 * row_number() OVER (ORDER BY merchantNormalizedName) AS merchantKey, *
  FROM (SELECT transactionDescriptionClean AS merchantNormalizedName, min(transactionDescription) AS merchantDisplayName
        FROM prepared WHERE transactionDescription <> '' GROUP BY 1)),
dim_date AS (
  SELECT strftime(d, '%Y%m%d')::BIGINT AS calendarDateKey, d AS calendarDate, strftime(d, '%Y-%m') AS yearMonth,
         date_trunc('month', d)::DATE AS monthStartDate
  FROM (SELECT transactionDate AS d FROM prepared UNION SELECT postedDate FROM prepared) WHERE d IS NOT NULL),
fact AS (
  SELECT 100 * row_number() OVER (ORDER BY f.sourceFileKey, p.sourceRowNumber) AS transactionKey, f.sourceFileKey, a.financialAccountKey,
         coalesce(strftime(p.transactionDate, '%Y%m%d')::BIGINT, 19000101) AS transactionDateKey,
         coalesce(strftime(p.postedDate, '%Y%m%d')::BIGINT, 19000101) AS postedDateKey,
         coalesce(m.merchantKey, -1) AS merchantKey, coalesce(m.merchantKey, -1) AS merchantRuleKey,
         coalesce(w.spendingCategoryKey, k.autoCategoryKey) AS spendingCategoryKey,
         coalesce(w.categoryRuleKey, n.categoryRuleKey) AS categoryRuleKey,
         p.sourceRowNumber, p.sourceRowIdentifier,
         sha256(p.sourceFileHash || '|' || p.sourceRowNumber || '|' || p.transactionDescriptionClean || '|'
                || p.transactionAmount || '|' || p.transactionType) AS transactionNaturalKey,
         p.transactionDescription, p.transactionDescriptionClean, p.sourceCategoryName, p.transactionType,
         coalesce(w.transactionEventType, k.event) AS transactionEventType, p.transactionAmount
  FROM prepared p
  JOIN dim_file f USING (sourceFileHash)
  JOIN dim_account a ON a.accountType = p.sourceAccountType AND a.accountLastFour = f.accountLastFour
  JOIN auto_rule k ON k.sourceAccountType = p.sourceAccountType AND k.transactionType = p.transactionType
                  AND k.sourceCategoryName IS NOT DISTINCT FROM p.sourceCategoryName
  JOIN map_category_rule n ON n.ruleName = k.ruleName
  LEFT JOIN dim_merchant m ON m.merchantNormalizedName = p.transactionDescriptionClean
  LEFT JOIN hit h ON h.sourceAccountType = p.sourceAccountType AND h.transactionType = p.transactionType
                 AND h.text = p.transactionRuleMatchText
  LEFT JOIN map_category_rule w ON w.categoryRuleKey = h.ruleKey)"""

GOLD = f"""
ledger AS (
  SELECT t.transactionKey, d.calendarDate AS transactionDate, p.calendarDate AS postedDate, d.yearMonth, d.monthStartDate,
         a.accountType, m.merchantDisplayName, c.parentSpendingCategoryName, c.spendingCategoryName, t.transactionType,
         t.transactionEventType, t.transactionAmount, t.transactionDescriptionClean
  FROM fact t JOIN dim_date d ON d.calendarDateKey = t.transactionDateKey
  JOIN dim_date p ON p.calendarDateKey = t.postedDateKey
  JOIN dim_account a USING (financialAccountKey) JOIN dim_merchant m USING (merchantKey)
  JOIN dim_category c USING (spendingCategoryKey)),
spending AS (
  SELECT yearMonth, monthStartDate, accountType, parentSpendingCategoryName, spendingCategoryName,
         {event_count('purchase')} AS purchaseTransactionCount, {event_count('refund')} AS refundTransactionCount,
         {event_sum('purchase')} AS grossSpendingAmount, {event_sum('refund')} AS refundAmount, {NET} AS netSpendingAmount
  FROM ledger GROUP BY ALL),
cashflow AS (
  SELECT yearMonth, monthStartDate, accountType, count(*) AS transactionCount,
         {event_count('income')} AS incomeTransactionCount, {event_count('purchase')} AS purchaseTransactionCount,
         {event_count('refund')} AS refundTransactionCount, {event_count('fee')} AS feeTransactionCount,
         {event_count('payment')} AS internalPaymentTransactionCount,
         {event_count('debtPayment')} AS debtPaymentTransactionCount, {event_count('transfer')} AS transferTransactionCount,
         {INCOME} AS incomeAmount, {event_sum('purchase')} AS grossPurchaseAmount, {event_sum('refund')} AS refundAmount,
         {event_sum('fee')} AS feeAmount, {event_sum('payment')} AS internalPaymentAmount,
         {event_sum('debtPayment')} AS debtPaymentAmount, {event_sum('transfer', 'transactionAmount')} AS netTransferAmount,
         {INCOME} AS inflowAmount, {OUTFLOW} AS outflowAmount, {INCOME} - {OUTFLOW} AS netCashflowAmount
  FROM ledger GROUP BY ALL),
merchants AS (
  SELECT merchantDisplayName, accountType, parentSpendingCategoryName, spendingCategoryName,
         {event_count('purchase')} AS purchaseTransactionCount, {event_sum('purchase')} AS totalSpendingAmount,
         CASE WHEN {event_count('purchase')} > 0
              THEN {event_sum('purchase')}::DOUBLE / {event_count('purchase')} ELSE 0 END AS averagePurchaseAmount,
         min(transactionDate) AS firstTransactionDate, max(transactionDate) AS lastTransactionDate
  FROM ledger GROUP BY ALL),
uncategorized AS (
  SELECT yearMonth, monthStartDate, accountType, transactionType, transactionEventType, count(*) AS transactionCount,
         sum(transactionAmount) AS netTransactionAmount
  FROM ledger WHERE {OPEN} GROUP BY ALL),
trend AS (
  SELECT *, lag(netSpendingAmount) OVER w AS previousMonthNetSpendingAmount,
         netSpendingAmount - coalesce(lag(netSpendingAmount) OVER w, 0) AS monthOverMonthChangeAmount
  FROM (SELECT yearMonth, monthStartDate, parentSpendingCategoryName, spendingCategoryName, {NET} AS netSpendingAmount
        FROM ledger GROUP BY ALL)
  WINDOW w AS (PARTITION BY parentSpendingCategoryName, spendingCategoryName ORDER BY monthStartDate))"""


def feed(query: str) -> str:
    return f"WITH {FEED}\n{query}"


def silver(query: str) -> str:
    return f"WITH {FEED},{SILVER}\n{query}"


def gold(query: str) -> str:
    return f"WITH {FEED},{SILVER},{GOLD}\n{query}"
