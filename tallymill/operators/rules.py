"""Prioritised matching of transactions against a table of description rules.

Whatever the number of rules, they are joined with the distinct texts through text anchors, see `text_matches`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import match_text, tokens
from ..sources.store import materialise
from .joins import lookup, one_row_beside

CLASSIFIERS = ["rule", "manual", "ai"]
WINNER = "categoryRuleKey long, spendingCategoryKey long, transactionEventType string"
# What decides a match, in the unified transaction shape.
EVIDENCE = ["sourceAccountType", "sourceCategoryName", "transactionType", "transactionRuleMatchText"]


def classifying_rules(rules: DataFrame) -> DataFrame:
    """Active rules that match on descriptions, with their text normalised like a transaction's."""
    return rules.filter(
        F.col("isActive") & F.col("categoryAssignmentSource").isin(CLASSIFIERS)
        & F.col("descriptionMatchType").isNotNull()
    ).select(
        "categoryRuleKey", "sourceAccountType", "sourceCategoryName", "transactionType", "descriptionMatchType",
        match_text(F.col("descriptionMatchText")).alias("ruleText"), "spendingCategoryKey",
        "transactionEventType", "rulePriority",
    )


def token_contains(text: Column, words: Column) -> Column:
    """Every token longer than one character is a substring of the text, and there is such a token."""
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(text, w))


# ---- candidates ------------------------------------------------------------------------------------------------
#
# A rule's anchors are pieces that every text it matches must have: the whole text (exact), its first letters
# (startsWith), pieces of three letters of its words, or a word of two. One of them is enough to find the rule's texts; the
# one that the fewest texts have finds the fewest that don't match.

# Bits of the filter that tells which pieces of a text are worth keeping. Wrong yeses cost a row, never a match.
FILTER_BITS = 1 << 15


def _grams(text: Column, size: int) -> Column:
    """All substrings of the given size: a look-ahead matches at every place without taking it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _inside(text: Column) -> Column:
    return F.transform(F.concat(_grams(text, 2), _grams(text, 3)), lambda g: F.concat(F.lit("*"), g))


def _text_anchors(text: Column) -> Column:
    starts = F.array(*[F.concat(F.lit("^"), F.substring(text, 1, n)) for n in range(4)])
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), text)), starts, _inside(text)))


def _rule_anchors(kind: Column, rule_text: Column, whole_if_short: bool) -> Column:
    def inside(text: Column) -> Column:
        return F.transform(_grams(text, 3), lambda g: F.concat(F.lit("*"), g))

    one = lambda head, text: F.array(F.concat(F.lit(head), text))
    of_words = F.flatten(F.transform(tokens(rule_text), lambda w: F.when(F.length(w) < 3, one("*", w)).otherwise(inside(w))))
    # The start of length 0 is one that every text has.
    short = F.when(F.length(rule_text) < 3, one("^", F.lit(""))).otherwise(inside(rule_text)) if whole_if_short else F.array().cast("array<string>")
    return (
        F.when(kind == "exact", one("=", rule_text))
        .when(kind == "startsWith", F.concat(one("^", F.substring(rule_text, 1, 3)), inside(rule_text)))
        .when(kind == "contains", F.when(F.size(tokens(rule_text)) > 0, of_words).otherwise(short))
        .otherwise(F.array().cast("array<string>"))
    )


def _with_anchors(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(text, anchor) for the anchors of texts that are among the given ones, or take their place in the filter.

    The filter is one row of FILTER_BITS bits, whatever the number of anchors; pieces are dropped before they become rows.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    held = anchors.agg(F.bitmap_construct_agg(place(F.col("anchor"))).alias("b"))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("b"), k, F.lit(1))), 16, 10).cast("int")
    bits = held.select(F.transform(F.sequence(F.lit(1), F.lit(FILTER_BITS // 8)), byte).alias("bits"))

    def wanted(anchor: Column) -> Column:
        at = place(anchor)
        return F.call_function("getbit", F.element_at("bits", F.shiftright(at, 3) + 1), F.pmod(at, F.lit(8))) == 1

    return one_row_beside(texts.select("text"), bits).select("text", F.explode(F.filter(_text_anchors(F.col("text")), wanted)).alias("anchor"))


def text_matches(texts: DataFrame, rules: DataFrame, whole_if_short: bool = False) -> DataFrame:
    """Rules (ruleText, descriptionMatchType and further columns), each with every `text` of texts that it matches.

    `texts` has one column `text`, distinct; `rules` a distinct `ruleId`. `whole_if_short`: a contains text of one-letter
    words is searched as a whole (approval); otherwise such a rule never matches (load).
    """
    kind, rule_text = F.col("descriptionMatchType"), F.col("ruleText")
    anchors = F.explode(F.array_distinct(_rule_anchors(kind, rule_text, whole_if_short)))
    anchored = rules.select(F.struct(*rules.columns).alias("rule"), anchors.alias("anchor"))
    often = _with_anchors(texts, anchored).groupBy("anchor").agg(F.count("*").alias("texts"))
    # A rule with an anchor that no text has matches none.
    rank = F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "anchor")
    chosen = anchored.join(often, "anchor", "left").groupBy("rule.ruleId").agg(F.min(rank).alias("best"), F.first("rule").alias("rule"))
    chosen = materialise(chosen.filter("best.n > 0").select("best.anchor", "rule.*"), "anchors")
    words = tokens(rule_text)
    contains = F.when(F.size(words) > 0, token_contains(F.col("text"), words)).otherwise(
        F.contains("text", rule_text) if whole_if_short else F.lit(False))
    hit = (
        ((kind == "exact") & (F.col("text") == rule_text)) | ((kind == "startsWith") & F.startswith("text", rule_text))
        | ((kind == "contains") & contains)
    )
    return _with_anchors(texts, chosen).join(chosen, "anchor").filter(hit).drop("anchor")


def winners_by_anchor(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """EVIDENCE columns plus the winning rule, for those combinations that any rule matches.

    Distinct texts meet the rules through `text_matches`, then the combinations of each text the rules it has. `evidence`
    should be distinct. Written out, so that a join with all transactions sees how small it is and leaves them in place.
    """
    texts = evidence.select(F.col("transactionRuleMatchText").alias("text")).distinct()
    r = text_matches(texts, rules.withColumn("ruleId", F.col("categoryRuleKey"))).alias("r")
    t = evidence.alias("t")
    condition = F.col("t.transactionRuleMatchText") == F.col("r.text")
    for name in ("sourceAccountType", "sourceCategoryName", "transactionType"):
        condition = condition & (F.col(f"r.{name}").isNull() | (F.col(f"r.{name}") == F.col(f"t.{name}")))
    outcome = F.struct(*[F.col(f"r.{c}") for c in ("categoryRuleKey", "spendingCategoryKey", "transactionEventType")])
    rank = F.struct(F.col("r.rulePriority"), F.col("r.categoryRuleKey"))
    won = t.join(r, condition).groupBy(*[F.col(f"t.{c}") for c in EVIDENCE]).agg(F.max_by(outcome, rank).alias("winner"))
    return materialise(won, "winners")


def winners_of(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """The `winner` of each combination of evidence that any rule matches."""
    # Written out: the matching reads them several times, and the transactions may be dear to compute.
    return winners_by_anchor(materialise(transactions.select(EVIDENCE).distinct(), "evidence"), rules)


def with_winner(transactions: DataFrame, winners: DataFrame, spread: list[str], whole: bool = False) -> DataFrame:
    """Transactions with their `winner`, NULL where there is none. `whole`: winners are sent to all transactions."""
    combined = F.coalesce(F.col("sourceCategoryName"), F.lit(""))
    winners = winners.withColumn("_category", combined).drop("sourceCategoryName")
    on = ["sourceAccountType", "_category", "transactionType", "transactionRuleMatchText"]
    return lookup(
        transactions.withColumn("_category", combined), F.broadcast(winners) if whole else winners, on, spread=spread
    ).drop("_category")


def match_rules(transactions: DataFrame, rules: DataFrame, spread: tuple[str, ...] = ("sourceRowIdentifier",)) -> DataFrame:
    """Transactions with a `winner` struct (WINNER), NULL where no rule matches. `rules`: classifying_rules(...).

    The highest priority wins, then the largest key; a rule without priority comes after all others, one of an unknown
    match type never matches.
    """
    return with_winner(transactions, winners_of(transactions, rules), list(spread))
