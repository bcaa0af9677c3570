"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm.common import table
from tallymill.llm.oracles import OP2, OP4, OP9, OP11, OP12, OP13

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.decontamination import contaminated_spans, summary

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summary(contaminated_spans(documents, table(spark, sf_dir, "benchmark")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.html_extraction import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.chat_format import event_log, formatted, read_back

    marks = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS bigint) conv_id", "CAST(turn AS bigint) turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(formatted(event_log(turns.union(odd))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.prefix_trie import prefix_trie, shared_beginnings, turn_lists

    return prefix_trie(shared_beginnings(turn_lists(table(spark, sf_dir, "conversations"))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.llm.lexical_search import search

    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_chat_format": op11_chat_format,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {
    "op2_decontamination": OP2, "op4_suffix_dedup": OP4, "op9_warc": OP9, "op11_chat_format": OP11, "op12_prefix_trie": OP12,
    "op13_lexical_search": OP13,
}
