"""From documents to token ids: five stages, each working on all rows that its predecessor kept.

1. quality: documents that the classifier rejects go. 2. near_duplicates: of each group whose SimHash fingerprints
(three-word shingles) are linked at two bits or fewer the document with the smallest id stays. 3. repeated_text: strings of 100 bytes that also
start earlier are cut out, whole characters only; documents of which nothing is left go. 4. decontamination: documents
with a window of a benchmark item go. 5. tokens: the rest is encoded and decoded.

All stages but the last return the columns of documents, in their order. Empty tables, null texts and repeated rows pass
through as the operators define; a null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.bpe import encode_documents
from tallymill.llm.common import shared_folder, table, text_or_empty, tuned
from tallymill.llm.decontamination import contaminated_spans
from tallymill.llm.quality import THRESHOLD, score, train
from tallymill.llm.queries import vocabulary_path
from tallymill.llm.simhash import without_copies
from tallymill.llm.suffix_dedup import with_removals


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(text_or_empty("text"), weights) >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs).select(docs.columns)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The other columns travel as one, so that none is taken for a column of the operator.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    rows = with_removals(docs.select("doc_id", "text", others.alias("others")), whole_characters=True)
    changed, left = F.col("removal.n_removed") > 0, F.decode(F.col("removal.kept"), "UTF-8")
    rows = rows.where(~(changed & (F.octet_length("removal.kept") == 0)))
    out = {c: F.col(f"others.`{c}`") for c in docs.columns if c not in ("doc_id", "text")}
    out |= {"doc_id": F.col("doc_id"), "text": F.when(changed, left).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.char_length(left).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*[out[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contaminated_spans(docs.select(F.struct("*").alias("row"), F.col("text")), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("found.spans") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: No stage but the fourth can be said in SQL; tests compare with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read by the next stage."""
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
