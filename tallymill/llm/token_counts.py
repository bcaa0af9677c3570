"""Token counts: Arrow functions that return lengths only, in batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import Texts, text_or_empty, tuned
from tallymill.llm.vocabulary import safe_pieces, vocabulary

BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16


def token_count(text: Column, path: str, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> Column:
    """Number of tokens of each text; a null or empty text has none.

    Texts above `piece_bytes` are cut at safe boundaries, where the vocabulary has any, and their pieces are counted in
    whichever batches have room; a batch holds about `batch_bytes`. Token ids never leave the batch.
    """

    @F.arrow_udf("bigint")
    def lengths(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for column in columns:
            texts = Texts(column)
            totals = np.zeros(len(texts), np.int64)
            batch, owners, held = [], [], 0

            def flush():
                np.add.at(totals, owners, vocab.count(batch))
                batch.clear()
                owners.clear()

            for i in range(len(texts)):
                text = texts[i]
                for piece in safe_pieces(text, piece_bytes) if vocab.splits_safely else [text]:
                    batch.append(piece.decode("utf-8"))
                    owners.append(i)
                    held += len(piece)
                    if held >= batch_bytes:
                        flush()
                        held = 0
            if batch:
                flush()
            yield pa.array(totals)

    return lengths(text)


def count_tokens(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024,
                 batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per row of df: id, n_bytes (UTF-8), n_tokens, over_limit.

    Nulls count as empty texts (0, 0, false); repeated rows and null ids keep their rows; further columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    tuned(df.sparkSession)
    text = text_or_empty(text_column)
    return df.select(
        F.col(f"`{id_column}`").alias(id_column),
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(text, path, batch_bytes, piece_bytes).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
