"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is read in two ways: as its lower-cased words, and as the shapes of its words (runs of lower case, upper case and
digits as one letter each, other signs as they are, and a mark where a word repeats the one before). Word unigrams and
bigrams of both readings are hashed to one weight vector; each of the four groups counts in shares of the text, so texts
of any length compare. A score is a sparse dot product of these shares and the weights.

The model is fitted on at most `MAX_ROWS` labelled rows, those with the smallest hash of their id; everything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import Texts, mixed, prefix_hash, span_hash, text_or_empty, tuned, word_spans

#: Weights are 2**DIMENSIONS; documented bound of the rows that a model is fitted on.
DIMENSIONS, MAX_ROWS = 18, 4096
#: FTRL-proximal: learning rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
EPOCHS, FOLDS, THRESHOLD = 3, 5, 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_STEP = np.uint64(0xD1342543DE82EF95)


def features(texts: Texts, dimensions: int = DIMENSIONS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, weight numbers, shares, first feature of each text and one more) of slices of the texts."""
    shift = np.uint64(64 - dimensions)
    for first, end, data, offsets in texts.slices():
        starts, ends, bounds = word_spans(data, offsets)
        lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        words = span_hash(prefix_hash(lower), starts, ends)
        # A sign that repeats the one before it within a word does not count for its shape.
        kinds = _CLASS[data]
        keep = np.ones(len(kinds), bool)
        keep[1:] = kinds[1:] != kinds[:-1]
        keep[starts] = True
        places = np.concatenate(([0], np.cumsum(keep)))
        shapes = span_hash(prefix_hash(kinds[keep]), places[starts], places[ends])
        owner = np.repeat(np.arange(end - first), np.diff(bounds))
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        shapes = shapes + same.astype(np.uint64) * _STEP
        paired = owner[1:] == owner[:-1]
        groups = [(words, owner), (shapes, owner)]
        groups += [((x[:-1] * _STEP + x[1:])[paired], owner[1:][paired]) for x in (words, shapes)]
        numbers, shares, owners = [], [], []
        for k, (hashes, own) in enumerate(groups):
            numbers.append(mixed(hashes + np.uint64(k + 1)) >> shift)
            counts = np.bincount(own, minlength=end - first)
            shares.append((1.0 / np.maximum(counts, 1))[own])
            owners.append(own)
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        yield (first, end, np.concatenate(numbers)[order].astype(np.int64), np.concatenate(shares)[order],
               np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=end - first)))))


class Ftrl:
    """FTRL-proximal for logistic loss, one example at a time; the last weight is the intercept."""

    def __init__(self, size: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float, importance: float = 1.0) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x * importance
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit_rows(texts: pa.Array, labels: np.ndarray, dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the intercept last) of a model of these texts; both classes count alike."""
    size = 1 << dimensions
    examples = []
    for _, end, numbers, shares, bounds in features(Texts(texts), dimensions):
        for i in range(len(bounds) - 1):
            at, inverse = np.unique(numbers[bounds[i]:bounds[i + 1]], return_inverse=True)
            x = np.bincount(inverse, shares[bounds[i]:bounds[i + 1]], len(at)) if len(at) else np.zeros(0)
            examples.append((np.append(at, size).astype(np.int32), np.append(x, 0.25).astype(np.float32)))
    model, order = Ftrl(size), np.random.default_rng(7)
    share = max(float(np.mean(labels)) if len(labels) else 0.5, 1e-6)
    weigh = {1: min(0.5 / share, 20.0), 0: min(0.5 / max(1 - share, 1e-6), 20.0)}
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            model.update(*examples[i], float(labels[i]), weigh[int(labels[i])])
    out = model.weights()
    out[-1] *= 0.25
    return out


def scored(texts: Texts, weights: np.ndarray, dimensions: int) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, end, numbers, shares, bounds in features(texts, dimensions):
        sums = np.concatenate(([0.0], np.cumsum(weights[numbers] * shares)))
        out[first:end] = sums[bounds[1:]] - sums[bounds[:-1]]
    return 1 / (1 + np.exp(-np.clip(out + weights[-1], -35, 35)))


def fold(id_column: Column, folds: int = FOLDS) -> Column:
    """The id's fold: CRC-32 of its text; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_column.cast("string"), "UTF-8")), F.lit(folds)), F.lit(0))


def train(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
          max_rows: int = MAX_ROWS, folds: int = FOLDS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weights of a model fitted on up to max_rows labelled rows outside fold 0.

    Rows with a null label, and ids with contradicting labels, are left out; of repeated ids any one row counts. Without
    labelled rows all weights are 0, and every score is 0.5.
    """
    spark = df.sparkSession
    known = labels.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{label_column}`").cast("int").alias("_y")).where("_y in (0, 1)")
    known = known.where(fold(F.col("_id"), folds) != 0).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))  # max_rows pairs of numbers
    sample = df.select(F.col(f"`{id_column}`").alias("_id"), text_or_empty(text_column).alias("_text")).join(chosen, "_id")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("_id").sort_values("_id")
        weights = fit_rows(pa.array(rows["_text"], pa.string()), rows["_y"].to_numpy(), dimensions)
        return pd.DataFrame({"w": [weights.astype("<f4").tobytes()]})

    found = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "w binary").first()  # one group of max_rows rows at most
    return np.frombuffer(bytes(found["w"]), "<f4").astype(np.float64) if found else np.zeros((1 << dimensions) + 1)


def score(text: Column, weights: np.ndarray, dimensions: int = DIMENSIONS) -> Column:
    """Chance that a text is of label 1; the weights have a fixed size, whatever the corpus."""
    shared = SparkSession.active().sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf("double")
    def dot(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value.astype(np.float64)
        for column in columns:
            yield pa.array(scored(Texts(column), w, dimensions))

    return dot(text)


def score_documents(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    label_column: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of df: id, held_out (fold 0), score, predicted (score >= threshold).

    Only texts are scored: ids, labels and other columns are no inputs. Null texts score as empty ones, which have no
    features and get the score of the intercept. Repeated rows and null ids keep their rows; an empty table gives an
    empty one.
    """
    tuned(df.sparkSession)
    weights = train(df, labels, id_column, text_column, label_column, max_rows)
    own = F.col(f"`{id_column}`")
    return df.select(own.alias(id_column), (fold(own) == 0).alias("held_out"), score(text_or_empty(text_column), weights).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
