"""BPE encoding and decoding with content-defined chunks.

A rolling hash cuts texts where the last bytes say so, so passages that documents share are cut alike. Documents are dealt
to tasks by their smallest chunk hash: those that share text mostly meet in one task, where a chunk is encoded once and
its ids are reused. A chunk's own tokens can be wrong only next to its two ends. The join of two chunks is therefore
encoded anew, from the last boundary inside the left chunk to the first inside the right one; where the tokens of the
chunks don't agree with these boundaries, or a chunk has none, the window grows until they do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import SLICE, Texts, mixed, powers, prefix_hash, struct_of, text_or_empty, tuned
from tallymill.llm.common import _UNBASE
from tallymill.llm.vocabulary import SAFE_CUT, Vocabulary, vocabulary

#: Bytes that the rolling hash sees, mean and least length of a chunk.
WINDOW, MEAN_CHUNK, LEAST_CHUNK = 32, 1024, 128
#: Bytes of chunks and ids that a task keeps for reuse.
CACHE_BYTES = 16 << 20


def cuts(text: np.ndarray) -> list[int]:
    """Where the chunks of a text end, its own end included; never inside a character."""
    n, found, last = len(text), [], 0
    for at in range(0, n, SLICE):
        part = text[max(0, at - WINDOW):at + SLICE]
        if len(part) <= WINDOW:
            break
        sums = prefix_hash(part)
        rolling = mixed((sums[WINDOW:] - sums[:-WINDOW]) * powers("unbase", _UNBASE, len(sums))[:-WINDOW])
        ends = np.flatnonzero(rolling % np.uint64(MEAN_CHUNK) == 0) + WINDOW + max(0, at - WINDOW)
        ends = ends[ends < n]
        for end in ends[(text[ends] & 0xC0) != 0x80].tolist():
            if end - last >= LEAST_CHUNK and end > at:
                found.append(end)
                last = end
    return [*found, n] if n else []


def home(text: Column) -> Column:
    """The smallest hash of a text's chunks: texts that share most chunks share it most of the time."""

    @F.arrow_udf("bigint")
    def smallest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = Texts(column)
            out = np.zeros(len(texts), np.int64)
            for i in range(len(texts)):
                part = texts.data[texts.offsets[i]:texts.offsets[i + 1]]
                ends = cuts(part)
                if ends:
                    raw, starts = part.tobytes(), [0, *ends[:-1]]
                    out[i] = min(int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(starts, ends))
            yield pa.array(out)

    return smallest(text)


class Reuse:
    """Chunk bytes to ids and the places where its tokens end; oldest chunks go when the room is used up."""

    def __init__(self, vocab: Vocabulary, room: int = CACHE_BYTES):
        self.vocab, self.room, self.held = vocab, room, 0
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def fill(self, chunks: list[bytes]) -> None:
        """Encode those not known, each once."""
        missing = [c for c in dict.fromkeys(chunks) if c not in self.known]
        for chunk, ids in zip(missing, self.vocab.encode([c.decode("utf-8") for c in missing])):
            ids = np.asarray(ids, np.uint32)
            self.known[chunk] = ids, np.cumsum(self.vocab.token_length[ids])
            self.held += len(chunk) + 12 * len(ids) + 200
        if self.held > self.room:
            needed = set(chunks)
            for chunk in [c for c in self.known if c not in needed]:
                if self.held <= self.room // 2:
                    break
                ids, _ = self.known.pop(chunk)
                self.held -= len(chunk) + 12 * len(ids) + 200

    def __getitem__(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.known[chunk]


def token_edge(ends: np.ndarray, at: int) -> int | None:
    """How many tokens end up to `at`; None if a token lies across it."""
    if at == 0:
        return 0
    k = int(np.searchsorted(ends, at))
    return k + 1 if k < len(ends) and ends[k] == at else None


def joined(raw: bytes, ends: list[int], reuse: Reuse) -> np.ndarray:
    """Ids of a whole text from the ids of its chunks."""
    starts = [0, *ends[:-1]]
    chunks = [raw[a:b] for a, b in zip(starts, ends)]
    reuse.fill(chunks)
    if len(chunks) == 1:
        return reuse[chunks[0]][0]
    out: list[np.ndarray] = []
    window = -1  # where the text still to be encoded anew begins; -1: none is open
    for k, (a, b, chunk) in enumerate(zip(starts, ends, chunks)):
        ids, edges = reuse[chunk]
        first = 0
        if k:
            first = None
            for found in SAFE_CUT.finditer(chunk, 0, len(chunk)):
                if (edge := token_edge(edges, found.start())) is not None:
                    first = found.start()
                    break
            if first is None:
                continue  # no boundary in this chunk: the window grows over it
            anew = raw[window:a + first]
            out.append(np.asarray(reuse.vocab.encode([anew.decode("utf-8")])[0], np.uint32) if anew else ids[:0])
            window = -1
        last = None
        if k + 1 == len(chunks):
            last = len(chunk)
        else:
            at = len(chunk) - 1
            while (at := chunk.rfind(b" ", first, at)) >= 0:
                if SAFE_CUT.match(chunk, at) and token_edge(edges, at) is not None:
                    last = at
                    break
            last = first if last is None else last
        out.append(ids[token_edge(edges, first):token_edge(edges, last)])
        if k + 1 < len(chunks):
            window = a + last
    if window >= 0:
        out.append(np.asarray(reuse.vocab.encode([raw[window:].decode("utf-8")])[0], np.uint32))
    return np.concatenate(out)


def encoded(text: Column, path: str, with_ids: bool = False) -> Column:
    """n_tokens, ids_sha256, decoded_sha256 of each text (and the ids, if asked for)."""
    kind = "n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>" * with_ids

    @F.arrow_udf(f"struct<{kind}>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        reuse = Reuse(vocab)
        for column in columns:
            texts, counts, sums, back, kept = Texts(column), [], [], [], []
            for i in range(len(texts)):
                part = texts.data[texts.offsets[i]:texts.offsets[i + 1]]
                raw = part.tobytes()
                if not raw:
                    ids = np.zeros(0, np.uint32)
                elif vocab.splits_safely:
                    ids = joined(raw, cuts(part), reuse)
                else:
                    ids = np.asarray(vocab.encode([raw.decode("utf-8")])[0], np.uint32)
                counts.append(len(ids))
                sums.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids.astype(np.int32))
            fields = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield struct_of(fields | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if with_ids else {}))

    return encode(text)


def together(df: DataFrame, id_column: str, text_column: str, parts: int) -> DataFrame:
    """df dealt out so that texts which share chunks meet; homes with more than one part's bytes go to several."""
    sized = df.withColumn("_home", home(F.col(text_column)))
    bytes_of = sized.groupBy("_home").agg(F.sum(F.octet_length(text_column)).alias("n"))
    whole = df.agg(F.sum(F.octet_length(text_column).cast("long"))).first()[0] or 0
    share = max(whole // max(parts, 1), 1 << 20)
    # Each hot home holds a part's share of all bytes, so there are no more of them than parts.
    hot = {r["_home"]: int(-(-r["n"] // share)) for r in bytes_of.where(F.col("n") > share).collect()}
    salt = F.lit(0).cast("long")
    if hot:
        splits = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
        # By id and text, so that repeated and null ids are dealt out as well, and a stage run again deals alike.
        salt = F.pmod(F.xxhash64(id_column, text_column), F.coalesce(splits[F.col("_home")], F.lit(1)))
    return sized.repartition(parts, F.col("_home"), salt).drop("_home")


def encode_documents(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False,
                     parts: int | None = None) -> DataFrame:
    """One row per row of df: id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256 (and ids).

    Ids are those of the file's own library without added special tokens, truncation or padding; a null or empty text has
    none. Repeated rows and null ids keep their rows; further columns are ignored; an empty table gives an empty one.
    """
    spark = tuned(df.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(f"`{id_column}`").alias("_id"), text_or_empty(text_column).alias("_text"))
    rows = together(texts, "_id", "_text", parts).select("_id", encoded(F.col("_text"), path, with_ids).alias("_e"))
    return rows.select(F.col("_id").alias(id_column), "_e.*")
