"""Prefix trie of conversations by truncation peeling.

A conversation is a chain: for each turn 36 bytes, a SHA-256 over all turns so far and the bytes of the turn's text. The
first d elements name a node of depth d, its last element alone, too. Chains are sorted over the cluster, so everything
below a node stands together, and are peeled in blocks: from the block's greatest depth on, chains that end there are merged
with the nodes that are left of the depth below; a node's numbers are then complete, it is written, loses its last turn and
goes to its parent, where it meets its siblings. So nodes are found and summed up in one pass over the block.

Nodes at the edge of a block, the prefixes of its first and last chain, may have more below them in other blocks. They stay
behind with what they have gathered, and are peeled in the next round together with those of all blocks, until one block
holds them all. Rounds number as the logarithm of the chains, whatever the depth, and a node that a third of the
conversations share is summed in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import kept, release, tuned
from tallymill.llm.runs import hex_digest, joined_runs, run_rows, run_schema

#: Bytes of a chain's element: a digest, then the length of the turn's text.
DIGEST, ELEMENT = 32, 36
#: Bytes of chains (with some for each row) that are peeled at once in the first round.
BLOCK_BYTES = 4 << 20
_ROW = "done boolean, chain binary, key binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint"
_TYPES = [pa.bool_(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 6]
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


# --- chains ----------------------------------------------------------------------------------------------------------

def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): for each turn in order the digest of role and text, and the text's length.

    Null turns come first, turns of one number are ordered by digest; null roles and texts are empty. Rows without conv_id
    belong to no conversation. A conversation's turns are one value, 36 bytes a turn: 50 million turns fit.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    element = F.concat(whole, F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", element.alias("e")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: t["e"])
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(turns, "")).alias("turns"))


def shared_beginnings(lists: DataFrame) -> DataFrame:
    """Each conversation c begins with the first crc32(c) % 9 turns of conversation c - c % 5 in place of as many of its own."""
    first = lists.select(F.col("conv_id").alias("from_id"), F.col("turns").alias("from_turns"))
    rows = lists.withColumn("from_id", F.expr("conv_id - conv_id % 5")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
    rows = rows.join(first, "from_id", "left")
    head = F.coalesce(F.expr(f"substring(from_turns, 1, {ELEMENT} * h)"), F.lit(b""))
    return rows.select("conv_id", F.concat(head, F.expr(f"substring(turns, {ELEMENT} * h + 1)")).alias("turns"))


def chained(turns: Column) -> Column:
    """Lists of turns with every digest replaced by one over it and all before it."""

    @F.arrow_udf("binary")
    def chain(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for value in column.to_pylist():
                last, elements = b"", []
                for at in range(0, len(value), ELEMENT):
                    last = hashlib.sha256(last + value[at:at + ELEMENT]).digest()
                    elements += [last, value[at + DIGEST:at + ELEMENT]]
                out.append(b"".join(elements))
            yield pa.array(out, pa.binary())

    return chain(turns)


# --- peeling ---------------------------------------------------------------------------------------------------------

def _merged(level: dict, name: bytes, chain: bytes, node: tuple) -> None:
    """Add (least conv_id, n_convs, n_children, n_leaves, saved below) to the node of that name."""
    old = level.get(name)
    if old is None:
        level[name] = (chain, *node)
    else:
        least = node[0] if old[1] is None else old[1] if node[0] is None else min(old[1], node[0])
        level[name] = (old[0], least, *(a + b for a, b in zip(old[2:], node[1:])))


def peel(chains: list[bytes], nodes: list[tuple], whole: bool) -> Iterator[tuple]:
    """Rows of _ROW for one block. chains are sorted; nodes: (least, n_convs, n_children, n_leaves, saved below) of each."""
    name = lambda chain, depth: chain[ELEMENT * (depth - 1):ELEMENT * depth] if depth else b""
    edges = set() if whole else {name(c, d) for c in (chains[0], chains[-1]) for d in range(len(c) // ELEMENT + 1)}
    ended: dict[int, list[int]] = {}
    for k, chain in enumerate(chains):
        ended.setdefault(len(chain) // ELEMENT, []).append(k)
    level: dict[bytes, tuple] = {}
    for depth in range(max(ended), -1, -1):
        for k in ended.pop(depth, ()):
            _merged(level, name(chains[k], depth), chains[k], nodes[k])
        above: dict[bytes, tuple] = {}
        for own, (chain, least, convs, children, leaves, below) in level.items():
            if own in edges:
                yield False, chain[:ELEMENT * depth], None, None, depth, least, convs, children, leaves, below
                continue
            leaves = leaves if children else 1
            saved = below + (convs - 1) * int.from_bytes(own[DIGEST:], "big")
            parent = name(chain, depth - 1) if depth else None
            yield True, None, own, parent, depth, least, convs, children, leaves, saved
            if depth:
                _merged(above, parent, chain, (least, convs, 1, leaves, saved))
        level = above


def peeled(items: DataFrame, block_bytes: int, whole: bool = False) -> DataFrame:
    """One round over items (chain, conv_id, n_convs, n_children, n_leaves, saved)."""
    numbers = ["conv_id", "n_convs", "n_children", "n_leaves", "saved"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        chains, nodes, size = [], [], 0
        for batch in batches:
            for chain, *node in zip(*(batch[n].to_pylist() for n in ("chain", *numbers))):
                if size >= block_bytes and not whole:
                    yield from peel(chains, nodes, False)
                    chains, nodes, size = [], [], 0
                chains.append(chain)
                nodes.append(tuple(node))
                size += len(chain) + 100
        if chains:
            yield from peel(chains, nodes, whole)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in _ended(rows(batches)):
            if row is not None:
                held.append(row)
            if held and (row is None or len(held) == 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)
                held = []

    placed = items.coalesce(1) if whole else items.repartitionByRange("chain", "conv_id")
    return placed.sortWithinPartitions("chain", "conv_id").select("chain", *numbers).mapInArrow(blocks, _ROW)


def _ended(rows: Iterable[tuple]) -> Iterator[tuple | None]:
    yield from rows
    yield None


def trie_nodes(chains: DataFrame, block_bytes: int = BLOCK_BYTES, scratch: list[str] | None = None) -> DataFrame:
    """key, parent, depth, conv_id, n_convs, n_children, n_leaves, saved of every node of chains (conv_id, chain).

    Keys are the last elements of the nodes' chains, that of the root is empty and its parent null. Blocks double from
    round to round, so that the rounds end whatever the chains look like.
    """
    none = F.lit(0).cast("bigint")
    # Equal chains are one item with the number of conversations, added up before the shuffle.
    items = chains.groupBy("chain").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).withColumns(
        {"n_children": none, "n_leaves": none, "saved": none})
    whole, found = False, None
    while True:
        rows = kept(peeled(items, block_bytes, whole), "peeled", scratch)
        done = rows.where("done").drop("done", "chain")
        found = done if found is None else found.union(done)
        if whole:
            return found
        block_bytes *= 2
        items = rows.where("not done").select("chain", "conv_id", "n_convs", "n_children", "n_leaves", "saved")
        whole = (items.agg(F.sum(F.octet_length("chain").cast("bigint") + 100)).first()[0] or 0) <= block_bytes


def ends(chains: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end: the digest of their ids, ascending, joined by commas."""
    rows = chains.select(F.coalesce(F.expr(f"substring(chain, -{ELEMENT})"), F.lit(b"")).alias("key"), "conv_id")
    placed = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                for key, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist()):
                    yield key, (1,), (b"%d," % conv,)

        return run_rows(items(), pa.binary(), trim=1)

    done = joined_runs(placed.mapInArrow(listed, run_schema("binary")), 1, scratch)
    return done.select("key", hex_digest("parts", 0).alias("ends_sha256"))


def prefix_trie(lists: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per node of conversations (conv_id, turns as `turn_lists` gives them): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Equal conversations are members of the same nodes; one without turns is a member of the root. No conversation, no root:
    an empty table gives an empty one.
    """
    spark, scratch = tuned(lists.sparkSession), []
    chains = kept(lists.select("conv_id", chained(F.col("turns")).alias("chain")), "chains")
    nodes = kept(trie_nodes(chains, block_bytes, scratch), "nodes")
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, "parent", "left").join(ends(chains), "key", "left")
    release(spark, scratch)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
