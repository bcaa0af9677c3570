"""Chat formatting, the prefix trie and digests of runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql.functions import spark_partition_id

from tallymill.llm import runs
from tallymill.llm.chat_format import CONTROL, escape, event_log, formatted, read_back, read_turns, render, unescape
from tallymill.llm.prefix_trie import prefix_trie, shared_beginnings, turn_lists
from tallymill.llm.queries import op11_chat_format, op12_prefix_trie

from .conftest import SF

LOG = "conv_id bigint, message bigint, seq bigint, event string, role string, text string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def conversations(spark):
    found = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    return found


# --- chat formatting ---------------------------------------------------------------------------------------------------

def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(render(r, t)[0]) for r, t in turns))


def test_texts_come_back_whatever_they_hold():
    rng = random.Random(4)
    bits = [*CONTROL, *(c[0] + "\\" * k + c[1:] for c in CONTROL for k in (1, 2)), "<", "[", "\\", "|", "s>", "é", "\n", "a ", "\U0001f600"]
    line, want = "", []
    for _ in range(400):
        role, text = ("".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(2))
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)
        turn, loss = render(rng.choice(["assistant", role]), text)
        if loss:
            assert unescape(turn[loss[0]:loss[1]]) == text
        line += turn
        want.append(next(read_turns(turn)))
        assert want[-1][1] == text
    assert list(read_turns(line)) == want


def test_conversations_of_the_table(spark, conversations):
    marks = "</s>[INST] ok [/INST]"
    got = {r.conv_id: tuple(r)[1:] for r in op11_chat_format(spark, SF).collect()}
    assert got == {c: digests(t) for c, t in {**conversations, -7: [("user", marks), ("assistant", marks)]}.items()}


def brute_fold(log):
    """log: (conv, message, seq, event, role, text). Turns of every conversation."""
    found = {}
    for conv, message in sorted({(r[0], r[1]) for r in log}):
        role, text, there, seen = "", "", False, set()
        for _, _, seq, event, by, piece in sorted((r for r in log if (r[0], r[1]) == (conv, message)), key=lambda r: (r[2], r[3], r[4] or "", r[5] or "")):
            if seq in seen:
                continue
            seen.add(seq)
            role = by if by is not None and event in ("open", "delta", "edit", "regenerate") else role
            if event == "delta":
                text, there = text + (piece or ""), True
            elif event in ("open", "edit"):
                text, there = piece or "", True
            elif event == "regenerate":
                text, there = "", True
            elif event == "remove":
                text, there = "", False
        if there:
            found.setdefault(conv, []).append((role, text))
    return found


def test_folded_logs(spark, monkeypatch):
    rng = random.Random(2)
    log = []
    for conv in range(30):
        for message in range(rng.randrange(1, 6)):
            log.append((conv, message, 0, "open", rng.choice(["user", "assistant"]), rng.choice([None, "hello "])))
            for seq in range(1, rng.randrange(1, 9)):
                event = rng.choice(["delta"] * 5 + ["edit", "regenerate", "remove", "seen"])
                log.append((conv, message, seq, event, rng.choice([None, None, "assistant"]), rng.choice([None, "", "abc", "<s> x", "é"])))
    log += rng.sample(log, 20) + [(40, 1, 5, "delta", "assistant", "no open event"), (41, 1, 0, "remove", None, None)]
    rng.shuffle(log)
    rows = spark.createDataFrame([(*r, "clash") for r in log], LOG)
    want = {c: digests(t) for c, t in brute_fold(list(set(log))).items()}
    for chunk in (None, 10):
        assert {r.conv_id: tuple(r)[1:] for r in read_back(formatted(rows), chunk).collect()} == want
    assert read_back(formatted(rows.limit(0))).count() == 0


def test_odd_turns(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, message string"
    long = "long \U0001f600\n" * 60_000
    data = [(1, 2, "assistant", long), (1, None, "system", None), (1, 0, None, "a"), (2, 0, "assistant", None), (None, 0, "assistant", "b"),
            (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    got = {r.conv_id: tuple(r)[1:] for r in read_back(formatted(event_log(spark.createDataFrame([(*r, "m") for r in data], kind)))).collect()}
    assert got == {1: digests([("system", ""), ("", "a"), ("assistant", long)]), 2: digests([("assistant", "")]), None: digests([("assistant", "b")]),
                   3: digests([("user", "same")] * 3)}


def test_one_conversation_over_many_tasks(spark):
    """All rows have one key: each task closes nothing, and its chunks are streamed in order."""
    turns = [("assistant" if k % 2 else "user", f"text {k}") for k in range(5000)]
    rows = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = formatted(event_log(rows))
        assert done.select(spark_partition_id().alias("p")).distinct().count() > 3
        assert [tuple(r)[1:] for r in read_back(done, chunk=1000).collect()] == [digests(turns)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- runs --------------------------------------------------------------------------------------------------------------

def test_runs_close_inside_a_partition_only():
    items = [(k, (1,), (b"%d," % n,)) for k in range(4) for n in range(3)]
    rows = [r for b in runs.run_rows(iter(items), pa.int64(), trim=1) for r in b.to_pylist()]
    assert [(r["key"], r["closed"], r["counts"]) for r in rows] == [(0, False, [3]), (1, True, [3]), (2, True, [3]), (3, False, [3])]
    assert rows[1]["parts"] == [hashlib.sha256(b"0,1,2").digest()] and rows[3]["parts"] == [b"0,1,2,"]
    assert all(not r["closed"] for b in runs.run_rows(iter(items), pa.int64(), chunk=4) for r in b.to_pylist())


# --- prefix trie -------------------------------------------------------------------------------------------------------

def brute_trie(rebuilt):
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, own in members.items():
        below = [m for m in members if m[:len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[:len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ended = sorted(c for c in own if len(rebuilt[c]) == len(node))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves), saved, sha(",".join(map(str, ended)))))
    return out


def rebuilt_of(conversations):
    def whole(c):
        h = zlib.crc32(str(c).encode()) % 9
        return [*conversations.get(c - c % 5, [])[:h], *conversations[c][h:]]

    return {c: whole(c) for c in conversations}


def test_trie_of_the_table(spark, conversations):
    got = [tuple(r) for r in op12_prefix_trie(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rebuilt_of(conversations))


def chains(spark, rebuilt):
    """turn_lists of conversations, with those without turns."""
    rows = [(c, k, r, t) for c, turns in rebuilt.items() for k, (r, t) in enumerate(turns)]
    lists = turn_lists(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    return lists.union(spark.createDataFrame([(c, bytearray()) for c, t in rebuilt.items() if not t], lists.schema))


@pytest.mark.parametrize("block", [1, 700, 1 << 20])
def test_trie_in_blocks(spark, block):
    """Deep, equal, nested and branching conversations; blocks of one chain and more."""
    rng = random.Random(7)
    rebuilt = {c: [(rng.choice(["user", "assistant"]), rng.choice(["", "a", "é"])) for _ in range(rng.randrange(7))] for c in range(120)}
    deep = [("user", f"turn {k}") for k in range(300)]
    rebuilt |= {200: deep, 201: deep[:150], 202: deep[:150], 203: [*deep[:100], ("user", "other")], 204: deep, 205: []}
    got = [tuple(r) for r in prefix_trie(chains(spark, rebuilt), block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rebuilt)


def test_odd_conversations(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, parent string, depth int"
    data = [(10, None, None, None), (10, 0, "user", "a"), (11, 1, "user", "b"), (11, 1, "user", "b"), (None, 0, "user", "c"), (12, 5, "assistant", "x" * 200_000)]
    rows = spark.createDataFrame([(*r, "p", 1) for r in data], kind)
    conversations = {10: [("", ""), ("user", "a")], 11: [("user", "b")] * 2, 12: [("assistant", "x" * 200_000)]}
    assert {tuple(r) for r in prefix_trie(shared_beginnings(turn_lists(rows))).collect()} == brute_trie(rebuilt_of(conversations))
    assert prefix_trie(shared_beginnings(turn_lists(rows.limit(0)))).count() == 0
