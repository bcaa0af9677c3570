"""Every stage against a plain version of it on its own input, and odd tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from .conftest import SF
from .test_dedup import brute_components, brute_fingerprint
from .test_scans import brute_hits


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        out.append((name, docs, stage(spark, docs, SF)))
        out[-1][2].write.parquet(path)
        docs = spark.read.parquet(path)
        out[-1] = (*out[-1][:2], docs)
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_text", "decontamination", "tokens"]
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("quality", "near_duplicates", "repeated_text", "decontamination"):
        assert stages[name][1].dtypes == documents.dtypes


def test_quality_stage(stages, spark):
    before, after = map(rows, stages["quality"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [(r.doc_id in after) == bool(r.quality) for r in labels if r.doc_id in before]
    assert sum(right) / len(right) > 0.97 and all(after[i] == before[i] for i in after)


def test_near_duplicates_stage(stages):
    before, after = map(rows, stages["near_duplicates"])
    assert all(after[i] == before[i] for i in after)
    parts = brute_components({i: brute_fingerprint(r.text) for i, r in before.items()})
    assert set(after) == {i for i, c in parts.items() if i == c} and len(after) < len(before)


def test_repeated_text_stage(stages):
    before, after = map(rows, stages["repeated_text"])
    seen, changed = set(), 0
    for i in sorted(before):
        raw = before[i].text.encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = [True] * 100
            seen.add(raw[k:k + 100])
        at, left = 0, []
        for c in before[i].text:
            n = len(c.encode())
            if not all(gone[at:at + n]):
                left.append(c)
            at += n
        text = "".join(left)
        changed += text != before[i].text
        if text or not raw:
            assert after[i].text == text and after[i].n_chars == (len(text) if text != before[i].text else before[i].n_chars)
        else:
            assert i not in after
    assert changed


def test_decontamination_stage(stages, spark):
    before, after = map(rows, stages["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, r in before.items() if not brute_hits(r.text, items)[-1]}


def test_tokens_stage(stages):
    before, after = map(rows, stages["tokens"])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_tokens == len(library.encode(before[i].text, add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()


def test_run_gives_the_last_stage(stages, spark):
    want = sorted(map(tuple, stages["tokens"][1].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(stages["tokens"][1].columns).collect())) == want


def test_odd_tables(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, _doc string, removal string, n_words int"
    odd = [(1, None), (2, ""), (3, "plain words"), (3, "plain words"), (None, "other text here"), (4, "é" * 5000)]
    for data in ([], odd):
        spark.createDataFrame([(i, t, None, None, len(t or ""), "f", "d", "r", 1) for i, t in data], kind).write.parquet(str(tmp_path / f"t{len(data)}"))
        docs = spark.read.parquet(str(tmp_path / f"t{len(data)}"))
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(data)}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            after = spark.read.parquet(path)
            assert after.count() <= docs.count()
            if k < 4:
                assert after.columns == docs.columns
            docs = after
