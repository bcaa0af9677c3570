"""Token counts and BPE against the library of the file, whole tables and odd texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymill.llm import bpe
from tallymill.llm.bpe import Reuse, cuts, encode_documents, joined
from tallymill.llm.queries import op5_bpe, op8_token_counts
from tallymill.llm.token_counts import count_tokens
from tallymill.llm.vocabulary import safe_pieces, vocabulary

from .conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "a", "é", "日本語のテキスト" * 400, "x" * 9000, " " * 9000, "a  b\t\n c <|endoftext|> d<|endoftext|>", "don't we'll I'M",
    "1234567 89 ½ ²", "🙂🙂 ok", "word " * 30000, "ab" * 3000 + " " + "cd" * 3000, "  x \u0085y", "<|endof", "text|>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_of_the_table(spark, texts, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op8_token_counts(spark, SF).collect()}
    for doc, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert got[doc] == (len(text.encode()), n, n > 1024)


def test_odd_texts(frame, library):
    df = frame([*enumerate(ODD), (None, "null id"), (3, "again"), (3, "again")])
    counts = count_tokens(df, PATH, piece_bytes=512, batch_bytes=2048).collect()
    assert len(counts) == len(ODD) + 3
    for r in (r for r in counts if r.doc_id is not None and r.doc_id != 3):
        assert r.n_tokens == len(library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids), r.doc_id
    for r in (r for r in encode_documents(df, PATH, with_ids=True).collect() if r.doc_id is not None and r.doc_id != 3):
        text = ODD[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids), r.doc_id
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(frame):
    assert count_tokens(frame([]), PATH).count() == 0
    assert encode_documents(frame([]), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(frame, name):
    import sentencepiece

    path = public_tokenizers.path(name)
    text = "The quick brown fox, 12 times! é"
    own = (sentencepiece.SentencePieceProcessor(model_file=path).encode(text) if name.endswith("model")
           else Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert count_tokens(frame([(1, text)]), path).first().n_tokens == len(own)


def test_bpe_of_the_table(spark, texts, library):
    got = {r.doc_id: r for r in op5_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_joins_are_exact_for_any_cuts(library, monkeypatch):
    """Tiny chunks: nearly every word is next to a join."""
    monkeypatch.setattr(bpe, "MEAN_CHUNK", 8)
    monkeypatch.setattr(bpe, "LEAST_CHUNK", 3)
    rng, vocab = random.Random(4), vocabulary(PATH)
    alphabet = ["the", "don't", "  ", " ", "\n", "é", "日本", "12", "!!", "<|endoftext|>", "x" * 40, "Q"]
    reuse, many = Reuse(vocab), 0
    for _ in range(300):
        text = "".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 90)))
        ends = cuts(np.frombuffer(text.encode(), np.uint8))
        many += len(ends) > 3
        assert joined(text.encode(), ends, reuse).tolist() == library.encode(text, add_special_tokens=False).ids
    assert many > 100


def test_shared_passages_are_cut_alike_and_encoded_once():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)).encode()
    vocab, reuse = vocabulary(PATH), Reuse(vocabulary(PATH))
    one, two = b"first start " + passage, b"another beginning, longer " + passage
    for text in (one, two):
        joined(text, cuts(np.frombuffer(text, np.uint8)), reuse)
    assert sum(map(len, reuse.known)) < 1.3 * len(passage)
    assert joined(two, cuts(np.frombuffer(two, np.uint8)), reuse).tolist() == vocab.library.encode(two.decode(), add_special_tokens=False).ids


def test_safe_pieces_give_the_text_back():
    text = ("some words é " * 500).encode()
    pieces = safe_pieces(text, 100)
    assert b"".join(pieces) == text and len(pieces) > 10
