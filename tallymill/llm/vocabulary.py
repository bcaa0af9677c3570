"""Public tokenizer files behind one small interface.

A byte-level BPE file of the tokenizers library is compiled to rank form, where its merges are listed in id order: both
libraries then apply the same merges to the same pieces, and the rank form takes a third of the CPU time. Any other file,
and any text with runs that the rank form splits in quadratic time, goes to the library that the file is made for.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

#: Fixed value: the split pattern of byte-level BPE files with `use_regex`.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer runs without white space, or of white space, go to the tokenizers library.
LONG_RUN = re.compile(r"\S{4096}|\s{4096}")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in set(plain)))
    return letters


class Vocabulary:
    """encode, count and (byte-level only) decode, with special strings in a text as the file's library takes them."""

    def __init__(self, path: str):
        self.path, self.ranks, self.special = path, None, {}
        kind = os.path.splitext(path)[1]
        if kind == ".model":
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: self.pieces.encode(list(texts), num_threads=1)
        elif kind == ".tiktoken":
            with open(path, "rb") as lines:
                self._ranked({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, {})
            self.encode = lambda texts: [self.ranks.encode_ordinary(t) for t in texts]
        else:
            with open(path, encoding="utf-8") as file:
                self._compile(json.load(file))
            self.encode = self._encode_ranked if self.ranks else self._encode_library

    @cached_property
    def library(self):
        """The file in the library it is made for; loaded only where it is needed."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(self.path)
        loaded.no_truncation()
        loaded.no_padding()
        return loaded

    @property
    def splits_safely(self) -> bool:
        """A space before an ASCII letter or digit always begins a new piece, so texts may be cut there."""
        return self.ranks is not None

    def count(self, texts) -> list[int]:
        return [len(x) for x in self.encode(texts)]

    def _encode_library(self, texts) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _encode_ranked(self, texts) -> list[list[int]]:
        plain, marked = self.ranks.encode_ordinary, self.special
        out = []
        for text in texts:
            if len(text) > 4096 and LONG_RUN.search(text):
                out += self._encode_library([text])
            elif any(s in text for s in marked):
                out.append(self.ranks.encode(text, allowed_special="all"))
            else:
                out.append(plain(text))
        return out

    def _ranked(self, ranks: dict[bytes, int], special: dict[str, int]) -> None:
        import tiktoken

        self.special = special
        self.ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        size = max([*ranks.values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, k in ranks.items():
            self.token_bytes[k] = token
        for text, k in special.items():
            self.token_bytes[k] = text.encode()
        self.token_length = np.fromiter(map(len, self.token_bytes), np.int64, size)

    def _compile(self, file: dict) -> None:
        """Rank form, if the file says nothing that it can't express."""
        model, letters = file["model"], byte_letters()
        expected = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        pre = file.get("pre_tokenizer") or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
        added = file.get("added_tokens", [])
        if model.get("type") != "BPE" or any(odd) or file.get("normalizer") or any(pre.get(k) != v for k, v in expected.items()):
            return
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or re.search(r"\s", a["content"]) for a in added):
            return
        special = {a["content"]: a["id"] for a in added}
        vocab = {t: k for t, k in model["vocab"].items() if t not in special}
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(b <= a for a, b in zip(order, order[1:])) or len(order) + 256 != len(vocab) or min(order, default=256) < 256:
            return
        self._ranked({bytes(letters[c] for c in t): k for t, k in vocab.items()}, special)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids stand for; bytes that are no UTF-8 become the replacement character."""
        if self.ranks is None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        raw = b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


SAFE_CUT = re.compile(rb" (?=[A-Za-z0-9])")


def safe_pieces(text: bytes, limit: int) -> list[bytes]:
    """The text in pieces of about `limit` bytes, cut only where a new piece of the vocabulary's pattern begins."""
    pieces, at = [], 0
    while len(text) - at > limit:
        cut = SAFE_CUT.search(text, at + limit)
        if not cut:
            break
        pieces.append(text[at:cut.start()])
        at = cut.start()
    return [*pieces, text[at:]]
