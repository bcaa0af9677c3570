"""Leaf blocks of HTML pages: text between block borders, the open elements around it, and numbers a model can read."""

from __future__ import annotations

import html
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: what doesn't end a block, has no end, isn't text, and closes an open element of its kind.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea select svg math iframe object canvas title".split()
# Without an end tag these run to the page's end; of the others only the start tag is left out.
TO_END = frozenset("script style textarea title".split())
IN_HEAD = frozenset("base basefont bgsound link meta".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("ul ol dl table tr tbody thead tfoot select body html".split())

# Possessive, so that an attempt that fails has gone over the page once.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<[!?][^>]*+>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_BORDERS = re.compile("[>\"']")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Path:
    """The open elements around a block: this one's tag and names, and those outside. Blocks share them, so that nesting of
    any depth costs one step per element."""

    __slots__ = ("outer", "own", "bits", "told")

    def __init__(self, outer: Path | None, own: tuple[str, ...]):
        self.outer, self.own, self.told = outer, own, None
        self.bits = outer.bits if outer else 0
        for x in own:
            self.bits |= 1 << _PATH_OF[x]

    def items(self) -> tuple[str, ...]:
        found, path = [], self
        while path:
            found.append(path.own)
            path = path.outer
        return tuple(x for own in reversed(found) for x in own)


@dataclass(slots=True)
class Block:
    text: str
    where: Path | None
    linked: int = 0

    @property
    def path(self) -> tuple[str, ...]:
        return self.where.items() if self.where else ()


def names_of(attributes: str) -> tuple[str, ...]:
    found = []
    for groups in _NAMES.findall(attributes):
        value = next(filter(None, groups), "")
        found += _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return tuple(found)


class _Ends:
    """Where the tag that an unquoted place is in has its end, for all places behind `start`, found from the page's end."""

    def __init__(self, page: str, start: int):
        self.places, later = array("q", (m.start() for m in _BORDERS.finditer(page, start))), {}
        self.ends = array("q", bytes(8 * len(self.places)))
        for k in range(len(self.places) - 1, -1, -1):
            c = page[self.places[k]]
            if c == ">":
                self.ends[k] = self.places[k]
            else:  # a quoted value: on behind the next quote of its kind
                next_one = later.get(c)
                self.ends[k] = self.ends[next_one + 1] if next_one is not None and next_one + 1 < len(self.places) else -1
                later[c] = k

    def has_end(self, at: int) -> bool:
        k = bisect_left(self.places, at)
        return k < len(self.places) and self.ends[k] >= 0


def tokens_of(page: str) -> Iterator[tuple[str | None, str, str, str]]:
    """(text, or None and tag, end, attributes) of the page's tokens in order, without what is inside elements of RAW.
    Self-closed ones have no inside. A < that no tag begins with is text.

    Every place of the page is gone over a bounded number of times: once a tag has turned out to have no end, the ends of
    all tags behind it are known before they are tried.
    """
    at, unclosed, ends, last = 0, set(), None, -2
    while at < len(page):
        if ends is not None and page[at] == "<":
            name = _NAME.match(page, at)
            if name and not ends.has_end(name.end()) or page[at + 1:at + 2] in ("!", "?") and at > last and not page.startswith("<!--", at):
                yield "<", "", "", ""
                at += 1
                continue
        token = _TOKEN.match(page, at)
        text, tag = token["text"], (token["tag"] or "").lower()
        if ends is None and text == "<":
            ends, last = _Ends(page, at), page.rfind(">")
        at = token.end()
        attributes = token["attributes"] or ""
        if tag in _RAW_END and not token["end"] and tag not in unclosed and not _CLOSED.search(attributes):
            if end := _RAW_END[tag].search(page, at):
                at = end.end()
            elif tag in TO_END:
                at = len(page)
            else:
                unclosed.add(tag)
        yield text, tag, token["end"] or "", attributes


class _Open:
    """The open elements. Where the nearest of a kind stands is known, so no tag goes over all of them."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[Path] = []
        self.of: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []  # neither inline nor p

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        at = len(self.tags)
        self.paths.append(Path(self.paths[-1] if self.paths else None, (tag, *names)))
        self.tags.append(tag)
        self.of.setdefault(tag, []).append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        if tag not in INLINE and tag != "p":
            self.blocks.append(at)

    def close_down_to(self, at: int) -> None:
        while len(self.tags) > at:
            self.paths.pop()
            self.of[self.tags.pop()].pop()
        for held in (self.scopes, self.blocks):
            while held and held[-1] >= at:
                held.pop()

    def nearest(self, *tags: str) -> int:
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=-1)

    def end_before(self, tag: str) -> None:
        """Close what the start of a block element ends."""
        closing = CLOSES.get(tag, ("p",))
        at, held = self.nearest(*closing), self.blocks if closing == ("p",) else self.scopes
        if at >= 0 and (not held or at >= held[-1]):
            self.close_down_to(at)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order: character references decoded, white space made one space, empty ones left out.

    A head ends with its end tag, or before the first text or tag that cannot stand in it.
    """
    out: list[Block] = []
    opened = _Open()
    held: list[str] = []
    linked, where = 0, None
    in_head = False

    def finish():
        nonlocal linked, where
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, where, linked))
            held.clear()
        linked, where = 0, None

    for text, tag, end, attributes in tokens_of(page):
        if text:
            if in_head and text.isspace():
                continue
            in_head = False
            if not held and not text.isspace():
                where = opened.paths[-1] if opened.paths else None
            held.append(text)
            if opened.of.get("a"):
                linked += len(text)
            continue
        if not tag or tag in _RAW_END and not end:
            continue
        if tag == "head":
            in_head = not end
            continue
        if in_head and (end and tag not in ("body", "html") or tag in IN_HEAD):
            continue
        in_head = False
        if tag not in INLINE:
            finish()
        if end:
            if (at := opened.nearest(tag)) >= 0:
                opened.close_down_to(at)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            opened.end_before(tag)
        if not attributes.rstrip().endswith("/"):
            opened.push(tag, names_of(attributes))
    finish()
    return out


PATH_BITS, WORD_BITS = 512, 32
NUMBERS = 6
WIDTH = PATH_BITS + WORD_BITS + NUMBERS


class _Hashed(dict):
    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode()) % self.size
        if len(self) < 200_000:
            self[word] = value
        return value


_WORD_OF, _PATH_OF = _Hashed(WORD_BITS), _Hashed(PATH_BITS)
_ROW_OF: dict[int, np.ndarray] = {}


def path_row(where: Path | None) -> np.ndarray:
    bits = where.bits | 1 << _PATH_OF["leaf " + where.own[-1]] if where else 0
    row = _ROW_OF.get(bits)
    if row is None:
        row = np.unpackbits(np.frombuffer(bits.to_bytes(PATH_BITS // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
        if len(_ROW_OF) < 4_000:
            _ROW_OF[bits] = row
    return row


def vectors(blocks: list[Block], first: int = 0, end: int | None = None) -> np.ndarray:
    """A row for each of the page's blocks from `first` to `end`: hashed tag path, hashed words, and length, links, signs,
    digits and place."""
    part = blocks[first:end]
    out = np.zeros((len(part), WIDTH), np.float32)
    for k, block in enumerate(part, first):
        row, words, n = out[k - first], block.text.lower().split(), len(block.text)
        row[:PATH_BITS] = path_row(block.where)
        counts = np.bincount([_WORD_OF[w] for w in words], minlength=WORD_BITS)
        row[PATH_BITS:PATH_BITS + WORD_BITS] = counts / max(1.0, float(np.sqrt((counts * counts).sum())))
        row[PATH_BITS + WORD_BITS:] = (
            np.log1p(n) / 6, min(1.0, block.linked / n), sum(map(block.text.count, ".,;:!?")) / n * 10, len(words) / 50 if len(words) < 50 else 1,
            k / len(blocks), 1,
        )
    return out
