"""Folding of text to comparable words, a whole Arrow batch at a time.

Accents, case, spacing, punctuation, markup, entities and Unicode forms carry no meaning for the
operators that compare texts, so each text becomes a sequence of folded words.  All work on a batch
is done on one array of code points: no Python loop runs over characters or words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_ENTITY = re.compile(r"&(?:#\d|#[xX][0-9a-fA-F]|[A-Za-z])")
_TAG = re.compile(r"<(?:!--.*?--|/?[A-Za-z][^<>]*|![A-Za-z][^<>]*)>", re.S)
_SPACE, _DROP = 32, 0
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LONGEST = 1 << 12


def plain(text: str | None) -> str:
    """``text`` without entities and tags; NULL gives an empty string."""
    if not text:
        return ""
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Folded code of each code point of the basic plane; 0 drops it, 32 parts words."""
    out = np.full(1 << 16, _SPACE, dtype=np.uint16)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "M" or kind == "Cf":
            out[c] = _DROP
        elif kind[0] in "LN":
            first = unicodedata.normalize("NFKD", ch.lower())[0].lower()
            code = ord({"đ": "d", "ı": "i", "ł": "l", "ø": "o"}.get(first, first)[0])
            out[c] = code if code < 1 << 16 else c
    return out


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = np.ones(_LONGEST, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(_LONGEST - 1, np.uint64(0x100000001B3)))
    return out


@dataclass
class Words:
    """The folded words of a batch, in order: hash, row in the batch, first and last character."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    codes: np.ndarray
    first: np.ndarray  # index of each row's first word, and one more at the end

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-16-le", "surrogatepass")


def fold(texts) -> Words:
    """Words of each text of the batch.  NULL, empty and blank texts have none."""
    texts = [plain(t) for t in texts]
    n = len(texts)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    flat = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _table()[np.minimum(flat, 0xFFFF)]
    if flat.size and int(flat.max()) > 0xFFFF:
        high = np.flatnonzero(flat > 0xFFFF)
        letters = np.array([unicodedata.category(chr(c))[0] in "LN" for c in flat[high].tolist()])
        codes[high] = np.where(letters, 0xE000 + flat[high] % 0x1800, _SPACE).astype(np.uint16)
    keep = codes != _DROP
    ends = np.cumsum(lengths + 1) - 1  # where each row ends in flat
    rows_end = np.concatenate(([0], np.cumsum(keep)))[np.minimum(ends, flat.size)] if n else ends
    codes = codes[keep]
    inside = codes > _SPACE
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.concatenate(([0], np.searchsorted(start, rows_end))).astype(np.int64)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    return Words(_hash(codes, start, end), row, start, end, codes, first)


def _hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not start.size:
        return np.zeros(0, dtype=np.uint64)
    inside = codes > _SPACE
    letters = codes[inside].astype(np.uint64)
    sizes = end - start
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = (np.arange(letters.size) - np.repeat(offsets, sizes)) % _LONGEST
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(letters * _powers()[place], offsets) + sizes.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every ``k`` consecutive words (ends of rows are not looked at)."""
    if words.size < k:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(words.size - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _MULT + words[j : words.size - k + 1 + j]
    return mix(out)
