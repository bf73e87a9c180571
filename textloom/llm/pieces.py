"""Splitting of texts into the pieces that a tokenizer merges bytes within, a whole batch at a time."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from .fold import mix

#: Fixed value: how the tokenizer splits text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")
LETTER, DIGIT, BLANK, OTHER = 1, 2, 3, 4


def _kind(c: int) -> int:
    ch = chr(c)
    kind = unicodedata.category(ch)
    if ch.isspace():
        return BLANK
    return LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    return np.array([_kind(c) for c in range(1 << 16)], dtype=np.uint8)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full((1 << 16) - 1, np.uint64(0x100000001B3)))])


class Pieces:
    """The pieces of a batch of texts: code points, start and end of each piece, its row, its hash."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        odd = [i for i, t in enumerate(texts) if "'" in t and _CONTRACTION.search(t)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        starts = self._starts(begin)
        if odd:  # English contractions are split by the pattern itself
            import regex

            pattern = regex.compile(PATTERN)
            inside = np.zeros(self.codes.size, dtype=bool)
            inside[starts] = True
            for i in odd:
                inside[begin[i] : begin[i + 1]] = False
                inside[[begin[i] + m.start() for m in pattern.finditer(texts[i])]] = True
            starts = np.flatnonzero(inside)
        self.start, self.end = starts, np.append(starts[1:], self.codes.size) if starts.size else starts
        self.row = np.searchsorted(begin, starts, side="right") - 1
        self.hash = self._hashes()

    def _starts(self, begin: np.ndarray) -> np.ndarray:
        codes, n = self.codes, self.codes.size
        if not n:
            return np.zeros(0, np.int64)
        kind = _kinds()[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes > 0xFFFF).tolist():
            kind[i] = _kind(int(codes[i]))
        first = np.zeros(n + 1, dtype=bool)
        first[begin] = True  # a text begins
        edge = first[:n].copy()
        edge[1:] |= kind[1:] != kind[:-1]
        # the last blank before other characters: a space joins them, another one is a piece
        last = np.zeros(n, dtype=bool)
        last[:-1] = (kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~first[1:n]
        begins = edge | last
        joins = np.flatnonzero(last & (codes == 32)) + 1
        begins[joins] = False
        return np.flatnonzero(begins)

    def _hashes(self) -> np.ndarray:
        if not self.start.size:
            return np.zeros(0, np.uint64)
        sizes = self.end - self.start
        place = (np.arange(self.codes.size) - np.repeat(self.start, sizes)) & 0xFFFF
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(
                (self.codes.astype(np.uint64) + np.uint64(1)) * _powers()[place], self.start
            ) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")
