"""Problem 6: evaluation texts leaking into training text, by Wu-Manber multi-pattern search.

The alphabet is folded words (``fold``).  The patterns are all runs of ``M`` words of the passages.
A block is two words; the shift table tells for each hashed block how far the search may move on, as
no pattern can end any nearer.  Blocks are hashed only where the search comes by.  Where the shift is
zero, the bucket of the patterns that end in this block is looked up and their words are compared with the
text's.  The search runs over many stretches of text in step (lanes of one array), so no Python loop
runs over positions.  Occurrences of a passage on near diagonals are counted, and where there are
enough the passage is aligned with that place of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import Words, fold, grams, mix
from .overlap import common_in_order, slices

M, BLOCK_BITS, LANE, HALF = 3, 20, 256, 8
#: At most about so many characters and passages are searched for at once; larger tables of counts than this are kept sparse.
SEARCH_CHARS, SEARCH_PASSAGES, DENSE = 2_000_000, 4_000, 1 << 23
COVER, ERRORS, SEEDS = 0.5, 0.2, 0.33
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _block(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashed block of two words."""
    with np.errstate(over="ignore"):
        return (mix(first * _MULT + second) >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)


class Patterns:
    """Some passages, prepared for the search.  Their number and length bound its size."""

    def __init__(self, passages: list[tuple[int, str | None]], m: int = M):
        self.m = m
        w = fold([t for _, t in passages])
        self.ids = np.array([i for i, _ in passages], dtype=np.int64)
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(passages))]
        self.sizes = np.array([len(x) for x in self.words], dtype=np.int64)
        self.short = {n: self._table([(p, x) for p, x in enumerate(self.words) if x.size == n], n) for n in range(1, m)}
        passage = np.concatenate([np.full(max(0, x.size - m + 1), p) for p, x in enumerate(self.words)] or [np.zeros(0)]).astype(np.int64)
        offset = np.concatenate([np.arange(max(0, x.size - m + 1)) for x in self.words] or [np.zeros(0)]).astype(np.int64)
        runs = np.array([x[i : i + m] for x in self.words for i in range(x.size - m + 1)], dtype=np.uint64).reshape(-1, m)
        self.runs, pattern = np.unique(runs, axis=0, return_inverse=True)  # the patterns; a run may stand in several passages
        order = np.argsort(pattern.ravel(), kind="stable")
        self.passage, self.offset = passage[order], offset[order]
        self.first = np.searchsorted(pattern.ravel()[order], np.arange(len(self.runs) + 1))
        self.shift = np.full(1 << BLOCK_BITS, m - 1, dtype=np.int8)
        for q in range(1, m):  # the block that ends at word q, counted from 0
            np.minimum.at(self.shift, _block(self.runs[:, q - 1], self.runs[:, q]), m - 1 - q)
        suffix = _block(self.runs[:, m - 2], self.runs[:, m - 1]) if len(self.runs) else np.zeros(0, np.int64)
        self.member = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.member], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32)

    @staticmethod
    def _table(passages: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.array([grams(x, n)[0] for _, x in passages], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], np.array([p for p, _ in passages], dtype=np.int64)[order]

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places where a pattern begins, and which."""
        m, n = self.m, w.hash.size
        if n < m or not len(self.runs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, LANE)
        end = np.minimum(at + LANE, n)
        places, buckets = [], []
        while at.size:
            block = _block(w.hash[at - 1], w.hash[at])
            move = self.shift[block].astype(np.int64)
            here = move == 0
            places.append(at[here])
            buckets.append(block[here])
            at = at + np.maximum(move, 1)
            inside = at < end
            at, end = at[inside], end[inside]
        place, block = np.concatenate(places), np.concatenate(buckets)
        inside = w.row[place] == w.row[place - m + 1]
        place, block = place[inside], block[inside]
        many = (self.bucket[block + 1] - self.bucket[block]).astype(np.int64)
        place = np.repeat(place, many)
        pattern = self.member[np.repeat(
            self.bucket[block] - np.concatenate(([0], np.cumsum(many)[:-1])), many
        ) + np.arange(place.size)] if place.size else np.zeros(0, np.int64)
        for q in range(m):  # the words themselves
            same = self.runs[pattern, q] == w.hash[place - (m - 1 - q)]
            place, pattern = place[same], pattern[same]
        return place - (m - 1), pattern

    def short_ones(self, w: Words) -> Iterator[tuple[int, int]]:
        """(row, passage) of passages with fewer words than a pattern that stand in the text as they are."""
        for n, (hashes, passage) in self.short.items():
            if not hashes.size or w.hash.size < n:
                continue
            g = grams(w.hash, n)
            at = np.flatnonzero(np.isin(g, hashes) & (w.row[: g.size] == w.row[n - 1 :]))
            for x in np.unique(np.stack([w.row[at].astype(np.uint64), g[at]]), axis=1).T:
                for i in range(*np.searchsorted(hashes, [x[1], x[1] + np.uint64(1)])):
                    yield int(x[0]), int(passage[i])

    def candidates(self, w: Words, cover: float) -> list[tuple[int, int, int, int]]:
        """(row, passage, from, to): where enough occurrences of a passage lie on near diagonals.

        Enough is two thirds of what a stretch of ``cover`` keeps with every sixth word changed (three runs in six words)."""
        start, pattern = self.occurrences(w)
        many = self.first[pattern + 1] - self.first[pattern]
        total = int(many.sum())
        if not total:
            return []
        entry = np.repeat(self.first[pattern] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(total)
        longest, rows = int(self.sizes.max()), int(w.row[-1]) + 1
        pair, least = self.passage[entry] * rows + np.repeat(w.row[start], many), np.maximum(
            np.minimum(3, self.sizes - self.m + 1), cover * SEEDS * self.sizes
        )
        if rows * self.sizes.size <= DENSE:
            count = np.bincount(pair, minlength=rows * self.sizes.size)[pair]
        else:
            _, back, each = np.unique(pair, return_inverse=True, return_counts=True)
            count = each[back]
        enough = np.flatnonzero(count >= least[pair // rows])
        if not enough.size:
            return []
        pair, offset, places = pair[enough], self.offset[entry[enough]], np.repeat(start, many)[enough]
        cell = (places - offset + longest) // HALF
        wide = 2 + np.ceil(cover * ERRORS * self.sizes / HALF).astype(np.int64)  # cells that added and left-out words spread a stretch over
        cells = int(cell.max()) + 1 + int(wide.max())
        code = np.sort(pair * cells + cell)
        edge = np.flatnonzero(np.diff(code, prepend=-1))
        code, n = code[edge], np.diff(np.append(edge, code.size))
        who = code // cells
        upto = np.concatenate(([0], np.cumsum(n)))
        both = upto[np.searchsorted(code, code + wide[who // rows])] - upto[:-1]
        band = np.flatnonzero(both >= least[who // rows])
        out, last = [], (-1, -1)
        for i in band.tolist():
            row, p, diagonal = int(who[i] % rows), int(who[i] // rows), int(code[i] % cells) * HALF - longest
            size, slack = int(self.sizes[p]), HALF + int(self.sizes[p]) // 5
            lo, hi = max(int(w.first[row]), diagonal - slack), min(int(w.first[row + 1]), diagonal + int(wide[p]) * HALF + size + slack)
            if (row, p) == last and lo <= out[-1][2] + 4 * HALF:
                out[-1] = (row, p, out[-1][2], hi)  # neighbouring bands are one place
            else:
                out.append((row, p, lo, hi))
            last = row, p
        return out


def alignment(passage: np.ndarray, text: np.ndarray, miss: int = 1) -> np.ndarray:
    """Errors at each word of the passage under the best local alignment (a word alike 1, an error -``miss``).

    A word changed or left out is one error, as is each word that the text adds before it; words outside the
    alignment count as left out.
    """
    m = text.size
    table = np.zeros((passage.size + 1, m + 1), dtype=np.int32)
    ramp = miss * np.arange(m, dtype=np.int32)
    for i, x in enumerate(passage, 1):
        best = np.maximum(0, np.maximum(table[i - 1, :-1] + np.where(text == x, 1, -miss), table[i - 1, 1:] - miss))
        table[i, 1:] = np.maximum(best, np.maximum.accumulate(best + ramp) - ramp)
    i, j = (int(v) for v in np.unravel_index(table.argmax(), table.shape))
    errors = np.ones(passage.size, dtype=np.int64)
    extra = 0
    while table[i, j] > 0:
        alike = passage[i - 1] == text[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (1 if alike else -miss):
            i, j = i - 1, j - 1
            errors[i], extra = (0 if alike else 1) + extra, 0
        elif table[i, j] == table[i - 1, j] - miss:
            i -= 1
            errors[i], extra = 1 + extra, 0
        else:
            j, extra = j - 1, extra + 1
    return errors


def longest_stretch(errors: np.ndarray, share: float) -> tuple[int, int]:
    """The most consecutive words with at most ``share`` errors a word, and those errors."""
    upto = np.concatenate(([0], np.cumsum(errors)))
    height = upto - share * np.arange(upto.size)
    # the last place at which the height is no more than at a start
    low = np.minimum.accumulate(height[::-1])[::-1]
    best, at = 0, (0, 0)
    for i in np.flatnonzero(np.concatenate(([True], height[1:] > np.maximum.accumulate(height)[:-1]))).tolist():
        j = int(np.searchsorted(low, height[i] + 1e-9, side="right")) - 1
        if j - i > best:
            best, at = j - i, (i, j)
    return best, int(upto[at[1]] - upto[at[0]])


def _search(patterns, cover: float, errors: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Patterns = patterns.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in slices(texts):
                w = fold(texts[a:b])
                best = {(row, p): (int(known.sizes[p]), 0) for row, p in known.short_ones(w)}
                for row, p, lo, hi in known.candidates(w, cover):
                    x, y = known.words[p], w.hash[lo:hi]
                    if common_in_order(x.tolist(), y.tolist()) < (1 - errors) * cover * x.size:
                        continue
                    n, e = longest_stretch(alignment(x, y), errors)
                    if n >= cover * x.size and (n, -e) > best.get((row, p), (0, 0)):
                        best[row, p] = n, -e
                if best:
                    keys = list(best)
                    yield pa.RecordBatch.from_pydict({
                        "item_id": pa.array([int(known.ids[p]) for _, p in keys], pa.int64()), "doc_id": pa.array([int(ids[a + r]) for r, _ in keys], pa.int64()),
                        "covered": pa.array([best[k][0] for k in keys], pa.int32()), "errors": pa.array([-best[k][1] for k in keys], pa.int32()), "n_words": pa.array(
                            [int(known.sizes[p]) for _, p in keys], pa.int32()
                        ),
                    })

    return search


def find_leaks(
    documents: DataFrame, id_column: str, text_column: str, passages: DataFrame, item_column: str, passage_column: str, cover: float = COVER,
    errors: float = ERRORS, search_chars: int = SEARCH_CHARS, search_passages: int = SEARCH_PASSAGES
) -> DataFrame:
    """(item_id, doc_id, covered, errors, n_words): documents that hold a stretch of a passage.

    A stretch is consecutive words of the passage, at least ``cover`` of them, in which at most
    ``errors`` of the words are changed, added or left out.  The documents are read without a shuffle, once for each block of
    passages: as many blocks as keep what is sent to the tasks under about ``search_chars`` characters and ``search_passages``
    passages, one for the usual held-out set.  A passage of fewer words than a pattern is found where it stands as it is.
    NULL or blank texts and passages, and passages without an id, are never found.  A passage of which a document has several
    stretches gives one row, with the longest.  Repeated documents each have their rows; passages should have different ids.
    """
    spark = documents.sparkSession
    given = passages.where(F.col(item_column).isNotNull() & F.col(passage_column).isNotNull()).select(
        F.col(item_column).cast("long").alias("i"), F.col(passage_column).alias("t")
    )
    count, chars = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-chars // search_chars), -(-count // search_passages))
    rows = documents.where(F.col(text_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), text_column)
    found = None
    for k in range(blocks):
        block = [(r["i"], r["t"]) for r in given.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()]  # a block, of bounded size
        part = rows.mapInArrow(
            _search(spark.sparkContext.broadcast(Patterns(block)), cover, errors), "item_id long, doc_id long, covered int, errors int, n_words int"
        )
        found = part if found is None else found.unionByName(part)
    return found
