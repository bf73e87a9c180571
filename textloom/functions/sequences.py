"""Measures on pairs of token sequences that need more than column expressions, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def chunked_lcs_f1(reference: list, prediction: list, size: int = 512) -> float:
    """Mean F1 of the common subsequence of aligned chunks, weighted by the longer chunk; 1 for two empty texts."""
    n = max(len(reference), len(prediction))
    if not n:
        return 1.0
    total = weights = 0.0
    for at in range(0, n, size):
        a, b = reference[at : at + size], prediction[at : at + size]
        weight = max(1, len(a), len(b))
        common = lcs_length(a, b) if a and b else 0
        total += weight * (2 * common / (len(a) + len(b)) if common else 0.0)
        weights += weight
    return total / weights


def chunked_lcs_f1_udf(size: int = 512):
    from pyspark.sql import functions as F

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([chunked_lcs_f1(list(x), list(y), size) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(score, "double")


def _grams(units: np.ndarray, n: int) -> np.ndarray:
    if units.size < n:
        return units[:0]
    out = np.zeros(units.size - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + units[j : units.size - n + 1 + j]
    return out


def gram_overlap(reference: np.ndarray, prediction: np.ndarray, order: int) -> tuple[int, int, int]:
    """Clipped matches, and n-grams of the prediction and the reference, of two arrays of units."""
    a, b = _grams(reference, order), _grams(prediction, order)
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum()), b.size, a.size


def overlaps_udf(char_orders: int, word_orders: int):
    """Struct arrays of (matches, predicted, expected) for character and word orders of two texts' columns.

    Arguments: reference text, prediction text, reference words, prediction words.
    """
    from pyspark.sql import functions as F

    kind = "struct<chars:array<array<bigint>>,words:array<array<bigint>>>"

    def count(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ref, pred, ref_words, pred_words in batches:
            rows = []
            for r, p, rw, pw in zip(ref, pred, ref_words, pred_words):
                chars = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1) for t in (r, p)]
                names: dict = {}
                units = [np.array([names.setdefault(w, len(names) + 1) for w in ws], dtype=np.uint64) for ws in (rw, pw)]
                rows.append((
                    [gram_overlap(*chars, n) for n in range(1, char_orders + 1)], [gram_overlap(*units, n) for n in range(1, word_orders + 1)]
                ))
            yield pd.DataFrame(rows, columns=["chars", "words"])

    return F.pandas_udf(count, kind)
