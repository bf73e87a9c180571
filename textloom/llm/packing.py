"""Problem 3: filling sequences of fixed capacity with records, by non-negative least squares.

Only the histogram of lengths, at most as many numbers as the capacity, is looked at in one place, a task for
each capacity.  For
windows of growing size up to the capacity, shallow combinations of lengths that fill the window are
enumerated, their repeat counts are solved by non-negative least squares against the histogram and
rounded down, and filled windows become items of the next size.  What is left is packed greedily: the longest
first, each into the fullest sequence that still takes it.  The outcome is a list of sequence types with
repeat counts; the records get their places in them by their rank among records of equal length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_total

CELLS, DEPTH, SMALLEST, STEPS = 256, 3, 512, 1500


def combinations(cells: int, depth: int, present: np.ndarray) -> np.ndarray:
    """All combinations of at most ``depth`` cells (0: none) that fill ``cells``, of cells that are present."""
    found = []
    for a in np.flatnonzero(present[1 : cells + 1]) + 1:
        if a == cells:
            found.append((a, 0, 0))
        b = cells - a
        if depth > 1 and 0 < b <= a and present[b]:
            found.append((a, b, 0))
        if depth > 2:
            found += [(a, b, c) for b in range(1, a + 1) if 0 < (c := cells - a - b) <= b and present[b] and present[c]]
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def least_squares(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts >= 0 that use up ``counts`` as nearly as may be; long cells weigh more."""
    weight = np.arange(counts.size, dtype=float) ** 0.5
    weight[0] = 0
    used = lambda x: np.bincount(combos.ravel(), np.repeat(x, 3), counts.size)
    back = lambda r: r[combos].sum(axis=1)
    x = z = np.zeros(len(combos))
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(weight**2 * used(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, t = 0.9 / norm, 1.0
    goal = weight**2 * counts
    goal[0] = 0
    for _ in range(steps):
        new = np.maximum(0, z - step * back(weight**2 * used(z) - goal))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / u * (new - x), new, u
    return x


class Items:
    """Items of a histogram: for each length, kinds (their records' lengths) with counts."""

    def __init__(self):
        self.kinds: dict[int, Counter] = defaultdict(Counter)

    def add(self, kind: tuple[int, ...], n: int) -> None:
        self.kinds[sum(kind)][kind] += n

    def take(self, length: int, most: int) -> tuple[tuple[int, ...], int]:
        kinds = self.kinds[length]
        kind = next(iter(kinds))
        n = min(most, kinds[kind])
        kinds[kind] -= n
        if not kinds[kind]:
            del kinds[kind]
            if not kinds:
                del self.kinds[length]
        return kind, n

    def total(self, length: int) -> int:
        return sum(self.kinds[length].values()) if length in self.kinds else 0


def _fill(items: Items, window: int, cells: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes items that fill windows of the given size; returns the kinds made, with counts."""
    width = max(1, -(-window // cells))
    cells = window // width
    lengths: dict[int, list[int]] = defaultdict(list)
    for length in sorted(items.kinds):
        if 0 < length <= window and -(-length // width) <= cells:
            lengths[-(-length // width)].append(length)
    counts = np.zeros(cells + 1)
    for c, ls in lengths.items():
        counts[c] = sum(items.total(x) for x in ls)
    combos = combinations(cells, depth, counts > 0)
    if not len(combos):
        return []
    repeats = np.floor(least_squares(combos, counts) + 1e-6).astype(np.int64)
    left = counts.astype(np.int64)
    made: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-repeats, kind="stable").tolist():
        need = Counter(c for c in combos[i].tolist() if c)
        n = min([int(repeats[i]), *(int(left[c]) // k for c, k in need.items())])
        if n <= 0:
            continue
        for c, k in need.items():
            left[c] -= n * k
        while n:  # the longest of each cell, as many at once as are of one kind
            parts, m = [], n
            for c in combos[i].tolist():
                if c:
                    length = lengths[c][-1]
                    kind, got = items.take(length, m)
                    parts.append([kind, got])
                    m = min(m, got)
                    if length not in items.kinds:
                        lengths[c].pop()
            for kind, got in parts:
                if got > m:
                    items.add(kind, got - m)
                    c = -(-sum(kind) // width)
                    if sum(kind) not in lengths[c]:
                        insort(lengths[c], sum(kind))
            made.append((tuple(x for kind, _ in parts for x in kind), m))
            n -= m
    return made


def sequence_types(
    histogram: dict[int, int], capacity: int, cells: int = CELLS, depth: int = DEPTH, smallest: int = SMALLEST
) -> list[tuple[tuple[int, ...], int]]:
    """Types of sequences (the lengths in each) with repeat counts that hold the whole histogram."""
    items = Items()
    for length, n in sorted(histogram.items()):
        if length > capacity or length <= 0:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        items.add((length,), n)
    windows = [capacity]
    while windows[-1] // 3 >= smallest:
        windows.append(windows[-1] // 3)
    full: list[tuple[tuple[int, ...], int]] = []
    for window in reversed(windows):
        made = _fill(items, window, cells, depth)
        if window == capacity:
            full = made
        else:
            for kind, n in made:
                items.add(kind, n)
    # the rest: the longest first, into the fullest that takes it; filled sequences may take more
    opened: dict[int, Counter] = defaultdict(Counter)
    for kind, n in full:
        opened[capacity - sum(kind)][kind] += n
    rooms = sorted(opened)
    for length in sorted(items.kinds, reverse=True):
        for kind, n in list(items.kinds[length].items()):
            while n:
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    base = next(iter(opened[room]))
                    m = min(n, opened[room][base])
                    opened[room][base] -= m
                    if not opened[room][base]:
                        del opened[room][base]
                        if not opened[room]:
                            del opened[room]
                            rooms.pop(at)
                    new = base + kind
                else:
                    k = min(capacity // length, n)
                    m, new = n // k, kind * k  # k of the kind in each
                    n -= m * (k - 1)
                rest = capacity - sum(new)
                if rest not in opened:
                    insort(rooms, rest)
                opened[rest][new] += m
                n -= m
    return sorted((kind, n) for kinds in opened.values() for kind, n in kinds.items())


def _slots(cells: int, depth: int):
    """Of a capacity's histogram: for each length, the ranks that go to a type of sequence, and the type's first sequence."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        taken: Counter = Counter()
        first, out = 0, []
        for kind, n in sequence_types(dict(zip(pdf["length"].tolist(), pdf["n"].tolist())), capacity, cells, depth):
            for length, k in sorted(Counter(kind).items()):
                out.append((capacity, length, taken[length], k, first))
                taken[length] += k * n
            first += n
        return pd.DataFrame(out, columns=["capacity", "length", "start", "k", "first"])

    return solve


def packed(lengths: DataFrame, capacities: list[int], cells: int = CELLS, depth: int = DEPTH) -> DataFrame:
    """(capacity, sequence, id, piece, length): for each capacity, the sequence of each record (id, length).

    A record longer than the capacity is cut into whole sequences of its own and a rest; no other is
    divided.  Records without a length, or of none, get no row.  Sequences are numbered from 0 without
    gaps.  Records of equal length are taken in the order of their ids.
    """
    spark = lengths.sparkSession
    whole = lengths.where("length > 0").select("id", F.col("length").cast("long").alias("_all"))
    each = whole.select("id", "_all", F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(capacities))])).alias("capacity"))
    pieces = each.select(
        "id", "capacity", "_all", F.explode(F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / F.col("capacity")).cast("int"))).alias("piece")
    )
    pieces = pieces.select(
        "id", "capacity", "piece", F.least(F.col("capacity"), F.col("_all") - F.col("piece") * F.col("capacity")).cast("int").alias("length")
    )
    ranked = running_total(pieces, ["capacity", "length"], ["id", "piece"], F.lit(1), "rank")
    histogram = pieces.groupBy("capacity", "length").agg(F.count(F.lit(1)).alias("n"))  # for each capacity at most as many rows as that
    made = histogram.groupBy("capacity").applyInPandas(_slots(cells, depth), "capacity int, length int, start long, k int, first long")
    slots: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for r in made.orderBy("capacity", "length", "start").collect():  # bounded by the capacities, not by the records
        slots[r["capacity"], r["length"]].append((r["start"], r["k"], r["first"]))
    tables = spark.sparkContext.broadcast({k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables.value
        for batch in batches:
            capacity, length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("capacity", "length", "rank"))
            sequence = np.zeros(length.size, dtype=np.int64)
            order = np.lexsort((length, capacity))
            edges = np.flatnonzero(np.diff(capacity[order], prepend=-1) | np.diff(length[order], prepend=-1))
            for at in np.split(order, edges[1:]) if order.size else []:
                start, k, base = table[int(capacity[at[0]]), int(length[at[0]])]
                i = np.searchsorted(start, rank[at] - 1, side="right") - 1
                sequence[at] = base[i] + (rank[at] - 1 - start[i]) // k[i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "capacity", "piece", "length")), pa.array(sequence)],
                ["id", "capacity", "piece", "length", "sequence"]
            )

    rows = ranked.select("id", "capacity", "piece", "length", F.col("rank").cast("long").alias("rank"))
    return rows.mapInArrow(place, f"id {dict(pieces.dtypes)['id']}, capacity int, piece int, length int, sequence long")


def packing_report(sequences: DataFrame) -> DataFrame:
    """Of packed records: sequences, records' pieces, tokens, the share of unused room, the fullest."""
    each = sequences.groupBy("capacity", "sequence").agg(F.sum("length").alias("filled"), F.count(F.lit(1)).alias("pieces"))
    return each.groupBy("capacity").agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("pieces").alias("pieces"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"),
        (1 - F.sum("filled") / (F.count(F.lit(1)) * F.col("capacity"))).alias("unused_share")
    )
