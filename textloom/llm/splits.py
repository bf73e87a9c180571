"""Problem 4: splits that keep related records together, by largest differencing.

Records are reduced to entities and their weights.  Entities are combined into many bins of nearly
equal weight: partial partitions, sorted vectors of bin weights, are put together two at a time,
those with the greatest differences first and with opposite ends meeting, until one is left.
Groups of bounded size do this in parallel; their results are combined in further levels in the
same way.  Whole bins then go to the splits by target share.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import shared_components
from ..sources.tables import keep

BINS, LEAVES, FAN = 200, 20_000, 200

#: Two letters, year, number and maybe a letter; anything may stand around it.
_ID = r"(?<![a-z0-9])([a-z]{2})[^a-z0-9]*((?:19|20)[0-9]{2})[^a-z0-9]*0*([0-9]+)([a-z]?)(?![a-z0-9])"


def document_key(value: Column) -> Column:
    """The document of an id: series, year, number and letter; other ids by their lower-case text; blank: NULL."""
    low = F.lower(value)
    parts = [F.regexp_extract(low, _ID, i) for i in range(1, 5)]
    text = F.regexp_replace(low, r"(?U)^\s+|\s+$", "")
    return F.when(parts[2] != "", F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], parts[3])).when(text != "", text)


def chunk_document_key(value: Column) -> Column:
    """The document of a chunk's id, which ends in the chunk's number."""
    return document_key(F.regexp_replace(value, r"(?:::|/c|#)[0-9]+\s*$", ""))


def difference(vectors: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Combines sorted bin weights by largest differencing: the result, and each one's bins in it."""
    nodes = [np.asarray(v, dtype=np.float64) for v in vectors]
    heap = [(v.min() - v.max(), i) for i, v in enumerate(nodes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        total = nodes[i] + nodes[j][::-1]
        order = np.argsort(-total, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        merges.append((i, j, place, place[::-1]))
        nodes.append(total[order])
        heapq.heappush(heap, (total[order[-1]] - total[order[0]], len(nodes) - 1))
    maps: list[np.ndarray | None] = [None] * len(nodes)
    maps[-1] = np.arange(nodes[-1].size)
    for k in range(len(merges) - 1, -1, -1):
        i, j, a, b = merges[k]
        above = maps[len(vectors) + k]
        maps[i], maps[j] = above[a], above[b]
    return nodes[-1], maps[: len(vectors)]


def balanced_bins(entities: DataFrame, bins: int = BINS) -> DataFrame:
    """(entity, bin): entities (entity, weight) spread over ``bins`` bins of nearly equal weight.

    No group holds more than about 20,000 entities or 200 partial results; nothing but the last
    level's bin weights is put together in one task.  NULL weights count as zero.
    """
    spark = entities.sparkSession
    nodes = entities.select(F.col("entity").alias("node"), F.coalesce(F.col("weight"), F.lit(0)).cast("double").alias("weight"))
    groups = max(1, -(-nodes.count() // LEAVES))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "node"], ascending=[False, True])
        vectors = []
        for w in pdf["weight"]:
            v = np.zeros(bins)
            v[0] = w
            vectors.append(v)
        total, maps = difference(vectors)
        return pd.DataFrame({
            "node": pdf["node"], "parent": pdf["parent"], "bin": [int(m[0]) for m in maps], "weights": [total.tolist()] + [None] * (len(pdf) - 1)
        })

    made = nodes.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("long")).groupBy("parent").applyInPandas(
        leaves, "node string, parent long, bin int, weights array<double>"
    )
    made = keep(made, "bins-leaves")
    placed = made.select(F.col("node").alias("entity"), "parent", "bin")
    level = made.where(F.col("weights").isNotNull()).select(F.col("parent").alias("node"), "weights")

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        total, maps = difference([np.asarray(w) for w in pdf["weights"]])
        return pd.DataFrame({
            "node": pdf["node"], "parent": pdf["parent"], "bins": [m.astype(int).tolist() for m in maps],
            "weights": [total.tolist()] + [None] * (len(pdf) - 1)
        })

    while groups > 1:
        groups = -(-groups // FAN)
        up = level.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("long")).groupBy("parent").applyInPandas(
            inner, "node long, parent long, bins array<int>, weights array<double>"
        )
        up = keep(up, "bins-level")
        maps = up.select("node", F.col("parent").alias("above"), "bins")
        placed = placed.join(maps, placed["parent"] == maps["node"]).select(
            "entity", F.col("above").alias("parent"), F.element_at("bins", F.col("bin") + 1).alias("bin")
        )
        level = up.where(F.col("weights").isNotNull()).select(F.col("parent").alias("node"), "weights")
    return placed.select("entity", "bin")


def assign_bins(weights: list[tuple[int, float]], targets: list[tuple[str, float]]) -> list[tuple[int, str]]:
    """Whole bins to splits: the heaviest first, each to the split that lacks most of its target weight."""
    total = sum(w for _, w in weights) or 1.0
    share = sum(t for _, t in targets) or 1.0
    lacking = {s: t / share * total for s, t in targets}
    out = []
    for b, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        split = max(lacking, key=lambda s: (lacking[s], s))
        lacking[split] -= w
        out.append((b, split))
    return out


def group_splits(
    df: DataFrame, id_column: str, keys: list[Column], targets: DataFrame, weight: Column | None = None, tag: bool = True, bins: int = BINS
) -> DataFrame:
    """(id, entity, new_split): all rows that share a key, directly or over others, get one split.

    ``targets`` is a small table (split, target_share).  Rows weigh one, or ``weight``.  Rows without
    any key are entities of their own.  Shares are met to about half a bin, unless one entity
    outweighs a target.  Empty tables give empty results; targets without rows are an error.
    """
    spark = df.sparkSession
    goals = [(r["split"], float(r["target_share"] or 0)) for r in targets.select("split", "target_share").collect()]  # a row for each split
    if not goals:
        raise ValueError("no target split")
    weights = df.select(F.col(id_column).alias("id"), (weight if weight is not None else F.lit(1)).cast("double").alias("weight"))
    named = shared_components(df, id_column, keys, tag)
    rows = keep(named.join(weights, "id") if weight is not None else named.withColumn("weight", F.lit(1.0)), "split-rows")
    entities = keep(rows.groupBy("entity").agg(F.sum("weight").alias("weight")), "split-entities")
    placed = keep(balanced_bins(entities, bins), "split-bins")
    sums = placed.join(entities, "entity").groupBy("bin").agg(F.sum("weight").alias("w")).collect()  # as many as bins
    table = spark.createDataFrame(assign_bins([(r["bin"], r["w"]) for r in sums], goals) or [], "bin int, new_split string")
    return rows.select("id", "entity").join(placed.join(F.broadcast(table), "bin"), "entity").select("id", "entity", "new_split")


def separated(rows: DataFrame) -> DataFrame:
    """Of rows (id, entity, split), those whose entity also has a row in another split.  A NULL split is one of its own."""
    named = rows.withColumn("_split", F.coalesce("split", F.lit("")))
    apart = named.groupBy("entity").agg(F.min("_split").alias("a"), F.max("_split").alias("b")).where("a < b").select("entity")
    return rows.join(apart, "entity", "left_semi")
