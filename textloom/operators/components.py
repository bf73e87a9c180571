"""Connected components of rows that share any of several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep


def shared_components(df: DataFrame, id_column: str, keys: list[Column], tag: bool = True, rounds: int = 50) -> DataFrame:
    """(id, entity): rows that share a value of the same key, directly or over other rows, get one entity.

    With ``tag`` False the keys are of one kind: a value also links rows that have it in different keys.
    An entity is named by the least of its key values (as text with the key's number), or by the
    row's own id where all keys are NULL.  Rows are reduced to distinct pairs of key values first, so
    a value on a third of all rows costs one pair; components of the pairs are found by spreading
    the least name along the pairs, with each name also jumping to its own name's name, until
    nothing changes.  Rows with one key, or whose keys always come together, need no round.
    """
    tagged = [F.when(k.isNotNull(), F.concat(F.lit(f"{i}:" if tag else ""), k.cast("string"))) for i, k in enumerate(keys)]
    rows = df.select(F.col(id_column).alias("id"), F.array_distinct(F.array_compact(F.array(*tagged))).alias("_keys"))
    rows = rows.withColumn("_first", F.try_element_at("_keys", F.lit(1)))
    links = rows.where(F.size("_keys") > 1).select(F.col("_first").alias("a"), F.explode(F.slice("_keys", 2, len(keys))).alias("b")).distinct()
    links = keep(links, "links")
    names = keep(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("name", F.col("node")), "names")
    both = keep(links.union(links.select("b", "a")), "links-both")
    for _ in range(rounds):
        near = both.join(names, both["b"] == names["node"]).groupBy(F.col("a").alias("node")).agg(F.min("name").alias("near"))
        least = names.join(near, "node").select("node", F.least("name", "near").alias("least"), "name")
        jump = least.select(F.col("node").alias("via"), F.col("least").alias("far"))
        moved = least.join(jump, least["least"] == jump["via"], "left").select(
            "node", F.coalesce(F.least("least", "far"), "least").alias("name"), "name"
        )
        moved = keep(moved.toDF("node", "name", "old"), "names")
        names = moved.select("node", "name")
        if moved.where(F.col("name") != F.col("old")).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    named = rows.join(names, rows["_first"] == names["node"], "left")
    return named.select("id", F.coalesce("name", "_first", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("entity"))
