"""Running totals and ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep


def running_totals(df: DataFrame, groups: list[str], order: list[str], totals: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds for each name the total of its value over the rows of the same group up to and with this row.

    Rows are ordered by ``order``, which must make rows unique within a group, or equal rows may
    come in any order.  The table is cut into ranges of (groups, order); totals of the ranges, a few
    numbers each, are summed up first, so a group holding a third of all rows is spread over many
    ranges.  NULL values count as zero; NULL keys form a group.  Empty tables give empty tables.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = {name: f"__value{i}" for i, name in enumerate(totals)}
    cut = df.withColumns({numbered[name]: F.coalesce(value, F.lit(0)) for name, value in totals.items()}).repartitionByRange(n, *groups, *order)
    cut = keep(cut.withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*groups, "__part").agg(*[F.sum(v).alias(v) for v in numbered.values()])
    sums = sums.select(
        "__part", *[F.col(g).alias(f"__group{i}") for i, g in enumerate(groups)],
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in numbered.values()]
    )
    same = cut["__part"] == sums["__part"]
    for i, g in enumerate(groups):
        same &= cut[g].eqNullSafe(sums[f"__group{i}"])
    joined = cut.join(sums, same).drop(sums["__part"])
    within = Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({name: F.col(f"{v}_before") + F.sum(v).over(within) for name, v in numbered.items()})
    return out.drop("__part", *numbered.values(), *[f"{v}_before" for v in numbered.values()], *[f"__group{i}" for i in range(len(groups))])


def running_total(df: DataFrame, groups: list[str], order: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, groups, order, {name: value}, partitions)
