"""Checks of data as rows (check_name, violations): 0 where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def count_where(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules on rows of one table, in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("check_name"), F.col(n).alias("violations")
    ) for n in rules])).alias("c")).select("c.*")


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """An error that names the checks with violations."""
    bad = {r["check_name"]: r["violations"] for r in checks.where("violations > 0").collect()}  # a row for each check
    if bad:
        raise ValueError(f"violations: {bad}")
