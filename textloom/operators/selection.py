"""Selecting documents by length, splitting them, and checks of what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import keep
from .prefix import running_total

#: Fixed values.
MAX_SEQ, RESERVED, VALIDATION, TEST, SEED = 20_000, 16, 0.10, 0.10, 3407
SPLIT_PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))


def p95_threshold(stats: DataFrame, tokens: str = "tokens_with_eos", q: float = 0.95) -> int:
    """The 95th percentile of all texts' tokens, rounded up; 0 for an empty table."""
    return int(stats.agg(F.ceil(F.percentile(tokens, F.lit(q)))).first()[0] or 0)


def selection_reasons(stats: DataFrame, threshold: int, capacity: int, keep_empty: bool = False) -> DataFrame:
    """Adds ``reason``: the first rule that a document fails, or ``selected``."""
    t = F.col("tokens_with_eos")
    reason = F.when(t > threshold, "over_p95").when(t > capacity, "over_context").otherwise("selected")
    if not keep_empty:
        reason = F.when(F.col("empty_after_clean"), "empty").otherwise(reason)
    return stats.withColumn("reason", reason)


def selection_counters(reasons: DataFrame) -> DataFrame:
    """Counts by reason in one row; empty texts count even where they are kept."""
    n = lambda r: F.count_if(F.col("reason") == r)
    return reasons.agg(
        F.count(F.lit(1)).alias("stats_rows"), n("selected").alias("selected_rows"), n("over_p95").alias("over_p95_threshold"),
        n("over_context").alias("over_context_capacity"), F.count_if("empty_after_clean").alias("empty_after_clean")
    )


def first_selected(reasons: DataFrame, limit: int, order: str = "source_index") -> DataFrame:
    """Rows up to and with the one that is the ``limit``-th selected, in source order."""
    ranked = running_total(reasons, [], [order], F.when(F.col("reason") == "selected", 1).otherwise(0), "_n")
    before = F.col("_n") - F.when(F.col("reason") == "selected", 1).otherwise(0)
    return ranked.where(before < limit).drop("_n")


def rows_at(df: DataFrame, indexes: DataFrame, key: str = "source_index") -> DataFrame:
    """The rows whose place is named in ``indexes``, each once."""
    return df.join(indexes.select(key), key, "left_semi")


def seeded_rank(df: DataFrame, id_column: str, seed: int) -> DataFrame:
    """Adds ``rank`` from 1 in the order of a seeded hash of the id: the same for any partitioning."""
    keyed = df.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"))))
    return running_total(keyed, [], ["_key", id_column], F.lit(1), "rank").drop("_key")


def seeded_split(df: DataFrame, id_column: str, validation: float = VALIDATION, test: float = TEST, seed: int = SEED) -> DataFrame:
    """Adds ``split``: exact numbers in a seeded order; no held-out share, no held-out split.

    Held out are the first ceil(n x (validation + test)); of these, in the order of the next seed, the first
    ceil(held out x test share) are the test split.
    """
    if validation < 0 or test < 0 or validation + test >= 1:
        raise ValueError("shares must not be negative, and sum to less than 1")
    share = validation + test
    if share == 0:
        return df.withColumn("split", F.lit("train"))
    from math import ceil

    n = df.count()
    held = ceil(round(n * share, 9))
    tested = ceil(round(held * test / share, 9))
    ranked = keep(seeded_rank(df, id_column, seed), "split")
    train = ranked.where(F.col("rank") > held).drop("rank").withColumn("split", F.lit("train"))
    out = seeded_rank(ranked.where(F.col("rank") <= held).drop("rank"), id_column, seed + 1)
    out = out.withColumn("split", F.when(F.col("rank") <= tested, "test").otherwise("validation")).drop("rank")
    return train.unionByName(out)


def split_summary(df: DataFrame, id_column: str = "document_id", tokens: str = "tokens_with_eos") -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(id_column).alias("documents"), zero(F.sum(tokens)).cast("long").alias("tokens"), zero(F.min(tokens)).cast("long").alias("min_tokens"),
        F.round(zero(F.avg(tokens)), 6).alias("mean_tokens"), zero(F.max(tokens)).cast("long").alias("max_tokens"),
    )


def split_leakage(df: DataFrame, id_column: str = "document_id") -> DataFrame:
    """For each pair of splits that both exist, the ids in both."""
    per = df.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.collect_set("split").alias("s"))
    there = df.agg(F.collect_set("split").alias("all")).first()["all"]
    pairs = [(a, b) for a, b in SPLIT_PAIRS if a in there and b in there]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left_split string, right_split string, shared long")
    hit = lambda a, b: F.struct(
        F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), (F.array_contains("s", a) & F.array_contains("s", b)).cast("long").alias("hit")
    )
    return per.select(F.explode(F.array(*[hit(a, b) for a, b in pairs])).alias("x")).select("x.*").groupBy("left_split", "right_split").agg(F.sum("hit").alias("shared"))


def shared_ids(df: DataFrame, left: str, right: str, id_column: str = "document_id") -> DataFrame:
    """Ids in both of two splits."""
    of = lambda s: df.where(F.col("split") == s).select(id_column)
    return of(left).intersect(of(right)).where(F.col(id_column).isNotNull())


def continuation(text: Column, max_total: int = 20_000, max_generation: int = 1024, fallback: int = 1024, minimum: int = 128) -> Column:
    """Where an evaluation text is cut: method, tokens of the prefix and the reference; NULL if too short.

    Before the first naming of article 2, or after ``fallback`` tokens where there is none.
    """
    at = T.article_two_at(text)
    count = T.count_words
    head, tail = count(F.substring(text, F.lit(1), at - 1)), count(F.substring(text, at, F.length(text)))
    n = count(text)
    prefix = F.when(at > 0, head).when(n > fallback + minimum, F.lit(fallback))
    length = F.least(F.when(at > 0, tail).otherwise(n - fallback), F.lit(max_generation), F.lit(max_total) - prefix)
    method = F.when(at > 0, "before_article_2").otherwise("token_fallback")
    return F.when(
        prefix.isNotNull() & (length >= minimum),
        F.struct(method.alias("split_method"), prefix.cast("long").alias("prefix_tokens"), length.cast("long").alias("reference_tokens"))
    )


def evaluation_candidates(df: DataFrame, id_column: str, text: str, limit: int = 0, seed: int = SEED, **cut) -> DataFrame:
    """Evaluation texts in seeded order with ``reason`` (selected, empty, short, no_continuation) and their cut.

    With a ``limit``, rows up to the one that is the ``limit``-th selected.
    """
    clean = F.coalesce(T.normalize_document(F.col(text)), F.lit(""))
    rows = df.select(F.col(id_column).alias("source_index"), clean.alias("clean"))
    rows = rows.select(
        "source_index", T.count_words(F.col("clean")).alias("tokens"), (F.col("clean") == "").alias("blank"),
        continuation(F.col("clean"), **cut).alias("c")
    )
    reason = F.when(F.col("blank"), "empty").when(F.col("tokens") + 1 < 2, "short").when(F.col("c").isNull(), "no_continuation").otherwise("selected")
    rows = rows.select("source_index", reason.alias("reason"), "tokens", "c.split_method", "c.prefix_tokens", "c.reference_tokens")
    if not limit:
        return rows
    ranked = keep(seeded_rank(keep(rows, "candidates"), "source_index", seed), "evaluation")  # ranges are cut from samples: the texts are read once
    return first_selected(ranked, limit, "rank")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and a sum of hashes that doesn't depend on their order; NULL and "" differ."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).alias("hash_sum"))
