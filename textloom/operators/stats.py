"""Document statistics, summaries, chunk plans and longest documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions.tokenizers import WordTokenizer

#: The candidate context lengths and what goes with them.
CONTEXT_LENGTHS = (2048, 4096, 8192, 10000, 12000, 16000, 32768)
RESERVED, UTILIZATION, OVERLAP, LONGEST, GROUPS, OVER_LIMIT = 16, 0.95, 128, 50, 30, 5.0
PARTS = 64
MEASURES = ("num_chars", "num_lines", "tokens_with_eos", "article_count")


def document_stats(
    content: DataFrame, id_column: str, text: str, content_format: str = "markdown", tokenizer=WordTokenizer(), add_eos: bool = True
) -> DataFrame:
    """One row for each document: characters, lines, tokens and headings of the cleaned text.

    NULL and empty texts count as empty: no characters or lines, and one token, the end mark.  ``tokenizer`` is
    any with ``counts`` (functions.tokenizers); counts that are there already are put in by ``with_token_counts``.
    """
    clean = content.select(F.col(id_column).alias("source_index"), T.clean_html(F.col(text), content_format, tree=False).alias("clean"))
    without, with_eos = tokenizer.counts(F.col("clean"), add_eos)
    counted = clean.select("source_index", "clean", without.alias("n"), with_eos.alias("m"))
    return counted.select(
        F.col("source_index").cast("string").alias("document_id"), "source_index", F.length("clean").cast("long").alias("num_chars"), T.count_lines(F.col("clean")).alias("num_lines"),
        F.col("n").alias("tokens_without_eos"), F.col("m").alias("tokens_with_eos"), T.article_count(F.col("clean")).alias("article_count"),
        T.chapter_count(F.col("clean")).alias("chapter_count"), T.section_count(F.col("clean")).alias("section_count"), (F.col("clean") == "").alias("empty_after_clean"),
    )


def with_token_counts(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """``stats`` with the counts of another tokenizer: of ``counts`` (document_id, tokens_without_eos, tokens_with_eos) the greatest of
    an id's rows; documents without a row keep their own."""
    given = counts.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max(F.struct("tokens_with_eos", "tokens_without_eos")).alias("_given"))
    joined = stats.join(given, "document_id", "left")
    return joined.select(*[F.coalesce(f"_given.{c}", c).alias(c) if c in ("tokens_without_eos", "tokens_with_eos") else F.col(c) for c in stats.columns])


def numeric_summaries(rows: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Ten figures for each measure, with exact percentiles; all zero for an empty table."""
    long = rows.select(F.explode(F.array(*[F.struct(
        F.lit(m).alias("measure"), F.col(m).cast("long").alias("v")
    ) for m in measures])).alias("x")).select("x.*")
    names = rows.sparkSession.createDataFrame([(m,) for m in measures], "measure string")
    zero = lambda c: F.coalesce(c, F.lit(0))
    got = long.groupBy("measure").agg(
        F.count("v").alias("count"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.avg("v").alias("mean"), *[
            F.percentile("v", F.lit(q)).alias(n) for n, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
        ], F.max("v").alias("max")
    )
    return names.join(got, "measure", "left").select(
        "measure", *[zero(F.col(c)).cast("long").alias(c) for c in ("count", "sum", "min")],
        *[F.round(zero(F.col(c)), 6).alias(c) for c in ("mean", "median", "p75", "p90", "p95", "p99")], zero(F.col("max")).cast("long").alias("max")
    )


def group_key(column: Column) -> Column:
    """Group of a value: without outer spaces; NULL and empty are ``unknown``."""
    return F.when(column.isNull() | (column == ""), "unknown").otherwise(T.strip(column))


def group_summaries(rows: DataFrame, fields: list[str], tokens: str = "tokens_with_eos", order: str = "source_index", top: int = GROUPS) -> DataFrame:
    """Documents, mean, 95th percentile and most tokens of the ``top`` groups of each field; ties: the earlier one."""
    long = rows.select(
        F.col(tokens).alias("t"), F.col(order).alias("o"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), group_key(F.col(f)).alias("value")) for f in fields])).alias("x")
    ).select("x.*", "t", "o")
    got = long.groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("documents"), F.avg("t").alias("mean_tokens"), F.percentile("t", F.lit(0.95)).alias("p95_tokens"),
        F.max("t").alias("max_tokens"), F.min("o").alias("first")
    )
    # the first of each part of a field's groups, then the first of those: no task holds all groups of a field
    part = got.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(PARTS)))
    for keys in (["field", "part"], ["field"]):
        part = part.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("documents"), "first", "value"))
        ).where(F.col("rank") <= top)
    return part.select(
        "field", "value", "documents", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("p95_tokens", 6).alias("p95_tokens"), "max_tokens"
    )


def chunk_plans(
    rows: DataFrame, lengths=CONTEXT_LENGTHS, reserved: int = RESERVED, utilization: float = UTILIZATION, overlap: int = OVERLAP,
    tokens: str = "tokens_without_eos"
) -> DataFrame:
    """For each context length: texts over target and context, and the chunks they would need.

    Equal token counts are put together before they meet the context lengths.  Lengths that leave no room
    are left out; an empty table gives no plan.
    """
    counts = rows.groupBy(F.col(tokens).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    capacity = F.col("max_seq_length") - reserved
    plans = F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(set(lengths))])).alias("max_seq_length")
    each = counts.select("t", "n", plans).where(capacity > 0).withColumn("content_capacity_tokens", capacity).withColumn(
        "target_chunk_tokens", K.chunk_target(F.col("content_capacity_tokens"), utilization)
    )
    each = each.withColumn("chunks", K.estimated_chunks(F.col("t"), F.col("target_chunk_tokens"), overlap))
    over = lambda c: F.sum(F.when(F.col("t") > F.col(c), F.col("n")).otherwise(0))
    n = F.sum("n")
    return each.groupBy("max_seq_length", "content_capacity_tokens", "target_chunk_tokens").agg(
        over("target_chunk_tokens").alias("documents_over_target"), F.round(over("target_chunk_tokens") * 100 / n, 6).alias("documents_over_target_percent"),
        over("content_capacity_tokens").alias("documents_over_context"), F.round(over("content_capacity_tokens") * 100 / n, 6).alias("documents_over_context_percent"),
        F.sum(F.col("chunks") * F.col("n")).alias("estimated_chunks"), F.round(F.sum(F.col("chunks") * F.col("n")) / n, 6).alias("estimated_mean_chunks_per_doc"), F.max("chunks").alias("estimated_max_chunks_for_one_doc"),
    )


def recommended_plan(plans: DataFrame, limit: float = OVER_LIMIT) -> DataFrame:
    """The shortest context with at most ``limit`` percent over it, else the one with the least percent over."""
    over = F.col("documents_over_context_percent")
    return plans.orderBy(over > limit, F.when(over <= limit, F.col("max_seq_length")), over, "max_seq_length").limit(1)


def longest(rows: DataFrame, k: int = LONGEST, tokens: str = "tokens_with_eos", order: str = "source_index") -> DataFrame:
    """The ``k`` longest; ties in source order."""
    return rows.orderBy(F.desc(tokens), order).limit(k)


def attach_latest(rows: DataFrame, metadata: DataFrame, id_column: str, fields: list[str], version: str = "source_index") -> DataFrame:
    """Adds the metadata of each row's ``document_id``: the last version of an id; NULL where there is none."""
    fields = [f for f in fields if f in metadata.columns]
    last = metadata.groupBy(F.col(id_column).cast("string").alias("_id")).agg(F.max_by(F.struct(*fields), version).alias("_m"))
    return rows.join(last, rows["document_id"] == last["_id"], "left").select(rows["*"], *[F.col(f"_m.{f}").alias(f) for f in fields])
