"""Scoring generated texts and language models, and comparing two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions.sequences import chunked_lcs_f1_udf, overlaps_udf
from .prefix import running_totals

CHAR_ORDERS, WORD_ORDERS, BETA = 6, 2, 2.0
SCORES = ("rouge1_f1", "rouge2_f1", "rougeL_chunked_f1", "article_heading_f1", "distinct2", "repeated_4gram_ratio")
LENGTHS = ("prefix_tokens", "reference_tokens", "generated_tokens", "length_ratio", "generation_seconds")
#: Which metrics are compared, and how.
IGNORED = ("num_documents", "num_generation_documents", "full_document_scored_tokens", "wall_clock_seconds")
LOWER_IS_BETTER = ("full_document_nll", "full_document_perplexity", "repeated_4gram_ratio_percent")


def f1(matches: Column, predicted: Column, expected: Column) -> Column:
    """F1 of overlapping multisets: 1 if both are empty, 0 if one is or nothing is shared."""
    return F.when((predicted == 0) & (expected == 0), 1.0).when(matches == 0, 0.0).otherwise(2.0 * matches / (predicted + expected))


def shared_count(a: Column, b: Column) -> Column:
    """Size of the intersection of two short multisets."""
    once = F.array_distinct(F.array_intersect(a, b))
    of = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    return F.aggregate(once, F.lit(0), lambda n, x: n + F.least(of(a, x), of(b, x)))


def distinct_share(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.size(F.array_distinct(values)) / F.size(values)).otherwise(0.0)


def continuation_metrics(pairs: DataFrame, reference: str, prediction: str, chunk: int = 512) -> DataFrame:
    """Adds the six scores of a prediction against its reference; pairs with a NULL side are left out.

    Diversity is of the prediction alone.  Empty texts score 1 against each other, 0 against others.
    """
    rows = pairs.where(F.col(reference).isNotNull() & F.col(prediction).isNotNull())
    rows = rows.withColumns({
        "_r": T.metric_text(F.col(reference)), "_p": T.metric_text(F.col(prediction)), "_ra": T.article_numbers(F.col(reference)),
        "_pa": T.article_numbers(F.col(prediction))
    })
    rows = rows.withColumns({"_rw": T.words(F.col("_r")), "_pw": T.words(F.col("_p"))})
    rows = rows.withColumns({
        "_o": overlaps_udf(0, 2)("_r", "_p", "_rw", "_pw")["words"], "rougeL_chunked_f1": chunked_lcs_f1_udf(chunk)("_rw", "_pw"),
        "_2": K.ngrams(F.col("_pw"), 2), "_4": K.ngrams(F.col("_pw"), 4)
    })
    rouge = lambda n: f1(*(F.col("_o")[n - 1][i] for i in range(3)))
    shared = shared_count(F.col("_ra"), F.col("_pa"))
    out = {
        "rouge1_f1": rouge(1), "rouge2_f1": rouge(2), "article_heading_f1": f1(shared, F.size("_pa"), F.size("_ra")), "distinct2": distinct_share(F.col("_2")),
        "repeated_4gram_ratio": F.when(F.size("_4") > 0, 1 - distinct_share(F.col("_4"))).otherwise(0.0),
    }
    return rows.withColumns(out).drop("_r", "_p", "_ra", "_pa", "_rw", "_pw", "_o", "_2", "_4")


def corpus_overlaps(pairs: DataFrame, reference: str, prediction: str, chars: int = CHAR_ORDERS, words: int = 4) -> DataFrame:
    """(kind, order, matches, predicted, expected): n-gram sums of a corpus, counted pair by pair before they are sent."""
    rows = pairs.where(F.col(reference).isNotNull() & F.col(prediction).isNotNull()).select(
        T.metric_text(F.col(reference)).alias("r"), T.metric_text(F.col(prediction)).alias("p")
    )
    rows = rows.select(overlaps_udf(chars, words)("r", "p", T.blank_split(F.col("r")), T.blank_split(F.col("p"))).alias("o"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"o.{k}").alias("orders")) for k in ("chars", "words")])
    rows = rows.select(F.explode(kinds).alias("k")).select("k.kind", F.posexplode("k.orders").alias("i", "c"))
    return rows.groupBy("kind", (F.col("i") + 1).alias("order")).agg(*[
        F.sum(F.col("c")[i]).alias(n) for i, n in enumerate(("matches", "predicted", "expected"))
    ])


def corpus_bleu(overlaps: DataFrame) -> DataFrame:
    """BLEU of four orders in percent: an order without matches gets half the precision of the one before such."""
    rows = overlaps.where("kind = 'words' and `order` <= 4")
    x = rows.agg(F.sort_array(F.collect_list(F.struct("order", "matches", "predicted", "expected"))).alias("o"), F.min("predicted").alias("least"))
    misses = lambda i: F.size(F.filter(F.slice("o", 1, i), lambda s: s["matches"] == 0))
    logs = [F.log(F.when(
        F.col("o")[i]["matches"] > 0, F.col("o")[i]["matches"] / F.col("o")[i]["predicted"]
    ).otherwise(1 / (F.pow(F.lit(2.0), misses(i + 1)) * F.col("o")[i]["predicted"]))) for i in range(4)]
    p, r = F.col("o")[0]["predicted"], F.col("o")[0]["expected"]
    brevity = F.when(p > r, 1.0).otherwise(F.exp(1 - r / p))
    return x.select(F.when(F.coalesce(F.col("least"), F.lit(0)) == 0, 0.0).otherwise(100 * brevity * F.exp(sum(logs, F.lit(0.0)) / 4)).alias("bleu"))


def corpus_chrf(overlaps: DataFrame, chars: int = CHAR_ORDERS, words: int = WORD_ORDERS, beta: float = BETA) -> DataFrame:
    """chrF++ in percent: precision and recall averaged over character and word orders."""
    rows = overlaps.where(f"(kind = 'chars' and `order` <= {chars}) or (kind = 'words' and `order` <= {words})")
    share = lambda n: F.sum(F.when(F.col(n) > 0, F.col("matches") / F.col(n)).otherwise(0.0)) / (chars + words)
    x = rows.agg(share("predicted").alias("p"), share("expected").alias("r"))
    below = beta * beta * F.col("p") + F.col("r")
    return x.select(F.when(below > 0, 100 * (1 + beta * beta) * F.col("p") * F.col("r") / below).otherwise(0.0).alias("chrf_plus_plus"))


def perplexity(nll: Column) -> Column:
    """exp of the loss, at most of 80; NaN stays NaN (``least`` would drop it)."""
    return F.when(F.isnan(nll), nll).otherwise(F.exp(F.least(nll, F.lit(80.0))))


def loss_perplexities(metrics: DataFrame) -> DataFrame:
    """Of (metric, value): adds a perplexity beside each loss, infinite from 80; those there stay as they are."""
    name = F.when(F.col("metric").endswith("_loss"), F.regexp_replace("metric", "_loss$", "_perplexity")).when(
        F.col("metric").endswith("_token_nll"), F.regexp_replace("metric", "_token_nll$", "_token_perplexity")
    )
    finite = ~F.isnan("value") & (F.col("value") < 80) & (F.col("value") > float("-inf"))
    new = metrics.select(name.alias("metric"), F.when(finite, F.exp("value")).otherwise(float("inf")).alias("value")).where("metric is not null")
    return metrics.unionByName(new.join(metrics.select("metric"), "metric", "left_anti"))


def token_metrics(rows: DataFrame, by: list[str], nll: str = "nll_sum", scored: str = "scored", top1: str = "top1", top5: str = "top5") -> DataFrame:
    """Loss, perplexity and accuracies weighted by tokens; NaN loss and accuracy 0 without any token."""
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_documents"), F.sum(scored).alias("full_document_scored_tokens"), F.sum(nll).alias("_n"), F.sum(top1).alias("_1"),
        F.sum(top5).alias("_5")
    )
    t = F.col("full_document_scored_tokens")
    loss = F.when(t > 0, F.col("_n") / t).otherwise(float("nan"))
    share = lambda c: F.when(t > 0, 100.0 * F.col(c) / t).otherwise(0.0)
    return s.select(
        *by, "num_documents", t, loss.alias("full_document_nll"), perplexity(loss).alias("full_document_perplexity"),
        share("_1").alias("full_document_top1_accuracy_percent"), share("_5").alias("full_document_top5_accuracy_percent")
    )


def generation_means(
    records: DataFrame, by: list[str], percents: list[str], means: list[str], rates: dict[str, str] | None = None, totals: list[str] = ()
) -> DataFrame:
    """Means over records that have a prediction and a reference: shares in percent, plain ones, rates of flags and totals; 0 of none."""
    have = F.col("prediction").isNotNull() & F.col("reference").isNotNull()
    mean = lambda c: F.coalesce(F.avg(F.when(have, F.col(c).cast("double"))), F.lit(0.0))
    return records.groupBy(*by).agg(
        F.count_if(have).alias("num_generation_documents"), *[(100 * mean(c)).alias(f"{c}_percent") for c in percents], *[mean(c).alias(f"average_{c}") for c in means],
        *[
            (100 * mean(c)).alias(name) for c, name in (rates or {}).items()
        ], *[F.coalesce(F.sum(F.when(have, F.col(c).cast("double"))), F.lit(0.0)).alias(f"total_{c}") for c in totals],
    )


def progressive(records: DataFrame, order: str, nll: str = "nll_sum", scored: str = "scored") -> DataFrame:
    """After each record, the loss of all up to and with it: one pass, not one for each record."""
    rows = running_totals(records, [], [order], {"_n": F.col(nll), "_t": F.col(scored)})
    return rows.select(
        order, F.when(F.col("_t") > 0, F.col("_n") / F.col("_t")).otherwise(float("nan")).alias("nll_so_far"), F.col("_t").alias("tokens_so_far")
    )


def logit_metrics(logits: DataFrame, position: list[str], token: str, logit: str, label: str, ignored: int = -100) -> DataFrame:
    """From one row for each candidate token of a position: its loss and whether the label is first or in the first five.

    Positions whose label is ``ignored`` are left out.  Of equal logits the label counts as last.  All sums are partial
    sums: a vocabulary is never put together.
    """
    rows = logits.where(F.col(label) != ignored).select(
        *position, F.col(logit).cast("double").alias("_v"), (F.col(token) == F.col(label)).alias("_hit")
    )
    x = rows.groupBy(*position).agg(F.max("_v").alias("_m"), F.max(F.when(F.col("_hit"), F.col("_v"))).alias("_l"))
    per = rows.join(x, position).groupBy(*position).agg(
        F.first("_m").alias("_m"), F.first("_l").alias("_l"), F.sum(F.exp(F.col("_v") - F.col("_m"))).alias("_s"),
        F.count_if(F.col("_v") >= F.col("_l")).alias("_above")
    )
    return per.select(
        *position, (F.col("_m") + F.log("_s") - F.col("_l")).alias("nll"), (F.col("_above") <= 1).cast("int").alias("top1"),
        (F.col("_above") <= 5).cast("int").alias("top5")
    )


def compare_models(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Of one row of metrics each: the shared numeric metrics side by side, with the gain in the better direction."""

    def long(df: DataFrame, name: str) -> DataFrame:
        numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float") and c not in IGNORED]
        return df.select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)
        ) for c in numeric])).alias("m")).select("m.*")

    rows = long(base, "base").join(long(tuned, "finetuned"), "metric")
    delta, lower = F.col("finetuned") - F.col("base"), F.col("metric").isin(*LOWER_IS_BETTER)
    return rows.select(
        "metric", "base", "finetuned", delta.alias("delta_finetuned_minus_base"), F.when(lower, -delta).otherwise(delta).alias("improvement"),
        (~lower).alias("higher_is_better")
    )


def best_checkpoints(steps: DataFrame, metric: str = "eval_token_nll", kept: int = 3) -> DataFrame:
    """Of (step, metric): the steps that are kept, the last ``kept`` and the best one."""
    best = steps.agg(F.min_by("step", F.struct(metric, "step")).alias("step")).withColumn("best", F.lit(True))
    last = steps.orderBy(F.desc("step")).limit(kept).select("step")
    return last.unionByName(best.select("step")).distinct().join(best, "step", "left").select("step", F.coalesce("best", F.lit(False)).alias("best"))


def training_steps(
    rows: DataFrame, batch: int, accumulation: int, epochs: float, warmup: float, eval_steps: int, logging_steps: int, max_steps: int = 0
) -> DataFrame:
    """Of one row with ``train_rows``: steps of an epoch, in all, of the warm-up, and between evaluations."""
    per = F.ceil(F.col("train_rows") / F.lit(batch * accumulation))
    total = F.lit(max_steps) if max_steps > 0 else F.ceil(per * F.lit(epochs))
    rows = rows.select(
        "train_rows", F.lit(batch * accumulation).cast("long").alias("effective_batch_size"), per.cast("long").alias("steps_per_epoch"),
        total.cast("long").alias("total_training_steps")
    )
    t = F.col("total_training_steps")
    return rows.withColumns({
        "warmup_steps": F.ceil(t * F.lit(warmup)).cast("long"), "eval_steps": F.least(F.lit(eval_steps).cast("long"), t),
        "logging_steps": F.least(F.lit(logging_steps).cast("long"), t)
    })
