"""Problem 7: mixing sources to target weights, by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_total
from ..sources.tables import keep

SEED = 3407


def mix_sources(texts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Copies of each text so that sources have their target shares of all tokens.

    ``texts`` has a row for each different text (id, source, tokens); ``targets`` is a small table
    (source, target_share, max_repeats).  The mixture has ``total`` tokens, or as many as the scarcest
    source allows when its texts are used ``max_repeats`` times.  Within a source each text is
    expected ``rate`` times, at most ``max_repeats``; expected copies are summed up along the texts
    from short to long, a random start is added, and a text is used once for each whole number passed.
    So no text is used more than ``max_repeats`` times (rounded down), and short and long texts keep
    their proportion.  Returns the used texts (id, source, tokens, copies), and for each target
    source what it has, was to have and got.  Sources without a target, texts of no tokens and NULL
    sources are left out; a source without texts gets nothing and doesn't limit the others.
    """
    goals = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    sized = texts.select("id", "source", "tokens").where("tokens > 0").join(F.broadcast(goals), "source").select("id", "source", "tokens")
    sized = keep(sized, "mix-sized")  # read several times below
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("available"), F.max("tokens").alias("longest"))
    plan = keep(goals.join(have, "source", "left"), "mix-plan")
    limit = plan.agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share"))).first()[0]
    size = float(total if total is not None else limit or 0)
    rate = F.least(F.lit(size) * F.col("target_share") / F.col("available"), F.col("max_repeats").cast("double"))
    offset = (F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007.0)
    plan = plan.select(
        "source", "target_share", "max_repeats", "texts", "available", "longest", F.coalesce(rate, F.lit(0.0)).alias("rate"), offset.alias("offset")
    )
    along = running_total(sized, ["source"], ["tokens", "id"], F.lit(1), "place")
    # expected copies of the first n texts are n times the rate: no sum of fractions
    upto = F.floor(F.col("place") * F.col("rate") + F.col("offset"))
    before = F.floor((F.col("place") - 1) * F.col("rate") + F.col("offset"))
    used = along.join(F.broadcast(plan.select("source", "rate", "offset")), "source").select(
        "id", "source", "tokens", (upto - before).cast("int").alias("copies")
    ).where("copies > 0")
    used = keep(used, "mix-used")
    got = used.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("used_texts"), F.max("copies").alias("most_copies")
    )
    whole = got.agg(F.sum("mixed_tokens")).first()[0] or 1
    report = plan.drop("offset").join(got, "source", "left").fillna(0, ["texts", "available", "longest", "mixed_tokens", "used_texts", "most_copies"])
    return used, report.withColumn("reached_share", F.col("mixed_tokens") / F.lit(float(whole)))
