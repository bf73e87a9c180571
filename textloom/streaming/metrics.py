"""Token-weighted metrics over a stream of scored records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def running_sums(records: DataFrame, by: list[str], nll: str, scored: str) -> DataFrame:
    """Sums that merge: works on a stream as on a table."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.sum(nll).alias("nll_sum"), F.sum(scored).alias("scored"))


def loss(sums: DataFrame) -> DataFrame:
    return sums.withColumn("token_nll", F.when(F.col("scored") > 0, F.col("nll_sum") / F.col("scored")).otherwise(float("nan")))


def windowed(records: DataFrame, time: str, width: str, late: str, nll: str, scored: str) -> DataFrame:
    """The sums of windows of event time; records later than ``late`` are dropped by the watermark.

    ``time`` may be a timestamp without zone, which watermarks don't take: it is read as UTC.
    """
    timed = records.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width)).agg(F.count(F.lit(1)).alias("records"), F.sum(nll).alias("nll_sum"), F.sum(scored).alias("scored"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now; its result as a table.

    Complete results are kept by batch in the shared folder; the last batch is the result.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{shared_folder(spark)}/textloom/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (last if last is not None else -1)).drop("batch")
