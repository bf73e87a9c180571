"""Reading tables, and writing intermediate ones where every executor can read them again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``, for work that takes far longer than reading: see ``spread``."""
    return spread(table(spark, folder, name))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a partition for each core, where it comes in less than half as many (a single small file).

    Tables of more files or row groups than that, so all large ones, stay as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a new local one if Spark runs in this process (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_textloom_folder", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark._textloom_folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: it is computed once and its lineage ends here.

    Unlike cached blocks the files survive the loss of executors.  ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    spark._textloom_kept = [*getattr(spark, "_textloom_kept", []), path]
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes what ``keep`` has written in this session, once its results are no longer read; how many tables that were."""
    kept = getattr(spark, "_textloom_kept", [])
    for path in kept:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._textloom_kept = []
    return len(kept)
