"""From analysed documents to a training corpus: selection by length, cleaning, checks and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from . import checks as C
from .selection import selection_reasons

STATS = ("tokens_without_eos", "tokens_with_eos", "num_chars", "num_lines", "article_count", "chapter_count", "section_count")
#: Fixed value: how a record that is a whole document is called.
CHUNK_TYPE = "full_document_p95"


def prepared_rows(
    content: DataFrame, id_column: str, text: str, stats: DataFrame, threshold: int, capacity: int, keep_empty: bool = False,
    passthrough: list[str] = ()
) -> DataFrame:
    """Selected documents with their cleaned text: one record each, and beside it what the checks look at.

    ``stats`` has a row for each document (``source_index`` is the content's id).  Documents are selected on their
    statistics before any text is read, so that only selected texts are cleaned.  NULL pass-through fields become "".
    """
    chosen = selection_reasons(stats, threshold, capacity, keep_empty).where("reason = 'selected'")
    texts = content.select(
        F.col(id_column).alias("source_index"), K.record_id(F.col(id_column), F.lit(None)).alias("content_id"), F.col(text).alias("_raw")
    )
    rows = chosen.join(texts, "source_index").withColumn("text", T.clean_html(F.col("_raw"), "markdown", tree=False))
    if not keep_empty:
        rows = rows.where("text <> ''")
    return rows.select(
        "document_id", F.concat("document_id", F.lit("::0000")).alias("chunk_id"), F.lit(CHUNK_TYPE).alias("chunk_type"), "source_index", "text", *STATS,
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in passthrough], "content_id", F.length("text").cast("long").alias("_cleaned_chars"),
    )


def preparation_checks(rows: DataFrame, stats: DataFrame, content: DataFrame, id_column: str, effective: int) -> DataFrame:
    """(check_name, violations) of prepared rows: ids that differ, lengths that cleaning changed, too long ones, repeated ids, an empty
    selection, and documents without statistics or statistics without a document."""
    rules = {
        "id_mismatch": F.col("content_id") != F.col("document_id"), "changed_length": F.col("_cleaned_chars") != F.col("num_chars"),
        "over_threshold": F.col("tokens_with_eos") > effective, "empty_text": F.col("text") == "",
    }
    empty = rows.agg((F.count(F.lit(1)) == 0).cast("long").alias("violations")).select(F.lit("nothing_selected").alias("check_name"), "violations")
    ids, known = content.select(F.col(id_column).alias("source_index")), stats.select("source_index")
    return C.together(
        C.count_where(rows, rules), C.count_rows("repeated_document", C.repeated(rows, "document_id")), empty,
        C.count_rows(
            "content_without_stats", ids.join(known, "source_index", "left_anti")
        ), C.count_rows("stats_without_content", known.join(ids, "source_index", "left_anti")),
    )
