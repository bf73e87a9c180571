"""Whole runs: analyse a corpus, prepare a training corpus from it, evaluate two models' records.

Each reads tables, writes tables, and at the end the small documents that describe them.  Output folders for documents are
on a file system the driver can write; tables go wherever Spark can.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.tokenizers import WordTokenizer
from ..operators import checks as C
from ..operators import evaluation as E
from ..operators import prepare as P
from ..operators import selection as S
from ..operators import stats as A
from ..sources import resolve, sinks
from ..sources.tables import keep

FIELDS = ("document_number", "title", "url", "legal_type", "legal_sectors", "issuing_authority", "issuance_date", "signers")
GROUPED = ("legal_type", "legal_sectors", "issuing_authority")
NAMES = {"num_chars": "characters", "num_lines": "lines", "tokens_with_eos": "tokens_with_eos", "article_count": "articles"}
LONG_COLUMNS = ("num_chars", "num_lines", "tokens_without_eos", "tokens_with_eos", "article_count", "chapter_count", "section_count")


def analyze(
    content: DataFrame, id_column: str, out: str, metadata: DataFrame | None = None, metadata_id: str = "id", settings: Settings = Settings(),
    tokenizer=WordTokenizer(), add_eos: bool = True, content_column: str | None = None, tables: str | None = None
) -> dict:
    """Statistics of each document, and of all of them.

    Writes ``document_token_stats`` (Parquet, and CSV with its fields in order) and ``longest_documents`` to ``tables`` (else ``out``),
    ``summary.json`` and ``report.md`` to ``out``; returns the summary.  Metadata is optional; of an id's rows the last counts.
    """
    cfg, tables = settings.analysis, tables or out
    resolve.require_columns(content, [id_column])
    text = resolve.content_column(content, content_column)
    stats = A.document_stats(content, id_column, text, cfg.content_format, tokenizer, add_eos)
    fields = [f for f in FIELDS if metadata is not None and f in metadata.columns]
    if fields:
        stats = A.attach_latest(stats, metadata, metadata_id, fields)
    stats.write.mode("errorifexists").parquet(f"{tables}/document_token_stats.parquet")
    stats = content.sparkSession.read.parquet(f"{tables}/document_token_stats.parquet")
    sinks.write_csv(stats, f"{tables}/document_token_stats.csv", ["document_id", *fields, *LONG_COLUMNS, "empty_after_clean"])
    longest = A.longest(stats, cfg.longest)
    sinks.write_jsonl(longest, f"{tables}/longest_documents")
    plans = A.chunk_plans(stats, reserved=cfg.reserved_tokens, utilization=cfg.target_utilization, overlap=cfg.overlap)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  tables of a few rows
    best = rows(A.recommended_plan(plans))
    grouped = [f for f in GROUPED if f in fields]
    groups = rows(A.group_summaries(stats, grouped)) if grouped else []
    summary = {
        "content_rows": content.count(), "metadata_rows": metadata.count() if metadata is not None else 0, "content_column": text, "content_format": cfg.content_format,
        "dataset_fingerprint": sinks.one_row(S.fingerprint(content, [id_column, text])), "tokenizer": tokenizer.name, "tokenizer_fingerprint": tokenizer.fingerprint(), "add_eos": add_eos,
        "metadata_fields": fields, "group_by_fields": grouped, "reserved_tokens": cfg.reserved_tokens, "target_utilization": cfg.target_utilization, "overlap": cfg.overlap, "settings_key": settings.key(),
        "empty_after_clean": stats.where("empty_after_clean").count(), **{NAMES[r.pop("measure")]: r for r in rows(A.numeric_summaries(stats))},
        "chunk_plans": sorted(rows(plans), key=lambda p: p["max_seq_length"]), "recommended_plan": best[0] if best else {}, "metadata_group_summaries": {f: [g for g in groups if g["field"] == f] for f in grouped},
    }
    sinks.write_json(f"{out}/summary.json", summary)
    sinks.write_text(f"{out}/report.md", sinks.analysis_report(summary, summary["chunk_plans"], best[0] if best else None, rows(longest.limit(10))))
    return summary


def prepare(
    content: DataFrame, id_column: str, analysis: str, out: str, settings: Settings = Settings(), tables: str | None = None,
    threshold: float | None = None, content_column: str | None = None, limit: int = 0
) -> dict:
    """A training corpus in splits, from an analysis of the same content.

    Refuses an analysis in another mode or of other content, any violated check, documents in two splits, and an output
    that is there.  Writes the splits to ``out`` and then ``manifest.json`` beside them (``out`` + ``.manifest.json``), which it returns.
    """
    cfg, tables = settings.preparation, tables or analysis
    spark = content.sparkSession
    _, path = resolve.analysis_paths(
        analysis, stats=f"{tables}/document_token_stats.parquet", threshold=threshold, exists=lambda p: p.endswith(".parquet") or os.path.exists(p)
    )  # Spark tells if the table is missing
    summary = resolve.require_markdown(sinks.read_json(path) if path else {})
    text = resolve.content_column(content, content_column)
    p95 = math.ceil(threshold if threshold is not None else summary["tokens_with_eos"]["p95"])
    capacity = cfg.max_seq_length - cfg.reserved_tokens
    seen = sinks.one_row(S.fingerprint(content, [id_column, text]))
    if summary.get("dataset_fingerprint", seen) != seen:
        raise ValueError("the analysis is of other content; repeat it")
    stats = spark.read.parquet(f"{tables}/document_token_stats.parquet")
    passthrough = [c for c in FIELDS if c in stats.columns]
    reasons = S.selection_reasons(stats, p95, capacity, cfg.keep_empty)
    if limit:
        reasons = keep(S.first_selected(reasons, limit), "limited")
    counters = S.selection_counters(reasons)
    rows = keep(P.prepared_rows(content, id_column, text, reasons.drop("reason"), p95, capacity, cfg.keep_empty, passthrough), "prepared")
    checks = P.preparation_checks(rows, stats, content, id_column, min(p95, capacity))
    C.require(checks)
    split = S.seeded_split(rows.drop("content_id", "_cleaned_chars"), "document_id", cfg.validation, cfg.test, cfg.seed)
    split = keep(split, "prepared-splits")
    leakage = S.split_leakage(split)
    C.require(leakage.select(F.concat_ws("/", "left_split", "right_split").alias("check_name"), F.col("shared").alias("violations")))
    manifest = sinks.manifest(
        counters, S.split_summary(split), leakage, content_column=text, content_format="markdown", dataset_fingerprint=seen, analysis_settings_key=summary.get("settings_key"), tokenizer=summary.get("tokenizer"),
        max_seq_length=cfg.max_seq_length, reserved_tokens=cfg.reserved_tokens, p95_threshold=p95, effective_threshold=min(p95, capacity), split_ratios={
            "train": 1 - cfg.validation - cfg.test, "validation": cfg.validation, "test": cfg.test
        },
    )
    sinks.write_splits(split, out)
    sinks.write_json(f"{out}.manifest.json", manifest)
    return manifest


def evaluate(records: DataFrame, out: str, base: str, tuned: str, model: str = "model", data: str = "") -> DataFrame:
    """Metrics of two models from one table of records (``model``, loss sums, and texts where there are any), side by side.

    Records without a prediction and a reference count for the losses alone.  Writes ``metrics.json`` and ``report.md`` to ``out``.
    """
    one = lambda name: records.where(F.col(model) == name)
    metrics = {}
    for name in (base, tuned):
        rows = one(name)
        row = E.token_metrics(rows, []).drop("num_documents")
        if {"prediction", "reference"} <= set(records.columns):
            scored = keep(E.continuation_metrics(rows, "reference", "prediction"), "continuations")
            means = E.generation_means(
                scored, [], list(E.SCORES), [c for c in E.LENGTHS if c in records.columns],
                {"ended_with_eos": "eos_rate_percent"} if "ended_with_eos" in records.columns else None
            )
            bleu = E.corpus_bleu(E.corpus_overlaps(rows, "reference", "prediction", 0, 4))
            chrf = E.corpus_chrf(E.corpus_overlaps(rows, "reference", "prediction", E.CHAR_ORDERS, E.WORD_ORDERS))
            for more in (means, bleu, chrf):
                row = row.join(F.broadcast(more))  # one row each
        metrics[name] = keep(row, "metrics")
    comparison = keep(E.compare_models(metrics[base], metrics[tuned]), "comparison")
    sinks.write_json(f"{out}/metrics.json", {name: sinks.one_row(df) for name, df in metrics.items()})
    sinks.write_text(f"{out}/report.md", sinks.comparison_report(comparison, base, tuned, data, one(base).count()))
    return comparison
