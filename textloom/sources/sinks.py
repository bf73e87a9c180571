"""Writing tables and reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the metrics of a comparison report, in order.
PREFERRED = (
    "full_document_nll", "full_document_perplexity", "full_document_top1_accuracy_percent", "full_document_top5_accuracy_percent", "rouge1_f1_percent", "rouge2_f1_percent", "rougeL_chunked_f1_percent",
    "bleu", "chrf_plus_plus", "article_heading_f1_percent", "distinct2_percent", "repeated_4gram_ratio_percent", "eos_rate_percent",
)


def write_splits(df: DataFrame, path: str, rows_per_file: int = 0, if_exists: str = "errorifexists") -> None:
    """One folder for each split, so that reading one split reads no other; refuses a folder that is there."""
    writer = df.write.partitionBy("split").mode(if_exists)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in this order, with a header; missing fields and NULL are empty."""
    have = set(df.columns)
    df.select(*[F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields]).write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def read_csv(spark, path: str, required: list[str] = ()) -> DataFrame:
    """All fields as text; quoted line feeds belong to a value."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise KeyError(f"missing columns: {missing}")
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_text(path: str, text: str) -> None:
    """A small document, in place at once or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, target)


def write_json(path: str, value: object) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def one_row(df: DataFrame) -> dict:
    """The only row of a table of aggregates."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError("not one row")
    return rows[0].asDict(recursive=True)


def manifest(selection: DataFrame, summaries: DataFrame, leakage: DataFrame, **settings) -> dict:
    """What a prepared corpus was made of: settings, counters, split figures, shared documents."""
    return {
        **settings, "selection": one_row(selection), "splits": {r["split"]: r.asDict() for r in summaries.collect()},
        "leakage": {f"{r['left_split']}/{r['right_split']}": r["shared"] for r in leakage.collect()}
    }


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(map(str, r)) + " |" for r in rows]]


def _listing(title: str, items: dict[str, object]) -> list[str]:
    figure = lambda v: f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else v
    return ["", f"## {title}", "", *[f"- {name}: {figure(v)}" for name, v in items.items()]]


def analysis_report(summary: dict, plans: list[dict], recommended: dict | None, longest: list[dict], top: int = 10) -> str:
    """Markdown of an analysis: data, tokens, structure, context lengths, the recommended one, the longest documents."""
    tokens, chars, articles = (summary[k] for k in ("tokens_with_eos", "characters", "articles"))
    percentiles = " / ".join(f"{tokens[p]:,.2f}" for p in ("p90", "p95", "p99"))
    lines = ["# Corpus analysis"]
    lines += _listing(
        "Data",
        {
            "content rows": summary["content_rows"], "metadata rows": summary["metadata_rows"], "content column": summary["content_column"],
            "tokenizer": summary["tokenizer"], "end mark counted": summary["add_eos"]
        }
    )
    lines += _listing(
        "Tokens",
        {
            "total": tokens["sum"], "mean of a document": tokens["mean"], "median": tokens["median"], "p90 / p95 / p99": percentiles,
            "most": tokens["max"]
        }
    )
    lines += _listing(
        "Structure",
        {"mean characters": chars["mean"], "mean articles": articles["mean"], "p95 articles": articles["p95"], "most articles": articles["max"]}
    )
    over = lambda p, what: f"{p[f'documents_over_{what}']:,} ({p[f'documents_over_{what}_percent']:.2f} %)"
    rows = [[
        p["max_seq_length"], p["target_chunk_tokens"], over(p, "context"), over(p, "target"), p["estimated_chunks"],
        f"{p['estimated_mean_chunks_per_doc']:.2f}", p["estimated_max_chunks_for_one_doc"]
    ] for p in plans]
    lines += [
        "", "## Context lengths", "", *_table(["context", "target", "over context", "over target", "chunks", "mean chunks", "most chunks"], rows)
    ]
    if recommended:
        lines += _listing(
            "Recommendation",
            {
                "context": recommended["max_seq_length"], "target": recommended["target_chunk_tokens"], "reserved": summary["reserved_tokens"],
                "chunks": recommended["estimated_chunks"]
            }
        )
    cell = lambda v, n=120: str(v or "").replace("|", "\\|")[:n]
    rows = [
        [i, cell(r["document_id"]), r["tokens_with_eos"], r["num_chars"], r["article_count"], cell(r.get("title"))] for i,
        r in enumerate(longest[:top], 1)
    ]
    lines += ["", "## Longest documents", "", *_table(["rank", "document", "tokens", "characters", "articles", "title"], rows)]
    return "\n".join(lines) + "\n"


def comparison_report(comparison: DataFrame, base: str = "base", tuned: str = "finetuned", data: str = "", documents: int | None = None) -> str:
    """Markdown of two models' metrics: what was compared on what, the preferred metrics in order, and how to read them."""
    got = {r["metric"]: r for r in comparison.collect()}  # a row for each metric
    lines = [
        "# Comparison", "", f"- base: {base}", f"- finetuned: {tuned}", *([f"- data: {data}"] if data else []),
        *([f"- documents, the same for both: {documents:,}"] if documents is not None else []), ""
    ]
    rows = [[m, *(f"{got[m][c]:.6f}" for c in ("base", "finetuned", "delta_finetuned_minus_base", "improvement"))] for m in PREFERRED if m in got]
    lines += _table(["metric", "base", "finetuned", "delta", "improvement"], rows)
    lower = [m for m in PREFERRED if m in got and not got[m]["higher_is_better"]]
    return "\n".join([*lines, "", f"Lower is better: {', '.join(lower) or 'none'}. Losses and accuracies are weighted by tokens."]) + "\n"
