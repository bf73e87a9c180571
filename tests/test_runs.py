import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.config import settings
from textloom.plans import runs

rng = random.Random(5)


@pytest.fixture(scope="module")
def content(spark):
    rows = [(i, " ".join(rng.choice(["điều", "khoản", "luật", "a", "b"]) for _ in range(rng.randrange(5, 80))) + "\r\nĐiều 1. x") for i in range(120)]
    rows += [(200, None), (201, "  "), (202, "w " * 3000)]
    return spark.createDataFrame(rows, "id long, content string").withColumn("text", F.lit("not this one"))


@pytest.fixture(scope="module")
def metadata(spark):
    return spark.createDataFrame([(i, i, f"t|{i}", "Luật" if i % 3 else None) for i in range(100)] + [(5, 500, "newer", "Luật")], "id long, source_index long, title string, legal_type string")


def test_analysis_and_preparation(spark, content, metadata, tmp_path):
    summary = runs.analyze(content, "id", f"{tmp_path}/analysis", metadata)
    assert summary["content_rows"] == 123 and summary["content_column"] == "content" and summary["empty_after_clean"] == 2
    assert json.loads((tmp_path / "analysis/summary.json").read_text())["tokens_with_eos"]["count"] == 123
    report = (tmp_path / "analysis/report.md").read_text()
    assert all(x in report for x in ("## Data", "## Tokens", "## Structure", "## Context lengths", "## Recommendation", "## Longest documents", "| 1 | 202 | 3,001") if x != "| 1 | 202 | 3,001") and "| 1 | 202 | 3001 |" in report
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/analysis/document_token_stats.csv")
    assert csv.columns[:3] == ["document_id", "title", "legal_type"] and csv.count() == 123
    assert csv.where("document_id = '5'").first()["title"] == "newer"

    manifest = runs.prepare(content, "id", f"{tmp_path}/analysis", f"{tmp_path}/prepared")
    out = spark.read.parquet(f"{tmp_path}/prepared")
    counters = manifest["selection"]
    assert out.count() == counters["selected_rows"] and counters["stats_rows"] == 123 and counters["empty_after_clean"] == 2 and counters["over_p95_threshold"] >= 1
    assert sum(s["rows"] for s in manifest["splits"].values()) == out.count() and set(manifest["leakage"].values()) == {0}
    row = out.where("document_id = '7'").first() or out.first()
    assert row["chunk_id"] == row["document_id"] + "::0000" and row["chunk_type"] == "full_document_p95" and "\r" not in row["text"]
    assert out.where("title is null or legal_type is null").count() == 0
    assert json.loads((tmp_path / "prepared.manifest.json").read_text())["p95_threshold"] == manifest["p95_threshold"]
    with pytest.raises(Exception, match="(?i)exist"):
        runs.prepare(content, "id", f"{tmp_path}/analysis", f"{tmp_path}/prepared")
    with pytest.raises(ValueError, match="other content"):
        runs.prepare(content.where("id > 3"), "id", f"{tmp_path}/analysis", f"{tmp_path}/again")
    few = runs.prepare(content, "id", f"{tmp_path}/analysis", f"{tmp_path}/few", limit=10)
    assert few["selection"]["selected_rows"] == 10


def test_preparation_refuses(spark, content, tmp_path):
    runs.analyze(content, "id", f"{tmp_path}/html", settings=settings({"analysis": {"content_format": "html"}}))
    with pytest.raises(ValueError, match="markdown"):
        runs.prepare(content, "id", f"{tmp_path}/html", f"{tmp_path}/out")
    runs.analyze(content, "id", f"{tmp_path}/a")
    with pytest.raises(ValueError, match="nothing_selected"):
        runs.prepare(content, "id", f"{tmp_path}/a", f"{tmp_path}/out", threshold=0)


def test_evaluation(spark, tmp_path):
    rows = [(m, float(i + k), 10, 3, 5, "điều một hai ba bốn năm", "điều một hai ba bốn" if m == "a" else "điều một hai ba bốn năm", bool(i % 2)) for k, m in enumerate("ab") for i in range(6)]
    rows.append(("a", 5.0, 5, 1, 2, None, None, None))
    df = spark.createDataFrame(rows, "model string, nll_sum double, scored long, top1 long, top5 long, reference string, prediction string, ended_with_eos boolean")
    got = {r["metric"]: r for r in runs.evaluate(df, str(tmp_path), "a", "b", data="x").collect()}
    assert got["bleu"]["finetuned"] == pytest.approx(100) and got["bleu"]["base"] < 100 and got["eos_rate_percent"]["base"] == 50
    assert got["full_document_nll"]["base"] == pytest.approx(20 / 65) and got["full_document_nll"]["improvement"] < 0
    assert json.loads((tmp_path / "metrics.json").read_text())["a"]["num_generation_documents"] == 6
    assert "| rougeL_chunked_f1_percent |" in (tmp_path / "report.md").read_text()
