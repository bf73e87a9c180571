import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.config import settings as make_settings
from textloom.functions import sequences as Q
from textloom.functions import tokens as K
from textloom.operators import checks as C
from textloom.operators import evaluation as E
from textloom.operators import selection as S
from textloom.operators import stats as A
from textloom.operators.components import shared_components
from textloom.operators.prefix import running_total
from textloom.sources import sinks


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_lcs(a, b):
    assert Q.lcs_length(a, b) == slow_lcs(a, b) == Q.lcs_length(b, a)


def test_chunked_lcs():
    assert Q.chunked_lcs_f1([], []) == 1.0
    assert Q.chunked_lcs_f1(["a"], []) == 0.0
    assert Q.chunked_lcs_f1(["a"], ["b"]) == 0.0
    assert Q.chunked_lcs_f1(list("abcd"), list("abcd"), 2) == 1.0
    assert Q.chunked_lcs_f1(list("abc"), list("ab"), 2) == pytest.approx(2 / 3)


def test_running_total_of_a_hot_group(spark):
    rows = [("hot", i, 1.0) for i in range(300)] + [(None, i, 2.0) for i in range(5)] + [("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    got = {(r["g"], r["o"]): r["total"] for r in running_total(df, ["g"], ["o"], F.col("v"), "total", 7).collect()}
    assert len(got) == 306
    assert all(got["hot", i] == i + 1 for i in range(300)) and got[None, 4] == 10 and got["b", 1] == 0
    assert running_total(df.where("o < 0"), ["g"], ["o"], F.col("v"), "total").count() == 0


def test_components(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, "c", None), (5, None, None), (6, None, "y"), (7, "d", "y"), (8, "d", "z"), (9, "e", "z")]
    df = spark.createDataFrame(rows, "k long, p string, q string")
    got = {r["id"]: r["entity"] for r in shared_components(df, "k", [F.col("p"), F.col("q")]).collect()}
    groups = {}
    for k, e in got.items():
        groups.setdefault(e, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4], [5], [6, 7, 8, 9]]
    chain = spark.createDataFrame([(i, str(i), str(i + 1)) for i in range(40)], "k long, p string, q string")
    assert shared_components(chain, "k", [F.col("p"), F.col("q")], tag=False).select("entity").distinct().count() == 1


def test_numeric_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "num_chars long, num_lines long, tokens_with_eos long, article_count long")
    rows = A.numeric_summaries(empty).collect()
    assert len(rows) == 4 and all(v == 0 for r in rows for v in r[1:])
    assert A.chunk_plans(empty.withColumn("tokens_without_eos", F.lit(1))).count() == 0


def test_chunks(spark):
    f = lambda n, t, o: spark.range(1).select(K.estimated_chunks(F.lit(n), F.lit(t), o).alias("x")).first()["x"]
    assert [f(10, 10, 2), f(11, 10, 2), f(18, 10, 2), f(19, 10, 2), f(5, 5, 9)] == [1, 2, 2, 3, 1]
    with pytest.raises(Exception, match="overlap"):
        f(6, 5, 5)


@pytest.mark.parametrize("total, context, stride", [(0, 5, 2), (1, 5, 2), (2, 5, 2), (5, 5, 2), (6, 5, 2), (23, 5, 2), (20, 5, 5)])
def test_score_windows(spark, total, context, stride):
    rows = spark.range(1).select(F.explode(K.score_windows(F.lit(total), context, stride)).alias("w")).select("w.*").collect()
    scored = sum(max(0, r["end"] - r["score_from"]) for r in rows)
    lost = (total - context) // context if stride == context and total > context else 0
    assert scored == max(0, total - 1 - lost)
    assert len(rows) == (0 if not total else 1 if total <= context else 1 + math.ceil((total - context) / stride))


def test_pieces_and_eos(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [1, 2]), ([], [0])], "s array<string>, i array<int>")
    rows = df.select(K.pieces(F.col("s"), 2).alias("p"), K.ngrams(F.col("s"), 2).alias("g"), K.append_eos(F.col("i"), F.lit(0)).alias("e")).collect()
    assert rows[0]["p"] == [["a", "b"], ["c"]] and len(rows[0]["g"]) == 2 and rows[0]["e"] == [1, 2, 0]
    assert rows[1]["p"] == [] and rows[1]["g"] == [] and rows[1]["e"] == [0]


def test_first_selected_counts_up_to_the_limit(spark):
    df = spark.createDataFrame([(i, 1 if i % 2 else 99, i == 4) for i in range(10)], "source_index long, tokens_with_eos long, empty_after_clean boolean")
    reasons = S.selection_reasons(df, 50, 100)
    row = S.selection_counters(S.first_selected(reasons, 3)).first()
    assert (row["stats_rows"], row["selected_rows"], row["empty_after_clean"], row["over_p95_threshold"]) == (6, 3, 1, 2)


@pytest.mark.parametrize("n, v, t", [(0, 0.1, 0.1), (1, 0.1, 0.1), (97, 0.1, 0.1), (50, 0.2, 0.0), (50, 0.0, 0.2), (10, 0.0, 0.0)])
def test_seeded_split(spark, n, v, t):
    df = spark.range(n).toDF("k")
    got = {r["split"]: r["n"] for r in S.seeded_split(df, "k", v, t).groupBy("split").agg(F.count("*").alias("n")).collect()}
    held = math.ceil(round(n * (v + t), 9))
    assert sum(got.values()) == n and got.get("train", 0) == n - held
    again = S.seeded_split(df.repartition(3), "k", v, t).exceptAll(S.seeded_split(df, "k", v, t))
    assert again.count() == 0


def test_f1_edges(spark):
    f = lambda m, p, r: spark.range(1).select(E.f1(F.lit(m), F.lit(p), F.lit(r)).alias("x")).first()["x"]
    assert [f(0, 0, 0), f(0, 3, 0), f(0, 0, 3), f(0, 2, 2), f(2, 2, 2)] == [1.0, 0.0, 0.0, 0.0, 1.0]


def test_bleu_smoothing_and_short_predictions(spark):
    score = lambda ref, pred: E.corpus_bleu(E.corpus_overlaps(spark.createDataFrame([(ref, pred)], "r string, p string"), "r", "p")).first()["bleu"]
    assert score("a b c d e", "a b c d e") == pytest.approx(100)
    assert score("a b", "a b") == 0.0
    want = 100 * math.exp(sum(map(math.log, (4 / 5, 2 / 4, 1 / (2 * 3), 1 / (4 * 2)))) / 4) * math.exp(0)
    assert score("a b x c d", "a b y c d") == pytest.approx(want)


def test_perplexities(spark):
    df = spark.createDataFrame([("eval_loss", 1.0), ("a_token_nll", 90.0), ("b_loss", float("nan")), ("eval_perplexity", 7.0), ("acc", 3.0)], "metric string, value double")
    got = {r["metric"]: r["value"] for r in E.loss_perplexities(df).collect()}
    assert got["eval_perplexity"] == 7.0 and got["a_token_perplexity"] == math.inf and got["b_perplexity"] == math.inf and len(got) == 7
    rows = spark.createDataFrame([("m", 0.0, 0, 0, 0), ("n", 200.0, 2, 1, 2)], "model string, nll_sum double, scored long, top1 long, top5 long")
    m = {r["model"]: r for r in E.token_metrics(rows, ["model"]).collect()}
    assert math.isnan(m["m"]["full_document_perplexity"]) and m["m"]["full_document_top1_accuracy_percent"] == 0
    assert m["n"]["full_document_perplexity"] == pytest.approx(math.exp(80))


def test_logits(spark):
    rows = [(1, t, float(v), 2) for t, v in enumerate([0, 1, 2, 3, 4, 5])] + [(2, 0, 1.0, -100), (3, 0, 1.0, 0)]
    got = {r["pos"]: r for r in E.logit_metrics(spark.createDataFrame(rows, "pos int, token int, logit double, label int"), ["pos"], "token", "logit", "label").collect()}
    assert set(got) == {1, 3} and got[1]["top1"] == 0 and got[1]["top5"] == 1 and got[3]["top1"] == 1
    assert got[1]["nll"] == pytest.approx(math.log(sum(math.exp(v) for v in range(6))) - 2)


def test_checkpoints(spark):
    df = spark.createDataFrame([(i, abs(i - 2) + 0.5) for i in range(6)], "step int, eval_token_nll double")
    assert {(r["step"], r["best"]) for r in E.best_checkpoints(df).collect()} == {(2, True), (3, False), (4, False), (5, False)}


def test_padding(spark):
    df = spark.createDataFrame([([7, 0],)], "ids array<int>")
    ids, mask, labels = K.padded(F.col("ids"), 4, F.size("ids"), 0)
    assert tuple(df.select(ids, mask, labels).first()) == ([7, 0, 0, 0], [1, 1, 0, 0], [7, 0, -100, -100])


def test_latest_metadata(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "document_id string")
    meta = spark.createDataFrame([(1, 5, "new"), (1, 4, "old"), (1, 5, "new")], "id long, source_index long, title string")
    assert sorted(map(tuple, A.attach_latest(rows, meta, "id", ["title", "missing"]).collect())) == [("1", "new"), ("2", None)]


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "k int, v string")
    checks = C.together(C.count_where(df, {"null": F.col("v").isNull(), "never": F.col("v") == "q"}), C.count_rows("twice", C.repeated(df, "k")))
    assert {r[0]: r[1] for r in checks.collect()} == {"null": 1, "never": 0, "twice": 1}
    with pytest.raises(ValueError, match="null"):
        C.require(checks)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,\n\"q\"", 1, "train"), (None, 2, "test")], "t string, n int, split string")
    sinks.write_csv(df, f"{tmp_path}/csv", ["n", "t", "gone"])
    back = sinks.read_csv(spark, f"{tmp_path}/csv", ["t"])
    assert back.columns == ["n", "t", "gone"] and {r["t"] for r in back.collect()} == {"a,\n\"q\"", None}
    with pytest.raises(KeyError):
        sinks.read_csv(spark, f"{tmp_path}/csv", ["other"])
    sinks.write_splits(df, f"{tmp_path}/splits", 100)
    assert spark.read.parquet(f"{tmp_path}/splits").where("split = 'test'").count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_splits(df, f"{tmp_path}/splits")
    sinks.write_jsonl(df, f"{tmp_path}/jsonl")
    sinks.write_json(f"{tmp_path}/x/y.json", {"đ": float("nan")})
    assert "đ" in (tmp_path / "x" / "y.json").read_text(encoding="utf-8")
    assert sinks.one_row(df.agg(F.count("*").alias("n"))) == {"n": 2}


def test_settings(tmp_path):
    s = make_settings({"evaluation": {"stride": 512}}, {"evaluation.context": 600, "preparation.seed": None})
    assert s.evaluation.stride == 512 and s.evaluation.context == 600 and len(s.key()) == 16
    for bad in ({"nothing": {}}, {"evaluation": {"x": 1}}):
        with pytest.raises(KeyError):
            make_settings(bad)
    for bad in ({"evaluation": {"stride": 9999}}, {"analysis": {"target_utilization": 0}}, {"preparation": {"validation": 0.9, "test": 0.1}}):
        with pytest.raises(ValueError):
            make_settings(bad)


def test_resolve(spark):
    from textloom.sources import resolve as R

    df = spark.createDataFrame([("a", "b")], "text string, content string")
    assert R.content_column(df) == "content" and R.content_column(df, "text") == "text"
    for bad in (lambda: R.content_column(df, "html"), lambda: R.content_column(df.select(F.lit(1).alias("x"))), lambda: R.pick_split(["a", "b"])):
        with pytest.raises(KeyError):
            bad()
    assert [R.pick_split(x) for x in (["train", "data"], ["test", "train"], ["only"])] == ["data", "train", "only"]
    assert R.newest_checkpoint(["x/checkpoint-9", "x/checkpoint-10", "x/checkpoint-a", "x/other-99"]) == "x/checkpoint-10"
    assert R.newest_checkpoint([]) is None


def test_truncation_and_ids(spark):
    df = spark.createDataFrame([([1, 2, 3], None, 7)], "ids array<int>, k string, i long")
    row = df.select(K.truncated(F.col("ids"), 3).alias("a"), K.truncated(F.col("ids"), 1).alias("b"), K.truncated(F.col("ids"), 0).alias("c"), K.record_id(F.col("k"), F.col("i")).alias("d")).first()
    assert tuple(row) == ([1, 2], [1], [1, 2, 3], "7")


def test_reports(spark):
    row = spark.createDataFrame([(2.0, 50.0)], "full_document_nll double, bleu double")
    better = spark.createDataFrame([(1.0, 40.0)], "full_document_nll double, bleu double")
    got = {r["metric"]: r for r in E.compare_models(row, better).collect()}
    assert got["full_document_nll"]["improvement"] == 1.0 and got["bleu"]["improvement"] == -10.0
    text = sinks.comparison_report(E.compare_models(row, better), "a", "b", "test", 7)
    assert "| bleu |" in text and "- base: a" in text and "Lower is better: full_document_nll." in text


def test_tokenizers(spark):
    from textloom.functions.tokenizers import BatchTokenizer, WordTokenizer

    codes = BatchTokenizer("codes", lambda: lambda rows: [list(map(ord, t)) for t in rows], eos=ord("."), settings={"size": 9})
    df = spark.createDataFrame([(1, "a b."), (2, "a b"), (3, ""), (4, None)], "k long, t string")
    pick = lambda **more: {r["document_id"]: (r["tokens_without_eos"], r["tokens_with_eos"]) for r in A.document_stats(df, "k", "t", **more).collect()}
    assert pick(tokenizer=codes) == {"1": (4, 4), "2": (3, 4), "3": (0, 1), "4": (0, 1)}
    assert pick(tokenizer=codes, add_eos=False) == {"1": (4, 4), "2": (3, 3), "3": (0, 0), "4": (0, 0)}
    assert pick() == {"1": (2, 3), "2": (2, 3), "3": (0, 1), "4": (0, 1)} and pick(add_eos=False)["2"] == (2, 2)
    prints = {t.fingerprint() for t in (codes, WordTokenizer(), BatchTokenizer("codes", codes.load, eos=1), BatchTokenizer("codes", codes.load, eos=ord("."), settings={"size": 9}))}
    assert len(prints) == 3
    given_ = spark.createDataFrame([("1", 7, 8), ("1", 6, 7), (None, 1, 1)], "document_id string, tokens_without_eos long, tokens_with_eos long")
    got = {r["document_id"]: r["tokens_with_eos"] for r in A.with_token_counts(A.document_stats(df, "k", "t"), given_).collect()}
    assert got == {"1": 8, "2": 3, "3": 1, "4": 1}


def test_top_groups_of_many(spark):
    rows = spark.range(3000).select(F.col("id").alias("source_index"), (F.col("id") % 1000).cast("string").alias("g"), F.lit(1).alias("tokens_with_eos"), F.when(F.col("id") < 5, "x ").alias("h"))
    got = A.group_summaries(rows, ["g", "h"]).collect()
    assert [r["value"] for r in got if r["field"] == "g"] and {r["value"] for r in got if r["field"] == "g"} == {str(i) for i in range(30)}
    assert {(r["value"], r["documents"]) for r in got if r["field"] == "h"} == {("x", 5), ("unknown", 2995)}


def test_rows_at(spark):
    df = spark.range(10).select(F.col("id").alias("source_index"))
    assert sorted(r[0] for r in S.rows_at(df, spark.createDataFrame([(3,), (3,), (99,)], "source_index long")).collect()) == [3]


def test_input_checks(spark, tmp_path):
    from textloom.sources import resolve as R

    df = spark.createDataFrame([("train", "a"), ("test", "b")], "split string, text string")
    assert R.require_splits(df, ["train", "test"]) is df
    with pytest.raises(ValueError, match="validation"):
        R.require_splits(df, ["train", "validation"])
    with pytest.raises(KeyError, match="body"):
        R.require_splits(df, ["train"], ["body"])
    there = {"x/document_token_stats.csv"}
    with pytest.raises(FileNotFoundError):
        R.analysis_paths("x", exists=there.__contains__)
    assert R.analysis_paths("x", threshold=9, exists=there.__contains__) == ("x/document_token_stats.csv", None)
    assert R.analysis_paths("x", summary="y", exists=lambda p: True) == ("x/document_token_stats.csv", "y")
    with pytest.raises(ValueError, match="html"):
        R.require_markdown({"content_format": "html"})


def test_kept_tables_are_forgotten(spark):
    from textloom.sources.tables import forget, keep

    forget(spark)
    df = keep(spark.range(3), "x")
    assert df.count() == 3 and forget(spark) == 1 and forget(spark) == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    from textloom.sources.tables import shared_folder

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
