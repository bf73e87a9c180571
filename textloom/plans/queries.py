"""The registered queries of the core, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions.sequences import chunked_lcs_f1_udf
from ..functions.tokenizers import BatchTokenizer
from ..operators import checks as C
from ..operators import evaluation as E
from ..operators import prepare as P
from ..operators import selection as S
from ..operators import stats as A
from ..operators.fields import split_field
from ..operators.prefix import running_total
from ..sources.tables import keep, table, texts
from ..streaming import metrics as M
from .oracles import ORACLE

LIMIT = 500  # of first_selected, an operator that stops at a number of rows
CONTEXT, STRIDE = 512, 128


def _codes():
    return lambda rows: [list(map(ord, t)) for t in rows]


CODES = BatchTokenizer("codes", _codes, eos=ord("."))


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return A.document_stats(texts(spark, folder, "documents"), "doc_id", "text")


def document_stats(spark, folder):
    return _stats(spark, folder)


def corpus_summary(spark, folder):
    return A.numeric_summaries(_stats(spark, folder))


def _grouped(spark, folder, fields):
    labels = table(spark, folder, "documents").select(F.col("doc_id").alias("source_index"), *fields)
    return A.group_summaries(_stats(spark, folder).join(labels, "source_index"), fields)


def group_summary_lang(spark, folder):
    return _grouped(spark, folder, ["lang"])


def group_summary_source(spark, folder):
    return _grouped(spark, folder, ["source"])


def group_summary_sets(spark, folder):
    return _grouped(spark, folder, ["lang", "source"])


def document_stats_codes(spark, folder):
    """Statistics under another tokenizer, plugged in: a token for each character; texts that end in a full stop have their end mark."""
    return A.document_stats(texts(spark, folder, "documents"), "doc_id", "text", tokenizer=CODES)


def document_stats_given(spark, folder):
    """Statistics with the delivered token counts where there are any."""
    return A.with_token_counts(_stats(spark, folder), table(spark, folder, "document_token_stats"))


def chunk_plan(spark, folder):
    return A.chunk_plans(_stats(spark, folder))


def recommended_plan(spark, folder):
    return A.recommended_plan(chunk_plan(spark, folder))


def longest_documents(spark, folder):
    return A.longest(_stats(spark, folder)).select("document_id", "num_chars", "tokens_with_eos")


METADATA = ["document_number", "title", "url", "legal_type", "legal_sectors", "issuing_authority", "issuance_date", "signers"]


def metadata_join_last_wins(spark, folder):
    ids = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("document_id"))
    return A.attach_latest(ids, table(spark, folder, "metadata"), "id", METADATA)


def metadata_group_summary(spark, folder):
    rows = A.attach_latest(_stats(spark, folder), table(spark, folder, "metadata"), "id", METADATA)
    return A.group_summaries(rows, ["legal_type", "legal_sectors", "issuing_authority"])


def _reasons(spark, folder):
    stats = keep(_stats(spark, folder), "stats")
    return S.selection_reasons(stats, S.p95_threshold(stats), S.MAX_SEQ - S.RESERVED)


def selection_reasons(spark, folder):
    return _reasons(spark, folder).select("document_id", "tokens_with_eos", "reason")


def selection_counters(spark, folder):
    return S.selection_counters(_reasons(spark, folder))


def selection_limit_n(spark, folder):
    return S.selection_counters(S.first_selected(_reasons(spark, folder), LIMIT))


def seeded_split(spark, folder):
    return S.seeded_split(table(spark, folder, "documents").select("doc_id"), "doc_id")


def seeded_split_summary(spark, folder):
    rows = _reasons(spark, folder).where("reason = 'selected'").select("document_id", "tokens_with_eos")
    return S.split_summary(S.seeded_split(rows, "document_id"))


def split_summary(spark, folder):
    return S.split_summary(table(spark, folder, "prepared"))


def split_leakage(spark, folder):
    return S.split_leakage(table(spark, folder, "prepared"))


def shared_train_validation(spark, folder):
    return S.shared_ids(table(spark, folder, "prepared"), "train", "validation")


def structure_counts(spark, folder):
    text = T.clean_html(F.col("text"))
    rows = texts(spark, folder, "prepared").select("source_index", text.alias("clean"))
    return rows.select(
        "source_index", T.article_count(F.col("clean")).alias("article_count"), T.chapter_count(F.col("clean")).alias("chapter_count"),
        T.section_count(F.col("clean")).alias("section_count")
    )


def _cleaned(spark, folder, tree):
    return texts(spark, folder, "documents").select(
        "doc_id", T.looks_like_html(F.col("text")).alias("is_html"), T.clean_html(F.col("text"), "html", tree).alias("clean")
    )


def html_clean_regex(spark, folder):
    return _cleaned(spark, folder, False)


def html_clean_tree(spark, folder):
    return _cleaned(spark, folder, True)


def _pages(spark, folder):
    """Each document as a page: a title, a script, and its lines in turn as a paragraph, as a block with a break and as a row of cells."""
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit('<p class="x">'), x, F.lit("</p>"))).when(
        i % 3 == 1, F.concat(F.lit("<DIV>"), x, F.lit("<br/>"), x, F.lit("</DIV>"))
    ).otherwise(F.concat(F.lit("<table><tr><td>"), x, F.lit("</td><th>"), i.cast("string"), F.lit("</th></tr></table>")))
    body = F.array_join(F.transform(F.split("text", "\n"), line), "")
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><script>if (a<b) {}</script>"), body,
        F.lit("<style>p {}</style></body></html>")
    )
    return texts(spark, folder, "documents").select("doc_id", page.alias("page"))


def html_pages_tree(spark, folder):
    return _pages(spark, folder).select(
        "doc_id", F.coalesce(T.looks_like_html(F.col("page")), F.lit(False)).alias("is_html"),
        T.clean_html(F.col("page"), "auto", True).alias("clean")
    )


def html_pages_regex(spark, folder):
    return _pages(spark, folder).select(
        "doc_id", F.coalesce(T.looks_like_html(F.col("page")), F.lit(False)).alias("is_html"),
        T.clean_html(F.col("page"), "auto", False).alias("clean")
    )


def _pairs(spark, folder):
    """Each text as the reference of the next one.

    Scoring takes far longer than the shuffle: the number of partitions is given, or they would be merged.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    nxt = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("prediction"))
    return rows.withColumnRenamed("text", "reference").repartition(n, "doc_id").join(nxt.repartition(n, "doc_id"), "doc_id")


SCORES = ["rouge1_f1", "rouge2_f1", "article_heading_f1", "distinct2", "repeated_4gram_ratio"]


def continuation_scores(spark, folder):
    rows = E.continuation_metrics(_pairs(spark, folder), "reference", "prediction")
    return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in SCORES])


def generation_means(spark, folder):
    rows = E.continuation_metrics(_pairs(spark, folder), "reference", "prediction")
    rows = rows.withColumns({
        "length_ratio": F.length("prediction") / F.greatest(F.lit(1), F.length("reference")), "reference_tokens": T.count_words(F.col("reference")), "generated_tokens": T.count_words(F.col("prediction")),
        "ended_with_eos": F.col("prediction").endswith("."), "generation_seconds": F.length("prediction") / F.lit(64.0),
    })
    out = E.generation_means(
        rows, [], SCORES, ["length_ratio", "reference_tokens", "generated_tokens", "generation_seconds"], {"ended_with_eos": "eos_rate_percent"},
        ["generation_seconds"]
    )
    return out.select("num_generation_documents", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def rouge_l_chunked(spark, folder):
    rows = _pairs(spark, folder).select(
        "doc_id", T.words(T.metric_text(F.col("reference"))).alias("r"), T.words(T.metric_text(F.col("prediction"))).alias("p")
    )
    return rows.select("doc_id", F.round(chunked_lcs_f1_udf()("r", "p"), 6).alias("rougeL_chunked_f1"))


def corpus_ngram_overlaps(spark, folder):
    return E.corpus_overlaps(_pairs(spark, folder), "reference", "prediction")


def corpus_bleu(spark, folder):
    return E.corpus_bleu(E.corpus_overlaps(_pairs(spark, folder), "reference", "prediction", 0, 4)).select(F.round("bleu", 6).alias("bleu"))


def corpus_chrf(spark, folder):
    return E.corpus_chrf(E.corpus_overlaps(
        _pairs(spark, folder), "reference", "prediction", E.CHAR_ORDERS, E.WORD_ORDERS
    )).select(F.round("chrf_plus_plus", 6).alias("chrf_plus_plus"))


def score_windows(spark, folder):
    rows = _stats(spark, folder).select("document_id", F.col("tokens_with_eos").cast("int").alias("t"))
    return rows.select("document_id", F.explode(K.score_windows(F.col("t"), CONTEXT, STRIDE)).alias("w")).select("document_id", "w.*")


def _records(spark, folder):
    """The events as records of scored texts: each type a model, its value a loss, the day a step."""
    e = table(spark, folder, "events").where("value is not null")
    n = F.pmod("event_id", F.lit(7)) + 1
    hit = lambda k: F.least(n, F.pmod("event_id", F.lit(k)))
    return e.select(
        "event_id", F.col("event_type").alias("model"), F.datediff("ts", F.lit("1970-01-01")).alias("step"), F.col("value").alias("nll_sum"),
        n.alias("scored"), hit(3).alias("top1"), hit(5).alias("top5")
    )


def lm_metrics(spark, folder):
    rows = E.token_metrics(_records(spark, folder), ["model"])
    return rows.select("model", "num_documents", "full_document_scored_tokens", *[F.round(c, 6).alias(c) for c in rows.columns[3:]])


def model_comparison(spark, folder):
    rows = keep(E.token_metrics(_records(spark, folder), ["model"]), "lm-metrics")
    of = lambda m: rows.where(F.col("model") == m).drop("model")
    out = E.compare_models(of("view"), of("click"))
    return out.select(
        "metric", *[F.round(c, 6).alias(c) for c in ("base", "finetuned", "delta_finetuned_minus_base", "improvement")], "higher_is_better"
    )


def progressive_loss(spark, folder):
    rows = _records(spark, folder).where("model = 'view'").select("event_id", "nll_sum", "scored")
    return E.progressive(rows, "event_id").select("event_id", F.round("nll_so_far", 6).alias("nll_so_far"), "tokens_so_far")


def loss_perplexities(spark, folder):
    """Mean losses of each model as named metrics, with their perplexities."""
    m = _records(spark, folder).groupBy("model").agg((F.sum("nll_sum") / F.sum("scored")).alias("l"), F.max("nll_sum").alias("most"))
    named = F.array(
        F.struct(F.concat("model", F.lit("_token_nll")).alias("metric"), F.col("l").alias("value")),
        F.struct(F.concat("model", F.lit("_worst_loss")).alias("metric"), F.col("most").alias("value")),
        F.struct(F.concat("model", F.lit("_accuracy")).alias("metric"), F.lit(0.5).alias("value"))
    )
    return E.loss_perplexities(m.select(F.explode(named).alias("x")).select("x.*")).select("metric", F.round("value", 4).alias("value"))


def best_checkpoints(spark, folder):
    """Of each minute as a step, with its mean loss: the steps that are kept."""
    steps = table(spark, folder, "events").groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("step")).agg(F.avg("value").alias("eval_token_nll"))
    return E.best_checkpoints(steps)


def logit_metrics(spark, folder):
    """Each vector as the logits of one position, its label as the next token."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("token", "logit"))
    return E.logit_metrics(rows, ["vec_id"], "token", "logit", "label").select("vec_id", F.round("nll", 5).alias("nll"), "top1", "top5")


BATCH = 4


def pad_and_mask(spark, folder):
    """Batches of the texts in order, each padded to its longest, rounded up to a multiple of eight."""
    lengths = F.transform(T.words(F.lower("text")), lambda w: F.length(w))
    rows = table(spark, folder, "eval_passages").select(F.col("item_id").alias("id"), "text").unionByName(texts(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))
    rows = keep(rows.where("text is not null").select("id", K.append_eos(lengths, F.lit(0)).alias("ids")), "token-ids")
    batch = running_total(
        rows.select("id", F.size("ids").alias("n")), [], ["id"], F.lit(1), "place"
    ).withColumn("batch", F.floor((F.col("place") - 1) / BATCH))
    longest = batch.groupBy("batch").agg(F.max("n").alias("longest"))
    rows = rows.join(batch.select("id", "batch"), "id").join(longest, "batch")
    ids, mask, labels = K.padded(F.col("ids"), 8, F.col("longest"), 0)
    return rows.select(
        "id", "batch", F.array_join(ids, " ").alias("input_ids"), F.array_join(mask, " ").alias("attention_mask"),
        F.array_join(labels, " ").alias("labels")
    )


def training_step_plan(spark, folder):
    rows = table(spark, folder, "prepared").agg(F.count_if(F.col("split") == "train").alias("train_rows"))
    return E.training_steps(rows, batch=2, accumulation=8, epochs=1.5, warmup=0.03, eval_steps=100, logging_steps=10)


def evaluation_candidates(spark, folder):
    return S.evaluation_candidates(texts(spark, folder, "documents"), "doc_id", "text")


def evaluation_selection(spark, folder):
    return S.evaluation_candidates(texts(spark, folder, "documents"), "doc_id", "text", limit=200).select("source_index", "reason")


def evaluation_skips(spark, folder):
    return evaluation_candidates(spark, folder).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


def tokenized_stats(spark, folder):
    rows = table(spark, folder, "prepared")
    per = S.split_summary(rows)
    return per.select("split", "rows", "documents", "tokens", "max_tokens").where("split in ('train', 'validation')")


def data_checks(spark, folder):
    prepared, documents = table(spark, folder, "prepared"), table(spark, folder, "documents")
    stats, given = _stats(spark, folder), table(spark, folder, "document_token_stats")
    ids = given.select("document_id").where("document_id is not null").distinct()
    rules = {
        "empty_text": ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), "over_context": F.col("tokens_with_eos") > S.MAX_SEQ - S.RESERVED, "no_end_mark": F.col("tokens_with_eos") != F.col("tokens_without_eos") + 1,
        "wrong_length": F.length("text") != F.col("num_chars"), "changed_length": F.length(T.clean_html(F.col("text"))) != F.col("num_chars"),
    }
    return C.together(
        C.count_where(prepared, rules), C.count_rows(
            "repeated_source_index", C.repeated(prepared, "source_index")
        ), C.count_rows("repeated_stats", C.repeated(given, "document_id")),
        C.count_rows(
            "documents_without_stats", documents.select(F.col("doc_id").cast("string").alias("document_id")).join(ids, "document_id", "left_anti")
        ),
        C.count_rows(
            "stats_without_document", ids.join(documents.select(F.col("doc_id").cast("string").alias("document_id")), "document_id", "left_anti")
        ),
        C.count_rows(
            "outdated_stats", stats.select("document_id", F.col("article_count").alias("a")).join(given, "document_id").where("a <> article_count")
        ),
        C.count_rows("leaked_train_validation", S.shared_ids(prepared, "train", "validation")),
    )


def _prepared(spark, folder):
    documents = texts(spark, folder, "documents")
    stats = keep(A.document_stats(documents, "doc_id", "text"), "stats")
    threshold = S.p95_threshold(stats)
    rows = keep(P.prepared_rows(documents, "doc_id", "text", stats, threshold, S.MAX_SEQ - S.RESERVED), "prepared")
    return documents, stats, threshold, rows


def prepared_documents(spark, folder):
    """The prepared corpus: selected documents, cleaned, with their split."""
    rows = _prepared(spark, folder)[3]
    return S.seeded_split(rows, "document_id").select(
        "document_id", "chunk_id", "chunk_type", "source_index", "num_chars", "tokens_with_eos", F.md5("text").alias("text_md5"), "split"
    )


def preparation_checks(spark, folder):
    documents, stats, threshold, rows = _prepared(spark, folder)
    return P.preparation_checks(rows, stats, documents, "doc_id", min(threshold, S.MAX_SEQ - S.RESERVED))


def preparation_manifest(spark, folder):
    """The figures of a manifest: those of the selection and of each split, as names and numbers."""
    _, stats, threshold, rows = _prepared(spark, folder)
    counters = S.selection_counters(S.selection_reasons(stats, threshold, S.MAX_SEQ - S.RESERVED)).withColumn("p95_threshold", F.lit(threshold))
    splits = S.split_summary(S.seeded_split(rows, "document_id"))
    figures = lambda df, first, names: df.select(F.explode(F.array(*[F.struct(
        F.concat(first, F.lit(n)).alias("figure"), F.col(n).cast("double").alias("value")
    ) for n in names])).alias("x")).select("x.*")
    return figures(counters, F.lit(""), counters.columns).unionByName(figures(splits, F.concat("split", F.lit(".")), splits.columns[1:]))


def dataset_fingerprint(spark, folder):
    documents = table(spark, folder, "documents")
    return S.fingerprint(documents.select("doc_id", "text", "lang", "source"), ["doc_id", "text", "lang", "source"])


def _event_stream(spark, folder):
    """The events as a stream of files: those of the folder, or the only one."""
    path = f"{folder}/events.parquet"
    events = spark.read.parquet(path)
    folders = any(not f.rstrip("/").endswith("events.parquet") for f in events.inputFiles())
    return spark.readStream.schema(events.schema).parquet(path if folders else f"{folder}/event[s].parquet")


def streaming_metrics(spark, folder):
    sums = M.running_sums(_event_stream(spark, folder).withColumn("scored", F.lit(1)), ["event_type"], "value", "scored")
    return M.loss(M.drain(sums)).select(
        "event_type", "records", F.round("nll_sum", 4).alias("nll_sum"), "scored", F.round("token_nll", 6).alias("token_nll")
    )


def streaming_windows(spark, folder):
    sums = M.windowed(_event_stream(spark, folder).withColumn("scored", F.lit(1)), "ts", "1 day", "1 day", "value", "scored")
    return M.drain(sums).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "records", F.round("nll_sum", 4).alias("nll_sum"))


def _field_values(spark, folder):
    metadata = table(spark, folder, "metadata")
    once = metadata.groupBy("source_index").agg(F.max("legal_sectors").alias("legal_sectors"), F.max("signers").alias("signers"))
    terms = [r[0] for r in table(spark, folder, "sector_terms").select("sector_name").collect()]  # a fixed list of names
    sectors = split_field(once, ["source_index"], "legal_sectors", terms).withColumn("field_name", F.lit("legal_sectors"))
    signers = split_field(once, ["source_index"], "signers").withColumn("field_name", F.lit("signers"))
    return sectors.unionByName(signers)


def p2_found(spark, folder):
    return _field_values(spark, folder).select("source_index", "field_name", "pos", "item_value")


def p2_value_report(spark, folder):
    """Each value of each field: rows that have it, alone or packed, quoted, and flagged."""
    rows = _field_values(spark, folder)
    n = rows.groupBy("source_index", "field_name").agg(F.max("pos").alias("n"))
    rows = rows.join(n, ["source_index", "field_name"])
    return rows.groupBy("field_name", "item_value").agg(
        F.count(F.lit(1)).alias("values"), F.count_if(F.col("n") > 1).alias("packed"), F.count_if("quoted").alias("quoted"),
        F.count("flag").alias("flagged")
    )


QUERIES = {
    f.__name__: f
    for f in (
        document_stats, corpus_summary, group_summary_lang, group_summary_source, group_summary_sets, document_stats_codes, document_stats_given, chunk_plan, recommended_plan, longest_documents, metadata_join_last_wins, metadata_group_summary,
        selection_reasons, selection_counters, selection_limit_n, seeded_split, seeded_split_summary, split_summary, split_leakage, shared_train_validation, structure_counts, html_clean_regex, html_clean_tree, html_pages_regex, html_pages_tree, prepared_documents, preparation_checks, preparation_manifest,
        continuation_scores, generation_means, rouge_l_chunked, corpus_ngram_overlaps, corpus_bleu, corpus_chrf, score_windows, lm_metrics, model_comparison, progressive_loss, loss_perplexities, best_checkpoints, logit_metrics, pad_and_mask, training_step_plan,
        evaluation_candidates, evaluation_selection, evaluation_skips, tokenized_stats, data_checks, dataset_fingerprint, streaming_metrics, streaming_windows, p2_found, p2_value_report,
    )
}
__all__ = ["ORACLE", "QUERIES"]
