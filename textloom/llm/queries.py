"""The queries of the subpackage's problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import keep, table, texts
from .difficulty import reading_levels
from .language import language, profile
from .leaks import find_leaks
from .overlap import overlap_classes, overlap_rows, text_classes
from .mixing import mix_sources
from .packing import packed, packing_report
from .tokens import budget_tokens, piece_lengths, spelled_alike, split_pieces, token_counts, written_out
from .splits import chunk_document_key, document_key, group_splits, separated


def _overlap(spark: SparkSession, folder: str):
    prepared = texts(spark, folder, "prepared")
    return prepared, *overlap_classes(prepared, "source_index", "text", F.col("split") == "train")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    _, members, pairs = _overlap(spark, folder)
    rows = overlap_rows(members, pairs)
    return rows.select(F.least("id_train", "id_eval").alias("source_index_a"), F.greatest("id_train", "id_eval").alias("source_index_b"))



def _folded_source(column: str = "source"):
    """Spellings of a source fall together."""
    return F.regexp_replace(spelled_alike(F.col(column)), " ", "-")


def _covered(spark: SparkSession, folder: str) -> DataFrame:
    """Each record outside train: its split and source, and of its nearest train record the similarity, the share covered and whose copy it is."""
    prepared, members, pairs = _overlap(spark, folder)
    best = pairs.groupBy("class_eval").agg(
        F.max("similarity").alias("similarity"), F.max(F.col("common") / F.col("n_eval")).alias("coverage"), F.count(F.lit(1)).alias("train_texts"),
        F.max_by("class_train", F.struct("similarity", -F.col("class_train"))).alias("nearest")
    )
    hit = members.where("not in_train").join(best, F.col("class") == F.col("class_eval")).select(
        "id", "similarity", "coverage", "train_texts", "nearest"
    )
    rows = prepared.where(~F.coalesce(F.col("split") == "train", F.lit(False))).select(
        "source_index", "document_id", "split", _folded_source().alias("source")
    )
    return rows.join(hit, F.col("source_index") == F.col("id"), "left").drop("id")


def p1_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation split and source: records, overlapping records, copies and mean best coverage."""
    return _covered(spark, folder).groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count("similarity").alias("overlapping"), F.count_if(F.col("similarity") == 1).alias("copies"),
        F.avg("coverage").alias("mean_coverage")
    )


def p1_record_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per overlapping record: the share of its words that a train record covers, and the nearest train text."""
    return _covered(spark, folder).where("similarity is not null").select(
        "source_index", "document_id", "split", "source", "coverage", "similarity", "train_texts", F.col("nearest").alias("class_train")
    )


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of class representatives that overlap; p1_members has the rows of each class."""
    prepared, _, pairs = _overlap(spark, folder)
    names = prepared.select(F.col("source_index"), "document_id")
    a = names.select(F.col("source_index").alias("class_train"), F.col("document_id").alias("document_id_train"))
    b = names.select(F.col("source_index").alias("class_eval"), F.col("document_id").alias("document_id_eval"))
    return pairs.join(a, "class_train").join(b, "class_eval").select(
        "class_train", "class_eval", "document_id_train", "document_id_eval", "common", "similarity",
        (F.col("common") / F.col("n_eval")).alias("coverage_eval")
    )


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal texts of each record of enough words."""
    members = text_classes(texts(spark, folder, "prepared"), "source_index", "text", F.col("split") == "train")[2]
    return members.select(F.col("id").alias("source_index"), "class", "n_words", "in_train")


def _keys() -> list:
    return [document_key(F.col("document_id")), chunk_document_key(F.col("chunk_id"))]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of the entities that the new split keeps together, the records of those that the delivered one separates."""
    prepared = table(spark, folder, "prepared")
    new = group_splits(prepared, "source_index", _keys(), table(spark, folder, "split_targets"), tag=False)
    return separated(new.join(prepared.select(F.col("source_index").alias("id"), "split"), "id")).select(F.col("id").alias("source_index"))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The new split of each record."""
    prepared = table(spark, folder, "prepared")
    return group_splits(
        prepared, "source_index", _keys(), table(spark, folder, "split_targets"), tag=False
    ).select(F.col("id").alias("source_index"), "entity", "new_split")


def p4_split_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records, documents and shares by new split, beside the target."""
    new = keep(p4_splits(spark, folder), "splits")
    n = new.count()
    got = new.groupBy(F.col("new_split").alias("split")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("entity").alias("documents"))
    return table(spark, folder, "split_targets").join(got, "split", "left").select(
        "split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("documents", F.lit(0)).alias("documents"),
        (F.coalesce("records", F.lit(0)) / F.lit(max(n, 1))).alias("share")
    )


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(texts(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_passages"), "item_id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("item_id", "doc_id")


def p6_leak_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per passage: documents that hold it, wholly (nine tenths) or in part."""
    got = _leaks(spark, folder).withColumn("share", F.col("covered") / F.col("n_words"))
    per = got.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("share") >= 0.9).alias("whole"), F.max("share").alias("best_share")
    )
    items = table(spark, folder, "eval_passages").select("item_id", "subject", "split")
    return items.join(per, "item_id", "left").select(
        "item_id", "subject", "split", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("whole", F.lit(0)).alias("whole"),
        "best_share"
    )


def _given_language():
    """The delivered language in its short form, NULL where that is missing or blank."""
    low = F.substring(F.lower(F.trim("lang")), 1, 2)
    return F.when(low.rlike("^[a-z]{2}$"), low)


def _languages(spark: SparkSession, folder: str):
    return profile(table(spark, folder, "documents"), "doc_id", "text", _given_language())


def _latest_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The version of each id in force: the last source_index."""
    rows = table(spark, folder, "metadata").where(F.col("id").isNotNull())
    return rows.groupBy("id").agg(F.max_by(F.struct("legal_type", "issuing_authority"), "source_index").alias("m")).select("id", "m.*")


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of document_token_stats, which has some twice."""
    rows = table(spark, folder, "document_token_stats").where(F.col("document_id").isNotNull())
    last = F.max(F.struct("tokens_with_eos", "tokens_without_eos", "num_chars", "legal_type", "issuing_authority"))
    return rows.groupBy(F.col("document_id").cast("long").alias("id")).agg(last.alias("s")).select("id", "s.*")


def _document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    documents = texts(spark, folder, "documents")
    more = documents.select(F.col("doc_id").alias("id"), F.length("text").alias("n_chars"), _given_language().alias("given"))
    counts = token_counts(
        documents, "doc_id", "text", languages=_languages(spark, folder)
    ).join(more, "id").withColumn("part", F.coalesce("given", "lang")).drop("given", "lang")
    given = _stats(spark, folder).select(
        "id", F.col("tokens_with_eos").alias("with_eos"), F.col("tokens_without_eos").alias("without_eos"), F.col("num_chars").alias("given_chars")
    )
    return budget_tokens(counts, given)


def p5_document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each text: under the public tokenizer, and as delivered where sound or estimated."""
    rows = _document_tokens(spark, folder)
    return rows.select(F.col("id").alias("doc_id"), "tokens", F.col("with_eos").alias("tokens_with_eos"), F.col("sound").alias("delivered"))


def p5_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens by source, language, legal type and issuing authority, and in all."""
    documents = table(spark, folder, "documents")
    labels = documents.select(F.col("doc_id").alias("id"), "source", "lang").join(
        _stats(spark, folder).select("id", F.col("legal_type").alias("t1"), F.col("issuing_authority").alias("a1")), "id", "left"
    )
    meta = _latest_metadata(spark, folder).select(
        F.expr("try_cast(id as long)").alias("id"), F.col("legal_type").alias("t2"), F.col("issuing_authority").alias("a2")
    )
    labels = labels.join(meta.where("id is not null"), "id", "left")
    first = lambda a, b: F.coalesce(F.when(F.trim(a) != "", F.col(a)), F.col(b))
    labels = labels.select(
        "id", _folded_source().alias("source"), F.substring(spelled_alike(F.col("lang")), 1, 2).alias("lang"),
        spelled_alike(first("t1", "t2")).alias("legal_type"), spelled_alike(first("a1", "a2")).alias("issuing_authority")
    )
    labels = keep(labels, "budget-labels")
    types = written_out(labels, "legal_type")
    labels = labels.join(
        types, F.col("legal_type") == F.col("short"), "left"
    ).withColumn("legal_type", F.coalesce("long", "legal_type")).drop("short", "long")
    rows = _document_tokens(spark, folder).join(labels, "id")
    slices_ = ["source", "lang", "legal_type", "issuing_authority"]
    named = F.explode(F.array(
        *[F.struct(F.lit(c).alias("slice"), F.coalesce(c, F.lit("unknown")).alias("value")) for c in slices_],
        F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value"))
    ))
    return rows.select(named.alias("k"), "tokens", "with_eos", "sound").groupBy("k.slice", "k.value").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("with_eos").alias("tokens_with_eos"), F.count_if("sound").alias("delivered"))


def _source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each different text of documents once, with its source and its tokens: under its least id of a source in mix_targets, or else its least id."""
    documents = texts(spark, folder, "documents").where(F.col("text").rlike(r"\S"))
    targets = table(spark, folder, "mix_targets").where("target_share > 0 and max_repeats > 0").select(F.col("source").alias("target")).where("target is not null").distinct()
    named = documents.select("doc_id", F.unhex(F.sha2("text", 256)).alias("same"), _folded_source().alias("source"))
    named = named.join(F.broadcast(targets), F.col("source") == F.col("target"), "left")  # a few sources
    once = named.groupBy("same").agg(F.min(F.struct(F.col("target").isNull().alias("other"), "doc_id", "source")).alias("d"))
    once = keep(once.select(F.col("d.doc_id").alias("id"), F.col("d.source").alias("source")), "mix-texts")
    counts = token_counts(documents, "doc_id", "text")
    return once.join(counts.select("id", "tokens"), "id")


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How often each text is used, of those used at all."""
    return mix_sources(
        _source_texts(spark, folder), table(spark, folder, "mix_targets")
    )[0].select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p7_mixture_report(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each target source: wanted and reached."""
    return mix_sources(_source_texts(spark, folder), table(spark, folder, "mix_targets"))[1]


def _train_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(id, length) of the train records: tokens_with_eos, or an estimate from the text where that is missing or wrong."""
    train = texts(spark, folder, "prepared").where("split = 'train'")
    counts = token_counts(train, "source_index", "text", languages=_languages(spark, folder)).withColumnRenamed("lang", "part")
    counts = counts.join(train.select(F.col("source_index").alias("id"), F.length("text").alias("n_chars")), "id")
    given = train.select(
        F.col("source_index").alias("id"), F.col("tokens_with_eos").alias("with_eos"), F.col("tokens_without_eos").alias("without_eos"),
        F.col("num_chars").alias("given_chars")
    )
    return budget_tokens(counts, given).select("id", F.col("with_eos").alias("length"))


def _capacities(spark: SparkSession, folder: str) -> list[int]:
    plans = table(spark, folder, "context_plans").select((F.col("max_seq_length") - F.col("reserved_tokens")).alias("c")).distinct()
    return sorted(r["c"] for r in plans.where("c > 0").collect())  # a few plans


def p3_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The sequence each train record goes to, for each capacity; long records in pieces."""
    out = packed(_train_lengths(spark, folder), _capacities(spark, folder))
    return out.select("capacity", "sequence", F.col("id").alias("source_index"), "piece", "length")


def p3_packing_report(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences and the share of unused room, for each capacity."""
    return packing_report(p3_sequences(spark, folder))


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: records packed, sequences over it, records within it that were divided, and records not whole."""
    lengths = keep(_train_lengths(spark, folder), "train-lengths")
    rows = keep(packed(lengths, _capacities(spark, folder)), "packed")
    filled = rows.groupBy("capacity", "sequence").agg(F.sum("length").alias("filled")).groupBy("capacity").agg(F.count_if(F.col("filled") > F.col("capacity")).alias("overfull_sequences"))
    whole = rows.groupBy("capacity", "id").agg(F.sum("length").alias("got"), F.count(F.lit(1)).alias("n")).join(lengths, "id")
    per = whole.groupBy("capacity").agg(
        F.count(F.lit(1)).alias("records"), F.count_if((F.col("n") > 1) & (F.col("length") <= F.col("capacity"))).alias("needlessly_divided"),
        F.count_if(F.col("got") != F.col("length")).alias("not_whole")
    )
    return per.join(filled, "capacity").select(
        F.col("capacity").cast("long").alias("capacity"), "records", "overfull_sequences", "needlessly_divided", "not_whole"
    )


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a new split, documents that it separates, and splits off their share by more than a hundredth."""
    new = keep(p4_splits(spark, folder), "splits")
    n = max(new.count(), 1)
    apart = new.groupBy("entity").agg(F.countDistinct("new_split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("separated_documents"))
    got = new.groupBy(F.col("new_split").alias("split")).agg((F.count(F.lit(1)) / F.lit(n)).alias("share"))
    goals = table(spark, folder, "split_targets").join(got, "split", "left")
    off = goals.agg(F.count_if(F.abs(F.coalesce("share", F.lit(0.0)) - F.col("target_share")) > 0.01).alias("splits_off_their_share"))
    return new.agg(F.countDistinct("source_index").alias("records")).join(F.broadcast(apart)).join(F.broadcast(off))  # a row each


def p5_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts counted, and by how much the sum of their tokens differs from that over all pieces and their frequencies."""
    documents = texts(spark, folder, "documents")
    pieces = piece_lengths(split_pieces(documents, "doc_id", "text")).agg(F.coalesce(F.sum(F.col("n") * F.col("tokens")), F.lit(0)).alias("by_piece"))
    counted = token_counts(documents, "doc_id", "text").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("by_text"))
    return counted.join(F.broadcast(pieces)).select("texts", (F.col("by_text") - F.col("by_piece")).alias("difference"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Target sources, those whose tokens miss what they should have by more than one text, and those with a text used too often."""
    report = p7_mixture_report(spark, folder)
    return report.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.abs(F.col("mixed_tokens") - F.col("rate") * F.col("available")) > F.col("longest")).alias("off_their_share"),
        F.count_if(F.col("most_copies") > F.col("max_repeats")).alias("used_too_often")
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    levels = reading_levels(
        texts(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "reading_labels"), "reading_level",
        language(_given_language(), F.col("text"), _languages(spark, folder))
    )
    return levels.select(F.col("id").alias("doc_id"), "reading_level")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_overlap_report, p1_record_coverage, p1_pairs, p1_members, p3_sequences, p3_packing_report, p3_checks, p4_found, p4_splits, p4_split_report, p4_checks,
        p5_document_tokens, p5_token_budget, p5_checks, p6_found, p6_leak_report, p7_mixture, p7_mixture_report, p7_checks, p8_found,
    )
}
_KEY = r"""CASE WHEN regexp_matches({x}, {p}) THEN concat_ws('-', regexp_extract({x}, {p}, 1), regexp_extract({x}, {p}, 2), regexp_extract({x}, {p}, 3)) || regexp_extract({x}, {p}, 4) END"""
_FORM = r"'(?:^|[^a-z0-9])([a-z]{2})[^a-z0-9]*((?:19|20)[0-9]{2})[^a-z0-9]*0*([0-9]+)([a-z]?)(?:[^a-z0-9]|$)'"
_KEYED = f"keyed AS (SELECT source_index, split, coalesce({_KEY.format(x='lower(document_id)', p=_FORM)}, {_KEY.format(x='lower(chunk_id)', p=_FORM)}, source_index::VARCHAR) AS k FROM prepared)"
#: Where SQL can say it; of checks, what must come out.
ORACLE: dict[str, str] = {
    "p3_checks": "SELECT max_seq_length - reserved_tokens AS capacity, (SELECT count(*) FROM prepared WHERE split = 'train') AS records, 0 AS overfull_sequences, 0 AS needlessly_divided, 0 AS not_whole FROM context_plans",
    "p4_checks": "SELECT count(*) AS records, 0 AS separated_documents, 0 AS splits_off_their_share FROM prepared",
    "p5_checks": "SELECT count(*) AS texts, 0 AS difference FROM documents",
    "p7_checks": "SELECT count(*) AS sources, 0 AS off_their_share, 0 AS used_too_often FROM mix_targets",
    "p4_found": f"WITH {_KEYED} SELECT source_index FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(DISTINCT coalesce(split, '')) > 1)",
}
