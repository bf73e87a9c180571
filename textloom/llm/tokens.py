"""Problem 5: tokens of each text under an existing tokenizer, each distinct piece tokenized once.

The tokenizer's pre-splitting is applied once, to whole batches on arrays of character classes; what
is written down are each document's pieces, by hash, with their frequencies, and the distinct pieces of
each batch.  The distinct pieces of the corpus are tokenized once each; the cached lengths are joined with
the piece frequencies of the documents.  Lengths of frequent pieces, a table of bounded size, are sent to
the tasks; rarer pieces are joined over a shuffle.  Both ways are exact.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep
from .overlap import slices
from .language import Profile
from .pieces import PATTERN, Pieces

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
HEAD = 1 << 18


@lru_cache(maxsize=2)
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a document's pieces (hashes and counts), and a piece of a batch with how often it stands there."""
    names = ["id", "hashes", "counts", "hash", "piece", "n"]
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in slices(texts):
            p, rows = Pieces(texts[a:b]), b - a
            distinct, at, back, n = np.unique(p.hash, return_index=True, return_inverse=True, return_counts=True)
            code = np.sort(p.row * np.int64(distinct.size) + back)  # document and piece
            edge = np.flatnonzero(np.diff(code, prepend=-1))
            count = np.diff(np.append(edge, code.size)).astype(np.uint32)
            code = code[edge]
            hashes = distinct[code % distinct.size] if distinct.size else distinct
            cut = np.searchsorted(code, np.arange(rows + 1) * np.int64(distinct.size)) if distinct.size else np.zeros(rows + 1, np.int64)
            yield pa.RecordBatch.from_arrays([
                ids.slice(a, rows), pa.array(
                    [hashes[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()
                ), pa.array([count[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64()),
            ], names)
            m = distinct.size
            yield pa.RecordBatch.from_arrays([
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(distinct.view(np.int64)), pa.array([p.text(i) for i in at.tolist()], pa.string()), pa.array(n, pa.int64()),
            ], names)


def split_pieces(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The pieces of each text and the distinct pieces of each batch, written down once; see ``piece_lengths`` and ``token_counts``."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), text_column)
    return keep(rows.mapInArrow(_split, "id long, hashes binary, counts binary, hash long, piece string, n long"), "pieces")


def piece_lengths(split: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(hash, piece, n, tokens): the distinct pieces, how often each stands in the texts, its tokens."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(ranks)
        for pdf in batches:
            yield pdf.assign(tokens=[len(x) for x in encoding.encode_ordinary_batch(pdf["piece"].tolist(), num_threads=1)])

    pieces = split.where(F.col("piece").isNotNull()).groupBy("hash", "piece").agg(F.sum("n").alias("n"))
    return pieces.mapInPandas(encode, "hash long, piece string, n long, tokens long")


def _counted(head):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths, languages = head.value
        for batch in batches:
            ids, packed = batch.column(0), batch.column(1).to_pylist()
            sizes = np.fromiter((len(x) // 8 for x in packed), np.int64, len(packed))
            hashes = np.frombuffer(b"".join(packed), np.int64)
            counts = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).astype(np.int64)
            row = np.repeat(np.arange(sizes.size), sizes)
            place = np.searchsorted(known, hashes)
            place[place == known.size] = 0
            found = known[place] == hashes if known.size else np.zeros(hashes.size, bool)
            total = np.bincount(row[found], lengths[place[found]] * counts[found], sizes.size).astype(np.int64)
            lang = languages.best(row, hashes, counts, sizes.size) if languages else [None] * sizes.size
            yield pa.RecordBatch.from_arrays(
                [ids, pa.nulls(sizes.size, pa.int64()), pa.array(total), pa.array(lang, pa.string())], ["id", "hash", "n", "lang"]
            )
            rare = np.flatnonzero(~found)
            if rare.size:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row[rare])), pa.array(hashes[rare]), pa.array(counts[rare]), pa.nulls(rare.size, pa.string())],
                    ["id", "hash", "n", "lang"]
                )

    return count


def token_counts(
    df: DataFrame, id_column: str, text_column: str, ranks: str = RANKS, head: int = HEAD, languages: Profile | None = None
) -> DataFrame:
    """(id, tokens, lang): tokens of each text, without any end mark.  NULL and empty texts have 0.

    ``lang`` is the likeliest of ``languages`` by the text's pieces, NULL where none are given.

    ``id_column`` is a unique whole number.  ``ranks`` is a file of merge ranks that every executor can
    read; it is never copied.  Pieces that make up at least one in ``head`` of all, so at most ``head`` of them, are
    looked up in a table that is sent to the tasks.  Pieces are told apart by a 64-bit hash.
    """
    spark = df.sparkSession
    split = split_pieces(df, id_column, text_column)
    lengths = keep(piece_lengths(split, ranks), "piece-lengths")
    total = lengths.agg(F.sum("n")).first()[0] or 0
    often = lengths.where(F.col("n") * F.lit(head) >= F.lit(total)) if head else lengths.limit(0)
    top = often.select("hash", "tokens").toPandas().sort_values("hash")  # at most head rows, as their frequencies sum up to the total
    known = spark.sparkContext.broadcast((top["hash"].to_numpy(np.int64), top["tokens"].to_numpy(np.int64), languages))
    counted = split.where(F.col("hashes").isNotNull()).select("id", "hashes", "counts").mapInArrow(
        _counted(known), "id long, hash long, n long, lang string"
    )
    counted = keep(counted, "piece-counts")
    rare = counted.where(F.col("hash").isNotNull()).join(lengths.select("hash", "tokens"), "hash").select(
        "id", (F.col("n") * F.col("tokens")).alias("n"), "lang"
    )
    return counted.where(F.col("hash").isNull()).select("id", "n", "lang").unionByName(rare).groupBy("id").agg(
        F.sum("n").alias("tokens"), F.max("lang").alias("lang")
    )


def budget_tokens(counts: DataFrame, given: DataFrame, low: float = 0.6, high: float = 1.6) -> DataFrame:
    """(id, tokens, with_eos, sound): the delivered count where it is sound, else an estimate.

    ``counts`` has (id, tokens, n_chars, part), ``given`` (id, with_eos, without_eos, given_chars).  A delivered
    count is sound if it is one more than the count without the end mark, was taken on a text of the
    same length (where that is told), and lies within ``low`` and ``high`` times the usual ratio to
    ``tokens``.  The usual ratio is the median of its ``part``; estimates use the ratio of the sums over
    sound rows of the part (of all parts, where the part has none; 1 without any).
    """
    rows = counts.join(given, "id", "left")
    whole = (F.col("with_eos") == F.col("without_eos") + 1) & (F.col("with_eos") > 0) & (F.col("given_chars").isNull() | (F.col("given_chars") == F.col("n_chars")))
    rows = rows.withColumn("ratio", F.when(whole & (F.col("tokens") > 0), F.col("with_eos") / (F.col("tokens") + 1)))
    usual = rows.groupBy("part").agg(F.percentile_approx("ratio", 0.5, 10000).alias("usual"))
    rows = keep(rows.join(F.broadcast(usual), rows["part"].eqNullSafe(usual["part"])).drop(usual["part"]), "budget-rows")  # parts: a few languages
    # a text of no tokens has the end mark alone
    sound = F.coalesce(
        F.col("ratio").between(F.col("usual") * low, F.col("usual") * high) | (whole & (F.col("tokens") == 0) & (F.col("with_eos") == 1)),
        F.lit(False)
    )
    rows = rows.withColumn("sound", sound)
    fits = rows.where("sound").groupBy("part").agg(F.sum("with_eos").alias("g"), F.sum(F.col("tokens") + 1).alias("t"))
    every = rows.where("sound").agg(F.sum("with_eos") / F.sum(F.col("tokens") + 1)).first()[0]
    rows = rows.join(F.broadcast(fits), rows["part"].eqNullSafe(fits["part"]), "left").drop(fits["part"])
    ratio = F.coalesce(F.col("g") / F.col("t"), F.lit(every), F.lit(1.0))
    estimate = F.when(F.col("tokens") == 0, 1).otherwise(F.greatest(F.lit(1), F.round((F.col("tokens") + 1) * ratio)))
    return rows.select("id", "tokens", F.when(F.col("sound"), F.col("with_eos")).otherwise(estimate).cast("long").alias("with_eos"), "sound")


def _composed(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else unicodedata.normalize("NFKC", v) for v in values])


def spelled_alike(column: Column) -> Column:
    """Key under which spellings of a name that differ in case, spacing or Unicode form fall together; blank: NULL."""
    key = F.regexp_replace(F.lower(F.pandas_udf(_composed, "string")(column)), r"(?U)[\s_\-]+", " ")
    key = F.trim(F.regexp_replace(key, "[\u200b\ufeff]", ""))
    return F.when(key != "", key)


def written_out(names: DataFrame, column: str) -> DataFrame:
    """(short, long): abbreviations among the distinct values of ``column``, and the commonest name with those initials.

    An abbreviation is a single word of two or three letters; initials are the first letters of the words.
    """
    counted = names.where(F.col(column).isNotNull()).groupBy(column).count()
    long = counted.where(F.instr(column, " ") > 0).withColumn(
        "short", F.array_join(F.transform(F.split(column, " "), lambda w: F.substring(w, 1, 1)), "")
    )
    long = long.groupBy("short").agg(F.max_by(column, F.struct("count", column)).alias("long"))
    return counted.where(F.col(column).rlike(r"^\p{L}{2,3}$")).select(F.col(column).alias("short")).join(long, "short")
