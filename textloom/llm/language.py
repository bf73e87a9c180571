"""Language of texts that are delivered without one, by naive Bayes on the tokenizer's pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlap import slices
from .pieces import Pieces

SAMPLE, LANGUAGES = 4_000, 20


class Profile:
    """Log frequencies of pieces in each language, the commonest language first."""

    def __init__(self, counts: pd.DataFrame):
        total = counts.groupby("lang")["n"].sum().sort_values(ascending=False)
        self.names: list[str] = list(total.index[:LANGUAGES])
        table = counts[counts["lang"].isin(self.names)].pivot_table(
            index="hash", columns="lang", values="n", aggfunc="sum", fill_value=0
        ).reindex(columns=self.names).sort_index()
        self.hashes = table.index.to_numpy(np.int64)
        seen = table.to_numpy(float) + 0.5
        self.logs = np.log(seen / seen.sum(axis=0)) if self.names else np.zeros((0, 0))

    def best(self, row: np.ndarray, hashes: np.ndarray, counts: np.ndarray, rows: int) -> list[str | None]:
        """The likeliest language of each row of pieces; rows without a known piece have the commonest, no languages give None."""
        if not self.names:
            return [None] * rows
        place = np.searchsorted(self.hashes, hashes)
        place[place == self.hashes.size] = 0
        hit = np.flatnonzero(self.hashes[place] == hashes)
        sums = np.stack([np.bincount(row[hit], self.logs[place[hit], k] * counts[hit], rows) for k in range(len(self.names))])
        return [self.names[k] for k in sums.argmax(axis=0)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column("lang").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        for a, b in slices(texts):
            p = Pieces(texts[a:b])
            of = langs[a:b][p.row]
            for lang in np.unique(of):
                h, n = np.unique(p.hash[of == lang], return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * h.size, pa.string()), "hash": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())
                })


def profile(df: DataFrame, id_column: str, text_column: str, lang: Column, sample: int = SAMPLE) -> Profile:
    """Learnt from the texts that have a language: about ``sample`` of them, chosen by a hash of the id.

    The bound makes what is sent to the driver, and from there to the tasks, the vocabulary of ``sample`` texts.
    """
    rows = df.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), lang.alias("lang"), F.col(text_column).alias("text")
    ).where("lang is not null")
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1)))).select("lang", "text")
    return Profile(chosen.mapInArrow(_counted, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n")).toPandas())


def language(given: Column, text: Column, known: Profile) -> Column:
    """``given``, or where it is NULL the likeliest language of the text; only such texts reach Python."""

    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.tolist()
            out: list = [None] * len(values)
            there = [i for i, t in enumerate(values) if t is not None]
            for a, b in slices([values[i] for i in there]):
                p = Pieces([values[i] for i in there[a:b]])
                for i, name in zip(there[a:b], known.best(p.row, p.hash.view(np.int64), np.ones(p.row.size), b - a)):
                    out[i] = name
            yield pd.Series(out, dtype=object)

    return F.coalesce(given, F.pandas_udf(guess, "string")(F.when(given.isNull(), text)))
