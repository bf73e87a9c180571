"""Tokenizers as column expressions: words by default, or any function from texts to ids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import tokens as K


@dataclass(frozen=True)
class WordTokenizer:
    """Letters, digits and underscores in lower case; the end mark is not a word."""

    name: str = "words"
    eos: str | None = "</s>"

    def tokens(self, text: Column) -> Column:
        return T.words(F.lower(text))

    def counts(self, text: Column, add_eos: bool = True) -> tuple[Column, Column]:
        """Tokens without and with the end mark, without building them."""
        n = T.count_words(text)
        return n, n + 1 if add_eos and self.eos is not None else n

    def fingerprint(self) -> str:
        return fingerprint(self.name, {"pattern": T.WORD, "eos": self.eos})


@dataclass(frozen=True)
class BatchTokenizer:
    """Any tokenizer: ``load`` is called once in each task and gives a function from texts to lists of ids.

    ``settings`` is what tells one tokenizer from another of the same name (files, vocabulary size).
    """

    name: str
    load: Callable[[], Callable[[list[str]], list[list[int]]]]
    eos: int | None = None
    settings: dict = field(default_factory=dict, hash=False)

    def tokens(self, text: Column) -> Column:
        load = self.load

        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = load()
            for batch in batches:
                yield pd.Series(encoder(batch.fillna("").tolist()), index=batch.index, dtype=object)

        return F.pandas_udf(encode, "array<int>")(text)

    def counts(self, text: Column, add_eos: bool = True) -> tuple[Column, Column]:
        ids = self.tokens(text)
        return F.size(ids).cast("long"), K.count_with_eos(ids, F.lit(self.eos).cast("int") if add_eos else None)

    def fingerprint(self) -> str:
        return fingerprint(self.name, {**self.settings, "eos": self.eos})


def fingerprint(name: str, settings: dict) -> str:
    """Tells whether two runs used the same tokenizer."""
    return hashlib.sha256(json.dumps({"name": name, **settings}, sort_keys=True, ensure_ascii=True).encode()).hexdigest()
