"""Several values packed in one field: one row per value, parsed by a small expression grammar.

The grammar, with ordered alternatives (the first that matches wins, a failed one backtracks)::

    field   <- blank (array / list) blank end
    array   <- '[' (string (',' string)*)? ']'        JSON strings with escapes
    list    <- part (separator part)*
    part    <- mark* (quoted / term / bare)?          an empty part is skipped
    mark    <- '(' digits ')' / digits [.)] / bullet  at the start of a part only
    quoted  <- open (escaped / char)* close           followed by a separator, a mark or the end
    term    <- a name of the vocabulary               followed by the same
    bare    <- (bracketed / nickname / char)+         up to a separator outside brackets

A quote that is never closed, or that is followed by other characters, makes ``quoted`` fail; the
text is then taken as ``bare`` and flagged.  Likewise ``array`` falls back to ``list``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators, quotes and bullets.
SEPARATOR = re.compile(r"\s*[;；,|•\t\r\n]\s*|\s*/\s*|\s+(?:và|and|-|–|&)\s+")
NUMBERED = re.compile(r"\s+(?=\(\d{1,3}\)\s|\d{1,3}[.)]\s)")
MARK = re.compile(r"\s*(?:\(\d{1,3}\)|\d{1,3}[.)](?=\s)|[-–+•*·](?=\s))\s*")
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’", "„": "“"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
BLANK = re.compile("[\\s\u200b\ufeff]*")

VALUE = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("item_value", T.StringType()), T.StructField("quoted", T.BooleanType()),
    T.StructField("flag", T.StringType())
]))


class FieldGrammar:
    """Parses one field; ``vocabulary`` holds names that may contain separators."""

    def __init__(self, vocabulary: list[str] | None = None):
        names = sorted({v.strip() for v in vocabulary or [] if v and v.strip()}, key=lambda v: (-len(v), v))
        self.term = re.compile("|".join(map(re.escape, names)), re.I) if names else None

    def parse(self, text: str | None) -> list[tuple[int, str, bool, str | None]]:
        if text is None or not text.strip():
            return []
        found = self._array(text)
        if found is None:
            found = self._list(text)
        return [(i, *v) for i, v in enumerate((v for v in found if v[0]), 1)]

    def _array(self, text: str) -> list | None:
        text = text.strip()
        if not (text.startswith("[") and text.endswith("]")):
            return None
        try:
            values = json.loads(text)
        except ValueError:
            return None
        if not all(isinstance(v, str) for v in values):
            return None
        return [(v.strip(), True, None) for v in values]

    def _list(self, text: str) -> list:
        out, at = [], 0
        while at < len(text):
            if (m := SEPARATOR.match(text, at)) and m.end() > at:
                at = m.end()
                continue
            at = BLANK.match(text, at).end()
            while (m := MARK.match(text, at)) and m.end() > at:
                at = m.end()
            if at >= len(text) or SEPARATOR.match(text, at):
                continue
            for alternative in (self._quoted, self._term, self._bare):
                if got := alternative(text, at):
                    value, at = got
                    out.append(value)
                    break
        return out

    def _stop(self, text: str, at: int, after_quote: bool = False) -> bool:
        """A value may end here: at the end, a separator, a mark, or, after a closed quote, another quote."""
        rest = BLANK.match(text, at).end()
        if rest >= len(text) or SEPARATOR.match(text, at) or NUMBERED.match(text, at):
            return True
        return after_quote and rest > at and text[rest] in QUOTES

    def _quoted(self, text: str, at: int):
        close = QUOTES.get(text[at])
        if close is None:
            return None
        chars, i = [], at + 1
        while i < len(text):
            c = text[i]
            if c == "\\" and i + 1 < len(text) and text[i + 1] in (close, "\\", text[at]):
                chars.append(text[i + 1])
                i += 2
            elif c == close and text[i + 1 : i + 2] == close and close in "\"'":
                chars.append(c)
                i += 2
            elif c == close and self._stop(text, i + 1, True):
                value = "".join(chars).strip()
                return (value, True, None), i + 1
            else:
                chars.append(c)
                i += 1
        return None

    def _term(self, text: str, at: int):
        if self.term is None:
            return None
        m = self.term.match(text, at)
        return ((m[0], False, None), m.end()) if m and self._stop(text, m.end()) else None

    def _bare(self, text: str, at: int):
        i, flag = at, None
        while i < len(text):
            c = text[i]
            if i > at and (SEPARATOR.match(text, i) or NUMBERED.match(text, i)):
                break
            close = BRACKETS.get(c) or (QUOTES.get(c) if i == at or text[i - 1].isspace() else None)
            if close:
                end = text.find(close, i + 1)
                if end > 0:
                    i = end + 1
                    continue
                flag = "unclosed"
            i += 1
        value = text[at:i].strip()
        if self.term is not None:
            flag = flag or "unknown"
        return (value, False, flag), max(i, at + 1)


def split_field(df: DataFrame, key: list[str], column: str, vocabulary: list[str] | None = None) -> DataFrame:
    """One row per value of ``column``: the key, ``pos`` from 1, ``item_value``, ``quoted``, ``flag``.

    ``vocabulary`` is a small, fixed list of names that may hold separators; values outside it are
    kept and flagged ``unknown``.  NULL and blank fields, and fields of separators alone, give no
    row.  Repeated values keep their own positions.  Only the key and the column are read, so other
    columns may have any names.  ``flag`` is NULL for a clean value, ``unclosed`` for a quote or
    bracket without its end.
    """
    grammar_of = list(vocabulary) if vocabulary else None

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = FieldGrammar(grammar_of)
        for batch in batches:
            yield pd.Series([grammar.parse(x) for x in batch])

    values = F.pandas_udf(parse, VALUE)
    rows = df.select(*key, F.col(column).alias("_packed")).where(F.col("_packed").rlike(r"\S"))
    return rows.select(*key, F.explode(values("_packed")).alias("_v")).select(*key, "_v.*")
