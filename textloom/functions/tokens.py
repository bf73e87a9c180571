"""Token arrays: end marks, chunks, windows, padding and chunk estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_with_eos(ids: Column, eos: Column | None) -> Column:
    """Tokens with one end mark: one more than there are, unless they end in it or there is none."""
    n = F.size(ids).cast("long")
    return n if eos is None else n + F.when(F.try_element_at(ids, F.lit(-1)).eqNullSafe(eos) | eos.isNull(), 0).otherwise(1)


def append_eos(ids: Column, eos: Column) -> Column:
    """``ids`` ending in exactly one ``eos``."""
    return F.when(F.try_element_at(ids, F.lit(-1)).eqNullSafe(eos), ids).otherwise(F.concat(ids, F.array(eos)))


def truncated(ids: Column, most: int) -> Column:
    """``ids`` with room for an end mark in ``most``, but one of them at least; 0 keeps all."""
    return F.slice(ids, 1, max(1, most - 1)) if most else ids


def record_id(given: Column, index: Column) -> Column:
    """The id as text, or where it is missing the row's number."""
    return F.coalesce(given.cast("string"), index.cast("string"))


def chunk_target(capacity: Column, utilization: float) -> Column:
    return F.greatest(F.lit(1), F.least(F.floor(capacity * F.lit(utilization)).cast("long"), capacity.cast("long")))


def estimated_chunks(n: Column, target: Column, overlap: int) -> Column:
    """1 for texts within ``target``, else 1 and a chunk for each begun step; a step of none is an error only then."""
    step = target - F.lit(overlap)
    more = F.when(step > 0, 1 + F.ceil((n - target) / step)).otherwise(F.raise_error(F.lit("target must exceed overlap")).cast("long"))
    return F.when(n <= target, F.lit(1).cast("long")).otherwise(more.cast("long"))


def pieces(values: Column, size: int) -> Column:
    """``values`` cut into arrays of ``size``; none of an empty array."""
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(size)).cast("int"))
    return F.when(
        F.size(values) > 0, F.transform(starts, lambda i: F.slice(values, i * size + 1, size))
    ).otherwise(F.array().cast("array<array<string>>"))


def ngrams(values: Column, n: int) -> Column:
    """Every ``n`` consecutive values, joined by a character that isn't part of words."""
    starts = F.sequence(F.lit(1), F.size(values) - (n - 1))
    return F.when(
        F.size(values) >= n, F.transform(starts, lambda i: F.array_join(F.slice(values, i, n), "\u0001"))
    ).otherwise(F.array().cast("array<string>"))


def score_windows(total: Column, context: int, stride: int) -> Column:
    """Windows that score a text of ``total`` tokens: structs of number, begin, end, scored from and to.

    The first window ends at the context length, each next one ``stride`` later; a token is scored where
    it is first seen and has a token before it in the window.  With a stride as long as the context one
    token at each full window's edge stays unscored.
    """
    more = F.when(total > context, F.ceil((total - context) / F.lit(stride))).otherwise(0).cast("int")

    def window(i: Column) -> Column:
        end = F.least(F.lit(context) + i * stride, total)
        last = F.when(i == 0, F.lit(0)).otherwise(F.least(F.lit(context) + (i - 1) * stride, total))
        begin = F.greatest(F.lit(0), end - context)
        return F.struct(
            i.cast("long").alias("window"), begin.cast("long").alias("begin"), end.cast("long").alias("end"),
            F.greatest(last, begin + 1).cast("long").alias("score_from")
        )

    return F.when(total > 0, F.transform(F.sequence(F.lit(0), more), window))


def padded(ids: Column, multiple: int, longest: Column, pad: int) -> tuple[Column, Column, Column]:
    """Ids, attention mask and labels of one length, the least multiple that holds ``longest``; padding isn't a label."""
    size = (F.ceil(longest / F.lit(multiple)) * multiple).cast("int")
    free = size - F.size(ids)
    filled = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), free))
    return filled(ids, pad), filled(F.transform(ids, lambda _: F.lit(1)), 0), filled(ids, -100)
