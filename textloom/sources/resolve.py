"""Which column, split or checkpoint a run reads: decided on names, before any row is read."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

#: Fixed value: columns that may hold the content, the first that is there counts.
CONTENT_COLUMNS = ("content_html", "content", "text")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise KeyError(f"missing columns: {missing}; there are {df.columns}")
    return df


def content_column(df: DataFrame, wanted: str | None = None) -> str:
    """The column of the content: the wanted one or an error, else the first of the usual ones."""
    if wanted is not None:
        require_columns(df, [wanted])
        return wanted
    for name in CONTENT_COLUMNS:
        if name in df.columns:
            return name
    raise KeyError(f"none of {CONTENT_COLUMNS} in {df.columns}")


def pick_split(names: Iterable[str], wanted: str = "data") -> str:
    """``wanted``, else ``train``, else the only one there is."""
    have = list(names)
    for name in (wanted, "train"):
        if name in have:
            return name
    if len(have) == 1:
        return have[0]
    raise KeyError(f"which of {sorted(have)}?")


def require_splits(df: DataFrame, names: Iterable[str], columns: Iterable[str] = ("text",), split: str = "split") -> DataFrame:
    """``df`` if it has the columns, and rows of each of the splits; an error names what is missing."""
    require_columns(df, [*columns, split])
    there = {r[0] for r in df.groupBy(split).count().collect()}  # a row for each split
    if missing := sorted(set(names) - there):
        raise ValueError(f"no rows of the splits {missing}; there are {sorted(map(str, there))}")
    return df


def analysis_paths(
    folder: str, stats: str | None = None, summary: str | None = None, threshold: float | None = None, exists: Callable[[str], bool] = os.path.exists
) -> tuple[str, str | None]:
    """Where the statistics and the summary of an analysis are; the summary may be missing where the threshold is given."""
    stats, summary = stats or f"{folder}/document_token_stats.csv", summary or f"{folder}/summary.json"
    if not exists(stats):
        raise FileNotFoundError(stats)
    if exists(summary):
        return stats, summary
    if threshold is None:
        raise FileNotFoundError(summary)
    return stats, None


def require_markdown(summary: dict) -> dict:
    """``summary`` if its analysis left tags alone, as the preparation does: else lengths wouldn't agree."""
    if summary.get("content_format", "markdown") != "markdown":
        raise ValueError(f"analysis was made in {summary['content_format']} mode; repeat it in markdown mode")
    return summary


def newest_checkpoint(paths: Iterable[str]) -> str | None:
    """The path ``checkpoint-N`` with the greatest number; others don't count."""
    numbered = [(int(m[1]), p) for p in paths if (m := re.search(r"(?:^|/)checkpoint-(\d+)/?$", p))]
    return max(numbered)[1] if numbered else None
