"""Lines, excerpts and previews, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT_LINES, PREVIEW_LINES = 80, 20


def lines(text: Column) -> Column:
    """Lines of a text; a line feed at its end opens no further one, and an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1))


def excerpt(text: Column, limit: int = EXCERPT_LINES) -> Column:
    """At most `limit` lines: struct of content, truncated, omitted_lines. Untruncated text stays as it is."""
    own = lines(text)
    over = F.size(own) > limit
    return F.struct(
        F.when(over, F.array_join(F.slice(own, 1, limit) if limit else F.array().cast("array<string>"), "\n")).otherwise(text).alias("content"),
        over.alias("truncated"),
        F.when(over, F.size(own) - limit).otherwise(0).alias("omitted_lines"),
    )


def preview(added: Column, each: int = PREVIEW_LINES) -> Column:
    """Added lines: all of them as head if they are few, else the first and the last and how many are left out."""
    n = F.size(added)
    few = n <= 2 * each
    return F.when(
        n > 0,
        F.struct(
            F.when(few, added).otherwise(F.slice(added, 1, each)).alias("head_lines"),
            F.when(~few, F.slice(added, -each, each)).alias("tail_lines"),
            F.when(few, 0).otherwise(n - 2 * each).alias("omitted_lines"),
        ),
    )
