"""Joins of points to ranges within a key, and gaps-and-islands compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines in one bucket. Ranges stand in every bucket they touch, so one huge path is spread over many join keys.
BUCKET = 256


def bucketed_ranges(ranges: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    first, last = F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET)
    return ranges.where(F.col(end) >= F.col(start)).withColumn("bucket", F.explode(F.sequence(first, last)))


def join_ranges(points: DataFrame, ranges: DataFrame, how: str = "inner", line: str = "line_no") -> DataFrame:
    """Points whose `path` and line lie in a range (path, start_line, end_line). A point and a range meet in exactly one
    bucket; with how='left_semi' or 'left_anti' the points themselves come back."""
    at = points.withColumn("bucket", F.floor(F.col(line) / BUCKET)).alias("p")
    spans = bucketed_ranges(ranges).alias("r")
    on = (
        (F.col("p.path") == F.col("r.path")) & (F.col("p.bucket") == F.col("r.bucket"))
        & (F.col(f"p.{line}") >= F.col("r.start_line")) & (F.col(f"p.{line}") <= F.col("r.end_line"))
    )
    joined = at.join(spans, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("bucket")
    own = [F.col(f"p.`{c}`") for c in points.columns]
    return joined.select(*own, *[F.col(f"r.`{c}`") for c in ranges.columns if c not in points.columns])


def islands(lines: DataFrame, *keys: str, line: str = "line_no") -> DataFrame:
    """(keys, start, end) of runs of consecutive lines; repeated lines count once."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    runs = lines.select(*keys, line).distinct().withColumn("run", F.col(line) - rank)
    return runs.groupBy(*keys, "run").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("run")


def compacted(lines: DataFrame, *keys: str, line: str = "line_no") -> DataFrame:
    """(keys, changed_lines): each key's runs in order."""
    runs = islands(lines, *keys, line=line)
    return runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("changed_lines"))
