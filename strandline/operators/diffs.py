"""Unified diffs to relations, with running sums over lines instead of a state machine.

Two readings of the same lines: `added_lines` (target side, production code, not blank) and `changes` (files, hunks and
their lines). Every window is bound to one diff, and after the first running sum to one file or hunk of it, so a table of
many diffs is parsed in parallel. The marker for a missing line feed at a file's end counts in neither reading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import paths

HUNK_HEADER = r"^@@ -([0-9]+)(,([0-9]+))? \+([0-9]+)(,([0-9]+))? @@"
NO_LINE_FEED = "\\ No newline at end of file"


@dataclass
class Changes:
    files: DataFrame
    hunks: DataFrame
    hunk_lines: DataFrame


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, pos, line: without a carriage return at the end, and without the piece after the last line feed."""
    parts = F.split(F.col("diff"), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = diffs.where(F.col("diff") != "").select("diff_id", F.posexplode(parts).alias("pos", "line"))
    return rows.withColumn("line", F.regexp_replace("line", "\r\\z", ""))


def _count(number: Column) -> Column:
    return F.when(number == "", 1).otherwise(number.cast("int"))


def _added(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


def _deleted(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def _running(flag: Column, *keys: str) -> Column:
    return F.sum(flag.cast("int")).over(Window.partitionBy(*keys).orderBy("pos"))


def _before(flag: Column, *keys: str) -> Column:
    window = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(flag.cast("int")).over(window), F.lit(0))


def added_lines(lines: DataFrame) -> DataFrame:
    """Target-side changed lines of production paths that are not blank, with their numbers."""
    line = F.col("line")
    target = line.startswith("+++ ")
    header = line.rlike(HUNK_HEADER) & ~target
    rows = lines.where(~line.startswith(NO_LINE_FEED))
    rows = rows.withColumn("file", _running(target, "diff_id"))
    in_file = Window.partitionBy("diff_id", "file")
    rows = rows.withColumn("path", F.max(F.when(target, paths.clean_diff_path(F.substr(line, F.lit(5))))).over(in_file))
    rows = rows.withColumn("hunk", _running(header, "diff_id", "file"))
    in_hunk = Window.partitionBy("diff_id", "file", "hunk")
    start = F.max(F.when(header, F.regexp_extract(line, HUNK_HEADER, 4).cast("int"))).over(in_hunk)
    rows = rows.withColumn("start", start).where("hunk > 0").where(~header)
    rows = rows.withColumn("line_no", (F.col("start") + _before(~_deleted(line), "diff_id", "file", "hunk")).cast("int"))
    path, content = F.col("path"), F.substr(line, F.lit(2))
    kept = rows.where(_added(line) & (path != "/dev/null") & (path != "") & ~paths.is_test(path) & content.rlike(r"(?U)\S"))
    return kept.select("diff_id", "path", "line_no", content.alias("content"))


def changes(lines: DataFrame) -> Changes:
    """Changed files with their status, hunks, and added and deleted lines in order."""
    line = F.col("line")
    git = line.startswith("diff --git ")
    rows = lines.withColumn("file_ord", _running(git, "diff_id")).where("file_ord > 0")
    kind = (
        F.when(git, "git").when(line.startswith("new file mode "), "added").when(line.startswith("deleted file mode "), "deleted")
        .when(line.startswith("rename from "), "from").when(line.startswith("rename to "), "to").when(line.startswith("+++ "), "target")
        .when(line.rlike(HUNK_HEADER), "hunk").when(line.startswith(NO_LINE_FEED), "marker").otherwise("body")
    )
    rows = rows.withColumn("what", kind)
    what, pos = F.col("what"), F.col("pos")
    words = F.split(line, " ", -1)
    named = F.size(words) >= 4
    target = paths.clean_diff_path(F.substr(line, F.lit(5)))
    path = (
        F.when(what == "git", F.when(named, paths.clean_diff_path(F.get(words, F.lit(3)))).otherwise(""))
        .when(what == "to", F.substr(line, F.lit(len("rename to ") + 1)))
        .when((what == "target") & (target != "/dev/null"), target)
    )
    old = (
        F.when(what == "git", F.when(named, paths.clean_diff_path(F.get(words, F.lit(2)))).otherwise(""))
        .when(what == "from", F.substr(line, F.lit(len("rename from ") + 1)))
    )
    status = F.when(what.isin("added", "deleted"), what).when(what == "from", "renamed")
    files = rows.groupBy("diff_id", "file_ord").agg(
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), pos)), F.lit("modified")).alias("status"),
        F.max_by(old, F.when(old.isNotNull(), pos)).alias("old_path"),
        F.max_by(path, F.when(path.isNotNull(), pos)).alias("path"),
    )
    same = (F.col("old_path") == F.col("path")) & F.col("status").isin("added", "modified")
    files = files.select(
        "diff_id", F.col("file_ord").cast("int").alias("file_ord"), "status",
        F.when(same, "").otherwise(F.col("old_path")).alias("old_path"), "path", paths.is_test(F.col("path")).alias("test"),
    )
    inside = rows.withColumn("hunk_ord", _running(what == "hunk", "diff_id", "file_ord")).where("hunk_ord > 0")
    number = lambda group: F.regexp_extract(line, HUNK_HEADER, group)
    hunks = inside.where(what == "hunk").select(
        "diff_id", F.col("file_ord").cast("int").alias("file_ord"), F.col("hunk_ord").cast("int").alias("hunk_ord"),
        number(1).cast("int").alias("old_start"), _count(number(3)).alias("old_lines"),
        number(4).cast("int").alias("new_start"), _count(number(6)).alias("new_lines"),
    )
    keys = ("diff_id", "file_ord", "hunk_ord")
    in_hunk = Window.partitionBy(*keys)
    body = inside.withColumn("new_start", F.max(F.when(what == "hunk", number(4).cast("int"))).over(in_hunk))
    body = body.withColumn("old_start", F.max(F.when(what == "hunk", number(1).cast("int"))).over(in_hunk)).where(what == "body")
    body = body.withColumn("new", F.col("new_start") + _before(~_deleted(line), *keys))
    body = body.withColumn("old", F.col("old_start") + _before(~_added(line), *keys))
    ranked = body.where(_added(line) | _deleted(line)).withColumn("line_ord", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    hunk_lines = ranked.select(
        "diff_id", F.col("file_ord").cast("int").alias("file_ord"), F.col("hunk_ord").cast("int").alias("hunk_ord"), "line_ord",
        F.when(_added(line), "add").otherwise("delete").alias("op"), F.when(_deleted(line), F.col("old").cast("int")).alias("old_line"),
        F.when(_added(line), F.col("new").cast("int")).alias("new_line"), F.substr(line, F.lit(2)).alias("content"),
    )
    return Changes(files, hunks, hunk_lines)
