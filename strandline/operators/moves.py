"""Symbols that changed their file between two snapshots, and what a pure move takes out of the diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators.diffs import Changes
from strandline.operators.intervals import join_ranges


def moved_symbols(current: DataFrame, base: DataFrame) -> DataFrame:
    """Names on different paths in both snapshots, whether the body is the same, and both line ranges."""
    c, b = current.alias("c"), base.alias("b")
    both = c.join(b, F.col("c.name") == F.col("b.name")).where(F.col("c.path") != F.col("b.path"))
    return both.select(
        names.symbol_id(F.col("b.path"), F.col("b.name")).alias("from_id"),
        names.symbol_id(F.col("c.path"), F.col("c.name")).alias("to_id"),
        (F.col("b.source") == F.col("c.source")).alias("body_equal"), F.col("c.name").alias("name"),
        F.col("b.path").alias("base_path"), F.col("b.start_line").alias("base_start"), F.col("b.end_line").alias("base_end"),
        F.col("c.path").alias("path"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"),
    )


def current_ranges(moves: DataFrame) -> DataFrame:
    return moves.where("body_equal").select("path", "start_line", "end_line")


def base_ranges(moves: DataFrame) -> DataFrame:
    return moves.where("body_equal").select(
        F.col("base_path").alias("path"), F.col("base_start").alias("start_line"), F.col("base_end").alias("end_line")
    )


def drop_moved_lines(added: DataFrame, moves: DataFrame) -> DataFrame:
    """Added lines outside of what moved unchanged."""
    return join_ranges(added, current_ranges(moves), "left_anti")


def drop_moved_hunk_lines(changes: Changes, moves: DataFrame) -> tuple[Changes, DataFrame]:
    """Hunk lines outside of what moved unchanged; hunks that lost all their lines go; files stay. Also the number of
    lines taken out of each file: (diff_id, file_ord, moved_lines_omitted)."""
    where = changes.files.select(
        "diff_id", "file_ord", F.col("path").alias("new_path"),
        F.when(F.coalesce("old_path", F.lit("")) == "", F.col("path")).otherwise(F.col("old_path")).alias("base_path"),
    )
    lines = changes.hunk_lines.join(where, ["diff_id", "file_ord"])
    adds = lines.where("op = 'add'").withColumn("path", F.col("new_path"))
    deletes = lines.where("op = 'delete'").withColumn("path", F.col("base_path"))
    others = lines.where("op not in ('add', 'delete')")
    kept = join_ranges(adds, current_ranges(moves), "left_anti", "new_line").unionByName(
        join_ranges(deletes, base_ranges(moves), "left_anti", "old_line")
    )
    kept = kept.drop("path").unionByName(others).select(changes.hunk_lines.columns)
    keys = ["diff_id", "file_ord", "hunk_ord"]
    before = changes.hunk_lines.groupBy(*keys).agg(F.count("*").alias("before"))
    after = kept.groupBy(*keys).agg(F.count("*").alias("after"))
    sizes = before.join(after, keys, "left").withColumn("gone", F.col("before") - F.coalesce("after", F.lit(0)))
    emptied = sizes.where("gone = before").select(keys)
    omitted = sizes.groupBy("diff_id", "file_ord").agg(F.sum("gone").cast("int").alias("moved_lines_omitted"))
    hunks = changes.hunks.join(emptied, keys, "left_anti")
    return Changes(changes.files, hunks, kept), omitted.where("moved_lines_omitted > 0")
