"""File records and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths, texts
from strandline.operators.diffs import Changes
from strandline.schemas import SCHEMA_VERSION

# Fixed values of the record format.
LARGE_BYTES, LARGE_LINES = 15 * 1024, 300
CHANGE_INTENT = ["symbol_moves", "package_reorganization"]
KEYS = ["diff_id", "file_ord"]
LINE = "array<struct<op string, old_line int, new_line int, content string>>"


def change_intent(moved_lines: Column) -> Column:
    """What a file that lost lines to moves is tagged with."""
    return F.when(moved_lines > 0, F.array(*map(F.lit, CHANGE_INTENT)))


def none_if_empty(column: Column) -> Column:
    return F.when(F.size(column) > 0, column)


def diffstat(hunk_lines: DataFrame) -> DataFrame:
    """(diff_id, file_ord, added_lines, deleted_lines, added_bytes, deleted_bytes)."""
    size = F.octet_length("content")
    add, delete = F.col("op") == "add", F.col("op") == "delete"
    return hunk_lines.groupBy(*KEYS).agg(
        F.count_if(add).cast("int").alias("added_lines"), F.count_if(delete).cast("int").alias("deleted_lines"),
        F.coalesce(F.sum(F.when(add, size)), F.lit(0)).cast("int").alias("added_bytes"),
        F.coalesce(F.sum(F.when(delete, size)), F.lit(0)).cast("int").alias("deleted_bytes"),
    )


def hunk_arrays(changes: Changes) -> DataFrame:
    """(diff_id, file_ord, hunks): each file's hunks with their lines, in order."""
    line = F.struct("line_ord", "op", "old_line", "new_line", "content")
    lines = changes.hunk_lines.groupBy(*KEYS, "hunk_ord").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    rows = changes.hunks.join(lines, [*KEYS, "hunk_ord"], "left")
    bare = F.transform("lines", lambda x: F.struct(x.op.alias("op"), x.old_line.alias("old_line"), x.new_line.alias("new_line"), x.content.alias("content")))
    rows = rows.withColumn("lines", F.coalesce(bare, F.array().cast(LINE)))
    hunk = F.struct("hunk_ord", "old_start", "old_lines", "new_start", "new_lines", "lines")
    return rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(hunk)).alias("hunks"))


def added_contents(hunks: Column) -> Column:
    lines = F.flatten(F.transform(hunks, lambda h: h.lines))
    return F.transform(F.filter(lines, lambda x: x.op == "add"), lambda x: x.content)


def is_compacted(status: Column, path: Column, added: Column, added_lines: Column, added_bytes: Column) -> Column:
    """Added files whose content is not shown: large, generated, vendored or binary ones."""
    large = (added_bytes > LARGE_BYTES) | (added_lines > LARGE_LINES)
    return (status == "added") & (large | paths.is_generated(path, added) | paths.is_vendor(path) | paths.is_binary(path))


def file_facts(changes: Changes, omitted: DataFrame | None = None) -> DataFrame:
    """Changed files with hunks, diffstat, classification, language, preview, and whether content is compacted."""
    rows = changes.files.join(hunk_arrays(changes), KEYS, "left").join(diffstat(changes.hunk_lines), KEYS, "left")
    if omitted is not None:
        rows = rows.join(omitted, KEYS, "left")
    else:
        rows = rows.withColumn("moved_lines_omitted", F.lit(0))
    empty = F.array().cast(f"array<struct<hunk_ord int, old_start int, old_lines int, new_start int, new_lines int, lines {LINE}>>")
    rows = rows.withColumn("hunks", F.coalesce("hunks", empty))
    rows = rows.fillna(0, ["added_lines", "deleted_lines", "added_bytes", "deleted_bytes", "moved_lines_omitted"])
    rows = rows.withColumn("added", added_contents(F.col("hunks")))
    path = F.col("path")
    return rows.select(
        "*", paths.language(path).alias("language"), paths.classification(path, F.col("test"), F.col("added")).alias("classification"),
        is_compacted(F.col("status"), path, F.col("added"), F.col("added_lines"), F.col("added_bytes")).alias("compacted"),
        F.aggregate(F.transform("hunks", lambda h: F.size(h.lines)), F.lit(0), lambda a, x: a + x).alias("hunk_lines"),
    )


def content_refs(files: DataFrame, workspace: DataFrame | None) -> DataFrame:
    """(diff_id, file_ord, content_ref) for files that are still there; the hash where the workspace has the file.
    `workspace`: path, content (bytes)."""
    kept = files.where((F.col("path") != "") & (F.col("status") != "deleted")).select(*KEYS, "path")
    if workspace is None:
        hashed = kept.withColumn("sha256", F.lit(None).cast("string"))
    else:
        hashed = kept.join(workspace.select("path", F.sha2("content", 256).alias("sha256")), "path", "left")
    ref = F.struct(F.lit("workspace_file").alias("kind"), F.col("path"), F.col("sha256"))
    return hashed.select(*KEYS, ref.alias("content_ref"))


def limited(hunks: Column, most: int) -> Column:
    """Hunks with at most `most` lines each (0: all), as they are written, with what was left out."""
    def shape(h: Column) -> Column:
        over = F.size(h.lines) > most if most else F.lit(False)
        shown = F.when(over, F.slice(h.lines, 1, most)).otherwise(h.lines) if most else h.lines
        return F.struct(
            h.old_start.alias("old_start"), h.old_lines.alias("old_lines"), h.new_start.alias("new_start"), h.new_lines.alias("new_lines"),
            F.when(over, F.size(h.lines) - most).alias("omitted_lines"), none_if_empty(shown).alias("lines"),
        )

    return F.transform(hunks, shape)


def unsupported(files: DataFrame) -> DataFrame:
    """Warnings for changed production files of languages without extraction, in diff order."""
    path = F.when(F.col("path") != "", F.col("path")).otherwise(F.col("old_path"))
    rows = files.where(~F.col("test")).withColumn("path", path).where("path <> ''")
    rows = rows.where(paths.analyzed_language(F.col("path")).isNull())
    message = "unsupported production language skipped for symbol and call graph analysis"
    return rows.select(
        F.lit("unsupported_language").alias("code"), F.lit(message).alias("message"), "path", F.lit(None).cast("string").alias("symbol"), *KEYS
    )


def file_symbols(nodes: DataFrame) -> DataFrame:
    """(path, symbols): ids of all nodes on a path, in order."""
    return nodes.groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("symbols"))


def summary(files, changed, deleted, moved, removed, entry_points, nodes, contexts) -> DataFrame:
    """One row of counters."""
    spark = files.sparkSession
    count = lambda df, name: df.agg(F.count("*").cast("int").alias(name))
    out = spark.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version"))
    parts = [
        files.agg(F.count("*").cast("int").alias("files"), F.count_if("test").cast("int").alias("test_files")), count(changed, "changed_symbols"),
        count(deleted, "deleted_symbols"), count(moved, "moved_symbols"), count(removed, "removed_calls"), count(entry_points, "entry_points"),
        count(nodes, "nodes"),
        contexts.agg(
            F.count("*").cast("int").alias("total"), F.count_if(F.col("relationship") == "changed_declaration").cast("int").alias("declaration_context"),
            F.count_if(F.col("relationship") != "changed_declaration").cast("int").alias("related_declaration_context"),
        ),
    ]
    for part in parts:  # one row each
        out = out.crossJoin(part)
    return out


def preview(added: Column) -> Column:
    return texts.preview(added)
