"""Declarations that a reviewer needs to see: changed ones, their direct callers and callees, and what encloses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import names, paths, texts
from strandline.operators.compare import with_id
from strandline.operators.intervals import BUCKET, bucketed_ranges


def enclosing(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, enclosing): for each wanted name the smallest other declaration of its file that holds it; ties by name."""
    inner = symbols.join(wanted.select("name"), "name", "left_semi").select("name", "path", "start_line", "end_line")
    inner = inner.withColumn("bucket", F.floor(F.col("start_line") / BUCKET)).alias("i")
    outer = bucketed_ranges(symbols.select("name", "path", "start_line", "end_line")).alias("o")
    held = inner.join(
        outer,
        (F.col("i.path") == F.col("o.path")) & (F.col("i.bucket") == F.col("o.bucket")) & (F.col("i.name") != F.col("o.name"))
        & (F.col("o.start_line") <= F.col("i.start_line")) & (F.col("o.end_line") >= F.col("i.end_line")),
    )
    span = F.col("o.end_line") - F.col("o.start_line")
    return held.groupBy(F.col("i.name").alias("name")).agg(F.min_by(F.col("o.name"), F.struct(span, F.col("o.name"))).alias("enclosing"))


def related(symbols: DataFrame, edges: DataFrame, changed: DataFrame, excluded: DataFrame, compact: DataFrame) -> DataFrame:
    """(name, relationship, related_to): neighbours of changed symbols that are themselves neither changed nor excluded.
    `excluded`: names that moved unchanged; `compact`: paths whose content is not shown."""
    shown = symbols.where(paths.analyzed_language_exact(F.col("path"))).join(compact.select("path"), "path", "left_anti")
    seeds = shown.join(changed.select("name"), "name", "left_semi").join(excluded.select("name"), "name", "left_anti")
    seeds = with_id(seeds, "related_to").select(F.col("name").alias("seed"), "related_to")
    callers = edges.join(seeds, edges["dst"] == seeds["seed"]).select(F.col("src").alias("name"), F.lit("direct_caller").alias("relationship"), "related_to")
    callees = edges.join(seeds, edges["src"] == seeds["seed"]).select(F.col("dst").alias("name"), F.lit("direct_callee").alias("relationship"), "related_to")
    around = enclosing(symbols, seeds.select(F.col("seed").alias("name")))
    around = around.join(seeds, around["name"] == seeds["seed"]).select(F.col("enclosing").alias("name"), F.lit("enclosing_declaration").alias("relationship"), "related_to")
    rows = callers.unionByName(callees).unionByName(around).distinct()
    rows = rows.join(changed.select("name"), "name", "left_anti").join(excluded.select("name"), "name", "left_anti")
    return rows.join(shown.select("name"), "name", "left_semi")


def contexts(symbols: DataFrame, edges: DataFrame, changed: DataFrame, excluded: DataFrame, compact: DataFrame) -> DataFrame:
    """Context records: id, path, name, kind, lines, relationship, related_to, changed_lines, excerpt."""
    shown = symbols.where(paths.analyzed_language_exact(F.col("path"))).join(compact.select("path"), "path", "left_anti")
    own = changed.join(excluded.select("name"), "name", "left_anti").select(
        "name", F.lit("changed_declaration").alias("relationship"), F.lit("").alias("related_to"), "changed_lines"
    )
    near = related(symbols, edges, changed, excluded, compact).withColumn("changed_lines", F.lit(None).cast(changed.schema["changed_lines"].dataType))
    rows = with_id(shown).join(own.unionByName(near), "name")
    name = F.col("name")
    return rows.select(
        "id", "path", names.short_name(name).alias("name"), names.context_kind(F.col("kind"), name).alias("kind"), "start_line",
        "end_line", "relationship", "related_to", "changed_lines", texts.excerpt(F.col("source")).alias("excerpt"),
    )
