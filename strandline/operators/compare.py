"""What the current snapshot lacks of the base snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import names


def with_id(symbols: DataFrame, name: str = "id") -> DataFrame:
    return symbols.withColumn(name, names.symbol_id(F.col("path"), F.col("name")))


def deleted_symbols(current: DataFrame, base: DataFrame, moves: DataFrame) -> DataFrame:
    """Ids of the base that are neither in the current snapshot nor where something moved from."""
    gone = with_id(base).select("id").join(with_id(current).select("id"), "id", "left_anti")
    return gone.join(moves.select(F.col("from_id").alias("id")), "id", "left_anti").distinct()


def edge_ids(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges between known symbols, by id: (from_id, to_id, site_path, site_line)."""
    ids = with_id(symbols).select("name", "id")
    ends = edges.join(ids.select(F.col("name").alias("src"), F.col("id").alias("from_id")), "src")
    ends = ends.join(ids.select(F.col("name").alias("dst"), F.col("id").alias("to_id")), "dst")
    return ends.select("from_id", "to_id", "site_path", "site_line")


def removed_calls(current: DataFrame, current_edges: DataFrame, base: DataFrame, base_edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Base edges whose ends, as far as they moved taken to where they moved, are no current edge."""
    now = edge_ids(current_edges, current).select(F.col("from_id").alias("f"), F.col("to_id").alias("t"))
    old = edge_ids(base_edges, base)
    start = moves.select(F.col("from_id").alias("f0"), F.col("to_id").alias("f1"))
    end = moves.select(F.col("from_id").alias("t0"), F.col("to_id").alias("t1"))
    mapped = old.join(start, F.col("from_id") == F.col("f0"), "left").join(end, F.col("to_id") == F.col("t0"), "left")
    mapped = mapped.withColumn("f", F.coalesce("f1", "from_id")).withColumn("t", F.coalesce("t1", "to_id"))
    return mapped.join(now, ["f", "t"], "left_anti").select("from_id", "to_id", "site_path", "site_line")
