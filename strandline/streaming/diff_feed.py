"""Changed symbols of a stream of diffs against a fixed symbol table.

The batch engine has no streams; this is its line attribution on one. Each micro-batch of diffs is parsed by the batch
operators, as their windows are bound to one diff and a diff never spans batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions import names
from strandline.operators import diffs
from strandline.operators.intervals import compacted, join_ranges


def touched(batch: DataFrame, symbols: DataFrame) -> DataFrame:
    """(diff_id, id, changed_lines) of one batch of (diff_id, diff)."""
    added = diffs.added_lines(diffs.diff_lines(batch))
    hits = join_ranges(added.select("diff_id", "path", "line_no"), symbols.select("name", "path", "start_line", "end_line"))
    hits = hits.withColumn("id", names.symbol_id(F.col("path"), F.col("name")))
    return compacted(hits, "diff_id", "id")


def attribute(stream: DataFrame, symbols: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing the touched symbols of a stream of diffs below `path`. A batch that is run again writes the same
    folder again, so each diff counts once."""

    def write(batch: DataFrame, number: int) -> None:
        touched(batch, symbols).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
