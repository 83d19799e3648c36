"""What the training-data operators share: Arrow mapping, held-out rows, and the scratch tables of the core."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandline.scratch import new_path, passing, removed, written

__all__ = ["new_path", "passing", "removed", "written"]  # scratch tables, beside what stands here

#: Rows in one Arrow batch; bounds a Python worker's memory when texts are long.
ARROW_ROWS = 1024
#: Bytes in one, where Spark can bound that, too.
ARROW_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for workers that see many long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_columns(df: DataFrame, schema: str, fn: Callable[[], Callable[[dict], dict | None]]) -> DataFrame:
    """mapInArrow over columns. `fn()` runs once a task and returns a function from a batch's columns (lists) to the
    output columns (lists or Arrow arrays); it may return None for no rows."""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = step({k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)})
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out
                )
        last = getattr(step, "last", None)
        if last is not None and (made := last()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema=None) -> DataFrame:
    """mapInArrow over whole batches; columns that `fn` leaves alone keep their Arrow values."""
    kind = schema or df.schema
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            if batch.num_rows:
                made = step(batch)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made.columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, kind)


#: Bits of a bit table (as powers of two), bits for each hash, and bits of the table in one row.
LEAST_BITS, MOST_BITS, PER_HASH, CHUNK = 16, 27, 32, 16


def bit_table(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """Of one column of hashes: bits (as a power of two), and a table with a bit for the leading bits of each, of at most
    1 << MOST_BITS bits whatever the number of rows. What it lets through is a superset, which a join makes exact."""
    bits = min(max((PER_HASH * hashes.count()).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits)
    rows = hashes.select(F.shiftright(place, CHUNK).cast("int").alias("chunk"), F.pmod(place, F.lit(1 << CHUNK)).cast("int").alias("bit"))

    def start():
        def step(cols: dict) -> dict:
            out = []
            for own in cols["own"]:
                flags = np.zeros(1 << CHUNK, np.uint8)
                flags[own] = 1
                out.append(np.packbits(flags).tobytes())
            return {"chunk": cols["chunk"], "flags": out}

        return step

    chunks = map_columns(rows.groupBy("chunk").agg(F.collect_set("bit").alias("own")), "chunk int, flags binary", start)  # 1 << CHUNK in a set at most
    table = np.zeros((1 << (bits - CHUNK), 1 << (CHUNK - 3)), np.uint8)
    for r in chunks.collect():
        table[r["chunk"]] = np.frombuffer(r["flags"], np.uint8)
    return bits, table.ravel()


def in_table(hashes: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    """Which of these unsigned hashes the table may hold."""
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def where(df: DataFrame, keep: Callable[[], Callable[[list], list[bool]]], column: str = "text") -> DataFrame:
    """Whole rows for which `keep()` says so of the column's values."""

    def start():
        test = keep()
        return lambda batch: batch.filter(pa.array(test(column_of(batch, column)), pa.bool_()))

    return map_batches(df, start)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
