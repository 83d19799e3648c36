"""Scratch tables in the folder that driver and executors share: they cut lineage, and a lost executor loses none of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made inside each open `passing` block.
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. One is made only in local mode, as in tests, where all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandline"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write the rows to a scratch table and read it back. Returns the path, too."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows, read back from a scratch table: later steps don't recompute them."""
    return written(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables made inside are deleted at the end, but for those whose paths are put into the list given; these
    belong to the block around, if there is one."""
    _MADE.append([])
    keep: list[str] = []
    try:
        yield keep
    finally:
        made = _MADE.pop()
        if _MADE:
            _MADE[-1].extend(p for p in made if p in keep)
        for path in made:
            if path not in keep:
                removed(spark, path)
