from pathlib import Path

from strandline.llm import common
from strandline.llm.components import components


def test_small_tables_are_few_files(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 400, 2)] + [(1, 3)], "a long, b long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with common.passing(spark):
            got = components(edges)
            rows, files = sorted(map(tuple, got.collect())), len({Path(f).name for f in got.inputFiles()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files <= spark.sparkContext.defaultParallelism < 50
    assert rows == sorted([(1, 0), (2, 0), (3, 0)] + [(k + 1, k) for k in range(4, 400, 2)])
