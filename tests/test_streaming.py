from strandline.schemas import DIFFS, SYMBOLS
from strandline.streaming import diff_feed


def test_diffs_of_a_stream_touch_symbols(spark, tmp_path):
    symbols = spark.createDataFrame([("p.A", "a.go", "function_declaration", 1, 5, ""), ("p.B", "a.go", "function_declaration", 6, 9, "")], SYMBOLS)
    diff = "diff --git a/a.go b/a.go\n--- a/a.go\n+++ b/a.go\n@@ -4 +4,3 @@\n+x\n+y\n+z\n"
    spark.createDataFrame([(1, diff), (2, diff.replace("+4,3", "+8,3"))], DIFFS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(DIFFS).parquet(f"{tmp_path}/in")
    diff_feed.attribute(stream, symbols, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = sorted((r["diff_id"], r["id"], [tuple(x) for x in r["changed_lines"]]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "a.go::p.A", [(4, 5)]), (1, "a.go::p.B", [(6, 6)]), (2, "a.go::p.B", [(8, 9)])]
