"""Relations over line items take in the whole table."""

from pyspark.sql import functions as F

from strandline.plans import derived

SF = "/root/testdata/sf0.001"


def test_all_line_items_are_references_and_added_lines(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert derived.relation(spark, SF, "added").count() == items.count()
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    made = derived.relation(spark, SF, "refs").select("seq", F.regexp_extract("src", r"\.f(\d+)$", 1).cast("long"))
    want = items.select(seq, "l_partkey").distinct()
    assert want.exceptAll(made.distinct()).count() == 0 == made.distinct().exceptAll(want).count()
