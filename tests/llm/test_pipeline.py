import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import common, decontamination, packing, quality, secrets, simhash
from test_similar import slow_least

SF = "/root/testdata/sf0.001"
KEPT = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted(map(tuple, df.select(KEPT).collect()), key=str)


def test_stages_against_plain_python(spark):
    docs = common.documents(spark, SF)
    given = docs.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.learn(docs, labels)
    want = [r for r in given if trees.score(np.array([quality.statistics(r["text"])]))[0] >= quality.THRESHOLD]
    got = corpus_pipeline.good(spark, docs, SF)
    assert got.columns == KEPT and rows(got) == sorted(map(tuple, want), key=str) and 0 < len(want) < len(given)

    got, _ = common.written(got, "t")
    one = corpus_pipeline.single(spark, got, SF)
    least = set(slow_least({r["doc_id"]: r["text"] for r in want}))
    assert 0 < len(least) < len(want)
    want = [r for r in want if r["doc_id"] in least]
    assert one.columns == KEPT and rows(one) == sorted(map(tuple, want), key=str)

    one, _ = common.written(one, "t")
    clean = corpus_pipeline.untainted(spark, one, SF)
    items = [decontamination.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in want for i in items if f" {' '.join(i)} " in f" {' '.join(decontamination.words(r['text']))} "}
    left = {r["doc_id"] for r in clean.collect()}
    assert held and not held & left and len(want) - len(held) - len(left) <= 2

    clean, _ = common.written(clean, "t")
    masked = corpus_pipeline.masked(spark, clean, SF)
    old = {r["doc_id"]: r for r in clean.collect()}
    for r in masked.collect():
        assert r["text"] == secrets.redact(old[r["doc_id"]]["text"])
        assert r["n_chars"] == (old[r["doc_id"]]["n_chars"] if r["text"] == old[r["doc_id"]]["text"] else len(r["text"]))
    packed = corpus_pipeline.packed(spark, masked, SF)
    assert {r["doc_id"] for r in packed.collect()} == left


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset.to_numpy() == np.cumsum(part.length) - part.length).all()


def test_odd_rows_pass(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, print long, key string, score double"
    odd = [(1, None, None, None, None, 1, "k", 0.1), (1, None, None, None, None, 1, "k", 0.1), (None, "a b c", "en", "s", 5, 2, "k", None),
           (None, "a b c", "en", "s", 5, 2, "k", None), (4, "", "en", "s", 0, 3, "k", 1.0), (5, "x " * 60_000, "en", "s", 9, 4, "k", 1.0)]
    docs = spark.createDataFrame(odd, schema)
    one = simhash.deduplicated(docs)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in one.collect()) == [(-1, 5), (1, 0), (5, 120_000)]
    item = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id long, text string")
    clean = decontamination.clean(docs, item)
    assert clean.columns == docs.columns and sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in clean.collect()) == [(1, 0), (1, 0), (4, 0), (5, 120_000)]
    packed = packing.pack(docs, epochs=1).toPandas()
    assert packed.groupby("doc_id", dropna=False).piece.max().to_dict()[5.0] > 10 and len(packed[packed.doc_id == 1]) == 2 and packed.doc_id.isna().sum() == 2
    kept = quality.kept(docs, quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0)))
    assert kept.count() == len(odd)
    assert secrets.redacted(docs).count() == len(odd)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_documents(spark, stage):
    docs = common.documents(spark, SF).limit(0)
    assert stage(spark, docs, SF).collect() == []
