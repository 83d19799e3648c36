import time
import tracemalloc

import numpy as np

from strandline.llm import common
from strandline.llm import decontamination as d


def slow_tiles(doc, item, least):
    """The textbook form: the longest common run of unmarked words, first in doc, then in item."""
    in_doc, in_item, out = [x < 0 for x in doc], [x < 0 for x in item], []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not in_doc[i + k] and not in_item[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        i, j, k = best
        if k < least:
            return out
        in_doc[i : i + k] = in_item[j : j + k] = [True] * k
        out.append(best)


def test_tiles_are_greedy_string_tiling():
    rng = np.random.default_rng(0)
    for _ in range(150):
        doc = rng.integers(-1, 4, rng.integers(0, 40))
        item = rng.integers(0, 4, rng.integers(0, 25))
        assert sorted(d.tiles(doc, item, 3)) == sorted(slow_tiles(doc.tolist(), item.tolist(), 3))


def test_one_repeated_word_takes_little_time_and_memory():
    doc, item = np.zeros(20_000, np.int64), np.zeros(2_000, np.int64)
    tracemalloc.start()
    began = time.perf_counter()
    assert d.tiles(doc, item) == [(0, 0, 2_000)]
    doc[999::1000] = -1
    assert [n for *_, n in d.tiles(doc, item)] == [999, 999]
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 6 and most < 50e6  # with tracing, which slows it down


def test_long_texts_are_tiled_like_short_ones():
    rng = np.random.default_rng(7)
    for _ in range(10):
        item = rng.integers(0, 3, 60)
        doc = np.concatenate([item[30:], rng.integers(0, 3, 40), item[:30], np.full(20, 1)])
        assert sorted(d.tiles(doc, item, 5)) == sorted(slow_tiles(doc.tolist(), item.tolist(), 5))


def test_table_against_every_pair(spark):
    rng = np.random.default_rng(9)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    items = [(k, say(int(rng.integers(1, 25)))) for k in range(30)]
    docs = [(k, " ".join([say(10), items[k % 30][1], say(10), *([items[(k * 7) % 30][1]] if k % 3 else [])])) for k in range(60)]
    want, ids = [], d.Numbers()
    for doc, text in docs:
        for one, own in items:
            a, b = ids.of(text), ids.of(own)
            n = sum(k for *_, k in slow_tiles(a.tolist(), b.tolist(), min(d.SEED, len(b))))
            if n >= d.COVERAGE * len(b) and (len(b) >= d.SEED or n == len(b)):
                want.append((doc, one, n))
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in got.collect()) == sorted(want) and len(want) > 60


def item(k, n):
    return " ".join(f"q{k}x{j}" for j in range(n))


def test_passages_whole_reordered_and_edited(spark, monkeypatch):
    bench = [(k, item(k, 40), 1) for k in range(6)] + [(6, "short one", 1), (7, None, 1), (8, "", 1), (9, "of " * 30, 1)]
    w = item(1, 40).split()
    half = " ".join(item(2, 40).split()[:20])
    edited = item(3, 40).split()
    edited[20] = "new"
    docs = [
        (0, "clean words only " * 30, 0),
        (1, "before " * 50 + item(0, 40).upper() + " after" * 20, 0),
        (2, " ".join(w[30:] + ["gap"] + w[:15] + ["gap", "more"] + w[15:30]), 0),  # reordered
        (3, half, 0),
        (4, " ".join(edited), 0),
        (5, "a short, one here", 0),
        (6, None, 0), (7, "", 0),
        (8, item(0, 40) + " " + item(4, 40), 0), (8, item(0, 40) + " " + item(4, 40), 0),
        (None, item(5, 40), 0),
        (9, "of " * 24, 0), (10, "of " * 23 + "the", 0),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(bench, "item_id long, text string, doc_id int")
    want = sorted([(1, 0), (2, 1), (4, 3), (5, 6), (8, 0), (8, 4), (8, 0), (8, 4), (-1, 5), (9, 9)])
    for most in (common.MOST_BITS, common.LEAST_BITS):
        monkeypatch.setattr(common, "MOST_BITS", most)
        got = d.contaminated(docs, bench).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in got) == want
        kept = d.clean(docs, bench)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 6, 7, 10]
    monkeypatch.setattr(common, "bit_table", lambda seeds: (common.LEAST_BITS, np.full(1 << (common.LEAST_BITS - 3), 255, np.uint8)))
    assert d.contaminated(docs, bench).count() == len(want)  # a full table lets every window through
    reordered = [r for r in d.contaminated(docs, bench).collect() if r["doc_id"] == 2][0]
    assert reordered["coverage"] == 1.0 and reordered["tiles"] == 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.contaminated(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert d.contaminated(one, bench.limit(0)).collect() == [] and d.clean(one, bench.limit(0)).count() == 1
