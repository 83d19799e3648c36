import itertools
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from strandline.llm import packing, tokens


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + x <= capacity]
        if fits:
            max(fits, key=sum).append(x)
        else:
            bins.append([x])
    return bins


def whole(plan, counts, capacity):
    got = Counter()
    for lengths, n in plan.items():
        assert n > 0 and sum(lengths) <= capacity
        for x in lengths:
            got[x] += n
    return got == Counter(counts)


def test_best_fit_on_counts_is_as_good_as_item_by_item():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 200))]
        plan = packing.best_fit(Counter(lengths), 64)
        assert whole(plan, Counter(lengths), 64)
        assert sum(plan.values()) == len(plain_best_fit(lengths, 64))


def test_crossover_and_mutation_keep_every_piece():
    rng = random.Random(2)
    for _ in range(60):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 300)))
        a = packing.best_fit(counts, 100)
        b = packing.mutate(a, 100, rng)
        for plan in (b, packing.crossover(a, b, 100, rng), packing.crossover(b, a, 100, rng)):
            assert whole(plan, counts, 100)


def test_search_beats_best_fit_where_it_can(spark):
    counts = {6: 2, 5: 2, 4: 2, 3: 4, 2: 2}  # best fit decreasing leaves room, a perfect packing exists
    first = packing.best_fit(counts, 14)
    best = packing.search(spark, counts, 14, islands=3, epochs=2, generations=30, population=5)
    assert whole(best, counts, 14) and sum(best.values()) <= sum(first.values())
    assert sum(best.values()) == -(-sum(x * n for x, n in counts.items()) // 14)


def test_filling_and_settling_keep_every_piece():
    rng = random.Random(4)
    for _ in range(60):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 300)))
        assert whole(packing.fill(list(counts.elements()), 100), counts, 100)
        first = packing.best_fit(counts, 100)
        settled = packing.settle(first, 100, rng)
        assert whole(settled, counts, 100) and packing.score(settled, 100) <= packing.score(first, 100)


def test_bound_is_below_every_plan():
    rng = random.Random(8)
    for _ in range(200):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
        best = min(len({*bins}) for bins in itertools.product(range(len(lengths)), repeat=len(lengths)) if all(
            sum(x for x, b in zip(lengths, bins) if b == k) <= 12 for k in {*bins})) if len(lengths) < 6 else len(plain_best_fit(lengths, 12))
        assert -(-sum(lengths) // 12) <= packing.bound(Counter(lengths), 12) <= best


def test_search_beats_best_fit_on_real_lengths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pieces(docs).groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in rows if r["length"] < packing.CAPACITY}
    first = packing.best_fit(counts, packing.CAPACITY)
    best = packing.search(spark, counts, packing.CAPACITY, islands=3, epochs=4)
    assert whole(best, counts, packing.CAPACITY)
    assert packing.bound(counts, packing.CAPACITY) <= sum(best.values()) < sum(first.values()) == 456


def test_pieces_are_cuts_of_the_librarys_ids(spark):
    texts = ["", None, "a <|endoftext|> b", "short text, don't cut", "word and other " * 900, "é字 " * 700, "x " * 1023, "x " * 1024]
    tokenizer = Tokenizer.from_file(tokens.vocabulary())
    want = []
    for doc, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [*range(len(ids), 0, -1024)][::-1]
        for piece, (a, b) in enumerate(zip([0, *cuts], cuts)):
            want.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), epochs=1)
    assert sorted(tuple(r)[:5] for r in got.collect()) == want


def test_every_piece_has_its_place(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("word" for _ in range(rng.choice([0, 1, 5, 30, 30, 30, 200, 2500]))), 7) for k in range(300)]
    rows += [(None, None, 0), (5, rows[5][1], 0), (5, rows[5][1], 0), (None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    got = packing.pack(docs.repartition(7)).toPandas()
    assert len(got) == sum(-(-(len((t or "").split()) + 1) // 1024) for _, t, _ in rows)
    assert len(set(zip(got.sequence_id, got.offset))) == len(got)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset.to_numpy() == np.cumsum(part.length) - part.length).all() and part.length.sum() <= 1024
    long = max(range(300), key=lambda k: len(rows[k][1]))
    own = got[got.doc_id == long].drop_duplicates("piece").sort_values("piece")
    assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
    assert (own.length[1:] == 1024).all() and own.length.sum() == 2501
    assert got.doc_id.isna().sum() == 2 and set(got[got.doc_id.isna()].length) == {1}


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_beside_a_null_id_stay_exact(spark):
    ids = [(1 << 62) + k for k in range(1, 40)]
    docs = spark.createDataFrame([(x, "word") for x in (None, *ids)], "doc_id long, text string").coalesce(1)
    got = [r["doc_id"] for r in packing.pack(docs).collect()]
    assert got.count(None) == 1 and sorted(x for x in got if x is not None) == ids
