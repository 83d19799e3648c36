import math
import zlib

import numpy as np
import pytest

from strandline.llm import language, quality

SF = "/root/testdata/sf0.01"


def is_held(doc):
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % 5 == 0


def test_quality_on_held_out_rows(spark):
    got = quality.op2_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 1000 and (got.held_out == got.doc_id.map(is_held)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    own = got.merge(labels, on="doc_id")
    own = own[own.held_out]
    good, bad = own[own.quality == 1].score.to_numpy(), own[own.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (good >= 0.3).mean() > 0.97


def slow_margin(trees, row):
    out = trees.base
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + (row[feature[node]] > cut[node])
        out += leaf[node - len(feature)]
    return out


def test_flat_trees_walk_like_single_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.fit(x, y, trees=40)
    fast = trees.margin(x)
    assert np.allclose(fast, [slow_margin(trees, r) for r in x])
    assert ((fast > 0) == (y > 0.5)).mean() > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (3, "x" * 300_000, 3.0), (3, "a b", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.learn(docs, none)).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {quality.PRIOR}
    one = spark.createDataFrame([(1, 1, 0), (3, None, 0), (3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.classify(docs, quality.learn(docs, one)).collect())
    assert quality.classify(docs.limit(0), quality.fit(np.zeros((0, 1)), np.zeros(0))).collect() == []


def test_sample_is_filled_whatever_the_number_of_labels(spark, monkeypatch):
    docs = spark.range(5000).withColumnRenamed("id", "doc_id")
    labels = docs.withColumn("quality", (docs.doc_id % 2).cast("int")).union(docs.withColumn("quality", (docs.doc_id % 2).cast("int")))
    given = sum(not is_held(k) for k in range(5000))
    for bits in (3, 12):
        monkeypatch.setattr(quality, "SLICE_BITS", bits)
        for sample in (7, 500, 10**6):
            got = [r["doc_id"] for r in quality.sampled(docs, labels, sample).collect()]
            assert len(got) == len(set(got)) and min(sample, given) / 2 <= len(got) <= sample and not any(map(is_held, got))
    assert quality.sampled(docs, labels.where("doc_id < 0")).collect() == []
    with pytest.raises(ValueError):
        quality.sampled(docs, labels, 0)


def slow_statistics(text):
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, many, n = max(len(words), 1), max(len(lines), 1), max(len(raw), 1)
    out = [sum(b in signs for b in raw) / n for signs in quality._GROUPS.values()]
    out.append(sum(not any(b in signs for signs in quality._GROUPS.values()) for b in raw) / n)
    mean = sum(map(len, words)) / w
    out += [math.log(1 + len(raw)), math.log(1 + len(words)), mean, math.sqrt(sum((len(x) - mean) ** 2 for x in words) / w)]
    out += [len(set(words)) / w, max((words.count(x) for x in words), default=0) / w]
    out += [len({tuple(words[k : k + m]) for k in range(len(words) - m + 1)}) / w for m in (2, 3)]
    out += [sum(x.isupper() for x in words) / w, 1 - sum(x.isalpha() for x in words) / w]
    out += [math.log(1 + len(lines)), len(set(lines)) / many, sum(len(x) < 40 for x in lines) / many, math.log(1 + len(raw) / many)]
    out += [sum(x.rstrip()[-1:] == b"." for x in lines) / many, -sum(raw.count(b) / n * math.log2(raw.count(b) / n) for b in set(raw))]
    return out


def test_statistics_are_the_stated_ones():
    for text in [None, "", " ", "A b  b.\nA b b.\n\n", "É! 12 #x\r\n\ttail", "one two one two one two.\nTHREE 'q' (z)"]:
        got = quality.statistics(text)
        assert len(got) == len(quality.STATISTICS) and np.allclose(got, slow_statistics(text)), text


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 2] > 5) ^ (rng.random(300) < 0.2)).astype(float)
    trees = quality.fit(x, y, trees=1, depth=1)
    p = y.mean()

    def gain(j, cut):
        left = x[:, j] <= cut
        g, h = p - y, np.full(300, p * (1 - p))
        if h[left].sum() < quality.LEAST / 8 or h[~left].sum() < quality.LEAST / 8:
            return 0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
        return part(left) + part(~left) - part(left | True)

    best = max(gain(j, cut) for j in range(4) for cut in np.unique(x[:, j]))
    assert np.isclose(gain(trees.feature[0, 0], trees.cut[0, 0]), best)
    for side in (False, True):
        own = (x[:, trees.feature[0, 0]] > trees.cut[0, 0]) == side
        assert np.isclose(trees.leaf[0, int(side)], -quality.RATE * (p - y[own]).sum() / (own.sum() * p * (1 - p) + quality.RIDGE))


def slow_phrases(train, text):
    inside = {tuple(train[a:b]) for a in range(len(train)) for b in range(a + 1, len(train) + 1)}
    count, at = 1, 0  # the last phrase, which the text's end cuts off
    while True:
        end = at
        while end < len(text) and tuple(text[at : end + 1]) in inside:
            end += 1
        if end == len(text):
            return count
        count += 1
        at = end if text[end] in train else end + 1  # a symbol that the labelled text lacks ends a phrase within it


def parsed(train, size, texts):
    model = language.Model({})
    model.langs, model.automata = ["x"], [language.Automaton(train, size)]
    return model.phrases([np.array(t, np.uint8) for t in texts])[:, 0].tolist()


def test_phrases_are_greedy_longest_matches(monkeypatch):
    rng = np.random.default_rng(1)
    for segment, together in ((1024, 1 << 21), (7, 1 << 21), (3, 12), (1, 5)):
        monkeypatch.setattr(language, "SEGMENT", segment)
        monkeypatch.setattr(language, "TOGETHER", together)
        for _ in range(25):
            size = 5
            train = rng.integers(1, size, rng.integers(1, 60)).tolist()
            texts = [rng.integers(0, size, rng.integers(1, 50)).tolist() for _ in range(4)] + [train * 2, train + train[3:] + train]
            assert parsed(train, size, texts) == [slow_phrases(train, t) for t in texts]
    assert parsed([1, 2], 4, [[]]) == [0]


def test_phrases_of_a_long_text():
    rng = np.random.default_rng(2)
    train = rng.integers(1, 9, 400).tolist()
    long = rng.integers(0, 9, 10_000).tolist()
    copied = sum((train[a : a + 90] for a in rng.integers(0, 300, 120).tolist()), [])
    assert parsed(train, 9, [long, copied, train * 25]) == [slow_phrases(train, t) for t in (long, copied, train * 25)]


def test_language_on_held_out_rows(spark):
    got = language.op9_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    own = got.merge(docs, on="doc_id")
    assert len(own) == 1000 and (own.held_out == own.doc_id.map(is_held)).all() and own.score.between(0, 1).all()
    assert (own[own.held_out].lang == own[own.held_out].lang_pred).mean() > 0.97


def test_language_odd_rows(spark):
    rows = [(k, ("der hund und die katze sind im haus " if k % 2 else "the dog and the cat are in the house ") * 3, "de" if k % 2 else "en", 1) for k in range(40)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "12 34 !!", "en", 1), (103, "日本", None, 1), (None, "die katze", None, 1), (104, "the cat " * 20_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[103]["lang_pred"] in ("de", "en") and got[None]["lang_pred"] == "de" and got[104]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", docs["lang"].substr(0, 0))).collect()} <= {"", "und"}
    bare = docs.where("lang is null")
    assert {r["lang_pred"] for r in language.identify(bare).collect()} == {"und"}
    assert language.identify(docs.limit(0)).collect() == []


def test_languages_of_thousands_of_signs():
    """Two languages over the same 3,000 signs, which differ only in what follows what."""
    rng = np.random.default_rng(2)
    signs = [chr(0x4E00 + k) for k in range(3000)]
    words = {lang: ["".join(rng.choice(signs, 3)) for _ in range(300)] for lang in ("p", "q")}
    text = {lang: lambda n, own=own: " ".join(rng.choice(own, n)) for lang, own in words.items()}
    model = language.Model({lang: [make(100) for _ in range(30)] for lang, make in text.items()})
    asked = [(lang, text[lang](40)) for lang in ("p", "q") for _ in range(20)]
    assert model.predict([t for _, t in asked])[0] == [lang for lang, _ in asked]
