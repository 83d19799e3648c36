import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import common, similar, simhash


def slow_shingles(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", folded)
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def slow_pairs(texts):
    """All pairs of similar texts, by brute force."""
    sets = {i: slow_shingles(t) for i, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def slow_least(texts):
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in slow_pairs(texts):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return sorted({find(i) for i in texts})


def edited(seed, families, most):
    """Families of texts, each a few words from another one of its family."""
    rng = np.random.default_rng(seed)
    words, rows = [f"W{k}" for k in range(2000)], {}
    for _ in range(families):
        own = [list(rng.choice(words, rng.integers(3, 150)))]
        for _ in range(int(rng.integers(1, most))):
            text = list(own[int(rng.integers(len(own)))])
            for _ in range(int(rng.integers(0, 1 + len(text) // 25))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            own.append(text)
        for text in own:
            rows[len(rows)] = " ".join(x.lower() if rng.random() < 0.3 else x for x in text)
    return rows


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.mark.parametrize("crowd", [similar.CROWD, 3])
def test_stage_finds_all_that_brute_force_finds(spark, monkeypatch, crowd):
    monkeypatch.setattr(similar, "CROWD", crowd)
    texts = edited(3, 30, 14) | {1000: "", 1001: None, 1002: "\t", 1003: "one Two", 1004: "ONE two"}
    pairs = slow_pairs(texts)
    far = [p for p in pairs if (simhash.fingerprint(texts[p[0]]) ^ simhash.fingerprint(texts[p[1]])).bit_count() > 3]
    assert len(far) > 50
    met = [set(similar.bands(similar.shingles(texts[a]))) & set(similar.bands(similar.shingles(texts[b]))) for a, b in pairs]
    assert all(met)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(table(spark, texts)).collect()) == slow_least(texts)


def test_pipeline_stage_joins_given_near_copies(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.documents(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (2, 56, 1, 255, 643, 770, 582, 875, 709, 944, 3, 4)").collect()}
    want = slow_least(texts)
    assert len(want) <= len(texts) - 5
    got = corpus_pipeline.single(spark, docs.where(docs.doc_id.isin(list(texts))), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == want


def slow_print(text):
    """Of five-word shingles, each once: bits that more than half of their XXH64 have."""
    import xxhash

    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in slow_shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_searches_with_simhash_fingerprints(spark):
    texts = edited(8, 25, 12)
    prints = {similar.node(t): slow_print(t) for t in texts.values()}
    rows = similar.nodes(table(spark, texts)).select("node", "print", "keys").collect()
    assert {r["node"]: r["print"] % (1 << 64) for r in rows} == prints
    distance = {(a, b): (slow_print(texts[a]) ^ slow_print(texts[b])).bit_count() for a, b in slow_pairs(texts)}
    assert max(distance.values()) > simhash.RADIUS and max(distance.values()) <= similar.FAR
    keys = {r["node"]: r["keys"] for r in rows}
    for (a, b), n in distance.items():  # near fingerprints meet in a choice of segments, too
        x, y = keys[similar.node(texts[a])][similar.BANDS :], keys[similar.node(texts[b])][similar.BANDS :]
        assert len(x) == 10 and (n > simhash.RADIUS or any(p == q for p, q in zip(x, y)))


@pytest.mark.parametrize("crowd", [1024, 4])
def test_buckets_hand_on_links_of_near_fingerprints_only(spark, crowd):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3).tolist()
    prints = {k: base[k % 3] ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)) for k in range(60)}
    rows = spark.createDataFrame([(0, 7, 60, n, p) for n, p in prints.items()], "band int, key long, n long, node long, print long")
    got = simhash.compared(rows, [similar.FAR], [0], crowd, "node").collect()
    assert got and all((prints[r["a"]] ^ prints[r["b"]]).bit_count() <= similar.FAR for r in got)
    from strandline.llm.components import components

    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= similar.FAR]
    both = [spark.createDataFrame(x, "a long, b long") for x in ([(r["a"], r["b"]) for r in got], near)]
    joined, want = ({tuple(r) for r in components(x).collect()} for x in both)
    assert joined == want


def test_pairs_that_the_forest_left_out_are_compared():
    hashes = [np.unique(np.random.default_rng(s).integers(0, 1 << 63, 100).astype(np.uint64)) for s in range(2)]
    near = np.unique(np.append(hashes[0][5:], hashes[1][:2]))
    sets = [hashes[0], hashes[1], near]
    place = [(n, n, 0, int(np.uint64(simhash.majority(x)).view(np.int64)), similar.bands(x).tobytes(), x.tobytes()) for n, x in enumerate(sets)]
    assert similar._joined(place, 0) == [(0, 2)]
    far = [(*x[:3], -1 - place[0][3] if n else x[3], *x[4:]) for n, x in enumerate(place)]  # no candidates: all bits differ
    assert similar._joined(far, 0) == []
