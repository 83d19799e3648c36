import numpy as np
import pytest
import xxhash

from strandline.llm import simhash


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_stated_one():
    for text in ["", None, "One", "one TWO", "a b c d e f g a b c", "É è x y\tz\n\x0bq", "x " * 500]:
        assert simhash.fingerprint(text) == slow_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_near_finds_all_pairs_in_groups(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 6, dtype=np.uint64)
    prints, groups = [], []
    for g, n in enumerate([1, 200, 3, 70, 2, 130]):
        for _ in range(n):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.append(int(base[g]) ^ sum(1 << int(b) for b in flips))
            groups.append(g)
    got = {(int(a), int(b)) for i, j in simhash.near(np.array(prints, np.uint64), np.array(groups), radius) for a, b in zip(i, j)}
    want = {(i, j) for j in range(len(prints)) for i in range(j) if groups[i] == groups[j] and (prints[i] ^ prints[j]).bit_count() <= radius}
    assert got == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, print string, component_id string")


def test_whole_operator_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(40):
        text = list(rng.choice(words, rng.integers(1, 120)))
        for _ in range(int(rng.integers(1, 6))):
            if len(text) > 4:
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            rows.append((n, " ".join(text), "p", "c"))
            n += 1
    rows += [(n, "", "p", "c"), (n + 1, None, "p", "c"), (n + 2, "\t \n", "p", "c"), (3, rows[3][1], "p", "c"), (None, rows[7][1], "p", "c"), (None, "only here alone", "p", "c")]
    prints = {i: slow_print(t) for i, t, *_ in rows if i is not None}
    want = slow_components(prints)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
    lone = [r for r in got if r["doc_id"] is None]
    assert sorted(str(r["component_id"]) for r in lone) == sorted([str(want[7]), "None"])


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(300)}
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    from strandline.llm.components import components

    got = {r["a"]: r["b"] for r in components(simhash.links(spark.createDataFrame(signed, "print long"), crowd=16)).collect()}
    want = slow_components({s: p % (1 << 64) for (s,), p in zip(signed, prints)} | {})
    assert {k: got.get(k, k) for k in want} == want


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
