"""Components of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts are compared as sequences of ASCII-folded words; texts of the same words are one node. The search is that of
simhash.py, over five-word shingles and wider: each node has a 64-bit SimHash fingerprint, and the nodes of a bucket are
compared as bit planes, with carry-save counters and abandoned words. Buckets are of two kinds:

* choices of agreeing segments, where fingerprints of at most simhash.RADIUS different bits meet for certain;
* bands of ROWS of BANDS * ROWS minimum hashes. At 0.8 some 10 of 64 bits differ, up to 18, which leaves no segments to
  agree; a pair of similarity s shares no band with odds (1 - s^ROWS)^BANDS, 3 in a million at 0.8 and less above. Here
  fingerprints may differ in FAR bits. Of two texts at 0.8, a bit differs with odds of 0.15, and 0.19 for the shortest texts
  (five shingles and four of them), so 1 pair in a million at most is further apart.

What the planes find is a candidate; a link is made only after both whole sets are compared, exactly. A bucket first hands
on a spanning forest of its candidates; then all its candidate pairs that these haven't brought into one component are
compared, so no candidate pair that could join two components goes unverified.

Defined results: null and empty texts are one node; a text of fewer than five words is one shingle.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction, so that it is tested in whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
#: Bits in which candidates of a band may differ.
FAR = 28
#: Shingles that are hashed together, hashes that are looked up together, and nodes of one bucket in a block.
SLICE, TOGETHER, CROWD = 512, 1 << 20, 1024

#: A-Z to a-z and the six ASCII white-space signs to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_DRAWN = np.random.default_rng(SEED)
_TIMES, _PLUS = (_DRAWN.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_MIX = _DRAWN.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _DRAWN.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def node(text: str | None) -> int:
    """XXH64 of the words, as a signed long."""
    import xxhash

    h = xxhash.xxh64_intdigest(b" ".join(words(text)), SEED)
    return h - (1 << 64) if h >> 63 else h


def shingles(text: str | None) -> np.ndarray:
    """Different XXH64 of the runs of SHINGLE words, in order."""
    import xxhash

    own = words(text)
    line = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    first = np.cumsum(size + 1) - size - 1
    n = max(1, len(own) - SHINGLE + 1)
    ends = (first + size)[SHINGLE - 1 :].tolist() if len(own) >= SHINGLE else [len(line)]
    starts = first[:n].tolist() or [0]
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed keys: of each band's minimum hashes, and of the band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for at in range(0, len(hashes), SLICE):
        least = np.minimum(least, (hashes[at : at + SLICE] * _TIMES + _PLUS).min(axis=1))
    mixed = ((least ^ least >> np.uint64(31)).reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND
    return (mixed ^ mixed >> np.uint64(29)).view(np.int64)


def choices(print_: int) -> list[int]:
    """Signed keys: of each choice of segments, the fingerprint's bits there."""
    return np.array([print_ & m for _, m in reach()[BANDS:]], np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the least similarity."""
    part, whole = LEAST
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


@cache
def reach() -> list[tuple[int, int]]:
    """Of each kind of key the radius, and the bits that agree in its buckets."""
    return [(FAR, 0)] * BANDS + [(simhash.RADIUS, m) for m in simhash.masks()]


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node, fingerprint, keys of its bands and then of its choices of segments, and the bands' as bytes."""

    def start():
        def step(cols: dict) -> dict:
            sets = [shingles(x) for x in cols["text"]]
            made, prints = [bands(x) for x in sets], [simhash.majority(x) for x in sets]
            return {
                "doc_id": cols["doc_id"], "node": [node(x) for x in cols["text"]], "print": np.array(prints, np.uint64).view(np.int64).tolist(),
                "keys": [x.tolist() + choices(p) for x, p in zip(made, prints, strict=True)], "bands": [x.tobytes() for x in made],
            }

        return step

    return common.map_columns(docs.select("doc_id", "text"), "doc_id long, node long, print long, keys array<long>, bands binary", start)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its shingles' bytes, for these nodes. Only texts that a bit table of the nodes lets through are moved."""
    wanted, _ = common.written(wanted, "wanted")
    bits, table = common.bit_table(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 1 << (common.MOST_BITS - 3) bytes at most

    def named():
        def step(cols: dict) -> dict | None:
            found = np.array([node(x) for x in cols["text"]], np.int64)
            at = np.flatnonzero(common.in_table(found.view(np.uint64), bits, shared.value)).tolist()
            return {"node": found[at].tolist(), "text": [cols["text"][k] for k in at]} if at else None

        return step

    def hashed():
        return lambda cols: {"node": cols["node"], "hashes": [shingles(x).tobytes() for x in cols["text"]]}

    texts = common.map_columns(docs.select("text"), "node long, text string", named).join(wanted, "node", "left_semi")
    return common.map_columns(texts.dropDuplicates(["node"]), "node long, hashes binary", hashed)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes that are similar."""

    def start():
        def step(cols: dict) -> dict:
            found = [
                (a, b) for a, b, x, y in zip(cols["a"], cols["b"], cols["x"], cols["y"], strict=True)
                if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            ]
            return {"a": [a for a, _ in found], "b": [b for _, b in found]}

        return step

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets, _ = common.written(_sets(docs, wanted), "sets", "lz4")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return common.map_columns(both.select("a", "b", "x", "y"), "a long, b long", start)


def _joined(place: list[tuple], band: int) -> list[tuple[int, int]]:
    """Links that join members of different roots. `place`: (node, root, side, print, bands, hashes) of each member; pairs
    are compared across sides if there are two, and only in the first band that they share (`band` is this one's number)."""
    root = np.array([r for _, r, *_ in place], np.int64)
    side = np.array([x for _, _, x, *_ in place])
    prints = np.array([x for *_, x, _, _ in place], np.int64).view(np.uint64)
    own = np.stack([np.frombuffer(x, np.int64) for *_, x, _ in place])[:, :band]
    sets = [np.frombuffer(x, np.uint64) for *_, x in place]
    size = np.array([len(x) for x in sets], np.int64)
    two, out = side.min() != side.max(), []
    part, whole = LEAST
    radius, agree = reach()[band]
    pairs = []
    for i, j in simhash.near(prints, np.zeros(len(place), np.int64), radius, agree):
        some = (root[i] != root[j]) & (whole * np.minimum(size[i], size[j]) >= part * np.maximum(size[i], size[j]))
        if two:
            some &= side[i] != side[j]
        i, j = i[some], j[some]
        some = ~(own[i] == own[j]).any(axis=1)
        pairs.append(np.stack([j[some], i[some]]))
    second, first = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    order = np.argsort(second, kind="stable")
    second, first = second[order], first[order]
    for k, at in zip(second[np.flatnonzero(np.diff(second, prepend=-1))].tolist(), np.split(first, np.flatnonzero(np.diff(second)) + 1), strict=False):
        at = at[root[at] != root[k]]
        if not len(at):
            continue
        for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(size[at]) // TOGETHER)) + 1):
            flat = np.concatenate([sets[i] for i in some])
            found = sets[k][np.minimum(np.searchsorted(sets[k], flat), size[k] - 1)] == flat
            both = np.add.reduceat(found, np.cumsum(size[some]) - size[some], dtype=np.int64)
            for i in some[whole * both >= part * (size[some] + size[k] - both)].tolist():
                if root[i] != root[k]:
                    root[root == root[i]] = root[k]
                    out.append((place[i][0], place[k][0]))
    return out


def _across(rows: DataFrame, docs: DataFrame, different: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of one bucket but different roots. `rows`: band, key, node, root. A bucket of more than
    CROWD nodes is dealt out as pairs of blocks."""
    sizes = rows.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    dealt = rows.join(sizes.select("band", "key", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks")), ["band", "key"])
    dealt, _ = common.written(dealt, "mixed")
    sets, _ = common.written(_sets(docs, dealt.select("node").distinct()), "sets", "lz4")
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    dealt = dealt.join(sets.join(different.select("node", "print", "bands"), "node"), "node")
    keys = ["band", "key", "lo", "hi"]
    dealt = dealt.select(*keys, "node", "root", "side", "print", "bands", "hashes").repartition(*keys).sortWithinPartitions(*keys)

    def start():
        held: list[tuple] = []
        last: list[tuple] = [()]

        def flush() -> list[tuple[int, int]]:
            found = _joined(held, last[0][0]) if len(held) > 1 else []
            held.clear()
            return found

        def columns(found: list[tuple[int, int]]) -> dict | None:
            return {"a": [a for a, _ in found], "b": [b for _, b in found]} if found else None

        def step(cols: dict) -> dict | None:
            found = []
            for key, row in zip(
                zip(*(cols[c] for c in keys), strict=True),
                zip(*(cols[c] for c in ("node", "root", "side", "print", "bands", "hashes")), strict=True), strict=True,
            ):
                if key != last[0]:
                    found += flush()
                    last[0] = key
                held.append(row)
            return columns(found)

        step.last = lambda: columns(flush())
        return step

    return common.map_columns(dealt, "a long, b long", start)


def links(docs: DataFrame, different: DataFrame) -> DataFrame:
    """(a, b) with b the smallest node of a's component; smallest nodes have no row. `different`: node, print, keys, bands
    (the keys' bytes), each once."""
    rows = simhash.meeting(different.select("node", F.posexplode("keys").alias("band", "key")))  # three numbers, 42 times a node
    rows, _ = common.written(rows.join(different.select("node", "print"), "node"), "buckets")
    radii, agreeing = zip(*reach(), strict=True)
    found, _ = common.written(simhash.compared(rows, radii, agreeing, CROWD, "node").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sure, _ = common.written(verified(docs, found), "sure")
    reached = components(sure).select(F.col("a").alias("node"), F.col("b").alias("root"))
    rooted = rows.where("n > 2").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return components(sure.unionByName(_across(rooted.select("band", "key", "node", "root"), docs, different)))


def roots(docs: DataFrame) -> DataFrame:
    """Each different node with the smallest doc_id that has it (`rep`, NO_ID if none) and its component's root."""
    with common.passing(docs.sparkSession) as keep:
        made, _ = common.written(nodes(docs), "nodes")
        grouped = made.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(simhash.NO_ID))).alias("rep"), F.first("print").alias("print"), F.first("keys").alias("keys"), F.first("bands").alias("bands"))
        different, _ = common.written(grouped, "different")
        reached = links(docs, different.select("node", "print", "keys", "bands"))
        rooted = different.select("node", "rep").join(reached.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
        out, path = common.written(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
        keep.append(path)
    return out
