"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most RADIUS of 64 bits agree on CUTS - RADIUS of CUTS segments at least, so every pair of
near fingerprints meets in a bucket of some choice of that many segments. Within buckets, fingerprints are stored as
bit planes, one bit of 64 neighbours in a word. The planes of the list and of the list moved on by s places are compared
for s = 1, 2, ...: carry-save counters hold the distances of all neighbours in step, and words are abandoned once every
pair in them is beyond the radius. A bucket that holds more than CROWD different fingerprints is dealt out as pairs of
blocks, so no task holds it whole. A task hands on a spanning forest of its links, not all pairs.

Defined results: null and empty texts have fingerprint zero and link like others; copies share a fingerprint and so a
component; repeated rows are returned each; a row without doc_id gets the component of its fingerprint, null if that has
no doc_id at all; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common, similar
from .components import components

SHINGLE, SEED, RADIUS, CUTS = 3, 42, 3, 5
#: Different fingerprints of one bucket that a task compares with each other, and lanes that it holds at a time.
CROWD, LANES = 2048, 1 << 16
NO_ID = (1 << 63) - 1

#: A-Z to a-z and the six ASCII white-space signs to spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)
)


def majority(hashes: np.ndarray) -> int:
    """64 bits: a bit is 1 if more than half of the hashes have it."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """64 bits: a bit is 1 if more than half of the shingles' XXH64 have it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - SHINGLE + 1)
    ends = (first + size)[min(SHINGLE, len(words)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    return majority(np.array([hash_of(line[a:b], SEED) for a, b in zip(first[:n].tolist(), ends, strict=True)], np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, as the signed long of the same bits."""

    def start():
        return lambda cols: {
            "doc_id": cols["doc_id"],
            "print": np.array([fingerprint(x) for x in cols["text"]], np.uint64).view(np.int64).tolist(),
        }

    return common.map_columns(docs.select("doc_id", "text"), "doc_id long, print long", start)


def segments(cuts: int = CUTS) -> list[tuple[int, int]]:
    """(first bit, bits) of each of `cuts` segments, from the lowest bit."""
    edges = [round(64 * k / cuts) for k in range(cuts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def masks(radius: int = RADIUS, cuts: int = CUTS) -> list[int]:
    """For each choice of the segments that must agree, their bits."""
    return [sum(((1 << n) - 1) << a for a, n in kept) for kept in combinations(segments(cuts), cuts - radius)]


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row p holds bit p (from the highest) of all prints, 64 to a word, lane i at bit i % 64 of word i // 64."""
    words = -(-len(prints) // 64)
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, : len(prints)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(64, words)


def near(prints: np.ndarray, groups: np.ndarray, radius: int = RADIUS, skip: int = 0):
    """Pairs (i, j) of lanes in the same run of `groups` whose prints differ in at most `radius` bits, in batches.
    `skip`: bits that are known to agree within a group."""
    n = len(prints)
    if n < 2:
        return
    rows = planes(prints)
    rows = rows[[p for p in range(64) if not skip >> (63 - p) & 1]]
    rows = np.concatenate([rows, np.zeros((len(rows), 2), np.uint64)], axis=1)
    last = np.flatnonzero(np.append(groups[1:] != groups[:-1], True))
    end = last[np.searchsorted(last, np.arange(n))] + 1  # of each lane's group
    left = end - np.arange(n) - 1  # lanes of the group after this one
    width = max(1, radius.bit_length())
    bias = (1 << width) - 1 - radius  # so that the counters run over beyond the radius
    full = ~np.uint64(0)
    for s in range(1, int(left.max()) + 1):
        lanes = np.zeros(-(-n // 64) * 64, np.uint8)
        lanes[:n] = left >= s
        valid = np.packbits(lanes, bitorder="little").view("<u8")
        at = np.flatnonzero(valid)
        valid = valid[at]
        step, shift = s // 64, np.uint64(s % 64)
        back = np.uint64(64) - shift
        counters = [np.full(len(at), full if bias >> k & 1 else 0, np.uint64) for k in range(width)]
        over = ~valid
        for p in range(0, len(rows), 2):
            pair = []
            for row in rows[p : p + 2]:
                ahead = row[np.minimum(at + step, len(row) - 2)]
                if shift:
                    ahead = ahead >> shift | row[np.minimum(at + step + 1, len(row) - 1)] << back
                pair.append(row[at] ^ ahead)
            low = counters[0]
            if len(pair) == 2:  # a full adder takes two planes and the lowest counter
                a, b = pair
                both = a ^ b
                carry = a & b | low & both
                counters[0] = low ^ both
            else:
                carry = low & pair[0]
                counters[0] = low ^ pair[0]
            for k in range(1, width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over = over | carry
            if p % 8 == 6:
                kept = over != full
                if not kept.all():
                    at, over = at[kept], over[kept]
                    counters = [c[kept] for c in counters]
                    if not len(at):
                        break
        if len(at):
            hit = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64)
            word, bit = np.nonzero(hit)
            i = at[word] * 64 + bit
            yield i, i + s


def forest(prints: np.ndarray, groups: np.ndarray, radius: int = RADIUS, skip: int = 0) -> list[tuple[int, int]]:
    """Links of `near` that join lanes not joined yet."""
    parent = np.arange(len(prints))
    out = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in near(prints, groups, radius, skip):
        new = parent[i] != parent[j]
        joined = False
        for one, other in zip(i[new].tolist(), j[new].tolist(), strict=True):
            a, b = find(one), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((one, other))
                joined = True
        while joined:  # every lane points to its root, so the test above sees all that is joined
            flat = parent[parent]
            joined = bool((flat != parent).any())
            parent = flat
    return out


def links(prints: DataFrame, radius: int = RADIUS, cuts: int = CUTS, crowd: int = CROWD) -> DataFrame:
    """Spanning links (a, b) between near prints. `prints`: print, each once."""
    agreeing = masks(radius, cuts)
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("print").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("key")) for k, m in enumerate(agreeing)]))
    rows = meeting(prints.select("print", band.alias("x")).select("x.band", "x.key", "print"))
    return compared(rows, [radius] * len(agreeing), agreeing, crowd)


def meeting(rows: DataFrame) -> DataFrame:
    """Rows of buckets (band, key) that hold more than one, with their number `n`."""
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, ["band", "key"])


def compared(rows: DataFrame, radii: list[int], agreeing: list[int], crowd: int = CROWD, name: str = "print") -> DataFrame:
    """Spanning links (a, b) within buckets, between the names of near prints. `rows`: band, key, n, print, and the name.
    `radii`, `agreeing`: of each band the radius, and the bits that agree in its buckets."""
    # Crowded buckets: blocks of about `crowd` prints, and a group for each pair of blocks.
    blocks = F.ceil(F.col("n") / crowd).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(name), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys, columns_of = ["band", "key", "lo", "hi"], dict.fromkeys(("print", name))
    rows = rows.select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *columns_of)
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def start():
        held: list[np.ndarray] = []
        count = [0]

        def compare(cols: np.ndarray) -> list[tuple[int, int]]:
            out = []
            for k in np.unique(cols[0]):
                part = cols[:, cols[0] == k]
                group = np.concatenate([[0], np.cumsum((part[:4, 1:] != part[:4, :-1]).any(axis=0))])
                sizes = np.bincount(group)
                order = np.lexsort((group, -sizes[group]))  # large groups first: the later shifts touch few words
                order = order[sizes[group[order]] > 1]
                if not len(order):
                    continue
                found = forest(part[4, order].view(np.uint64), group[order], radii[k], agreeing[k])
                names = part[-1, order]
                out += [(int(names[a]), int(names[b])) for a, b in found]
            return out

        def columns(found: list[tuple[int, int]]) -> dict | None:
            return {"a": [a for a, _ in found], "b": [b for _, b in found]} if found else None

        def step(cols: dict) -> dict | None:
            held.append(np.array([cols[c] for c in (*keys, *columns_of)], np.int64))
            count[0] += held[-1].shape[1]
            if count[0] < LANES:
                return None
            rows = np.concatenate(held, axis=1)
            same = (rows[:4] == rows[:4, -1:]).all(axis=0)  # the last group may go on
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held[:] = [rows[:, cut:]]
            count[0] = rows.shape[1] - cut
            return columns(compare(rows[:, :cut])) if cut else None

        step.last = lambda: columns(compare(np.concatenate(held, axis=1))) if held else None
        return step

    return common.map_columns(sorted_rows, "a long, b long", start)


def roots(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each different print with the smallest doc_id that has it (`rep`) and its component's root print."""
    different, _ = common.written(
        prints.groupBy("print").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep")), "different"
    )
    reached = components(links(different.select("print"), radius))
    rooted = different.join(reached.select(F.col("a").alias("print"), F.col("b").alias("root")), "print", "left")
    return rooted.withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row a document: doc_id, fingerprint, component_id."""
    common.tune(docs.sparkSession)
    prints, _ = common.written(fingerprints(docs), "prints")
    rooted = roots(prints, radius)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("print", "component_id"), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """Whole rows: of each component of similar texts (similar.py) one document, that of the smallest doc_id; of repeated
    rows one."""
    common.tune(docs.sparkSession)
    best = similar.roots(docs).groupBy("root").agg(F.min(F.struct("rep", "node")).alias("x"))
    key, mark = (next(n for n in (f"{x}{'_' * k}" for k in range(99)) if n not in docs.columns) for x in ("key", "node"))
    chosen = best.select(F.col("x.rep").alias(key), F.col("x.node").alias(mark))

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [similar.node(x) for x in common.column_of(batch, "text")]
            return batch.append_column(mark, pa.array(found, pa.int64()))

        return step

    schema = StructType([*docs.schema.fields, StructField(mark, LongType())])
    marked = common.map_batches(docs, start, schema).withColumn(key, F.coalesce("doc_id", F.lit(NO_ID)))
    return marked.join(chosen, [key, mark], "left_semi").dropDuplicates([key, mark]).select(docs.columns)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
