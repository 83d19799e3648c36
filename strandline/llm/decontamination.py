"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-case words, words are numbers (hashes). Seeds are Karp-Rabin hashes of the windows of SEED words;
items of fewer words are one seed of their own size. A bit table of all seeds of the benchmark (at most 1 << common.MOST_BITS bits,
whatever its size; common.bit_table) lets one pass over the documents keep only those with such windows, cut down to the words in them. Their
seeds are joined to the benchmark's, which gives the pairs of text and item that share one. Each pair is tiled: the longest
match of words that are in no tile yet, at least SEED long, is marked again and again; running Karp-Rabin hashes tell whether
there is a match of a given length, and halving the range of lengths finds the longest. Tiles may come in any order, so
reordered passages count. A document is reported with an item whose words its tiles cover to COVERAGE or more; items of fewer
than SEED words must be there whole. Equal texts are tiled once.

Defined results: null and empty texts and items match nothing; repeated rows, of documents or items, are reported each; of
tied matches the first in the document, then in the item, is marked; without documents or items there are no rows; other
columns are ignored. Memory for a pair grows with its words, not with its matches.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED, COVERAGE = 5, 0.8
#: Words whose numbers a task remembers.
REMEMBERED = 1 << 19
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: hashes are polynomials modulo 2^64


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Numbers(dict):
    """From word to its number: 63 bits of XXH64."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1
        return out

    def of(self, text: str | None) -> np.ndarray:
        return np.array([self[w] for w in words(text)], np.int64)


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` numbers."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _BASE + spread[k : k + n]
    return out ^ out >> np.uint64(31)


def _rolling(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers, so that a window of any size takes one subtraction."""
    prefix, power = np.zeros(len(ids) + 1, np.uint64), np.ones(len(ids) + 1, np.uint64)
    spread = ((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)).tolist()
    base, mask, h, p = int(_BASE), (1 << 64) - 1, 0, 1
    for k, x in enumerate(spread):
        h = (h * base + x) & mask
        p = p * base & mask
        prefix[k + 1], power[k + 1] = h, p
    return prefix, power


def _at(rolled: tuple[np.ndarray, np.ndarray], starts: np.ndarray, size: int) -> np.ndarray:
    prefix, power = rolled
    return prefix[starts + size] - prefix[starts] * power[size]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of `size` without a marked word."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[:-size]) if size < len(total) else np.zeros(0, np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of greedy tiles of at least `least` numbers. Numbers below 0 match nothing."""
    out: list[tuple[int, int, int]] = []
    in_doc, in_item = doc < 0, item < 0
    rolled_doc, rolled_item = _rolling(doc), _rolling(item)

    def shared(size: int) -> tuple[np.ndarray, ...]:
        """Free windows of `size` words: starts in doc whose hashes the item has, these hashes, starts in item, their hashes."""
        d, t = _free(in_doc, size), _free(in_item, size)
        hd, ht = _at(rolled_doc, d, size), _at(rolled_item, t, size)
        hit = np.isin(hd, ht)
        return d[hit], hd[hit], t, ht

    most = min(len(doc), len(item))
    while most >= least:
        low, high = least, most  # the longest size with a match: where one exists, a shorter one does, too
        while low <= high:
            size = (low + high) // 2
            if len(shared(size)[0]):
                low = size + 1
            else:
                high = size - 1
        if high < least:
            break
        most = high
        d, hd, t, ht = shared(most)
        order = np.argsort(ht, kind="stable")
        t, ht = t[order], ht[order]
        first = {h: k for k, h in reversed(list(enumerate(ht.tolist())))}  # of each hash the next place to try
        marked = False
        for a, h in zip(d.tolist(), hd.tolist(), strict=True):
            if in_doc[a] or in_doc[a + most - 1]:  # tiles of this size only, so an end lies in one that overlaps
                continue
            k = first[h]
            while k < len(t) and ht[k] == h:
                b = int(t[k])
                if not (in_item[b] or in_item[b + most - 1]):
                    break
                k += 1
            first[h] = k
            if k < len(t) and ht[k] == h and (doc[a : a + most] == item[t[k] : t[k] + most]).all():
                b = int(t[k])
                in_doc[a : a + most] = in_item[b : b + most] = True
                out.append((a, b, most))
                marked = True
        most -= not marked  # only a hash that lied leaves a match unmarked
    return out


def around(ids: np.ndarray, hits: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The numbers that stand in a window of `hits` (size, whether each window counts); -1 for each gap."""
    keep = np.zeros(len(ids) + 1, np.int64)
    for size, hit in hits:
        at = np.flatnonzero(hit)
        np.add.at(keep, at, 1)
        np.add.at(keep, at + size, -1)
    inside = np.cumsum(keep[:-1]) > 0
    gap = inside.copy()
    gap[1:] |= inside[:-1]  # one number that matches nothing after each stretch
    return np.where(inside, ids, -1)[gap]


def covered(doc: np.ndarray, item: np.ndarray, coverage: float) -> tuple[float, int, int] | None:
    """(share, words, tiles) of the item that the document covers, if that is enough."""
    size = min(SEED, len(item))
    found = tiles(around(doc, [(size, np.isin(windows(doc, size), windows(item, size)))]), item, size)
    n = sum(k for *_, k in found)
    return (n / len(item), n, len(found)) if n >= coverage * len(item) and (len(item) >= SEED or n == len(item)) else None


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Different items: number (any), item_id, copies, words as numbers (bytes), and their different seeds."""

    def start():
        number, seen, part = Numbers(), [0], TaskContext.get().partitionId()

        def step(cols: dict) -> dict:
            own = [number.of(t) for t in cols["text"]]
            seen[0] += len(own)
            return {
                "item": [part << 40 | k for k in range(seen[0] - len(own), seen[0])], "item_id": cols["item_id"], "copies": cols["copies"],
                "item_words": [x.tobytes() for x in own], "size": [min(SEED, len(x)) for x in own],
                "seeds": [_signed(np.unique(windows(x, min(SEED, len(x))))) if len(x) else [] for x in own],
            }

        return step

    rows = benchmark.where(F.col("text").isNotNull()).groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    made = common.map_columns(rows, "item long, item_id long, copies long, item_words binary, size int, seeds array<long>", start)
    return common.written(made.where("size > 0"), "items")[0]


KEYS = ("k1", "k2")
_KEYED = (F.xxhash64, lambda c: F.xxhash64(F.lit(1), c))


def keyed(docs: DataFrame) -> DataFrame:
    """With 128 bits that stand for the text."""
    for name, make in zip(KEYS, _KEYED, strict=True):
        docs = docs.withColumn(name, make(F.col("text")))
    return docs


def reduced(docs: DataFrame, sizes: list[int], bits: int, table: np.ndarray) -> tuple[DataFrame, str]:
    """Documents with a window that may be a seed: doc_id, the text's key, the words in such windows, and their hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 1 << (common.MOST_BITS - 3) bytes at most

    def start():
        number, flags = Numbers(), shared.value

        def step(cols: dict) -> dict | None:
            out: dict = {"doc_id": [], "k1": [], "k2": [], "words": [], "seeds": []}
            for doc, k1, k2, text in zip(*(cols[c] for c in ("doc_id", *KEYS, "text")), strict=True):
                ids = number.of(text)
                hits, found = [], []
                for size in sizes:
                    hashes = windows(ids, size)
                    hit = common.in_table(hashes, bits, flags)
                    if hit.any():
                        hits.append((size, hit))
                        found.append(hashes[hit])
                if found:
                    for name, x in zip(out, (doc, k1, k2, around(ids, hits).tobytes(), _signed(np.unique(np.concatenate(found)))), strict=True):
                        out[name].append(x)
            return out if out["doc_id"] else None

        return step

    rows = keyed(docs.select("doc_id", "text"))
    made = common.map_columns(rows, "doc_id long, k1 long, k2 long, words binary, seeds array<long>", start)
    return common.written(made, "reduced")


PAIR = "k1 long, k2 long, item_id long, copies long, coverage double, covered_words long, tiles long"


def tainted(docs: DataFrame, benchmark: DataFrame, coverage: float) -> tuple[DataFrame, DataFrame] | None:
    """The reduced documents, and the pairs of a text's key and an item that it covers enough; both written."""
    with common.passing(docs.sparkSession) as keep:
        items = benchmark_items(benchmark)
        seeds, _ = common.written(items.select("item", F.explode("seeds").alias("seed")), "seeds")
        sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # SEED at most
        if not sizes:
            return None
        rows, rows_path = reduced(docs, sizes, *common.bit_table(seeds.select("seed")))
        texts, _ = common.written(rows.dropDuplicates(KEYS).drop("doc_id"), "texts")
        near = texts.select(*KEYS, F.explode("seeds").alias("seed")).join(seeds, "seed").select(*KEYS, "item").distinct()
        both = near.join(texts.select(*KEYS, "words"), [*KEYS]).join(items.drop("seeds", "size"), "item")

        def start():
            def step(cols: dict) -> dict | None:
                found = []
                for k1, k2, item_id, copies, own, item in zip(*(cols[c] for c in (*KEYS, "item_id", "copies", "words", "item_words")), strict=True):
                    got = covered(np.frombuffer(own, np.int64), np.frombuffer(item, np.int64), coverage)
                    if got:
                        found.append((k1, k2, item_id, copies, *got))
                names = [f.split()[0] for f in PAIR.split(", ")]
                return dict(zip(names, map(list, zip(*found, strict=True)), strict=True)) if found else None

            return step

        pairs, path = common.written(common.map_columns(both.select(*KEYS, "item_id", "copies", "words", "item_words"), PAIR, start), "pairs")
        keep += [rows_path, path]
        return rows, pairs


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and benchmark item that it covers enough: doc_id, item_id, coverage, covered_words, tiles."""
    common.tune(docs.sparkSession)
    found = tainted(docs, benchmark, coverage)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, covered_words long, tiles long")
    rows, pairs = found
    each = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", *KEYS).join(each, [*KEYS]).select("doc_id", "item_id", "coverage", "covered_words", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Whole rows of documents that cover no item enough. The keys of texts that go are a written table, so Spark knows its
    size when it chooses how to join."""
    common.tune(docs.sparkSession)
    with common.passing(docs.sparkSession) as keep:
        found = tainted(docs, benchmark, coverage)
        if found is None:
            return docs
        gone, path = common.written(found[1].select(*KEYS).distinct(), "tainted")
        keep.append(path)
    same = [make(docs["text"]) == gone[name] for name, make in zip(KEYS, _KEYED, strict=True)]
    return docs.join(gone, same, "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
