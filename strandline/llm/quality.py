"""Document quality by histogram gradient-boosted trees over statistics of the text.

Of the labelled rows that are not held out, at most SAMPLE (documented bound: those with the smallest hashes of doc_id and
label) are chosen from the labels alone; only their texts are described to learn from. The driver bins each statistic by
quantiles and grows trees on histograms of gradients. Trees are flattened into arrays of one shape, so one pass over all
documents describes every whole text and walks a batch of them down one level at a time with array operations. Labels,
lang, source and doc_id are no inputs.

Defined results: null and empty texts have statistics of zero and are scored like others; without labelled rows every
score is PRIOR, and labels of which none can be sampled raise; repeated rows are returned each; a label counts once for
each doc_id and value, with the text of the smallest hash where several rows have this doc_id; null labels don't count;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, BINS, DEPTH, TREES, RATE, LEAST, RIDGE = 20_000, 64, 4, 120, 0.1, 8.0, 1.0
THRESHOLD, PRIOR = 0.3, 0.5
SLICE_BITS = 12

#: Classes of bytes (fixed values): letters, digits, white space, signs by kind, bytes of other characters.
_GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t",
    "line": b"\n\r", "stop": b".,;:?", "bang": b"!", "hash": b"#", "dollar": b"$", "amp": b"&", "percent": b"%", "star": b"*",
    "bar": b"|", "quote": b"\"'`", "bracket": b"()[]{}<>", "dash": b"-_=+/\\~^@",
}
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _k, _v in enumerate(_GROUPS.values()):
    _CLASS[np.frombuffer(_v, np.uint8)] = _k

STATISTICS = [
    *(f"share_{g}" for g in _GROUPS), "share_other", "log_bytes", "log_words", "word_length", "word_spread", "distinct_words",
    "top_word", "distinct_pairs", "distinct_triples", "capital_words", "signed_words", "lines", "distinct_lines", "short_lines",
    "line_length", "ends_with_stop", "entropy",
]


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    n = max(len(data), 1)
    counts = np.bincount(data, minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=len(_GROUPS) + 1) / n
    seen = counts[counts > 0] / n
    words = raw.split()
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    many = max(len(lines), 1)
    return [
        *shares.tolist(), float(np.log1p(len(raw))), float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()),
        len(tally) / w, max(tally.values(), default=0) / w,
        len(set(zip(words, words[1:], strict=False))) / w, len(set(zip(words, words[1:], words[2:], strict=False))) / w,
        sum(map(bytes.isupper, words)) / w, 1 - sum(map(bytes.isalpha, words)) / w,
        float(np.log1p(len(lines))), len(set(lines)) / many, sum(len(x) < 40 for x in lines) / many,
        float(np.log1p(len(raw) / many)), sum(x.rstrip().endswith(b".") for x in lines) / many,
        float(-(seen * np.log2(seen)).sum()) + 0.0,
    ]


class Trees:
    """Boosted trees as arrays: for tree t, inner nodes 0 to 2^depth - 2 in heap order, then a value for each leaf."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(leaf) + 1]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic loss; each level's nodes are split at once, on histograms over (node, bin)."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y):
        return Trees(float(np.log(PRIOR / (1 - PRIOR))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    features, cuts, values = [], [], []
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            at = node - first
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * BINS + binned[:, j]
                gl = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hl = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST / 8) | (hr < LEAST / 8)] = 0
                gain = gain[:, : len(e)]
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                feature[first:][:width][better] = j
                cut[first:][:width][better] = e[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin = margin + value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(values))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` different (doc_id, y), those with the smallest hashes, of labels that are not held out and belong to
    a document. Counts of hashes by SLICE_BITS bits, then by the next ones within the slice that would be too much, tell up
    to which hash to go, whatever the number of rows and partitions."""
    marked = labels.where(F.col("quality").isNotNull() & ~common.held_out()).select("doc_id", F.col("quality").cast("double").alias("y"))
    marked = marked.distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows, path = common.written(marked.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "y"), 1)), "labelled")
    base, width, total = 0, 63, 0
    while width:
        step = min(SLICE_BITS, width)
        width -= step
        inside = rows.where((F.col("hash") >= base) & (F.shiftright(F.col("hash") - base, width + step) == 0))
        slices = inside.groupBy(F.shiftright(F.col("hash") - base, width).alias("slice")).agg(F.count("*").alias("n")).collect()  # 1 << SLICE_BITS at most
        for r in sorted(slices):
            if total + r["n"] > sample:
                base += r["slice"] << width
                break
            total += r["n"]
        else:
            base += 1 << (width + step)
            break
        if 2 * total >= sample:
            break
    if not total and not rows.isEmpty():
        raise ValueError("there are labels, but none of them fits in the sample")
    return rows.where(F.col("hash") < min(base, (1 << 63) - 1)).select("doc_id", "y")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from a bounded sample of labelled rows that are not held out."""
    common.tune(docs.sparkSession)
    with common.passing(docs.sparkSession):
        picked = sampled(docs, labels, sample)
        rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `sample` rows of two numbers
        rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("y", "least.text")
        described = common.map_columns(rows, "y double, x array<double>", lambda: lambda cols: {"y": cols["y"], "x": [statistics(t) for t in cols["text"]]})
        found = sorted((tuple(r["x"]), r["y"]) for r in described.collect())
    x = np.array([r[0] for r in found], np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r[1] for r in found], np.float64))


def classify(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    common.tune(docs.sparkSession)

    def start():
        def step(cols: dict) -> dict:
            score = trees.score(np.array([statistics(t) for t in cols["text"]], np.float64))
            return {
                "doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": score.tolist(),
                "predicted": (score >= THRESHOLD).astype(int).tolist(),
            }

        return step

    rows = docs.select("doc_id", common.held_out().alias("held_out"), "text")
    return common.map_columns(rows, "doc_id long, held_out boolean, score double, predicted int", start)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return classify(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def kept(docs: DataFrame, trees: Trees) -> DataFrame:
    """Whole rows of documents that are not rejected."""
    common.tune(docs.sparkSession)
    return common.where(
        docs, lambda: lambda texts: (trees.score(np.array([statistics(t) for t in texts])) >= THRESHOLD).tolist()
    )
