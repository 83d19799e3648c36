"""Token ids in files: canonical, length-limited Huffman codes from global counts, in blocks that decode alone.

A file is a Parquet part of about FILE ids whose rows are blocks, in ascending doc_id. A block holds the code words of whole
documents, its documents' ids and lengths, and the bit offset of every CHECKPOINT-th id, from which a reader can start.
Decoding looks as many bits as the longest code word has up in one table and runs all checkpoints of a batch of blocks in
step. The code book (a length for each id, from which the canonical code follows) is a table beside the blocks. Code words
have at most LIMIT bits, or one more than it takes to number the ids in use if that is more.

Defined results: null and empty texts hold the end id alone; rows of equal doc_id stand together, ordered by a hash of their
ids (so the order depends on what they hold, not on how the input lies), each counted in `start`; a null doc_id comes first;
an empty table gives no blocks and no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

END_ID = 2
#: Ids between two bit offsets; ids in a block, about; bits of the longest code word; blocks that are decoded together.
CHECKPOINT, BLOCK, LIMIT, TOGETHER = 256, 1 << 16, 16, 16
#: Ids in a file, about, where that gives more files than there are cores.
FILE = 1 << 26

IDS = "doc_id long, n_tokens long, ids binary, content long, salt int, counted array<int>, counts array<long>"
CODED = "doc_id long, n_tokens long, payload binary, bits binary, content long, salt int"
BLOCKS = "part int, block int, start long, doc_ids binary, nulls binary, n_tokens binary, payload binary, bytes binary, marks binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def longest(used: int) -> int:
    """Bits that a code word of `used` ids may have."""
    return max(LIMIT, used.bit_length() + 1)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code word lengths of at most `limit` bits with the least total, by package-merge. Ids without a count get 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need code words of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    n, rows = len(used), []
    packages = np.zeros(0, np.int64)
    for _ in range(limit):  # in each row, leaves and pairs of the row below, by weight
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        rows.append(order < n)
        merged = merged[order]
        m = len(merged) // 2 * 2
        packages = merged[0:m:2] + merged[1:m:2]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(rows):  # the first `take` entries of a row are chosen; its pairs choose twice as many below
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code word of each id: consecutive numbers in the order of length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            codes[i], last = code, int(lengths[i])
            code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every value of the next `limit` bits the id, and below it in five bits its code word's length."""
    codes = canonical(lengths)
    out = np.ones(1 << limit, np.uint32)
    for i in np.flatnonzero(lengths):
        shift = limit - int(lengths[i])
        at = int(codes[i]) << shift
        out[at : at + (1 << shift)] = i << 5 | lengths[i]
    return out


def encode_bits(runs: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """For each run of ids its code words, most significant bit first, and the bit offset of every CHECKPOINT-th one."""
    if not runs:
        return []
    n = np.array([len(x) for x in runs], np.int64)
    ids = np.concatenate(runs)
    size = lengths[ids].astype(np.int64)
    end = np.concatenate([[0], np.cumsum(size)])
    first = np.concatenate([[0], np.cumsum(n)])
    total = np.diff(end[first])  # bits of each run, which begins at a whole byte
    room = (total + 7) // 8
    base = 8 * (np.cumsum(room) - room)
    at = end[:-1] + np.repeat(base - end[first[:-1]], n)
    word, left = at >> 6, 64 - (at & 63) - size  # of 64 bits; bits that are left of it behind a code word
    values, over = codes.astype(np.uint64)[ids], np.flatnonzero(left < 0)
    placed = values << np.maximum(left, 0).astype(np.uint64)
    placed[over] = values[over] >> (-left[over]).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(room.sum()) // 8 + 2, np.uint64)
    out[word[heads]] = np.bitwise_or.reduceat(placed, heads)
    out[word[over] + 1] |= values[over] << (64 + left[over]).astype(np.uint64)
    raw = out.astype(">u8").tobytes()
    return [
        (raw[b // 8 : b // 8 + r], at[s : s + k : CHECKPOINT] - b)
        for b, r, s, k in zip(base.tolist(), room.tolist(), first.tolist(), n.tolist(), strict=False)
    ]


def decode_bits(data: np.ndarray, marks: np.ndarray, counts: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of runs that begin at bit offsets `marks` of `data`, `counts` (at most CHECKPOINT) in each, run by run."""
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    order = np.argsort(-counts, kind="stable")  # runs that end early drop off at the back
    at, out = marks[order].astype(np.uint32 if len(data) < 1 << 28 else np.uint64), np.zeros((CHECKPOINT, len(marks)), np.uint32)
    alive = np.searchsorted(-counts[order], -np.arange(CHECKPOINT), "left")
    seven, three, down, low = np.uint32(7), np.uint32(3), np.uint32(32 - limit), np.uint32(31)
    for k in range(int(counts.max(initial=0))):
        pos = at[: int(alive[k])]
        found = table[(window[pos >> three] << (pos & seven)) >> down]
        out[k, : len(pos)] = found
        pos += found & low
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return (out >> np.uint32(5)).T[back][np.arange(CHECKPOINT)[None, :] < counts[:, None]]


def _content(ids: np.ndarray) -> int:
    """XXH64 of the ids, as a signed long."""
    import xxhash

    h = xxhash.xxh64_intdigest(ids.astype("<u4").tobytes())
    return h - (1 << 64) if h >> 63 else h


def _runs(n_tokens: np.ndarray) -> np.ndarray:
    """Ids in each run between bit offsets: full ones, then the rest, for each document."""
    runs = -(-n_tokens // CHECKPOINT)
    out = np.full(int(runs.sum()), CHECKPOINT, np.int64)
    out[np.cumsum(runs) - 1] = n_tokens - (runs - 1) * CHECKPOINT
    return out


def write(docs: DataFrame, end_id: int = END_ID, vocabulary: str | None = None, path: str | None = None) -> str:
    """Encode whole texts and write blocks and code book below `path`, a new folder in the shared one if not given."""
    spark = docs.sparkSession
    common.tune(spark)
    vocab = vocabulary or tokens.vocabulary()
    out = path or common.new_path(spark, "token_files")

    def ids_of():
        encode, seen = tokens.encoder(vocab), [0]
        small = len(encode.byte_lengths()) <= 1 << 16  # ids of two bytes, if they fit
        total = np.zeros(0, np.int64)

        def step(cols: dict) -> dict:
            nonlocal total
            made = [np.frombuffer(x, "<u4") for x in encode(cols["text"])]
            made = [np.append(x, np.uint32(end_id)) for x in made]
            seen[0] += len(made)
            got = np.bincount(np.concatenate(made), minlength=len(total))
            got[: len(total)] += total
            total = got
            return {
                "doc_id": cols["doc_id"], "n_tokens": [len(x) for x in made],
                "ids": [x.astype("<u2" if small else "<u4").tobytes() for x in made],
                "content": [_content(x) for x in made], "salt": [k & 0x7FFFFFFF for k in range(seen[0] - len(made), seen[0])],
                "counted": [None] * len(made), "counts": [None] * len(made),
            }

        def last() -> dict:  # one row more for each task: what it has counted
            at = np.flatnonzero(total)
            return {c: [None] for c in ("doc_id", "n_tokens", "ids", "content", "salt")} | {"counted": [at.tolist()], "counts": [total[at].tolist()]}

        step.last = last
        return step

    made, ids_path = common.written(common.map_columns(docs.select("doc_id", "text"), IDS, ids_of), "ids")
    ids = made.where("counted IS NULL").drop("counted", "counts")

    def unpack(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")

    tally = made.where("counted IS NOT NULL").select(F.explode(F.arrays_zip("counted", "counts")).alias("x")).select(F.col("x.counted").alias("id"), F.col("x.counts").alias("n"))
    rows = tally.groupBy("id").agg(F.sum("n").alias("n")).collect()  # one for each id of the vocabulary at most
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, longest(len(rows)))
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{out}/book")
    shared = spark.sparkContext.broadcast((canonical(lengths), lengths))  # five bytes an id of the vocabulary

    def code():
        tokens.forget()
        codes, lengths = shared.value

        def step(cols: dict) -> dict:
            runs, made = [unpack(x, n) for x, n in zip(cols["ids"], cols["n_tokens"], strict=True)], []
            for k in range(0, len(runs), 64):
                made += encode_bits(runs[k : k + 64], codes, lengths)
            return {
                "doc_id": cols["doc_id"], "n_tokens": cols["n_tokens"], "payload": [x for x, _ in made],
                "bits": [np.diff(x, prepend=0).astype("<u2").tobytes() for _, x in made], "content": cols["content"], "salt": cols["salt"],
            }

        return step

    coded, coded_path = common.written(common.map_columns(ids, CODED, code), "coded", "none")
    common.removed(spark, ids_path)

    def block():
        part, state = TaskContext.get().partitionId(), {"block": 0, "start": 0, "rows": [], "n": 0}

        def cut() -> list:
            rows, state["rows"], state["n"] = state["rows"], [], 0
            if not rows:
                return []
            n = np.array([r[1] for r in rows], "<i8")
            made = (
                part, state["block"], state["start"],
                np.array([r[0] or 0 for r in rows], "<i8").tobytes(), np.array([r[0] is None for r in rows], np.uint8).tobytes(),
                n.tobytes(), b"".join(r[2] for r in rows), np.array([len(r[2]) for r in rows], "<i8").tobytes(),
                b"".join(r[3] for r in rows),
            )
            state["block"] += 1
            state["start"] += int(n.sum())
            return [made]

        names = [f.split()[0] for f in BLOCKS.split(", ")]
        columns = lambda rows: dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else None

        def step(cols: dict) -> dict | None:
            made = []
            for row in zip(cols["doc_id"], cols["n_tokens"], cols["payload"], cols["bits"], strict=True):
                state["rows"].append(row)
                state["n"] += row[1]
                if state["n"] >= BLOCK:
                    made += cut()
            return columns(made)

        step.last = lambda: columns(cut())
        return step

    # Ranges over the id, its content and then a row's number in its task: rows alike in both can fill several parts.
    parts = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // FILE))
    order = [F.col("doc_id").asc_nulls_first(), F.col("content"), F.col("salt")]
    ordered = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    common.map_columns(ordered, BLOCKS, block).write.option("compression", "none").parquet(f"{out}/blocks")
    common.removed(spark, coded_path)
    return out


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/book").collect()}
    book = np.zeros(max(lengths, default=-1) + 1, np.uint8)
    for i, n in lengths.items():
        book[i] = n
    blocks = spark.read.parquet(f"{path}/blocks")
    ends = blocks.groupBy("part").agg(F.max(F.struct("start", "n_tokens")).alias("x")).select("part", "x.*").collect()
    firsts, total = {}, 0  # a number for each part
    for r in sorted(ends, key=lambda r: r["part"]):
        firsts[r["part"]] = total
        total += r["start"] + int(np.frombuffer(r["n_tokens"], "<i8").sum())
    shared = spark.sparkContext.broadcast(book)

    def start():
        tokens.forget()
        limit = max(1, int(shared.value.max(initial=0)))
        table = decode_table(shared.value, limit)

        def step(cols: dict) -> dict:
            out: dict = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)}
            for k in range(0, len(cols["part"]), TOGETHER):  # more runs in step than one block has
                some = slice(k, k + TOGETHER)
                n = [np.frombuffer(x, "<i8") for x in cols["n_tokens"][some]]
                documents = [len(x) for x in n]
                starts = [s + firsts[p] + np.cumsum(x) - x for s, p, x in zip(cols["start"][some], cols["part"][some], n, strict=True)]
                n, size = np.concatenate(n), np.frombuffer(b"".join(cols["bytes"][some]), "<i8")
                marks = np.frombuffer(b"".join(cols["marks"][some]), "<u2").astype(np.int64)
                of = np.repeat(np.arange(len(n)), -(-n // CHECKPOINT))
                sums = np.cumsum(marks)
                head = np.searchsorted(of, np.arange(len(n)))
                marks = sums - sums[head][of] + marks[head][of] + 8 * (np.cumsum(size) - size)[of]
                ids = decode_bits(np.frombuffer(b"".join(cols["payload"][some]), np.uint8), marks, _runs(n), table, limit).astype("<u4")
                raw, ends = ids.tobytes(), np.cumsum(n)
                begins = ends - n
                nulls, doc_ids = (b"".join(cols[c][some]) for c in ("nulls", "doc_ids"))
                assert len(nulls) == sum(documents)
                out["doc_id"] += [None if z else d for d, z in zip(np.frombuffer(doc_ids, "<i8").tolist(), nulls, strict=True)]
                out["start"] += np.concatenate(starts).tolist()
                out["n_tokens"] += n.tolist()
                out["ids_crc32"] += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                if with_ids:
                    out["ids"] += [ids[a:b].tolist() for a, b in zip(begins, ends, strict=True)]
            return out

        return step

    return common.map_columns(blocks, RESULT + ", ids array<long>" * with_ids, start)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    return read(spark, write(common.documents(spark, sf_dir)))
