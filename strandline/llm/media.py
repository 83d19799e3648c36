"""Media columns: texts' bytes as 8-bit PCM in FLAC streams, and back to PCM blocks with seekable sample offsets.

A byte is one sample. As text is no wave, its bytes lie far from zero and far from each other, and hardly shrink; so `store`
companders them: the commonest byte of all documents is sample 0, the next ones -1, 1, -2, 2 and so on. The table of this
(which byte each byte is written as) stands in every row, where Parquet's dictionary keeps it once. Without a table a byte b
is sample b - 128.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts have equal streams, whatever the row;
repeated rows are returned each; an empty table gives no rows; columns besides doc_id and text are ignored. A stream that
fails a checksum raises flac.Corrupt.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, flac

UNIT, TAIL = 64, 64
#: Payload bytes that are coded together; bounds a worker's memory.
TOGETHER = 1 << 21

MEDIA = "doc_id long, n_bytes long, media binary, written_as binary"
DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, sample_offsets string"
)
BLOCKS = "doc_id long, sample_offset long, samples int, pcm binary"


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def _batches(sizes: list[int]):
    """Ranges of rows of about TOGETHER bytes."""
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= TOGETHER or k == len(sizes) - 1:
            yield start, k + 1
            start, total = k + 1, 0


def companding(docs: DataFrame) -> bytes:
    """The byte that each byte is written as, from the counts of all payloads' bytes; ties by value."""

    def count():
        total = np.zeros(256, np.int64)

        def step(cols: dict) -> None:
            nonlocal total
            for text in cols["text"]:
                total = total + np.bincount(np.frombuffer(payload(text)[0], np.uint8), minlength=256)

        step.last = lambda: {"byte": list(range(256)), "n": total.tolist()}
        return step

    rows = common.map_columns(docs.select("text"), "byte int, n long", count).groupBy("byte").agg(F.sum("n").alias("n")).collect()  # 256
    counts = dict.fromkeys(range(256), 0) | {r["byte"]: r["n"] for r in rows}
    out = bytearray(256)
    for rank, byte in enumerate(sorted(counts, key=lambda b: (-counts[b], b))):
        out[byte] = 128 + (-(rank + 1 >> 1) if rank & 1 else rank >> 1)
    return bytes(out)


def _turned(table: bytes | None) -> bytes | None:
    """The table that undoes another."""
    if table is None:
        return None
    out = bytearray(256)
    for byte, other in enumerate(table):
        out[other] = byte
    return bytes(out)


def encode_media(docs: DataFrame, table: bytes | None = None) -> DataFrame:
    """A media column: doc_id, bytes before padding, FLAC stream, and the table that the bytes went through."""

    def start():
        def step(cols: dict) -> dict:
            made = [payload(x) for x in cols["text"]]
            media: list[bytes] = []
            for a, b in _batches([len(p) for p, _ in made]):
                media += flac.encode([p if table is None else p.translate(table) for p, _ in made[a:b]])
            return {"doc_id": cols["doc_id"], "n_bytes": [n for _, n in made], "media": media, "written_as": [table] * len(made)}

        return step

    return common.map_columns(docs.select("doc_id", "text"), MEDIA, start)


def store(docs: DataFrame, path: str | None = None) -> str:
    """Write the media column, companded, below `path`, a new folder in the shared one if not given."""
    common.tune(docs.sparkSession)
    out = path or common.new_path(docs.sparkSession, "media")
    encode_media(docs, companding(docs)).write.option("compression", "none").parquet(out)
    return out


def _decoded(cols: dict):
    """For each row its number, payload, and (first sample, samples) of each block."""
    known: dict[bytes | None, bytes | None] = {}
    for a, b in _batches([len(x) for x in cols["media"]]):
        for k, (samples, blocks) in enumerate(flac.decode(cols["media"][a:b]), a):
            table = cols["written_as"][k]
            if table not in known:
                known[table] = _turned(table)
            pcm = (samples + 128).astype(np.uint8).tobytes()
            yield k, pcm if table is None else pcm.translate(known[table]), blocks


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row for each frame: its PCM (unsigned 8-bit) and the offset of its first sample, to seek by."""

    def start():
        def step(cols: dict) -> dict | None:
            out: dict = {"doc_id": [], "sample_offset": [], "samples": [], "pcm": []}
            for k, pcm, blocks in _decoded(cols):
                for at, n in blocks:
                    for name, x in zip(out, (cols["doc_id"][k], at, n, pcm[at : at + n]), strict=True):
                        out[name].append(x)
            return out if out["doc_id"] else None

        return step

    return common.map_columns(media.select("doc_id", "media", "written_as"), BLOCKS, start)


def feature(pcm: bytes, blocks: int) -> str:
    """What the PCM sounds like: peak, root mean square, rate of sign changes, and blocks."""
    x = np.frombuffer(pcm, np.uint8).astype(np.float32) - 128
    crossings = int(np.count_nonzero(np.diff(x < 0)))
    square = int((np.bincount(np.frombuffer(pcm, np.uint8), minlength=256) * (np.arange(256) - 128) ** 2).sum())
    return f"peak={int(np.abs(x).max(initial=0))};rms={np.sqrt(square / len(x)):.4f};crossings={crossings / len(x):.6f};blocks={blocks}"


def digest(media: DataFrame) -> DataFrame:
    """Decode each stored stream and describe what was read back, and where its PCM blocks begin."""

    def start():
        def step(cols: dict) -> dict:
            rows = []
            for k, pcm, blocks in _decoded(cols):
                stream = cols["media"][k]
                rows.append((
                    cols["doc_id"][k], cols["n_bytes"][k], len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-TAIL:]), len(stream),
                    hashlib.sha256(stream).hexdigest(), feature(pcm, len(blocks)), ",".join([str(at) for at, _ in blocks]),
                ))
            names = [f.split()[0] for f in DIGEST.split(", ")]
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return step

    return common.map_columns(media.select("doc_id", "n_bytes", "media", "written_as"), DIGEST, start)


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is stored as files, and the digests are of what is read back from there."""
    path = store(common.documents(spark, sf_dir))
    return digest(spark.read.schema(MEDIA).parquet(path))
