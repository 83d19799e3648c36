import hashlib
import zlib

import numpy as np
import pytest

from strandline.llm import flac, media


def back(stream):
    ((samples, blocks),) = flac.decode([stream])
    return (samples + 128).astype(np.uint8).tobytes(), blocks


def test_round_trip():
    rng = np.random.default_rng(1)
    payloads = [
        bytes(64), bytes(range(256)) * 8, rng.integers(0, 256, 64 * 33, dtype=np.uint8).tobytes(),
        bytes([128]) * 4096 + bytes([0, 255]) * 512, (np.sin(np.arange(64 * 40) / 9) * 100 + 128).astype(np.uint8).tobytes(), b"a" * 64 * 200,
    ]
    streams = flac.encode(payloads)
    for payload, stream in zip(payloads, streams, strict=True):
        raw, blocks = back(stream)
        assert raw == payload and blocks[0][0] == 0 and sum(n for _, n in blocks) == len(payload)
    assert [((s + 128).astype(np.uint8).tobytes()) for s, _ in flac.decode(streams)] == payloads
    assert flac.encode([]) == [] and flac.decode([]) == []


def without_table(stream):
    """The same stream without its seek table, so frames are found one after the other."""
    first = flac.open_stream(stream)["first"]
    return b"fLaC\x80" + stream[5:42] + stream[first:]


def test_without_seek_table():
    payload = bytes(range(64)) * 100
    assert back(without_table(flac.encode([payload])[0]))[0] == payload


def test_damage_is_found():
    stream = bytearray(flac.encode([bytes(range(64)) * 40])[0])
    first = flac.open_stream(bytes(stream))["first"]
    for at in (first + 3, first + 40, len(stream) - 1, 30):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises((flac.Corrupt, ValueError)):
            flac.decode([bytes(broken)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, value, k):
        u = -2 * value - 1 if value < 0 else 2 * value
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)


def stream_of(frames, bits, samples):
    """A stream of one-off subframes; `frames`: (number of samples, function that writes the subframe)."""
    raw = samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : -(-bits // 8)].tobytes()
    info = bytes(10) + (8000 << 44 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    out = b"fLaC\x80" + len(info).to_bytes(3, "big") + info
    for k, (n, write) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x74, 0]) + bytes([k]) + (n - 1).to_bytes(2, "big")
        crc = 0
        for b in head:
            crc = int(flac.CRC8[crc ^ b])
        w = Writer()
        write(w)
        body = w.bits + "0" * (-len(w.bits) % 8)
        frame = head + bytes([crc]) + int(body, 2).to_bytes(len(body) // 8, "big")
        data = np.frombuffer(frame, np.uint8)
        out += frame + int(flac.checksums(data, np.array([0]), np.array([len(data)]), flac.CRC16, 16)[0]).to_bytes(2, "big")
    return out


def test_all_kinds_of_subframes():
    rng = np.random.default_rng(4)
    lpc = np.cumsum(rng.integers(-9, 10, 64)).astype(np.int64) * 3
    plain = rng.integers(-500, 500, 32)

    def write_lpc(w):
        coefficients, shift = [7, -3], 2
        w.put(0b0_100001_0, 8)
        for x in lpc[:2]:
            w.put(int(x), 12)
        w.put(4 - 1, 4)
        w.put(shift, 5)
        for c in coefficients:
            w.put(c, 4)
        w.put(1, 2)  # five-bit parameters
        w.put(1, 4)  # two partitions
        left = [int(lpc[i] - ((7 * lpc[i - 1] - 3 * lpc[i - 2]) >> shift)) for i in range(2, 64)]
        w.put(4, 5)
        for x in left[:30]:
            w.rice(x, 4)
        w.put(31, 5)  # escaped: raw numbers
        w.put(14, 5)
        for x in left[30:]:
            w.put(x, 14)

    def write_lpc_plain(w):
        w.put(0b0_100000_0, 8)
        w.put(int(lpc[0]), 12)
        w.put(3 - 1, 4)
        w.put(1, 5)
        w.put(2, 3)
        w.put(0, 6)
        w.put(0, 4)  # parameter 0: long unary runs
        for i in range(1, 64):
            w.rice(int(lpc[i] - (2 * lpc[i - 1] >> 1)), 0)

    def write_verbatim(w):
        w.put(0b0_000001_0, 8)
        for x in plain:
            w.put(int(x), 12)

    def write_constant(w):
        w.put(0b0_000000_0, 8)
        w.put(-77, 12)

    def write_wasted(w):
        w.put(0b0_000001_1, 8)
        w.put(0b01, 2)  # two wasted bits
        for x in plain:
            w.put(int(x), 10)

    want = np.concatenate([lpc, lpc, plain, np.full(16, -77), plain * 4])
    frames = [(64, write_lpc), (64, write_lpc_plain), (32, write_verbatim), (16, write_constant), (32, write_wasted)]
    ((samples, blocks),) = flac.decode([stream_of(frames, 12, want)])
    assert samples.tolist() == want.tolist() and blocks == [(0, 64), (64, 64), (128, 32), (160, 16), (176, 32)]
    # The second frame again through the decoder in step, by a seek table.
    one = stream_of([(64, write_lpc_plain)], 12, lpc)
    table = (0).to_bytes(8, "big") + (0).to_bytes(8, "big") + (64).to_bytes(2, "big")
    one = b"fLaC\x00" + one[5:42] + b"\x83" + len(table).to_bytes(3, "big") + table + one[42:]
    assert flac.decode([one])[0][0].tolist() == lpc.tolist()


def test_media_columns(spark, tmp_path):
    texts = ["", None, "é", "plain " * 700, "x" * 64, "x" * 65, "plain " * 700]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "z", 1), (2, "é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = media.digest(media.encode_media(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "z" if r["doc_id"] is None else texts[r["doc_id"]]
        raw = (text or "").encode()
        padded = raw + bytes((-len(raw)) % 64 or (64 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        stream = flac.encode([padded])[0]
        assert r["media_sha256"] == hashlib.sha256(stream).hexdigest() and r["media_bytes"] == len(stream)
    path = media.store(docs, f"file://{tmp_path}/media")
    blocks = media.pcm_blocks(spark.read.parquet(path)).where("doc_id = 3").orderBy("sample_offset").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks).rstrip(b"\0") == texts[3].encode()
    assert [b["sample_offset"] for b in blocks] == [0, 1024, 2048, 3072, 4096]
    assert media.digest(media.encode_media(docs.limit(0))).collect() == []
