"""FLAC streams in numpy: many frames are coded and decoded in step, one lane a frame.

The encoder writes mono streams with fixed predictors and Rice-coded residuals, and a seek table with a point for every
frame. The decoder reads constant, verbatim, fixed and linear-predictor subframes, wasted bits, both Rice methods and
escaped partitions of any mono stream with 4 to 24 bits a sample, and verifies the checksums of frame headers and frames
and the MD5 of the samples. Frames with plain Rice partitions are decoded in step; others one by one.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK, RATE, MAX_ORDER, MOST_RICE = 1024, 8000, 4, 11
#: Sample-size codes of frame headers, and the coefficients of the fixed predictors (fixed values of the format).
SIZE_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class Corrupt(ValueError):
    """A stream that is cut short, or whose checksum does not fit."""


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ polynomial, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint32)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of many byte ranges, in step."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, crc = starts[order], np.zeros(len(starts), np.uint32)
    alive = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    keep = np.uint32((1 << bits) - 1)
    for k in range(len(alive)):
        m = int(alive[k])
        part = crc[:m]
        crc[:m] = (part << np.uint32(8) & keep) ^ table[(part >> np.uint32(bits - 8)) ^ data[at[:m] + k]]
    out = np.zeros(len(starts), np.uint32)
    out[order] = crc
    return out


def pack_bits(pos: np.ndarray, size: np.ndarray, value: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bytes with `value` (at most 17 bits of `size`) at each bit position; fields do not overlap."""
    word = value.astype(np.int64) << (24 - size - (pos & 7))
    byte, out = pos >> 3, np.zeros(n_bytes + 3, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(byte + k, weights=(word >> shift) & 0xFF, minlength=n_bytes + 3).astype(np.int64)
    return out[:n_bytes].astype(np.uint8)


def _number(n: int) -> bytes:
    """A frame number as the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(lead << 1 | 1) & 0xFF) | n, *reversed(tail)])


def _header(n: int, frame: int) -> bytes:
    """A frame header of `n` 8-bit mono samples, with its checksum."""
    size = {256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}.get(n, 7)
    head = bytes([0xFF, 0xF8, size << 4 | 4, 1 << 1]) + _number(frame) + (struct.pack(">H", n - 1) if size == 7 else b"")
    crc = 0
    for b in head:
        crc = int(CRC8[crc ^ b])
    return head + bytes([crc])


def _parameters(grouped: np.ndarray) -> np.ndarray:
    """The Rice parameter of each partition (the last axis): the best of what its mean suggests and the two beside it."""
    width = grouped.shape[-1]
    total = grouped.sum(axis=-1)
    guess = np.clip(np.floor(np.log2(np.maximum(total * (np.log(2) / width), 1))).astype(np.int64), 1, MOST_RICE - 1)
    tried = [guess - 1, guess, guess + 1]
    costs = np.stack([(grouped >> k[..., None].astype(np.int32)).sum(axis=-1) + width * (k + 1) for k in tried])
    return np.take_along_axis(np.stack(tried), costs.argmin(axis=0)[None], axis=0)[0]


def _bodies(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of frames of equal length (one a row): their bytes on end, and how many bytes each has."""
    frames, n = samples.shape
    work = samples.astype(np.int32)
    best, order, residual = None, np.zeros(frames, np.int64), work
    part = work
    for k in range(min(MAX_ORDER, n - 1) + 1):
        if k:
            part = part[:, 1:] - part[:, :-1]
        cost = np.abs(part).sum(axis=1)
        if best is None:
            best, residual = cost, work.copy()
        else:
            better = cost < best
            best = np.where(better, cost, best)
            order[better] = k
            residual[better, k:] = part[better]
    parts = max(p for p in range(5) if n % (1 << p) == 0 and (p == 0 or n >> p >= 64))
    width = n >> parts
    column = np.arange(n)
    warm = column[None, :] < order[:, None]
    folded = np.where(warm, 0, np.where(residual < 0, -2 * residual - 1, 2 * residual))
    grouped = folded.reshape(frames, 1 << parts, width)
    rice = _parameters(grouped)
    param = np.repeat(rice, width, axis=1)
    quotient = folded >> param
    cost = np.where(warm, 8, quotient + 1 + param)
    heads = np.zeros((frames, n), np.int64)
    heads[:, ::width] = 4
    heads[:, 0] = 0
    np.put_along_axis(heads, order[:, None], 10, axis=1)  # method, partition order and the first parameter
    end = np.cumsum(cost + heads, axis=1) + 8
    size = (end[:, -1] + 7) // 8
    base = 8 * (np.cumsum(size) - size)
    end += base[:, None]
    coded = ~warm
    rows = np.arange(frames)
    first = end[rows, order] - cost[rows, order] - 10
    later = np.broadcast_to(column % width == 0, warm.shape) & (column > 0)[None, :]
    fields = [
        (base, np.full(frames, 8), (8 + order) << 1),
        (end[warm] - 8, np.full(int(warm.sum()), 8), samples[warm].astype(np.int64) & 0xFF),
        (first, np.full(frames, 6), np.full(frames, parts)),
        (first + 6, np.full(frames, 4), rice[:, 0]),
        ((end - cost)[later] - 4, np.full(int(later.sum()), 4), param[later]),
        (end[coded] - param[coded] - 1, param[coded] + 1, (1 << param[coded]) | (folded[coded] & ((1 << param[coded]) - 1))),
    ]
    pos, bits, value = (np.concatenate(x) for x in zip(*fields, strict=True))
    return pack_bits(pos, bits, value, int(size.sum())), size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose bytes are signed 8-bit samples with 128 taken off."""
    lengths = [len(p) for p in payloads]
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128
    first = np.cumsum([0, *lengths])
    frames = [(d, k, int(first[d]) + at, min(BLOCK, n - at)) for d, n in enumerate(lengths) for k, at in enumerate(range(0, n, BLOCK))]
    pieces: list[bytes] = [b""] * len(frames)
    sizes = np.array([f[3] for f in frames], np.int64)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        begin = np.array([frames[r][2] for r in rows], np.int64)
        body, size = _bodies(data[begin[:, None] + np.arange(n)[None, :]])
        raw, end = body.tobytes(), np.cumsum(size).tolist()
        for r, a, b in zip(rows.tolist(), [0, *end], end, strict=False):
            pieces[r] = _header(n, frames[r][1]) + raw[a:b]
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    crcs = checksums(joined, np.concatenate([[0], ends[:-1]]), ends, CRC16, 16).astype(">u2").tobytes() if pieces else b""
    out, at = [], 0
    for d, (payload, n) in enumerate(zip(payloads, lengths, strict=True)):
        own = []
        while at < len(frames) and frames[at][0] == d:
            own.append(pieces[at] + crcs[2 * at : 2 * at + 2])
            at += 1
        size = [len(x) for x in own]
        points, offset = [], 0
        for k, s in enumerate(size):
            points.append(struct.pack(">QQH", k * BLOCK, offset, min(BLOCK, n - k * BLOCK)))
            offset += s
        table = b"".join(points)
        signed = np.frombuffer(payload, np.uint8) ^ 0x80
        info = struct.pack(">HH", BLOCK, BLOCK) + (min(size, default=0)).to_bytes(3, "big") + (max(size, default=0)).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(signed.tobytes()).digest()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


class _Bits:
    """A reader for what is not decoded in step."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def read(self, n: int, signed: bool = False) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise Corrupt("the stream ends within a frame")
        x = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return x - (1 << n) if signed and n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def _parse(data: bytes, at: int, info: dict) -> dict:
    """A frame's header and its subframe's type, up to where the subframe's samples begin."""
    head = data[at : at + 4]
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise Corrupt(f"no frame at byte {at}")
    if head[3] >> 4:
        raise ValueError("only mono streams are read")
    i = at + 4
    lead, number = data[i], data[i]
    if lead >= 0x80:
        more = 0
        while lead << more & 0x80:
            more += 1
        number = lead & (0x7F >> more)
        for b in data[i + 1 : i + more]:
            number = number << 6 | b & 0x3F
        i += more - 1
    i += 1
    size = head[2] >> 4
    if size == 6:
        n, i = data[i] + 1, i + 1
    elif size == 7:
        n, i = int.from_bytes(data[i : i + 2], "big") + 1, i + 2
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    i += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    bits = SIZE_CODES.get(head[3] >> 1 & 7, info["bits"])
    crc = 0
    for b in data[at:i]:
        crc = int(CRC8[crc ^ b])
    if i >= len(data) or crc != data[i]:
        raise Corrupt(f"the header at byte {at} does not fit its checksum")
    kind = data[i + 1] >> 1 & 0x3F
    return {"n": n, "bits": bits, "number": number, "kind": kind, "wasted": data[i + 1] & 1, "body": 8 * (i + 2)}


def _one(data: bytes, frame: dict) -> tuple[np.ndarray, int]:
    """The samples of one frame and the bit where its subframe ends."""
    r, n, kind, bits, wasted = _Bits(data, frame["body"]), frame["n"], frame["kind"], frame["bits"], 0
    if frame["wasted"]:
        wasted = r.unary() + 1
        bits -= wasted
    if kind == 0:
        out = [r.read(bits, True)] * n
    elif kind == 1:
        out = [r.read(bits, True) for _ in range(n)]
    else:
        order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
        if order < 0:
            raise Corrupt(f"subframe type {kind} is reserved")
        out = [r.read(bits, True) for _ in range(order)]
        coefficients, shift = FIXED[order] if kind <= 12 else [], 0
        if kind >= 32:
            precision, shift = r.read(4) + 1, r.read(5, True)
            coefficients = [r.read(precision, True) for _ in range(order)]
        wide = 4 + r.read(2)
        parts = r.read(4)
        for p in range(1 << parts):
            k = r.read(wide)
            escape = r.read(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if p == 0 else 0)):
                if escape is not None:
                    e = r.read(escape, True)
                else:
                    u = r.unary() << k | r.read(k)
                    e = -(u + 1 >> 1) if u & 1 else u >> 1
                out.append(e + (sum(c * x for c, x in zip(coefficients, reversed(out[-order:] if order else []), strict=True)) >> shift))
    return np.array(out, np.int64) << wasted, r.at


def _in_step(data: np.ndarray, frames: list[dict], window: np.ndarray) -> list[tuple[np.ndarray, int] | None]:
    """Frames with the same length, predictor kind, order and partitions. None for lanes with an escaped partition."""
    n, kind, bits = frames[0]["n"], frames[0]["kind"], frames[0]["bits"]
    order = kind - 8 if kind <= 12 else kind - 31
    wide, parts = frames[0]["wide"], frames[0]["parts"]
    lanes = len(frames)
    pos = np.array([f["rice"] for f in frames], np.int64)
    limit = 8 * len(data)
    out = np.zeros((n, lanes), np.int64)
    for j in range(order):
        out[j] = [f["warm"][j] for f in frames]
    escaped = np.zeros(lanes, bool)

    def peek() -> np.ndarray:
        return window[np.minimum(pos, limit) >> 3] << (pos & 7).astype(np.uint64)

    j = order
    for p in range(1 << parts):
        k = (peek() >> np.uint64(64 - wide)).astype(np.int64)
        escaped |= k == (1 << wide) - 1
        pos += wide
        tail = (63 - k).astype(np.uint64)
        for j in range(j, (p + 1) * (n >> parts)):
            word = peek()
            zeros = LEADING[(word >> np.uint64(48)).astype(np.int64)]
            if zeros.max(initial=0) == 16:
                long = zeros == 16
                while long.any():
                    pos[long] += 16
                    escaped |= long & (pos > limit)
                    long &= ~escaped
                    word = peek()
                    more = LEADING[(word >> np.uint64(48)).astype(np.int64)]
                    zeros[long] += more[long]
                    long &= more == 16
                skipped = zeros & 15
            else:
                skipped = zeros
            rest = (word << skipped.astype(np.uint64) << np.uint64(1)) >> tail >> np.uint64(1)
            out[j] = zeros << k | rest.astype(np.int64)
            pos += skipped + 1 + k
        j = (p + 1) * (n >> parts)
    u = out[order:]
    out[order:] = (u >> 1) ^ -(u & 1)
    if kind <= 12:
        for k in range(order, 0, -1):  # undo the differences, highest first
            start = out[:k].copy()
            for _ in range(k - 1):
                start = np.diff(start, axis=0)
            out[k - 1] = start[-1]
            out[k - 1 :] = np.cumsum(out[k - 1 :], axis=0)
            if k > 1:
                out[: k - 1] = np.array([[f["warm"][i] for f in frames] for i in range(k - 1)])
    else:
        coefficients = np.array([f["coefficients"] for f in frames], np.int64).T[::-1]
        shift = np.array([f["shift"] for f in frames], np.int64)
        for j in range(order, n):
            out[j] += (coefficients * out[j - order : j]).sum(axis=0) >> shift
    out = out.T
    return [None if escaped[i] else (out[i], int(pos[i])) for i in range(lanes)]


LEADING = np.array([16 - x.bit_length() for x in range(1 << 16)], np.int64)


def _prepare(data: bytes, frame: dict) -> bool:
    """Read what stands before the first Rice partition; False if the frame is not decoded in step."""
    kind = frame["kind"]
    if frame["wasted"] or not (8 <= kind <= 12 or kind >= 32):
        return False
    r = _Bits(data, frame["body"])
    order = kind - 8 if kind <= 12 else kind - 31
    frame["warm"] = [r.read(frame["bits"], True) for _ in range(order)]
    if kind >= 32:
        precision, frame["shift"] = r.read(4) + 1, r.read(5, True)
        frame["coefficients"] = [r.read(precision, True) for _ in range(order)]
    frame["wide"], frame["parts"] = 4 + r.read(2), r.read(4)
    frame["rice"] = r.at
    return True


def open_stream(data: bytes) -> dict:
    """STREAMINFO, the seek table's byte offsets of frames, and where the first frame begins."""
    if data[:4] != b"fLaC":
        raise Corrupt("no FLAC stream")
    at, info, points = 4, {}, []
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            x = int.from_bytes(body[10:18], "big")
            info = {"rate": x >> 44, "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "samples": x & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind & 0x7F == 3:
            points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 0x80:
            break
    return info | {"first": at, "points": [p for p in points if p[0] != (1 << 64) - 1]}


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """For each stream its samples, and (first sample, samples) of each block. Raises Corrupt if a checksum fails."""
    data = b"".join(streams)
    flat = np.frombuffer(data, np.uint8)
    padded = np.concatenate([flat, np.zeros(16, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(flat) + 9, np.uint64)
    for k in range(8):
        window |= padded[k : k + len(window)] << np.uint64(56 - 8 * k)
    base, infos, frames = 0, [], []
    for d, stream in enumerate(streams):
        info = open_stream(stream)
        infos.append(info)
        covered = sum(p[2] for p in info["points"])
        if covered == info["samples"]:  # a point for every frame
            for sample, offset, _ in info["points"]:
                frames.append(_parse(data, base + info["first"] + offset, info) | {"of": d, "sample": sample, "start": base + info["first"] + offset})
        else:  # one after the other
            at, sample = base + info["first"], 0
            while sample < info["samples"]:
                frame = _parse(data, at, info) | {"of": d, "sample": sample, "start": at}
                frame["samples"], end = _one(data, frame)
                frame["end"] = at = (end + 7) // 8 + 2
                sample += frame["n"]
                frames.append(frame)
        base += len(stream)
    groups: dict[tuple, list[dict]] = {}
    for frame in frames:
        if "samples" in frame:
            continue
        if _prepare(data, frame):
            groups.setdefault((frame["n"], frame["kind"], frame["bits"], frame["wide"], frame["parts"]), []).append(frame)
    for group in groups.values():
        for frame, got in zip(group, _in_step(flat, group, window), strict=True):
            if got is not None:
                frame["samples"], frame["end"] = got[0], (got[1] + 7) // 8 + 2
    for frame in frames:
        if "samples" not in frame:
            frame["samples"], end = _one(data, frame)
            frame["end"] = (end + 7) // 8 + 2
    if frames:
        starts = np.array([f["start"] for f in frames], np.int64)
        ends = np.array([f["end"] for f in frames], np.int64)
        if ends.max() > len(flat):
            raise Corrupt("the stream ends within a frame")
        want = flat[ends - 2].astype(np.uint32) << 8 | flat[ends - 1]
        if (checksums(flat, starts, ends - 2, CRC16, 16) != want).any():
            raise Corrupt("a frame does not fit its checksum")
    out: list[tuple[list, list]] = [([], []) for _ in streams]
    for frame in frames:
        out[frame["of"]][0].append(frame["samples"])
        out[frame["of"]][1].append((frame["sample"], frame["n"]))
    done = []
    for info, (parts, blocks) in zip(infos, out, strict=True):
        samples = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        width = -(-info["bits"] // 8)
        raw = samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        if len(samples) != info["samples"] or info["md5"] != bytes(16) and hashlib.md5(raw).digest() != info["md5"]:
            raise Corrupt("the samples do not fit the stream's MD5")
        done.append((samples, blocks))
    return done
