import heapq
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandline.llm import token_files, tokens


def plain():
    return Tokenizer.from_file(tokens.vocabulary())


TEXTS = [
    "", None, " ", "  a  b", "a \n b", "x\t y", "a  b  c ", "don't  stop\n\n\n x <|endoftext|> y", "É é 1²Ⅷ",
    "😀😀 字字", "word " * 3000, "'s 's", "a" * 5000, "\x1c \x85", "plain text, with stops. And\nlines",
]


def test_encoder_gives_the_librarys_ids():
    rng = np.random.default_rng(3)
    signs = [" ", "  ", "\n", "\t", "a", "É", "1", "²", "!", "'", "s", "'s", " ", "　", "x", "字", "​", "_"]
    texts = TEXTS + ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)]
    tokenizer = plain()
    for text, ids in zip(texts, tokens.Encoder(tokens.vocabulary())(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_have_their_own_id():
    ids = np.frombuffer(tokens.Encoder(tokens.vocabulary())(["x <|endoftext|> y"])[0], "<u4").tolist()
    assert ids == plain().encode("x <|endoftext|> y", add_special_tokens=False).ids and 50256 in ids


def test_code_lengths_are_huffmans_where_the_limit_allows():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 1000, 200)
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        best += x
        heapq.heappush(heap, x)
    lengths = token_files.code_lengths(counts)
    assert int((lengths * counts).sum()) == best
    steep = np.array([int(1.7**k) + 1 for k in range(40)])
    lengths = token_files.code_lengths(steep, 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(n) for n in lengths) <= 1
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(300), 8)


def test_bits_round_trip():
    rng = np.random.default_rng(2)
    counts = np.maximum(0, rng.normal(0, 500, 3000).astype(int))
    used = np.flatnonzero(counts)
    lengths = token_files.code_lengths(counts)
    codes = token_files.canonical(lengths)
    runs = [rng.choice(used, n) for n in (1, 255, 256, 257, 5000, 3)]
    made = token_files.encode_bits(runs, codes, lengths)
    n = np.array([len(r) for r in runs])
    size = np.array([len(raw) for raw, _ in made])
    starts = np.concatenate([m + 8 * b for (_, m), b in zip(made, np.cumsum(size) - size)])
    data = np.frombuffer(b"".join(raw for raw, _ in made), np.uint8)
    got = token_files.decode_bits(data, starts, token_files._runs(n), token_files.decode_table(lengths))
    assert got.tolist() == np.concatenate(runs).tolist()


def test_files_hold_every_id_in_order(spark):
    rows = [(k * 3 % 101, t, 5) for k, t in enumerate(TEXTS * 3)] + [(None, "no id", 1), (None, None, 1), (7, "twice", 0), (7, "twice", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = token_files.read(spark, token_files.write(docs), with_ids=True).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    at, tokenizer = 0, plain()
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    want = sorted(((d if d is not None else -1, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in got) == want


def test_order_of_equal_ids_is_that_of_their_content(spark):
    rows = [(7, t) for t in ("one", "two words here", "a b c d e f", "one", "", None)] + [(None, "x y"), (None, "z")]
    seen = set()
    for parts, turned in ((1, False), (1, True), (5, False)):
        docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").repartition(parts)
        got = token_files.read(spark, token_files.write(docs)).collect()
        seen.add(tuple(sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in got)))
    assert len(seen) == 1


def test_more_ids_than_sixteen_bits_number():
    rng = np.random.default_rng(6)
    counts = rng.integers(1, 1000, 150_000)
    lengths = token_files.code_lengths(counts, token_files.longest(len(counts)))
    limit, codes = int(lengths.max()), token_files.canonical(lengths)
    runs = [rng.integers(0, 150_000, n).astype(np.uint32) for n in (1, 256, 700)]
    made = token_files.encode_bits(runs, codes, lengths)
    n, size = np.array([len(r) for r in runs]), np.array([len(raw) for raw, _ in made])
    starts = np.concatenate([m + 8 * b for (_, m), b in zip(made, np.cumsum(size) - size)])
    data = np.frombuffer(b"".join(raw for raw, _ in made), np.uint8)
    got = token_files.decode_bits(data, starts, token_files._runs(n), token_files.decode_table(lengths, limit), limit)
    assert limit <= 19 and got.tolist() == np.concatenate(runs).tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(spark, token_files.write(docs)).collect() == []


def test_code_words_across_words_of_64_bits():
    rng = np.random.default_rng(8)
    lengths = token_files.code_lengths(np.array([int(1.6**k) + 1 for k in range(40)]), 19)
    codes = token_files.canonical(lengths)
    runs = [rng.integers(0, 40, n).astype(np.uint32) for n in (1, 2, 63, 256, 3000)] + [np.zeros(0, np.uint32), np.full(9, 39, np.uint32)]
    for run, (raw, marks) in zip(runs, token_files.encode_bits(runs, codes, lengths), strict=True):
        bits = "".join(f"{codes[i]:0{lengths[i]}b}" for i in run)
        assert raw == int(bits + "0" * (-len(bits) % 8) or "0", 2).to_bytes((len(bits) + 7) // 8, "big")
        assert marks.tolist() == [int(lengths[run[:k]].sum()) for k in range(0, len(run), 256)]


def test_forgotten_encoders_give_their_memory_back():
    def held():
        return int(open("/proc/self/status").read().split("RssAnon:")[1].split()[0]) >> 10

    tokens.encoder(tokens.vocabulary())([f"w{k}x{k * k} {k:x}" for k in range(200_000)])
    before = held()
    tokens.forget()
    assert not tokens._ENCODERS and before - held() > 30
