import base64

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandline.llm import attribution, tokens

TEXTS = ["one line", "two\nlines here", "\n\n\nx", "a\n", None, "", "x \n  y\n\n\n\nz é\n", "é\n字😀\n'll go\n", "w " * 4000 + "\n" + "q" * 3000]


def by_offsets(text, rule):
    """From the library's own character offsets, over characters' UTF-8 lengths."""
    tokenizer = Tokenizer.from_file(tokens.vocabulary())
    text = text or ""
    at = np.cumsum([0, *(len(c.encode()) for c in text)])
    edges = [0] + [int(at[i + 1]) for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)] + [int(at[-1])]
    counts = [0] * (len(edges) - 1)
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        a, b = int(at[a]), int(at[b])
        shares = [max(0, min(b, y) - max(a, x)) for x, y in zip(edges, edges[1:])]
        touched = [k for k, s in enumerate(shares) if s]
        counts[touched[0] if rule == "start" else shares.index(max(shares))] += 1
    return edges, counts


def test_against_the_librarys_offsets(spark):
    rows = [(k, t, 9, "n") for k, t in enumerate(TEXTS)] + [(None, "no id", 1, "n"), (1, TEXTS[1], 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section int, n_tokens string")
    for rule in attribution.RULES:
        got = attribution.section_tokens(docs, rule).collect()
        for k, text in enumerate(TEXTS):
            if text and any(ord(c) > 0x2FFF for c in text):
                continue  # a sign that is many tokens has the same character offsets in each
            edges, counts = by_offsets(text, rule)
            own = sorted({tuple(r)[1:] for r in got if r["doc_id"] == k})
            assert [r[1] for r in own] + [own[-1][2]] == edges and [r[3] for r in own] == counts
        assert sum(r["doc_id"] == 1 for r in got) == 4 and sum(r["doc_id"] is None for r in got) == 1


def by_ranks(text, edges, rule):
    """From the bytes of each of the library's ids, as another file of the same vocabulary states them."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        known = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, f)} | {50256: len("<|endoftext|>")}
    counts, at = [0] * (len(edges) - 1), 0
    for i in Tokenizer.from_file(tokens.vocabulary()).encode(text or "", add_special_tokens=False).ids:
        shares = [max(0, min(at + known[i], y) - max(at, x)) for x, y in zip(edges, edges[1:])]
        touched = [k for k, s in enumerate(shares) if s]
        counts[touched[0] if rule == "start" else shares.index(max(shares))] += 1
        at += known[i]
    assert at == edges[-1]
    return counts


def test_against_bytes_of_ids(spark):
    texts = [*TEXTS, "字字\n字😀 字\n\nx", "a <|endoftext|>\n b<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rule in attribution.RULES:
        got = attribution.section_tokens(docs, rule).collect()
        for k, text in enumerate(texts):
            own = sorted(tuple(r)[1:] for r in got if r["doc_id"] == k)
            edges = [r[1] for r in own] + [own[-1][2]]
            assert edges == np.cumsum([0, *(len(x.encode()) for x in (text or "").splitlines(keepends=True) or [""])]).tolist()
            assert [r[3] for r in own] == by_ranks(text, edges, rule), text


def test_fields_are_sections_of_one_document(spark):
    rows = [(1, "Title", "body of it", 3), (2, None, "alone", 3), (3, "字", "", 3), (None, None, None, 3), (1, "Title", "body of it", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, head string, text string, c0 int")
    for rule in attribution.RULES:
        got = attribution.field_tokens(docs, ["head", "text"], " ", rule).collect()
        assert len(got) == 10 and {r["field"] for r in got} == {"head", "text"}
        for doc, head, text, _ in rows[:4]:
            own = sorted({tuple(r)[1:] for r in got if r["doc_id"] == doc})
            whole, edges = f"{head or ''} {text or ''}", [0, len((head or "").encode()) + 1]
            edges.append(edges[1] + len((text or "").encode()))
            assert [(r[1], r[2]) for r in own] == list(zip(edges, edges[1:])) and [r[3] for r in own] == by_ranks(whole, edges, rule)


def test_rules_differ_on_a_crossing_token():
    widths, edges = np.array([2, 5, 1]), np.array([0, 3, 8])
    assert attribution.allocate(widths, edges, "start")[0].tolist() == [2, 1]
    assert attribution.allocate(widths, edges, "most")[0].tolist() == [1, 2]
    assert attribution.allocate(widths, edges, "most")[1].tolist() == [0, 1]


def test_empty_table(spark):
    assert attribution.section_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
