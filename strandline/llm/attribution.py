"""Token counts of sections or fields, by the offsets of tokens of the whole document.

A document is encoded once. Each token's place follows from the bytes of the tokens before it; sections are the lines of
the text (a section holds its line and the line feed after it), or the document's fields, joined by a separator that
belongs to the field before it. Either way they cover the text without gaps. Tokens are joined to
sections by interval: a token inside one section counts there; one that crosses a boundary is allocated by `rule`:
`start` to the section of its first byte, `most` to the section that holds most of its bytes (the first of equals).

Defined results: null and empty texts have one section without tokens; a text's trailing line feed opens no section;
a null field is empty; repeated rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

RULES = ("start", "most")
COUNTED = "doc_id long, section int, byte_start long, byte_end long, n_tokens long, crossing long"


def sections(text: str | None) -> np.ndarray:
    """Byte offsets at which the sections begin, and the end of the last."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    feeds = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], feeds[feeds < len(data)], [len(data)]])


def allocate(widths: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross one of its boundaries. `widths`: bytes of each token."""
    end = np.cumsum(widths)
    start = end - widths
    n = len(edges) - 1
    first = np.searchsorted(edges, start, "right") - 1
    last = np.searchsorted(edges, np.maximum(end - 1, start), "right") - 1
    first, last = np.minimum(first, n - 1), np.minimum(last, n - 1)
    owner = first.copy()
    across = np.flatnonzero(first != last)
    if rule == "most":
        for k in across.tolist():
            own = np.arange(first[k], last[k] + 1)
            share = np.minimum(edges[own + 1], end[k]) - np.maximum(edges[own], start[k])
            owner[k] = own[share.argmax()]
    return np.bincount(owner, minlength=n), np.bincount(owner[across], minlength=n)


def _counted(docs: DataFrame, columns: list[str], split, rule: str, vocabulary: str | None) -> DataFrame:
    """`split` gives, from the values of a row's columns, the whole text and the edges of its sections."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or tokens.vocabulary()
    common.tune(docs.sparkSession)

    def start():
        encode = tokens.encoder(path)
        widths = encode.byte_lengths()

        def step(cols: dict) -> dict:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            docs_of = []
            made = [split(*x) for x in zip(*(cols[f"c{k}"] for k in range(len(columns))), strict=True)]
            for doc, (_, edges), raw in zip(cols["doc_id"], made, encode([text for text, _ in made]), strict=True):
                counts, crossing = allocate(widths[np.frombuffer(raw, "<u4")], edges, rule)
                docs_of += [doc] * len(counts)
                for into, x in zip(parts, (np.arange(len(counts)), edges[:-1], edges[1:], counts, crossing), strict=True):
                    into.append(x)
            names = [f.split()[0] for f in COUNTED.split(", ")][1:]
            return {"doc_id": docs_of} | {k: np.concatenate(x).tolist() for k, x in zip(names, parts, strict=True)}

        return step

    return common.map_columns(docs.select("doc_id", *(F.col(c).alias(f"c{k}") for k, c in enumerate(columns))), COUNTED, start)


def section_tokens(docs: DataFrame, rule: str = "most", vocabulary: str | None = None) -> DataFrame:
    """One row a section: its byte span, its tokens, and those of them that cross a boundary."""
    return _counted(docs, ["text"], lambda text: (text, sections(text)), rule, vocabulary)


def field_tokens(docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "most", vocabulary: str | None = None) -> DataFrame:
    """One row a field of each document, whose text is the fields in turn: `field`, its byte span, tokens and crossing ones."""

    def split(*values: str | None) -> tuple[str, np.ndarray]:
        own = [(x or "") + separator * (k < len(values) - 1) for k, x in enumerate(values)]
        return "".join(own), np.cumsum([0, *(len(x.encode("utf-8", "surrogatepass")) for x in own)])

    made = _counted(docs, fields, split, rule, vocabulary)
    return made.select("doc_id", F.element_at(F.array(*map(F.lit, fields)), F.col("section") + 1).alias("field"), *made.columns[2:])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(common.documents(spark, sf_dir))
