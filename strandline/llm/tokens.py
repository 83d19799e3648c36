"""Whole-text token ids with the tokenizers library, through a cache of pre-tokens.

A byte-level BPE cuts a text into pre-tokens (runs of letters, of digits, of other signs, each with at most one space
before it, contractions, and white space) and merges bytes within each alone. The cuts are found here for a whole batch
of texts with array operations; the library's model then encodes each pre-token that the worker has not met lately.
Texts with an apostrophe may hold contractions: the library's own pre-tokenizer cuts those. A text that holds the string of
an added token (an end-of-text mark, say) is encoded by the library whole, which gives that token's own id.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of one generation of a worker's cache (two are kept, some 250 MB), and the longest pre-token it keeps.
CACHE_ENTRIES, CACHE_CHARS = 550_000, 64
SPACE, LETTER, NUMBER, OTHER = range(4)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
        elif kind == "Z" or 9 <= c <= 13 or c == 0x85:
            out[c] = SPACE
    return out


@cache
def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte: itself if it is visible Latin-1, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class _PreTokens(dict):
    """From pre-token to its ids (little-endian, 4 bytes each). Two generations bound the size."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.old = model.tokenize, {}
        self.signs = _byte_signs()
        self.space = self.signs[0x20]

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            word = piece[1:] if piece[0] == " " else piece
            if word.isascii() and word.isalnum():
                signs = self.space + word if piece[0] == " " else word
            else:
                signs = piece.encode().decode("latin-1").translate(self.signs)
            out = array("I", [t.id for t in self.tokenize(signs)]).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; null and empty texts have none."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known = _PreTokens(self.tokenizer.model)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out, plain = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text and self.added is not None and self.added.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            elif text and "'" in text:
                spans = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
                out[i] = b"".join([self.known[text[s:e]] for _, (s, e) in spans])
            elif text:
                plain.append(i)
        for at in range(0, len(plain), 64):
            part = plain[at : at + 64]
            for i, ids in zip(part, self._plain([texts[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without contractions; none is empty."""
        whole = "".join(texts)
        first = np.cumsum([0, *map(len, texts)])
        points = code_points(whole)
        kind = _classes()[points]
        start = np.ones(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        # Of white space before something else, the last sign stands apart; if it is a space, it joins what follows.
        last = (kind[1:] != SPACE) & (kind[:-1] == SPACE)
        last[first[1:-1] - 1] = False
        at = np.flatnonzero(last)
        start[at] = True
        start[at + 1] = points[at] != 0x20
        start[first[:-1]] = True
        cuts = np.flatnonzero(start)
        owners = np.searchsorted(cuts, first).tolist()
        ends = cuts.tolist()
        ends.append(len(whole))
        known = self.known
        ids = [known[whole[s:e]] for s, e in zip(ends, ends[1:], strict=False)]
        return [b"".join(ids[s:e]) for s, e in zip(owners, owners[1:], strict=False)]

    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes of each id: a byte-level token has one sign a byte, an added token is plain text."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = len(token.content.encode())
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary; its cache serves later tasks, too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop this worker's encoders: a task that encodes no texts has no use for their caches."""
    _ENCODERS.clear()
