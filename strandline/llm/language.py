"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match from any place. A text is cut into phrases,
each as long as the automaton allows; a phrase costs the bits of a place in the labelled text. The language that needs the
fewest normalised phrases (bits a symbol) wins; ties go to the first in alphabetical order.

Texts are taken as runs of letters, in lower case, with one space between, and symbols are the bytes of their UTF-8 form:
so scripts with thousands of signs need no larger tables than others, and no sign is left out. A symbol that no labelled
text has ends the phrase that it stands in. Whole texts are parsed: segments of SEGMENT symbols are parsed in step, and each
is then set right for the phrase that comes into it. Learned from at most ROWS labelled rows a language (documented bound),
whole ones, until they have SYMBOLS symbols: those with the smallest hash of doc_id, then of the text, among texts of at most
CHARS code points, longer ones only where these are too few. Only rows that are not held out are learned from.

Defined results: a null text and one without a letter are `und` with score 0; without any labelled row every text is
`und`; repeated rows are returned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import code_points

ROWS, CHARS, SYMBOLS = 32, 2500, 48_000
#: Symbols of a segment, and of a block of segments, which bound a worker's memory.
SEGMENT, TOGETHER = 1024, 1 << 21
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for what is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(text: str | None) -> np.ndarray:
    """UTF-8 bytes of the lower-case letters, and of a space for each run of other signs between them."""
    letters = _letters()[code_points(text or "")]
    kept = letters != 0
    kept[1:] |= letters[:-1] != 0
    out = np.where(letters, letters, 32)[kept]
    out = out[:-1] if len(out) and out[-1] == 32 else out
    return np.frombuffer(out.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)


def _enough(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Whole texts from the first on until they have SYMBOLS symbols."""
    total = np.cumsum([0, *map(len, texts)])
    return texts[: int(np.searchsorted(total, SYMBOLS, "left"))]


class Automaton:
    """The suffix automaton of a sequence of classes 1 to `size` - 1. Class 0 is in no text.

    A state's moves stand in shared arrays: the move by class c at `base[state] + c`, which is its own if `owner` says so.
    """

    def __init__(self, sequence: list[int], size: int):
        links, lengths, moves = [-1], [0], [{}]
        last = 0
        for c in sequence:
            new = len(lengths)
            lengths.append(lengths[last] + 1)
            links.append(0)
            moves.append({})
            p, last = last, new
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = links[p]
            if p >= 0:
                q = moves[p][c]
                if lengths[q] == lengths[p] + 1:
                    links[new] = q
                else:
                    copy = len(lengths)
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = links[p]
                    links[q] = links[new] = copy
        self.root = np.zeros(size, np.int32)  # where a phrase begins
        for c, q in moves[0].items():
            self.root[c] = q
        self._place(moves, size)

    def _place(self, moves: list[dict[int, int]], size: int) -> None:
        used = bytearray(size * 4)
        base = np.zeros(len(moves), np.int64)
        at, found = size, {}
        for state in sorted((s for s, own in enumerate(moves) if len(own) > 1), key=lambda s: -len(moves[s])):
            classes, tries = list(moves[state]), 0
            while any(used[at + tries + c] for c in classes):
                tries += 1
                if at + tries + 2 * size > len(used):
                    used.extend(bytes(len(used)))
            found[state] = at + tries
            for c in classes:
                used[at + tries + c] = 1
            at += tries >> 3  # leave what is nearly full behind
            if at + 3 * size > len(used):
                used.extend(bytes(len(used)))
        single = [s for s, own in enumerate(moves) if len(own) == 1]
        free = np.flatnonzero(np.frombuffer(used, np.uint8)[size:] == 0)[: len(single)] + size
        free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
        for state, slot in zip(single, free.tolist(), strict=True):
            found[state] = slot - next(iter(moves[state]))
        for state, place in found.items():
            base[state] = place
        flat = np.array([(base[s] + c, s, q) for s, own in enumerate(moves) for c, q in own.items()] or [(0, -1, 0)], np.int64)
        room = int(max(flat[:, 0].max(), base.max())) + size + 1
        self.base, self.owner, self.target = base.astype(np.int32), np.full(room, -1, np.int32), np.zeros(room, np.int32)
        self.owner[flat[:, 0]], self.target[flat[:, 0]] = flat[:, 1], flat[:, 2]

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase ends before `c`, with which the next one begins."""
        at = self.base[state] + c
        goes_on = self.owner[at] == state
        return np.where(goes_on, self.target[at], self.root[c]), ~goes_on

    def parse(self, lanes: np.ndarray, sizes: np.ndarray, before: np.ndarray, state: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each lane, and the state at its end. `lanes`: a column a lane, longest first; `sizes`: their
        lengths; `before`: the lane that each one goes on from, -1 for none and -2 for one that goes on from `state`.

        All lanes are first parsed from the root. Then each that goes on is parsed again from where the one before it ended,
        only until both parses are in one state; if they never are, the lane's own end changes and the next one follows."""
        n, m = lanes.shape
        alive = np.searchsorted(-sizes, -np.arange(n), "left")
        states, ends = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        for k in range(n):
            a = int(alive[k])
            states[k + 1, :a], ended = self.step(states[k, :a], lanes[k, :a])
            ends[k + 1, :a] = ends[k, :a] + ended
        at = np.arange(m)
        last, count = states[sizes, at], ends[sizes, at]
        after = np.full(m, -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        todo = np.flatnonzero(before != -1)
        while len(todo):
            now = np.where(before[todo] == -2, state, last[np.maximum(before[todo], 0)]).astype(np.int32)
            own, mine, changed = todo, np.zeros(len(todo), np.int32), []
            for k in range(n + 1):
                done = k == sizes[own]
                if done.any():  # never in one state
                    old = last[own[done]]
                    count[own[done]], last[own[done]] = mine[done], now[done]
                    changed.append(own[done][old != now[done]])
                same = (now == states[k, own]) & ~done
                if same.any():
                    count[own[same]] = mine[same] + ends[sizes[own[same]], own[same]] - ends[k, own[same]]
                    old = last[own[same]]
                    last[own[same]] = states[sizes[own[same]], own[same]]
                    changed.append(own[same][old != last[own[same]]])
                left = ~(same | done)
                own, now, mine = own[left], now[left], mine[left]
                if not len(own):
                    break
                now, ended = self.step(now, lanes[k, own])
                mine = mine + ended
            todo = after[np.concatenate(changed)] if changed else np.zeros(0, np.int64)
            todo = np.unique(todo[todo >= 0])
        return count, last


class Model:
    """Automata by language over one alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        parts = {lang: _enough([symbols(t) for t in own]) for lang, own in texts.items()}
        parts = {lang: own for lang, own in parts.items() if any(map(len, own))}
        self.langs = sorted(parts)
        seen = np.unique(np.concatenate([x for own in parts.values() for x in own])) if parts else np.zeros(0, np.uint8)
        self.classes = np.zeros(256, np.uint8)  # 0: in no labelled text
        self.classes[seen] = np.arange(1, len(seen) + 1)  # UTF-8 uses 243 of 256 bytes at most
        size = len(seen) + 2
        self.automata, self.bits = [], []
        for lang in self.langs:
            sequence: list[int] = []
            for x in parts[lang]:
                sequence += [*self.classes[x].tolist(), size - 1]  # a class between texts that no text has
            self.automata.append(Automaton(sequence, size))
            self.bits.append(float(np.log2(len(sequence) + 1)))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows, of classes) in each language. Segments of texts are parsed in step, and blocks of at
        most TOGETHER symbols one after the other; a text goes on from block to block."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        blocks, total = [[]], 0
        for i, x in enumerate(texts):
            for a in range(0, len(x), SEGMENT):
                if total + SEGMENT > TOGETHER:
                    blocks.append([])
                    total = 0
                blocks[-1].append((i, a, min(SEGMENT, len(x) - a)))
                total += SEGMENT
            out[i] = len(x) > 0  # the phrase that the text's end cuts off
        carried = [0] * len(self.langs)
        for block in blocks:
            if not block:
                continue
            sizes = np.array([n for *_, n in block], np.int64)
            order = np.argsort(-sizes, kind="stable")
            where = np.empty(len(block), np.int64)
            where[order] = np.arange(len(block))
            grid = np.zeros((int(sizes.max()), len(block)), np.uint8)
            before = np.full(len(block), -1)
            for k, (i, a, n) in enumerate(block):
                grid[:n, where[k]] = texts[i][a : a + n]
                if a:
                    before[where[k]] = where[k - 1] if k else -2
            who = np.array([i for i, *_ in block])[order]
            for j, automaton in enumerate(self.automata):
                count, last = automaton.parse(grid, sizes[order], before, carried[j])
                np.add.at(out[:, j], who, count)
                carried[j] = int(last[where[-1]])
        return out

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of each text (rows) in each language, and each text's symbols."""
        made = [self.classes[symbols(t)] for t in texts]
        total = np.array([len(x) for x in made], np.int64)
        return self.phrases(made) * np.array(self.bits) / np.maximum(total, 1)[:, None], total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cost, total = self.costs(texts)
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(texts)), best]
        rest = cost.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1)
        score = np.where(np.isinf(second), 1.0, np.divide(second, low + second, out=np.ones(len(texts)), where=np.isfinite(second) & (second > 0)))
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)], [float(s) if n else 0.0 for s, n in zip(score, total, strict=True)]


def learn(docs: DataFrame, rows: int = ROWS) -> Model:
    """At most `rows` rows a language reach the driver."""
    order = [F.length("text") > CHARS, F.when(F.length("text") > CHARS, F.length("text")), F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out())
    labelled = labelled.where(F.length("text") > 0)
    ranked = labelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    picked: dict[str, list] = {}
    for r in ranked.where(F.col("rank") <= rows).select("lang", "rank", "text").collect():
        picked.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return Model({lang: [t for _, t in sorted(own)] for lang, own in picked.items()})


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))  # ROWS whole texts bound it, a language

    def start():
        own = shared.value

        def step(cols: dict) -> dict:
            lang, score = [], []
            for a in range(0, len(cols["text"]), 512):
                x, y = own.predict(cols["text"][a : a + 512])
                lang += x
                score += y
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": lang, "score": score}

        return step

    rows = docs.select("doc_id", common.held_out().alias("held_out"), "text")
    return common.map_columns(rows, "doc_id long, held_out boolean, lang_pred string, score double", start)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir))
