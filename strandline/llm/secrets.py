"""Secret scans with assignment-aware lexing.

Three base patterns find assigned credentials, access-key ids and long hexadecimal runs anywhere. Besides, texts whose
letters hold a sensitive name are lexed as source or configuration (lexing.py), which gives name-literal pairs; names that
stand for literals are constants, which are propagated through assignments and concatenations; a pair's score is the
target's sensitivity times how much its value looks like a secret. The literals of pairs at or above THRESHOLD, and those
of the constants in them, are spans of kind `literal`. Spans are in code points, end exclusive.

Defined results: null and empty texts have no spans; spans of one kind never overlap; a value of more than LONGEST signs is
none; a value of more than lexing.PARTS literals is scored by the first of them, and all are spans; repeated rows are
returned each; an empty table gives no rows; columns besides doc_id and text are ignored. Texts are scanned whole, in time
linear in their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, lexing

KINDS = ("assign", "access", "hex", "literal")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
THRESHOLD = 0.5
#: A longer value is data, not a secret.
LONGEST = 2048

# The base patterns, and parts of names by how sensitive they are.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, as runs are taken greedily
_NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "secretkey": 1.0, "authkey": 1.0, "encryptionkey": 1.0, "token": 0.9, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.9, "connectionstring": 0.8, "signature": 0.6, "salt": 0.6, "auth": 0.7,
}
_HARMLESS = {"name", "field", "label", "url", "uri", "path", "file", "length", "count", "size", "type", "policy", "expiry", "hint", "id"}
_HOLDERS = re.compile(r"(?i)^(change|replace|your|example|sample|dummy|test|todo|none|null|true|false|undefined|redacted|placeholder|xxx|\*+|<.*>$|\$\{.*\}$|\{\{.*\}\}$|%\w+%$)")
#: All that a text keeps whose sensitive names are looked for: letters, in lower case.
_NO_LETTERS = bytes(b for b in range(256) if not 97 <= b <= 122)
_ROOTS = [n.encode() for n in _NAMES if not any(m in n and m != n for m in _NAMES)]  # every other name holds one of these
_SPACE = re.compile(r"\s")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """How sensitive a target's name is: by its parts, alone and in pairs; a harmless last part takes it away."""
    parts = [p.lower() for p in _PARTS.findall(name.rpartition(".")[2])]
    if not parts or parts[-1] in _HARMLESS:
        return 0.0
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((_NAMES.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)


def plausibility(literal: str) -> float:
    """How much a literal looks like a secret: long enough, no placeholder, not prose, of many different signs."""
    if not LEAST_VALUE <= len(literal) <= LONGEST or _HOLDERS.match(literal) or _SPACE.search(literal):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(any(map(test, counts)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.35 + entropy / 8 + 0.1 * (kinds - 1)) if len(counts) > 2 else 0.0


def names_something(text: str) -> bool:
    """Whether the text's letters hold a sensitive name. No other text has a sensitive target."""
    letters = text.encode("utf-8", "surrogatepass").lower().translate(None, _NO_LETTERS)
    return any(name in letters for name in _ROOTS)


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that sensitive names stand for; of overlapping ones the first."""
    inner: list[tuple[int, int]] = []
    spans: set[tuple[int, int]] = set()
    for k, region in enumerate([(0, len(text)), None]):
        for begin, end in [region] if k == 0 else inner:
            found = lexing.pairs(text, begin, end, inner if k == 0 else None)
            weight_of = {name: sensitivity(name) for name in {name for name, _ in found}}
            if not any(weight_of.values()):
                continue
            weights = [weight_of[name] for name, _ in found]
            held, refs = lexing.resolve(found)
            known: dict[tuple, float] = {}
            marked = []
            for at, (weight, parts) in enumerate(zip(weights, held, strict=True)):
                if weight and sum(b - a for a, b in parts) <= LONGEST:
                    if parts not in known:
                        known[parts] = plausibility("".join([text[a:b] for a, b in parts]))
                    if weight * known[parts] >= THRESHOLD:
                        marked.append(at)
            spans |= lexing.reached(found, refs, marked)
    out, last = [], 0
    for a, b in sorted(spans):
        if a >= last and b > a:
            out.append((a, b))
            last = b
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then kind as listed."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if names_something(text):
        found += [(a, b, "literal") for a, b in literals(text)]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row a document: counts and digest of the base spans, and all spans."""
    common.tune(docs.sparkSession)

    def start():
        def step(cols: dict) -> dict:
            rows = []
            for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
                spans = scan(text)
                kinds = Counter(kind for _, _, kind in spans)
                base = told([s for s in spans if s[2] != "literal"])
                rows.append((doc, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(base.encode()).hexdigest(), told(spans)))
            names = [f.split()[0] for f in SCANNED.split(", ")]
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return step

    return common.map_columns(docs.select("doc_id", "text"), SCANNED, start)


MASK = "[SECRET]"


def redact(text: str | None) -> str | None:
    """The text with every span replaced by MASK; spans that touch or overlap become one."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at and not (out and a == at):
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with secrets masked in `text` and `n_chars`, if there is one, counted anew for them."""
    common.tune(docs.sparkSession)

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            old = common.column_of(batch, "text")
            new = [redact(x) for x in old]
            names = batch.schema.names
            batch = batch.set_column(names.index("text"), "text", pa.array(new, pa.string()))
            if "n_chars" in names:
                n = [n if a == b else len(b) for n, a, b in zip(common.column_of(batch, "n_chars"), old, new, strict=True)]
                kind = batch.schema.field("n_chars").type
                batch = batch.set_column(names.index("n_chars"), "n_chars", pa.array(n, kind))
            return batch

        return step

    return common.map_batches(docs, start)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(common.documents(spark, sf_dir))
