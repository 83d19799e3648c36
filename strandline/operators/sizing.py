"""Limits on what a report shows: lines of hunks and excerpts, records by priority, and a token budget.

Detail records are ranked once: by class, then the smaller first, then in the report's order. Keeping the first N of that
order is the same as taking away the largest record of the lowest class again and again. A budget holds at most budget * 4
bytes, so only a bounded head of the ranking reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import texts
from strandline.schemas import OMISSIONS

# How many omission rows are shown one by one.
DETAIL_ROWS = 20
#: Detail classes from the one that is kept longest to the one that goes first.
CLASSES = ["file", "changed_symbol", "deleted_symbol", "declaration_context", "moved_symbol", "removed_call", "entry_point", "node"]
#: No serialized detail record is shorter.
LEAST_RECORD = 16


NAMES = [f.split()[0] for f in OMISSIONS.split(", ")]
COUNTS = ("original_count", "emitted_count", "omitted_count")


@dataclass(frozen=True)
class Limits:
    max_lines_per_hunk: int = 0
    max_context_lines: int = 0
    max_records: int = 0
    budget_tokens: int = 0
    review_summary: bool = False

    def validate(self) -> None:
        if min(self.max_lines_per_hunk, self.max_context_lines, self.max_records, self.budget_tokens) < 0:
            raise ValueError("limits must not be negative")


def marshal_size(json: Column) -> Column:
    """Bytes of a JSON text when < > & and the two Unicode line separators are escaped."""
    text = lambda x: F.length(json) - F.length(F.replace(json, F.lit(x), F.lit("")))
    return F.octet_length(json) + 5 * (text("<") + text(">") + text("&")) + 3 * (text(" ") + text(" "))


def hunk_omissions(files: DataFrame, most: int) -> DataFrame:
    """A row for each shown file that has longer hunks, in diff order."""
    total = F.col("hunk_lines")
    gone = F.aggregate(F.transform("hunks", lambda h: F.greatest(F.size(h.lines) - most, F.lit(0))), F.lit(0), lambda a, x: a + x)
    rows = files.where("not compacted").withColumn("gone", gone).where("gone > 0")
    return rows.select(
        F.lit("hunk_lines").alias("kind"), F.lit("max_lines_per_hunk").alias("reason"), "path", F.lit("").alias("record_type"),
        total.cast("long").alias("original_count"), (total - F.col("gone")).cast("long").alias("emitted_count"),
        F.col("gone").cast("long").alias("omitted_count"), "diff_id", "file_ord",
    )


def limited_contexts(contexts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Contexts with at most `most` excerpt lines, and an omission row for each that got shorter."""
    own = F.size(texts.lines(F.col("excerpt.content")))
    cut = texts.excerpt(F.col("excerpt.content"), most)
    rows = contexts.withColumn("_own", own).withColumn("_cut", cut).withColumn("_before", F.col("excerpt.omitted_lines"))
    shorter = F.col("_cut.truncated")
    new = F.struct(
        F.when(shorter, F.col("_cut.content")).otherwise(F.col("excerpt.content")).alias("content"),
        (shorter | F.col("excerpt.truncated")).alias("truncated"), (F.col("_before") + F.col("_cut.omitted_lines")).alias("omitted_lines"),
    )
    shown = F.col("_own") - F.col("_cut.omitted_lines")
    omissions = rows.where(shorter).select(
        F.lit("context_lines").alias("kind"), F.lit("max_context_lines").alias("reason"), "path", F.col("relationship").alias("record_type"),
        (F.col("_own") + F.col("_before")).cast("long").alias("original_count"), shown.cast("long").alias("emitted_count"),
        (F.col("_own") + F.col("_before") - shown).cast("long").alias("omitted_count"), "id", "relationship", "related_to",
    )
    return rows.withColumn("excerpt", new).drop("_own", "_cut", "_before"), omissions


def rolled_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of omission rows by `keys`, in their order; the other texts are empty."""
    out = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
    for name in ("kind", "reason", "path", "record_type"):
        if name not in keys:
            out = out.withColumn(name, F.lit(""))
    return out.orderBy(*keys).select(NAMES)


@dataclass
class Omissions:
    """Omission rows in order: a few, then those of contexts by path, which may be many, then a few."""

    first: list[dict]
    rolled: DataFrame | None = None
    last: list[dict] = field(default_factory=list)

    def __iter__(self) -> Iterator[dict]:
        yield from self.first
        if self.rolled is not None:
            for r in self.rolled.toLocalIterator():
                yield r.asDict()
        yield from self.last


def shown_omissions(hunks: DataFrame | None, contexts: DataFrame | None) -> Omissions:
    """Omission rows as they are shown: up to DETAIL_ROWS of a kind one by one, else rolled up."""
    names = NAMES
    out: list[dict] = []
    late: list[dict] = []
    if hunks is not None:
        head = hunks.orderBy("diff_id", "file_ord").limit(DETAIL_ROWS + 1).select(names).collect()
        if len(head) <= DETAIL_ROWS:
            out += [r.asDict() for r in head]
        else:
            late = [r.asDict() for r in rolled_up(hunks, ["kind", "reason"]).collect()]
    if contexts is not None:
        head = contexts.orderBy("id", "relationship", "related_to").limit(DETAIL_ROWS + 1).select(names).collect()
        if len(head) <= DETAIL_ROWS:
            return Omissions(out + [r.asDict() for r in head] + late)
        return Omissions(out + late, rolled_up(contexts, ["kind", "reason", "path", "record_type"]))
    return Omissions(out + late)


def budget_omissions(given: list[dict] | Omissions) -> list[dict]:
    """Omission rows by kind and reason, and a row that says how many there were."""
    rolled = getattr(given, "rolled", None)
    rows, total = [*given.first, *given.last] if isinstance(given, Omissions) else given, 0
    if rolled is not None:  # a row for each kind and reason, and how many rows it stands for
        sums = rolled.groupBy("kind", "reason").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in COUNTS)).collect()
        total = sum(r["rows"] for r in sums)
        rows = rows + [omission(r["kind"], r["reason"], *(r[c] for c in COUNTS)) for r in sums]
        total -= len(sums)
    total += len(rows)
    if total <= 1:
        return [*given]
    groups: dict[tuple[str, str], dict] = {}
    for r in rows:
        if (r["kind"], r["reason"]) == ("omission_metadata", "budget_tokens"):
            continue
        own = groups.setdefault((r["kind"], r["reason"]), omission(r["kind"], r["reason"], 0, 0, 0))
        for c in COUNTS:
            own[c] += r[c]
    out = [groups[k] for k in sorted(groups)]
    if total > len(out):
        out.append(omission("omission_metadata", "budget_tokens", total, len(out) + 1, total - len(out) - 1))
    return out


def omission(kind: str, reason: str, original: int, emitted: int, omitted: int, path: str = "", record_type: str = "") -> dict:
    return {
        "kind": kind, "reason": reason, "path": path, "record_type": record_type, "original_count": original, "emitted_count": emitted,
        "omitted_count": omitted,
    }


def upserted(rows: list[dict], new: dict) -> list[dict]:
    key = lambda r: (r["kind"], r["reason"], r["path"], r["record_type"])
    out = [new if key(r) == key(new) else r for r in rows]
    return out if any(r is new for r in out) else [*out, new]


PRIORITY = ["class", "size", "ord", "k1", "k2", "k3"]


def top_records(details: DataFrame, most: int) -> DataFrame:
    """The `most` detail records that stay: by class, the smaller first, ties in report order."""
    return details.orderBy(*PRIORITY).limit(most)


def fit_budget(details: DataFrame, total: int, omissions: list[dict] | Omissions, budget: int, tokens_of) -> tuple[int, list[dict]]:
    """How many records fit, and the omission rows that go with them. `tokens_of(record bytes, count, omissions)`
    estimates the whole report. The most that could fit is bounded by the budget's bytes."""
    rows = budget_omissions(omissions)
    head = min(total, budget * 4 // LEAST_RECORD + 1)
    sizes = [r["bytes"] for r in details.orderBy(*PRIORITY).limit(head).select("bytes").collect()]
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    for n in reversed(range(len(sums))):
        own = upserted(rows, omission("records", "budget_tokens", total, n, total - n)) if total else rows
        if tokens_of(sums[n], n, own) <= budget:
            return n, own
    own = upserted(rows, omission("records", "budget_tokens", total, 0, total)) if total else rows
    while True:  # the floor's own row counts, too: until the estimate stays the same
        estimate = tokens_of(0, 0, own)
        more = budget_omissions(upserted(own, omission("budget", "budget_floor_exceeded", estimate, budget, estimate - budget)))
        if tokens_of(0, 0, more) == estimate:
            return 0, more
        own = more


def tokens(n_bytes: int) -> int:
    return math.ceil(n_bytes / 4)
