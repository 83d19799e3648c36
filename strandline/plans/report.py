"""The change report: from diff relations and two snapshots to typed records, and how they are written."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import compare, contexts as declarations, filters, impact, moves as moving, records, sizing
from strandline.operators.diffs import Changes
from strandline.operators.filters import PathFilter
from strandline.operators.sizing import Limits
from strandline.schemas import CALL_REFS, EDGES, SCHEMA_VERSION, SYMBOLS, WARNINGS
from strandline.scratch import cut

__all__ = ["CALL_REFS", "Report", "Snapshot", "build", "empty_snapshot", "write_json", "write_jsonl"]


@dataclass
class Snapshot:
    symbols: DataFrame  # name, path, kind, start_line, end_line, source
    edges: DataFrame  # src, dst, site_path, site_line, site_code


@dataclass
class Report:
    files: DataFrame
    changed: DataFrame
    deleted: DataFrame
    contexts: DataFrame
    moved: DataFrame
    removed: DataFrame
    entry_points: DataFrame
    nodes: DataFrame
    calls: DataFrame
    refs: DataFrame
    warnings: list[dict] = field(default_factory=list)


def empty_snapshot(spark: SparkSession) -> Snapshot:
    return Snapshot(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], EDGES))


def build(
    changes: Changes, added: DataFrame, current: Snapshot, base: Snapshot | None = None, options: PathFilter | None = None,
    workspace: DataFrame | None = None,
) -> Report:
    """Every relation of the report. Without a base snapshot nothing counts as moved, deleted or removed."""
    options = options or PathFilter()
    spark = added.sparkSession
    files = filters.filtered_files(changes.files, options)
    allowed = filters.allowed_paths(files)
    if options.active:
        added = filters.filtered_lines(added, allowed)
        changes = Changes(files, *[x.join(files.select("diff_id", "file_ord"), ["diff_id", "file_ord"], "left_semi") for x in (changes.hunks, changes.hunk_lines)])
    old = base or empty_snapshot(spark)
    moved = cut(moving.moved_symbols(current.symbols, old.symbols), "moves")
    added = moving.drop_moved_lines(added, moved)
    changes, omitted = moving.drop_moved_hunk_lines(changes, moved)
    facts = cut(records.file_facts(changes, omitted), "files")

    changed = cut(impact.changed_ranges(added, current.symbols), "changed")
    found = impact.impact(changed, current.edges, current.symbols)
    nodes = cut(impact.node_records(found.nodes, current.symbols, changed), "nodes")
    equal = moved.where("body_equal").select("name")
    report = Report(
        files=facts,
        changed=impact.changed_symbols(changed, current.symbols, moved),
        deleted=compare.deleted_symbols(current.symbols, old.symbols, moved),
        contexts=declarations.contexts(current.symbols, current.edges, changed, equal, facts.where("compacted").select("path")),
        moved=moved.select("from_id", "to_id", "body_equal"),
        removed=compare.removed_calls(current.symbols, current.edges, old.symbols, old.edges, moved),
        entry_points=compare.with_id(current.symbols).join(found.entry_points, "name", "left_semi").select("id"),
        nodes=nodes,
        calls=impact.node_calls(found.nodes, current.edges, current.symbols).join(nodes.select("name", "id"), "name"),
        refs=records.content_refs(facts, workspace),
    )
    if options.active:
        report = filters.prune(report, allowed, options.changed_only)
    for name in ("changed", "deleted", "contexts", "removed", "entry_points"):
        report = replace(report, **{name: cut(getattr(report, name), name)})
    return report


def summary(report: Report) -> DataFrame:
    return records.summary(report.files, report.changed, report.deleted, report.moved, report.removed, report.entry_points, report.nodes, report.contexts)


def _some(column: Column, nothing) -> Column:
    return F.when(column != nothing, column)


def _typed(kind: str, *columns: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), *columns))


def _plain(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def _file_columns(limit: int) -> list[Column]:
    compacted = F.col("compacted")
    hunks = records.limited(F.col("hunks"), limit)
    left_out = F.aggregate(F.transform(hunks, lambda h: F.coalesce(h.omitted_lines, F.lit(0))), F.lit(0), lambda a, x: a + x)
    preview = records.preview(F.col("added"))
    return [
        F.col("status"), _some(F.col("old_path"), "").alias("old_path"), F.col("path"), F.col("test"), _some(F.col("language"), "").alias("language"),
        F.col("classification"), records.change_intent(F.col("moved_lines_omitted")).alias("change_intent"),
        F.struct("added_lines", "deleted_lines", "added_bytes", "deleted_bytes").alias("diffstat"), F.col("symbols"), F.col("content_ref"),
        F.when(compacted, preview).alias("preview"), F.when(compacted, F.lit(True)).alias("hunks_omitted"),
        _some(F.when(compacted, F.col("hunk_lines")).otherwise(left_out), 0).alias("omitted_lines"),
        _some(F.col("moved_lines_omitted"), 0).alias("moved_lines_omitted"), F.when(~compacted, records.none_if_empty(hunks)).alias("hunks"),
    ]


def _ranges(name: str) -> Column:
    return records.none_if_empty(F.col(name)).alias(name)


def details(report: Report, limits: Limits) -> DataFrame:
    """Every detail record: its class, sort keys, JSON with and without a type, and the size that it is ranked by."""
    nothing = F.lit("")

    def rows(df: DataFrame, kind: str, typed: Column, plain: Column, size: Column, k1=nothing, k2=nothing, k3=nothing, ord=F.lit(0)) -> DataFrame:
        return df.select(
            F.lit(sizing.CLASSES.index(kind)).alias("class"), size.cast("long").alias("size"), ord.cast("long").alias("ord"), k1.alias("k1"), k2.alias("k2"),
            k3.alias("k3"), typed.alias("typed"), plain.alias("plain"),
        )

    files = report.files.join(records.file_symbols(report.nodes), "path", "left").join(report.refs, records.KEYS, "left")
    every = records.limited(F.col("hunks"), 0)
    bare = _plain(
        F.col("status"), _some(F.col("old_path"), "").alias("old_path"), F.col("path"), F.col("test"),
        _some(F.col("moved_lines_omitted"), 0).alias("moved_lines_omitted"), records.none_if_empty(every).alias("hunks"),
    )
    shape = _file_columns(limits.max_lines_per_hunk)
    out = rows(files, "file", _typed("file", *shape), _typed("file", *shape), sizing.marshal_size(bare), ord=F.col("diff_id") * (1 << 31) + F.col("file_ord"))

    identity = F.col("id").alias("id")
    for name, kind in (("changed", "changed_symbol"), ("deleted", "deleted_symbol"), ("entry_points", "entry_point")):
        text = F.regexp_replace(_plain(identity), r'^\{"id":(.*)\}\z', "$1")
        out = out.unionByName(rows(getattr(report, name), kind, _typed(kind, identity), text, F.octet_length("id"), F.col("id")))

    shown = report.contexts if not limits.max_context_lines else sizing.limited_contexts(report.contexts, limits.max_context_lines)[0]
    context = [
        F.col("id"), F.col("path"), F.col("name"), F.col("kind"), F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end")).alias("line_range"),
        F.col("relationship"), _some(F.col("related_to"), "").alias("related_to"), _ranges("changed_lines"), F.col("excerpt"),
    ]
    out = out.unionByName(
        rows(shown, "declaration_context", _typed("declaration_context", *context), _plain(*context), sizing.marshal_size(_plain(*context)), F.col("id"), F.col("relationship"), F.col("related_to"))
    )
    move = [F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.col("body_equal").alias("body_sha256_equal")]
    out = out.unionByName(rows(report.moved, "moved_symbol", _typed("moved_symbol", *move), _plain(*move), sizing.marshal_size(_plain(*move)), F.col("from_id"), F.col("to_id")))
    call = [F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.struct(F.col("site_path").alias("path"), F.col("site_line").alias("line")).alias("call_site")]
    out = out.unionByName(rows(report.removed, "removed_call", _typed("removed_call", *call), _plain(*call), sizing.marshal_size(_plain(*call)), F.col("from_id"), F.col("to_id")))

    site = F.struct(F.col("site_path").alias("path"), F.col("site_line").alias("line")).alias("call_site")
    calls = report.calls.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("to_id").alias("to"), site))).alias("calls"))
    node = [
        F.col("id"), F.col("path"), F.col("short").alias("name"), F.col("kind"), F.col("start_line"), F.col("end_line"), _ranges("calls"), F.col("changed"),
        _ranges("changed_lines"), F.col("package"),
    ]
    nodes = report.nodes.join(calls, "id", "left")
    return out.unionByName(rows(nodes, "node", _typed("node", *node), _plain(*node), sizing.marshal_size(_plain(*node)), F.col("id")))


def _compact(value) -> str:
    """JSON as the records are written: no spaces, no escapes beyond what JSON needs."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _summary_object(report: Report) -> dict:
    row = summary(report).first().asDict()
    out = {"schema_version": row["schema_version"]}
    out |= {k: row[k] for k in ("files", "test_files", "changed_symbols", "deleted_symbols", "moved_symbols", "removed_calls", "entry_points", "nodes")}
    return out | {"context_records": {k: row[k] for k in ("total", "declaration_context", "related_declaration_context")}}


def _summary_text(head: dict, omissions: Iterable[dict]) -> Iterator[str]:
    """The summary's JSON object piece by piece, with the omission rows at its end, if there are any."""
    yield _compact(head)[:-1]
    some = False
    for r in omissions:
        yield ("," if some else ',"omissions":[') + _compact({k: v for k, v in r.items() if v or k not in ("path", "record_type")})
        some = True
    yield "]}" if some else "}"


def _warning_objects(report: Report) -> list[dict]:
    return [{k: w.get(k) for k in ("code", "message", "path", "symbol") if k in ("code", "message") or w.get(k)} for w in report.warnings]


def review_files(report: Report) -> DataFrame:
    """Changed files with the ids of nodes on their path, in diff order."""
    joined = report.files.join(records.file_symbols(report.nodes), "path", "left")
    shown = F.struct(
        F.col("path"), _some(F.col("old_path"), "").alias("old_path"), F.col("status"), _some(F.col("language"), "").alias("language"), F.col("symbols")
    )
    return joined.select("test", "diff_id", "file_ord", F.to_json(shown).alias("json")).orderBy("diff_id", "file_ord")


def review_summary(report: Report) -> Iterator[str]:
    """The first-pass map of the whole report, before any limit: a JSON object without its first brace, piece by piece, so
    the driver holds one entry at a time."""
    yield f'"schema_version":"{SCHEMA_VERSION}"'
    files = review_files(report)
    call = F.to_json(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.struct(F.col("site_path").alias("path"), F.col("site_line").alias("line")).alias("call_site")))
    lists = [
        ("changed_production_files", (r["json"] for r in files.where("not test").toLocalIterator())),
        ("changed_test_files", (r["json"] for r in files.where("test").toLocalIterator())),
        ("changed_symbols", (_compact(r["id"]) for r in report.changed.orderBy("id").toLocalIterator())),
        ("deleted_symbols", (_compact(r["id"]) for r in report.deleted.orderBy("id").toLocalIterator())),
        ("risky_removed_call_edges", (r["json"] for r in report.removed.orderBy("from_id", "to_id").select(call.alias("json")).toLocalIterator())),
        ("unsupported_files", map(_compact, sorted({w["path"] for w in report.warnings if w["code"] == "unsupported_language" and w.get("path")}))),
    ]
    for name, entries in lists:
        some = False
        for entry in entries:
            yield f",{entry}" if some else f',"{name}":[{entry}'
            some = True
        if some:
            yield "]"
    yield "}"


@dataclass
class Sized:
    """What is written: the head (summary, review summary, warnings) and the detail records that stay."""

    summary: dict
    omissions: Iterable[dict]
    review: bool
    warnings: list[dict]
    details: DataFrame


def sized(report: Report, limits: Limits, form: str) -> Sized:
    """Apply the limits in their order: hunk lines, excerpts, omission roll-up, records, budget."""
    limits.validate()
    hunks = sizing.hunk_omissions(report.files, limits.max_lines_per_hunk) if limits.max_lines_per_hunk else None
    excerpts = sizing.limited_contexts(report.contexts, limits.max_context_lines)[1] if limits.max_context_lines else None
    omissions = sizing.shown_omissions(hunks, excerpts)
    rows = details(report, limits)
    total = None
    if limits.max_records:
        total = rows.count()
        if total > limits.max_records:
            rows = sizing.top_records(rows, limits.max_records)
            omissions.last.append(sizing.omission("records", "max_records", total, limits.max_records, total - limits.max_records))
            total = limits.max_records
    head = _summary_object(report)
    warnings = _warning_objects(report)
    if limits.budget_tokens:
        review = sum(len(x.encode()) for x in review_summary(report)) if limits.review_summary else None
        text = F.col("typed") if form == "jsonl" else F.col("plain")
        rows = cut(rows.withColumn("bytes", F.octet_length(text)), "details")
        shape = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_distinct("class").alias("classes")).first()
        classes = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}  # as many as classes

        def tokens_of(n_bytes: int, n: int, own: Iterable[dict]) -> int:
            frame = _frame_bytes(head, own, review, warnings, form)
            if form == "jsonl":
                return sizing.tokens(frame + n_bytes + n)
            used, left = 0, n  # commas between the records of a list: one fewer than there are
            for c in range(len(sizing.CLASSES)):
                here = min(left, classes.get(c, 0))
                used, left = used + max(0, here - 1), left - here
            return sizing.tokens(frame + n_bytes + used)

        if tokens_of(shape["bytes"], shape["n"], omissions) > limits.budget_tokens:
            kept, omissions = sizing.fit_budget(rows, shape["n"], omissions, limits.budget_tokens, tokens_of)
            rows = sizing.top_records(rows, kept)
    return Sized(head, omissions, limits.review_summary, warnings, rows)


LISTS = ["files", "changed_symbols", "deleted_symbols", "contexts", "moved_symbols", "removed_calls", "entry_points", "nodes"]


REVIEW = {"jsonl": '{"type":"review_summary",', "json": ',"review_summary":{'}


def _frame_bytes(head: dict, omissions: Iterable[dict], review: int | None, warnings: list[dict], form: str) -> int:
    """Bytes of everything but detail records and what separates them. `review`: bytes of the review summary, if any."""
    more = len(REVIEW[form]) + review if review is not None else 0
    if form == "jsonl":
        more += sum(len(_compact({"type": "warning"} | w).encode()) + 1 for w in warnings) + 1 + (review is not None)
        return sum(len(x.encode()) for x in _summary_text({"type": "summary"} | head, omissions)) + more
    own = _object_head(head) + _object_warnings(warnings) + "".join(f',"{name}":[]' for name in LISTS) + "}\n"
    return len(own.encode()) + sum(len(x.encode()) for x in _summary_text(head, omissions)) + more


def _object_head(head: dict) -> str:
    return f'{{"schema_version":{_compact(head["schema_version"])},"summary":'


def _object_warnings(warnings: list[dict]) -> str:
    return f',"warnings":{_compact(warnings)}' if warnings else ""


ORDER = ["class", "ord", "k1", "k2", "k3"]


def write_jsonl(report: Report, out: TextIO, limits: Limits | None = None) -> None:
    """One JSON object a line, in the fixed order of sections. Records stream through the driver one by one."""
    made = sized(report, limits or Limits(), "jsonl")
    out.writelines(_summary_text({"type": "summary"} | made.summary, made.omissions))
    out.write("\n")
    if made.review:
        out.write(REVIEW["jsonl"])
        out.writelines(review_summary(report))
        out.write("\n")
    for warning in made.warnings:
        out.write(_compact({"type": "warning"} | warning) + "\n")
    for r in made.details.orderBy(*ORDER).select("typed").toLocalIterator():
        out.write(r["typed"] + "\n")


def write_json(report: Report, out: TextIO, limits: Limits | None = None) -> None:
    """One JSON object with a list for each class of records; empty lists are written, too."""
    made = sized(report, limits or Limits(), "json")
    out.write(_object_head(made.summary))
    out.writelines(_summary_text(made.summary, made.omissions))
    if made.review:
        out.write(REVIEW["json"])
        out.writelines(review_summary(report))
    out.write(_object_warnings(made.warnings))
    at = -1
    for r in made.details.orderBy(*ORDER).select("class", "plain").toLocalIterator():
        comma = r["class"] == at
        while at < r["class"]:
            at += 1
            out.write(("]" if at else "") + f',"{LISTS[at]}":[')
        out.write(("," if comma else "") + r["plain"])
    while at < len(LISTS) - 1:
        at += 1
        out.write(("]" if at else "") + f',"{LISTS[at]}":[')
    out.write("]}\n")


def write_records(report: Report, path: str, limits: Limits | None = None) -> None:
    """Detail records as text files in order, written by the executors; for reports too long for one file."""
    made = sized(report, limits or Limits(), "jsonl")
    made.details.orderBy(*ORDER).select("typed").write.text(path)


def warnings_of(files: DataFrame) -> list[dict]:
    rows = records.unsupported(files).orderBy("diff_id", "file_ord")
    names = [f.split()[0] for f in WARNINGS.split(", ")]
    return [{k: r[k] for k in names} for r in rows.toLocalIterator()]
