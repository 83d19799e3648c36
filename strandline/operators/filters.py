"""Path filters on changed files, and what they prune from derived records."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import names, paths


@dataclass(frozen=True)
class PathFilter:
    include: str = ""
    excludes: tuple[str, ...] = field(default_factory=tuple)
    exclude_vendor: bool = False
    changed_only: bool = False

    @property
    def active(self) -> bool:
        return bool(self.include or self.excludes or self.exclude_vendor or self.changed_only)

    def validate(self) -> None:
        for flag, pattern in [("include", self.include)] * bool(self.include) + [("exclude", x) for x in self.excludes]:
            try:
                paths.glob_regex(pattern)
            except paths.BadPattern as bad:
                raise paths.BadPattern(f'the pattern "{pattern}" of --{flag} is malformed: {bad}') from None


def filter_paths(files: DataFrame):
    """The cleaned, non-empty paths that a file is filtered by: its own and its old one."""
    both = F.array(paths.clean_report_path(F.col("path")), paths.clean_report_path(F.coalesce("old_path", F.lit(""))))
    return F.filter(F.array_distinct(both), lambda p: p != "")


def filtered_files(files: DataFrame, options: PathFilter) -> DataFrame:
    """Files that pass: any path matches `include`, none is vendored or matches an exclude."""
    if not options.active:
        return files
    own = filter_paths(files)
    keep = F.size(own) > 0
    if options.include:
        keep &= F.exists(own, partial(paths.glob_match, options.include))
    if options.exclude_vendor:
        keep &= ~F.exists(own, paths.is_vendor)
    for pattern in options.excludes:
        keep &= ~F.exists(own, partial(paths.glob_match, pattern))
    return files.where(keep)


def allowed_paths(files: DataFrame) -> DataFrame:
    """(path): cleaned paths of the files."""
    return files.select(F.explode(filter_paths(files)).alias("path")).distinct()


def filtered_lines(added: DataFrame, allowed: DataFrame) -> DataFrame:
    clean = paths.clean_report_path(F.col("path"))
    return added.withColumn("_clean", clean).join(allowed.select(F.col("path").alias("_clean")), "_clean", "left_semi").drop("_clean")


def _flag(rows: DataFrame, path, allowed: DataFrame, name: str) -> DataFrame:
    """Whether a path column's cleaned value is allowed."""
    marks = allowed.select(F.col("path").alias(f"{name}_key"), F.lit(True).alias(name))
    joined = rows.withColumn(f"{name}_at", paths.clean_report_path(path)).join(marks, F.col(f"{name}_at") == F.col(f"{name}_key"), "left")
    return joined.drop(f"{name}_at", f"{name}_key").withColumn(name, F.coalesce(name, F.lit(False)))


def _ids(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    return _flag(rows, names.id_path(F.col("id")), allowed, "_ok").where("_ok").drop("_ok")


def prune(report, allowed: DataFrame, changed_only: bool):
    """The report without derived records that no allowed path explains. `report`: plans.report.Report."""
    changed, deleted = _ids(report.changed, allowed), _ids(report.deleted, allowed)
    moved = _flag(_flag(report.moved, names.id_path(F.col("from_id")), allowed, "_f"), names.id_path(F.col("to_id")), allowed, "_t")
    moved = moved.where("_f or _t").drop("_f", "_t")
    removed = _flag(_flag(report.removed, names.id_path(F.col("from_id")), allowed, "_f"), names.id_path(F.col("to_id")), allowed, "_t")
    removed = _flag(removed, F.col("site_path"), allowed, "_s").where("_f or _t or _s").drop("_f", "_t", "_s")
    contexts = _flag(_flag(report.contexts, F.col("path"), allowed, "_own"), names.id_path(F.col("related_to")), allowed, "_rel")
    contexts = contexts.where("_own and (related_to = '' or _rel)" if changed_only else "_own or _rel").drop("_own", "_rel")
    nodes, calls = report.nodes, report.calls
    if changed_only:
        nodes = _flag(nodes, F.col("path"), allowed, "_ok").where("_ok").drop("_ok")
        calls = _flag(calls, F.col("site_path"), allowed, "_ok").where("_ok").drop("_ok")
    known = [changed, moved.select(F.col("from_id").alias("id")), moved.select(F.col("to_id").alias("id")), contexts.select("id"), nodes.select("id")]
    if changed_only:
        known.append(deleted)
    ids = known[0].select("id")
    for more in known[1:]:
        ids = ids.unionByName(more.select("id"))
    ids = ids.distinct()
    calls = calls.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    entry = report.entry_points.join(ids, "id", "left_semi")
    if changed_only:
        entry = _ids(entry, allowed)
    return replace(
        report, changed=changed, deleted=deleted, moved=moved, removed=removed, contexts=contexts, nodes=nodes, calls=calls, entry_points=entry
    )
