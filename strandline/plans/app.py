"""From a repository and revisions to a report: what is compared, how strictly, and with which sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import diffs, filters
from strandline.operators.filters import PathFilter
from strandline.operators.sizing import Limits
from strandline.plans import report as reports
from strandline.plans.report import Report, Snapshot
from strandline.sources import extract, git


class Refused(RuntimeError):
    """A request that strict analysis doesn't answer."""


@dataclass
class Options:
    path_filter: PathFilter = field(default_factory=PathFilter)
    limits: Limits = field(default_factory=Limits)
    best_effort: bool = False


@dataclass
class App:
    """Each access to Git and to files can be replaced."""

    spark: SparkSession
    repo: str = "."
    has_staged: Callable[[], bool] | None = None
    has_unstaged: Callable[[], bool] | None = None
    inspect: Callable[[list[str]], DataFrame] | None = None
    current: Callable[[], Snapshot] | None = None
    base: Callable[[str], Snapshot] | None = None
    workspace: Callable[[DataFrame], DataFrame | None] | None = None

    def __post_init__(self) -> None:
        self.has_staged = self.has_staged or (lambda: git.has_staged(self.repo))
        self.has_unstaged = self.has_unstaged or (lambda: git.has_unstaged(self.repo))
        self.inspect = self.inspect or (lambda commits: git.diff(self.spark, self.repo, commits))
        self.current = self.current or (lambda: extract.snapshot(git.sources(self.spark, self.repo)))
        self.base = self.base or (lambda ref: extract.snapshot(git.at_ref(self.spark, self.repo, ref)))
        self.workspace = self.workspace or (lambda paths: git.opened(self.spark, self.repo, paths))

    def resolve(self, commits: list[str], fallback_to_head: bool) -> list[str]:
        """Without commits: what is staged, else HEAD if that is asked for and the worktree is clean."""
        if commits or not fallback_to_head or self.has_staged():
            return commits
        if self.has_unstaged():
            raise Refused(
                "HEAD is not taken while changes are unstaged or files untracked: stage, commit or stash them, or name a commit or a range"
            )
        return ["HEAD"]

    def report(self, commits: list[str], fallback_to_head: bool = False, options: Options | None = None) -> Report:
        options = options or Options()
        commits = self.resolve(commits, fallback_to_head)
        options.path_filter.validate()
        options.limits.validate()
        lines = diffs.diff_lines(self.inspect(commits)).cache()
        changes = diffs.changes(lines)
        kept = filters.filtered_files(changes.files, options.path_filter)
        if kept.isEmpty():  # neither snapshot is looked at
            nothing = reports.empty_snapshot(self.spark)
            none = diffs.Changes(changes.files.limit(0), changes.hunks.limit(0), changes.hunk_lines.limit(0))
            return reports.build(none, diffs.added_lines(lines).limit(0), nothing, nothing)
        warnings = reports.warnings_of(kept)
        if warnings and not options.best_effort:
            raise Refused(
                f"{warnings[0]['path']} is in a language that is not analysed; --best-effort reports the rest, with warnings"
            )
        current, base, more = self.snapshots(base_ref(commits), options.best_effort)
        made = reports.build(changes, diffs.added_lines(lines), current, base, options.path_filter, self.workspace(kept.select("path")))
        made.warnings = warnings + more
        return made

    def snapshots(self, ref: str, best_effort: bool) -> tuple[Snapshot, Snapshot, list[dict]]:
        """Both snapshots. With best effort a failed one is empty, and both are if the current one failed, as else all of
        the base would seem deleted."""
        nothing = reports.empty_snapshot(self.spark)
        made, warnings = {}, []
        for which, load in (("current", self.current), ("base", lambda: self.base(ref))):
            try:
                made[which] = load()
            except (extract.ExtractionError, git.GitError, OSError) as failed:
                if not best_effort:
                    raise
                warnings.append(failure(which, failed))
        if "current" not in made:
            return nothing, nothing, warnings
        return made["current"], made.get("base", nothing), warnings


def failure(which: str, failed: Exception) -> dict:
    """A warning for a snapshot that could not be built, with the path that its message names."""
    text = str(failed)
    parse = text.startswith("parse ") or ": syntax error" in text
    path = text.removeprefix("parse ").partition(":")[0] if text.startswith("parse ") and ":" in text else None
    return {"code": "parse_error" if parse else "graph_build_failed", "message": f"{which} graph build failed: {text}", "path": path, "symbol": None}


def base_ref(commits: list[str]) -> str:
    """What a request compares against: HEAD for staged changes, a commit's parent, or a range's start."""
    if not commits:
        return "HEAD"
    return f"{commits[0]}^" if len(commits) == 1 else commits[0]
