"""Command line: a change report of a Git repository as JSON lines or one JSON object."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Callable, Sequence
from typing import TextIO

from strandline.operators.filters import PathFilter
from strandline.operators.sizing import Limits
from strandline.schemas import SCHEMA_VERSION

NAME, VERSION = "strandline", "0.1.0"
SUPPORTED = ["go", "java"]


class Reported(Exception):
    """A problem that has been told already."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        print(message, file=sys.stderr)
        raise Reported(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog=NAME, description="Report what a change touches, from staged changes, a commit, or a range.", allow_abbrev=False)
    flag = lambda name, text: p.add_argument(name, action="store_true", help=text)
    flag("--fallback-to-head", "analyze HEAD when no commits are given, the worktree is clean and nothing is staged")
    flag("--best-effort", "emit partial records with warnings instead of failing on analysis gaps")
    flag("--review-summary", "emit a compact first-pass record")
    p.add_argument("--format", default="jsonl", help="jsonl or json")
    p.add_argument("--output", default="", help="write the report to a path instead of standard output")
    flag("--version", "print version metadata and exit")
    flag("--json", "print version metadata as JSON (with --version)")
    p.add_argument("--base", help="base revision of a range (needs --head)")
    p.add_argument("--head", help="head revision of a range (needs --base)")
    p.add_argument("--include", default="", help="only changed paths that match the glob")
    p.add_argument("--exclude", action="append", default=[], help="no changed paths that match the glob (repeatable)")
    flag("--exclude-vendor", "no vendored paths")
    flag("--changed-only", "context of changed files only")
    for name, text in (
        ("--max-lines-per-hunk", "changed lines shown of each hunk"), ("--max-context-lines", "lines shown of each context excerpt"),
        ("--max-records", "detail records after the summary"), ("--budget-tokens", "report size as ceil(serialized bytes / 4)"),
    ):
        p.add_argument(name, type=_whole, default=0, help=f"{text} (0: no limit)")
    p.add_argument("--repo", default=".", help="the repository (default: the current folder)")
    p.add_argument("commits", nargs="*")
    return p


TRUTHS = {x: True for x in ("1", "t", "T", "true", "TRUE", "True")} | {x: False for x in ("0", "f", "F", "false", "FALSE", "False")}


def split(known: argparse.ArgumentParser, argv: Sequence[str]) -> tuple[list[str], list[str]]:
    """Flags, with one dash or two, up to the first argument that is none or `--`; and the rest. `--flag=false` unsets."""
    switches = {a.option_strings[-1]: a.nargs == 0 for a in known._actions if a.option_strings}
    flags, rest = [], list(argv)
    while rest and rest[0].startswith("-") and rest[0] != "-":
        arg = rest.pop(0)
        if arg == "--":
            break
        name, sign, value = arg.partition("=")
        name = name if name.startswith("--") or name == "-h" else f"-{name}"
        if not switches.get(name, True):
            if not sign:
                if not rest:
                    known.error(f"{name} needs a value")
                value = rest.pop(0)
            flags.append(f"{name}={value}")
        elif sign and name in switches:
            if value not in TRUTHS:
                known.error(f"{name} takes true or false, not {value}")
            flags = [f for f in flags if f != name] + [name] * TRUTHS[value]
        else:
            flags.append(name + sign + value)
    return flags, rest


def _whole(text: str) -> int:
    return int(text, 0)


def revisions(args: argparse.Namespace) -> list[str]:
    named = any(x.lstrip("-").partition("=")[0] in ("base", "head") and x[:1] == "-" and x[:3] != "---" for x in args.commits)
    if named or args.base is not None or args.head is not None:
        if args.commits:
            raise ValueError("revisions are given twice: by --base and --head, and by position")
        if args.base is None or args.head is None:
            raise ValueError("--base needs --head, and --head needs --base")
        return [args.base, args.head]
    return args.commits


def version_info(repo: str = ".") -> dict:
    def ask(*command: str) -> str:
        try:
            return subprocess.run(["git", *command], cwd=repo, capture_output=True, text=True).stdout.strip()
        except OSError:
            return ""

    version = ask("describe", "--tags", "--abbrev=0", "--match", "v[0-9]*").removeprefix("v") or VERSION
    commit = ask("rev-parse", "--short=7", "HEAD") or "unknown"
    return {"name": NAME, "version": version, "commit": commit if commit == "unknown" else commit[:7], "schema_version": SCHEMA_VERSION, "supported_languages": SUPPORTED}


def write_version(out: TextIO, as_json: bool) -> None:
    info = version_info()
    if as_json:
        out.write(json.dumps(info, separators=(",", ":")) + "\n")
    else:
        out.write(f"{info['name']} {info['version']} (commit {info['commit']}, schema {info['schema_version']}; languages: {','.join(SUPPORTED)})\n")


def run(argv: Sequence[str], out: TextIO, new_app: Callable[[str], object] | None = None) -> None:
    known = parser()
    flags, positional = split(known, argv)
    args = known.parse_args(flags)
    args.commits = positional
    if args.version:
        return write_version(out, args.json)
    if args.json:
        raise ValueError("--json goes with --version only")
    commits = revisions(args)
    path_filter = PathFilter(args.include, tuple(args.exclude), args.exclude_vendor, args.changed_only)
    path_filter.validate()
    limits = Limits(args.max_lines_per_hunk, args.max_context_lines, args.max_records, args.budget_tokens, args.review_summary)
    limits.validate()
    from strandline.plans import app, report

    writers = {"": report.write_jsonl, "jsonl": report.write_jsonl, "json": report.write_json}
    if args.format not in writers:
        raise ValueError(f'there is no format "{args.format}": take jsonl or json')
    target = open(args.output, "w", encoding="utf-8", newline="\n") if args.output else out  # noqa: SIM115
    try:
        made = (new_app or _default_app)(args.repo).report(commits, args.fallback_to_head, app.Options(path_filter, limits, args.best_effort))
        writers[args.format](made, target, limits)
    finally:
        if target is not out:
            target.close()


def _default_app(repo: str):
    import os

    from pyspark.sql import SparkSession

    from strandline.plans.app import App

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH", "")]))
    spark = SparkSession.builder.appName(NAME).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return App(spark, os.path.abspath(repo))


def main(argv: Sequence[str] | None = None) -> int:
    try:
        run(sys.argv[1:] if argv is None else argv, sys.stdout)
    except Reported:
        return 1
    except Exception as failed:
        print(failed, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
