"""Git access: diffs and worktree state on the driver, file contents in parallel."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.schemas import DIFFS

#: Files that one task reads from Git.
CHUNK = 200
#: Directories that neither snapshot looks into.
SKIPPED = [".git", "vendor"]


class GitError(RuntimeError):
    """A Git command that failed, with what it said."""


def git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", *args], cwd=repo, capture_output=True)
    if done.returncode:
        raise GitError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def diff_arguments(commits: list[str], include_formatting: bool = False) -> list[str]:
    """No commit: what is staged; one: it against its parent; two: one against the other."""
    out = ["diff", "--no-ext-diff", "--unified=0"]
    if not include_formatting:
        out += ["--ignore-all-space", "--ignore-blank-lines"]
    if not commits:
        return [*out, "--staged"]
    if len(commits) == 1:
        return [*out, f"{commits[0]}^", commits[0]]
    if len(commits) == 2:
        return [*out, *commits]
    raise ValueError(f"a diff is of at most two commits, not of {len(commits)}")


def diff(spark: SparkSession, repo: str, commits: list[str], include_formatting: bool = False) -> DataFrame:
    text = git(repo, *diff_arguments(commits, include_formatting)).decode(errors="replace")
    return spark.createDataFrame([(0, text)], DIFFS)


def has_staged(repo: str) -> bool:
    return bool(git(repo, "diff", "--staged", "--name-only").strip())


def has_unstaged(repo: str) -> bool:
    """Changes that are not staged, and files that Git doesn't know."""
    lines = git(repo, "status", "--porcelain", "--untracked-files=normal").decode(errors="replace").splitlines()
    return any(line.startswith("??") or line[1:2] not in ("", " ") for line in lines)


def skipped(path, folders: list[str] = SKIPPED):
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(parts, F.array(*map(F.lit, folders)))


def worktree(spark: SparkSession, repo: str, folders: list[str] = SKIPPED, names: str = "*") -> DataFrame:
    """(path, content) of the files below a folder, without those below `folders`: Git's own and vendored ones. Files whose
    names don't match the glob `names` are not listed, and files of skipped folders not opened: the filter on Spark's own
    path column comes before contents are read."""
    root = repo.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names)
    files = read.load(root if "://" in root else f"file://{root}")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    inside = F.substr(plain, F.lit(len(base) + 1))
    return files.where(~skipped(inside, folders)).select(inside.alias("path"), "content")


def sources(spark: SparkSession, repo: str) -> DataFrame:
    """The worktree's files of analysed languages."""
    return worktree(spark, repo, names="*.{go,java}")


def opened(spark: SparkSession, repo: str, paths: DataFrame) -> DataFrame:
    """(path, content) of the files named in `paths`; those that the worktree lacks, or that lie outside of it, are left out.
    Only these are read."""
    if "://" in repo:
        return worktree(spark, repo, [".git"]).join(paths.select("path").distinct(), "path", "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                inside = os.path.normpath(path)
                if os.path.isabs(inside) or inside.split(os.sep)[0] in ("..", ".git"):
                    continue
                try:
                    with open(os.path.join(repo, inside), "rb") as f:
                        out.append((path, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["path", "content"])

    return paths.select("path").distinct().mapInPandas(run, "path string, content binary")


def at_ref(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """(path, content) of a commit's production files; contents come from one Git process for each chunk of paths."""
    listed = git(repo, "ls-tree", "-r", "--name-only", "-z", ref).decode(errors="replace").split("\0")
    paths = [p for p in listed if p and p.endswith((".go", ".java"))]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").where(~skipped(F.col("path")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            asked = "".join(f"{ref}:{p}\n" for p in frame["path"]).encode()
            done = subprocess.run(["git", "cat-file", "--batch"], cwd=repo, input=asked, capture_output=True)
            if done.returncode:
                raise GitError(f"git cat-file failed: {done.stderr.decode(errors='replace').strip()}")
            data, at, out = done.stdout, 0, []
            for path in frame["path"]:
                end = data.index(b"\n", at)
                head = data[at:end].split()
                if head[-1] == b"missing":
                    raise GitError(f"{ref} has no {path}")
                size = int(head[2])
                out.append((path, data[end + 1 : end + 1 + size]))
                at = end + 2 + size
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.repartition(max(1, -(-len(paths) // CHUNK))).mapInPandas(run, "path string, content binary")
