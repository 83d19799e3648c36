"""Symbols, calls and imports of source files: one pass of per-file extraction, then relational work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.operators import graph
from strandline.plans.report import Snapshot
from strandline.scratch import cut
from strandline.sources.syntax import golang, java
from strandline.sources.syntax.lexer import Extract, SyntaxProblem


class Extractor(Protocol):
    """What a language brings: which paths count as production code, and a file's declarations and calls."""

    def production(self, path: Column) -> Column: ...

    def extract(self, text: str) -> Extract: ...


@dataclass(frozen=True)
class Language:
    production: Callable[[Column], Column]
    extract: Callable[[str], Extract]


#: Extractors by language.
REGISTRY: dict[str, Language] = {
    "go": Language(lambda p: p.endswith(".go") & ~paths.is_test(p), golang.extract),
    "java": Language(lambda p: p.endswith(".java") & ~paths.is_java_test(p), java.extract),
}

ROWS = (
    "what string, path string, language string, package string, pos long, name string, kind string, start_line int, "
    "end_line int, body string, src string, target string"
)


#: An import line of Java. Files of other languages are looked through, too.
IMPORT = re.compile(r"^\s*import\s+(static\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:\.\*)?)\s*;", re.M | re.A)


class ExtractionError(ValueError):
    """A file that can't be read as its language."""


def production_sources(sources: DataFrame) -> DataFrame:
    """Sources of analysed languages outside of test scope, with their language."""
    path = F.col("path")
    language = F.lit(None).cast("string")
    for name, own in REGISTRY.items():
        language = F.when(own.production(path), name).otherwise(language)
    return sources.withColumn("language", language).where("language is not null")


def extracted(sources: DataFrame) -> DataFrame:
    """One row for each symbol, call, import and problem of (path, content, language) rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in ROWS.split(", ")]
        for frame in frames:
            out = []
            for path, content, language in zip(frame["path"], frame["content"], frame["language"], strict=True):
                try:
                    made = REGISTRY[language].extract(content or "")
                except SyntaxProblem:
                    out.append(("error", path, language, None, 0, f"parse {path}: syntax error", *[None] * 6))
                    continue
                for k, m in enumerate(IMPORT.finditer(content or "")):
                    out.append(("import", path, language, None, k, m[2], "static" if m[1] else "", *[None] * 5))
                for k, x in enumerate(made.symbols):
                    out.append(("symbol", path, language, made.package, k, x.name, x.kind, x.start_line, x.end_line, x.source, None, None))
                for k, c in enumerate(made.calls):
                    out.append(("call", path, language, made.package, k, None, None, c.line, None, c.code, c.src, c.target))
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    return sources.select("path", "content", "language").mapInPandas(run, ROWS)


def snapshot(sources: DataFrame) -> Snapshot:
    """The symbol table and call graph of (path, content) rows. Any file with a syntax problem fails the whole."""
    own = production_sources(sources.withColumn("content", F.col("content").cast("string")))
    rows = cut(extracted(own), "extracted")
    bad = rows.where("what = 'error'").agg(F.min_by("name", "path")).first()[0]
    if bad is not None:
        raise ExtractionError(bad)
    declared = rows.where("what = 'symbol'").select("name", "path", "kind", "start_line", "end_line", F.col("body").alias("source"), "pos")
    symbols = cut(graph.last_wins(declared), "symbols")
    refs = rows.where("what = 'call'").select(
        "path", "language", "package", F.col("pos").alias("seq"), "src", "target", F.col("path").alias("site_path"),
        F.col("start_line").alias("site_line"), F.col("body").alias("site_code"),
    )
    imported = rows.where("what = 'import'").select("path", F.col("pos").cast("int").alias("ord"), (F.col("kind") == "static").alias("is_static"), "name")
    edges = cut(graph.call_graph(refs, symbols, graph.imports(imported)), "edges")
    return Snapshot(symbols, edges)
