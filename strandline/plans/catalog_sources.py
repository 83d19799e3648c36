"""Queries over source texts that are written from parts by a rule, and over Java names, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.plans.derived import relation, with_
from strandline.plans.queries import many, query
from strandline.sources import extract

# One file a part: {k} is its key, {a} and {b} its key's remainders; a comment of `size` lines comes first.
GO = """package pkg{a}

import "fmt"

func F{k}() {
\tG{b}()
\tfmt.Println(T{b}{})
}

type T{b} struct{ n int }

func (t *T{b}) M{k}() {
\tT{b}{}.M{k}()
\tt.Run()
}
"""
JAVA = """package com.p{a};

import com.lib.L{b};
import static com.lib.U.u{b};
import bare;
import com.wild{b}.*;

class C{k} {
  C{k}() {}
  int m(int x) {
    L{b}.go();
    return n(x);
  }
  int n(int x) { return x; }
}
"""


def _sources(spark, sf_dir, template: str, folder: str, ending: str) -> DataFrame:
    """(path, content): the template filled in for each part, below a comment."""
    rows = relation(spark, sf_dir, "code")
    content = F.lit(template)
    for mark, column in (("{k}", "n"), ("{a}", "a"), ("{b}", "b")):
        content = F.replace(content, F.lit(mark), F.col(column))
    comment = F.repeat(F.lit("// line { of\n"), F.col("size"))
    return rows.select(F.concat(F.lit(folder), "n", F.lit(ending)).alias("path"), F.concat(comment, content).alias("content"))


def _extracted(spark, sf_dir, *which: str) -> DataFrame:
    rows = extract.extracted(extract.production_sources(_sources(spark, sf_dir, *which)))
    return rows.select("path", "what", "package", "pos", "name", "kind", "start_line", "end_line", "src", "target")


def _twin(path: str, package: str, rows: list[tuple]) -> str:
    """`rows`: what, pos, name, kind, first line, last line, src, target, as SQL over `code`."""
    parts = [
        f"SELECT '{path[0]}' || n || '{path[1]}' AS path, '{what}' AS what, {'NULL' if what == 'import' else package} AS package, CAST({pos} AS BIGINT) AS pos, "
        f"{name} AS name, {kind} AS kind, CAST({first} AS INT) AS start_line, CAST({last} AS INT) AS end_line, {src} AS src, {target} AS target FROM code"
        for what, pos, name, kind, first, last, src, target in rows
    ]
    return with_("code") + " " + " UNION ALL ".join(parts)


_GO_F, _GO_M = "'pkg' || a || '.F' || n", "'pkg' || a || '.T' || b || '.M' || n"


@query(_twin(("go/f", ".go"), "'pkg' || a", [
    ("symbol", 0, _GO_F, "'function_declaration'", "size + 5", "size + 8", "NULL", "NULL"),
    ("symbol", 1, _GO_M, "'method_declaration'", "size + 12", "size + 15", "NULL", "NULL"),
    ("call", 0, "NULL", "NULL", "size + 6", "NULL", _GO_F, "'G' || b"),
    ("call", 1, "NULL", "NULL", "size + 13", "NULL", _GO_M, "'T' || b || '.M' || n"),
    ("call", 2, "NULL", "NULL", "size + 14", "NULL", _GO_M, "'Run'"),
]))
def extract_go_symbols(spark, sf_dir):
    return _extracted(spark, sf_dir, GO, "go/f", ".go")


_JAVA_C = "'com.p' || a || '.C' || n"


@query(_twin(("java/C", ".java"), "'com.p' || a", [
    ("import", 0, "'com.lib.L' || b", "''", "NULL", "NULL", "NULL", "NULL"),
    ("import", 1, "'com.lib.U.u' || b", "'static'", "NULL", "NULL", "NULL", "NULL"),
    ("import", 2, "'bare'", "''", "NULL", "NULL", "NULL", "NULL"),
    ("import", 3, "'com.wild' || b || '.*'", "''", "NULL", "NULL", "NULL", "NULL"),
    ("symbol", 0, _JAVA_C, "'class_declaration'", "size + 8", "size + 15", "NULL", "NULL"),
    ("symbol", 1, f"{_JAVA_C} || '.<init>'", "'constructor_declaration'", "size + 9", "size + 9", "NULL", "NULL"),
    ("symbol", 2, f"{_JAVA_C} || '.m'", "'method_declaration'", "size + 10", "size + 13", "NULL", "NULL"),
    ("symbol", 3, f"{_JAVA_C} || '.n'", "'method_declaration'", "size + 14", "size + 14", "NULL", "NULL"),
    ("call", 0, "NULL", "NULL", "size + 11", "NULL", f"{_JAVA_C} || '.m'", "'L' || b || '.go'"),
    ("call", 1, "NULL", "NULL", "size + 12", "NULL", f"{_JAVA_C} || '.m'", "'C' || n || '.n'"),
]))
def extract_java_calls(spark, sf_dir):
    return _extracted(spark, sf_dir, JAVA, "java/C", ".java")


@query(with_("code") + """ SELECT 'java/C' || n || '.java' AS path, false AS is_static, false AS is_wildcard, 'com.lib' AS owner, 'L' || b AS short, 0 AS ord FROM code
UNION ALL SELECT 'java/C' || n || '.java', true, false, 'com.lib.U', 'u' || b, 1 FROM code
UNION ALL SELECT 'java/C' || n || '.java', false, true, 'com.wild' || b, NULL, 3 FROM code""")
def java_import_rows(spark, sf_dir):
    return graph.java_imports(_sources(spark, sf_dir, JAVA, "java/C", ".java")).select("path", "is_static", "is_wildcard", "owner", "short", "ord")


#: The first of the names that a call may mean, asked for one by one.
JAVA_TWIN = with_("java_symbols", "java_refs", "java_imports") + """,
symbols AS (SELECT DISTINCT name FROM java_symbols), types AS (SELECT DISTINCT name FROM java_symbols WHERE kind = 'class_declaration'),
calls AS (SELECT DISTINCT src, target, package, path, contains(target, '.') AS dotted, regexp_replace(target, '[.][^.]*$', '') AS receiver,
  string_split(target, '.')[-1] AS method, string_split(src, '.')[-2] AS owner FROM java_refs),
fixed AS (SELECT c.*, a.name AS in_package, b.name AS as_is FROM calls c LEFT JOIN symbols a ON a.name = c.package || '.' || c.target
  LEFT JOIN symbols b ON b.name = c.target),
open AS (SELECT * FROM fixed WHERE in_package IS NULL AND as_is IS NULL),
singles AS (SELECT path, short, arg_max(owner, ord) AS owner FROM java_imports WHERE NOT is_static AND NOT is_wildcard GROUP BY ALL),
full_type AS (SELECT o.*, coalesce(a.name, b.name) AS type FROM open o LEFT JOIN types a ON a.name = o.receiver
  LEFT JOIN types b ON b.name = o.package || '.' || o.receiver WHERE o.dotted AND contains(o.receiver, '.')),
near_type AS (SELECT o.*, coalesce(a.name, b.name) AS type FROM open o LEFT JOIN singles s ON s.path = o.path AND s.short = o.receiver
  LEFT JOIN types a ON a.name = s.owner || '.' || o.receiver LEFT JOIN types b ON b.name = o.package || '.' || o.receiver
  WHERE o.dotted AND NOT contains(o.receiver, '.')),
by_type AS (SELECT src, target, package, path, 0 AS ord, type || '.' || method AS name FROM full_type UNION ALL
  SELECT src, target, package, path, 0, type || '.' || method FROM near_type WHERE type IS NOT NULL UNION ALL
  SELECT n.src, n.target, n.package, n.path, i.ord, t.name || '.' || n.method FROM near_type n JOIN java_imports i ON i.path = n.path AND NOT i.is_static
    AND i.is_wildcard JOIN types t ON t.name = i.owner || '.' || n.receiver WHERE n.type IS NULL),
by_static AS (SELECT o.src, o.target, o.package, o.path, CASE WHEN i.is_wildcard THEN 1000 ELSE 0 END + i.ord AS ord, i.owner || '.' || o.method AS name
  FROM open o JOIN java_imports i ON i.path = o.path AND i.is_static AND (i.is_wildcard OR i.short = o.method) WHERE NOT o.dotted OR o.receiver = o.owner),
hits AS (SELECT t.*, 0 AS step FROM by_type t JOIN symbols s ON s.name = t.name UNION ALL SELECT t.*, 1 FROM by_static t JOIN symbols s ON s.name = t.name),
firsts AS (SELECT src, target, package, path, arg_min(name, step * 100000 + ord) AS dst FROM hits GROUP BY ALL),
resolved AS (SELECT src, target, path, coalesce(in_package, as_is) AS dst FROM fixed WHERE coalesce(in_package, as_is) IS NOT NULL
  UNION ALL SELECT src, target, path, dst FROM firsts)"""


def _java_calls(spark, sf_dir) -> DataFrame:
    symbols, refs, imports = many(spark, sf_dir, "java_symbols", "java_refs", "java_imports")
    return graph.resolve_java(refs, symbols, imports)


@query(JAVA_TWIN + " SELECT src, dst, count(*) AS calls FROM resolved GROUP BY ALL")
def java_call_resolution(spark, sf_dir):
    return _java_calls(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("calls"))


@query(JAVA_TWIN + """ SELECT r.src, r.dst, max(j.seq) AS seq FROM resolved r JOIN java_refs j ON j.src = r.src AND j.target = r.target AND j.path = r.path
WHERE r.src <> r.dst AND j.path = (SELECT max(x.path) FROM resolved x WHERE x.src = r.src AND x.dst = r.dst) GROUP BY ALL""")
def java_edge_last_site(spark, sf_dir):
    found = _java_calls(spark, sf_dir)
    latest = found.withColumn("site", F.struct(F.col("site.site_path"), F.col("site.site_line"), F.col("order.seq").alias("site_code")))
    return graph.edges(latest).select("src", "dst", F.col("site_code").alias("seq"))
