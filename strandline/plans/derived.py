"""Engine relations derived from the driver's tables by SQL that Spark and DuckDB read alike.

The tables hold no code, so symbols stand for parts, call edges and changed lines for line items, and diffs for documents.
`{part}` and the like are the tables: DataFrames in Spark, views in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def name_of(key: str) -> str:
    return f"'pkg' || CAST({key} % 10 AS STRING) || '.f' || CAST({key} AS STRING)"


def path_of(key: str, moved: bool) -> str:
    folder = f"(CASE WHEN {key} % 7 = 0 THEN 'moved/' ELSE 'src/' END)" if moved else "'src/'"
    return f"{folder} || 'file' || CAST(CAST(floor({key} / 100.0) AS INT) AS STRING) || '.go'"


def _symbols(skip: int, current: bool) -> str:
    edited = "(CASE WHEN p_partkey % 5 = 0 THEN ' // edited' ELSE '' END)" if current else "''"
    return f"""
SELECT {name_of('p_partkey')} AS name, {path_of('p_partkey', current)} AS path,
  CASE WHEN p_partkey % 9 = 0 THEN 'method_declaration' ELSE 'function_declaration' END AS kind,
  CAST((p_partkey % 100) * 30 + 1 AS INT) AS start_line, CAST((p_partkey % 100) * 30 + 1 + p_size AS INT) AS end_line,
  'func ' || p_name || '(' || CAST(p_partkey AS STRING) || ')' || {edited} AS source
FROM {{part}} WHERE p_partkey % {skip} <> 0"""


def _edges(skip: int, current: bool, fan: int) -> str:
    return f"""
SELECT {name_of('s')} AS src, {name_of('t')} AS dst, {path_of('s', current)} AS site_path, CAST(l AS INT) AS site_line,
  'call' AS site_code
FROM (SELECT s, t, min(l) AS l FROM (
    SELECT l_partkey AS s, l_partkey + 1 + 4 * (l_suppkey % {fan}) AS t, l_linenumber AS l FROM {{lineitem}} WHERE l_partkey % 4 < 3
    UNION ALL SELECT p_partkey, p_partkey - 2, 0 FROM {{part}} WHERE p_partkey % 4 = 3 AND p_partkey % 3 = 0) u
  GROUP BY s, t) e
JOIN (SELECT p_partkey AS p1 FROM {{part}} WHERE p_partkey % {skip} <> 0) a ON a.p1 = e.s
JOIN (SELECT p_partkey AS p2 FROM {{part}} WHERE p_partkey % {skip} <> 0) b ON b.p2 = e.t"""


SQL = {
    "sym_cur": _symbols(11, True),
    "sym_base": _symbols(13, False),
    "edges_cur": _edges(11, True, 3),
    "edges_base": _edges(13, False, 4),
    "changed": f"SELECT {name_of('p_partkey')} AS name FROM {{part}} WHERE p_partkey % 11 <> 0 AND p_partkey % 17 = 0",
    "added": f"""
SELECT CAST(0 AS BIGINT) AS diff_id, {path_of('l_partkey', True)} AS path,
  CAST((l_partkey % 100) * 30 + 1 + l_suppkey % 40 AS INT) AS line_no, 'x' AS content
FROM {{lineitem}}""",
    "hunk_rows": f"""
SELECT CAST(0 AS BIGINT) AS diff_id, CAST(CAST(floor(l_partkey / 100.0) AS INT) * 2 + (CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) AS INT) AS file_ord,
  CAST(l_suppkey % 3 + 1 AS INT) AS hunk_ord, CAST(l_linenumber AS INT) AS line_ord, CASE WHEN l_linenumber % 2 = 0 THEN 'add' ELSE 'delete' END AS op,
  CAST((l_partkey % 100) * 30 + 1 + l_suppkey % 40 AS INT) AS line, {path_of('l_partkey', True)} AS path, {path_of('l_partkey', False)} AS old_path
FROM {{lineitem}}""",
    "java_symbols": """
SELECT DISTINCT 'com.p' || CAST(p_partkey % 5 AS STRING) || '.T' || CAST(p_partkey % 13 AS STRING) AS name, 'class_declaration' AS kind FROM {part}
UNION ALL SELECT DISTINCT 'com.p' || CAST(p_partkey % 5 AS STRING) || '.T' || CAST(p_partkey % 13 AS STRING) || '.m' || CAST(p_partkey % 31 AS STRING),
  'method_declaration' FROM {part}""",
    "java_refs": """
SELECT DISTINCT 'f' || CAST(l_suppkey % 20 AS STRING) || '.java' AS path, 'com.p' || CAST(l_suppkey % 5 AS STRING) AS package, l_orderkey * 10 + l_linenumber AS seq,
  'com.p' || CAST(l_suppkey % 5 AS STRING) || '.T' || CAST(l_partkey % 13 AS STRING) || '.m' || CAST(l_partkey % 31 AS STRING) AS src,
  CASE l_linenumber % 5 WHEN 0 THEN 'm' || CAST(l_orderkey % 31 AS STRING)
    WHEN 1 THEN 'T' || CAST(l_orderkey % 13 AS STRING) || '.m' || CAST(l_partkey % 31 AS STRING)
    WHEN 2 THEN 'com.p' || CAST(l_orderkey % 5 AS STRING) || '.T' || CAST(l_orderkey % 13 AS STRING) || '.m' || CAST(l_orderkey % 31 AS STRING)
    WHEN 3 THEN 'T' || CAST(l_partkey % 13 AS STRING) || '.s' || CAST(l_orderkey % 9 AS STRING)
    ELSE 'x.T' || CAST(l_orderkey % 13 AS STRING) || '.m1' END AS target, 'f.java' AS site_path, CAST(l_linenumber AS INT) AS site_line, 'call' AS site_code
FROM {lineitem}""",
    "java_imports": """
SELECT DISTINCT 'f' || CAST(p_partkey % 20 AS STRING) || '.java' AS path, p_size % 2 = 0 AS is_static, p_size % 3 = 0 AS is_wildcard,
  CASE WHEN p_size % 2 = 0 THEN 'com.p' || CAST(p_size % 5 AS STRING) || '.T' || CAST(p_size % 13 AS STRING) ELSE 'com.p' || CAST(p_size % 5 AS STRING) END AS owner,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'm' || CAST(p_size % 31 AS STRING) ELSE 'T' || CAST(p_size % 13 AS STRING) END AS short,
  CAST(p_size AS INT) AS ord FROM {part}""",
    "code": """
SELECT CAST(p_partkey AS INT) AS k, CAST(p_partkey % 10 AS STRING) AS a, CAST(p_partkey % 7 AS STRING) AS b, CAST(p_partkey AS STRING) AS n, CAST(p_size AS INT) AS size
FROM {part}""",
    "methods": """
SELECT 'pkg' || CAST(p_partkey % 3 AS STRING) || '.T' || CAST(p_partkey % 7 AS STRING) || '.m' || CAST(p_partkey % 40 AS STRING) AS name,
  'dir' || CAST(p_partkey % 20 AS STRING) || '/f.go' AS path, p_partkey AS pos, p_size AS start_line FROM {part}""",
    "refs": f"""
SELECT DISTINCT 'a.go' AS path, 'go' AS language, 'pkg' || CAST(l_partkey % 4 AS STRING) AS package, l_orderkey * 10 + l_linenumber AS seq,
  {name_of('l_partkey')} AS src,
  CASE l_linenumber % 3 WHEN 0 THEN 'T' || CAST(l_suppkey % 9 AS STRING) || '.m' || CAST(l_partkey % 40 AS STRING)
    WHEN 1 THEN 'm' || CAST(l_partkey % 45 AS STRING)
    ELSE 'pkg1.T' || CAST(l_suppkey % 7 AS STRING) || '.m' || CAST(l_partkey % 40 AS STRING) END AS target,
  'a.go' AS site_path, CAST(l_linenumber AS INT) AS site_line, 'call' AS site_code
FROM {{lineitem}}""",
    "urls": """
SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') ||
  (CASE page_id % 9 WHEN 0 THEN '/test/a.go' WHEN 1 THEN '/x_test.go' WHEN 2 THEN '/src/test/java/B.java' WHEN 3 THEN '/vendor/c.py'
    WHEN 4 THEN '/d.pb.go' WHEN 5 THEN '/img.PNG' WHEN 6 THEN '/build/e.tsx' WHEN 7 THEN '/README.md' ELSE '/lib/g.rs' END) AS path
FROM {pages}""",
}

TABLES = ["part", "lineitem", "pages", "documents"]


def twin(name: str) -> str:
    """The relation's SQL over DuckDB's views."""
    return SQL[name].format(**{t: t for t in TABLES})


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def with_(*names: str) -> str:
    """A WITH clause for these relations, in DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({twin(n)})" for n in names)


#: Lines of a synthetic diff's first hunk.
FIRST_HUNK = 20


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, diff): one file for each document, whose lines are added, deleted and kept in turn, in up to two hunks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null")
    key = F.col("doc_id")
    text = lambda x: F.lit(x)
    number = key.cast("string")
    path = F.when(key % 5 == 0, F.concat(text("tests/f"), number, text(".go"))).otherwise(F.concat(text("pkg/f"), number, text(".go")))
    old = F.when(key % 4 == 2, F.concat(text("old/f"), number, text(".go"))).otherwise(path)
    mode = (
        F.when(key % 4 == 1, "new file mode 100644\n").when(key % 4 == 3, "deleted file mode 100644\n")
        .when(key % 4 == 2, F.concat(text("rename from "), old, text("\nrename to "), path, text("\n"))).otherwise("")
    )
    sign = lambda i: F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" ")
    body = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(sign(i), text("x"), x))
    first = F.array_join(F.slice(body, 1, FIRST_HUNK), "\n")
    rest = F.slice(body, F.lit(FIRST_HUNK + 1), F.greatest(F.size(body) - FIRST_HUNK, F.lit(0)))
    second = F.when(F.size(body) > FIRST_HUNK, F.concat(text("\n@@ -1000 +2000,3 @@\n"), F.array_join(rest, "\n"))).otherwise("")
    start = F.concat(text("@@ -"), (key % 50 + 1).cast("string"), text(",5 +"), (key % 30 + 1).cast("string"), text(",7 @@\n"))
    marker = F.when(key % 6 == 0, "\n\\ No newline at end of file").otherwise("")
    target = F.when(key % 4 == 3, "/dev/null").otherwise(F.concat(text("b/"), path))
    whole = F.concat(
        text("diff --git a/"), old, text(" b/"), path, text("\n"), mode, text("--- a/"), old, text("\n+++ "), target, text("\n"), start, first,
        second, marker, text("\n"),
    )
    return docs.select(key.cast("long").alias("diff_id"), whole.alias("diff"))


#: The lines of those diffs, told directly: for DuckDB.
DIFF_LINES_TWIN = f"""
diff_raw AS (SELECT doc_id AS diff_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
diff_ops AS (SELECT diff_id, i, 'x' || x AS content, CASE WHEN i < {FIRST_HUNK} THEN 1 ELSE 2 END AS hunk_ord,
  CASE i % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' ELSE 'keep' END AS op FROM diff_raw),
diff_numbers AS (SELECT *, CASE hunk_ord WHEN 1 THEN diff_id % 50 + 1 ELSE 1000 END + count(*) FILTER (WHERE op <> 'add') OVER w AS old_line,
  CASE hunk_ord WHEN 1 THEN diff_id % 30 + 1 ELSE 2000 END + count(*) FILTER (WHERE op <> 'delete') OVER w AS new_line
  FROM diff_ops WINDOW w AS (PARTITION BY diff_id, hunk_ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
