"""Queries over the driver's tables: the engine's operators on derived relations, each with the DuckDB SQL that gives the
same rows by its own means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import names, paths, texts
from strandline.operators import compare, contexts, diffs, filters, graph, impact, intervals, moves, records, sizing
from strandline.operators.diffs import Changes
from strandline.operators.filters import PathFilter
from strandline.operators.sizing import Limits
from strandline.plans import catalog_sources, derived, report
from strandline.plans.derived import DIFF_LINES_TWIN, relation, twin, with_
from strandline.plans.queries import ORACLE_SQL, QUERIES, many, query, table

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_sources", "flagship"]

# --- intervals -------------------------------------------------------------------------------------------------------

@query("""
SELECT l_orderkey AS symbol, CAST(min(l) AS INT) AS range_start, CAST(max(l) AS INT) AS range_end
FROM (SELECT l_orderkey, l, l - row_number() OVER (PARTITION BY l_orderkey ORDER BY l) AS run
  FROM (SELECT DISTINCT l_orderkey, l_linenumber AS l FROM lineitem)) GROUP BY l_orderkey, run""")
def line_range_compaction(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("symbol"), F.col("l_linenumber").alias("line_no"))
    return intervals.islands(rows, "symbol").select("symbol", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


@query(with_("sym_cur", "added") + """
SELECT name, CAST(min(line_no) AS INT) AS range_start, CAST(max(line_no) AS INT) AS range_end FROM (
  SELECT name, line_no, line_no - row_number() OVER (PARTITION BY name ORDER BY line_no) AS run FROM (
    SELECT DISTINCT s.name, a.line_no FROM added a JOIN sym_cur s ON a.path = s.path AND a.line_no BETWEEN s.start_line AND s.end_line))
GROUP BY name, run""")
def changed_symbol_ranges(spark, sf_dir):
    symbols, added = many(spark, sf_dir, "sym_cur", "added")
    lines = impact.changed_lines(added, symbols)
    return intervals.islands(lines, "name").select("name", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


# --- snapshots -------------------------------------------------------------------------------------------------------

MOVES = """moves AS (SELECT b.path || '::' || b.name AS from_id, c.path || '::' || c.name AS to_id, b.source = c.source AS body_equal, c.name,
  c.path, c.start_line, c.end_line FROM sym_cur c JOIN sym_base b ON c.name = b.name AND c.path <> b.path)"""


def _moves(spark, sf_dir) -> DataFrame:
    return moves.moved_symbols(*many(spark, sf_dir, "sym_cur", "sym_base"))


@query(with_("sym_cur", "sym_base") + f", {MOVES} SELECT from_id, to_id, body_equal FROM moves")
def moved_symbols(spark, sf_dir):
    return _moves(spark, sf_dir).select("from_id", "to_id", "body_equal")


@query(with_("sym_cur", "sym_base") + f", {MOVES} SELECT path, start_line, end_line FROM moves WHERE body_equal")
def moved_line_ranges(spark, sf_dir):
    return moves.current_ranges(_moves(spark, sf_dir))


@query(with_("sym_cur", "sym_base") + f""", {MOVES} SELECT path || '::' || name AS id FROM sym_base
WHERE path || '::' || name NOT IN (SELECT path || '::' || name FROM sym_cur) AND path || '::' || name NOT IN (SELECT from_id FROM moves)""")
def deleted_symbols(spark, sf_dir):
    current, base = many(spark, sf_dir, "sym_cur", "sym_base")
    return compare.deleted_symbols(current, base, _moves(spark, sf_dir))


REMOVED = MOVES + """,
now_edges AS (SELECT a.path || '::' || a.name AS f, b.path || '::' || b.name AS t FROM edges_cur e JOIN sym_cur a ON a.name = e.src
  JOIN sym_cur b ON b.name = e.dst),
old_edges AS (SELECT a.path || '::' || a.name AS from_id, b.path || '::' || b.name AS to_id, e.site_path, e.site_line FROM edges_base e
  JOIN sym_base a ON a.name = e.src JOIN sym_base b ON b.name = e.dst),
removed AS (SELECT o.* FROM old_edges o LEFT JOIN moves m ON m.from_id = o.from_id LEFT JOIN moves n ON n.from_id = o.to_id
  WHERE NOT EXISTS (SELECT 1 FROM now_edges w WHERE w.f = coalesce(m.to_id, o.from_id) AND w.t = coalesce(n.to_id, o.to_id)))"""


def _removed(spark, sf_dir) -> DataFrame:
    current, base, now, old = many(spark, sf_dir, "sym_cur", "sym_base", "edges_cur", "edges_base")
    return compare.removed_calls(current, now, base, old, _moves(spark, sf_dir))


@query(with_("sym_cur", "sym_base", "edges_cur", "edges_base") + f", {REMOVED} SELECT * FROM removed")
def removed_calls_after_moves(spark, sf_dir):
    return _removed(spark, sf_dir)


@query(with_("sym_cur", "sym_base", "added") + f""", {MOVES} SELECT path, line_no FROM added a WHERE NOT EXISTS (
  SELECT 1 FROM moves m WHERE m.body_equal AND m.path = a.path AND a.line_no BETWEEN m.start_line AND m.end_line)""")
def drop_moved_lines(spark, sf_dir):
    (added,) = many(spark, sf_dir, "added")
    return moves.drop_moved_lines(added, _moves(spark, sf_dir)).select("path", "line_no")


@query(with_("sym_cur", "sym_base", "added") + f""", {MOVES}, hit AS (SELECT DISTINCT s.name, s.path FROM added a
  JOIN sym_cur s ON a.path = s.path AND a.line_no BETWEEN s.start_line AND s.end_line)
SELECT path || '::' || name AS id FROM hit WHERE name NOT IN (SELECT name FROM moves WHERE body_equal)""")
def changed_symbols(spark, sf_dir):
    symbols, added = many(spark, sf_dir, "sym_cur", "added")
    changed = impact.changed_lines(added, symbols).select("name").distinct()
    return impact.changed_symbols(changed, symbols, _moves(spark, sf_dir))


MOVED_ROWS = """moved_rows AS (SELECT h.*, EXISTS (SELECT 1 FROM sym_cur c JOIN sym_base b ON c.name = b.name AND c.path <> b.path AND c.source = b.source
  WHERE (h.op = 'add' AND c.path = h.path AND h.line BETWEEN c.start_line AND c.end_line)
    OR (h.op = 'delete' AND b.path = h.old_path AND h.line BETWEEN b.start_line AND b.end_line)) AS gone FROM hunk_rows h)"""


def _without_moves(spark, sf_dir) -> tuple[Changes, DataFrame]:
    (rows,) = many(spark, sf_dir, "hunk_rows")
    files = rows.groupBy("diff_id", "file_ord").agg(F.min("path").alias("path"), F.min("old_path").alias("old_path"), F.lit("renamed").alias("status"), F.lit(False).alias("test"))
    hunks = rows.select("diff_id", "file_ord", "hunk_ord", *[F.lit(1).alias(c) for c in ("old_start", "old_lines", "new_start", "new_lines")]).distinct()
    lines = rows.select(
        "diff_id", "file_ord", "hunk_ord", "line_ord", "op", F.when(F.col("op") == "delete", F.col("line")).alias("old_line"),
        F.when(F.col("op") == "add", F.col("line")).alias("new_line"), F.lit("x").alias("content"),
    )
    return moves.drop_moved_hunk_lines(Changes(files, hunks, lines), _moves(spark, sf_dir))


@query(with_("sym_cur", "sym_base", "hunk_rows") + f", {MOVED_ROWS} SELECT file_ord, hunk_ord, count(*) AS lines FROM moved_rows WHERE NOT gone GROUP BY ALL")
def hunks_without_moved_lines(spark, sf_dir):
    changes, _ = _without_moves(spark, sf_dir)
    lines = changes.hunk_lines.groupBy("file_ord", "hunk_ord").agg(F.count("*").alias("lines"))
    return changes.hunks.join(lines, ["file_ord", "hunk_ord"]).select("file_ord", "hunk_ord", "lines")


@query(with_("sym_cur", "sym_base", "hunk_rows") + f""", {MOVED_ROWS} SELECT file_ord, CAST(count(*) AS INT) AS moved_lines_omitted,
'symbol_moves,package_reorganization' AS change_intent FROM moved_rows WHERE gone GROUP BY file_ord""")
def moved_line_intents(spark, sf_dir):
    _, omitted = _without_moves(spark, sf_dir)
    return omitted.select("file_ord", "moved_lines_omitted", F.array_join(records.change_intent(F.col("moved_lines_omitted")), ",").alias("change_intent"))


# --- graph -----------------------------------------------------------------------------------------------------------

@query(f"""SELECT name, path, start_line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path DESC, pos DESC) AS r
FROM ({twin('methods')})) WHERE r = 1""")
def symbol_last_wins(spark, sf_dir):
    (declared,) = many(spark, sf_dir, "methods")
    return graph.last_wins(declared).select("name", "path", "start_line")


GO_TWIN = f"""
WITH symbols AS (SELECT DISTINCT name FROM ({twin('methods')})), refs AS ({twin('refs')}),
latest AS (SELECT src, target, package, max(struct_pack(path := path, seq := seq)) AS ord, arg_max(site_line, seq) AS site_line FROM refs GROUP BY ALL),
keys AS (SELECT name, regexp_replace(name, '^[^.]*[.]', '') AS key FROM symbols UNION SELECT name, string_split(name, '.')[-1] FROM symbols),
hits AS (SELECT l.*, coalesce(a.name, b.name) AS exact FROM latest l LEFT JOIN symbols a ON a.name = l.package || '.' || l.target
  LEFT JOIN symbols b ON b.name = l.target),
resolved AS (SELECT src, exact AS dst, ord.seq AS seq, site_line FROM hits WHERE exact IS NOT NULL
  UNION ALL SELECT h.src, k.name, h.ord.seq, h.site_line FROM hits h JOIN keys k ON k.key = h.target WHERE h.exact IS NULL)"""


@query(GO_TWIN + " SELECT DISTINCT src, dst FROM resolved")
def call_resolution_cascade(spark, sf_dir):
    methods, refs = many(spark, sf_dir, "methods", "refs")
    return graph.resolve_go(refs, methods.select("name").distinct()).select("src", "dst").distinct()


@query(GO_TWIN + " SELECT src, dst, max(seq) AS seq FROM resolved WHERE src <> dst GROUP BY src, dst")
def edge_last_site(spark, sf_dir):
    methods, refs = many(spark, sf_dir, "methods", "refs")
    resolved = graph.resolve_go(refs, methods.select("name").distinct())
    latest = resolved.withColumn("site", F.struct(F.col("site.site_path"), F.col("site.site_line"), F.col("order.seq").alias("site_code")))
    return graph.edges(latest).select("src", "dst", F.col("site_code").alias("seq"))


WALK = """,
walk(name, path) AS (SELECT name, [name] FROM changed UNION ALL
  SELECT e.src, list_prepend(e.src, w.path) FROM walk w JOIN edges_cur e ON e.dst = w.name WHERE NOT list_contains(w.path, e.src)),
chains AS (SELECT * FROM walk WHERE name NOT IN (SELECT dst FROM edges_cur)),
on_chain AS (SELECT DISTINCT unnest(path) AS name FROM chains)"""


def _impact(spark, sf_dir) -> impact.Impact:
    changed, edges, symbols = many(spark, sf_dir, "changed", "edges_cur", "sym_cur")
    return impact.impact(changed, edges, symbols)


@query(with_("changed", "edges_cur") + WALK + " SELECT DISTINCT name FROM chains")
def entry_points(spark, sf_dir):
    return _impact(spark, sf_dir).entry_points


@query(with_("changed", "edges_cur") + WALK + " SELECT name FROM on_chain")
def impacted_nodes(spark, sf_dir):
    return _impact(spark, sf_dir).nodes


@query(with_("changed", "edges_cur") + WALK + " SELECT array_to_string(path, '->') AS chain FROM chains")
def root_to_changed_chains(spark, sf_dir):
    return impact.chains(*many(spark, sf_dir, "changed", "edges_cur", "sym_cur"))


@query(with_("changed", "edges_cur", "sym_cur") + WALK + """ SELECT e.src AS name, s.path || '::' || s.name AS to_id, e.site_path, e.site_line
FROM edges_cur e JOIN on_chain a ON a.name = e.src JOIN on_chain b ON b.name = e.dst JOIN sym_cur s ON s.name = e.dst""")
def node_relevant_calls(spark, sf_dir):
    edges, symbols = many(spark, sf_dir, "edges_cur", "sym_cur")
    return impact.node_calls(_impact(spark, sf_dir).nodes, edges, symbols)


@query(with_("changed", "edges_cur", "sym_cur") + WALK + """ SELECT s.path || '::' || s.name AS id, s.path, string_split(s.name, '.')[-1] AS short,
  CASE WHEN length(s.name) - length(replace(s.name, '.', '')) >= 2 THEN 'method' ELSE 'function' END AS kind,
  s.name IN (SELECT name FROM changed) AS changed, string_split(s.name, '.')[1] AS package FROM sym_cur s JOIN on_chain c ON c.name = s.name""")
def node_records(spark, sf_dir):
    changed, symbols = many(spark, sf_dir, "changed", "sym_cur")
    ranges = changed.withColumn("changed_lines", F.array(F.struct(F.lit(1).alias("start"), F.lit(1).alias("end"))))
    rows = impact.node_records(_impact(spark, sf_dir).nodes, symbols, ranges)
    return rows.select("id", "path", "short", "kind", "changed", "package")


@query(with_("changed", "edges_cur", "sym_cur") + WALK + """ SELECT s.path, count(*) AS symbols, min(s.path || '::' || s.name) AS first_symbol
FROM sym_cur s JOIN on_chain c ON c.name = s.name GROUP BY s.path""")
def file_symbols(spark, sf_dir):
    symbols = relation(spark, sf_dir, "sym_cur")
    nodes = compare.with_id(symbols).join(_impact(spark, sf_dir).nodes, "name", "left_semi")
    rows = records.file_symbols(nodes)
    return rows.select("path", F.size("symbols").cast("long").alias("symbols"), F.col("symbols")[0].alias("first_symbol"))


# --- contexts --------------------------------------------------------------------------------------------------------

ENCLOSING = """enclosing AS (SELECT i.name, (SELECT o.name FROM sym_cur o WHERE o.path = i.path AND o.name <> i.name AND o.start_line <= i.start_line
  AND o.end_line >= i.end_line ORDER BY o.end_line - o.start_line, o.name LIMIT 1) AS enclosing FROM sym_cur i)"""


@query(with_("sym_cur") + f", {ENCLOSING} SELECT * FROM enclosing WHERE enclosing IS NOT NULL")
def enclosing_declaration(spark, sf_dir):
    (symbols,) = many(spark, sf_dir, "sym_cur")
    return contexts.enclosing(symbols, symbols)


RELATED = MOVES + f""", {ENCLOSING},
gone AS (SELECT name FROM moves WHERE body_equal),
seeds AS (SELECT s.name, s.path || '::' || s.name AS related_to FROM sym_cur s JOIN changed c ON c.name = s.name WHERE s.name NOT IN (SELECT name FROM gone)),
near AS (SELECT e.src AS name, 'direct_caller' AS relationship, d.related_to FROM edges_cur e JOIN seeds d ON e.dst = d.name
  UNION SELECT e.dst, 'direct_callee', d.related_to FROM edges_cur e JOIN seeds d ON e.src = d.name
  UNION SELECT n.enclosing, 'enclosing_declaration', d.related_to FROM enclosing n JOIN seeds d ON n.name = d.name WHERE n.enclosing IS NOT NULL),
related AS (SELECT * FROM near WHERE name NOT IN (SELECT name FROM changed) AND name NOT IN (SELECT name FROM gone))"""


def _context_inputs(spark, sf_dir):
    symbols, edges, changed = many(spark, sf_dir, "sym_cur", "edges_cur", "changed")
    equal = _moves(spark, sf_dir).where("body_equal").select("name")
    return symbols, edges, changed, equal, spark.createDataFrame([], "path string")


@query(with_("changed", "edges_cur", "sym_cur", "sym_base") + f", {RELATED} SELECT * FROM related")
def related_contexts(spark, sf_dir):
    return contexts.related(*_context_inputs(spark, sf_dir))


@query(with_("changed", "edges_cur", "sym_cur", "sym_base") + f""", {RELATED}
SELECT s.path || '::' || s.name AS id, string_split(s.name, '.')[-1] AS name,
  CASE s.kind WHEN 'method_declaration' THEN 'method' ELSE 'function' END AS kind, s.start_line, s.end_line, x.relationship, x.related_to,
  s.source AS content FROM sym_cur s JOIN (SELECT * FROM related UNION ALL SELECT name, 'changed_declaration', '' FROM changed
  WHERE name NOT IN (SELECT name FROM gone)) x ON x.name = s.name""")
def context_records(spark, sf_dir):
    symbols, edges, changed, equal, none = _context_inputs(spark, sf_dir)
    ranges = changed.withColumn("changed_lines", F.array(F.struct(F.lit(1).alias("start"), F.lit(1).alias("end"))))
    rows = contexts.contexts(symbols, edges, ranges, equal, none)
    return rows.select("id", "name", "kind", "start_line", "end_line", "relationship", "related_to", F.col("excerpt.content").alias("content"))


# --- diffs -----------------------------------------------------------------------------------------------------------

def _lines(spark, sf_dir) -> DataFrame:
    return diffs.diff_lines(derived.diffs(spark, sf_dir))


FILES = """files AS (SELECT DISTINCT diff_id, CASE diff_id % 4 WHEN 0 THEN 'modified' WHEN 1 THEN 'added' WHEN 2 THEN 'renamed' ELSE 'deleted' END AS status,
  CASE WHEN diff_id % 5 = 0 THEN 'tests/f' ELSE 'pkg/f' END || diff_id || '.go' AS path,
  CASE diff_id % 4 WHEN 2 THEN 'old/f' || diff_id || '.go' WHEN 3 THEN CASE WHEN diff_id % 5 = 0 THEN 'tests/f' ELSE 'pkg/f' END || diff_id || '.go'
    ELSE '' END AS old_path, diff_id % 5 = 0 AS test FROM diff_raw)"""


@query(f"""WITH {DIFF_LINES_TWIN}, {FILES} SELECT n.diff_id, f.path, CAST(n.new_line AS INT) AS line_no, n.content FROM diff_numbers n
JOIN files f ON f.diff_id = n.diff_id WHERE n.op = 'add' AND NOT f.test AND f.status <> 'deleted'""")
def diff_added_lines(spark, sf_dir):
    return diffs.added_lines(_lines(spark, sf_dir))


@query(f"WITH {DIFF_LINES_TWIN}, {FILES} SELECT diff_id, 1 AS file_ord, status, old_path, path, test FROM files")
def diff_file_status(spark, sf_dir):
    return diffs.changes(_lines(spark, sf_dir)).files


@query(f"""WITH {DIFF_LINES_TWIN} SELECT DISTINCT diff_id, 1 AS file_ord, hunk_ord, CAST(CASE hunk_ord WHEN 1 THEN diff_id % 50 + 1 ELSE 1000 END AS INT) AS old_start,
CASE hunk_ord WHEN 1 THEN 5 ELSE 1 END AS old_lines, CAST(CASE hunk_ord WHEN 1 THEN diff_id % 30 + 1 ELSE 2000 END AS INT) AS new_start,
CASE hunk_ord WHEN 1 THEN 7 ELSE 3 END AS new_lines FROM diff_ops""")
def diff_hunks(spark, sf_dir):
    return diffs.changes(_lines(spark, sf_dir)).hunks


@query(f"""WITH {DIFF_LINES_TWIN} SELECT diff_id, hunk_ord, op, CAST(CASE op WHEN 'delete' THEN old_line END AS INT) AS old_line,
CAST(CASE op WHEN 'add' THEN new_line END AS INT) AS new_line, content FROM diff_numbers WHERE op <> 'keep'""")
def diff_line_numbering(spark, sf_dir):
    rows = diffs.changes(_lines(spark, sf_dir)).hunk_lines
    return rows.select("diff_id", "hunk_ord", "op", "old_line", "new_line", "content")


@query(f"""WITH {DIFF_LINES_TWIN} SELECT diff_id, CAST(count(*) FILTER (WHERE op = 'add') AS INT) AS added_lines,
CAST(count(*) FILTER (WHERE op = 'delete') AS INT) AS deleted_lines, CAST(coalesce(sum(strlen(content)) FILTER (WHERE op = 'add'), 0) AS INT) AS added_bytes,
CAST(coalesce(sum(strlen(content)) FILTER (WHERE op = 'delete'), 0) AS INT) AS deleted_bytes FROM diff_numbers WHERE op <> 'keep' GROUP BY diff_id""")
def diffstat(spark, sf_dir):
    return records.diffstat(diffs.changes(_lines(spark, sf_dir)).hunk_lines).drop("file_ord")


def _facts(spark, sf_dir) -> DataFrame:
    return records.file_facts(diffs.changes(_lines(spark, sf_dir)))


@query(f"""WITH {DIFF_LINES_TWIN}, {FILES}, sums AS (SELECT diff_id, count(*) FILTER (WHERE op = 'add') AS n,
  coalesce(sum(strlen(content)) FILTER (WHERE op = 'add'), 0) AS b, count(*) FILTER (WHERE op <> 'keep') AS shown FROM diff_ops GROUP BY diff_id)
SELECT f.diff_id, CAST(s.shown AS INT) AS hunk_lines, f.status = 'added' AND (s.b > 15 * 1024 OR s.n > 300) AS compacted, 'go' AS language,
  CASE WHEN f.test THEN 'test' ELSE 'source' END AS classification FROM files f JOIN sums s ON s.diff_id = f.diff_id""")
def file_records(spark, sf_dir):
    rows = _facts(spark, sf_dir)
    return rows.select("diff_id", "hunk_lines", "compacted", "language", F.array_join("classification", ",").alias("classification"))


@query(f"""WITH {DIFF_LINES_TWIN}, adds AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY i) AS r, count(*) OVER (PARTITION BY diff_id) AS n
  FROM diff_ops WHERE op = 'add')
SELECT diff_id, CAST(CASE WHEN n <= 40 THEN n ELSE 20 END AS INT) AS head, CAST(CASE WHEN n <= 40 THEN 0 ELSE 20 END AS INT) AS tail,
  CAST(CASE WHEN n <= 40 THEN 0 ELSE n - 40 END AS INT) AS omitted_lines, min(content) FILTER (WHERE r = 1) AS first_line
FROM adds GROUP BY diff_id, n""")
def file_preview(spark, sf_dir):
    rows = _facts(spark, sf_dir).where("added_lines > 0").withColumn("preview", texts.preview(F.col("added")))
    return rows.select(
        "diff_id", F.size("preview.head_lines").alias("head"), F.coalesce(F.size("preview.tail_lines"), F.lit(0)).alias("tail"),
        "preview.omitted_lines", F.col("preview.head_lines")[0].alias("first_line"),
    )


@query(f"""WITH {DIFF_LINES_TWIN}, {FILES}, sums AS (SELECT diff_id, hunk_ord, count(*) FILTER (WHERE op <> 'keep') AS n FROM diff_ops GROUP BY ALL),
big AS (SELECT diff_id FROM diff_ops GROUP BY diff_id HAVING diff_id % 4 = 1 AND (count(*) FILTER (WHERE op = 'add') > 300 OR
  coalesce(sum(strlen(content)) FILTER (WHERE op = 'add'), 0) > 15 * 1024))
SELECT f.path, 'hunk_lines' AS kind, CAST(sum(n) AS BIGINT) AS original_count, CAST(sum(least(n, 4)) AS BIGINT) AS emitted_count,
  CAST(sum(greatest(n - 4, 0)) AS BIGINT) AS omitted_count FROM sums s JOIN files f ON f.diff_id = s.diff_id
WHERE f.diff_id NOT IN (SELECT diff_id FROM big) GROUP BY f.path HAVING sum(greatest(n - 4, 0)) > 0""")
def hunk_limit_omissions(spark, sf_dir):
    return sizing.hunk_omissions(_facts(spark, sf_dir), 4).select("path", "kind", "original_count", "emitted_count", "omitted_count")


@query(f"""WITH {DIFF_LINES_TWIN}, {FILES} SELECT CAST(count(*) AS INT) AS files, CAST(count(*) FILTER (WHERE test) AS INT) AS test_files,
count(*) FILTER (WHERE NOT test) AS production_files FROM files""")
def review_file_split(spark, sf_dir):
    files = diffs.changes(_lines(spark, sf_dir)).files
    return files.agg(
        F.count("*").cast("int").alias("files"), F.count_if("test").cast("int").alias("test_files"), F.count_if(~F.col("test")).alias("production_files")
    )


@query(f"""WITH {DIFF_LINES_TWIN}, {FILES} SELECT diff_id, path FROM files WHERE (path LIKE 'pkg/%' OR old_path LIKE 'pkg/%') AND NOT
(regexp_matches('/' || path, '^(/[^/]*)*/f[0-9][^/]*3[^/]*$') OR regexp_matches('/' || old_path, '^(/[^/]*)*/f[0-9][^/]*3[^/]*$'))""")
def path_filter_globs(spark, sf_dir):
    files = diffs.changes(_lines(spark, sf_dir)).files
    return filters.filtered_files(files, PathFilter(include="pkg/**", excludes=("**/f[0-9]*3*",))).select("diff_id", "path")


@query(f"""WITH {DIFF_LINES_TWIN}, {FILES}, sums AS (SELECT diff_id, hunk_ord, op, i, content,
  row_number() OVER (PARTITION BY diff_id, hunk_ord ORDER BY i) AS r FROM diff_ops WHERE op <> 'keep')
SELECT diff_id, hunk_ord, CAST(count(*) FILTER (WHERE r <= 3) AS INT) AS shown, CAST(greatest(count(*) - 3, 0) AS INT) AS omitted_lines
FROM sums GROUP BY diff_id, hunk_ord""")
def hunk_line_cap(spark, sf_dir):
    rows = _facts(spark, sf_dir).select("diff_id", F.posexplode(records.limited(F.col("hunks"), 3)).alias("pos", "h"))
    shown = F.coalesce(F.size("h.lines"), F.lit(0))
    return rows.where("h.lines is not null").select(
        "diff_id", (F.col("pos") + 1).alias("hunk_ord"), shown.alias("shown"), F.coalesce("h.omitted_lines", F.lit(0)).alias("omitted_lines")
    )


GLOBS = r"""(path LIKE 'pkg/%' OR old_path LIKE 'pkg/%') AND NOT
(regexp_matches('/' || path, '^(/[^/]*)*/f[0-9][^/]*3[^/]*$') OR regexp_matches('/' || old_path, '^(/[^/]*)*/f[0-9][^/]*3[^/]*$'))"""


@query(f"""WITH {DIFF_LINES_TWIN}, {FILES}, allowed AS (SELECT path FROM files WHERE {GLOBS} UNION SELECT old_path FROM files WHERE {GLOBS} AND old_path <> '')
SELECT n.diff_id, f.path, CAST(n.new_line AS INT) AS line_no FROM diff_numbers n JOIN files f ON f.diff_id = n.diff_id
WHERE n.op = 'add' AND NOT f.test AND f.status <> 'deleted' AND f.path IN (SELECT path FROM allowed)""")
def path_filtered_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    files = filters.filtered_files(diffs.changes(lines).files, PathFilter(include="pkg/**", excludes=("**/f[0-9]*3*",)))
    return filters.filtered_lines(diffs.added_lines(lines), filters.allowed_paths(files)).select("diff_id", "path", "line_no")


@query(f"""WITH {DIFF_LINES_TWIN}, {FILES} SELECT test, diff_id, 1 AS file_ord, '{{"path":"' || path || '"' ||
CASE WHEN old_path <> '' THEN ',"old_path":"' || old_path || '"' ELSE '' END || ',"status":"' || status || '","language":"go"' ||
CASE WHEN diff_id % 3 = 0 THEN ',"symbols":["' || path || '::a","' || path || '::b"]' ELSE '' END || '}}' AS json FROM files""")
def review_file_entries(spark, sf_dir):
    files = _facts(spark, sf_dir)
    nodes = files.where("diff_id % 3 = 0").select("path", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("n"))
    nodes = nodes.select("path", F.concat_ws("::", "path", "n").alias("id"))
    none = dict.fromkeys(("changed", "deleted", "contexts", "moved", "removed", "entry_points", "calls", "refs"))
    return report.review_files(report.Report(files=files, nodes=nodes, **none))


# --- paths and texts -------------------------------------------------------------------------------------------------

EXT = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
LANGUAGE = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items()) + " ELSE ltrim(ext, '.') END"


@query(f"SELECT page_id, path, {LANGUAGE} AS language FROM (SELECT *, {EXT} AS ext FROM ({twin('urls')}))")
def language_of_path(spark, sf_dir):
    rows = relation(spark, sf_dir, "urls")
    return rows.select("page_id", "path", paths.language(F.col("path")).alias("language"))


@query(f"""SELECT page_id, path, regexp_matches(path, '(^|/)(test|tests|testdata)(/|$)') OR path LIKE '%\\_test.go' ESCAPE '\\' OR
(path LIKE '%.java' AND regexp_matches(path, '(^|/)src/(test|integrationTest|functionalTest|e2eTest)/java/')) AS test FROM ({twin('urls')})""")
def test_paths(spark, sf_dir):
    return relation(spark, sf_dir, "urls").select("page_id", "path", paths.is_test(F.col("path")).alias("test"))


BINARY = "(" + ", ".join(f"'{x}'" for x in paths.BINARY_EXTENSIONS) + ")"


@query(f"""SELECT page_id, CASE WHEN concat_ws(',', v, g, b) = '' THEN 'source' ELSE concat_ws(',', v, g, b) END AS classification FROM (
SELECT page_id, CASE WHEN list_has_any(string_split(path, '/'), {paths.VENDOR_DIRS}) THEN 'vendor' END AS v,
  CASE WHEN contains(lower(path), 'generated') OR contains(lower(path), '.pb.go') OR contains(lower(path), '_gen.') THEN 'generated' END AS g,
  CASE WHEN {EXT} IN {BINARY} THEN 'binary' END AS b FROM ({twin('urls')}))""")
def file_classification(spark, sf_dir):
    rows = relation(spark, sf_dir, "urls")
    none = F.array().cast("array<string>")
    return rows.select("page_id", F.array_join(paths.classification(F.col("path"), F.lit(False), none), ",").alias("classification"))


@query(f"""SELECT page_id, path FROM (SELECT *, CASE WHEN path = '' THEN NULL ELSE path END AS p FROM ({twin('urls')}))
WHERE p IS NOT NULL AND {EXT} NOT IN ('.go', '.java')""")
def unsupported_files(spark, sf_dir):
    rows = relation(spark, sf_dir, "urls")
    files = rows.select(F.col("page_id").alias("diff_id"), F.lit(1).alias("file_ord"), "path", F.lit("").alias("old_path"), F.lit(False).alias("test"))
    return records.unsupported(files).select(F.col("diff_id").alias("page_id"), "path")


@query("""SELECT doc_id, n > 10 AS truncated, CAST(greatest(n - 10, 0) AS INT) AS omitted_lines,
CASE WHEN n > 10 THEN array_to_string(lines[1:10], chr(10)) ELSE text END AS content FROM (SELECT doc_id, text, lines, len(lines) AS n FROM (
  SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) END AS lines
  FROM documents))""")
def excerpt_bounds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.excerpt(F.col("text"), 10).alias("x")).select("doc_id", "x.truncated", "x.omitted_lines", "x.content")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_sha256(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("diff_id"), F.lit(1).alias("file_ord"), F.col("doc_id").cast("string").alias("path"), F.lit("modified").alias("status"))
    space = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return records.content_refs(files, space).select(F.col("diff_id").alias("doc_id"), F.col("content_ref.sha256").alias("content_hash"))


# --- limits ----------------------------------------------------------------------------------------------------------

@query("""SELECT class, key, size FROM (
  SELECT 0 AS class, doc_id AS key, strlen(text) + 5 * (length(text) - length(replace(replace(replace(text, '<', ''), '>', ''), '&', ''))) AS size FROM documents
  UNION ALL SELECT 1, p_partkey, strlen(p_name) FROM part) ORDER BY class, size, key LIMIT 1500""")
def priority_top_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("class"), F.col("doc_id").alias("key"), sizing.marshal_size(F.col("text")).cast("long").alias("size"))
    parts = table(spark, sf_dir, "part").select(F.lit(1).alias("class"), F.col("p_partkey").alias("key"), F.octet_length("p_name").cast("long").alias("size"))
    rows = docs.unionByName(parts).select("*", F.col("key").alias("ord"), *[F.lit("").alias(k) for k in ("k1", "k2", "k3")])
    return sizing.top_records(rows, 1500).select("class", "key", "size")


@query("""SELECT source AS path, lang AS record_type, CAST(sum(n_chars) AS BIGINT) AS original_count, CAST(sum(least(n_chars, 100)) AS BIGINT) AS emitted_count,
CAST(sum(greatest(n_chars - 100, 0)) AS BIGINT) AS omitted_count FROM documents GROUP BY source, lang""")
def omission_rollup(spark, sf_dir):
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(
        F.lit("context_lines").alias("kind"), F.lit("max_context_lines").alias("reason"), F.col("source").alias("path"), F.col("lang").alias("record_type"),
        n.alias("original_count"), F.least(n, F.lit(100)).alias("emitted_count"), F.greatest(n - 100, F.lit(0)).alias("omitted_count"),
    )
    return sizing.rolled_up(rows, ["kind", "reason", "path", "record_type"]).select("path", "record_type", "original_count", "emitted_count", "omitted_count")


@query("""SELECT doc_id, CAST(n + 7 AS BIGINT) AS original_count, CAST(least(n, 5) AS BIGINT) AS emitted_count, CAST(n + 7 - least(n, 5) AS BIGINT) AS omitted_count
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> '') WHERE n > 5""")
def context_line_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    excerpt = F.struct(F.col("text").alias("content"), F.lit(True).alias("truncated"), F.lit(7).alias("omitted_lines")).alias("excerpt")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("path"), F.lit("direct_caller").alias("relationship"), F.lit("").alias("related_to"), excerpt)
    return sizing.limited_contexts(rows, 5)[1].select(F.col("id").cast("long").alias("doc_id"), "original_count", "emitted_count", "omitted_count")


#: Tokens that a report of documents may take, and the bytes that each omission row counts there.
BUDGET, ROW_BYTES = 20_000, 100


@query(f"""WITH sizes AS (SELECT 0 AS class, doc_id AS key, strlen(text) AS n FROM documents UNION ALL SELECT 1, p_partkey, strlen(p_name) FROM part),
ranked AS (SELECT row_number() OVER w AS r, sum(n) OVER w AS total FROM sizes WINDOW w AS (ORDER BY class, n, key ROWS UNBOUNDED PRECEDING)),
fits AS (SELECT coalesce(max(r), 0) AS kept FROM ranked WHERE ceil((total + r + {ROW_BYTES}) / 4.0) <= {BUDGET})
SELECT 'records' AS kind, 'budget_tokens' AS reason, (SELECT count(*) FROM sizes) AS original_count, kept AS emitted_count,
  (SELECT count(*) FROM sizes) - kept AS omitted_count FROM fits""")
def budget_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("class"), F.col("doc_id").alias("ord"), F.octet_length("text").cast("long").alias("bytes"))
    parts = table(spark, sf_dir, "part").select(F.lit(1).alias("class"), F.col("p_partkey").alias("ord"), F.octet_length("p_name").cast("long").alias("bytes"))
    rows = docs.unionByName(parts).select("*", F.col("bytes").alias("size"), *[F.lit("").alias(k) for k in ("k1", "k2", "k3")])
    tokens_of = lambda n_bytes, n, own: sizing.tokens(n_bytes + n + ROW_BYTES * len(own))
    _, omissions = sizing.fit_budget(rows, rows.count(), [], BUDGET, tokens_of)
    names = ["kind", "reason", "original_count", "emitted_count", "omitted_count"]
    return spark.createDataFrame([tuple(r[k] for k in names) for r in omissions], "kind string, reason string, original_count long, emitted_count long, omitted_count long")


@query("""WITH sums AS (SELECT lang AS kind, source AS reason, doc_id % 5 AS path, sum(n_chars) AS n FROM documents GROUP BY ALL),
groups AS (SELECT kind, reason, sum(n) AS n FROM sums GROUP BY ALL)
SELECT kind, reason, CAST(n AS BIGINT) AS original_count, CAST(0 AS BIGINT) AS emitted_count, CAST(n AS BIGINT) AS omitted_count FROM groups
UNION ALL SELECT 'omission_metadata', 'budget_tokens', (SELECT count(*) FROM sums), (SELECT count(*) FROM groups) + 1,
  (SELECT count(*) FROM sums) - (SELECT count(*) FROM groups) - 1 WHERE (SELECT count(*) FROM sums) > (SELECT count(*) FROM groups)""")
def budget_omission_rollup(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").groupBy("lang", "source", (F.col("doc_id") % 5).alias("path")).agg(F.sum("n_chars").alias("n"))
    rows = [sizing.omission(r["lang"], r["source"], r["n"], 0, r["n"], str(r["path"])) for r in sums.collect()]  # five for each language and source
    names = ["kind", "reason", "original_count", "emitted_count", "omitted_count"]
    made = [tuple(r[k] for k in names) for r in sizing.budget_omissions(rows)]
    return spark.createDataFrame(made, "kind string, reason string, original_count long, emitted_count long, omitted_count long")


# --- pruning ---------------------------------------------------------------------------------------------------------

ALLOWED = "allowed AS (SELECT DISTINCT path FROM sym_cur WHERE path LIKE 'src/file%1.go')"


def _allowed(spark, sf_dir) -> DataFrame:
    return relation(spark, sf_dir, "sym_cur").where("path like 'src/file%1.go'").select("path").distinct()


def _pruned(spark, sf_dir, changed_only: bool) -> report.Report:
    symbols, edges, changed = many(spark, sf_dir, "sym_cur", "edges_cur", "changed")
    ids = compare.with_id(symbols)
    wanted = ids.join(changed, "name", "left_semi")
    ranges = changed.withColumn("changed_lines", F.array(F.struct(F.lit(1).alias("start"), F.lit(1).alias("end"))))
    base = relation(spark, sf_dir, "sym_base")
    moved = _moves(spark, sf_dir)
    none = spark.createDataFrame([], "path string")
    nodes = impact.node_records(ids.select("name"), symbols, ranges)
    made = report.Report(
        files=None, changed=wanted.select("id"), deleted=compare.deleted_symbols(symbols, base, moved),
        contexts=contexts.contexts(symbols, edges, ranges, moved.where("body_equal").select("name"), none), moved=moved.select("from_id", "to_id", "body_equal"),
        removed=_removed(spark, sf_dir), entry_points=wanted.select("id"), nodes=nodes,
        calls=impact.node_calls(ids.select("name"), edges, symbols).join(nodes.select("name", "id"), "name"), refs=None,
    )
    return filters.prune(made, _allowed(spark, sf_dir), changed_only)


P = "IN (SELECT path FROM allowed)"


@query(with_("sym_cur", "sym_base", "edges_cur", "edges_base") + f""", {REMOVED}, {ALLOWED} SELECT * FROM removed
WHERE string_split(from_id, '::')[1] {P} OR string_split(to_id, '::')[1] {P} OR site_path {P}""")
def pruned_removed_calls(spark, sf_dir):
    return _pruned(spark, sf_dir, False).removed


@query(with_("sym_cur", "sym_base") + f""", {MOVES}, {ALLOWED} SELECT from_id, to_id, body_equal FROM moves
WHERE string_split(from_id, '::')[1] {P} OR string_split(to_id, '::')[1] {P}""")
def pruned_moves(spark, sf_dir):
    return _pruned(spark, sf_dir, False).moved


CONTEXT_ROWS = """rows AS (SELECT s.path, s.path || '::' || s.name AS id, x.relationship, x.related_to FROM sym_cur s JOIN (SELECT * FROM related UNION ALL
  SELECT name, 'changed_declaration', '' FROM changed WHERE name NOT IN (SELECT name FROM gone)) x ON x.name = s.name)"""


@query(with_("changed", "edges_cur", "sym_cur", "sym_base") + f""", {RELATED}, {CONTEXT_ROWS}, {ALLOWED} SELECT id, relationship, related_to FROM rows
WHERE path {P} OR string_split(related_to, '::')[1] {P}""")
def pruned_contexts(spark, sf_dir):
    return _pruned(spark, sf_dir, False).contexts.select("id", "relationship", "related_to")


@query(with_("changed", "edges_cur", "sym_cur", "sym_base") + f""", {RELATED}, {CONTEXT_ROWS}, {ALLOWED} SELECT id, relationship, related_to FROM rows
WHERE path {P} AND (related_to = '' OR string_split(related_to, '::')[1] {P})""")
def pruned_contexts_changed_only(spark, sf_dir):
    return _pruned(spark, sf_dir, True).contexts.select("id", "relationship", "related_to")


@query(with_("sym_cur") + f""", {ALLOWED} SELECT path || '::' || name AS id FROM sym_cur WHERE path {P}""")
def pruned_nodes_changed_only(spark, sf_dir):
    return _pruned(spark, sf_dir, True).nodes.select("id")


@query(with_("sym_cur", "changed") + f""", {ALLOWED} SELECT path || '::' || name AS id FROM sym_cur WHERE path {P} AND name IN (SELECT name FROM changed)""")
def pruned_entry_points_changed_only(spark, sf_dir):
    return _pruned(spark, sf_dir, True).entry_points


@query(with_("changed", "edges_cur", "sym_cur", "sym_base") + f""", {RELATED}, {CONTEXT_ROWS}, {ALLOWED},
known AS (SELECT path || '::' || name AS id FROM sym_cur WHERE path {P}
  UNION SELECT from_id FROM moves WHERE string_split(from_id, '::')[1] {P} OR string_split(to_id, '::')[1] {P}
  UNION SELECT to_id FROM moves WHERE string_split(from_id, '::')[1] {P} OR string_split(to_id, '::')[1] {P}
  UNION SELECT id FROM rows WHERE path {P} AND (related_to = '' OR string_split(related_to, '::')[1] {P})
  UNION SELECT path || '::' || name FROM sym_base WHERE path {P} AND path || '::' || name NOT IN (SELECT path || '::' || name FROM sym_cur)
    AND path || '::' || name NOT IN (SELECT from_id FROM moves))
SELECT e.src AS name, t.path || '::' || t.name AS to_id, e.site_path, e.site_line FROM edges_cur e JOIN sym_cur s ON s.name = e.src JOIN sym_cur t ON t.name = e.dst
WHERE e.site_path {P} AND t.path || '::' || t.name IN (SELECT id FROM known)""")
def pruned_calls_changed_only(spark, sf_dir):
    return _pruned(spark, sf_dir, True).calls.select("name", "to_id", "site_path", "site_line")


# --- the report ------------------------------------------------------------------------------------------------------

SUMMARY = with_("changed", "edges_cur", "edges_base", "sym_cur", "sym_base") + WALK + f""", {RELATED},
{REMOVED.replace(MOVES + ',', '').strip()}, dead AS (SELECT path || '::' || name AS id FROM sym_base
  WHERE path || '::' || name NOT IN (SELECT path || '::' || name FROM sym_cur) AND path || '::' || name NOT IN (SELECT from_id FROM moves))"""


@query(SUMMARY + """ SELECT '1.0' AS schema_version, CAST((SELECT count(*) FROM changed WHERE name NOT IN (SELECT name FROM gone)) AS INT) AS changed_symbols,
CAST((SELECT count(*) FROM dead) AS INT) AS deleted_symbols, CAST((SELECT count(*) FROM moves) AS INT) AS moved_symbols,
CAST((SELECT count(*) FROM removed) AS INT) AS removed_calls, CAST((SELECT count(DISTINCT name) FROM chains) AS INT) AS entry_points,
CAST((SELECT count(*) FROM on_chain) AS INT) AS nodes, CAST((SELECT count(*) FROM related) AS INT) AS related_declaration_context""")
def summary_counts(spark, sf_dir):
    symbols, edges, changed, equal, none = _context_inputs(spark, sf_dir)
    ranges = changed.withColumn("changed_lines", F.array(F.struct(F.lit(1).alias("start"), F.lit(1).alias("end"))))
    base = relation(spark, sf_dir, "sym_base")
    moved = _moves(spark, sf_dir)
    found = _impact(spark, sf_dir)
    rows = records.summary(
        spark.createDataFrame([], "test boolean"), impact.changed_symbols(changed, symbols, moved), compare.deleted_symbols(symbols, base, moved), moved,
        _removed(spark, sf_dir), found.entry_points, found.nodes, contexts.contexts(symbols, edges, ranges, equal, none),
    )
    return rows.drop("files", "test_files", "total", "declaration_context")


def _file_number(path):
    """Twice the number in the path, and one more below moved/: told by the path itself, so no task numbers all files."""
    return F.regexp_extract(path, "file([0-9]+)", 1).cast("int") * 2 + path.startswith("moved/").cast("int")


def _report(spark, sf_dir) -> report.Report:
    current, base, now, old, added = many(spark, sf_dir, "sym_cur", "sym_base", "edges_cur", "edges_base", "added")
    files = added.select("path").distinct().select(
        F.lit(0).cast("long").alias("diff_id"), _file_number(F.col("path")).alias("file_ord"), F.lit("modified").alias("status"),
        F.lit("").alias("old_path"), "path", paths.is_test(F.col("path")).alias("test"),
    )
    hunks = files.select("diff_id", "file_ord", F.lit(1).alias("hunk_ord"), *[F.lit(1).alias(c) for c in ("old_start", "old_lines", "new_start", "new_lines")])
    shown = added.select("path", "line_no", "content").distinct().join(files.select("path", "file_ord"), "path")
    order = Window.partitionBy("file_ord").orderBy("line_no")
    lines = shown.select(
        F.lit(0).cast("long").alias("diff_id"), "file_ord", F.lit(1).alias("hunk_ord"), F.row_number().over(order).alias("line_ord"), F.lit("add").alias("op"),
        F.lit(None).cast("int").alias("old_line"), F.col("line_no").alias("new_line"), "content",
    )
    return report.build(Changes(files, hunks, lines), added, report.Snapshot(current, now), report.Snapshot(base, old))


#: From added lines to every class of detail records: keys of all, and what is written of those that are told by names.
REPORT = with_("added", "edges_cur", "edges_base", "sym_cur", "sym_base") + f""", {MOVES},
kept_lines AS (SELECT a.path, a.line_no FROM added a WHERE NOT EXISTS (
  SELECT 1 FROM moves m WHERE m.body_equal AND m.path = a.path AND a.line_no BETWEEN m.start_line AND m.end_line)),
changed AS (SELECT DISTINCT s.name FROM kept_lines a JOIN sym_cur s ON a.path = s.path AND a.line_no BETWEEN s.start_line AND s.end_line)""" + WALK + f""",
{RELATED.replace(MOVES + ',', '').strip()}, {REMOVED.replace(MOVES + ',', '').strip()}, ids AS (SELECT name, path || '::' || name AS id FROM sym_cur),
dead AS (SELECT path || '::' || name AS id FROM sym_base
  WHERE path || '::' || name NOT IN (SELECT id FROM ids) AND path || '::' || name NOT IN (SELECT from_id FROM moves)),
files AS (SELECT DISTINCT CAST(regexp_extract(path, 'file([0-9]+)', 1) AS BIGINT) * 2 + CASE WHEN path LIKE 'moved/%' THEN 1 ELSE 0 END AS ord FROM added)
SELECT 0 AS class, ord, '' AS k1, '' AS k2, '' AS k3, '' AS record FROM files
UNION ALL SELECT 1, 0, id, '', '', '{{"type":"changed_symbol","id":"' || id || '"}}' FROM ids WHERE name IN (SELECT name FROM changed) AND name NOT IN (SELECT name FROM gone)
UNION ALL SELECT 2, 0, id, '', '', '{{"type":"deleted_symbol","id":"' || id || '"}}' FROM dead
UNION ALL SELECT 3, 0, i.id, x.relationship, x.related_to, '' FROM ids i JOIN (SELECT * FROM related
  UNION ALL SELECT name, 'changed_declaration', '' FROM changed WHERE name NOT IN (SELECT name FROM gone)) x ON x.name = i.name
UNION ALL SELECT 4, 0, from_id, to_id, '', '{{"type":"moved_symbol","from":"' || from_id || '","to":"' || to_id || '","body_sha256_equal":' || body_equal || '}}' FROM moves
UNION ALL SELECT 5, 0, from_id, to_id, '', '{{"type":"removed_call","from":"' || from_id || '","to":"' || to_id || '","call_site":{{"path":"' || site_path || '","line":' || site_line || '}}}}' FROM removed
UNION ALL SELECT 6, 0, id, '', '', '{{"type":"entry_point","id":"' || id || '"}}' FROM ids WHERE name IN (SELECT name FROM chains)
UNION ALL SELECT 7, 0, id, '', '', '' FROM ids WHERE name IN (SELECT name FROM on_chain)"""


@query(REPORT)
def report_rows(spark, sf_dir):
    rows = report.details(_report(spark, sf_dir), Limits())
    told = F.when(F.col("class").isin(0, 3, 7), "").otherwise(F.col("typed"))
    return rows.select("class", "ord", "k1", "k2", "k3", told.alias("record"))


@query()
def report_records(spark, sf_dir):
    """Every detail record as JSON, with its class and sort keys."""
    return report.details(_report(spark, sf_dir), Limits()).select("class", "ord", "k1", "k2", "k3", F.col("typed").alias("record"))


@query(f"SELECT DISTINCT name, key FROM (WITH symbols AS (SELECT DISTINCT name FROM ({twin('methods')})) SELECT name, regexp_replace(name, '^[^.]*[.]', '') AS key FROM symbols UNION SELECT name, string_split(name, '.')[-1] FROM symbols)")
def callable_index(spark, sf_dir):
    (methods,) = many(spark, sf_dir, "methods")
    return graph.callable_index(methods.select("name").distinct()).select("name", "key")


@query(with_("sym_cur") + " SELECT name, string_split(name, '.')[-1] AS short, string_split(name, '.')[1] AS package, path || '::' || name AS id FROM sym_cur")
def symbol_names(spark, sf_dir):
    name = F.col("name")
    return relation(spark, sf_dir, "sym_cur").select("name", names.short_name(name).alias("short"), names.package(name).alias("package"), names.symbol_id(F.col("path"), name).alias("id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_records(spark, sf_dir)
