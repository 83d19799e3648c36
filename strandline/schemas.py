"""Relations of the engine, as Spark DDL."""

DIFFS = "diff_id long, diff string"
ADDED_LINES = "diff_id long, path string, line_no int, content string"
FILE_CHANGES = "diff_id long, file_ord int, status string, old_path string, path string, test boolean"
HUNKS = "diff_id long, file_ord int, hunk_ord int, old_start int, old_lines int, new_start int, new_lines int"
HUNK_LINES = (
    "diff_id long, file_ord int, hunk_ord int, line_ord int, op string, old_line int, new_line int, content string"
)
SOURCES = "path string, content string"
SYMBOLS = "name string, path string, kind string, start_line int, end_line int, source string"
CALL_REFS = (
    "path string, language string, package string, seq long, src string, target string, site_line int, site_code string"
)
JAVA_IMPORTS = "path string, is_static boolean, is_wildcard boolean, owner string, short string, ord int"
EDGES = "src string, dst string, site_path string, site_line int, site_code string"
WARNINGS = "code string, message string, path string, symbol string"
OMISSIONS = (
    "kind string, reason string, path string, record_type string, original_count long, emitted_count long, "
    "omitted_count long"
)
RANGES = "array<struct<start int, end int>>"
EMPTY_RANGES = f"cast(null as {RANGES})"

#: Version stamped on every summary (a fixed value of the output format).
SCHEMA_VERSION = "1.0"
