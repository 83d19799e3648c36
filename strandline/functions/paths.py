"""Predicates and facts about paths, as Columns. Patterns are written for Java's and RE2's syntax alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
TEST_DIRS = ["test", "tests", "testdata"]
JAVA_TEST_SETS = ["test", "integrationTest", "functionalTest", "e2eTest"]
VENDOR_DIRS = ["vendor", "node_modules", "third_party", "dist", "build"]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".jar", ".woff", ".woff2", ".ttf",
    ".otf", ".mp4", ".mov",
]
LANGUAGES = {
    ".go": "go", ".js": "javascript", ".jsx": "javascriptreact", ".ts": "typescript", ".tsx": "typescriptreact",
    ".py": "python", ".rb": "ruby", ".rs": "rust", ".java": "java", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".md": "markdown",
}
ANALYZED = {".go": "go", ".java": "java"}
GENERATED_PATHS = ["generated", ".pb.go", "_gen."]
GENERATED_PHRASES = ["code generated", "do not edit", "auto-generated"]

JAVA_TEST_PATTERN = rf"(^|/)src/({'|'.join(JAVA_TEST_SETS)})/java/(.*/)?[^/]*\.java$"
TEST_PATTERN = rf"((^|/)({'|'.join(TEST_DIRS)})(/|$))|(_test\.go$)|({JAVA_TEST_PATTERN})"
VENDOR_PATTERN = rf"(^|/)({'|'.join(VENDOR_DIRS)})(/|$)"
EXTENSION_PATTERN = r"(\.[^./]*)$"


def is_test(path: Column) -> Column:
    """Test-only scope: a test directory, a Go test file, or a Java test source set."""
    return path.rlike(TEST_PATTERN)


def is_java_test(path: Column) -> Column:
    return path.rlike(JAVA_TEST_PATTERN)


def is_production(path: Column) -> Column:
    """Go outside of test scope; Java outside of test source sets (generic test directories count as production)."""
    return (path.endswith(".go") & ~is_test(path)) | (path.endswith(".java") & ~is_java_test(path))


def extension(path: Column) -> Column:
    """From the last dot of the last segment on; empty if there is none."""
    return F.regexp_extract(path, EXTENSION_PATTERN, 1)


def language(path: Column) -> Column:
    """By extension, in any case; the bare extension where no name is listed."""
    ext = F.lower(extension(path))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[ext], F.regexp_replace(ext, r"^\.", ""))


def analyzed_language(path: Column) -> Column:
    """The language that symbols can be extracted for; null for others."""
    return F.create_map(*[F.lit(x) for pair in ANALYZED.items() for x in pair])[F.lower(extension(path))]


def analyzed_language_exact(path: Column) -> Column:
    """Whether declarations of the path are shown: extensions in lower case only."""
    return extension(path).isin(list(ANALYZED))


def is_vendor(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/").rlike(VENDOR_PATTERN)


def is_binary(path: Column) -> Column:
    return F.lower(extension(path)).isin(BINARY_EXTENSIONS)


def is_generated(path: Column, added: Column) -> Column:
    """By the path, or by an added comment line with one of the usual phrases."""
    low = F.lower(path)
    by_path = low.contains(GENERATED_PATHS[0]) | low.contains(GENERATED_PATHS[1]) | low.contains(GENERATED_PATHS[2])

    def says(line: Column) -> Column:
        text = F.regexp_replace(line, r"(?U)^\s+", "")
        phrase = F.lower(text)
        return text.startswith("//") & (
            phrase.contains(GENERATED_PHRASES[0]) | phrase.contains(GENERATED_PHRASES[1]) | phrase.contains(GENERATED_PHRASES[2])
        )

    return by_path | F.exists(added, says)


def classification(path: Column, test: Column, added: Column) -> Column:
    """test, vendor, generated, binary in this order; source if none holds."""
    found = F.array_compact(
        F.array(
            F.when(test, "test"), F.when(is_vendor(path), "vendor"), F.when(is_generated(path, added), "generated"),
            F.when(is_binary(path), "binary"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("source")))


def clean_diff_path(path: Column) -> Column:
    """Without one leading a/ and then one leading b/."""
    return F.regexp_replace(F.regexp_replace(path, "^a/", ""), "^b/", "")


def clean_report_path(path: Column) -> Column:
    """Without diff prefixes, with forward slashes, and without slashes at the ends."""
    slashed = F.regexp_replace(clean_diff_path(path), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(slashed, "^/+", ""), "/+$", "")


class BadPattern(ValueError):
    """A glob that is empty or malformed."""


def _clean(pattern: str) -> str:
    pattern = re.sub("^b/", "", re.sub("^a/", "", pattern))
    return pattern.replace("\\", "/").strip("/")


def _segment(glob: str) -> str:
    """A segment's wildcards (`*`, `?`, classes) as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            negated = glob[i : i + 1] == "^"
            i += negated
            ranges, first = "", True
            while first or glob[i : i + 1] != "]":
                ends = []
                while True:
                    if i >= len(glob) or glob[i] in "-]":
                        raise BadPattern("syntax error in pattern")
                    ends.append(glob[i])
                    i += 1
                    if len(ends) == 1 and glob[i : i + 1] == "-":
                        i += 1
                        continue
                    break
                if i >= len(glob):
                    raise BadPattern("syntax error in pattern")
                if ends[0] <= ends[-1]:
                    ranges += "-".join(re.sub(r"([\[\]^&\\-])", r"\\\1", e) for e in dict.fromkeys(ends))
                first = False
            i += 1
            out += (f"[^/{ranges}]" if negated else f"[{ranges}]") if ranges else ("[^/]" if negated else "[^\\s\\S]")
        else:
            out += re.sub(r"([.^$+{}()|\[\]\\])", r"\\\1", c)
    return out


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for `/` and a cleaned path. `**` stands for any number of segments, none too."""
    cleaned = _clean(pattern)
    if not cleaned:
        raise BadPattern("empty pattern")
    return "^" + "".join("(/[^/]*)*" if s == "**" else "/" + _segment(s) for s in cleaned.split("/")) + "$"


def glob_match(pattern: str, path: Column) -> Column:
    return F.concat(F.lit("/"), clean_report_path(path)).rlike(glob_regex(pattern))
