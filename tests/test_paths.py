import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import names, paths, texts


def column(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", fn(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_scopes(spark):
    cases = {
        "a/b.go": (False, True), "a/b_test.go": (True, False), "test/x.go": (True, False), "a/testdata/x.go": (True, False), "testing/x.go": (False, True),
        "tests/A.java": (True, True), "src/test/java/p/A.java": (True, False), "m/src/integrationTest/java/A.java": (True, False),
        "src/e2eTest/java/A.kt": (False, False), "src/main/java/A.java": (False, True), "x.py": (False, False), "a/test": (True, False),
    }
    assert column(spark, cases, paths.is_test) == [a for a, _ in cases.values()]
    assert column(spark, cases, paths.is_production) == [b for _, b in cases.values()]


def test_facts(spark):
    given_paths = ["a/b.GO", "x.yml", "Makefile", ".bashrc", "a.b/c", "img.JPeG", "z.tar.gz", "vendor/x.go", "my\\vendor\\x", "a/BUILD/x"]
    assert column(spark, given_paths, paths.language) == ["go", "yaml", "", "bashrc", "", "jpeg", "gz", "go", "", ""]
    assert column(spark, given_paths, paths.is_binary) == [False, False, False, False, False, True, True, False, False, False]
    assert column(spark, given_paths, paths.is_vendor) == [False] * 7 + [True, True, False]
    added = F.array(F.lit("  // Code generated by x. DO NOT EDIT."), F.lit("code"))
    assert column(spark, ["a.go"], lambda x: paths.is_generated(x, added)) == [True]
    assert column(spark, ["a/b/x", "b/b/x", "a/x", "x"], paths.clean_diff_path) == ["x", "b/x", "x", "x"]
    assert column(spark, ["a/b/x", "\\x\\y\\", "/x//"], paths.clean_report_path) == ["x", "x/y", "x"]


GLOBS = [
    ("**/*_test.go", "a/b/x_test.go", True), ("**/*_test.go", "x_test.go", True), ("vendor/**", "vendor", True), ("vendor/**", "vendor/a/b", True),
    ("vendor/**", "x/vendor/b", False), ("x/*/z", "x/y/z", True), ("x/*/z", "x/y/y/z", False), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a-c]x", "zx", True), ("x.go", "xago", False), ("**", "a/b", True), ("a/**/b", "a/b", True),
    ("a/**/b", "a/x/y/b", True), ("internal/**/*.go", "internal/x.go", True), ("/x/", "x", True),
]


def test_globs(spark):
    rows = spark.range(1)
    got = rows.select(*[paths.glob_match(p, F.lit(x)).alias(f"c{i}") for i, (p, x, _) in enumerate(GLOBS)]).first()
    assert list(got) == [w for *_, w in GLOBS]
    for bad in ("", "/", "[", "[]a]", "a/[b", "[-a]", "[a-"):
        with pytest.raises(paths.BadPattern):
            paths.glob_regex(bad)


def slow_glob(pattern, name):
    if not pattern:
        return not name
    if pattern[0] == "**":
        return any(slow_glob(pattern[1:], name[i:]) for i in range(len(name) + 1))
    if not name:
        return False
    head = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern[0])
    return re.fullmatch(head, name[0]) is not None and slow_glob(pattern[1:], name[1:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["**", "*", "x", "?", "x*", "*y"]), min_size=1, max_size=5), st.lists(st.sampled_from(["x", "y", "xy", "xx"]), min_size=1, max_size=5))
def test_glob_regex_is_segment_matching(pattern, name):
    assert bool(re.search(paths.glob_regex("/".join(pattern)), "/" + "/".join(name))) == slow_glob(pattern, name)


def test_names_and_texts(spark):
    given_names = ["p.F", "p.T.m", "com.acme.A", "x"]
    assert column(spark, given_names, names.node_kind) == ["function", "method", "method", "function"]
    assert column(spark, given_names, names.callable_name) == ["F", "T.m", "acme.A", "x"]
    assert column(spark, ["", "a", "a\n", "a\n\n", "\n"], texts.lines) == [[], ["a"], ["a"], ["a", ""], [""]]
    long = "\n".join(map(str, range(83))) + "\n"
    got = column(spark, [long, "a\nb\n"], texts.excerpt)
    assert (got[0]["truncated"], got[0]["omitted_lines"], got[0]["content"].count("\n")) == (True, 3, 79)
    assert tuple(got[1]) == ("a\nb\n", False, 0)
