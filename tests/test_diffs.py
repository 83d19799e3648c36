import random

from strandline.operators import diffs
from strandline.schemas import DIFFS


def read(spark, *texts):
    lines = diffs.diff_lines(spark.createDataFrame(list(enumerate(texts)), DIFFS))
    made = diffs.changes(lines)
    return (
        sorted(tuple(r) for r in diffs.added_lines(lines).collect()), sorted(tuple(r) for r in made.files.collect()),
        sorted(tuple(r) for r in made.hunks.collect()), sorted(tuple(r) for r in made.hunk_lines.collect()),
    )


def test_cases(spark):
    text = (
        "diff --git a/x.go b/x.go\nindex 1..2 100644\n--- a/x.go\n+++ b/x.go\n@@ -10 +10 @@ func f\n-old\n+new\n@@ -20,0 +21,3 @@\n+a\n+  \n+b\r\n"
        "diff --git a/n_test.go b/n_test.go\nnew file mode 100644\n--- /dev/null\n+++ b/n_test.go\n@@ -0,0 +1 @@\n+t\n\\ No newline at end of file\n"
        "diff --git a/d.go b/d.go\ndeleted file mode 100644\n--- a/d.go\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-p\n-q\n"
        "diff --git a/o.go b/r.go\nsimilarity index 100%\nrename from o.go\nrename to r.go\n"
        "diff --git a/e.go b/e.go\n--- a/e.go\n+++ b/e.go\n@@ -1 +1,2 @@\n-x\n\\ No newline at end of file\n+x\n+y\n"
    )
    added, files, hunks, lines = read(spark, text, "", "no diff at all\n")
    assert added == [(0, "e.go", 1, "x"), (0, "e.go", 2, "y"), (0, "x.go", 10, "new"), (0, "x.go", 21, "a"), (0, "x.go", 23, "b")]
    assert files == [
        (0, 1, "modified", "", "x.go", False), (0, 2, "added", "", "n_test.go", True), (0, 3, "deleted", "d.go", "d.go", False),
        (0, 4, "renamed", "o.go", "r.go", False), (0, 5, "modified", "", "e.go", False),
    ]
    assert hunks[:2] == [(0, 1, 1, 10, 1, 10, 1), (0, 1, 2, 20, 0, 21, 3)]
    assert [x for x in lines if x[1] == 1] == [
        (0, 1, 1, 1, "delete", 10, None, "old"), (0, 1, 1, 2, "add", None, 10, "new"), (0, 1, 2, 1, "add", None, 21, "a"),
        (0, 1, 2, 2, "add", None, 22, "  "), (0, 1, 2, 3, "add", None, 23, "b"),
    ]
    assert [x[4:] for x in lines if x[1] == 3] == [("delete", 1, None, "p"), ("delete", 2, None, "q")]


def in_turn(text):
    """The same numbering, one line after the other."""
    out, path, line, inside = [], "", 0, False
    for x in text.split("\n")[:-1]:
        if x.startswith("+++ "):
            path, inside = x[4:].removeprefix("a/").removeprefix("b/"), False
        elif x.startswith("@@ "):
            line, inside = int(x.split("+")[1].split(" ")[0].split(",")[0]), True
        elif inside and path != "/dev/null":
            if x.startswith("+") and not x.startswith("+++"):
                if x[1:].strip():
                    out.append((path, line, x[1:]))
                line += 1
            elif not (x.startswith("-") and not x.startswith("---")) and not x.startswith("\\ No newline"):
                line += 1
    return out


def test_numbering_is_that_of_a_walk(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        text = ""
        for f in range(rng.randint(1, 3)):
            target = rng.choice([f"b/f{f}.go", "/dev/null", "b/b/x.go"])
            text += f"diff --git a/f{f}.go b/f{f}.go\n--- a/f{f}.go\n+++ {target}\n"
            for h in range(rng.randint(0, 3)):
                text += f"@@ -{rng.randint(1, 99)} +{rng.randint(1, 99)},{rng.randint(0, 9)} @@ x\n"
                text += "".join(rng.choice(["+a", "-b", " c", "+", "+ ", "+++z", "---y", "\\ No newline at end of file", "+é"]) + "\n" for _ in range(rng.randint(0, 8)))
        texts.append(text)
    added, *_ = read(spark, *texts)
    want = sorted((i, *row) for i, text in enumerate(texts) for row in in_turn(text))
    assert added == want
