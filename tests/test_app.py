import io
import json
import subprocess

import pytest

from strandline import cli
from strandline.operators.filters import PathFilter
from strandline.plans import app, report
from strandline.schemas import DIFFS
from strandline.sources import extract, git


def sh(repo, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=repo, check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    sh(tmp_path, "init", "-q")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor/v.go").write_text("package v\nfunc V() {}\n")
    (tmp_path / "a.go").write_text("package app\n\nfunc A() { B() }\n\nfunc B() { old() }\n")
    sh(tmp_path, "add", ".")
    sh(tmp_path, "commit", "-qm", "one")
    (tmp_path / "a.go").write_text("package app\n\nfunc A() { B() }\n\nfunc B() { fresh() }\n")
    return tmp_path


def test_git_access(spark, repo):
    assert not git.has_staged(repo) and git.has_unstaged(repo)
    assert git.diff_arguments([])[-1] == "--staged" and git.diff_arguments(["c"])[-2:] == ["c^", "c"] and "--ignore-all-space" not in git.diff_arguments(["a", "b"], True)
    with pytest.raises(ValueError):
        git.diff_arguments(["a", "b", "c"])
    with pytest.raises(git.GitError):
        git.git(repo, "show", "nothing")
    (repo / "notes.txt").write_text("x")
    assert {r["path"] for r in git.worktree(spark, str(repo)).collect()} == {"a.go", "notes.txt"}
    assert {r["path"] for r in git.sources(spark, str(repo)).collect()} == {"a.go"}
    wanted = spark.createDataFrame([(p,) for p in ("notes.txt", "gone.go", "vendor/v.go", "notes.txt", "../x", ".git/config")], "path string")
    assert {r["path"] for r in git.opened(spark, str(repo), wanted).collect()} == {"notes.txt", "vendor/v.go"}
    assert {r["path"] for r in git.opened(spark, f"file://{repo}", wanted).collect()} == {"notes.txt", "vendor/v.go"}
    assert {r["path"]: bytes(r["content"]) for r in git.at_ref(spark, str(repo), "HEAD").collect()}["a.go"].endswith(b"old() }\n")


def test_command_line_end_to_end(spark, repo, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_default_app", lambda path: app.App(spark, str(repo)))
    assert cli.main(["--fallback-to-head"]) == 1 and "HEAD is not taken" in capsys.readouterr().err
    sh(repo, "add", ".")
    target = repo / "out.jsonl"
    assert cli.main(["--output", str(target), "--review-summary"]) == 0
    rows = [json.loads(x) for x in target.read_text().splitlines()]
    assert rows[0]["changed_symbols"] == 1 and rows[1]["type"] == "review_summary"
    assert [r["id"] for r in rows if r["type"] == "entry_point"] == ["a.go::app.A"]
    assert len(rows[2]["content_ref"]["sha256"]) == 64
    out = io.StringIO()
    cli.run(["--include", "nothing/**", "--format", "json"], out)
    assert json.loads(out.getvalue())["summary"]["files"] == 0


def test_command_line_problems(capsys):
    for argv, text in [
        (["--json"], "--json goes with --version"), (["--base", "x"], "needs --head"), (["--base", "x", "--head", "y", "z"], "given twice"),
        (["--include", "["], "of --include is malformed"), (["--max-records", "-1"], "must not be negative"), (["--format", "xml"], "there is no format"),
        (["--nope"], "unrecognized arguments"),
    ]:
        assert cli.main(argv) == 1
        assert text in capsys.readouterr().err
    for argv in (["a", "b", "--base", "x"], ["a", "-head=x"], ["--", "--base"], ["-base", "x", "-head", "y", "z"]):
        assert cli.main(argv) == 1 and "given twice" in capsys.readouterr().err
    assert cli.main(["-best-effort=maybe"]) == 1 and "true or false" in capsys.readouterr().err
    assert cli.main(["--format"]) == 1 and "needs a value" in capsys.readouterr().err
    known = cli.parser()
    flags, rest = cli.split(known, ["-format", "json", "--best-effort", "-best-effort=false", "-max-records=0x10", "-exclude", "-x", "a", "--json"])
    args = known.parse_args(flags)
    assert (args.format, args.best_effort, args.max_records, args.exclude, rest) == ("json", False, 16, ["-x"], ["a", "--json"])
    with pytest.raises(SystemExit) as ended:
        cli.main(["-help"])
    assert ended.value.code == 0
    capsys.readouterr()
    out = io.StringIO()
    cli.run(["--version", "--json"], out)
    assert json.loads(out.getvalue())["schema_version"] == "1.0" and json.loads(out.getvalue())["supported_languages"] == ["go", "java"]
    assert cli.revisions(cli.parser().parse_intermixed_args(["a", "b"])) == ["a", "b"]


def fake(spark, diff, **more):
    def fail(*_):
        raise AssertionError("must not be called")

    given = {"has_staged": fail, "has_unstaged": fail, "inspect": lambda commits: spark.createDataFrame([(0, diff)], DIFFS), "current": fail, "base": fail}
    return app.App(spark, workspace=lambda paths: None, **(given | more))


DIFF = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -1 +1 @@\n+x\n"


def test_strict_and_best_effort(spark):
    with pytest.raises(app.Refused, match="x.ts is in a language"):
        fake(spark, DIFF).report([])

    def broken(*_):
        raise extract.ExtractionError("parse b.go: syntax error")

    with pytest.raises(extract.ExtractionError):
        fake(spark, DIFF.replace(".ts", ".go"), current=broken).report([])
    made = fake(spark, DIFF, current=broken, base=lambda ref: report.empty_snapshot(spark)).report([], options=app.Options(best_effort=True))
    assert [(w["code"], w["path"]) for w in made.warnings] == [("unsupported_language", "x.ts"), ("parse_error", "b.go")]
    assert made.warnings[1]["message"] == "current graph build failed: parse b.go: syntax error" and made.files.count() == 1
    nothing = fake(spark, DIFF).report([], options=app.Options(PathFilter(include="other/**")))
    assert nothing.files.count() == 0


def test_fallback_policy(spark):
    made = lambda staged, dirty: fake(spark, "", has_staged=lambda: staged, has_unstaged=lambda: dirty)
    assert made(True, True).resolve([], True) == [] and made(False, False).resolve([], True) == ["HEAD"]
    assert fake(spark, "").resolve(["x"], True) == ["x"] and fake(spark, "").resolve([], False) == []
    with pytest.raises(app.Refused):
        made(False, True).resolve([], True)
    assert [app.base_ref(c) for c in ([], ["c"], ["a", "b"])] == ["HEAD", "c^", "a"]
