"""Small repositories: sources and diffs in, records out."""

import io
import json
import random

import pytest

from strandline.operators import diffs, impact, sizing
from strandline.operators.filters import PathFilter
from strandline.operators.sizing import Limits
from strandline.plans import report
from strandline.schemas import DIFFS
from strandline.sources import extract


def snap(spark, files):
    return extract.snapshot(spark.createDataFrame(list(files.items()), "path string, content string"))


def parsed(spark, text):
    lines = diffs.diff_lines(spark.createDataFrame([(0, text)], DIFFS))
    return diffs.changes(lines), diffs.added_lines(lines)


def section(path, body, old=None, status=""):
    a = f"a/{old or path}" if status != "new file mode 100644\n" else "/dev/null"
    b = f"b/{path}" if not status.startswith("deleted") else "/dev/null"
    return f"diff --git a/{old or path} b/{path}\n{status}--- {a}\n+++ {b}\n{body}"


def built(spark, cur, base, text, options=None):
    changes, added = parsed(spark, text)
    return report.build(changes, added, snap(spark, cur), snap(spark, base) if base is not None else None, options)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


CUR = {
    "desk.go": """package shop

type Desk struct{ open bool }
type Clerk struct{}
type Stock struct{}

func (d *Desk) Greet() {
	Clerk{}.Sell(2)
}

func (c Clerk) Sell(n int) {
	Stock{}.Take(n)
	println("sold")
}

func (s Stock) Take(n int) {}
""",
    "pack_b.go": 'package shop\n\nfunc Pack() {\n\tprintln("box, tape")\n}\n',
    "desk_test.go": 'package shop\n\nimport "testing"\n\nfunc TestSell(t *testing.T) {\n\tvar c Clerk\n\tc.Sell(1)\n}\n',
}
BASE = {
    "desk.go": """package shop

type Desk struct{ open bool }
type Clerk struct{}
type Stock struct{}
type Ledger struct{}

func (d *Desk) Greet() {
	Clerk{}.Sell(2)
}

func (c Clerk) Sell(n int) {
	Stock{}.Take(n)
	Ledger{}.Note(n)
}

func (s Stock) Take(n int) {}
func (l Ledger) Note(n int) {}
""",
    "pack_a.go": 'package shop\n\nfunc Pack() {\n\tprintln("box")\n}\n',
    "desk_test.go": CUR["desk_test.go"],
}
DIFF = (
    section("desk.go", '@@ -14 +13 @@\n-\tLedger{}.Note(n)\n+\tprintln("sold")\n')
    + section("pack_b.go", '@@ -4 +4 @@\n-\tprintln("box")\n+\tprintln("box, tape")\n', "pack_a.go", "rename from pack_a.go\nrename to pack_b.go\n")
    + section("desk_test.go", "@@ -7 +7 @@\n-before\n+after\n")
)


def test_flagship_records_byte_for_byte(spark):
    """Sell changed, Note and the call of it went, Pack changed its file and its body."""
    made = built(spark, CUR, BASE, DIFF)
    out = io.StringIO()
    report.write_jsonl(made, out)
    lines = out.getvalue().splitlines()
    assert lines[0] == (
        '{"type":"summary","schema_version":"1.0","files":3,"test_files":1,"changed_symbols":2,"deleted_symbols":1,"moved_symbols":1,'
        '"removed_calls":1,"entry_points":2,"nodes":3,"context_records":{"total":4,"declaration_context":2,"related_declaration_context":2}}'
    )
    assert lines[1] == (
        '{"type":"file","status":"modified","path":"desk.go","test":false,"language":"go","classification":["source"],'
        '"diffstat":{"added_lines":1,"deleted_lines":1,"added_bytes":16,"deleted_bytes":17},'
        '"symbols":["desk.go::shop.Clerk.Sell","desk.go::shop.Desk.Greet"],"content_ref":{"kind":"workspace_file","path":"desk.go"},'
        '"hunks":[{"old_start":14,"old_lines":1,"new_start":13,"new_lines":1,"lines":['
        '{"op":"delete","old_line":14,"content":"\\tLedger{}.Note(n)"},{"op":"add","new_line":13,"content":"\\tprintln(\\"sold\\")"}]}]}'
    )
    assert lines[4:7] == [
        '{"type":"changed_symbol","id":"desk.go::shop.Clerk.Sell"}', '{"type":"changed_symbol","id":"pack_b.go::shop.Pack"}',
        '{"type":"deleted_symbol","id":"desk.go::shop.Ledger.Note"}',
    ]
    assert [json.loads(x)["relationship"] for x in lines[7:11]] == ["changed_declaration", "direct_caller", "direct_callee", "changed_declaration"]
    assert lines[8] == (
        '{"type":"declaration_context","id":"desk.go::shop.Desk.Greet","path":"desk.go","name":"Greet","kind":"method",'
        '"line_range":{"start":7,"end":9},"relationship":"direct_caller","related_to":"desk.go::shop.Clerk.Sell",'
        '"excerpt":{"content":"func (d *Desk) Greet() {\\n\\tClerk{}.Sell(2)\\n}","truncated":false,"omitted_lines":0}}'
    )
    assert lines[11:] == [
        '{"type":"moved_symbol","from":"pack_a.go::shop.Pack","to":"pack_b.go::shop.Pack","body_sha256_equal":false}',
        '{"type":"removed_call","from":"desk.go::shop.Clerk.Sell","to":"desk.go::shop.Ledger.Note","call_site":{"path":"desk.go","line":14}}',
        '{"type":"entry_point","id":"desk.go::shop.Desk.Greet"}', '{"type":"entry_point","id":"pack_b.go::shop.Pack"}',
        '{"type":"node","id":"desk.go::shop.Clerk.Sell","path":"desk.go","name":"Sell","kind":"method","start_line":11,"end_line":14,'
        '"changed":true,"changed_lines":[{"start":13,"end":13}],"package":"shop"}',
        '{"type":"node","id":"desk.go::shop.Desk.Greet","path":"desk.go","name":"Greet","kind":"method","start_line":7,"end_line":9,'
        '"calls":[{"to":"desk.go::shop.Clerk.Sell","call_site":{"path":"desk.go","line":8}}],"changed":false,"package":"shop"}',
        '{"type":"node","id":"pack_b.go::shop.Pack","path":"pack_b.go","name":"Pack","kind":"function","start_line":3,"end_line":5,'
        '"changed":true,"changed_lines":[{"start":4,"end":4}],"package":"shop"}',
    ]


def test_object_form_and_limits(spark):
    made = built(spark, CUR, BASE, DIFF)
    out = io.StringIO()
    report.write_json(made, out)
    whole = json.loads(out.getvalue())
    assert list(whole) == ["schema_version", "summary", "files", "changed_symbols", "deleted_symbols", "contexts", "moved_symbols", "removed_calls", "entry_points", "nodes"]
    assert whole["files"][0]["type"] == "file" and "type" not in whole["nodes"][0] and whole["deleted_symbols"] == ["desk.go::shop.Ledger.Note"]
    assert [len(whole[k]) for k in report.LISTS] == [3, 2, 1, 4, 1, 1, 2, 3]

    def lines(**limits):
        out = io.StringIO()
        report.write_jsonl(made, out, Limits(**limits))
        return [json.loads(x) for x in out.getvalue().splitlines()], len(out.getvalue().encode())

    got, _ = lines(max_records=5)
    assert [x["type"] for x in got[1:]] == ["file"] * 3 + ["changed_symbol"] * 2 and got[0]["nodes"] == 3
    assert got[0]["omissions"] == [{"kind": "records", "reason": "max_records", "original_count": 17, "emitted_count": 5, "omitted_count": 12}]
    got, size = lines(budget_tokens=700)
    assert size <= 2800 and got[0]["omissions"][-1]["reason"] == "budget_tokens"
    got, size = lines(budget_tokens=1)
    floor = [o for o in got[0]["omissions"] if o["reason"] == "budget_floor_exceeded"]
    assert len(got) == 1 and floor[0]["original_count"] == -(-size // 4)
    got, _ = lines(max_lines_per_hunk=1)
    assert got[1]["hunks"][0]["omitted_lines"] == 1 and got[1]["omitted_lines"] == 1 and got[1]["diffstat"]["added_lines"] == 1
    assert got[0]["omissions"][0] == {"kind": "hunk_lines", "reason": "max_lines_per_hunk", "path": "desk.go", "original_count": 2, "emitted_count": 1, "omitted_count": 1}
    got, _ = lines(review_summary=True, max_records=1)
    assert got[1]["type"] == "review_summary" and [f["path"] for f in got[1]["changed_production_files"]] == ["desk.go", "pack_b.go"]
    assert got[1]["risky_removed_call_edges"][0]["to"] == "desk.go::shop.Ledger.Note" and len(got) == 3
    got, size = lines(review_summary=True, budget_tokens=700)
    assert size <= 2800 and [x["type"] for x in got[:2]] == ["summary", "review_summary"] and got[0]["omissions"][-1]["reason"] == "budget_tokens"
    out = io.StringIO()
    report.write_json(made, out, Limits(review_summary=True))
    whole = json.loads(out.getvalue())
    assert list(whole)[:3] == ["schema_version", "summary", "review_summary"] and whole["review_summary"] == {k: v for k, v in got[1].items() if k != "type"}
    out = io.StringIO()
    report.write_json(made, out, Limits(review_summary=True, budget_tokens=600))
    assert len(out.getvalue().encode()) <= 2400 and json.loads(out.getvalue())["summary"]["omissions"]
    with pytest.raises(ValueError):
        lines(max_records=-1)


def test_pure_move_takes_lines_out_of_the_diff(spark):
    cur = {"new.go": "package app\n\nfunc Moved() { helper() }\n\nvar X = 1\n"}
    base = {"old.go": "package app\n\nfunc Moved() { helper() }\n"}
    text = section("new.go", "@@ -0,0 +1,2 @@\n+package app\n+\n@@ -0,0 +3 @@\n+func Moved() { helper() }\n@@ -0,0 +5 @@\n+var X = 1\n", status="new file mode 100644\n") + section(
        "old.go", "@@ -1,3 +0,0 @@\n-package app\n-\n-func Moved() { helper() }\n", status="deleted file mode 100644\n"
    )
    made = built(spark, cur, base, text)
    assert [r["body_equal"] for r in made.moved.collect()] == [True]
    assert ids(made.deleted) == [] and ids(made.changed) == [] and made.nodes.count() == 0
    files = {r["path"]: r for r in made.files.collect()}
    assert files["new.go"]["moved_lines_omitted"] == 1 and [len(h["lines"]) for h in files["new.go"]["hunks"]] == [2, 1]
    assert files["old.go"]["moved_lines_omitted"] == 1 and files["old.go"]["status"] == "deleted"


def test_chain_ranges_and_cycles(spark):
    cur = {"c.go": "package app\nfunc A() {\n B() }\nfunc B() {\n C()\n}\nfunc C() {\n x\n y\n D()\n z }\nfunc D() {}\nfunc P() { Q() }\nfunc Q() { P() }\nfunc R() { R() }\nfunc X() { B()\n X2() }\nfunc X2() { X() }\n"}
    text = section("c.go", "@@ -8,2 +8,2 @@\n+ x\n+ y\n@@ -11 +11 @@\n+ z }\n@@ -14 +14 @@\n+func Q() { P() }\n@@ -15 +15 @@\n+func R() { R() }\n")
    made = built(spark, cur, None, text)
    assert ids(made.entry_points) == ["c.go::app.A", "c.go::app.R"]  # a cycle without a root has no entry
    nodes = {r["name"]: r for r in made.nodes.collect()}
    assert sorted(nodes) == ["app.A", "app.B", "app.C", "app.R"]
    assert [tuple(x) for x in nodes["app.C"]["changed_lines"]] == [(8, 9), (11, 11)]
    assert ids(made.changed) == ["c.go::app.C", "c.go::app.Q", "c.go::app.R"] and made.deleted.count() == 0


def test_walks_in_memory_and_by_joins_agree(spark, monkeypatch):
    rng = random.Random(3)
    for k in range(4):
        names = [f"n{x}" for x in range(14)]
        edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range((16, 20, 26, 0)[k])})
        edges = [(a, b) for a, b in edges if a != b] + [("n1", "gone"), ("gone", "n2")]
        changed = rng.sample(names, 3) + ["gone"]
        callers = {x: [a for a, b in edges if b == x and a != "gone"] for x in names}

        def up(path, callers=callers):
            yield path
            for a in callers[path[0]]:
                if a not in path:
                    yield from up([a, *path])

        chains = [p for x in changed if x != "gone" for p in up([x]) if not callers[p[0]]]
        want = sorted({p[0] for p in chains}), sorted({x for p in chains for x in p})
        frames = [spark.createDataFrame([(x,) for x in changed], "name string"), spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in names], "name string")]
        for most in (100, 0):
            monkeypatch.setattr(impact, "LOCAL_EDGES", most)
            got = impact.impact(*frames)
            assert (ids(got.entry_points, "name"), ids(got.nodes, "name")) == want


def test_nodes_are_on_simple_paths_only(spark):
    # root -> a -> c with a <-> x: x reaches the change but is on no simple path.
    cur = {"g.go": "package p\nfunc root() { a() }\nfunc a() { c(); x() }\nfunc x() { a() }\nfunc c() {}\n"}
    made = built(spark, cur, None, section("g.go", "@@ -5 +5 @@\n+func c() {}\n"))
    assert ids(made.nodes, "name") == ["p.a", "p.c", "p.root"] and ids(made.entry_points) == ["g.go::p.root"]


def test_path_filters(spark):
    cur = {"a/x.go": "package p\nfunc Caller() { Callee() }\n", "b2/y.go": "package p\nfunc Callee() { one() }\n"}
    text = section("b2/y.go", "@@ -2 +2 @@\n+func Callee() { one() }\n") + section("vendor/v.go", "@@ -1 +1 @@\n+x\n")
    kept = built(spark, cur, None, text, PathFilter(include="b2/**"))
    assert kept.files.count() == 1 and ids(kept.nodes, "name") == ["p.Callee", "p.Caller"]
    only = built(spark, cur, None, text, PathFilter(include="b2/**", changed_only=True))
    assert ids(only.nodes, "name") == ["p.Callee"] and only.entry_points.count() == 0 and only.contexts.count() == 1
    assert built(spark, cur, None, text, PathFilter(exclude_vendor=True)).files.count() == 1
    with pytest.raises(ValueError):
        PathFilter(include="[x").validate()
    with pytest.raises(ValueError):
        PathFilter(excludes=("",)).validate()


def test_compacted_files_hide_content(spark):
    body = "".join(f"+line {k}\n" for k in range(301))
    cur = {"big.go": "package p\nfunc F() {}\n"}
    made = built(spark, cur, None, section("big.go", f"@@ -0,0 +1,301 @@\n{body}", status="new file mode 100644\n"))
    out = io.StringIO()
    report.write_jsonl(made, out)
    record = json.loads(out.getvalue().splitlines()[1])
    assert record["hunks_omitted"] and record["omitted_lines"] == 301 and "hunks" not in record
    assert record["preview"]["head_lines"][0] == "line 0" and record["preview"]["tail_lines"][-1] == "line 300" and record["preview"]["omitted_lines"] == 261
    assert made.contexts.count() == 0


def test_contexts_roll_up_by_path(spark):
    cur = {f"f{k:02}.go": f"package p\nfunc F{k}() {{\n x()\n y()\n}}\n" for k in range(22)}
    text = "".join(section(path, "@@ -3 +3 @@\n- a()\n+ x()\n") for path in cur)
    made = built(spark, cur, None, text)

    def head(**limits):
        out = io.StringIO()
        report.write_jsonl(made, out, Limits(max_context_lines=1, **limits))
        return json.loads(out.getvalue().splitlines()[0])["omissions"], len(out.getvalue().encode())

    rows, size = head()
    assert [r["path"] for r in rows] == sorted(cur) and {r["kind"] for r in rows} == {"context_lines"}
    assert {(r["original_count"], r["emitted_count"], r["omitted_count"]) for r in rows} == {(4, 1, 3)}
    assert head(budget_tokens=-(-size // 4))[0] == rows
    rows, size = head(budget_tokens=400)
    assert size <= 1600 and rows[0] == {"kind": "context_lines", "reason": "max_context_lines", "original_count": 88, "emitted_count": 22, "omitted_count": 66}
    assert rows[1] == {"kind": "omission_metadata", "reason": "budget_tokens", "original_count": 22, "emitted_count": 2, "omitted_count": 20}


def test_omissions_roll_up(spark):
    rows = [sizing.omission("hunk_lines", "max_lines_per_hunk", 2, 1, 1, f"f{k}") for k in range(25)]
    assert sizing.budget_omissions(rows)[0]["omitted_count"] == 25
    assert sizing.budget_omissions(rows)[1] == sizing.omission("omission_metadata", "budget_tokens", 25, 2, 23)
    text = "".join(section(f"f{k:02}.go", "@@ -0,0 +1,2 @@\n+a\n+b\n") for k in range(25))
    made = built(spark, {"z.go": "package z\n"}, None, text)
    out = io.StringIO()
    report.write_jsonl(made, out, Limits(max_lines_per_hunk=1))
    assert json.loads(out.getvalue().splitlines()[0])["omissions"] == [
        {"kind": "hunk_lines", "reason": "max_lines_per_hunk", "original_count": 50, "emitted_count": 25, "omitted_count": 25}
    ]
