import pytest

from strandline.schemas import EDGES
from strandline.sources import extract
from strandline.sources.syntax import golang, java
from strandline.sources.syntax.lexer import SyntaxProblem


def edges(spark, files):
    snap = extract.snapshot(spark.createDataFrame(list(files.items()), "path string, content string"))
    assert snap.edges.columns == [f.split()[0] for f in EDGES.split(", ")]
    return {(r["src"], r["dst"]): r["site_line"] for r in snap.edges.collect()}, {r["name"]: r for r in snap.symbols.collect()}


def test_go_declarations():
    got = golang.extract(
        'package app\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\n// func Not() {}\ntype T struct{ f func() }\n\nfunc A(a func(int) bool, b struct{ c int }) (x struct{ y int }, err error) {\n'
        '\tg := func() { inner() }\n\tg()\n\ts := `func Raw() {`\n\t_ = s + "}"\n}\nfunc (t *T) M() {}\nfunc (l List[K]) N() int { return 1 }\nfunc (T) O() {}\n'
        "func (_ pkg.Q) P() {}\nfunc Gen[K any](k K) { h[K](k) }\nfunc NoBody(x int)\nvar V = func() { hidden() }\n"
    )
    assert [s.name for s in got.symbols] == ["app.A", "app.T.M", "app.List.N", "app.T.O", "app.Q.P", "app.Gen"]
    assert (got.symbols[0].start_line, got.symbols[0].end_line) == (11, 16) and got.symbols[1].kind == "method_declaration"
    assert [(c.src, c.target, c.line) for c in got.calls] == [("app.A", "inner", 12), ("app.A", "g", 13), ("app.Gen", "h", 21)]


def test_go_callees():
    body = (
        "f(); Service{}.Do(); (&Repo{}).Find(); &Old{}; fmt.Println(x()); v.Run(); a.b.Deep(); pkg.T{1}.Q(); y.Z().W()\n"
        "func() { closure() }(); arr[0](1); []byte(s); map[string]int(m); t.(I).As(); (v).Par(); defer d()\n a.\n  b().\n  c()\n"
        "if z := cond(); z { go run(1) }\nvar i interface{ Hidden() }\n"
    )
    got = golang.extract(f'package p\nimport "fmt"\nimport q "x/y"\nfunc F() {{\n{body}}}\n')
    assert [c.target for c in got.calls] == [
        "f", "Service.Do", "Repo.Find", "x", "Run", "Deep", "T.Q", "W", "Z", "closure", "As", "Par", "d", "c", "b", "cond", "run",
    ]
    assert {c.line for c in got.calls if c.target in "bc"} == {7}
    for broken in ("package p\nfunc F() {", 'package p\nvar x = "abc\n', "package p\nfunc F() { ( }", "package p /* x", "package p\nfunc 1x() {}\n", "package p\nfunc F {}\n"):
        with pytest.raises(SyntaxProblem):
            golang.extract(broken)


def test_java_symbols():
    got = java.extract(
        "package org.tea;\nclass Kettle {\n  Kettle() { fill(); }\n  int boil(int n) {\n    Supplier<String> s = () -> { return \"hot\"; };\n"
        "    Runnable w = new Runnable() { public void run() { s.get(); } };\n    return n;\n  }\n}\ninterface Pourer { default void pour() {} }\n"
        "record Cup(int size) { public Cup {} }\nenum Leaf { GREEN; void steep() {} }\n"
    )
    assert [s.name.removeprefix("org.tea.") for s in got.symbols] == [
        "Kettle", "Kettle.<init>", "Kettle.boil", "Kettle.lambda@5", "Kettle.anonymous@6", "Kettle.anonymous@6.run", "Pourer", "Pourer.pour", "Cup", "Cup.<init>",
        "Leaf", "Leaf.steep",
    ]
    more = java.extract(
        "class A<T extends Comparable<T>> implements B<Map<String, List<T>>> {\n  @Override public <K> Map<K, V> get(K k) throws E { return null; }\n"
        "  private int[] xs = {1, 2}, ys;\n  static { init(); }\n  Function<A, B> f = a -> a.x();\n  abstract void none();\n  @interface Mark { int v() default 1; }\n"
        "  static class Inner { enum E { X(1) { void m() {} }, Y; E() {} } }\n  void sw(int v) { switch (v) { case 1 -> one(); default -> { two(); } } }\n}\n"
    )
    assert [s.name.removeprefix("default.") for s in more.symbols] == ["A", "A.get", "A.lambda@5", "A.none", "A.v", "A.Inner", "A.Inner.E", "A.Inner.E.m", "A.Inner.E.<init>", "A.sw"]
    assert [s.start_line for s in more.symbols][:3] == [1, 2, 5]


def test_java_calls_resolve(spark):
    a = "package com.acme;\nclass A {\n  void f() {\n    helper();\n    B.s();\n    new B().g();\n    Unknown.s();\n    System.out.println(\"x\");\n    this.helper();\n    b.lower();\n  }\n  void helper() {}\n  void println(String s) {}\n}\nclass B {\n  static void s() {}\n  void g() { helper(); }\n  void helper() {}\n}\n"
    got, _ = edges(spark, {"src/main/java/com/acme/A.java": a})
    assert got == {("com.acme.A.f", "com.acme.A.helper"): 9, ("com.acme.A.f", "com.acme.B.s"): 5, ("com.acme.A.f", "com.acme.B.g"): 6, ("com.acme.B.g", "com.acme.B.helper"): 17}
    lib = "package com.lib;\npublic class B {\n  static void s() {}\n  void g() {}\n}\nclass Util { static void work() {} static void star() {} }\n"
    user = "package com.acme;\nimport com.lib.B;\nimport static com.lib.Util.work;\nimport static com.lib.Util.*;\nclass A {\n  void f() { B.s(); new B().g(); work(); star(); Runnable r = () -> work(); }\n}\n"
    got, _ = edges(spark, {"A.java": user, "B.java": lib})
    assert {d for s, d in got if s == "com.acme.A.f"} == {"com.lib.B.s", "com.lib.B.g", "com.lib.Util.work", "com.lib.Util.star"}
    assert ("com.acme.A.lambda@6", "com.lib.Util.work") in got
    wild = "package com.acme;\nimport com.lib.*;\nclass A { void f() { B.s(); } }\n"
    got, _ = edges(spark, {"A.java": wild, "B.java": lib})
    assert got == {("com.acme.A.f", "com.lib.B.s"): 3}


def test_go_calls_resolve(spark):
    got, symbols = edges(spark, {
        "a.go": 'package app\nimport "x/lib"\nfunc A() { New(); lib.New(); v.Save(); A(); Dup() }\nfunc New() {}\nfunc Dup() { one() }\n',
        "b.go": "package app\n\ntype S struct{}\nfunc (s S) Save() {}\nfunc Dup() { two() }\n", "lib/lib.go": "package lib\nfunc New() {}\nfunc (r R) Save() {}\n",
        "a_test.go": "package app\nfunc TestA() { A() }\n",
    })
    assert set(got) == {("app.A", "app.New"), ("app.A", "app.S.Save"), ("app.A", "lib.R.Save"), ("app.A", "app.Dup")}
    assert symbols["app.Dup"]["path"] == "b.go" and "app.TestA" not in symbols


def test_syntax_problems_fail_the_snapshot(spark):
    with pytest.raises(extract.ExtractionError, match="parse b.go: syntax error"):
        edges(spark, {"a.go": "package a\n", "b.go": "package b\nfunc {"})
