"""Rules from source texts to issues."""

import json

import pytest
from pyspark.sql import functions as F
from simloom.functions.program import parse
from simloom.plans import rules
from simloom.sources import scan
from simloom.sources.program import build_methods, tables_of


def body(v="sum", log="", number="10"):
    return f"""{{
    let {v} = 0
    for (let i = 0; i < list.length; i++) {{
      {v} += list[i].price
    }}
    {log}
    if ({v} > {number}) {{
      {v} = {v} * 2
    }}
    this.total = {v}
    return {v}
  }}"""


CASES = "\n".join(f"      case {i}:\n        this.n = {i}\n        break" for i in range(6))
CHAIN = "if (a) { x() } " + " ".join(f"else if (a == {i}) {{ y{i}() }}" for i in range(5)) + " else { z() }"
FILES = {
    "/w/p1/A.ets": f"// header\nclass A {{\n  total: number = 0\n  sum(list: Item[]): number {body()}\n  other(): void {{ go() }}\n}}\n",
    "/w/p1/B.ets": f"class B {{\n  total: number = 0\n  private async add(list: Item[]): Promise<number> {body(log='console.log(`x ${list.length}`)')}\n}}\n",
    "/w/p2/C.ets": f"class C {{\n  total = 0\n  add(list: Item[]) {body('acc')}\n}}\n",
    "/w/p2/D.ets": f"class D {{\n  n = 0\n  pick(a: number) {{\n    switch (a) {{\n{CASES}\n      default:\n        this.n = 9\n    }}\n  }}\n  chain(a) {{\n    {CHAIN}\n  }}\n}}\n",
    "/w/p2/E.ets": "@Component\nstruct E {\n  @State items: string[] = []\n  aboutToAppear() {\n" + "    f()\n" * 81 + "  }\n  build() {\n    Column() {\n      ForEach(this.items, (x: string) => { Text(x) })\n      ForEach(this.items, (x) => { Text(x) }, (x) => x)\n    }\n  }\n  @Builder card() { ForEach(this.items) }\n}\nfunction long() {\n" + "  g()\n" * 50 + "}\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    return tables_of(spark.createDataFrame(list(FILES.items()), "file string, content string").repartition(3))


def said(issues):
    return sorted((r.file_path[-5:], r.line, r.severity, r.method_name, r.description) for r in issues.collect())


def test_reader_finds_members_statements_and_calls():
    classes = parse(FILES["/w/p2/E.ets"])
    assert [(c["class_name"], c["class_kind"], c["decorators"]) for c in classes] == [("%dflt", "CLASS", []), ("E", "STRUCT", ["Component"])]
    assert classes[1]["fields"] == [{"name": "items", "type": "string[]"}]
    appear, build, card = classes[1]["methods"]
    assert (appear["method_name"], appear["start_line"], len(appear["stmts"])) == ("aboutToAppear", 4, 81) and card["decorators"] == ["Builder"]
    assert [(c["class_name"], c["method_name"], c["nargs"]) for s in build["stmts"] for c in s["calls"] if c["class_name"] == "ForEach"] == [("ForEach", "create", 2), ("ForEach", "create", 3)]
    texts = [s["text"] for s in parse(FILES["/w/p1/A.ets"])[1]["methods"][0]["stmts"]]
    assert texts == ["let sum = 0", "for (let i = 0; i < list.length; i++)", "sum += list[i].price", "if (sum > 10)", "sum = sum * 2", "this.total = sum", "return sum"]


@pytest.mark.parametrize("text", [None, "", "{", "class", "class A", "class A { m(", "}}}", "function f(", "@", "`${", "class A { x: Map<a, b> = {} ; y(){ return `a${b}` } }", "struct S { build() { A({ x: 1 }).b() } }"])
def test_reader_takes_any_text(text):
    assert parse(text)[0]["class_name"] == "%dflt"


def test_methods_are_numbered_in_order_and_end_at_their_last_statement(tables):
    rows = [(r.file[-5:], r.class_name, r.method_name, r.start_line, r.end_line) for r in tables.methods.orderBy("seq").collect()]
    assert rows[:3] == [("A.ets", "A", "sum", 4, 14), ("A.ets", "A", "other", 16, 16), ("B.ets", "B", "add", 3, 13)]
    assert sorted(r.method_name for r in build_methods(tables.methods).collect()) == ["build", "card"]
    assert {(r.class_name, r.name, r.type) for r in tables.fields.collect()} >= {("A", "total", "number"), ("C", "total", "")}


def test_exact_and_renamed_methods(tables):
    assert said(rules.run(tables, "code-clone-type1-check")) == [
        ("A.ets", 4, 2, "sum", "Code Clone Type-1: Method 'sum' (lines 4-14) is identical to 'B.add' in B.ets:3-13. (7 statements)")
    ]
    assert rules.run(tables, "code-clone-type1-check", [{"minStmts": 8}]).count() == 0
    assert rules.run(tables, "code-clone-type1-check", [{"ignoreLogs": False}]).count() == 0
    texts = [x[-1] for x in said(rules.run(tables, "code-clone-type2-check"))]
    assert len(texts) == 3 and all("structurally identical" in x and "renamed identifiers" in x for x in texts)
    near = said(rules.run(tables, "code-clone-type1-check", [{"ignoreLogs": False, "similarityThreshold": 0.8}]))
    assert len(near) == 1 and near[0][:4] == ("A.ets", 4, 2, "sum")
    one = said(rules.run(tables, "code-clone-type2-check", [{"enableCloneClasses": True}], alert=1))
    assert [x[2:] for x in one] == [(1, "sum", "Code Clone Type-2 [Class #1, 3 members]: A.sum() in A.ets:4-14; B.add() in B.ets:3-13; C.add() in C.ets:3-13.")]


def test_fragments(tables):
    own = {"minimumTokens": 40, "normalizeIdentifiers": False}
    got = said(rules.run(tables, "code-clone-fragment-check", [own]))
    assert ("A.ets", 4, 2, "", "Code Clone Type-1 (different classes): A.ets:4-15 is similar to /w/p1/B.ets:3-14. (52 tokens, 12 lines)") in got
    assert ("E.ets", 5, 2, "aboutToAppear", "Code Clone Type-1 (same method): E.ets > E.aboutToAppear():5-18 is similar to /w/p2/E.ets > E.aboutToAppear():19-32. (40 tokens, 14 lines)") in got
    assert {x[0] for x in said(rules.run(tables, "code-clone-fragment-check"))} == {"E.ets"}  # 100 tokens
    assert not any("ts > A" in x[-1] for x in said(rules.run(tables, "code-clone-fragment-check", [{"minimumTokens": 40, "ignoreLogs": False}])))
    classes = said(rules.run(tables, "code-clone-fragment-check", [own | {"enableCloneClasses": True}]))
    assert any("Code Clone Type-1 (different classes) [Class #1, 2 members]: A.ets:4-15; B.ets:3-14." == x[-1] for x in classes)
    near = said(rules.run(tables, "code-clone-fragment-check", [own | {"similarityThreshold": 0.6}]))
    assert ("A.ets", 5, 2, "sum", "Code Clone Type-3 (different classes): A.ets > A.sum():5-11 is similar to /w/p2/C.ets > C.add():5-12. (40 tokens, 8 lines, 80% similar)") in near


def test_branches(tables):
    got = said(rules.run(tables, "switch-statement-check"))
    cases = "; ".join(f"{i} (3 lines)" for i in range(6)) + "; default (2 lines)"
    assert got == [
        ("D.ets", 2, 2, "chain", "Long if-else chain with 6 branches detected in method 'chain'. Consider using polymorphism or strategy."),
        ("D.ets", 2, 2, "pick", f"Switch statement with 7 cases detected in method 'pick'. Consider using polymorphism or strategy. Case line counts: {cases}."),
    ]
    assert [x[3] for x in said(rules.run(tables, "switch-statement-check", [{"minCases": 7}]))] == ["pick"]


def test_a_switch_in_one_statement_is_reported_once(spark, tables):
    code = "pick(a) {\n  switch (a) {\n" + CASES + "\n  }\n}"
    m = tables.methods.where("method_name = 'pick'").withColumns({"code": F.lit(code)})
    seq = m.first().seq
    s = spark.createDataFrame([(seq, "/w/p2/D.ets", 0, 2, 2, "switch (a) {\n" + CASES + "\n  }", 9)], "method long, file string, idx int, line int, col int, text string, end_line int")
    one = said(rules.run(rules.Tables(tables.files, m, s, tables.fields), "switch-statement-check"))
    assert [(x[1], x[3]) for x in one] == [(2, "pick")]


def test_long_methods_and_few_arguments(tables):
    got = said(rules.run(tables, "long-method-check"))
    assert [(x[2], x[3], x[-1][-35:]) for x in got] == [(1, "aboutToAppear", " refactoring. (Current: 82 lines, Max: 80)"[-35:]), (2, "long", " refactoring. (Current: 51 lines, Max: 50)"[-35:])]
    few = rules.run(tables, "foreach-args-check").collect()
    assert sorted((r.line, r.start_col, r.end_col, r.severity) for r in few) == [(89, 6, 12, 1), (93, 20, 26, 1)]
    assert rules.run(tables, "foreach-args-check", [{"minArgs": 1}]).count() == 0


def test_scan_of_projects(spark, tmp_path, tables):
    files = spark.createDataFrame([(f, c, None) for f, c in FILES.items()] + [("/w/p3/x.ets", None, "not read"), ("/elsewhere/y.ets", "z", None)], "file string, content string, error string")
    issues, placed = scan.batch_scan(files, "/w", {"long-method-check": None, "switch-statement-check": None})
    assert {(r.project, r.method_name) for r in issues.collect()} == {("p2", "aboutToAppear"), ("p2", "long"), ("p2", "pick"), ("p2", "chain")}
    summary = scan.scan_summary(placed, issues)
    assert sorted(map(tuple, summary.collect())) == [("p1", 2, 0, 0, True), ("p2", 3, 0, 4, True), ("p3", 1, 1, 0, False)]
    assert tuple(scan.outcome_counts(summary).first()) == (3, 2, 1)
    rows = {r.project: r for r in scan.export_rows(placed.where("error is null"), issues, "/w").collect()}
    assert rows["p2"].ets_file_count == 3 and rows["p2"].smell_total == 4 and rows["p2"].long_method_count == 2 and rows["p1"].avg_loc_per_smell_total == ""
    assert rows["p2"].avg_loc_per_smell_total == f"{rows['p2'].code_lines / 4:.2f}"
    a, b, out = (str(tmp_path / n) for n in ("a", "b", "out"))
    scan.write_report(issues, a)
    (tmp_path / "b.json").write_text(json.dumps([{"filePath": "/w/q", "messages": [{"rule": "x", "line": 3}]}]))
    assert scan.merged_report(spark, out, [str(tmp_path / "b.json")], [a]) == 5


def test_split_scans(spark):
    rows = [("a", 0, True, False, 10, 3), ("b", 0, True, False, 200_000, 2), ("c", 0, False, True, 5, 2), ("d", 1, False, False, 5, 0), ("e", 2, False, False, 5, 4)]
    t = scan.with_splits(spark.createDataFrame(rows, "rel string, depth int, success boolean, timed_out boolean, duration_ms long, child_dirs int"), max_depth=2)
    assert {r.rel: (r.split, r.split_reasons) for r in t.collect()} == {"a": (False, []), "b": (True, ["slow"]), "c": (True, ["timeout", "failed"]), "d": (False, ["failed"]), "e": (False, ["failed"])}
    assert sorted(r.rel for r in scan.leaves(t).collect()) == ["a", "d", "e"]


def test_registry():
    assert {r.level for r in rules.RULES.values()} == {"file", "project"} and len(rules.RULES) == 7
