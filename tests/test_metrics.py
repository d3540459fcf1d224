import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F
from simloom.operators import metrics, report
from simloom.operators.order import numbered
from simloom.plans import fixtures as X
from simloom.sources import readers


def test_long_method_tiers(spark):
    rows = [(50, False), (51, False), (80, True), (81, True), (120, True), (121, True)]
    out = metrics.long_methods(spark.createDataFrame(rows, "lines long, is_ui boolean")).collect()
    assert sorted((r.lines, r.severity, r.over) for r in out) == [(51, 2, 50), (81, 1, 80), (120, 1, 80), (121, 2, 120)]


def test_envy(spark):
    rows = [("settle", i, "foreign", "Bill") for i in range(5)] + [("even", i, "foreign", p) for i, p in enumerate("BAAB")] + [("calm", 0, "other", None)]
    got = {r.method: r for r in metrics.access_metrics(spark.createDataFrame(rows, "method string, idx int, kind string, provider string")).collect()}
    assert (got["settle"].atfd, got["settle"].lda, got["settle"].cpfd) == (5, 0.0, 1)
    assert got["even"].dominant == "B" and (got["calm"].lda, got["calm"].dominant) == (1.0, "")
    df = spark.createDataFrame(rows, "method string, idx int, kind string, provider string")
    assert [r.method for r in metrics.envious(metrics.access_metrics(df)).collect()] == ["settle"]
    assert metrics.envious(metrics.access_metrics(df), atfd=5).count() == 0


def test_switch_blocks_and_case_lengths(spark):
    src = spark.sql(X.SOURCES)
    got = src.select("id", F.explode(metrics.switch_blocks(F.split("text", "\n"))).alias("b")).select("id", "b.first", "b.column", "b.text").collect()
    assert [(r.id, r.first, r.column, r.text.count("\n") + 1) for r in sorted(got)] == [(1, 1, 2, 9), (3, 0, 0, 2), (5, 0, 0, 4), (6, 1, 0, 4), (6, 5, 0, 3)]
    lens = metrics.case_lengths(src.where("id = 1").select(F.col("id").alias("block"), "text")).orderBy("i").collect()
    assert [(r.label, r.lines) for r in lens] == [("1", 3), ("2", 2), ("default", 2)]


def test_if_chains(spark):
    got = {(r.file, r.pos): r.branches for r in metrics.if_chains(metrics.conditional_tokens(spark.sql(X.BRACES))).collect()}
    # file a: three branches, the chain inside else left out, and a single if; file b: depth never falls below zero
    assert sorted(v for (f, _), v in got.items() if f == "a") == [1, 3]
    assert sorted(v for (f, _), v in got.items() if f == "b") == [1, 2, 2]


def test_log_lines_and_blanking(spark):
    got = sorted(map(tuple, metrics.log_lines(spark.sql(X.LOGGED)).collect()))
    assert got == [("m1", n) for n in (4, 5, 6, 9, 10, 11, 12)] + [("m2", 20)]
    df = spark.createDataFrame([("a\nb\nc", [2])], "t string, n array<int>")
    assert df.select(metrics.blank_lines(F.col("t"), F.col("n"))).first()[0] == "a\n\nc"


def test_ui_methods_and_scopes(spark):
    rows = [("STRUCT", "build", [], False), ("CLASS", "build", [], False), ("CLASS", "x", ["Builder"], False), ("STRUCT", "aboutToAppear", ["Component"], False), ("STRUCT", "aboutToAppear", [], None), ("CLASS", "y", [], True)]
    df = spark.createDataFrame(rows, "k string, m string, d array<string>, v boolean")
    assert [r[0] for r in df.select(metrics.is_ui_method(F.col("k"), F.col("m"), F.col("d"), F.col("v"))).collect()] == [True, False, True, True, False, True]
    rows = [("A", "m", "A", "m"), ("A", "m", "A", "n"), ("A", None, "A", None), (None, None, None, None), ("A", "m", "B", "m")]
    s = spark.createDataFrame(rows, "a string, b string, c string, d string").select(metrics.scope(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(True)))
    assert [r[0] for r in s.collect()] == ["SAME_METHOD", "SAME_CLASS", "SAME_CLASS", "DIFFERENT_CLASS", "DIFFERENT_CLASS"]


def test_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"filePath": "/w/p1/a.ets", "messages": [{"rule": "x"}, {"rule": "y"}]}, {"filePath": "/w/p2/b.ets", "messages": [{"rule": "x"}]}, {"filePath": "/z/q", "messages": []}]')
    df = readers.issue_reports(spark, str(tmp_path / "r.json")).withColumn("project", readers.project_of(F.col("filePath"), "/w"))
    assert sorted((r.project, r.rule) for r in df.collect()) == [("p1", "x"), ("p1", "y"), ("p2", "x")]
    assert [tuple(r) for r in report.rule_matrix(df, ["p1", "p2"]).collect()] == [("x", 1, 1, 2), ("y", 1, 0, 1)]
    assert sorted(tuple(r) for r in report.rule_columns(df, {"x": "X"}).collect()) == [("p1", 1), ("p2", 1)]
    out = str(tmp_path / "csv")
    readers.write_csv(report.rule_matrix(df, ["p1"]), out)
    assert spark.read.option("header", True).csv(out).columns == ["rule", "p1", "total"]
    avg = spark.createDataFrame([(10, 4), (1, 0)], "l int, c int").select(report.average_text(F.col("l"), F.col("c"))).collect()
    assert [r[0] for r in avg] == ["2.50", ""]


def test_issue_rows(spark):
    df = spark.createDataFrame([(1, "d"), (1, "d"), (2, "d")], "line int, description string")
    rows = report.issues(df, line=F.col("line"), description=F.col("description"), rule_id=F.lit("r"), file_path=F.lit("f"))
    assert rows.columns == [c.split()[0] for c in report.ISSUE_SCHEMA.split(", ")]
    assert report.distinct_issues(rows).count() == 2 and rows.first().disabled is True
    said = spark.range(1).select(report.location_text(F.lit("a/b.ets"), F.lit("C"), F.lit("m"), F.lit(1), F.lit(9))).first()[0]
    assert said == "b.ets > C.m():1-9"
    pct = spark.range(1).select(report.fragment_text(F.lit("Type-3"), F.lit("same class"), F.lit("L"), F.lit("R"), F.lit(5), F.lit(2), F.lit(0.875))).first()[0]
    assert pct == "Code Clone Type-3 (same class): L is similar to R. (5 tokens, 2 lines, 88% similar)"


def test_numbers_and_names_as_text(spark):
    values = [0.0, 0.125, 1.005, 2.675, 1.115, 0.995, 12.345, 99.995, 0.004999, 1 / 3]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(report.to_fixed(F.col("x")), report.signed_fixed(-F.col("x")), report.js_round(F.col("x") * 100), report.js_round(-F.col("x") - 0.5)).collect()
    for v, r in zip(values, got):
        exact = Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert r[0] == str(exact) and (r[1] == f"-{exact}" or v == 0) and r[2] == math.floor(v * 100 + 0.5) and r[3] == math.floor(-v - 0.5 + 0.5)
    assert spark.range(1).select(report.safe_name(F.lit("a b/c-d_e.f"))).first()[0] == "a_b_c-d_e.f"
    assert report.clone_kind(False, False) == "Type-1" and report.clone_kind(True, False) == "Type-2"


def test_numbered_rows_are_dense_and_in_order(spark):
    got = numbered(spark.range(1000).repartition(7), "n", F.col("id").desc()).collect()
    assert sorted((r.n, r.id) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    assert numbered(spark.range(0), "n", "id").count() == 0


def test_source_files(spark, tmp_path):
    (tmp_path / "a.ets").write_text("x\n// c\n\n/* d\n*/ y")
    df = readers.source_files(spark, str(tmp_path / "*.ets"))
    assert readers.code_lines(df).first().loc == 2 and df.first().error is None
    missing = spark.createDataFrame([("file:/none",)], "file string")
    assert readers.diagnostics(readers.source_files(spark, str(tmp_path / "*.ets"), missing)).first().failed == 1
    dirs = spark.createDataFrame([(n,) for n in ("b", ".git", "a", "node_modules")], "name string")
    assert [r.name for r in readers.child_dirs(dirs).collect()] == ["a", "b"] and readers.child_dirs(dirs, hidden=True, limit=1).first().name == ".git"


def test_duplicate_stream(spark, tmp_path):
    from simloom.streaming.incremental import duplicate_stream

    src, store, out, ck = (str(tmp_path / n) for n in ("src", "store", "out", "ck"))
    schema = "doc_id long, text string"
    for rows in ([(1, "a  b"), (2, "c")], [(3, "a b"), (4, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = duplicate_stream(spark.readStream.schema(schema).parquet(src), store, out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [tuple(r)[:2] for r in spark.read.parquet(out).select("doc_id", "first_id").collect()] == [(3, 1)]
