import math

import pytest
from pyspark.sql import functions as F
from simloom.functions import lexer, similarity
from simloom.functions import text as T
from simloom.plans import fixtures, options


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f,given,wanted",
    [
        (T.normalize_basic, "let   x   =   1", "let x = 1"),
        (T.normalize_basic, "  a \n b ", "a b"),
        (T.normalize_basic, "@/path/to/file.ets: SomeClass", "@FILE: SomeClass"),
        (T.normalize_basic, "this: @entry/a.ets: Foo", "this: @FILE: CLASS"),
        (T.normalize_basic, "%AC123 some text %AC456", "%AC some text %AC"),
        (T.rename_identifiers, "let foo = bar + foo", "let ID_1 = ID_2 + ID_1"),
        (T.rename_identifiers, "i = MAX + été9 + console.x1", "i = MAX + été9 + console.ID_1"),
        (T.normalize_literals, 'config.set("timeout", 3000)', "config.set(STR, NUM)"),
        (T.normalize_literals, "1.5e-3 0x1A2B a9", "NUM NUM a9"),
        (T.normalize_literals, "12. a 3.x", "NUM. a NUMx"),
        (T.strip_types, "let a: Map<string, number>[] = b as Foo", "let a = b "),
        (T.strip_decorators, "@Component(a) struct X @State y", " struct X  y"),
        (T.is_log, 'Logger.debug("debug")', True),
        (T.is_log, 'doSomething() && console.log("done")', False),
        (T.base_name, "a/b\\c.ets", "c.ets"),
        (T.base_name, "a/", "a/"),
        (T.djb2, "", "0"),
        (T.djb2, "abc", "17862"),
        (T.unwrapped, "((Promise))", "Promise"),
        (T.is_ignored_type, "(string | null)", True),
        (T.is_ignored_type, "Map<string | Foo>|null", False),
        (T.is_ignored_type, "", True),
        (T.distinct_parts, "a b|a  c", 3),
        (T.case_count, "case 1: default: lowercase case_x", 2),
        (T.contains_switch, "myswitch (a)", False),
        (T.contains_switch, "switch (a)", True),
    ],
)
def test_golden(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


def test_djb2_matches_its_definition(spark):
    def model(s):
        h = 0
        for i in range(0, len(b := s.encode("utf-16-be")), 2):
            h = (h * 31 + (b[i] << 8 | b[i + 1]) + 2**31) % 2**32 - 2**31
        return format(h, "x")

    for s in ("hello world", "réeux \U0001f600 ß", "x" * 500):
        assert one(spark, T.djb2, s) == model(s)


def test_offsets(spark):
    text = "ab\n\ncde"
    for off in range(len(text) + 1):
        line, col = spark.createDataFrame([(text,)], "x string").select(*T.offset_line(F.col("x"), F.lit(off))).first()
        assert (line, col) == (text[:off].count("\n") + 1, off - (text.rfind("\n", 0, off) + 1))


def test_code_lines(spark):
    df = spark.createDataFrame([("f() {\r\n\n  a;\n}", 9, True), (None, 3, True), ("", 4, True), ("x", 1, False)], "c string, n int, b boolean")
    assert [r[0] for r in df.select(T.code_line_count(F.col("c"), F.col("n"), F.col("b"))).collect()] == [2, 3, 4, 0]


def test_similarity():
    assert similarity.lcs_length("ABCBDAB", "BDCAB") == 4
    assert similarity.lcs_similarity(list("abcd"), list("acde")) == 0.75
    assert (similarity.lcs_similarity([], []), similarity.lcs_similarity(["a"], [])) == (1.0, 0.0)


def test_grams(spark):
    g = spark.sql("select array('a','b','c','a','b') t").select(similarity.grams(F.col("t"), 2, "")).first()[0]
    assert sorted(g) == ["ab", "ab", "bc", "ca"]
    assert spark.sql("select array('a') t").select(similarity.grams(F.col("t"), 2)).first()[0] == []


def test_lexer():
    t = lexer.tokenize("if (a >= b) { // note\n  return `x` + 'q' >> 2; }\n@State x = null", literals=True)
    assert [x[0] for x in t] == "if ( a > = b ) { return STR + STR > > NUM ; } @ State x = NULL".split()
    assert [x[0] for x in lexer.tokenize("`a${b} c` + d", literals=True)] == ["STR", "b", "}", "c", "STR"]  # no re-scan after ${
    kinds = {x[0]: x[1] for x in t}
    assert kinds["if"] == "KEYWORD" and kinds["@"] == "DECORATOR" and kinds["NULL"] == "LITERAL" and kinds["{"] == "PUNCTUATION"
    assert [x[2] for x in t if x[0] == "return"] == [2] and [x[3] for x in t if x[0] == "return"] == [2]
    assert [x[0] for x in lexer.tokenize("a >= b >> c")] == ["a", ">", "=", "b", ">", ">", "c"]
    assert [x[0] for x in lexer.tokenize("foo bar foo x", rename=True)] == ["ID_0", "ID_1", "ID_0", "x"]
    assert [x[0] for x in lexer.tokenize("let a: Map<string, X> = f(b as C, d)", drop_types=True)] == "let a = f ( b , d )".split()
    assert [x[0] for x in lexer.tokenize("@A(b(c), d) @E struct F", drop_decorators=True)] == ["struct", "F"]
    assert lexer.tokenize(None) == lexer.tokenize("") == [] and [x[0] for x in lexer.tokenize("a << b #c")] == ["a", "b"]


def test_options():
    d = options.MethodCloneOptions()
    assert options.parse(d, [{"minStmts": 0, "ignoreLogs": "no", "similarityThreshold": 0.5}]) == options.MethodCloneOptions(similarity=0.5)
    assert options.parse(d, [{"min_stmts": True}]) == d == options.parse(d, None) == options.parse(d, [3])
    assert options.parse(options.ForEachOptions(), [{"minArgs": 2, "min_args": 5}]).min_args == 5
    assert options.LongMethodOptions().limit == 50 and options.parse(options.LongMethodOptions(), [{"maxStmts": 7}]).limit == 7
    assert math.isnan(options.LongMethodOptions().max_lines)
    assert options.arguments(["--a=1", "--b"]) == {"a": "1", "b": "true"}
    with pytest.raises(ValueError):
        options.projects(["a", " "])


def test_fixture_literals(spark):
    assert spark.sql(fixtures.values("id, x", (1, "it's\na\\b"), (2, ""), (3, None))).orderBy("id").collect()[0].x == "it's\na\\b"


def test_token_rows_leave_in_short_batches(spark, monkeypatch):
    texts = ["let a = `x${b}` // c\n@D('e') f", None, "", "x += 1; " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "file long, content string")
    got = sorted(map(tuple, lexer.token_rows(df).collect()))
    assert got == [(f, i, *t) for f, text in enumerate(texts) for i, t in enumerate(lexer.tokenize(text))] and len(got) > 20000
    monkeypatch.setattr(lexer, "_AT_ONCE", 1000)
    table = lexer.pa.RecordBatch.from_pydict({"file": [1, 2], "content": ["x += 1; " * 5000] * 2})
    sizes = [b.num_rows for b in lexer._rows(iter([table]))]
    assert sum(sizes) == 40000 and max(sizes) == 1000
