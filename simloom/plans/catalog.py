"""Queries over the driver's tables, one per operator group, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.functions import lexer
from simloom.functions import text as T
from simloom.functions.similarity import grams, lcs_similarity_udf
from simloom.operators import clones, fragments, metrics, report, runs
from simloom.operators.components import connected_components
from simloom.plans import fixtures as X
from simloom.scratch import materialize
from simloom.sources.readers import document_methods, document_tokens, load, project_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Defaults of the rules.
WINDOW, SIMILARITY, STMT_SIMILARITY, LIMIT, SOFT, HARD = 100, 0.8, 0.5, 50, 80, 120
MIN_TYPES, MIN_PARTS, MIN_CASES = 3, 20, 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Pieces of DuckDB SQL.
_WORDS = r"list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda w: w <> '')"
_STMTS = r"list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x09-\x0D\x20]'))"
_WB, _WE = "(^|[^A-Za-z0-9_])", "([^A-Za-z0-9_]|$)"


def _basic(c: str) -> str:
    c = rf"regexp_replace({c}, '[\x09-\x0D\x20]+', ' ', 'g')"
    c = f"trim({c}, ' ')"
    c = rf"regexp_replace({c}, '@[^:\x09-\x0D\x20]+\.[a-z]+:', '@FILE:', 'gi')"
    c = f"regexp_replace({c}, 'this: @FILE: [A-Za-z0-9_]+', 'this: @FILE: CLASS', 'g')"
    return f"regexp_replace({c}, '%AC[0-9]+', '%AC', 'g')"


_CONTENT = f"array_to_string(list_transform({_STMTS}, lambda s: {_basic('s')}), '|')"
_METHODS = f"m AS (SELECT doc_id AS seq, source AS project, lang, {_STMTS} AS stmts, {_CONTENT} AS content FROM documents)"
_WINS = f"""t AS (SELECT doc_id AS file, {_WORDS} AS w FROM documents),
win AS (SELECT file, i AS start, md5(array_to_string(w[i+1:i+{WINDOW}], '|')) AS fp FROM (SELECT file, w, unnest(range(0, len(w) - {WINDOW} + 1)) AS i FROM t WHERE len(w) >= {WINDOW}))"""
_PAIRS = f"""{_WINS}, pr AS (SELECT a.file AS f1, a.start AS s1, b.file AS f2, b.start AS s2 FROM win a JOIN win b ON a.fp = b.fp
  AND (a.file < b.file OR (a.file = b.file AND b.start - a.start >= {WINDOW})))"""
_RUNS = f"""{_PAIRS}, mk AS (SELECT *, CASE WHEN lag(s1) OVER o + 1 = s1 AND lag(s2) OVER o + 1 = s2 THEN 0 ELSE 1 END AS nw FROM pr WINDOW o AS (PARTITION BY f1, f2 ORDER BY s1, s2)),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY f1, f2 ORDER BY s1, s2) AS island FROM mk),
runs AS (SELECT f1, min(s1) AS s1, min(s1) + count(*) + {WINDOW - 2} AS e1, f2, min(s2) AS s2, min(s2) + count(*) + {WINDOW - 2} AS e2, count(*) + {WINDOW - 1} AS token_count FROM isl GROUP BY f1, f2, island)"""
_NEAR = f"""{_METHODS}, flat AS (SELECT seq, unnest(stmts) AS s FROM m), cnt AS (SELECT seq, s, count(*) AS c FROM flat GROUP BY seq, s), tot AS (SELECT seq, sum(c) AS n FROM cnt GROUP BY seq),
sh AS (SELECT a.seq AS a, b.seq AS b, sum(least(a.c, b.c)) AS m FROM cnt a JOIN cnt b ON a.s = b.s AND a.seq < b.seq GROUP BY a.seq, b.seq),
near AS (SELECT sh.a, sh.b, m / (x.n + y.n - m) AS similarity FROM sh JOIN tot x ON x.seq = sh.a JOIN tot y ON y.seq = sh.b
  JOIN m p ON p.seq = sh.a JOIN m q ON q.seq = sh.b WHERE array_to_string(p.stmts, '|') <> array_to_string(q.stmts, '|') AND x.n <= {clones.RATIO} * y.n AND y.n <= {clones.RATIO} * x.n AND m / (x.n + y.n - m) >= {STMT_SIMILARITY})"""
_EXACT = f"{_METHODS}, ex AS (SELECT a.seq AS a, b.seq AS b FROM m a JOIN m b ON a.content = b.content AND a.seq < b.seq)"


_TEXTS = f"(SELECT id::BIGINT AS id, text FROM ({X.STATEMENTS}) UNION ALL SELECT doc_id + 1000, text FROM documents)"


def _texts(spark, sf):
    """The statement literals and all whole documents."""
    own = spark.sql(X.STATEMENTS).select(F.col("id").cast("long").alias("id"), "text")
    return own.unionByName(load(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))


@query(rf"SELECT id, coalesce(regexp_matches(text, '(?is)^\s*(console|hilog|logger)\.\w+\s*\(.*\)\s*$'), false) AS is_log FROM {_TEXTS}")
def q01_log_filter(spark, sf):
    return _texts(spark, sf).select("id", F.coalesce(T.is_log(F.col("text")), F.lit(False)).alias("is_log"))


@query(rf"WITH {_METHODS} SELECT seq AS doc_id, len(list_distinct(list_filter(string_split_regex(content, '[\x09-\x0D\x20]+|\|'), lambda x: x <> '')))::BIGINT AS parts FROM m WHERE len(list_distinct(list_filter(string_split_regex(content, '[\x09-\x0D\x20]+|\|'), lambda x: x <> ''))) >= {MIN_PARTS}")
def q02_complexity(spark, sf):
    return document_methods(spark, sf).select(F.col("seq").alias("doc_id"), T.distinct_parts(F.col("content")).alias("parts")).where(F.col("parts") >= MIN_PARTS)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def q03_first_wins(spark, sf):
    return clones.first_wins(load(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_KIND = "CASE WHEN regexp_matches(w, '^[0-9]+([.,][0-9]+)*$') THEN 'LITERAL' WHEN regexp_matches(w, '^@') THEN 'DECORATOR' WHEN regexp_matches(w, '^[!-/:-@\\[-`{-~]+$') THEN 'OPERATOR' ELSE 'IDENTIFIER' END"


@query(f"SELECT file, count(*)::BIGINT AS tokens, count(DISTINCT kind)::BIGINT AS types FROM (SELECT file, {_KIND} AS kind FROM (SELECT doc_id AS file, unnest({_WORDS}) AS w FROM documents)) GROUP BY file HAVING count(*) >= {WINDOW} AND count(DISTINCT kind) >= {MIN_TYPES}")
def q04_admission(spark, sf):
    w = F.col("w")
    kind = F.when(w.rlike("^[0-9]+([.,][0-9]+)*$"), "LITERAL").when(w.rlike("^@"), "DECORATOR").when(w.rlike(r"^[!-/:-@\[-`{-~]+$"), "OPERATOR").otherwise("IDENTIFIER")
    t = document_tokens(spark, sf).select("file", F.explode("tokens").alias("w")).select("file", kind.alias("kind"))
    return t.groupBy("file").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("kind").alias("types")).where((F.col("tokens") >= WINDOW) & (F.col("types") >= MIN_TYPES))


_LINES = r"len(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')), lambda x: x NOT IN ('', '{', '}')))"
_LONG = f"lm AS (SELECT doc_id, source, lines, CASE WHEN ui AND lines > {HARD} THEN {HARD} WHEN ui AND lines > {SOFT} THEN {SOFT} WHEN NOT ui AND lines > {LIMIT} THEN {LIMIT} END AS over, CASE WHEN ui AND lines <= {HARD} THEN 1 ELSE 2 END AS severity FROM (SELECT doc_id, source, lang = 'de' AS ui, {_LINES}::BIGINT AS lines FROM documents))"


def _long(spark, sf):
    d = load(spark, sf, "documents")
    lines = T.code_line_count(F.col("text"), F.lit(0), F.lit(True))
    return metrics.long_methods(d.select("doc_id", "source", (F.col("lang") == "de").alias("is_ui"), lines.alias("lines")), LIMIT, SOFT, HARD)


@query(f"WITH {_LONG} SELECT doc_id, lines, over AS limit_lines, severity FROM lm WHERE over IS NOT NULL")
def q05_long_method(spark, sf):
    return _long(spark, sf).select("doc_id", "lines", F.col("over").alias("limit_lines"), "severity")


_ACCESS = """acc AS (SELECT l_orderkey AS method, l_linenumber AS idx, l_suppkey, s_nationkey AS provider, CASE WHEN s_nationkey = c_nationkey THEN 'local' ELSE 'foreign' END AS kind
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_DOMINANT = "top AS (SELECT method, provider AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY n DESC, seen) AS r FROM (SELECT method, provider, count(*) AS n, min(struct_pack(idx, l_suppkey, provider)) AS seen FROM acc WHERE kind = 'foreign' GROUP BY method, provider)) WHERE r = 1)"


def _accesses(spark, sf):
    line, order, cust, supp = (load(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = line.join(order, line.l_orderkey == order.o_orderkey).join(cust, order.o_custkey == cust.c_custkey).join(supp, line.l_suppkey == supp.s_suppkey)
    kind = F.when(F.col("s_nationkey") == F.col("c_nationkey"), "local").otherwise("foreign")
    # Line numbers repeat within an order, so the place is made total.
    place = F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_suppkey") * 1000 + F.col("s_nationkey")
    return joined.select(F.col("l_orderkey").alias("method"), place.alias("idx"), kind.alias("kind"), F.col("s_nationkey").cast("string").alias("provider"))


@query(f"""WITH {_ACCESS}, {_DOMINANT}, a AS (SELECT method, count(*) FILTER (WHERE kind = 'foreign') AS atfd, count(*) FILTER (WHERE kind = 'local') AS loc, count(DISTINCT provider) FILTER (WHERE kind = 'foreign') AS cpfd FROM acc GROUP BY method)
SELECT method AS l_orderkey, atfd::BIGINT AS atfd, round(CASE WHEN loc + atfd = 0 THEN 1.0 ELSE loc / (loc + atfd) END, 6) AS lda, cpfd::BIGINT AS cpfd, dominant::VARCHAR AS dominant FROM a JOIN top USING (method)
WHERE atfd > 4 AND CASE WHEN loc + atfd = 0 THEN 1.0 ELSE loc / (loc + atfd) END < 0.33 AND cpfd <= 2""")
def q06_feature_envy(spark, sf):
    return metrics.envious(metrics.access_metrics(_accesses(spark, sf))).select(F.col("method").alias("l_orderkey"), "atfd", F.round("lda", 6).alias("lda"), "cpfd", "dominant")


@query(f"SELECT id, CASE WHEN strpos(text, 'ForEach') > 0 THEN line ELSE -1 END AS at_line, CASE WHEN strpos(text, 'ForEach') > 0 THEN col + strpos(text, 'ForEach') - 1 ELSE -1 END::INTEGER AS at_col FROM ({X.CALLS}) WHERE class_name = 'ForEach' AND method_name = 'create' AND nargs < 3")
def q07_call_arity(spark, sf):
    return metrics.few_arguments(spark.sql(X.CALLS)).select("id", "at_line", F.col("at_col").cast("int").alias("at_col"))


_CASES = "len(list_filter(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda w: w IN ('case', 'default')))"


@query(f"""SELECT id, {_CASES.format('text')}::BIGINT AS cases, (len(regexp_extract_all(text, '\\{{')) - len(regexp_extract_all(text, '\\}}')))::BIGINT AS braces, regexp_matches(text, '\\bswitch\\s*\\(') AS has_switch FROM ({X.SOURCES})
UNION ALL SELECT page_id + 1000, {_CASES.format('html')}::BIGINT, (len(regexp_extract_all(html, '\\{{')) - len(regexp_extract_all(html, '\\}}')))::BIGINT, regexp_matches(html, '\\bswitch\\s*\\(') FROM pages""")
def q08_case_counts(spark, sf):
    both = spark.sql(X.SOURCES).select(F.col("id").cast("long").alias("id"), "text").unionByName(load(spark, sf, "pages").select((F.col("page_id") + 1000).alias("id"), F.col("html").alias("text")))
    return both.select("id", T.case_count(F.col("text")).alias("cases"), T.brace_delta(F.col("text")).alias("braces"), T.contains_switch(F.col("text")).alias("has_switch"))


_TURNS = "tu AS (SELECT conv_id, turn, role, text, sum(len(string_split(text, chr(10)))) OVER (PARTITION BY conv_id ORDER BY turn) AS e, len(string_split(text, chr(10))) AS n FROM conversations), tl AS (SELECT conv_id, turn, role, text, (e - n + 1)::BIGINT AS s, e::BIGINT AS e FROM tu)"


def _turns(spark, sf):
    n = F.size(F.split("text", "\n"))
    e = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, sf, "conversations").select("conv_id", "turn", "role", "text", (e - n + 1).alias("s"), e.alias("e"))


@query(f"WITH {_TURNS} SELECT a.conv_id, a.turn AS t1, b.turn AS t2, greatest(a.s, b.s) <= least(a.e + 1, b.e) AS overlaps FROM tl a JOIN tl b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 2")
def q09_overlap(spark, sf):
    t = _turns(spark, sf)
    a, b = t.alias("a"), t.alias("b")
    near = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") > F.col("a.turn")) & (F.col("b.turn") <= F.col("a.turn") + 2)
    return a.join(b, near).select("a.conv_id", F.col("a.turn").alias("t1"), F.col("b.turn").alias("t2"), fragments.overlap(F.col("a.s"), F.col("a.e") + 1, F.col("b.s"), F.col("b.e")).alias("overlaps"))


_BUILT_IN = ", ".join(f"'{w}'" for w in T.IGNORED_TYPES)


def _unwrap(c: str) -> str:
    for _ in range(3):
        c = f"trim(regexp_replace({c}, '^\\((.*)\\)$', '\\1'))"
    return c


@query(f"""WITH RECURSIVE b AS (SELECT id, type, {_unwrap('type')} AS t FROM ({X.TYPES})),
f AS (SELECT id, type, t, 0 AS i, 0 AS angle, 0 AS paren, '' AS now, []::VARCHAR[] AS parts FROM b
  UNION ALL SELECT id, type, t, i + 1, angle + CASE WHEN c = '<' THEN 1 WHEN c = '>' AND angle > 0 THEN -1 ELSE 0 END, paren + CASE WHEN c = '(' THEN 1 WHEN c = ')' AND paren > 0 THEN -1 ELSE 0 END,
    CASE WHEN c = '|' AND angle = 0 AND paren = 0 THEN '' ELSE now || c END, CASE WHEN c = '|' AND angle = 0 AND paren = 0 THEN list_append(parts, now) ELSE parts END
  FROM (SELECT *, substr(t, i + 1, 1) AS c FROM f WHERE i < length(t))),
p AS (SELECT id, type, list_filter(list_transform(list_append(parts, now), lambda x: trim(x)), lambda x: x <> '') AS parts FROM f WHERE i = length(t))
SELECT id, type = '' OR len(list_filter(parts, lambda x: NOT (starts_with({_unwrap('x')}, '%') OR {_unwrap('x')} = 'unknown' OR lower({_unwrap('x')}) IN ({_BUILT_IN})))) = 0 AS ignored, array_to_string(parts, ';') AS parts FROM p""")
def q10_ignored_types(spark, sf):
    return spark.sql(X.TYPES).select("id", T.is_ignored_type(F.col("type")).alias("ignored"), F.array_join(T.union_parts(F.col("type")), ";").alias("parts"))


@query("SELECT project, count(*)::BIGINT AS pages FROM (SELECT regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS project FROM pages) WHERE project IN ('en', 'fr', 'de', 'es') GROUP BY project")
def q11_attribution(spark, sf):
    known = F.broadcast(spark.createDataFrame([(p,) for p in ("en", "fr", "de", "es")], "project string"))
    path = F.regexp_replace("url", "^https?://[^/]+", "/root")
    return load(spark, sf, "pages").select(F.regexp_extract(project_of(path, "/root"), "^[^?#]*", 0).alias("project")).join(known, "project").groupBy("project").agg(F.count(F.lit(1)).alias("pages"))


def _hashed(spark, sf):
    """Methods with the digest of their content, normalised once."""
    m = document_methods(spark, sf).select("seq", "project", "lang", F.size("stmts").alias("n"), F.sha2("content", 256).alias("content"))
    return materialize(m, "hashed-methods")


@query(f"WITH {_EXACT} SELECT a, b, 'Code Clone Type-1: Method ''doc' || a || ''' (lines 1-' || len(p.stmts) || ') is identical to ''' || q.project || '.doc' || b || ''' in ' || q.project || ':1-' || len(q.stmts) || '. (' || len(p.stmts) || ' statements)' AS description FROM ex JOIN m p ON p.seq = a JOIN m q ON q.seq = b")
def q12_exact_pairs(spark, sf):
    m = _hashed(spark, sf)
    side = lambda i: m.select(F.col("seq").alias(i), F.col("project").alias(f"p_{i}"), F.col("n").alias(f"n_{i}"))
    name = lambda i: F.concat(F.lit("doc"), F.col(i).cast("string"))
    said = report.method_text("Type-1", name("a"), F.lit(1), F.col("n_a"), F.col("p_b"), name("b"), F.col("p_b"), F.lit(1), F.col("n_b"), F.col("n_a"))
    return clones.exact_pairs(m).join(side("a"), "a").join(side("b"), "b").select("a", "b", said.alias("description"))


@query(f"WITH {_NEAR} SELECT a, b, round(similarity, 6) AS similarity FROM near")
def q13_near_miss_pairs(spark, sf):
    return clones.near_miss_pairs(document_methods(spark, sf), STMT_SIMILARITY).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT f1, f2, count(*)::BIGINT AS pairs, min(s1)::BIGINT AS first_start FROM pr GROUP BY f1, f2")
def q14_window_pairs(spark, sf):
    return fragments.window_pair_counts(document_tokens(spark, sf), WINDOW)


@query(f"WITH {_WINS}, g AS (SELECT fp, count(*) AS c FROM win GROUP BY fp HAVING count(*) > 1) SELECT c::BIGINT AS copies, count(*)::BIGINT AS fingerprints FROM g GROUP BY c")
def q15_repeated_windows(spark, sf):
    return fragments.repeated_fingerprints(document_tokens(spark, sf), WINDOW).groupBy("copies").agg(F.count(F.lit(1)).alias("fingerprints"))


@query()
def q16_near_blocks(spark, sf):
    return fragments.near_blocks(document_tokens(spark, sf), WINDOW, SIMILARITY)


@query(f"WITH {_TURNS}, r AS (SELECT conv_id AS file, s AS start, e AS \"end\" FROM tl UNION SELECT conv_id, s, e + 1 FROM tl) SELECT r.file, r.start, r.\"end\", (SELECT role FROM tl WHERE conv_id = r.file AND r.start >= s AND r.\"end\" <= e ORDER BY turn LIMIT 1) AS class_name, (SELECT 'turn' || turn FROM tl WHERE conv_id = r.file AND r.start >= s AND r.\"end\" <= e ORDER BY turn LIMIT 1) AS method_name FROM r")
def q17_enclosing_method(spark, sf):
    t = _turns(spark, sf)
    m = t.select(F.col("conv_id").alias("file"), F.col("turn").alias("seq"), F.col("s").alias("start_line"), F.col("e").alias("end_line"), F.col("role").alias("class_name"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("method_name"))
    r = t.select(F.col("conv_id").alias("file"), F.col("s").alias("start"), F.col("e").alias("end"))
    return fragments.enclosing_method(r.unionByName(r.withColumn("end", F.col("end") + 1)).distinct(), m)


@query("SELECT l_orderkey, count(*)::BIGINT AS hits FROM lineitem WHERE l_quantity >= 25 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY l_orderkey")
def q18_anti_dedup(spark, sf):
    seen = load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return load(spark, sf, "lineitem").where("l_quantity >= 25").join(seen, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT user_id, count(*)::BIGINT AS reads, count(*) FILTER (WHERE nxt = 'purchase')::BIGINT AS paired FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type <> 'purchase' GROUP BY user_id")
def q19_lead_pairing(spark, sf):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = load(spark, sf, "events").select("user_id", "event_type", nxt.alias("nxt")).where("event_type <> 'purchase'")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("reads"), F.count(F.when(F.col("nxt") == "purchase", 1)).alias("paired"))


@query(f"SELECT file, w AS token, count(*)::BIGINT AS n FROM (SELECT doc_id AS file, unnest({_WORDS}) AS w FROM documents) GROUP BY file, w HAVING count(*) > 1")
def q20_multisets(spark, sf):
    from simloom.functions.similarity import multiset

    return multiset(document_tokens(spark, sf).select("file", F.explode("tokens").alias("token")), ["file"], "token").where("n > 1")


@query(f"""SELECT file, gram, count(*)::BIGINT AS n FROM (SELECT file, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS gram
FROM (SELECT doc_id AS file, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM documents) WINDOW o AS (PARTITION BY file ORDER BY i)) WHERE gram IS NOT NULL GROUP BY file, gram HAVING count(*) > 1""")
def q21_grams(spark, sf):
    g = document_tokens(spark, sf).select("file", F.explode(grams(F.col("tokens"), 3, " ")).alias("gram"))
    return g.groupBy("file", "gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {_ACCESS}, {_DOMINANT} SELECT method AS l_orderkey, dominant::VARCHAR AS dominant FROM top")
def q22_dominant_provider(spark, sf):
    return metrics.access_metrics(_accesses(spark, sf)).where("dominant <> ''").select(F.col("method").alias("l_orderkey"), "dominant")


_LINES_OF = "ln AS (SELECT id, i, x FROM (SELECT id, unnest(string_split_regex(text, '\\r?\\n')) AS x, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS i FROM {0}))"
_CASES_OF = """lb AS (SELECT *, CASE WHEN regexp_matches(x, '\\bcase\\s+[^:]+:') THEN trim(regexp_extract(x, '\\bcase\\s+([^:]+):', 1)) WHEN regexp_matches(x, '\\bdefault\\s*:') THEN 'default' END AS label,
  max(CASE WHEN NOT regexp_matches(x, '^[\\s}}]*$') THEN i END) OVER (PARTITION BY id) AS last FROM ln),
cs AS (SELECT id, i, label, greatest(coalesce(lead(i) OVER (PARTITION BY id ORDER BY i), last + 1) - i, 1) AS lines FROM lb WHERE label IS NOT NULL)"""


@query(f"WITH {_LINES_OF.format(f'({X.SOURCES})')}, {_CASES_OF.replace('}}', '}')} SELECT id AS block, i::INTEGER AS i, label, lines::BIGINT AS lines FROM cs")
def q23_case_lengths(spark, sf):
    return metrics.case_lengths(spark.sql(X.SOURCES).select(F.col("id").alias("block"), "text")).select("block", "i", "label", "lines")


_ISSUES = f"WITH {_EXACT}, {_LONG}, iss AS (SELECT p.project, 'clone' AS rule FROM ex JOIN m p ON p.seq = a UNION ALL SELECT source, CASE severity WHEN 1 THEN 'long-ui' ELSE 'long' END FROM lm WHERE over IS NOT NULL)"
_PROJECTS = [f"src{i}" for i in range(20)]


def _issue_counts(spark, sf):
    """``project, rule, n``: issues are counted, not listed, since exact pairs grow with the square of a group."""
    pairs = clones.exact_pair_counts(_hashed(spark, sf), "project").select("project", F.lit("clone").alias("rule"), F.col("pairs").alias("n"))
    long = _long(spark, sf).select(F.col("source").alias("project"), F.when(F.col("severity") == 1, "long-ui").otherwise("long").alias("rule"))
    return pairs.unionByName(long.groupBy("project", "rule").agg(F.count(F.lit(1)).alias("n")))


@query(f"{_ISSUES} SELECT iss.project, count(*) FILTER (WHERE rule = 'clone')::BIGINT AS clones, count(*) FILTER (WHERE rule <> 'clone')::BIGINT AS long_methods, round(any_value(l.loc) / count(*), 6) AS loc_per_issue FROM iss JOIN (SELECT source AS project, sum({_LINES})::BIGINT AS loc FROM documents GROUP BY source) l USING (project) GROUP BY iss.project")
def q24_smell_columns(spark, sf):
    wide = report.rule_columns(_issue_counts(spark, sf), {"clone": "clones", "long": "long_methods", "long-ui": "long_methods"}, F.sum("n"))
    lines = T.code_line_count(F.col("text"), F.lit(0), F.lit(True))
    loc = load(spark, sf, "documents").groupBy(F.col("source").alias("project")).agg(F.sum(lines).alias("loc"))
    return wide.join(loc, "project").select("project", "clones", "long_methods", F.round(F.col("loc") / (F.col("clones") + F.col("long_methods")), 6).alias("loc_per_issue"))


@query(f"{_ISSUES} SELECT rule, {', '.join(f'''count(*) FILTER (WHERE project = '{p}')::BIGINT AS {p}''' for p in _PROJECTS)}, count(*)::BIGINT AS total FROM iss WHERE project IN ({', '.join(f'''{chr(39)}{p}{chr(39)}''' for p in _PROJECTS)}) GROUP BY rule")
def q25_rule_matrix(spark, sf):
    return report.rule_matrix(_issue_counts(spark, sf), _PROJECTS, F.sum("n"))


@query("SELECT a.conv_id, a.turn AS t1, b.turn AS t2, CASE WHEN a.role = b.role AND a.turn % 2 = b.turn % 2 AND left(a.text, 1) = left(b.text, 1) THEN 'same method' WHEN a.role = b.role THEN 'same class' ELSE 'different classes' END AS scope FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def q26_scopes(spark, sf):
    c = load(spark, sf, "conversations").withColumn("method", F.concat((F.col("turn") % 2).cast("string"), F.left("text", F.lit(1))))
    a, b = c.alias("a"), c.alias("b")
    s = metrics.scope(F.col("a.role"), F.col("a.method"), F.col("b.role"), F.col("b.method"), F.lit(True))
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn"))).select("a.conv_id", F.col("a.turn").alias("t1"), F.col("b.turn").alias("t2"), metrics.scope_text(s).alias("scope"))


@query(f"WITH {_WINS} SELECT file, count(*)::BIGINT AS windows, max(start)::BIGINT AS last_start FROM win GROUP BY file")
def q27_windows(spark, sf):
    return fragments.windows(document_tokens(spark, sf), WINDOW).groupBy("file").agg(F.count(F.lit(1)).alias("windows"), F.max("start").alias("last_start"))


@query(f"SELECT file, i::BIGINT AS start, md5(array_to_string(w[i+1:i+{WINDOW}], '|')) AS digest FROM (SELECT doc_id AS file, {_WORDS} AS w, unnest(range(0, len({_WORDS}) - {WINDOW} + 1, {WINDOW // 2})) AS i FROM documents)")
def q28_blocks(spark, sf):
    return fragments.windows(document_tokens(spark, sf), WINDOW, WINDOW // 2).select("file", "start", F.md5(fragments.fingerprint(F.col("w"))).alias("digest"))


@query("SELECT p_partkey, (list_reduce(ids, lambda h, x: (h * 131 + x) % 1000000007, 0::BIGINT) || '_' || list_reduce(ids, lambda h, x: (h * 137 + x) % 1000000009, 0::BIGINT)) AS hash FROM (SELECT p_partkey, list_transform(regexp_extract_all(p_name, '[^ ]'), lambda c: ascii(c)::BIGINT) AS ids FROM part)")
def q29_rolling_hash(spark, sf):
    ids = F.transform(F.regexp_extract_all("p_name", F.lit("[^ ]"), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    h = lambda base, mod: fragments.rolling_hash(ids, base, mod).cast("string")
    return load(spark, sf, "part").select("p_partkey", F.concat_ws("_", h(131, 1_000_000_007), h(137, 1_000_000_009)).alias("hash"))


@query(f"WITH {_RUNS} SELECT f1, s1::BIGINT AS s1, e1::BIGINT AS e1, f2, s2::BIGINT AS s2, e2::BIGINT AS e2, token_count::BIGINT AS token_count FROM runs")
def q30_merged_runs(spark, sf):
    return runs.window_runs(document_tokens(spark, sf), WINDOW)


@query()
def q31_greedy_dedup(spark, sf):
    return runs.window_runs(document_tokens(spark, sf), WINDOW, dedup=True)


@query(rf"SELECT DISTINCT method, unnest(range(line, until + 1))::INTEGER AS line FROM (SELECT *, greatest(coalesce(lead(line) OVER (PARTITION BY method ORDER BY idx) - 1, end_line), line) AS until FROM ({X.LOGGED})) WHERE regexp_matches(text, '(?is)^\s*(console|hilog|logger)\.\w+\s*\(.*\)\s*$')")
def q32_log_lines(spark, sf):
    return metrics.log_lines(spark.sql(X.LOGGED))


_BLOCKS = """RECURSIVE src AS (SELECT id, text FROM ({0})),
ln AS (SELECT id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM src),
dl AS (SELECT id, i, x, len(regexp_extract_all(x, '\\{{')) - len(regexp_extract_all(x, '\\}}')) AS delta, regexp_matches(x, '\\bswitch\\s*\\(') AS sw FROM ln),
st AS (SELECT id, -1 AS i, -1 AS first, 0 AS depth, -1 AS shut FROM src
  UNION ALL SELECT st.id, dl.i, CASE WHEN st.first < 0 THEN CASE WHEN sw AND delta >= 0 THEN dl.i ELSE -1 END WHEN st.depth + delta <= 0 THEN -1 ELSE st.first END,
    CASE WHEN st.first < 0 THEN CASE WHEN sw AND delta >= 0 THEN delta ELSE 0 END WHEN st.depth + delta <= 0 THEN 0 ELSE st.depth + delta END, CASE WHEN st.first >= 0 AND st.depth + delta <= 0 THEN st.first ELSE -1 END
  FROM st JOIN dl ON dl.id = st.id AND dl.i = st.i + 1),
sp AS (SELECT id, shut AS first, i AS last FROM st WHERE shut >= 0 UNION ALL SELECT id, first, i FROM st WHERE first >= 0 AND i = (SELECT max(i) FROM ln WHERE ln.id = st.id)),
bk AS (SELECT sp.id, sp.first, greatest(strpos(any_value(ln.x) FILTER (WHERE ln.i = sp.first), 'switch') - 1, 0) AS col, string_agg(ln.x, chr(10) ORDER BY ln.i) AS text FROM sp JOIN ln ON ln.id = sp.id AND ln.i BETWEEN sp.first AND sp.last GROUP BY sp.id, sp.first)"""


@query(f"WITH {_BLOCKS.format(X.SOURCES)} SELECT id, first::INTEGER AS first_line, col::INTEGER AS switch_column, {_CASES.format('text')}::BIGINT AS cases, length(text)::INTEGER AS chars FROM bk")
def q33_switch_blocks(spark, sf):
    b = spark.sql(X.SOURCES).select("id", F.explode(metrics.switch_blocks(F.split("text", "\n"))).alias("b"))
    return b.select("id", F.col("b.first").alias("first_line"), F.col("b.column").alias("switch_column"), T.case_count(F.col("b.text")).alias("cases"), F.length("b.text").alias("chars"))


_TAGS = "tg AS (SELECT page_id AS file, unnest(regexp_extract_all(html, '[{}]')) AS value, generate_subscripts(regexp_extract_all(html, '[{}]'), 1) AS pos FROM pages)"


@query(f"WITH {_TAGS}, s AS (SELECT file, pos, value, sum(CASE value WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY file ORDER BY pos) AS s FROM tg) SELECT file, pos::BIGINT AS pos, value, (s - least(0, min(s) OVER (PARTITION BY file ORDER BY pos)))::BIGINT AS depth FROM s")
def q34_depth(spark, sf):
    t = load(spark, sf, "pages").select(F.col("page_id").alias("file"), F.posexplode(F.regexp_extract_all("html", F.lit("[{}]"), F.lit(0))).alias("p", "value"))
    return metrics.clamped_depth(t.select("file", (F.col("p") + 1).cast("long").alias("pos"), "value"))


_CHAINS = """t AS (SELECT file, pos, value FROM ({0})),
s AS (SELECT *, sum(CASE value WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER o AS s, lead(value) OVER (PARTITION BY file ORDER BY pos) AS nx, lag(value) OVER (PARTITION BY file ORDER BY pos) AS pv FROM t WINDOW o AS (PARTITION BY file ORDER BY pos)),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY file ORDER BY pos)) AS depth FROM s),
c AS (SELECT file, pos, depth, CASE WHEN value = 'else' AND nx = 'if' THEN 'elseIf' WHEN value = 'else' THEN 'else' ELSE 'if' END AS kind FROM d WHERE value = 'else' OR (value = 'if' AND coalesce(pv, '') <> 'else')),
h AS (SELECT c.*, (SELECT max((o.pos, o.kind, o.depth)) FROM c o WHERE o.file = c.file AND o.pos < c.pos AND o.depth < c.depth) AS near, (SELECT min(o.pos) FROM c o WHERE o.file = c.file AND o.pos > c.pos AND (o.depth < c.depth OR (o.depth = c.depth AND o.kind IN ('else', 'if')))) AS stop FROM c WHERE kind = 'if'),
ch AS (SELECT file, pos, 1 + (SELECT count(*) FROM c o WHERE o.file = h.file AND o.kind = 'elseIf' AND o.depth = h.depth AND o.pos > h.pos AND (h.stop IS NULL OR o.pos < h.stop)) AS branches FROM h WHERE NOT coalesce(near[2] = 'else' AND near[3] = depth - 1, false))"""


@query(f"WITH {_CHAINS.format(X.BRACES)} SELECT file, pos::BIGINT AS pos, branches::BIGINT AS branches FROM ch")
def q35_if_chains(spark, sf):
    return metrics.if_chains(metrics.conditional_tokens(spark.sql(X.BRACES)))


@query("SELECT doc_id, len(string_split(h, chr(10)))::BIGINT AS line, length(string_split(h, chr(10))[-1])::BIGINT AS col FROM (SELECT doc_id, substr(text, 1, (length(text) // 2)::BIGINT) AS h FROM documents)")
def q36_offset_line(spark, sf):
    line, col = T.offset_line(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    return load(spark, sf, "documents").select("doc_id", line.alias("line"), col.alias("col"))


@query(f"WITH {_EXACT} SELECT key, min(a)::BIGINT AS a, min(b)::BIGINT AS b FROM (SELECT p.project || ':' || p.lang AS x, q.project || ':' || q.lang AS y, a, b, CASE WHEN p.project || ':' || p.lang <= q.project || ':' || q.lang THEN p.project || ':' || p.lang || '|' || q.project || ':' || q.lang ELSE q.project || ':' || q.lang || '|' || p.project || ':' || p.lang END AS key, row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY a, b) AS n FROM ex JOIN m p ON p.seq = a JOIN m q ON q.seq = b) WHERE n = 1 GROUP BY key")
def q37_pair_keys(spark, sf):
    m = _hashed(spark, sf).withColumn("key", F.concat_ws(":", "project", "lang"))
    return clones.first_pairs(m, by_content=False).select("key", "a", "b")


@query(f"WITH RECURSIVE {_NEAR}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT a.seq, b.seq FROM m a JOIN m b ON a.content = b.content AND a.seq <> b.seq), c AS (SELECT a AS v, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v WHERE c.r < e.b) SELECT v AS vertex, min(r) AS component FROM c GROUP BY v")
def q38_components(spark, sf):
    m = document_methods(spark, sf)
    return connected_components(clones.exact_links(m.select("seq", "content")).union(clones.near_miss_pairs(m, STMT_SIMILARITY).select("a", "b")))


@query(f"SELECT min(doc_id) AS class_key, count(*)::BIGINT AS size, array_to_string(list(doc_id ORDER BY doc_id), ',') AS members FROM (SELECT {_basic('text')} AS content, doc_id FROM documents) GROUP BY content HAVING count(*) > 1")
def q39_method_classes(spark, sf):
    m = load(spark, sf, "documents").select(F.col("doc_id").alias("seq"), T.normalize_basic(F.col("text")).alias("content"))
    return clones.clone_classes(clones.exact_links(m)).select("class_key", "size", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


_DJB = "list_reduce(list_transform(regexp_extract_all({0}, '(?s).'), lambda c: unicode(c)::BIGINT), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT)"


@query(f"SELECT p_partkey, CASE WHEN h < 0 THEN '-' ELSE '' END || lower(to_hex(abs(h))) AS hash FROM (SELECT p_partkey, {_DJB.format('p_name')} AS h FROM part)")
def q40_djb2(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.djb2(F.col("p_name")).alias("hash"))


@query(f"SELECT doc_id, md5({_basic('text')}) AS digest FROM documents")
def q41_normalize(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.normalize_basic(F.col("text"))).alias("digest"))


_KEPT = ", ".join(f"'{w}'" for w in T.KEPT)
_NAMED = f"regexp_matches(w, '^[A-Za-z_]') AND NOT (lower(w) IN ({_KEPT}) OR length(w) <= 1 OR upper(w) = w)"


@query(f"""SELECT id, array_to_string(list_transform(ws, lambda w: CASE WHEN {_NAMED} THEN 'ID_' || (len(list_distinct(names[1:list_position(names, w) - 1])) + 1) ELSE w END), '') AS renamed
FROM (SELECT id, ws, list_filter(ws, lambda w: {_NAMED}) AS names FROM (SELECT id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS ws FROM ({X.STATEMENTS})))""")
def q42_rename(spark, sf):
    return spark.sql(X.STATEMENTS).select("id", T.rename_identifiers(F.col("text")).alias("renamed"))


@query(rf"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?\b', 'NUM', 'g'), '\b0x[0-9a-fA-F]+\b', 'NUM', 'g'), '"[^"]*"', 'STR', 'g'), chr(39) || '[^' || chr(39) || ']*' || chr(39), 'STR', 'g') AS text FROM {_TEXTS}""")
def q43_literals(spark, sf):
    return _texts(spark, sf).select("id", T.normalize_literals(F.col("text")).alias("text"))


@query(rf"SELECT id, regexp_replace(regexp_replace(text, ':\s*[A-Za-z_]\w*(\s*<[^>]*>)?(\s*\[\])*', '', 'g'), '\bas\b\s+[A-Za-z_]\w*', '', 'g') AS without_types, regexp_replace(text, '@[A-Za-z_]\w*(\s*\([^)]*\))?', '', 'g') AS without_decorators FROM {_TEXTS}")
def q44_strip(spark, sf):
    return _texts(spark, sf).select("id", T.strip_types(F.col("text")).alias("without_types"), T.strip_decorators(F.col("text")).alias("without_decorators"))


@query(f"""SELECT min(p_partkey) AS a, count(*)::BIGINT AS size, content FROM (SELECT p_partkey, CASE WHEN k1 THEN w1 ELSE 'ID_1' END || ' ' || CASE WHEN k2 THEN w2 WHEN k1 OR w1 = w2 THEN 'ID_1' ELSE 'ID_2' END || '|' || p_type AS content
FROM (SELECT p_partkey, p_type, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, w1 IN ({_KEPT}) AS k1, w2 IN ({_KEPT}) AS k2 FROM part)) GROUP BY content""")
def q45_type2_groups(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", T.type2_text(F.array("p_name", "p_type")).alias("content"))
    return p.groupBy("content").agg(F.min("p_partkey").alias("a"), F.count(F.lit(1)).alias("size")).select("a", "size", "content")


_STEP = "lambda acc, e: list_transform(range(1, len(e) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k], CASE WHEN k > 1 THEN acc[k - 1] ELSE 0 END + e[k]))))"


@query(f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), p AS (SELECT x.item_id, x.w AS a, y.w AS b FROM b x JOIN b y ON y.item_id = x.item_id + 1),
l AS (SELECT item_id, len(a) AS n, len(b) AS m, list_reduce(list_prepend(list_transform(b, lambda y: 0), list_transform(a, lambda x: list_transform(b, lambda y: (y = x)::INTEGER))), {_STEP}) AS row FROM p WHERE len(a) > 0 AND len(b) > 0)
SELECT p.item_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2 * row[-1] / (n + m) END, 6) AS similarity FROM p LEFT JOIN l USING (item_id)""")
def q46_lcs(spark, sf):
    b = load(spark, sf, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    pairs = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return pairs.select("a.item_id", F.round(lcs_similarity_udf("a.w", "b.w"), 6).alias("similarity"))


@query()
def q47_tokenize(spark, sf):
    both = spark.sql(X.SOURCES).select(F.col("id").cast("long").alias("file"), F.col("text").alias("content"))
    both = both.unionByName(load(spark, sf, "pages").select((F.col("page_id") + 1000).alias("file"), F.col("html").alias("content")))
    return lexer.token_rows(both)


@query(f"SELECT file, len(list_distinct(ws))::BIGINT AS identifiers, coalesce('ID_' || (list_position(firsts, ws[-1]) - 1), '') AS last_id FROM (SELECT file, ws, list_transform(list_sort(list_transform(list_distinct(ws), lambda x: lpad(list_position(ws, x)::VARCHAR, 9, '0') || x)), lambda y: substr(y, 10)) AS firsts FROM (SELECT doc_id AS file, list_filter({_WORDS}, lambda w: length(w) > 1) AS ws FROM documents))")
def q48_token_ids(spark, sf):
    ids = document_tokens(spark, sf).select("file", F.filter("tokens", lambda w: F.length(w) > 1).alias("ws")).withColumn("firsts", F.array_distinct("ws"))
    last = F.concat(F.lit("ID_"), (F.array_position("firsts", F.try_element_at("ws", F.lit(-1))) - 1).cast("string"))
    return ids.select("file", F.size("firsts").cast("long").alias("identifiers"), F.coalesce(last, F.lit("")).alias("last_id"))


@query()
def q49_token_filters(spark, sf):
    t = lexer.with_tokens(spark.sql(X.STATEMENTS).withColumnRenamed("text", "content"), drop_types=True, drop_decorators=True, rename=True, literals=True)
    return t.select("id", F.array_join(F.transform("tokens", lambda x: x["value"]), " ").alias("tokens"))


@query(f"WITH {_LONG} SELECT DISTINCT 1 AS line, 'doc' || doc_id || ' has ' || lines || ' code lines (limit ' || over || ')' AS description, severity, 'long-method' AS rule_id, source AS file_path, true AS disabled, false AS checked, source || '1%0%' || length('doc' || doc_id) || '%long-method%doc' || doc_id || ' has ' || lines || ' code lines (limit ' || over || ')' AS merge_key FROM lm WHERE over IS NOT NULL")
def q50_issue_rows(spark, sf):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    said = F.format_string("%s has %d code lines (limit %d)", name, "lines", "over")
    rows = report.issues(_long(spark, sf), line=F.lit(1), start_col=F.lit(0), end_col=F.length(name), description=said, severity=F.col("severity"), rule_id=F.lit("long-method"), file_path=F.col("source"), method_name=name)
    return report.distinct_issues(rows).select("line", "description", "severity", "rule_id", "file_path", "disabled", "checked", report.merge_key().alias("merge_key"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
