"""The rules end to end: program tables and options in, issue rows out.

A rule is a function ``(tables, options, rule) -> issues`` in ``RULES``; ``run``
fills its options from user settings and enriches severity. All rules read the
same tables, so one job scans all projects at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import lexer
from simloom.functions import text as T
from simloom.operators import clones, envy, fragments, metrics, report
from simloom.operators.components import connected_components
from simloom.operators.order import numbered
from simloom.plans import options as O
from simloom.scratch import materialize
from simloom.sources.program import Tables, build_methods


@dataclass(frozen=True)
class Rule:
    """Identity of a rule; ``alert`` is the severity a user sets, ``severity`` the rule's own."""

    rule_id: str
    doc: str
    make: Callable[[Tables, Any, Rule], DataFrame]
    options: Any
    level: str
    severity: int = 2
    alert: int | None = None

    @property
    def final_severity(self) -> int:
        return self.severity if self.alert is None else self.alert


def _issues(df: DataFrame, rule: Rule, line: Column, start: Column, end: Column, text: Column, file: Column, method: Column | None = None, severity: Column | None = None) -> DataFrame:
    own = F.lit(rule.final_severity)
    columns = {"line": line, "start_col": start, "end_col": end, "description": text, "file_path": file, "rule_id": F.lit(rule.rule_id), "rule_doc_path": F.lit(rule.doc)}
    columns["severity"] = own if severity is None else F.coalesce(severity, own)
    return report.issues(df, **columns, **({} if method is None else {"method_name": method}))


# Methods


def method_contents(t: Tables, o: O.MethodCloneOptions, kind: str) -> DataFrame:
    """Admitted methods with their normalised ``content``: enough statements left, enough distinct parts, the first of each identity."""
    stmts = t.stmts.where(~T.is_log(F.col("text"))) if o.ignore_logs else t.stmts
    texts = stmts.groupBy(F.col("method").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("s"))
    m = metrics.admitted_methods(t.methods.where("has_body")).join(texts, "seq").withColumn("stmts", F.col("s.text"))
    m = m.withColumn("n", F.size("stmts")).where(F.col("n") >= max(1, o.min_stmts))
    content = T.type1_text(F.col("stmts"), o.ignore_types, o.ignore_decorators) if kind == "Type-1" else T.type2_text(F.col("stmts"), o.ignore_types, o.ignore_decorators, o.ignore_literals)
    m = m.select("seq", "file", "class_name", "method_name", "start_line", "end_line", "n", content.alias("content"))
    if o.min_complexity > 0:
        m = m.where(T.distinct_parts(F.col("content")) >= o.min_complexity)
    m = clones.first_wins(m, ["file", "class_name", "method_name", "start_line"], ["seq"])
    return materialize(m.withColumn("key", F.concat_ws(":", "file", "method_name")), "method-contents")


def clone_pairs(m: DataFrame, similarity: float) -> DataFrame:
    """``key, a, b, similarity``: the first pair of each key, exact pairs (similarity null) before near ones."""
    found = clones.first_pairs(m).select("key", F.lit(0).alias("stage"), F.struct(F.lit(0).alias("n"), F.col("bucket").alias("x"), F.lit(0).alias("m"), F.col("a").alias("y")).alias("at"), "a", "b", F.lit(None).cast("double").alias("similarity"))
    if similarity < 1:
        parts = m.select("seq", F.filter(F.split("content", r"\|"), lambda x: x != "").alias("stmts"))
        near = clones.near_miss_pairs(parts, similarity)
        side = lambda i: m.select(F.col("seq").alias(i), F.col("n").alias(f"n_{i}"), F.col("key").alias(f"k_{i}"))
        near = near.join(side("a"), "a").join(side("b"), "b")
        swap = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
        x, y = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
        at = F.struct(F.least("n_a", "n_b").alias("n"), x.alias("x"), F.greatest("n_a", "n_b").alias("m"), y.alias("y"))
        found = found.unionByName(near.select(clones.pair_key(F.col("k_a"), F.col("k_b")).alias("key"), F.lit(1).alias("stage"), at.alias("at"), x.alias("a"), y.alias("b"), "similarity"))
    first = found.groupBy("key").agg(F.min(F.struct("stage", "at", "a", "b", "similarity")).alias("p"))
    return first.select("key", "p.a", "p.b", "p.similarity")


def method_class_issues(pairs: DataFrame, m: DataFrame, rule: Rule, kind: str) -> DataFrame:
    """One issue a class, at its first member (by file and line), naming all members."""
    who = F.concat_ws(":", "file", F.concat_ws(".", "class_name", "method_name"), "start_line")
    members = clones.clone_members(pairs).join(m.select(F.col("seq").alias("member"), "file", "class_name", "method_name", "start_line", "end_line", who.alias("who")), "member")
    said = report.member_text(F.col("class_name"), F.col("method_name"), F.col("file"), F.col("start_line"), F.col("end_line"))
    classes = members.groupBy("class_key").agg(F.min("who").alias("who"), F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("file", "start_line", "method_name", said.alias("t")))).alias("m"))
    classes = numbered(classes, "class_id", "who")
    text = report.class_text(kind, F.col("class_id"), F.col("size"), F.array_join(F.col("m.t"), "; "))
    head = lambda c: F.get("m", F.lit(0))[c]
    return _issues(classes, rule, head("start_line"), F.lit(0), F.length(head("method_name")), text, head("file"), head("method_name"))


def _clone_rule(kind: str) -> Callable[[Tables, O.MethodCloneOptions, Rule], DataFrame]:
    def make(t: Tables, o: O.MethodCloneOptions, rule: Rule) -> DataFrame:
        m = method_contents(t, o, kind)
        pairs = clone_pairs(m, o.similarity)
        if o.classes:
            return method_class_issues(pairs, m, rule, kind)
        side = lambda i: m.select(*[F.col(c).alias(f"{c}_{i}") for c in ("seq", "file", "class_name", "method_name", "start_line", "end_line", "n")])
        p = pairs.join(side("a"), F.col("a") == F.col("seq_a")).join(side("b"), F.col("b") == F.col("seq_b"))
        said = report.method_text(kind, *map(F.col, ("method_name_a", "start_line_a", "end_line_a", "class_name_b", "method_name_b", "file_b", "start_line_b", "end_line_b", "n_a")), similarity=F.coalesce("similarity", F.lit(1.0)))
        return _issues(p, rule, F.col("start_line_a"), F.lit(0), F.length("method_name_a"), said, F.col("file_a"), F.col("method_name_a"))

    return make


# Fragments


def fragment_tokens(t: Tables, o: O.FragmentOptions) -> DataFrame:
    """``file, tokens, lines`` of admitted files: log lines blanked, lexed, long and varied enough."""
    files = t.files.where("content is not null")
    if o.ignore_logs:
        logs = metrics.log_lines(t.stmts.where("line > 0").select("method", "idx", "line", "end_line", "text"))
        per = logs.join(t.methods.select(F.col("seq").alias("method"), "file"), "method").groupBy("file").agg(F.collect_set("line").alias("gone"))
        files = files.join(per, "file", "left").withColumn("content", F.when(F.col("gone").isNull(), F.col("content")).otherwise(metrics.blank_lines(F.col("content"), F.col("gone")))).drop("gone")
    lexed = lexer.with_tokens(files, rename=o.normalize_identifiers, literals=o.normalize_literals, drop_types=o.ignore_types, drop_decorators=o.ignore_decorators)
    lexed = lexed.where(F.size("tokens") >= o.minimum_tokens)
    if o.min_token_types > 0:
        lexed = lexed.where(F.size(F.array_distinct("tokens.type")) >= o.min_token_types)
    return materialize(lexed.select("file", F.col("tokens.value").alias("tokens"), F.col("tokens.line").alias("lines")), "fragment-tokens")


def _placed(runs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Runs of token places ``s, e`` with lines in their stead; the places stay as ``i, j``."""
    for k in (1, 2):
        lines = tokens.select(F.col("file").alias(f"f{k}"), F.col("lines").alias("l"))
        at = lambda c: F.get("l", F.col(c).cast("int")).cast("long")
        runs = runs.join(lines, f"f{k}").withColumns({f"i{k}": F.col(f"s{k}"), f"j{k}": F.col(f"e{k}"), f"s{k}": at(f"s{k}"), f"e{k}": at(f"e{k}")}).drop("l")
    return runs


def exact_fragments(tokens: DataFrame, size: int) -> DataFrame:
    runs = fragments.merge_runs(fragments.window_pairs(tokens, size), size)
    return materialize(fragments.greedy_dedup(fragments.drop_self_overlaps(_placed(runs, tokens))), "fragments")


def near_fragments(tokens: DataFrame, size: int, threshold: float) -> DataFrame:
    """Block pairs that are similar but not equal, as runs with ``similarity``."""
    near = fragments.near_blocks(tokens, size, threshold).withColumns({"e1": F.col("s1") + size - 1, "e2": F.col("s2") + size - 1, "token_count": F.lit(size).cast("long")})
    return materialize(fragments.greedy_dedup(fragments.drop_self_overlaps(_placed(near, tokens))), "near-fragments")


def _located(rows: DataFrame, methods: DataFrame, k: str = "") -> DataFrame:
    """``rows`` with class and method of the place ``f, s, e`` (suffix ``k``)."""
    place = fragments.enclosing_method(rows.select(F.col(f"f{k}").alias("file"), F.col(f"s{k}").alias("start"), F.col(f"e{k}").alias("end")).distinct(), methods)
    named = place.select(F.col("file").alias(f"f{k}"), F.col("start").alias(f"s{k}"), F.col("end").alias(f"e{k}"), F.col("class_name").alias(f"c{k}"), F.col("method_name").alias(f"m{k}"))
    return rows.join(named, [f"f{k}", f"s{k}", f"e{k}"])


def fragment_classes(exact: DataFrame) -> DataFrame:
    """``class_key, f, s, e, i, j`` of the members of each class of fragments; a fragment is its file, lines and places."""
    node = lambda k: F.concat(F.col(f"f{k}"), F.format_string(":%d-%d:%d-%d", *[F.col(f"{c}{k}") for c in "seij"]))
    one = lambda k: exact.select(node(k).alias("node"), *[F.col(f"{c}{k}").alias(c) for c in "fseij"])
    nodes = numbered(one(1).unionByName(one(2)).distinct(), "id", "node")
    edges = exact.select(node(1).alias("x"), node(2).alias("y")).join(nodes.select(F.col("node").alias("x"), F.col("id").alias("a")), "x").join(nodes.select(F.col("node").alias("y"), F.col("id").alias("b")), "y").select("a", "b")
    labels = connected_components(edges)
    return nodes.join(labels, F.col("id") == F.col("vertex")).select(F.col("component").alias("class_key"), "f", "s", "e", "i", "j")


def fragment_rule(t: Tables, o: O.FragmentOptions, rule: Rule) -> DataFrame:
    tokens = fragment_tokens(t, o)
    methods = metrics.admitted_methods(t.methods)
    exact = exact_fragments(tokens, o.minimum_tokens)
    kind = report.clone_kind(o.normalize_identifiers, o.normalize_literals)
    if o.classes:
        members = _located(fragment_classes(exact), methods)
        known = lambda *cs: (F.count_distinct(*cs) == 1) & (F.count(cs[-1]) == F.count(F.lit(1)))
        scope = F.when(known("f", "c", "m"), "SAME_METHOD").when(known("f", "c"), "SAME_CLASS").otherwise("DIFFERENT_CLASS")
        said = report.location_text(F.col("f"), F.col("c"), F.col("m"), F.col("s"), F.col("e"))
        classes = members.groupBy("class_key").agg(scope.alias("scope"), F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("f", "s", "i", F.col("m").alias("name"), said.alias("t")))).alias("m"))
        classes = numbered(classes, "class_id", "class_key")
        head = lambda c: F.get("m", F.lit(0))[c]
        text = report.class_text(kind, F.col("class_id"), F.col("size"), F.array_join(F.col("m.t"), "; "), metrics.scope_text(F.col("scope")))
        return _issues(classes, rule, head("s"), F.lit(0), F.lit(0), text, head("f"), F.coalesce(head("name"), F.lit("")))
    rows = exact.withColumns({"similarity": F.lit(1.0), "kind": F.lit(kind)})
    if o.similarity < 1:
        rows = rows.unionByName(near_fragments(tokens, o.minimum_tokens, o.similarity).withColumn("kind", F.lit("Type-3")))
    rows = _located(_located(rows, methods, "1"), methods, "2")
    scope = metrics.scope_text(metrics.scope(F.col("c1"), F.col("m1"), F.col("c2"), F.col("m2"), F.col("f1") == F.col("f2")))
    place = lambda k, full: report.location_text(*[F.col(f"{c}{k}") for c in "fcmse"], full=full)
    lines = F.greatest(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2")) + 1
    text = report.fragment_text(F.col("kind"), scope, place(1, False), place(2, True), F.col("token_count"), lines, F.col("similarity"))
    return _issues(rows, rule, F.col("s1"), F.lit(0), F.lit(0), text, F.col("f1"), F.coalesce("m1", F.lit("")))


# Branches


def case_summary(blocks: DataFrame) -> DataFrame:
    """``block, summary``: the cases of each block with their lines."""
    each = metrics.case_lengths(blocks).select("block", F.struct("i", F.format_string("%s (%d line%s)", "label", "lines", F.when(F.col("lines") == 1, "").otherwise("s")).alias("t")).alias("c"))
    return each.groupBy("block").agg(F.array_join(F.array_sort(F.collect_list("c"))["t"], "; ").alias("summary"))


def switches_in_statements(t: Tables, min_cases: int) -> DataFrame:
    """``method, line, col, width, cases, text`` of switches found in the statement stream."""
    per = t.stmts.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("idx", "line", "col", "text"))).alias("s"))
    each = per.select("method", F.col("s.text").alias("texts"), F.posexplode("s").alias("at", "x")).where(T.contains_switch(F.col("x.text")))
    found = each.select("method", F.col("x.line").alias("line"), F.col("x.col").alias("col"), F.length("x.text").alias("width"), metrics.delimited_block(F.col("texts"), F.col("at")).alias("text"))
    return found.withColumn("cases", T.case_count(F.col("text"))).where(F.col("cases") >= min_cases)


def switches_in_source(methods: DataFrame, min_cases: int) -> DataFrame:
    """The same from the methods' texts; lines count from the method's first."""
    blocks = methods.where("code <> ''").select(F.col("seq").alias("method"), F.explode(metrics.switch_blocks(F.split("code", "\r?\n"))).alias("b"))
    found = blocks.select("method", (F.col("b.first") + 1).alias("line"), F.col("b.column").alias("col"), F.lit(1).alias("width"), F.col("b.text").alias("text"))
    return found.withColumn("cases", T.case_count(F.col("text"))).where(F.col("cases") >= min_cases)


def unreported(found: DataFrame, reported: DataFrame, keys: tuple[str, ...] = ("method", "line", "cases")) -> DataFrame:
    """Rows of ``found`` whose key was not reported before, each key once."""
    left = found.join(reported.select(*keys).distinct(), list(keys), "left_anti")
    return left.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("col"))).where("__n = 1").drop("__n")


def chains_in_source(methods: DataFrame, min_branches: int) -> DataFrame:
    """``method, line, col, branches`` of long if-else chains in the methods' texts."""
    lexed = lexer.with_tokens(methods.where("code <> ''").select(F.col("seq").alias("file"), F.col("code").alias("content"))).select("file", F.posexplode("tokens").alias("pos", "t"))
    lexed = materialize(lexed.select("file", "pos", "t.value", "t.line", "t.column"), "code-tokens")
    chains = metrics.if_chains(metrics.conditional_tokens(lexed.select("file", "pos", "value")), min_branches)
    return chains.join(lexed, ["file", "pos"]).select(F.col("file").alias("method"), "line", F.col("column").alias("col"), "branches")


def switch_rule(t: Tables, o: O.SwitchOptions, rule: Rule) -> DataFrame:
    methods = t.methods.where("has_body")
    bodies = Tables(t.files, methods, t.stmts.join(methods.select(F.col("seq").alias("method")), "method", "left_semi"), t.fields)
    from_stmts = materialize(switches_in_statements(bodies, o.min_cases), "switches")
    found = from_stmts.unionByName(unreported(switches_in_source(methods, o.min_cases), from_stmts))
    found = materialize(found.withColumn("block", F.xxhash64("method", "line", "col", "cases", "text")), "all-switches")
    names = methods.select(F.col("seq").alias("method"), "file", "method_name")
    rows = found.join(case_summary(found.select("block", "text").distinct()), "block", "left").join(names, "method")
    text = report.switch_text(F.col("cases"), F.col("method_name"), F.coalesce("summary", F.lit("unavailable")))
    switches = _issues(rows, rule, F.col("line"), F.col("col"), F.col("col") + F.col("width"), text, F.col("file"), F.col("method_name"))
    chains = chains_in_source(methods, o.min_cases).join(names, "method")
    said = report.chain_text(F.col("branches"), F.col("method_name"))
    return switches.unionByName(_issues(chains, rule, F.col("line"), F.col("col"), F.col("col") + 2, said, F.col("file"), F.col("method_name")))


# Method thresholds


def long_method_rule(t: Tables, o: O.LongMethodOptions, rule: Rule) -> DataFrame:
    counts = t.stmts.groupBy(F.col("method").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    ui = metrics.is_ui_method(F.col("class_kind"), F.col("method_name"), F.col("decorators"), F.col("has_view_tree"), F.col("class_decorators"))
    m = t.methods.join(counts, "seq", "left")
    m = m.withColumns({"lines": T.code_line_count(F.col("code"), F.coalesce("n", F.lit(0)), F.col("has_body") | (F.col("code") != "")), "is_ui": ui})
    over = metrics.long_methods(m, o.limit, o.ui_soft, o.ui_hard, rule.final_severity)
    text = report.long_method_text(F.col("method_name"), F.col("lines"), F.col("over"))
    return _issues(over, rule, F.col("start_line"), F.col("start_col"), F.col("start_col") + F.length("method_name"), text, F.col("file"), F.col("method_name"), F.col("severity"))


def envy_rule(t: Tables, o: O.EnvyOptions, rule: Rule, even: bool = False) -> DataFrame:
    """Needs ``uses``; a method whose front end resolves nothing uses no other class. ``even``: see ``report.to_fixed``."""
    ui = metrics.is_ui_method(F.col("class_kind"), F.col("method_name"), F.col("decorators"), F.col("has_view_tree"), F.col("class_decorators"))
    name = F.col("method_name")
    m = t.methods.where(~name.startswith("%") & (name != "constructor") & ~ui & F.col("has_body"))
    uses = t.uses.join(m.select(F.col("seq").alias("method")), "method", "left_semi")
    found = envy.envious_methods(uses, m.select(F.col("seq").alias("method"), F.col("class_name").alias("self_class")), t.fields, o.atfd, o.lda, o.cpfd)
    rows = found.join(m, F.col("method") == F.col("seq"))
    text = report.envy_text(name, F.col("dominant"), F.col("atfd"), F.col("lda"), F.col("cpfd"), even)
    return _issues(rows, rule, F.col("start_line"), F.col("start_col"), F.col("start_col") + F.length(name), text, F.col("file"), name)


def for_each_rule(t: Tables, o: O.ForEachOptions, rule: Rule) -> DataFrame:
    m = build_methods(t.methods).select(F.col("seq").alias("method"), F.col("file").alias("path"))
    calls = t.stmts.join(m, "method").select("path", "line", "col", "text", F.explode("calls").alias("c")).select("path", "line", "col", "text", "c.*")
    few = metrics.few_arguments(calls, min_args=o.min_args)
    known = F.col("at_col") >= 0
    rows = _issues(few, rule, F.col("at_line"), F.col("at_col"), F.when(known, F.col("at_col") + len("ForEach") - 1).otherwise(-1), F.lit(report.FOR_EACH_TEXT), F.when(known, F.col("path")).otherwise(""))
    return report.distinct_issues(rows)


# Names of the rules and of their documents, as issue rows carry them.
RULES: dict[str, Rule] = {
    r.rule_id: r
    for r in (
        Rule("foreach-args-check", "docs/foreach-args-check.md", for_each_rule, O.ForEachOptions(), "file", 1),
        Rule("long-method-check", "docs/long-method-check.md", long_method_rule, O.LongMethodOptions(), "file"),
        Rule("feature-envy-check", "docs/feature-envy-check.md", envy_rule, O.EnvyOptions(), "file"),
        Rule("switch-statement-check", "docs/switch-statement-check.md", switch_rule, O.SwitchOptions(), "file"),
        Rule("code-clone-type1-check", "docs/code-clone-type1-check.md", _clone_rule("Type-1"), O.MethodCloneOptions(), "project"),
        Rule("code-clone-type2-check", "docs/code-clone-type2-check.md", _clone_rule("Type-2"), O.MethodCloneOptions(), "project"),
        Rule("code-clone-fragment-check", "docs/code-clone-fragment-check.md", fragment_rule, O.FragmentOptions(), "project"),
    )
}


def run(t: Tables, rule_id: str, settings: Any = None, alert: int | None = None, **given: Any) -> DataFrame:
    """Issues of one rule with the user's ``settings`` and severity; what else is ``given`` goes to the rule's function."""
    r = RULES[rule_id]
    r = Rule(r.rule_id, r.doc, r.make, r.options, r.level, r.severity, alert)
    return r.make(t, O.parse(r.options, settings), r, **given)
