"""Threshold rules over methods: length, access locality, branches, call arity, scopes, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import text as T

# Life-cycle methods of UI components.
LIFECYCLE = ("aboutToAppear", "aboutToDisappear", "onPageShow", "onPageHide", "onBackPress")


def is_ui_method(class_kind: Column, method: Column, decorators: Column, has_view_tree: Column, class_decorators: Column | None = None) -> Column:
    """Builders, methods with a view tree, a struct's build, and life-cycle methods of components (a class decorator)."""
    struct = class_kind == "STRUCT"
    component = struct & method.isin(*LIFECYCLE) & F.array_contains(decorators if class_decorators is None else class_decorators, "Component")
    return F.coalesce(F.array_contains(decorators, "Builder") | has_view_tree | (struct & (method == "build")) | component, F.lit(False))


def admitted_methods(methods: DataFrame) -> DataFrame:
    """Methods of real classes: no synthetic class or method, no constructor."""
    name = F.col("method_name")
    return methods.where(~F.col("class_name").startswith("%") & ~name.startswith("%") & (name != "constructor"))


def long_methods(methods: DataFrame, limit: int = 50, ui_soft: int = 80, ui_hard: int = 120, default_severity: int = 2) -> DataFrame:
    """Methods (``lines``, ``is_ui``) over their limit: ``severity`` and the ``over`` limit."""
    n, ui = F.col("lines"), F.col("is_ui")
    over = F.when(ui & (n > ui_hard), ui_hard).when(ui & (n > ui_soft), ui_soft).when(~ui & (n > limit), limit)
    severity = F.when(ui & (n <= ui_hard), 1).otherwise(default_severity)
    return methods.withColumns({"over": over.cast("int"), "severity": severity.cast("int")}).where(F.col("over").isNotNull())


def access_metrics(accesses: DataFrame) -> DataFrame:
    """Per ``method``: foreign accesses, locality, distinct providers, dominant provider.

    ``accesses``: method, idx, kind (local, foreign or other), provider. Ties
    of the dominant provider go to the one seen first; locality is 1 where
    nothing is accessed.
    """
    foreign = F.col("kind") == "foreign"
    per = accesses.where(foreign).groupBy("method", "provider").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("seen"))
    top = per.groupBy("method").agg(F.max_by("provider", F.struct("n", (-F.col("seen")).alias("s"))).alias("dominant"), F.count(F.lit(1)).alias("cpfd"), F.sum("n").alias("atfd"))
    local = accesses.groupBy("method").agg(F.count(F.when(F.col("kind") == "local", 1)).alias("local"))
    lda = F.coalesce(F.col("local") / F.nullif(F.col("local") + F.coalesce("atfd", F.lit(0)), F.lit(0)), F.lit(1.0))
    return local.join(top, "method", "left").select("method", F.coalesce("atfd", F.lit(0)).alias("atfd"), lda.alias("lda"), F.coalesce("cpfd", F.lit(0)).alias("cpfd"), F.coalesce("dominant", F.lit("")).alias("dominant"))


def envious(metrics: DataFrame, atfd: int = 4, lda: float = 0.33, cpfd: int = 2) -> DataFrame:
    return metrics.where((F.col("dominant") != "") & (F.col("atfd") > atfd) & (F.col("lda") < lda) & (F.col("cpfd") <= cpfd))


def few_arguments(calls: DataFrame, class_name: str = "ForEach", method_name: str = "create", min_args: int = 3) -> DataFrame:
    """Calls of class.method with too few arguments, placed at the class name within ``text``."""
    hit = F.instr("text", class_name)
    found = calls.where((F.col("class_name") == class_name) & (F.col("method_name") == method_name) & (F.col("nargs") < min_args))
    return found.withColumns({"at_line": F.when(hit > 0, F.col("line")).otherwise(-1), "at_col": F.when(hit > 0, F.col("col") + hit - 1).otherwise(-1)})


def log_lines(stmts: DataFrame) -> DataFrame:
    """``method, line`` of every line from a log statement up to the next statement, or the method's end."""
    order = Window.partitionBy("method").orderBy("idx")
    until = F.greatest(F.coalesce(F.lead("line").over(order) - 1, F.col("end_line")), F.col("line"))
    logs = stmts.withColumn("until", until).where(T.is_log(F.col("text")))
    return logs.select("method", F.explode(F.sequence("line", "until")).alias("line")).distinct()


def blank_lines(content: Column, lines: Column) -> Column:
    """Text with the given lines (from 1) emptied; numbering stays."""
    return F.array_join(F.transform(F.split(content, "\n"), lambda x, i: F.when(F.array_contains(lines, i + 1), "").otherwise(x)), "\n")


def switch_blocks(lines: Column) -> Column:
    """Switch blocks of an array of lines: first line, column of ``switch``, text.

    A block opens at a line that holds a switch and closes at a later line
    that brings the braces back to zero; one that closes more braces than it
    opens on its first line is no block; an open one ends with the lines.
    """
    block = "array<struct<first:int,column:int,text:string>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(0).cast("long").alias("depth"), F.array().cast(block).alias("out"))

    def made(first: Column, last: Column) -> Column:
        at = F.instr(F.get(lines, first), "switch")
        return F.struct(first.alias("first"), F.greatest(at - 1, F.lit(0)).cast("int").alias("column"), F.array_join(F.slice(lines, first + 1, last - first + 1), "\n").alias("text"))

    def step(s: Column, x: Column) -> Column:
        delta = T.brace_delta(x)
        opens = (s["first"] < 0) & T.contains_switch(x) & (delta >= 0)
        closes = (s["first"] >= 0) & (s["depth"] + delta <= 0)
        first = F.when(opens, s["i"]).when(closes, -1).otherwise(s["first"])
        depth = F.when(opens, delta).when((s["first"] >= 0) & ~closes, s["depth"] + delta).otherwise(F.lit(0).cast("long"))
        out = F.when(closes, F.concat(s["out"], F.array(made(s["first"], s["i"])))).otherwise(s["out"])
        return F.struct((s["i"] + 1).alias("i"), first.alias("first"), depth.alias("depth"), out.alias("out"))

    def finish(s: Column) -> Column:
        return F.when(s["first"] >= 0, F.concat(s["out"], F.array(made(s["first"], F.size(lines) - 1)))).otherwise(s["out"])

    return F.aggregate(lines, start, step, finish)


def case_lengths(blocks: DataFrame) -> DataFrame:
    """``block, label, lines`` per case of each block's ``text``; the last one without trailing blank or closing lines."""
    lines = blocks.select("block", F.posexplode(F.split("text", "\r?\n")).alias("i", "x"))
    label = F.when(F.col("x").rlike(r"(?<![A-Za-z0-9_])case\s+[^:]+:"), F.trim(F.regexp_extract("x", r"(?<![A-Za-z0-9_])case\s+([^:]+):", 1))).when(F.col("x").rlike(r"(?<![A-Za-z0-9_])default\s*:"), F.lit("default"))
    everything = Window.partitionBy("block")
    full = lines.withColumn("label", label).withColumn("last", F.max(F.when(~F.col("x").rlike(r"^[\s}]*$"), F.col("i"))).over(everything))
    heads = full.where("label is not null").withColumn("next", F.lead("i").over(everything.orderBy("i")))
    n = F.coalesce(F.col("next"), F.col("last") + 1) - F.col("i")
    return heads.select("block", "i", "label", F.greatest(n, F.lit(1)).cast("long").alias("lines"))


def clamped_depth(tokens: DataFrame) -> DataFrame:
    """Brace depth before each token, never below zero: the running sum less its lowest prefix."""
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("value") == "{", 1).when(F.col("value") == "}", -1).otherwise(0)
    summed = tokens.withColumn("s", F.sum(step).over(order))
    lowest = F.least(F.min("s").over(order), F.lit(0))
    return summed.withColumn("depth", F.col("s") - lowest).drop("s")


def conditional_tokens(tokens: DataFrame) -> DataFrame:
    """if, else and elseIf tokens with their depth; an else before an if is one elseIf."""
    order = Window.partitionBy("file").orderBy("pos")
    fused = clamped_depth(tokens).withColumns({"next": F.lead("value").over(order), "before": F.lag("value").over(order)})
    kind = F.when((F.col("value") == "else") & (F.col("next") == "if"), "elseIf").when(F.col("value") == "else", "else").when((F.col("value") == "if") & ~F.coalesce(F.col("before") == "else", F.lit(False)), "if")
    return fused.withColumn("kind", kind).where("kind is not null").select("file", "pos", "kind", "depth")


def if_chains(conditionals: DataFrame, min_branches: int = 1) -> DataFrame:
    """``file, pos, branches`` of each chain that does not stand inside an else block.

    One pass over a file's conditionals in order with a stack of the blocks
    that are open: a conditional closes all that lie deeper, an ``else`` or
    ``if`` also the chain of its own depth, an ``elseIf`` makes that longer.
    """
    entry = "struct<depth:bigint,kind:string,head:bigint,branches:bigint>"
    found = "struct<pos:bigint,branches:bigint>"
    rows = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "kind", F.col("depth").cast("long").alias("depth"))))
    none = F.struct(F.array().cast(f"array<{entry}>").alias("open"), F.array().cast(f"array<{found}>").alias("out"))
    chains = lambda es: F.transform(F.filter(es, lambda e: e["head"] >= 0), lambda e: F.struct(e["head"].alias("pos"), e["branches"].alias("branches")))

    def step(s: Column, t: Column) -> Column:
        below, deeper = F.filter(s["open"], lambda e: e["depth"] < t["depth"]), F.filter(s["open"], lambda e: e["depth"] > t["depth"])
        level = F.filter(s["open"], lambda e: e["depth"] == t["depth"])
        top = F.try_element_at(below, F.lit(-1))
        nested = F.coalesce((t["depth"] > 0) & (top["kind"] == "else") & (top["depth"] == t["depth"] - 1), F.lit(False))
        mine = F.try_element_at(level, F.lit(-1))
        goes_on = t["kind"] == "elseIf"
        head = F.when(goes_on, F.coalesce(mine["head"], F.lit(-1))).when((t["kind"] == "if") & ~nested, t["pos"]).otherwise(F.lit(-1).cast("long"))
        branches = F.when(goes_on, F.coalesce(mine["branches"], F.lit(0)) + 1).otherwise(F.lit(1).cast("long"))
        new = F.struct(t["depth"].alias("depth"), t["kind"].alias("kind"), head.cast("long").alias("head"), branches.cast("long").alias("branches"))
        done = F.concat(s["out"], chains(deeper), F.when(goes_on, F.array().cast(f"array<{found}>")).otherwise(chains(level)))
        return F.struct(F.concat(below, F.array(new)).alias("open"), done.alias("out"))

    folded = conditionals.groupBy("file").agg(rows.alias("t")).select("file", F.explode(F.aggregate("t", none, step, lambda s: F.concat(s["out"], chains(s["open"])))).alias("c"))
    return folded.select("file", "c.pos", "c.branches").where(F.col("branches") >= min_branches)


def delimited_block(texts: Column, start: Column) -> Column:
    """Text from element ``start`` (from 0) to the one that brings the braces back to zero; only the first if it holds a whole switch."""
    first = F.get(texts, start)
    whole = (T.brace_delta(first) <= 0) & T.contains_switch(first) & (T.case_count(first) > 0)
    state = F.struct(T.brace_delta(first).alias("depth"), F.array(first).alias("out"), whole.alias("done"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + T.brace_delta(x)
        return F.struct(
            F.when(s["done"], s["depth"]).otherwise(depth).alias("depth"), F.when(s["done"], s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"), (s["done"] | (depth <= 0)).alias("done")
        )

    rest = F.slice(texts, start + 2, F.greatest(F.size(texts) - start - 1, F.lit(0)))
    return F.aggregate(rest, state, step, lambda s: F.array_join(s["out"], "\n"))


def scope(c1: Column, m1: Column, c2: Column, m2: Column, same_file: Column) -> Column:
    """SAME_METHOD, SAME_CLASS or DIFFERENT_CLASS; unknown names never count as equal."""
    same_class = same_file & c1.isNotNull() & (c1 == c2)
    return F.when(F.coalesce(same_class & m1.isNotNull() & (m1 == m2), F.lit(False)), "SAME_METHOD").when(F.coalesce(same_class, F.lit(False)), "SAME_CLASS").otherwise("DIFFERENT_CLASS")


def scope_text(s: Column) -> Column:
    return F.when(s == "SAME_METHOD", "same method").when(s == "SAME_CLASS", "same class").when(s == "DIFFERENT_CLASS", "different classes").otherwise("unknown")
