"""Feature envy: whose data a method uses, resolved from its statements.

``stmts`` rows hold what the program says, nothing resolved: ``method, idx,
text, is_branch``, the field read or written ``field`` (base, base_type, name;
null without one), what the statement defines ``def`` (name, or base and name
of a field), the value on its right ``right``, and its calls ``invokes`` (text,
declared class, base, base_type). ``methods`` rows hold ``method, self_class``;
``fields`` rows ``class_name, name, type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import text as T
from simloom.operators.metrics import access_metrics, envious
from simloom.scratch import materialize, release

STMTS = (
    "method long, idx int, line int, text string, is_branch boolean, field struct<base:string,base_type:string,name:string>, "
    "def struct<name:string,base:string>, right string, invokes array<struct<text:string,declared:string,base:string,base_type:string>>"
)


def is_foreign(provider: Column, self_class: Column) -> Column:
    """A known class other than the method's own that is no built-in one."""
    return F.coalesce((provider != "") & (provider != self_class) & ~T.is_ignored_type(provider), F.lit(False))


def is_constructor_call(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(".constructor()>")), F.lit(False))


def field_types(stmts: DataFrame, fields: DataFrame, base: Column, name: Column, out: str) -> DataFrame:
    """``stmts`` with the type of the own field ``name`` in ``out``, null where ``base`` is not this or declares none.

    Fields of a class are few against statements; the engine broadcasts the side if its size allows.
    """
    f = fields.where("name <> ''").groupBy(F.col("class_name").alias("__c"), F.col("name").alias("__f")).agg(F.max_by("type", F.coalesce("seq", F.lit(0))).alias(out))
    return stmts.join(f, (base == "this") & (F.col("self_class") == F.col("__c")) & (name == F.col("__f")), "left").drop("__c", "__f")


def _providers(rows: DataFrame, stmts: DataFrame, fields: DataFrame, rounds: int = 64) -> DataFrame:
    """``rows`` (method, self_class, base, base_type, ...) with the class of the value ``base``: ``provider``.

    ``this`` is the method's class; a typed value its type; else the field its
    first statement reads is followed, whose base is a value again. A cycle
    ends in no provider. Each round follows one field further for all values.
    """
    reads = stmts.where("def.name <> '' and field is not null").groupBy("method", F.col("def.name").alias("value")).agg(F.min_by("field", "idx").alias("f"))
    reads = materialize(reads, "envy-reads")
    named = F.when(F.col("base") == "this", F.col("self_class")).when(F.coalesce(F.col("base_type"), F.lit("")).isin("", "unknown"), F.lit(None)).otherwise(F.col("base_type"))
    values = rows.select("method", "self_class", F.col("base").alias("start"), "base", "base_type").distinct().withColumn("seen", F.array("base")).withColumn("provider", named)
    values = materialize(values, "envy-values")
    done = values.where("provider is not null").select("method", "start", "base_type", "provider")
    open_ = values.where("provider is null").withColumn("first_type", F.col("base_type"))
    parts = [done]
    for _ in range(rounds):
        step = open_.join(reads.withColumnRenamed("method", "m"), (F.col("method") == F.col("m")) & (F.col("base") == F.col("value")))
        step = field_types(step, fields, F.col("f.base"), F.col("f.name"), "own_type")
        own = F.col("f.base") == "this"
        step = step.withColumn("base_type", F.col("f.base_type")).withColumn("base", F.col("f.base"))
        found = F.when(own, F.coalesce("own_type", F.lit(""))).when(F.array_contains("seen", F.col("base")), "").when(F.coalesce("base_type", F.lit("")).isin("", "unknown"), F.lit(None)).otherwise(F.col("base_type"))
        step = materialize(step.withColumn("provider", found).withColumn("seen", F.concat("seen", F.array("base"))).select("method", "self_class", "start", "first_type", "base", "base_type", "seen", "provider"), "envy-step")
        parts.append(step.where("provider is not null").select("method", "start", F.col("first_type").alias("base_type"), "provider"))
        open_ = step.where("provider is null")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError("values refer to fields of fields deeper than the rounds allowed")
    known = parts[0]
    for p in parts[1:]:
        known = known.union(p)
    known = known.select(F.col("method").alias("__m"), F.col("start").alias("__s"), F.col("base_type").alias("__t"), "provider")
    joined = rows.join(known, (F.col("method") == F.col("__m")) & F.col("base").eqNullSafe(F.col("__s")) & F.col("base_type").eqNullSafe(F.col("__t")), "left")
    return joined.drop("__m", "__s", "__t").withColumn("provider", F.coalesce("provider", F.lit("")))


def classified(stmts: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """Accesses ``method, idx, place, what (field, write, call), kind (local, foreign, other), provider, base, text``."""
    s = stmts.join(methods.select("method", "self_class"), "method")
    reads = s.where("field is not null").select("method", "self_class", "idx", F.lit(0).alias("place"), F.col("field.base").alias("base"), F.col("field.base_type").alias("base_type"), F.col("field.name").alias("name"), F.col("def.name").alias("value"))
    reads = field_types(_providers(reads, stmts, fields), fields, F.col("base"), F.col("name"), "own_type")
    # A field of another class's type is a way to that class, not data of its own.
    through = F.coalesce((F.col("own_type") != "") & (F.col("own_type") != F.col("self_class")) & ~T.is_ignored_type(F.col("own_type")), F.lit(False))
    kind = F.when((F.col("base") == "this") & ~through, "local").when((F.col("base") != "this") & is_foreign(F.col("provider"), F.col("self_class")), "foreign").otherwise("other")
    reads = reads.select("method", "idx", "place", F.lit("field").alias("what"), kind.alias("kind"), "provider", "base", F.lit("").alias("text"), "value")
    writes = field_types(s.where("def.base = 'this'"), fields, F.col("def.base"), F.col("def.name"), "own_type").where("own_type is not null")
    writes = writes.select("method", "idx", F.lit(1).alias("place"), F.lit("write").alias("what"), F.lit("local").alias("kind"), F.lit("").alias("provider"), F.lit("this").alias("base"), F.lit("").alias("text"), F.lit(None).cast("string").alias("value"))
    calls = s.select("method", "self_class", "idx", F.posexplode("invokes").alias("p", "call")).select("method", "self_class", "idx", "p", F.col("call.text").alias("text"), "call.declared", "call.base", "call.base_type")
    first = F.row_number().over(Window.partitionBy("method", "idx", "text").orderBy("p"))
    calls = _providers(calls.withColumn("n", first).where("n = 1").drop("n"), stmts, fields)
    usable = F.coalesce((F.col("declared") != "") & (F.col("declared") != "%unk") & ~T.is_ignored_type(F.col("declared")), F.lit(False))
    provider = F.when(usable, F.col("declared")).otherwise(F.col("provider"))
    calls = calls.withColumn("provider", provider).select("method", "idx", (F.col("p") + 2).alias("place"), F.lit("call").alias("what"), F.when(is_foreign(F.col("provider"), F.col("self_class")), "foreign").otherwise("other").alias("kind"), "provider", F.coalesce("base", F.lit("")).alias("base"), "text", F.lit(None).cast("string").alias("value"))
    return reads.unionByName(writes).unionByName(calls)


def alias_closure(seeds: DataFrame, assignments: DataFrame, rounds: int = 64) -> DataFrame:
    """``method, name``: the seeds and all names they are, over ``def = right``, assigned from."""
    found = materialize(seeds.select("method", "name").distinct(), "aliases")
    edges = assignments.where("def <> '' and right <> ''").select(F.col("method").alias("m"), "def", "right").distinct()
    size = found.count()
    for _ in range(rounds):
        more = found.join(edges, (F.col("method") == F.col("m")) & (F.col("name") == F.col("def"))).select("method", F.col("right").alias("name"))
        wider = materialize(found.union(more).distinct(), "aliases")
        release(found)
        found, before, size = wider, size, wider.count()
        if before == size:
            return found
    raise RuntimeError("assignments run on longer than the rounds allowed")


def pure_mappings(stmts: DataFrame, accesses: DataFrame) -> DataFrame:
    """``method`` of those that only carry one class's fields over to one fresh object.

    No branch, no access to own data, fields of one foreign class only, each
    written by the next statement to the same base; that base comes from a
    ``new``; at most one other call goes to it and none elsewhere.
    """
    order = Window.partitionBy("method").orderBy("idx")
    nxt = stmts.withColumns({"next_base": F.lead(F.col("def.base")).over(order), "next_right": F.lead("right").over(order)})
    fields = accesses.where("what = 'field' and kind = 'foreign'").select("method", "idx", "provider", "value")
    carried = fields.join(nxt.select("method", "idx", "next_base", "next_right"), ["method", "idx"])
    target = F.when((F.col("value") != "") & (F.col("next_right") == F.col("value")) & (F.col("next_base") != "") & (F.col("next_base") != "this"), F.col("next_base"))
    per = carried.withColumn("target", target).groupBy("method").agg(
        F.count_distinct("provider").alias("providers"), F.min("target").alias("lo"), F.max("target").alias("hi"), F.max(F.col("target").isNull()).alias("lost")
    )
    able = per.where("providers = 1 and not lost and lo = hi").select("method", F.col("lo").alias("target"))
    able = able.join(stmts.where("is_branch").select("method").distinct(), "method", "left_anti").join(accesses.where("kind = 'local'").select("method").distinct(), "method", "left_anti")
    able = materialize(able, "mapping-candidates")
    flat = stmts.join(able.select("method"), "method", "left_semi").select("method", "text", F.when(F.col("def.base").isNull(), F.col("def.name")).alias("def"), "right")
    closed = alias_closure(able.select("method", F.col("target").alias("name")), flat)
    fresh = flat.where(F.contains(F.coalesce("text", F.lit("")), F.lit("= new "))).select("method", F.col("def").alias("name")).distinct().join(closed, ["method", "name"])
    fresh = materialize(fresh, "fresh")
    calls = accesses.where("what = 'call' and kind = 'foreign'").join(able, "method").join(fresh.select("method", F.col("name").alias("base"), F.lit(True).alias("is_fresh")), ["method", "base"], "left")
    left = calls.where(~(is_constructor_call(F.col("text")) & F.coalesce("is_fresh", F.lit(False))))
    said = left.groupBy("method").agg(F.count(F.when(F.col("base") == F.col("target"), 1)).alias("terminal"), F.count(F.when(F.col("base") != F.col("target"), 1)).alias("elsewhere"))
    pure = able.join(fresh.select("method").distinct(), "method", "left_semi").join(said, "method", "left")
    return pure.where("coalesce(elsewhere, 0) = 0 and coalesce(terminal, 0) <= 1").select("method")


def envious_methods(stmts: DataFrame, methods: DataFrame, fields: DataFrame, atfd: int = 4, lda: float = 0.33, cpfd: int = 2) -> DataFrame:
    """Metrics of the methods that use another class's data more than their own, pure mappings exempt."""
    fields = fields if "seq" in fields.columns else fields.withColumn("seq", F.lit(0))
    accesses = materialize(classified(stmts, methods, fields), "accesses")
    ranked = accesses.select("method", (F.col("idx").cast("long") * 1_000_000 + F.col("place")).alias("idx"), "kind", "provider")
    found = envious(access_metrics(ranked), atfd, lda, cpfd)
    return found.join(pure_mappings(stmts, accesses), "method", "left_anti")
