"""Duplicate methods: exact pairs, near-miss pairs, classes, pair keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.operators.components import connected_components
from simloom.operators.order import numbered
from simloom.scratch import materialize

RATIO = 1.25


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def exact_pairs(methods: DataFrame) -> DataFrame:
    """``a, b`` of every two methods (``seq``) of equal ``content``, earlier first.

    Contents are compared by digest, and groups of one leave before the join.
    """
    named = methods.select("seq", F.sha2("content", 256).alias("h"))
    several = named.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    kept = named.join(several, "h", "left_semi")
    a, b = kept.select(F.col("seq").alias("a"), "h"), kept.select(F.col("seq").alias("b"), "h")
    return a.join(b, "h").where("a < b").select("a", "b")


def near_miss_pairs(methods: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a, b, similarity``: multiset Jaccard of ``stmts`` >= threshold, size ratio <= 1.25, contents not equal.

    Elements are numbered occurrences of a statement's hash, rarest first; two
    multisets of that similarity share one of their first
    n - ceil(threshold * n) + 1 elements (prefix filter). Equal contents are
    folded into one representative before, and unfolded after.
    """
    base = methods.select("seq", F.sha2(F.array_join("stmts", "|"), 256).alias("h"), "stmts", F.size("stmts").alias("n")).where("n > 0")
    fold = materialize(base.groupBy("h").agg(F.min("seq").alias("rep"), F.first("n").alias("n")), "contents")
    reps = base.join(fold.select("h", "rep"), "h").where("seq = rep").dropDuplicates(["rep"])
    flat = reps.select("rep", "n", F.explode("stmts").alias("s")).groupBy("rep", "n", F.xxhash64("s").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    elements = flat.select("rep", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("c").cast("int")), lambda i: F.xxhash64("s", i))).alias("e"))
    elements = materialize(elements, "elements")
    freq = elements.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "e"))
    ranked = elements.join(freq, "e", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", place)
    heads = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("df") > 1)).select("rep", "n", "e")
    sized = (F.col("x.n") <= F.col("y.n") * RATIO) & (F.col("y.n") <= F.col("x.n") * RATIO)
    cand = heads.alias("x").join(heads.alias("y"), (F.col("x.e") == F.col("y.e")) & (F.col("x.rep") < F.col("y.rep")) & sized).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    shared = cand.join(elements.select(F.col("rep").alias("a"), "e"), "a").join(elements.select(F.col("rep").alias("b"), "e"), ["b", "e"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("m"))
    similar = shared.withColumn("similarity", F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).where(F.col("similarity") >= threshold)
    members = base.join(fold.select("h", "rep"), "h").select("rep", "seq")
    out = similar.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "similarity")
    out = out.join(members.select(F.col("rep").alias("ra"), F.col("seq").alias("p")), "ra").join(members.select(F.col("rep").alias("rb"), F.col("seq").alias("q")), "rb")
    return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def first_pairs(methods: DataFrame, by_content: bool = True) -> DataFrame:
    """``key, bucket, a, b``: of all exact pairs with one unordered pair of ``key`` values the first one found.

    Pairs are found by content in order of its first method, then by ``a`` and
    ``b`` (without ``by_content`` by those alone). Of each content and key only the two earliest methods can be in a
    first pair, so a group of copies takes part with its distinct keys.
    """
    named = methods.select("seq", "key", F.sha2("content", 256).alias("h"))
    reps = named.groupBy("h", "key").agg(F.min("seq").alias("a"), F.count(F.lit(1)).alias("c"))
    second = named.join(reps.where("c > 1").select("h", "key", F.col("a").alias("lo")), ["h", "key"]).where("seq > lo").groupBy("h", "key").agg(F.min("seq").alias("b"))
    reps = reps.join(second, ["h", "key"], "left")
    buckets = reps.groupBy("h").agg(F.min("a").alias("bucket"), F.sum("c").alias("n")).where("n > 1").select("h", "bucket")
    reps = materialize(reps.join(buckets, "h"), "first-copies")
    same = reps.where("b is not null").select(pair_key(F.col("key"), F.col("key")).alias("key"), "bucket", "a", "b")
    x, y = (reps.select("h", "bucket", F.col("key").alias(f"k{i}"), F.col("a").alias(f"a{i}")) for i in (1, 2))
    cross = x.join(y.drop("bucket"), "h").where("k1 < k2").select(pair_key(F.col("k1"), F.col("k2")).alias("key"), "bucket", F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b"))
    first = same.unionByName(cross).groupBy("key").agg(F.min(F.struct("bucket", "a", "b") if by_content else F.struct("a", "b", "bucket")).alias("p"))
    return first.select("key", "p.bucket", "p.a", "p.b")


def exact_links(methods: DataFrame) -> DataFrame:
    """``a, b``: every method of a group of equal ``content`` with the group's first, so n - 1 rows for n copies."""
    named = methods.select("seq", F.sha2("content", 256).alias("h"))
    heads = named.groupBy("h").agg(F.min("seq").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "a")
    return named.join(heads, "h").where("a <> seq").select("a", F.col("seq").alias("b"))


def exact_pair_counts(methods: DataFrame, by: str) -> DataFrame:
    """``by, pairs``: exact pairs by a column of their earlier method, counted from places in the sorted groups, never listed."""
    named = methods.select("seq", by, F.sha2("content", 256).alias("h"))
    several = named.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    placed = numbered(named.join(several, "h", "left_semi"), "i", "h", "seq")
    last = placed.groupBy("h").agg(F.max("i").alias("last"))
    return placed.join(last, "h").where("i < last").groupBy(by).agg(F.sum(F.col("last") - F.col("i")).alias("pairs"))


def clone_members(links: DataFrame) -> DataFrame:
    """``class_key, member``: one row a member of each class, named by its smallest."""
    labels = connected_components(links)
    return labels.select(F.col("component").alias("class_key"), F.col("vertex").alias("member"))


def clone_classes(links: DataFrame) -> DataFrame:
    """``class_key, size, members``: for reports, whose classes are listed in one text; ``clone_members`` has no such list."""
    return clone_members(links).groupBy("class_key").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("member")).alias("members"))
