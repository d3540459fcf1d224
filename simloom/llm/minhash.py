"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles, hashed once; its sketch is the
``k`` smallest hashes. Equal sets are folded into one class first. Then

1. inverted lists of retained values: each class is filed under every run of
   three consecutive retained values. Two sets of the asked similarity agree
   on most of the union's smallest values, so they share many such runs;
   sets that only share a passage share hardly any.
2. classes that share too few lists with anyone leave; the others' full sets
   are fetched once, and each learns how many of its shingles no other
   candidate has (``lone``), which bounds its similarity to anything.
3. star: in every list each member is paired with the most central one
   (fewest lone shingles), filtered by the union-sketch estimate and verified
   on the full sets. Connected components follow.
4. components that still meet in a list are compared in blocks of bounded
   size, two blocks a task, on the full sets; a task returns only links that
   join two components.

So a group of thousands of near copies costs about one pair a member and list
plus a few matrix products, no list is capped, and no list of all pairs is
ever written. Two sets of at most ``k`` shingles always meet in a list. Larger
ones need three common lists of about 62; at similarity 0.85 they have 40 on
average, and tests hold the least number over thousands of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.bytetext import distinct_sorted, list_array, mix64, shingles, sliced
from simloom.operators.components import connected_components
from simloom.scratch import materialize

SKETCH = 64
#: Ids up to this many are broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Sets of fewer shingles are also filed under each single value.
SMALL = 12
#: Classes and shingles of a block (a larger set is a block by itself); two blocks meet in a task. Columns of a matrix product.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 200_000, 4096
#: A candidate's estimate may fall this far short before verification.
ESTIMATE_FLOOR = 0.5


def _sets(batch_texts, width: int):
    low = batch_texts.lowered()
    start, end, row = low.words()
    return distinct_sorted(*shingles(low.hashes(start, end), row, low.rows, width))


def _sketch(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for part, t in sliced(batches, "text"):
        row, v = _sets(t, width)
        n = t.per_row(row)
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        rank = np.arange(len(row)) - first[row]
        small = rank < k
        sums = []
        for salt in (0x51ED270B, 0x2545F491):
            mixed = np.concatenate([[0], np.cumsum(mix64(v.view(np.uint64) ^ np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64)
            sums.append((mixed[first + n] - mixed[first]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), list_array(v[small], np.minimum(n, k))],
            names=["doc_id", "n", "s1", "s2", "sketch"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part, t in sliced(batches, "text"):
        row, v = _sets(t, width)
        yield pa.RecordBatch.from_arrays([part.column("v"), list_array(v, t.per_row(row))], names=["v", "shingles"])


def _few(df: DataFrame) -> DataFrame:
    """Hint a broadcast only where the row count has been checked."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _enough(inter: Column, n1: Column, n2: Column, num: int, den: int) -> Column:
    return (inter * den) >= (n1 + n2 - inter) * num


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Pairs (a, b) that reach num/den on their full sets, after the union-sketch estimate."""
    side = lambda c: sets.select(F.col("v").alias(c), F.col("shingles").alias(f"s_{c}"), F.col("n").alias(f"n_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = both.where((F.least("n_a", "n_b") * den) >= (F.greatest("n_a", "n_b") * num))
    sk = lambda c: F.slice(f"s_{c}", 1, k)
    union = F.slice(F.array_sort(F.array_union(sk("a"), sk("b"))), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(sk("a"), sk("b"))))
    estimated = sized.where(shared >= F.size(union) * ESTIMATE_FLOOR)
    inter = F.size(F.array_intersect("s_a", "s_b"))
    return estimated.where(_enough(inter, F.col("n_a"), F.col("n_b"), num, den)).select("a", "b").distinct()


def _links_of_block(frame: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between different components among the two blocks of sets in ``frame``; a spanning part of them suffices."""
    lengths = frame["shingles"].map(len).to_numpy()
    values = np.concatenate(frame["shingles"].to_list()) if len(frame) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(frame)), lengths)
    kinds, at, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, at = owner[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    inter = np.zeros((len(frame), len(frame)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int((times > 1).sum()), COLUMNS):
        part = slice(*np.searchsorted(at, [low, low + COLUMNS]))
        dense = np.zeros((len(frame), COLUMNS), dtype=np.float32)
        dense[owner[part], at[part] - low] = 1
        inter += dense @ dense.T
    v, comp = frame["v"].to_numpy(), frame["comp"].to_numpy()
    near = inter * den >= (lengths[:, None] + lengths[None, :] - inter) * num
    x, y = np.nonzero(near & (comp[:, None] < comp[None, :]))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = find(comp[i]), find(comp[j])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((v[i], v[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _between_components(labelled: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links that join two components, among classes that meet in a list.

    Components that meet in some list form a cluster. Sets of a cluster are
    dealt into size classes of which only neighbours can be similar enough,
    these into blocks of bounded size, and every two blocks that may hold
    similar sets meet in one task, which compares all its sets by matrix
    products and returns only links that still join something: no list of
    pairs is ever written. The work grows with the square of the sets of like
    size in a cluster that one star did not join already.
    """
    keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "lo")
    still = labelled.join(keys, "key").select("v", "n", "n_min", "comp", "lo")
    still = materialize(still.distinct(), "open")
    clusters = connected_components(still.select(F.col("comp").alias("a"), F.col("lo").alias("b")).distinct())
    members = still.select("v", "n", "n_min", "comp").distinct().join(clusters, F.col("comp") == F.col("vertex"))
    # Similar sets differ in size by at most den / num, so by one size class; a vertex of several sets lies in all theirs.
    log = lambda c: F.floor(F.log(c) / math.log(den / num * 1.000001)).cast("int")
    sized = members.select("v", "n", "comp", F.col("component").alias("cluster"), F.explode(F.sequence(log(F.col("n_min")), log(F.col("n")))).alias("size"))
    sized = materialize(sized, "clusters")
    blocks = sized.groupBy("cluster", "size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    near = [sized.select("cluster", "size").distinct()]
    for step, name in ((0, "own_blocks"), (1, "next_blocks"), (-1, "last_blocks")):
        other = blocks.select("cluster", (F.col("size") - step).alias("size"), F.col("blocks").alias(name))
        near.append(near[-1].join(other, ["cluster", "size"], "left").na.fill(0, [name]))
    dealt = sized.join(near[-1], ["cluster", "size"]).withColumn("own", F.pmod(F.xxhash64("v"), F.col("own_blocks")).cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    meeting = lambda a, i, b, j: F.struct(a.alias("a"), i.alias("i"), b.alias("b"), j.alias("j"))
    size, own = F.col("size"), F.col("own")
    meets = F.concat(
        F.transform(upto("own_blocks"), lambda m: meeting(size, F.least(m, own), size, F.greatest(m, own))),
        F.transform(upto("next_blocks"), lambda m: meeting(size, own, size + 1, m)),
        F.transform(upto("last_blocks"), lambda m: meeting(size - 1, m, size, own)),
    )
    met = dealt.withColumn("m", F.explode(meets)).select("v", "comp", "cluster", F.xxhash64("m").alias("task")).distinct()
    filled = met.join(sets.select("v", "shingles"), "v")
    return filled.groupBy("cluster", "task").applyInPandas(lambda f: _links_of_block(f, num, den), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, k: int = SKETCH) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest doc_id reachable over links of Jaccard
    similarity >= num/den between sets of ``width``-word shingles; ``kept`` is
    ``doc_id = component_id``. Texts that are null, empty or blank have an
    empty set and stand alone. Rows that share a doc_id are one vertex. A null
    doc_id is never linked: its component_id is null and it is kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(
        source.mapInArrow(partial(_sketch, width=width, k=k), "doc_id long, n long, s1 long, s2 long, sketch array<long>"), "sketches"
    )
    real = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("v"))
    members = real.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2"])
    members = materialize(members, "members")
    heads = members.where(F.col("doc_id") == F.col("v")).select("v", "s1", "s2").distinct()

    need = F.when(F.col("n") < 24, 1).otherwise(3)
    runs = F.when(
        F.size("sketch") >= 3,
        F.transform(F.sequence(F.lit(1), F.size("sketch") - 2), lambda i: F.xxhash64(F.get("sketch", i - 1), F.get("sketch", i), F.get("sketch", i + 1))),
    ).otherwise(F.array().cast("array<bigint>"))
    runs = F.when(F.col("n") < SMALL, F.concat(runs, F.col("sketch"))).otherwise(runs)  # few values: one may part every run
    filed = (
        real.select(F.col("doc_id").alias("v"), "n", "s1", "s2", F.array_distinct(runs).alias("keys"))
        .join(heads.hint("shuffle_hash"), ["v", "s1", "s2"], "left_semi")
        .select("v", "n", F.explode("keys").alias("key"))
        .distinct()
    )
    shared = filed.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").select("key")
    lists = materialize(filed.join(shared, "key"), "lists")
    able = lists.groupBy("v", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= need).select("v", "n").distinct()
    able = materialize(able, "able")

    ids = able.select("v").distinct()
    sets = (
        source.where(F.col("doc_id").isNotNull())
        .withColumnRenamed("doc_id", "v")
        .join(_few(ids), "v", "left_semi")
        .mapInArrow(partial(_full_sets, width=width), "v long, shingles array<long>")
    )
    sets = materialize(sets.withColumn("n", F.size("shingles").cast("long")).where("n > 0"), "sets")
    owned = sets.select("v", F.explode("shingles").alias("x")).groupBy("x").agg(F.min("v").alias("v"), F.max("v").alias("w"))
    lone = owned.where("v = w").groupBy("v").agg(F.count(F.lit(1)).alias("lone"))
    known = materialize(
        sets.groupBy("v").agg(F.min("n").alias("n_min"), F.max("n").alias("n")).join(lone, "v", "left").select("v", "n", "n_min", F.coalesce("lone", F.lit(0)).alias("lone")),
        "known",
    )
    # A vertex whose lone shingles alone break the threshold links with nobody (one set a vertex only).
    possible = known.where((F.col("n") != F.col("n_min")) | ((F.col("n") - F.col("lone")) * den >= F.col("n") * num))
    filed = materialize(lists.select("key", "v").distinct().join(possible, "v"), "filed")

    centre = filed.groupBy("key").agg(F.min(F.struct("lone", "v")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("m.v").alias("b"))
    star = filed.join(centre, "key").where("v <> b").groupBy(F.col("v").alias("a"), "b", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= need).select("a", "b").distinct()
    links = materialize(_verify(star, sets, num, den, k), "links")
    labels = connected_components(links)

    labelled = filed.join(labels, filed.v == labels.vertex, "left").select("key", "v", "n", "n_min", "lone", F.coalesce("component", "v").alias("comp"))
    labelled = materialize(labelled, "labelled")
    more = materialize(_between_components(labelled, sets, num, den), "more-links")
    # Rows of one doc_id with different texts hold their classes together.
    spread = members.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").select("doc_id", "a")
    same_id = members.join(spread, "doc_id").select("a", F.col("v").alias("b")).where("a <> b")
    extra = more.union(same_id)
    if not extra.isEmpty():
        labels = connected_components(links.union(extra))
    named = members.join(labels, members.v == labels.vertex, "left").select("doc_id", "s1", "s2", "n", F.coalesce("component", "v").alias("component_id"))
    alone = rows.where(F.col("doc_id").isNull() | (F.col("n") <= 0)).select("doc_id", "s1", "s2", "n", F.col("doc_id").alias("component_id"))
    return named.union(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def oracle_sql(width: int = 3, num: int = 85, den: int = 100) -> str:
    """The same components in DuckDB: every two sets that share a shingle, whole sets, closure over the links."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{width - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {width - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * m >= {num} * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a AS v, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v WHERE c.r < e.b),
k AS (SELECT v, min(r) AS r FROM c GROUP BY v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r, d.doc_id)) AS component_id, least(d.doc_id, coalesce(r, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.v = d.doc_id"""
