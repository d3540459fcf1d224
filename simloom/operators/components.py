"""Connected components of an undirected edge table.

Two alternating star contractions: every vertex points its larger neighbours
at the smallest vertex of its neighbourhood, then its smaller ones. The number
of rounds grows with the logarithm of the longest path, no vertex list ever
leaves the executors, and each round is written to the shared scratch folder,
so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.scratch import materialize, release


def _hub_pairs(edges: DataFrame) -> DataFrame:
    """Each vertex of an edge with the smallest vertex of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hub"))
    return both.join(hubs, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    return (
        _hub_pairs(edges)
        .where(F.col("b") > F.col("a"))
        .select(F.col("hub").alias("a"), "b")
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from smaller to larger; each vertex hands its smaller neighbours to the smallest."""
    hubs = edges.groupBy("b").agg(F.min("a").alias("hub"))
    handed = edges.join(hubs, "b").where(F.col("a") != F.col("hub")).select(F.col("hub").alias("x"), F.col("a").alias("y"))
    kept = hubs.select(F.col("hub").alias("x"), F.col("b").alias("y"))
    return (
        handed.union(kept)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 64) -> DataFrame:
    """``(vertex, component)`` for every vertex with an edge; component = smallest vertex reachable.

    Null end points and self loops are ignored; an empty edge table gives an
    empty result. Vertices without an edge do not appear: the caller keeps
    them as their own component.
    """
    e = (
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), F.col(src).isNotNull().alias("ok"), F.col(dst).isNotNull().alias("ok2"))
        .where(F.col("ok") & F.col("ok2") & (F.col("a") != F.col("b")))
        .select("a", "b")
        .distinct()
    )
    e = materialize(e, "cc-edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("vertex"), F.col("a").alias("component"))
    state = None
    for _ in range(max_rounds):
        nxt = materialize(_small_star(_large_star(e)), "cc-round")
        row = nxt.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s"),
            F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("t"),
        ).first()
        release(e)  # rounds are written whole, so none reads the one before
        e, before, state = nxt, state, (row.n, row.s, row.t)
        if before == state or row.n == 0:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    hubs = e.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct()
    return e.select(F.col("b").alias("vertex"), F.col("a").alias("component")).union(hubs)
