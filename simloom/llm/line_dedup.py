"""Line dedup over suffixes of line-ID sequences, in DataFrame expressions only.

Every document is its sequence of lines that hold a word. Distinct repeated
lines are numbered in order of their hash; these are the ranks of depth 1.
Prefix doubling joins the rank of each suffix with that of the suffix as many
lines further on; sorting the distinct pairs numbers them again, which orders
all suffixes by twice as many lines. Doubling goes on until no rank repeats, so
the last level knows the longest repeat. Suffixes of one rank at depth d are
the interval of all suffixes with a common prefix of d lines; each interval
keeps its first place (by doc_id, then line).

A suffix that is not the first of an interval repeats the one that is. The
deepest such interval gives the place it repeats, and a descent through the
levels gives the length of their longest common prefix, line by line. Runs that
only continue the run of the line before leave; what stays are the maximal
repeated runs, and those of ``min_lines`` lines or more are deleted. With
``long_lines`` a single long line that also stands at an earlier place goes too.

Suffixes whose line or rank is unique leave at once, so the tables hold
repeated text only. Groups are counted before they are shuffled, joins go by
document or by rank, and a line that a third of the documents share is one
row in the table of intervals; joins with it are inner joins, which adaptive
execution splits by rows where one key has many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.bytetext import as_row, row_columns
from simloom.scratch import materialize, release

MIN_LINES = 2
#: A line of more words or more bytes is long: with ``long_lines`` it is deleted where it recurs by itself.
LONG_WORDS, LONG_BYTES = 50, 400
_WORD = r"[^\x20\x09-\x0D]"


def _key(text: Column) -> Column:
    return F.xxhash64(F.lit(11), text)


def _is_long(line: Column) -> Column:
    return (F.octet_length(line) > LONG_BYTES) | ((F.octet_length(line) > 2 * LONG_WORDS) & (F.regexp_count(line, F.lit(f"{_WORD}+")) > LONG_WORDS))


def line_places(docs: DataFrame, long_lines: bool = False) -> DataFrame:
    """``doc_id, key, k, at, h1, h2`` of each line with a word: its ordinal among those, its line number, its hash; with ``long_lines`` also ``long``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    also = (lambda x: [_is_long(x).alias("long")]) if long_lines else lambda x: []
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), x.rlike(_WORD).alias("ok"), *also(x))), lambda s: s["ok"])
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _key(text).alias("key"), F.posexplode(lines).alias("k", "s"))
    return rows.select("doc_id", "key", "k", "s.at", "s.h1", "s.h2", *(["s.long"] if long_lines else [])).distinct()


def _numbered(named: DataFrame, by: list[str], step: str) -> DataFrame:
    """``doc_id, key, k, rank, first`` of the places whose ``by`` values recur; ranks keep their order, ``first`` is the earliest place."""
    place = F.struct("doc_id", "key", "k")
    groups = named.groupBy(*by).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).where("copies > 1")
    intervals = materialize(groups.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), f"intervals-{step}")
    out = materialize(named.join(intervals.drop("copies"), by).select("doc_id", "key", "k", "rank", "first"), f"ranks-{step}")
    release(intervals)
    return out


def suffix_levels(places: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """(depth, suffixes that agree in so many lines with another) for depths that double until none does.

    ``min_lines`` is one of the depths. Depth 1 is always there, perhaps empty.
    """
    have, now = 1, _numbered(places, ["h1", "h2"], "1")
    levels = [(1, now)]
    while not now.isEmpty():
        step = have if have >= min_lines else min(have, min_lines - have)  # below min_lines the two halves may overlap
        later = now.select("doc_id", "key", (F.col("k") - step).alias("k"), F.col("rank").alias("then"))
        pairs = now.select("doc_id", "key", "k", F.col("rank").alias("r")).join(later, ["doc_id", "key", "k"])
        have, now = have + step, _numbered(pairs, ["r", "then"], str(have + step))
        levels.append((have, now))
    return levels[:-1] if len(levels) > 1 else levels


def _later(suffixes: DataFrame) -> DataFrame:
    return suffixes.where(F.struct("doc_id", "key", "k") > F.col("first"))


def maximal_runs(levels: list[tuple[int, DataFrame]], min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, key, k, lcp, first``: runs of ``lcp`` lines from ``k`` on that repeat those from the earlier place ``first``; none lies inside another."""
    deep = [_later(s).select("doc_id", "key", "k", F.lit(d).alias("lcp"), "first") for d, s in levels if d >= min_lines]
    if not deep:
        return materialize(levels[0][1].where("false").select("doc_id", "key", "k", F.lit(1).alias("lcp"), "first"), "runs")
    found = deep[0]
    for more in deep[1:]:
        found = found.union(more)
    best = found.groupBy("doc_id", "key", "k").agg(F.max(F.struct("lcp", "first")).alias("m")).select("doc_id", "key", "k", "m.lcp", "m.first")
    in_doc = Window.partitionBy("doc_id", "key").orderBy("k")
    before = F.lag(F.struct("k", F.col("first.doc_id").alias("d"), F.col("first.key").alias("y"), F.col("first.k").alias("f"))).over(in_doc)
    goes_on = (F.col("b.k") == F.col("k") - 1) & (F.col("b.d") == F.col("first.doc_id")) & (F.col("b.y") == F.col("first.key")) & (F.col("b.f") == F.col("first.k") - 1)
    runs = best.withColumn("b", before).where(~F.coalesce(goes_on, F.lit(False))).drop("b")
    runs = materialize(runs.withColumn("start_depth", F.col("lcp")), "run-starts")
    for depth, suffixes in reversed(levels[:-1]):
        side = lambda n: suffixes.select(F.col("doc_id").alias(f"d{n}"), F.col("key").alias(f"y{n}"), F.col("k").alias(f"k{n}"), F.col("rank").alias(f"r{n}"))  # noqa: B023, E731
        own = (F.col("doc_id") == F.col("d1")) & (F.col("key") == F.col("y1")) & (F.col("k") + F.col("lcp") == F.col("k1"))
        its = (F.col("first.doc_id") == F.col("d2")) & (F.col("first.key") == F.col("y2")) & (F.col("first.k") + F.col("lcp") == F.col("k2"))
        more = (F.col("start_depth") > depth) & F.coalesce(F.col("r1") == F.col("r2"), F.lit(False))
        runs = runs.join(side(1), own, "left").join(side(2), its, "left").withColumn("lcp", F.when(more, F.col("lcp") + depth).otherwise(F.col("lcp")))
        runs = runs.select("doc_id", "key", "k", "lcp", "first", "start_depth")
    reach = F.max(F.col("k") + F.col("lcp")).over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    return materialize(runs.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") < F.col("k") + F.col("lcp"))).select("doc_id", "key", "k", "lcp", "first"), "runs")


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_lines: bool = False) -> DataFrame:
    """``doc_id, key, lines``: the line numbers to delete, in order, and ``runs``, how many maximal runs they form."""
    places = materialize(line_places(docs, long_lines), "lines")
    levels = suffix_levels(places, min_lines)
    covered = maximal_runs(levels, min_lines).select("doc_id", "key", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("lcp") - 1)).alias("k"))
    release(*[s for _, s in levels])
    if long_lines:
        covered = covered.unionByName(_later(_numbered(places.where("long"), ["h1", "h2"], "long")).select("doc_id", "key", "k"))
    covered = covered.distinct()
    order = Window.partitionBy("doc_id", "key").orderBy("k")
    begins = (F.coalesce(F.lag("k").over(order), F.lit(-2)) + 1 != F.col("k")).cast("int")
    gone = covered.withColumn("b", begins).join(places.select("doc_id", "key", "k", "at"), ["doc_id", "key", "k"])
    return gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("at")).alias("lines"), F.sum("b").alias("runs"))


def _with_deletions(docs: DataFrame, min_lines: int, long_lines: bool) -> DataFrame:
    """``row`` (all columns of ``docs``), the lines to delete, the runs they form, and the text that is kept."""
    gone = deleted_lines(docs, min_lines, long_lines).withColumnRenamed("doc_id", "id")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    joined = as_row(docs).join(gone, (F.col("row.doc_id").cast("long") == F.col("id")) & (_key(text) == F.col("key")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("lines", i)), "\n")
    return joined.select("row", "lines", "runs", F.when(F.col("lines").isNull(), text).otherwise(kept).alias("kept"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_lines: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_removed, n_runs, kept_sha256``.

    ``n_lines`` counts lines with a word; blank lines are never deleted and do
    not part a run. Rows equal in doc_id and text count as one place and get
    equal results. A null text counts as empty; a row without doc_id neither
    deletes nor loses lines; an empty table gives an empty result. Texts are
    taken whole, however many lines they have. Other columns are ignored,
    what they are called included.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _with_deletions(source, min_lines, long_lines)
    lines = F.filter(F.split(F.coalesce("row.text", F.lit("")), "\n"), lambda x: x.rlike(_WORD))
    return out.select(
        "row.doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("runs", F.lit(0)).cast("long").alias("n_runs"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, min_lines: int = MIN_LINES, long_lines: bool = False) -> DataFrame:
    """``docs`` with repeated runs (and long lines, if asked) cut from their texts; documents left without a word by it are dropped.

    The same cases as ``line_dedup``; a text that loses nothing stays as it is (null included).
    """
    out = _with_deletions(docs, min_lines, long_lines)
    emptied = F.col("lines").isNotNull() & ~F.col("kept").rlike(_WORD)
    text = F.when(F.col("lines").isNull(), F.col("row.text").cast("string")).otherwise(F.col("kept"))
    return out.where(~emptied).select(*row_columns(docs.columns, text=text))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d),
n AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM n),
f AS (SELECT doc_id, k, min((doc_id, k)) OVER (PARTITION BY line, nxt) AS first FROM p WHERE nxt IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest([k, k + 1]) AS k FROM f WHERE (doc_id, k) > first),
g AS (SELECT c.doc_id, c.k, n.pos, CASE WHEN coalesce(lag(c.k) OVER (PARTITION BY c.doc_id ORDER BY c.k), -2) + 1 <> c.k THEN 1 ELSE 0 END AS b FROM c JOIN n USING (doc_id, k)),
r AS (SELECT doc_id, count(*) AS n_removed, sum(b) AS n_runs FROM g GROUP BY doc_id),
kept AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.pos) AS t FROM a LEFT JOIN g USING (doc_id, pos) WHERE g.k IS NULL GROUP BY a.doc_id),
m AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
