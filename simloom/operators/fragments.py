"""Duplicated fragments: token windows, pairs, merged runs, greedy interval dedup.

Windows are named by a double rolling hash and a second hash of their tokens;
only the names of windows that occur twice go on, and text never travels.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.scratch import free_shuffles, materialize, release


def windows(tokens: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """``file, start, w`` of each window of the ``tokens`` array; none for shorter files."""
    if size <= 0:
        raise ValueError("window size must be positive")
    n = F.size("tokens")
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(max(1, stride)))).otherwise(F.array().cast("array<int>"))
    return tokens.select("file", "tokens", F.explode(starts).alias("start")).select("file", F.col("start").cast("long").alias("start"), F.slice("tokens", F.col("start") + 1, size).alias("w"))


def fingerprint(w: Column) -> Column:
    return F.array_join(w, "|")


def rolling_hash(ids: Column, base: int, mod: int) -> Column:
    """Polynomial hash of an id array; the same as sliding it along."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda h, x: F.pmod(h * base + x, F.lit(mod)))


#: Bases and moduli of the double rolling hash.
ROLLING = ((131, 1_000_000_007), (137, 1_000_000_009))


def rolling_hashes(ids: np.ndarray, size: int, base: int, mod: int) -> np.ndarray:
    """Polynomial hash of every window of ``size`` ids, as if slid along: windows of twice the size come from two halves."""
    if size <= 0:
        raise ValueError("window size must be positive")
    if len(ids) < size:
        return np.zeros(0, dtype=np.int64)
    whole, have, block, width = None, 0, ids.astype(np.int64) % mod, 1
    while True:
        if size & width:  # the bits of the size from the lowest: block stands before what is there
            n = len(ids) - have - width + 1
            whole = block[:n] if whole is None else (block[:n] * pow(base, have, mod) + whole[width : width + n]) % mod
            have += width
        if have == size:
            return whole
        block = (block[:-width] * pow(base, width, mod) + block[width:]) % mod
        width *= 2


def _hashed(batches: Iterator[pa.RecordBatch], size: int, stride: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("ids")
        flat, off = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
        for i in range(batch.num_rows):
            own = flat[off[i] : off[i + 1]].view(np.uint64)
            if len(own) < size:
                continue
            (b1, m1), (b2, m2) = ROLLING
            low = (rolling_hashes(own % np.uint64(m1), size, b1, m1) << 31 | rolling_hashes(own % np.uint64(m2), size, b2, m2))[::stride]
            # A second, unrelated name: bits of the words mixed pairwise over doubled distances.
            mixed, width, whole, have = own, 1, None, 0
            while have < size:
                if size & width:
                    n = len(own) - have - width + 1
                    whole = mixed[:n] if whole is None else _mix(mixed[:n] * np.uint64(0x9E3779B97F4A7C15) ^ whole[width : width + n])
                    have += width
                if have < size:
                    mixed = _mix(mixed[:-width] * np.uint64(0x9E3779B97F4A7C15) ^ mixed[width:])
                    width *= 2
            n = len(low)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("file")[i].as_py()] * n, batch.column("file").type), pa.array(np.arange(n, dtype=np.int64) * stride), pa.array(low), pa.array(whole[::stride].view(np.int64))],
                names=["file", "start", "h", "h2"],
            )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def hashed_windows(tokens: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """``file, start, h, h2``: windows of the ``tokens`` array by their double rolling hash ``h`` and a second hash ``h2``.

    Equal windows have equal names; with about 124 bits, others do not. Each
    file is hashed in a time that grows with its length, whatever the size.
    """
    if size <= 0:
        raise ValueError("window size must be positive")
    kind = dict(tokens.dtypes)["file"]
    ids = tokens.select("file", F.transform("tokens", lambda t: F.xxhash64(t)).alias("ids"))
    return ids.mapInArrow(partial(_hashed, size=size, stride=max(1, stride)), f"file {kind}, start long, h long, h2 long")


def repeated_fingerprints(tokens: DataFrame, size: int) -> DataFrame:
    """``h, h2, copies`` of windows that occur twice or more; their text is never moved."""
    return hashed_windows(tokens, size).groupBy("h", "h2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def window_pairs(tokens: DataFrame, size: int) -> DataFrame:
    """``f1, s1, f2, s2`` of equal windows; in one file only where they do not overlap.

    A list of pairs by its meaning: it grows with the square of the copies.
    ``window_pair_counts`` gives their number without it.
    """
    kept = _repeated(tokens, size)
    a, b = (kept.select(F.col("file").alias(f"f{i}"), F.col("start").alias(f"s{i}"), "h", "h2") for i in (1, 2))
    before = (F.col("f1") < F.col("f2")) | ((F.col("f1") == F.col("f2")) & (F.col("s2") - F.col("s1") >= size))
    return a.join(b, ["h", "h2"]).where(before).select("f1", "s1", "f2", "s2")


def _repeated(tokens: DataFrame, size: int) -> DataFrame:
    wins = materialize(hashed_windows(tokens, size), "windows")
    hot = wins.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "h2")
    return materialize(wins.join(hot, ["h", "h2"], "left_semi"), "repeated-windows")


def window_pair_counts(tokens: DataFrame, size: int) -> DataFrame:
    """``f1, f2, pairs, first_start``: how many window pairs two files have, counted by window and file, never listed."""
    kept = _repeated(tokens, size)
    per = materialize(kept.groupBy("h", "h2", "file").agg(F.count(F.lit(1)).alias("c"), F.min("start").alias("lo")), "windows-by-file")
    a, b = (per.select(F.col("file").alias(f"f{i}"), F.col("c").alias(f"c{i}"), F.col("lo").alias(f"lo{i}"), "h", "h2") for i in (1, 2))
    across = a.join(b, ["h", "h2"]).where("f1 < f2").select("f1", "f2", (F.col("c1") * F.col("c2")).alias("pairs"), F.col("lo1").alias("first_start"))
    far = Window.partitionBy("h", "h2", "file").orderBy("start").rangeBetween(size, Window.unboundedFollowing)
    within = kept.withColumn("pairs", F.count(F.lit(1)).over(far)).where("pairs > 0").select(F.col("file").alias("f1"), F.col("file").alias("f2"), "pairs", F.col("start").alias("first_start"))
    return across.unionByName(within).groupBy("f1", "f2").agg(F.sum("pairs").alias("pairs"), F.min("first_start").alias("first_start"))


def merge_runs(pairs: DataFrame, size: int) -> DataFrame:
    """Runs of pairs that follow each other by one token in both files.

    Only neighbours in the order (f1, f2, s1, s2) are compared, so repeated
    content that interleaves diagonals breaks runs.
    """
    order = Window.partitionBy("f1", "f2").orderBy("s1", "s2")
    follows = (F.lag("s1").over(order) + 1 == F.col("s1")) & (F.lag("s2").over(order) + 1 == F.col("s2"))
    marked = pairs.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    runs = marked.groupBy("f1", "f2", "island").agg(F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.count(F.lit(1)).alias("n"))
    return runs.select("f1", "s1", (F.col("s1") + F.col("n") + (size - 2)).alias("e1"), "f2", "s2", (F.col("s2") + F.col("n") + (size - 2)).alias("e2"), (F.col("n") + (size - 1)).alias("token_count"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s1, s2) <= F.least(e1, e2)


def drop_self_overlaps(runs: DataFrame) -> DataFrame:
    """Runs without those whose two places overlap in one file."""
    return runs.where((F.col("f1") != F.col("f2")) | ~overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))


def _kept_runs(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows that overlap no kept row in both ranges, in order of starts and then size.

    Kept rows that reach the current start overlap each other in the first
    range, so their second ranges are apart and a sorted list of them suffices.
    """
    frame = frame.sort_values(["s1", "s2", "token_count"], ascending=[True, True, False], kind="stable")
    ends, starts, spans, keep = [], [], {}, []
    for s1, e1, s2, e2 in zip(frame["s1"].tolist(), frame["e1"].tolist(), frame["s2"].tolist(), frame["e2"].tolist(), strict=True):
        while ends and ends[0][0] < s1:
            gone = heapq.heappop(ends)[1]
            starts.pop(bisect.bisect_left(starts, gone))
            del spans[gone]
        at = bisect.bisect_right(starts, e2) - 1
        free = at < 0 or spans[starts[at]] < s2
        keep.append(free)
        if free and e1 >= s1:
            heapq.heappush(ends, (e1, s2))
            bisect.insort(starts, s2)
            spans[s2] = e2
    return frame[keep]


def greedy_dedup(runs: DataFrame) -> DataFrame:
    """Per file pair, in order of start and then size, a run stays if it overlaps no kept run in both files.

    All columns stay; ``s1, e1, s2, e2`` may be places or lines. The runs of
    one pair of files meet in one task, in time that grows with their number.
    """
    return runs.groupBy("f1", "f2").applyInPandas(_kept_runs, runs.schema)


def _elements(grams_: np.ndarray) -> np.ndarray:
    """Per row of gram names: the names of its multiset's elements, sorted; the k-th copy of a gram is an element of its own."""
    s = np.sort(grams_, axis=1)
    at = np.arange(s.shape[1])
    first = np.ones(s.shape, dtype=bool)
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    copy = (at - np.maximum.accumulate(np.where(first, at, 0), axis=1)).astype(np.uint64)
    return np.sort(np.where(copy > 0, _mix(s ^ _mix(copy * np.uint64(0x9E3779B97F4A7C15))), s), axis=1)


def _gram_names(ids: np.ndarray, q: int) -> np.ndarray:
    """Names of the ``q`` numbers from each place on, along the last axis."""
    n = ids.shape[-1] - q + 1
    out = _mix(ids[..., :n] + np.uint64(0x632BE59BD9B4E019))
    for j in range(1, q):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) ^ ids[..., j : j + n])
    return out


def _block_places(batch: pa.RecordBatch, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all files of a batch; row, number and first place of each block."""
    words = batch.column("ids")
    flat, off = words.values.to_numpy(zero_copy_only=False).view(np.uint64), words.offsets.to_numpy().astype(np.int64)
    count = np.maximum(0, (np.diff(off) - size) // stride + 1)
    row = np.repeat(np.arange(batch.num_rows), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return flat, row, number, off[row] + number * stride


#: Blocks whose elements are made, or compared, together.
_TOGETHER = 2048


def _block_heads(batches: Iterator[pa.RecordBatch], size: int, q: int, keep: int) -> Iterator[pa.RecordBatch]:
    """``e, fh, at``: each block's ``keep`` smallest elements; ``at`` is twice its number, and one more where the next block has the element too."""
    span = np.arange(size)
    for batch in batches:
        flat, row, number, place = _block_places(batch, size, max(1, size // 2))
        names = batch.column("fh").to_numpy(zero_copy_only=False)
        for a in range(0, len(row), _TOGETHER):
            part = slice(a, a + _TOGETHER)
            e = _elements(_gram_names(flat[place[part, None] + span], q))[:, :keep]
            block = np.repeat(np.arange(a, a + len(e)), e.shape[1])
            e = e.ravel()
            order = np.lexsort((block, e))
            e, block = e[order], block[order]
            follows = np.zeros(len(e), dtype=bool)
            follows[1:] = (e[1:] == e[:-1]) & (block[1:] == block[:-1] + 1) & (row[block[1:]] == row[block[:-1]])
            at = np.arange(len(e))
            odd = (at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 1
            both = np.zeros(len(e), dtype=bool)
            both[:-1] = odd[1:]
            e, block, both = e[~odd], block[~odd], both[~odd]
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(names[row[block]]), pa.array((2 * number[block] + both).astype(np.int64))], names=["e", "fh", "at"])


def _block_digests(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``file, fh, no, x``: a 128-bit name of each block's content."""
    span, stride = np.arange(size), max(1, size // 2)
    for batch in batches:
        flat, row, number, place = _block_places(batch, size, stride)
        for a in range(0, len(row), _TOGETHER):
            part = slice(a, a + _TOGETHER)
            names = [xxhash.xxh3_128_digest(x) for x in flat[place[part, None] + span]]
            files = batch.select(["file", "fh"]).take(pa.array(row[part]))
            yield pa.RecordBatch.from_arrays([*files.columns, pa.array(number[part]), pa.array(names, pa.binary())], names=["file", "fh", "no", "x"])


def _block_ids(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``x, ids`` of the blocks that ``asked`` names by number and content."""
    stride = max(1, size // 2)
    for batch in batches:
        words = batch.column("ids")
        flat, off = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
        for row, asked in enumerate(batch.column("asked").to_pylist()):
            places = [int(off[row]) + a["no"] * stride for a in asked]
            found = [(a["x"], flat[p : p + size]) for a, p in zip(asked, places, strict=True)]
            # Where a file's name stands twice, only the one that has the content gives it.
            found = [(x, v.tobytes()) for x, v in found if xxhash.xxh3_128_digest(np.ascontiguousarray(v)) == x]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], names=["x", "ids"])


def _lcs_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``a`` with that of ``b``."""
    last = np.zeros((len(a), b.shape[1] + 1), dtype=np.int32)
    for i in range(a.shape[1]):
        best = np.where(a[:, i, None] == b, last[:, :-1] + 1, last[:, 1:])
        np.maximum.accumulate(best, axis=1, out=last[:, 1:])
    return last[:, -1]


def _block_similarity(pairs: pa.Table, contents: pa.Table, size: int, q: int, need: int) -> pa.Table:
    """``x, y, similarity`` of the pairs of contents that share ``need`` elements."""
    at = {x: i for i, x in enumerate(contents.column("content").to_pylist())}
    ids = np.frombuffer(b"".join(contents.column("ids").to_pylist()), dtype=np.uint64).reshape(-1, size)
    elements = _elements(_gram_names(ids, q))
    x, y = (np.array([at[v] for v in pairs.column(c).to_pylist()], dtype=np.int64) for c in "xy")
    good, similarity = [], []
    for a in range(0, len(x), _TOGETHER):
        i, j = x[a : a + _TOGETHER], y[a : a + _TOGETHER]
        s = np.sort(np.concatenate([elements[i], elements[j]], axis=1), axis=1)
        some = np.flatnonzero((s[:, 1:] == s[:, :-1]).sum(axis=1) >= need)
        good.append(a + some)
        similarity.append(2 * _lcs_lengths(ids[i[some]], ids[j[some]]) / (2 * size))
    rows = pairs.select(["x", "y"]).take(pa.array(np.concatenate(good)))
    return rows.append_column("similarity", pa.array(np.concatenate(similarity), pa.float64()))


#: Pairs of one group of near copies that are compared in one task.
_PAIRS = 20_000


def near_blocks(tokens: DataFrame, size: int, threshold: float, q: int = 3) -> DataFrame:
    """Half-overlapping blocks with threshold <= LCS similarity < 1, q-gram Jaccard >= 0.7 * threshold first.

    Blocks have equally many grams, so the asked Jaccard similarity is a
    number of shared elements, and of these the ``common`` smallest are among
    the ``keep`` smallest of both blocks. Blocks with fewer such elements that
    any other place has leave first; a prefix filter on the rarest ones of the
    others loses no pair. Contents are compared once, whatever their copies;
    the pairs of places arise in the result only.
    """
    if size <= 0:
        raise ValueError("window size must be positive")
    bound, n, stride = 0.7 * threshold, size - q + 1, max(1, size // 2)
    need = next((k for k in range(1, n + 1) if k >= bound * (2 * n - k)), None)
    kind = dict(tokens.dtypes)["file"]
    if need is None:
        return tokens.sparkSession.createDataFrame([], f"f1 {kind}, s1 long, f2 {kind}, s2 long, similarity double")
    common = min(11, need)
    keep = n - need + common
    ids = tokens.where(F.size("tokens") >= size).select("file", F.xxhash64("file").alias("fh"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("ids"))
    heads = ids.select("fh", "ids").mapInArrow(partial(_block_heads, size=size, q=q, keep=keep), "e long, fh long, at long")
    seen = heads.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("e"))).where("df > 1")
    both = F.when(F.col("at") % 2 == 1, F.array(F.expr("at div 2"), F.expr("at div 2 + 1"))).otherwise(F.array(F.expr("at div 2")))
    kept = seen.select("fh", F.explode(both).alias("no"), "df", "e").groupBy("fh", "no").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("els")).where(F.size("els") >= common)
    kept = materialize(kept.select("fh", "no", F.col("els.e").alias("els")), "near-block-elements")
    free_shuffles(tokens.sparkSession)

    digests = ids.mapInArrow(partial(_block_digests, size=size), f"file {kind}, fh long, no long, x binary")
    blocks = materialize(digests.join(kept, ["fh", "no"]), "near-block-places")
    release(kept)
    free_shuffles(tokens.sparkSession)
    # Equal contents have equal elements and so are kept together; the frequency order is the same in all of them.
    contents = blocks.groupBy("x").agg(F.first("els").alias("els"), F.min(F.struct("fh", "no")).alias("at"))
    contents = materialize(contents.select("x", "els", "at.fh", "at.no"), "near-block-contents")
    heads = contents.select("x", F.explode(F.expr(f"slice(els, 1, size(els) - {common - 1})")).alias("e"))
    cand = heads.alias("a").join(heads.alias("b"), (F.col("a.e") == F.col("b.e")) & (F.col("a.x") < F.col("b.x"))).select(F.col("a.x").alias("x"), F.col("b.x").alias("y")).distinct()
    pairs = materialize(cand, "near-block-pairs")
    free_shuffles(tokens.sparkSession)

    # Pairs go to the first near content of their first one, so a group's contents travel once for every _PAIRS pairs, not for each.
    first = pairs.groupBy(F.col("y").alias("x")).agg(F.min("x").alias("lead"))
    led = pairs.join(first, "x", "left").withColumn("lead", F.coalesce("lead", "x"))
    parts = led.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / _PAIRS).alias("parts"))
    dealt = materialize(led.join(parts, "lead").select("lead", F.pmod(F.xxhash64("y"), F.col("parts")).alias("part"), "x", "y"), "near-block-pairs-dealt")
    release(pairs)
    free_shuffles(tokens.sparkSession)
    sent = dealt.select("lead", "part", "x").unionByName(dealt.select("lead", "part", F.col("y").alias("x"))).distinct()
    used = contents.join(dealt.select("x").unionByName(dealt.select(F.col("y").alias("x"))).distinct(), "x", "left_semi")
    asked = used.groupBy("fh").agg(F.collect_list(F.struct("no", "x")).alias("asked"))
    words = ids.join(asked, "fh").select("ids", "asked").mapInArrow(partial(_block_ids, size=size), "x binary, ids binary")
    sent = sent.join(words, "x").select(F.col("lead").alias("to"), F.col("part").alias("nth"), F.col("x").alias("content"), "ids")
    compare = lambda p, c: _block_similarity(p, c, size, q, need)
    scored = dealt.groupBy("lead", "part").cogroup(sent.groupBy("to", "nth")).applyInArrow(compare, "x binary, y binary, similarity double")
    scored = materialize(scored.where((F.col("similarity") >= threshold) & (F.col("similarity") < 1)), "near-block-scores")
    release(contents, dealt)
    free_shuffles(tokens.sparkSession)

    name = lambda i: F.concat_ws(":", f"f{i}", f"s{i}")
    place = lambda c, i: blocks.select(F.col("x").alias(c), F.col("file").alias(f"f{i}"), (F.col("no") * stride).alias(f"s{i}"))
    apart = (F.col("f1") != F.col("f2")) | (F.abs(F.col("s1") - F.col("s2")) >= size)
    found = scored.unionByName(scored.select(F.col("y").alias("x"), F.col("x").alias("y"), "similarity"))
    return found.join(place("x", 1), "x").join(place("y", 2), "y").where(apart & (name(1) < name(2))).select("f1", "s1", "f2", "s2", "similarity")


def enclosing_method(ranges: DataFrame, methods: DataFrame) -> DataFrame:
    """First declared method of the file that contains start..end; nulls where none does."""
    inside = (F.col("r.file") == F.col("m.file")) & (F.col("r.start") >= F.col("m.start_line")) & (F.col("r.end") <= F.col("m.end_line"))
    joined = ranges.alias("r").join(methods.alias("m"), inside, "left")
    first = F.min(F.when(F.col("m.seq").isNotNull(), F.struct("m.seq", "m.class_name", "m.method_name")))
    return joined.groupBy("r.file", "r.start", "r.end").agg(first.alias("x")).select("file", "start", "end", F.col("x.class_name").alias("class_name"), F.col("x.method_name").alias("method_name"))
