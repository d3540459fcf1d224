"""Runs of equal windows without a list of window pairs on disk.

Every window is known by an anchor, its leftmost smallest gram: equal windows
have equal anchors at equal offsets. Anchors with the names of their windows
are shuffled once; places of one anchor in two files give a piece of a
diagonal. Pairs within one file never leave the task that reads it.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of an anchor at most, pairs listed at once.
GRAM, AT_ONCE = 16, 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _names(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit names of all windows of ``size`` ids, made from halves of doubled widths."""
    block, width, whole, have = _mix(ids ^ np.uint64(seed)), 1, None, 0
    while True:
        if size & width:
            n = len(ids) - have - width + 1
            whole = block[:n] if whole is None else _mix(block[:n] * _GOLD + whole[width : width + n])
            have += width
        if have == size:
            return whole
        block = _mix(block[:-width] * _GOLD + block[width:])
        width *= 2


def _leftmost_min(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost smallest value of every ``span`` values."""
    n = len(values) - span + 1
    best, width = np.arange(len(values)), 1
    while 2 * width <= span:  # the best of twice the width, from two halves
        a, b = best[:-width], best[width:]
        best = np.where(values[b] < values[a], b, a)
        width *= 2
    a, b = best[:n], best[span - width : span - width + n]
    return np.where(values[b] < values[a], b, a)


def _texts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[object, np.ndarray]]:
    words, files = batch.column("ids"), batch.column("file")
    flat, off = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
    for i in np.flatnonzero(np.diff(off) >= size).tolist():
        yield files[i].as_py(), flat[off[i] : off[i + 1]].view(np.uint64)


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``g, file, at, lo, names``: an anchor, its place, the first window it stands for, and 8 bytes a window."""
    gram = min(GRAM, size)
    for batch in batches:
        kind, parts, held = batch.schema.field("file").type, [], 0
        for last, (file, ids) in _marked(_texts(batch, size)):
            if ids is not None:
                grams, names = _names(ids, gram, 1), _names(ids, size, 2)
                place = _leftmost_min(grams, size - gram + 1)
                lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                parts.append((file, grams[place[lo]].view(np.int64), place[lo], lo, names))
                held += len(names)
            if parts and (last or held > AT_ONCE):
                base = np.cumsum([0] + [len(p[4]) for p in parts])
                ends = np.concatenate([p[3] + b for p, b in zip(parts, base)] + [base[-1:]]) * 8
                names = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate([p[4] for p in parts]))])
                files = pa.array([p[0] for p in parts], kind).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])))
                g, at, lo = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(g), files, pa.array(at.astype(np.int32)), pa.array(lo.astype(np.int32)), names], names=["g", "file", "at", "lo", "names"])
                parts, held = [], 0


def _marked(items: Iterator) -> Iterator[tuple[bool, tuple]]:
    for x in items:
        yield False, x
    yield True, (None, None)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``f1, f2, s1, s2, n, l1, l2``: ``n`` equal windows one after the other in two files, from anchors sorted by ``g, file, at``.

    Where ``l1`` or ``l2`` is above 1, ``n`` is 1 and each of ``l1`` starts from ``s1`` on equals each of ``l2`` from ``s2`` on.
    """
    yield from _gathered(_grouped(batches, size))


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few batches from many small ones."""
    few, rows = [], 0
    for part in parts:
        few.append(part)
        rows += part.num_rows
        if rows > AT_ONCE >> 3:
            yield pa.Table.from_batches(few).combine_chunks().to_batches()[0]
            few, rows = [], 0
    if few:
        yield pa.Table.from_batches(few).combine_chunks().to_batches()[0]


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        g = batch.column("g").to_numpy()
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
        if held and len(g) and held[0].column("g")[0].as_py() != g[0]:
            yield from _of_anchor(pa.concat_tables(held), size)
            held = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(g)]):
            if b < len(g) or held:
                if b < len(g):
                    if b - a > 1 or held:
                        yield from _of_anchor(pa.concat_tables([*held, table.slice(a, b - a)]), size)
                    held = []
                    continue
            held.append(table.slice(a, b - a))
    if held:
        yield from _of_anchor(pa.concat_tables(held), size)


def _of_anchor(t: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    m = t.num_rows
    if m < 2:
        return
    at, lo, files = t.column("at").to_numpy().astype(np.int64), t.column("lo").to_numpy().astype(np.int64), t.column("file").combine_chunks()
    rank = files.dictionary_encode().indices.to_numpy()  # the rows are in order of file
    if rank[-1] == 0:
        return
    # A row of names by offset (anchor less start), 0 where another anchor stands for the window; equal places share one.
    names = t.column("names").combine_chunks().dictionary_encode()
    _, one, which = np.unique(names.indices.to_numpy().astype(np.int64) * (size + 1) + (at - lo), return_index=True, return_inverse=True)
    rows = np.zeros((len(one), size), np.uint64)
    for k, i in enumerate(one.tolist()):
        own = np.frombuffer(names[i].as_py(), np.uint64)
        first = at[i] - lo[i]
        rows[k, first - len(own) + 1 : first + 1] = own[::-1]
    # Places that follow each other in a file, with one and the same window, are a block: texts that repeat one word.
    alone = (rows[which] != 0).sum(axis=1) == 1
    head = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1]) | ~alone[1:]])
    long = np.diff(np.r_[head, m])
    at, rank, which, files = at[head], rank[head], which[head], files.take(pa.array(head))
    members = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])
    out, n = [], 0
    for k in range(len(rows)):
        same = (rows[k:] == rows[k]) & (rows[k] != 0)
        count = same.sum(axis=1)
        top = size - 1 - same[:, ::-1].argmax(axis=1)  # the largest offset is the first window
        for j in np.flatnonzero(count).tolist():
            for x in members[k].tolist():
                y = members[k + j]
                y = y[(rank[y] != rank[x]) & ((y > x) if j == 0 else True)]
                if not len(y):
                    continue
                a, b = np.minimum(x, y), np.maximum(x, y)
                out.append((a, b, at[a] - top[j], at[b] - top[j], np.full(len(y), count[j]), long[a], long[b]))
                n += len(y)
                if n > AT_ONCE:
                    yield _piece_batch(files, out)
                    out, n = [], 0
    if out:
        yield _piece_batch(files, out)


def _piece_batch(files: pa.Array, out: list) -> pa.RecordBatch:
    a, b, *rest = (np.concatenate([o[k] for o in out]) for k in range(7))
    return pa.RecordBatch.from_arrays([files.take(pa.array(a)), files.take(pa.array(b)), *(pa.array(x.astype(np.int32)) for x in rest)], names=["f1", "f2", "s1", "s2", "n", "l1", "l2"])


class _Kept:
    """Greedy choice among runs of one pair of files that come in order of start; see ``fragments.greedy_dedup``."""

    def __init__(self) -> None:
        self.ends: list[tuple[int, int]] = []
        self.starts: list[int] = []
        self.spans: dict[int, int] = {}

    def mask(self, s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(s1), bool)
        cuts = np.flatnonzero(np.r_[True, s1[1:] != s1[:-1]]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(s1)]):
            at = int(s1[a])
            while self.ends and self.ends[0][0] < at:
                gone = heapq.heappop(self.ends)[1]
                self.starts.pop(bisect.bisect_left(self.starts, gone))
                del self.spans[gone]
            free = np.arange(a, b)
            if self.starts and b - a > 8:  # those that meet kept runs leave at once
                over = np.array(self.starts)
                near = np.searchsorted(over, e2[a:b], "right") - 1
                until = np.array([self.spans[x] for x in self.starts])
                free = free[(near < 0) | (until[near] < s2[a:b])]
            i = 0
            while i < len(free):
                x = int(free[i])
                lo, hi = int(s2[x]), int(e2[x])
                k = bisect.bisect_right(self.starts, hi) - 1
                i += 1
                if k >= 0 and self.spans[self.starts[k]] >= lo:
                    continue
                keep[x] = True
                heapq.heappush(self.ends, (int(e1[x]), lo))
                bisect.insort(self.starts, lo)
                self.spans[lo] = hi
                i += int(np.searchsorted(s2[free[i:]], hi, "right")) if len(free) - i > 8 else 0
        return keep


class _Merger:
    """Runs of the pairs of one pair of files, which come in parts in order of (s1, s2)."""

    def __init__(self, size: int, within: bool, dedup: bool) -> None:
        self.size, self.within, self.kept = size, within, _Kept() if dedup else None
        self.open: tuple[int, int, int] | None = None

    def feed(self, s1: np.ndarray, s2: np.ndarray, last: bool = False) -> tuple[np.ndarray, ...]:
        """``s1, s2, n`` of the runs that are over."""
        if self.open is not None:  # the open run's last pair goes before, its length is added below
            o1, o2, had = self.open
            s1, s2 = np.r_[o1 + had - 1, s1], np.r_[o2 + had - 1, s2]
        if not len(s1):
            return s1, s2, s1
        heads = np.flatnonzero(np.r_[True, (s1[1:] != s1[:-1] + 1) | (s2[1:] != s2[:-1] + 1)])
        n = np.diff(np.r_[heads, len(s1)])
        r1, r2 = s1[heads], s2[heads]
        if self.open is not None:
            r1[0], r2[0], n[0] = o1, o2, n[0] + had - 1
        self.open = None if last else (int(r1[-1]), int(r2[-1]), int(n[-1]))
        if not last:
            r1, r2, n = r1[:-1], r2[:-1], n[:-1]
        if self.kept is not None:
            if self.within:
                apart = r2 > r1 + n + (self.size - 2)
                r1, r2, n = r1[apart], r2[apart], n[apart]
            if len(r1):
                far = n + (self.size - 2)
                keep = self.kept.mask(r1, r1 + far, r2, r2 + far)
                r1, r2, n = r1[keep], r2[keep], n[keep]
        return r1, r2, n


def _run_batch(f1: pa.Array, f2: pa.Array, s1: np.ndarray, s2: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
    far = n + (size - 2)
    return pa.RecordBatch.from_arrays([f1, pa.array(s1), pa.array(s1 + far), f2, pa.array(s2), pa.array(s2 + far), pa.array(n + (size - 1))], names=["f1", "s1", "e1", "f2", "s2", "e2", "token_count"])


def _listed(runs: list, kind: pa.DataType, size: int) -> pa.RecordBatch:
    times = [len(r[2]) for r in runs]
    of = pa.array(np.repeat(np.arange(len(runs)), times))
    f1, f2 = (pa.array([r[k] for r in runs], kind).take(of) for k in (0, 1))
    return _run_batch(f1, f2, *(np.concatenate([r[k] for r in runs]) for k in (2, 3, 4)), size)


def _within(batches: Iterator[pa.RecordBatch], size: int, dedup: bool) -> Iterator[pa.RecordBatch]:
    """Runs of windows equal within one file and apart."""
    for batch in batches:
        kind, runs, held = batch.schema.field("file").type, [], 0
        for file, ids in _texts(batch, size):
            if len(ids) < 2 * size:
                continue
            names = _names(ids, size, 2)
            ordered = np.sort(names)
            if not (ordered[1:] == ordered[:-1]).any():
                continue
            second = _names(ids, size, 3)
            order = np.lexsort((second, names))  # stable, so starts ascend within equal windows
            new = np.r_[True, (names[order[1:]] != names[order[:-1]]) | (second[order[1:]] != second[order[:-1]])]
            group = np.cumsum(new) - 1
            n = len(order)
            key = group * n + order  # ascends
            end = np.searchsorted(group, group, "right")
            first = np.searchsorted(key, key + size, "left")
            first, count = first, np.maximum(end - np.minimum(first, end), 0)
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            first, count = first[rank], count[rank]  # by start
            if not count.any():
                continue
            total, merger, a = np.cumsum(count), _Merger(size, True, dedup), 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, "right")))
                c = count[a:b]
                s1 = np.repeat(np.arange(a, b), c)
                skip = np.cumsum(c) - c
                s2 = order[np.arange(len(s1)) - np.repeat(skip - first[a:b], c)]
                got = merger.feed(s1, s2, b >= n)
                if len(got[0]):
                    runs.append((file, file, *got))
                    held += len(got[0])
                if held > AT_ONCE:
                    yield _listed(runs, kind, size)
                    runs, held = [], 0
                a = b
        if runs:
            yield _listed(runs, kind, size)


def _rows_of(u1: np.ndarray, u2: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order, from starts ``u1`` in order that meet ``many`` starts from ``u2`` on; all of one ``u1`` at once."""
    total, cuts, a = np.cumsum(many), np.flatnonzero(np.r_[u1[1:] != u1[:-1], True]) + 1, 0
    while a < len(u1):
        fit = int(np.searchsorted(total[cuts - 1], (total[a - 1] if a else 0) + AT_ONCE, "right"))
        b = int(cuts[max(fit - 1, int(np.searchsorted(cuts, a, "right")))])
        c = many[a:b]
        x, y = np.repeat(u1[a:b], c), np.repeat(u2[a:b], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        order = np.lexsort((y, x))
        yield x[order], y[order]
        a = b


def _across(batches: Iterator[pa.RecordBatch], size: int, dedup: bool) -> Iterator[pa.RecordBatch]:
    """Runs from pieces sorted by ``f1, f2, s1, s2``; pairs are listed as soon as no later piece starts before them."""
    none = np.zeros(0, np.int64)
    now, merger, wait, runs, held, kind = None, None, (none,) * 3, [], 0, None

    def add(pair: tuple, got: tuple[np.ndarray, ...]) -> None:
        nonlocal held
        if len(got[2]):
            runs.append((*pair, *got))
            held += len(got[2])

    def over() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if runs and held > AT_ONCE >> 3:
            yield _listed(runs, kind, size)
            runs.clear()
            held = 0

    def finish() -> Iterator[pa.RecordBatch]:
        if now is not None:
            for x, y in _rows_of(*wait):
                add(now, merger.feed(x, y))
                yield from over()
            add(now, merger.feed(none, none, True))
            yield from over()

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("f1").type
        f1, f2 = batch.column("f1"), batch.column("f2")
        i1, i2 = (f.dictionary_encode().indices.to_numpy().astype(np.int64) for f in (f1, f2))
        s1, s2, n, l1, l2 = (batch.column(c).to_numpy().astype(np.int64) for c in ("s1", "s2", "n", "l1", "l2"))
        cuts = np.flatnonzero(np.r_[True, (i1[1:] != i1[:-1]) | (i2[1:] != i2[:-1])]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(s1)]):
            pair = (f1[a].as_py(), f2[a].as_py())
            if pair != now:
                yield from finish()
                now, merger, wait = pair, _Merger(size, False, dedup), (none,) * 3
                if dedup and b - a == 1 and b < len(s1) and min(l1[a], l2[a]) > 1:
                    # All starts of a stretch equal all of another: no run is longer than a window, and every size-th of each stays.
                    x, y = np.arange(s1[a], s1[a] + l1[a], size), np.arange(s2[a], s2[a] + l2[a], size)
                    add(pair, (np.repeat(x, len(y)), np.tile(y, len(x)), np.ones(len(x) * len(y), np.int64)))
                    now = None
                    continue
            c = n[a:b] * l1[a:b]
            step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            u = (np.repeat(s1[a:b], c) + step, np.repeat(s2[a:b], c) + step * np.repeat(n[a:b] > 1, c), np.repeat(l2[a:b], c))
            u = [np.r_[p, q] for p, q in zip(wait, u)]
            order = np.argsort(u[0], kind="stable")
            done = int(np.searchsorted(u[0][order], s1[b - 1], "left"))  # later pieces start at the last one's place or after it
            for x, y in _rows_of(*(p[order[:done]] for p in u)):
                add(now, merger.feed(x, y))
                yield from over()
            wait = tuple(p[order[done:]] for p in u)
        yield from over()
    yield from finish()
    if runs:
        yield _listed(runs, kind, size)


def window_runs(tokens: DataFrame, size: int, dedup: bool = False) -> DataFrame:
    """``merge_runs`` of ``window_pairs``; with ``dedup``, ``greedy_dedup`` of those whose places do not overlap.

    Only anchors with 8 bytes a window, and pieces of pairs of different files,
    are shuffled; one anchor's places meet in one task, as do the pieces of two
    files, both read in batches.
    """
    if size <= 0:
        raise ValueError("window size must be positive")
    kind = dict(tokens.dtypes)["file"]
    ids = tokens.select("file", F.transform("tokens", lambda t: F.xxhash64(t)).alias("ids"))
    run = f"f1 {kind}, s1 long, e1 long, f2 {kind}, s2 long, e2 long, token_count long"
    within = ids.mapInArrow(partial(_within, size=size, dedup=dedup), run)
    anchors = ids.mapInArrow(partial(_anchors, size=size), f"g long, file {kind}, at int, lo int, names binary")
    pieces = anchors.repartition("g").sortWithinPartitions("g", "file", "at").mapInArrow(partial(_pieces, size=size), f"f1 {kind}, f2 {kind}, s1 int, s2 int, n int, l1 int, l2 int")
    across = pieces.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "s1", "s2").mapInArrow(partial(_across, size=size, dedup=dedup), run)
    return within.unionByName(across)
