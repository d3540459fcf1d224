"""Exact substring dedup: bytes of any 50-byte string that an earlier document has.

Strings of ``LENGTH`` bytes are compared by sorting suffixes, but only where
something can match. Every string is named by the smallest hash among its
24-byte substrings; equal strings have equal names, so strings of different
names never need to meet, and a run of neighbouring strings with one name
travels as one context.

1. Documents are packed into slices of a few megabytes, kept as a table
   bucketed by slice, so later joins with it move only the small side.
2. Each slice sends its distinct names, packed per range of names; a range
   answers with one bit a name: does any other document use it?
3. Each slice sends the distinct contexts under shared names, each with the
   smallest doc_id that has it. A range sorts the suffixes of its contexts
   deep-shallow: multikey passes over 8-byte symbols to 24 bytes, then blind
   tries for groups that still agree. Neighbours that agree in LENGTH bytes
   are one string; the smallest doc_id of each goes back, run-length coded.
4. Each slice marks the bytes whose string starts in a smaller doc_id.

A passage in a third of all documents reaches a range once a slice, never
once a document. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.bytetext import Texts, eights, mix64, packed, sliced, unpacked
from simloom.scratch import bucketed, materialize

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: Text bytes a bucket of the slice table, names a range.
BUCKET_BYTES, RANGE_NAMES = 16 << 20, 1 << 18
SHALLOW = 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class BlindTrie:
    """Sorts distinct byte strings: descends by branch bytes alone, then compares once."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: int | list = 0 if strings else []
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, list):  # [depth, {byte: node}]
            children = node[1]
            node = children.get(s[node[0]]) if s[node[0]] in children else next(iter(children.values()))
        other = self.strings[node]
        at = next(k for k, (x, y) in enumerate(zip(s, other, strict=True)) if x != y)
        parent, byte, node = None, 0, self.root
        while isinstance(node, list) and node[0] < at:
            parent, byte = node, s[node[0]]
            node = node[1][byte]
        if isinstance(node, list) and node[0] == at:
            node[1][s[at]] = i
            return
        split = [at, {other[at]: node, s[at]: i}]
        if parent is None:
            self.root = split
        else:
            parent[1][byte] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True)) if node else None
            else:
                out.append(node)
        return out


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """Places in order of the keys, the first one leading; equal ones in any order.

    The first key is sorted by itself; only its groups that differ in a later
    key are sorted by all of them, and most groups are of equal strings.
    """
    order = np.argsort(keys[0])
    first = keys[0][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = first[1:] != first[:-1]
    group = np.cumsum(new) - 1
    head = order[new][group]
    differs = np.zeros(len(order), dtype=bool)
    for k in keys[1:]:
        differs |= k[order] != k[head]
    mixed = np.zeros(len(order), dtype=bool)  # by group
    mixed[group[differs]] = True
    at = np.flatnonzero(mixed[group])
    some = order[at]
    order[at] = some[np.lexsort([*(k[some] for k in keys[:0:-1]), group[at]])]
    return order


def deep_shallow(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings buf[s:s+length] and, along it, a flag where a string equals the one before."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = [*range(0, length - 7, 8)]
    if at[-1] + 8 < length:
        at.append(length - 8)
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    word = lambda k, some: np.ascontiguousarray(eight[some + at[k]]).view(">u8").reshape(-1).astype(np.uint64)
    keys = [word(k, starts) for k in range(min(SHALLOW, len(at)))]
    order = _order(keys)
    same = np.ones(n, dtype=bool)
    same[0] = False
    for k in keys:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    rest = range(len(keys), len(at))
    member = same.copy()
    member[:-1] |= same[1:]
    deep = np.flatnonzero(member)
    if not len(rest) or not len(deep):
        return order, same
    head = np.flatnonzero(~same[deep])
    group = np.cumsum(~same[deep]) - 1
    differs = np.zeros(len(deep), dtype=bool)
    tails = [word(k, starts[order[deep]]) for k in rest]
    for tail in tails:
        differs |= tail != tail[head][group]
    mixed = np.unique(group[differs])
    ends = np.append(head[1:], len(deep))
    # A trie of two strings is one branch: all of those are compared at once, by the first number that differs.
    two = mixed[ends[mixed] - head[mixed] == 2]
    turn, open_ = np.zeros(len(two), dtype=bool), np.ones(len(two), dtype=bool)
    for tail in tails:
        a, b = tail[head[two]], tail[head[two] + 1]
        turn |= open_ & (a > b)
        open_ &= a == b
    at = deep[head[two]]
    same[at + 1] = False
    at = at[turn]
    order[at], order[at + 1] = order[at + 1], order[at]
    for g in np.setdiff1d(mixed, two, assume_unique=True):
        a, b = head[g], ends[g]
        block = order[deep[a:b]]
        text = [buf[starts[i] : starts[i] + length].tobytes() for i in block]
        kinds = list(dict.fromkeys(text))
        place = {kinds[k]: r for r, k in enumerate(BlindTrie(kinds).order())}
        rank = np.array([place[x] for x in text])
        inner = np.argsort(rank, kind="stable")
        order[deep[a:b]] = block[inner]
        same[deep[a + 1 : b]] = rank[inner][1:] == rank[inner][:-1]
    return order, same


class Runs:
    """Runs of neighbouring strings of one name in the documents of a slice."""

    def __init__(self, t: Texts) -> None:
        self.t = t
        n = len(t.buf)
        size = np.diff(t.off)
        if n < LENGTH:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            self.name = np.zeros(0, np.uint64)
            return
        part = mix64(np.ascontiguousarray(eights(t.buf)[: n - 7]))
        grams = sum(part[k : n - GRAM + 1 + k] * _ODD[k // 8] for k in range(0, GRAM, 8))
        low, have = grams, 1
        while have * 2 <= SPAN:
            low = np.minimum(low[: len(low) - have], low[have:])
            have *= 2
        if have < SPAN:
            low = np.minimum(low[: len(low) - (SPAN - have)], low[SPAN - have :])
        whole = np.zeros(n + 1, dtype=np.int32)
        long = size >= LENGTH
        np.add.at(whole, t.off[:-1][long], 1)
        np.add.at(whole, t.off[1:][long] - LENGTH + 1, -1)
        at = np.flatnonzero(np.cumsum(whole)[: len(low)] > 0)
        least, row = low[at], np.repeat(np.arange(t.rows), size)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        # Smallest hashes crowd near zero, and names are dealt by size.
        self.start, self.name, self.row = at[head], mix64(least[head] + np.uint64(0x5DEECE66D)), row[head]
        self.end = np.append(at[head[1:] - 1], at[-1:]) + 1 if len(at) else self.start  # past the last string's start


def _range_of(name: np.ndarray, ranges: int) -> np.ndarray:
    return ((name >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part_id, seq = TaskContext.get().partitionId(), 0
    for part, t in sliced(batches, "text"):
        ids = part.column("doc_id").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part_id << 32 | seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.diff(t.off)], pa.list_(pa.int64())), pa.array([packed(t.buf.tobytes())], pa.binary())],
            names=["slice", "ids", "sizes", "data"],
        )
        seq += 1


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, Texts]]:
    """Each slice of the table: its row, number, doc_ids (null: largest) and texts."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids = row.column("ids")[0].values
            ids = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False))
            sizes = row.column("sizes")[0].values.to_numpy(zero_copy_only=False)
            data = np.frombuffer(unpacked(row.column("data")[0].as_py()), dtype=np.uint8)
            yield row, row.column("slice")[0].as_py(), ids, Texts(data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _known(runs: Runs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names of the slice's documents with an id, whether two doc_ids use them, and each run's name number (-1: none)."""
    real = ids[runs.row] != np.iinfo(np.int64).max
    names = np.unique(runs.name[real])
    at = np.searchsorted(names, runs.name)
    at = np.where(real, at, -1)
    lo = np.full(len(names), np.iinfo(np.int64).max)
    hi = np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(lo, at[real], ids[runs.row[real]])
    np.maximum.at(hi, at[real], ids[runs.row[real]])
    return names, hi > lo, at


def _bounds(names: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the sorted names."""
    r = _range_of(names, ranges)
    cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    return [(int(r[a]), int(a), int(b)) for a, b in zip(cut, np.append(cut[1:], len(r)), strict=True)]


def _send_names(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for _, number, ids, t in _opened(batches):
        names, _, _ = _known(Runs(t), ids)
        cut = _bounds(names, ranges)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in cut], pa.int64()), pa.array([number] * len(cut), pa.int64()), pa.array([names[a:b].tobytes() for _, a, b in cut], pa.binary())], names=["range", "slice", "blob"]
        )


def _answer_names(frame: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(b, dtype=np.uint64) for b in frame["blob"]]
    kinds, times = np.unique(np.concatenate(parts), return_counts=True)
    shared = kinds[times > 1]
    bits = [np.packbits(np.isin(p, shared, assume_unique=True)).tobytes() for p in parts]
    return pd.DataFrame({"slice": frame["slice"], "range": frame["range"], "blob": bits})


def _kinds(name: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct (name, digest), in order of the name, and each place's number among them."""
    order = _order([name, digest[:, 0], digest[:, 1]])
    new = np.ones(len(order), dtype=bool)
    for k in (name, digest[:, 0], digest[:, 1]):
        k = k[order]
        new[1:] &= k[1:] == k[:-1]
    new[1:] = ~new[1:]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _shared_runs(t: Texts, ids: np.ndarray, answers, ranges: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """The slice's runs under shared names, the number of each one's distinct context, and one run and the least doc_id of each context."""
    runs = Runs(t)
    names, shared, at = _known(runs, ids)
    got = {a["range"]: a["blob"] for a in answers or []}
    for r, a, b in _bounds(names, ranges):
        if r in got:
            shared[a:b] |= np.unpackbits(np.frombuffer(got[r], dtype=np.uint8), count=b - a).astype(bool)
    use = np.flatnonzero((at >= 0) & shared[np.maximum(at, 0)]) if len(names) else np.zeros(0, int)
    digest = t.digests(runs.start[use], runs.end[use] + LENGTH - 1)
    one, context = _kinds(runs.name[use], digest)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, context, ids[runs.row[use]])
    runs.start, runs.end, runs.row, runs.name = (x[use] for x in (runs.start, runs.end, runs.row, runs.name))
    return runs, context, one, least


def _send_contexts(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for row, number, ids, t in _opened(batches):
        runs, _, one, least = _shared_runs(t, ids, row.column("names")[0].as_py(), ranges)
        # contexts are ordered by name, so ranges are contiguous
        out = []
        for r, a, b in _bounds(runs.name[one], ranges):
            pick = one[a:b]
            text = b"".join(t.buf[s : e + LENGTH - 1].tobytes() for s, e in zip(runs.start[pick], runs.end[pick], strict=True))
            out.append((r, number, (runs.end[pick] - runs.start[pick]).astype(np.int32).tobytes(), least[a:b].tobytes(), packed(text)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["range", "slice", "counts", "least", "text"])


def _answer_contexts(frame: pd.DataFrame) -> pd.DataFrame:
    counts = [np.frombuffer(b, dtype=np.int32).astype(np.int64) for b in frame["counts"]]
    each = np.concatenate(counts)
    least = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in frame["least"]])
    buf = np.frombuffer(b"".join(map(unpacked, frame["text"])), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum(each + LENGTH - 1)])
    t = Texts(buf, off)
    one, same = _kinds(np.zeros(len(each), np.uint64), t.digests(off[:-1], off[1:]))
    lowest = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(lowest, same, least)
    # Suffixes of the distinct contexts that start a whole string.
    n = each[one]
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(one)), n)
    starts = off[one][owner] + np.arange(first[-1]) - first[owner]
    order, equal = deep_shallow(buf, starts)
    kind = np.cumsum(~equal) - 1
    best = np.full(kind[-1] + 1 if len(kind) else 0, np.iinfo(np.int64).max)
    np.minimum.at(best, kind, lowest[owner[order]])
    source = np.empty(len(starts), dtype=np.int64)
    source[order] = best[kind]
    # Run-length code per distinct context, then hand each slice those of its contexts.
    new = np.ones(len(source), dtype=bool)
    new[1:] = (source[1:] != source[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(source)))
    per = np.bincount(owner[head], minlength=len(one))
    begin = np.concatenate([[0], np.cumsum(per)])
    out, at = [], 0
    for c in counts:
        mine = same[at : at + len(c)]
        at += len(c)
        took = per[mine]
        idx = np.repeat(begin[mine], took) + np.arange(took.sum()) - np.repeat(np.cumsum(took) - took, took)
        out.append((length[idx].astype(np.int32).tobytes(), source[head][idx].tobytes()))
    return pd.DataFrame({"slice": frame["slice"], "range": frame["range"], "lengths": [o[0] for o in out], "sources": [o[1] for o in out]})


def _apply(batches: Iterator[pa.RecordBatch], ranges: int, texts_too: bool) -> Iterator[pa.RecordBatch]:
    for row, _, ids, t in _opened(batches):
        runs, context, one, _ = _shared_runs(t, ids, row.column("names")[0].as_py(), ranges)
        got = sorted(row.column("contexts")[0].as_py() or [], key=lambda a: a["range"])
        length = np.concatenate([np.frombuffer(a["lengths"], dtype=np.int32) for a in got] or [np.zeros(0, np.int32)]).astype(np.int64)
        source = np.concatenate([np.frombuffer(a["sources"], dtype=np.int64) for a in got] or [np.zeros(0, np.int64)])
        flat = np.repeat(source, length)  # the least doc_id of every string of every distinct context, in order
        size = runs.end - runs.start
        first = np.concatenate([[0], np.cumsum(size[one])])
        where = np.repeat(first[:-1][context], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(runs.start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        later = flat[where] < ids[np.repeat(runs.row, size)]
        cover = np.zeros(len(t.buf) + 1, dtype=np.int64)
        cover += np.bincount(at[later], minlength=len(cover))
        cover -= np.bincount(at[later] + LENGTH, minlength=len(cover))
        gone = np.cumsum(cover)[:-1] > 0
        start, _, span_row = t.spans(gone)
        spans, removed = t.per_row(span_row), np.add.reduceat(np.append(gone, False).astype(np.int64), t.off[:-1]) if t.rows else np.zeros(0, int)
        removed = np.where(np.diff(t.off) > 0, removed, 0)
        kept = [t.buf[a:b][~gone[a:b]].tobytes() for a, b in zip(t.off[:-1], t.off[1:], strict=True)]
        cols = [row.column("ids")[0].values, pa.array(np.diff(t.off)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if texts_too:
            cols.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def suffix_dedup(docs: DataFrame, with_texts: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``).

    A byte goes if a 50-byte string that covers it also starts in a document
    of smaller doc_id, judged on the input. Matches never cross documents; a
    null text counts as empty; rows of one doc_id do not remove each other's
    bytes; a row without doc_id neither removes nor loses any. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, ranges = max(shuffles, -(-total // BUCKET_BYTES)), max(shuffles, -(-total // (13 * RANGE_NAMES)))
    slices = bucketed(source.mapInArrow(_slices, "slice long, ids array<long>, sizes array<long>, data binary"), "slice", buckets, "slices")
    sent = slices.mapInArrow(partial(_send_names, ranges=ranges), "range long, slice long, blob binary")
    bits = sent.groupBy("range").applyInPandas(_answer_names, "slice long, range long, blob binary")
    bits = materialize(bits, "shared-names")
    per_slice = bits.groupBy(F.col("slice").alias("s1")).agg(F.collect_list(F.struct("range", "blob")).alias("names"))
    with_names = slices.join(per_slice.hint("shuffle_hash"), slices.slice == per_slice.s1, "left")
    contexts = with_names.select("slice", "ids", "sizes", "data", "names").mapInArrow(partial(_send_contexts, ranges=ranges), "range long, slice long, counts binary, least binary, text binary")
    answers = contexts.groupBy("range").applyInPandas(_answer_contexts, "slice long, range long, lengths binary, sources binary")
    answers = materialize(answers, "least-sources")
    per_slice2 = answers.groupBy(F.col("slice").alias("s2")).agg(F.collect_list(F.struct("range", "lengths", "sources")).alias("contexts"))
    both = with_names.join(per_slice2.hint("shuffle_hash"), F.col("slice") == F.col("s2"), "left").select("slice", "ids", "sizes", "data", "names", "contexts")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_texts else "")
    return both.mapInArrow(partial(_apply, ranges=ranges, texts_too=with_texts), schema)


#: The same in DuckDB: texts as hexadecimal digits, every 50-byte string with the smallest doc_id that has it.
ORACLE = rf"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, (2 * i + 1)::BIGINT, {2 * LENGTH})) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM g) WHERE lo < doc_id),
n AS (SELECT doc_id, i, CASE WHEN coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{LENGTH + 1}) + {LENGTH} < i THEN 1 ELSE 0 END AS new FROM r),
p AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n),
sp AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM p GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM sp GROUP BY doc_id),
c AS (SELECT k.doc_id, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
