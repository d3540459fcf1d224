"""Benchmark decontamination by SimHash over item-sized windows.

A document window has as many words as the benchmark item it is held against.
Its fingerprint is the sign pattern of the sum of its five-word shingles' hash
bits. A multi-index cuts the 64 bits into ``BLOCKS`` blocks: fingerprints
within ``RADIUS`` bits differ by at most RADIUS // BLOCKS in some block, and
every item is filed under all block values that near, so one lookup a block
returns all items within the radius and few others. What the lookup returns
and lies within the radius is a candidate; candidates are verified exactly by
the weighted Jaccard similarity (shingle counts) of window and item.

Windows that share no shingle with any item of their size have similarity 0
with all of them, so leaving those out before fingerprinting is exact; all
other windows are fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.bytetext import as_row, row_columns, row_type, shingles, sliced, texts
from simloom.scratch import materialize

WIDTH = 5
#: Similarity 0.8 is about 9.7 of 64 bits apart, with a deviation of 2.9: a window of just that similarity is found with odds of 0.997.
RADIUS, BLOCKS = 17, 6
#: Items and their bytes in one broadcast; a larger benchmark is held against the documents in several passes.
ITEMS_A_PASS, BYTES_A_PASS = 5_000, 16 << 20

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: First bit and number of bits of each block.
_CUTS = [(64 * b // BLOCKS, 64 * (b + 1) // BLOCKS - 64 * b // BLOCKS) for b in range(BLOCKS)]


def fingerprints(counted: np.ndarray) -> np.ndarray:
    """Sign patterns of rows of 64 sums."""
    return ((counted > 0).astype(np.uint64) * _BITS).sum(axis=1, dtype=np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    return np.where(h[:, None] & _BITS, 1, -1).astype(np.int32)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two shingle multisets."""
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    least = np.minimum(ca[ia], cb[ib]).sum()
    union = len(a) + len(b) - least
    return float(least / union) if union else 0.0


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    first, bits = _CUTS[b]
    return ((prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Index:
    """Items by shingle and their fingerprints by block."""

    def __init__(self, ids: list[int], item_texts: list[str | None]) -> None:
        t = texts(pa.array(item_texts, pa.string())).lowered()
        start, end, row = t.words()
        h = t.hashes(start, end)
        n = t.per_row(row)
        first = np.concatenate([[0], np.cumsum(n)])
        self.items = []
        for i, item in enumerate(ids):
            if n[i]:
                own = h[first[i] : first[i + 1]]
                width = min(WIDTH, int(n[i]))
                s = shingles(own, np.zeros(len(own), np.int64), 1, width)[1]
                self.items.append((item, int(n[i]), width, s))
        pairs = sorted({(int(x), width, k) for k, (_, _, width, s) in enumerate(self.items) for x in s})
        self.widths = sorted({w for _, w, _ in pairs})
        self.by_width = {}
        for w in self.widths:
            keys = np.array([p[0] for p in pairs if p[1] == w], dtype=np.uint64)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.by_width[w] = keys, np.array([p[2] for p in pairs if p[1] == w]), seen
        self.words = np.array([x[1] for x in self.items], dtype=np.int64)
        self.prints = np.array([fingerprints(signs(s).sum(axis=0, keepdims=True))[0] for *_, s in self.items], dtype=np.uint64)
        #: lists[b] files every item under the values its block b is near: the items of value v stand from cut[v] to cut[v + 1].
        self.lists = []
        for b, (_, bits) in enumerate(_CUTS):
            values = np.arange(1 << bits, dtype=np.int64)
            near = [np.flatnonzero(np.bitwise_count(values ^ x) <= RADIUS // BLOCKS) for x in _block(self.prints, b)]
            value = np.concatenate([*near, np.zeros(0, np.int64)]).astype(np.int64)
            item = np.repeat(np.arange(len(near)), [len(x) for x in near])
            order = np.argsort(value, kind="stable")
            self.lists.append((np.searchsorted(value[order], np.arange((1 << bits) + 1)), item[order].astype(np.int32)))

    def within(self, prints: np.ndarray, words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Print, item and distance of all pairs within the radius (items of ``words`` words, if given), nearest first."""
        pairs = [np.zeros(0, np.int64)]
        for b, (cut, item) in enumerate(self.lists):
            value = _block(prints, b)
            many = cut[value + 1] - cut[value]
            at = np.repeat(cut[value] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            w, k = np.repeat(np.arange(len(prints)), many), item[at].astype(np.int64)
            if words is not None:
                fits = self.words[k] == words
                w, k = w[fits], k[fits]
            pairs.append(w * len(self.items) + k)
        w, k = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.items)))
        d = np.bitwise_count(prints[w] ^ self.prints[k]).astype(np.int64)
        order = np.argsort(d, kind="stable")
        order = order[d[order] <= RADIUS]
        return w[order], k[order], d[order]


def _matches(index: Index, h: np.ndarray, hits: list[tuple[int, int, int]], num: int, den: int) -> list[int]:
    """Items found in one document. h: its word hashes; hits: (place, width, item) of shared shingles."""
    found: set[int] = set()
    by_size: dict[tuple[int, int], list[int]] = {}
    for p, width, k in hits:
        by_size.setdefault((index.items[k][1], width), []).append(p)
    for (n, width), places in by_size.items():
        size = min(n, len(h))
        span = size - width + 1  # shingles in a window
        if span < 1:
            continue
        s = shingles(h, np.zeros(len(h), np.int64), 1, width)[1]
        reach = np.zeros(len(h) - size + 2, dtype=np.int64)
        p = np.array(places)
        np.add.at(reach, np.clip(p - span + 1, 0, len(reach) - 1), 1)
        np.add.at(reach, np.clip(p + 1, 0, len(reach) - 1), -1)
        starts = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
        for low in range(0, len(starts), 4096):
            some = starts[low : low + 4096]
            left, right = int(some[0]), int(some[-1]) + span
            if right - left > 8 * len(some) + span * 4:  # far apart: sum each window by itself
                sums = np.stack([signs(s[a : a + span]).sum(axis=0) for a in some])
            else:
                total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(s[left:right]), axis=0, dtype=np.int32)])
                sums = total[some - left + span] - total[some - left]
            w, k, _ = index.within(fingerprints(sums), n)
            for a, i in zip(some[w].tolist(), k.tolist(), strict=True):
                if i not in found and weighted_jaccard(s[a : a + span], index.items[i][3]) * den >= num:
                    found.add(i)
    return sorted(index.items[k][0] for k in found)


def _scan(batches: Iterator[pa.RecordBatch], packed, num: int, den: int) -> Iterator[pa.RecordBatch]:
    ids, item_texts = packed.value
    if getattr(_scan, "_have", (None,))[0] != packed.key:
        _scan._have = packed.key, Index(ids, item_texts)
    index = _scan._have[1]
    for part, t in sliced(batches, None):
        low = t.lowered()
        start, end, row = low.words()
        h = low.hashes(start, end)
        first = np.searchsorted(row, np.arange(t.rows + 1))
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for width in index.widths:
            if len(h) < width:
                continue
            keys, owners, seen = index.by_width[width]
            inside = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
            s = shingles(h, row, t.rows, width)[1][: len(inside)]
            maybe = np.flatnonzero(seen[(s & np.uint64(0xFFFF)).astype(np.int64)])
            a, b = np.searchsorted(keys, s[maybe]), np.searchsorted(keys, s[maybe], side="right")
            for m in np.flatnonzero(b > a):
                at = int(inside[maybe[m]])
                r = int(row[at])
                hits.setdefault(r, []).extend((at - int(first[r]), width, int(k)) for k in owners[a[m] : b[m]])
        out = [_matches(index, h[first[r] : first[r + 1]], hits[r], num, den) if r in hits else [] for r in range(t.rows)]
        cols = {"doc_id": part.column("row").field("doc_id")} if packed.ids_only else {"row": part.column("row")}
        if "before" in part.schema.names:
            cols["before"] = part.column("before")
        yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(out, pa.list_(pa.int64()))], names=[*cols, "items"])


class _Packed:
    """A broadcast of the items.

    Workers keep the last index by ``key``, a digest of the items: they outlive
    tasks, and an address or a broadcast's number can come again with other items.
    """

    def __init__(self, broadcast, ids_only: bool = False) -> None:
        self.broadcast, self.ids_only = broadcast, ids_only
        self.key = sha256(repr(broadcast.value).encode()).hexdigest()

    @property
    def value(self):
        return self.broadcast.value


def _passes(docs: DataFrame, benchmark: DataFrame, num: int, den: int, ids_only: bool) -> DataFrame:
    """``row`` (or only ``doc_id``) of every row of ``docs`` with ``items``, the list of the items found in it.

    Each pass takes a bounded part of the benchmark to the workers; between
    two passes the rows are written, so one part is held at a time.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    passes = max(1, -(-size.n // ITEMS_A_PASS), -(-size.b // BYTES_A_PASS))
    sc, out = docs.sparkSession.sparkContext, as_row(docs)
    row = row_type(out)
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()
        out = out.withColumnRenamed("items", "before") if p else out
        last = p == passes - 1
        shared = sc.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        kept = "doc_id long" if ids_only and last else f"row {row}"
        out = out.mapInArrow(partial(_scan, packed=_Packed(shared, ids_only and last), num=num, den=den), kept + (", before array<bigint>" if p else "") + ", items array<bigint>")
        out = out.withColumn("items", F.array_union("before", "items")).drop("before") if p else out
        if not last:
            out = materialize(out, "decontaminate-pass")
            shared.destroy()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs``: ``doc_id, contaminated, n_items, item_ids`` (sorted, comma-joined).

    An item is found when some window of the item's number of words (or the
    whole document, if it has fewer) has weighted shingle similarity of at
    least num/den with it. Items of fewer than five words count as one
    shingle and must stand verbatim. Null or wordless texts and items match
    nothing; items without item_id are ignored; an empty benchmark finds
    nothing, an empty table gives an empty result; every row gives a row.
    Whole texts are searched, however long. Other columns are ignored, what
    they are called included.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _passes(source, benchmark, num, den, ids_only=True)
    items = F.array_sort(F.array_distinct("items"))
    return out.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item is found; the same cases as ``contamination``."""
    return _passes(docs, benchmark, num, den, ids_only=False).where(F.size("items") == 0).select(*row_columns(docs.columns))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same in DuckDB: every window that shares a shingle with an item of its size, by weighted shingle counts.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS n, least({WIDTH}, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bg AS (SELECT item_id, n, k, g, count(*) AS c FROM (SELECT item_id, n, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM b)) GROUP BY ALL),
dg AS (SELECT doc_id, len, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, len(w) AS len, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
h AS (SELECT doc_id, len, item_id, n, k, i, least(n, len) - k + 1 AS span FROM dg JOIN bg USING (k, g)),
s AS (SELECT DISTINCT doc_id, item_id, n, k, span, unnest(range(greatest(1, i - span + 1)::BIGINT, least(i, len - least(n, len) + 1)::BIGINT + 1)) AS s FROM h),
m AS (SELECT s.doc_id, s.item_id, s.s, s.n, s.k, s.span, h.g, count(*) AS c FROM s JOIN (SELECT DISTINCT h.doc_id, h.item_id, h.i, dg.g FROM h JOIN dg USING (doc_id, k, i)) h ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.i BETWEEN s.s AND s.s + s.span - 1 GROUP BY ALL),
j AS (SELECT m.doc_id, m.item_id, m.s, m.n, m.k, m.span, sum(least(m.c, bg.c)) AS least FROM m JOIN bg ON bg.item_id = m.item_id AND bg.g = m.g GROUP BY ALL),
f AS (SELECT doc_id, item_id FROM j WHERE 100 * least >= 80 * (span + n - k + 1 - least) GROUP BY ALL)
SELECT d.doc_id, count(item_id) > 0 AS contaminated, count(item_id)::BIGINT AS n_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS item_ids FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""
