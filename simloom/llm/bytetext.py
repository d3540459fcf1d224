"""Vectorised byte-level text primitives shared by the operators.

An Arrow string column is viewed as one UTF-8 byte buffer with offsets; words,
lines and their hashes come from whole-buffer numpy operations, so no Python
code runs per word. A null text counts as the empty text. Batches are cut into
slices of a few megabytes (never inside a document), so memory is bounded by
the slice size or by the longest single document.

Hashes mix eight bytes a round by a bijection, so no two ranges that differ in
one round are equal, and no algebraic structure of a text (such as a Thue-Morse
sequence, which polynomials modulo 2 ** 64 cannot tell apart) makes them so.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
#: Longer ranges are hashed one by one, shorter ones eight bytes of all of them at a time.
SHORT = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end. A view of its own copy of the bytes."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", buffer=padded, strides=(1,))


class Texts:
    """A slice of documents: ``buf`` bytes, ``off`` row offsets (rows + 1)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        self.buf, self.off, self.rows = buf, off, len(off) - 1
        self._eights = None

    def lowered(self) -> Texts:
        """A-Z to a-z, everything else untouched."""
        return Texts(_LOWER[self.buf], self.off)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, side="right") - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each maximal run of bytes with ``inside``; runs end with their document."""
        edge = np.empty(len(inside) + 1, dtype=bool)
        edge[0], edge[-1] = True, True
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[self.off] = True
        cut = np.flatnonzero(edge)
        if len(cut) < 2:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        start, end = cut[:-1], cut[1:]
        keep = inside[start]
        start, end = start[keep], end[keep]
        return start, end, self.row_of(start)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than 0x20 and 0x09-0x0D."""
        return self.spans(~_SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each line between newlines; every document has at least one."""
        nl = np.flatnonzero(self.buf == 10)
        start = np.concatenate([self.off[:-1], nl + 1])
        end_row = np.concatenate([np.arange(self.rows), self.row_of(nl)]) if len(nl) else np.arange(self.rows)
        order = np.lexsort((start, end_row))
        start, row = start[order], end_row[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
        end[last] = self.off[row[last] + 1]
        return start, end, row

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; equal bytes give equal hashes anywhere."""
        if self._eights is None:
            self._eights = eights(self.buf)
        size = end - start
        h = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        long = np.flatnonzero(size > SHORT)
        at = np.flatnonzero((size > 0) & (size <= SHORT)) if len(long) else None
        left = size if at is None else size[at]
        place, some = (start, h) if at is None else (start[at], h[at])
        live, done = np.arange(len(left)), 0
        while len(live):
            rest = left[live] - done
            x = self._eights[place[live] + done] & _FIRST[np.clip(rest, 0, 8)]
            some[live] = mix64(some[live] ^ x)
            done += 8
            live = live[rest > 8]
        if at is not None:
            h[at] = some
            data = memoryview(np.ascontiguousarray(self.buf))
            one = xxhash.xxh3_64_intdigest
            h[long] = np.array([one(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], dtype=np.uint64)
        return h

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128-bit digest of each byte range as two numbers."""
        data, one = memoryview(np.ascontiguousarray(self.buf)), xxhash.xxh3_128_digest
        joined = b"".join([one(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return np.frombuffer(joined, dtype=np.int64).reshape(-1, 2)

    def per_row(self, row: np.ndarray) -> np.ndarray:
        return np.bincount(row, minlength=self.rows).astype(np.int64)


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """View a string or binary column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return Texts(buf, off - off[0])


def as_row(df: DataFrame) -> DataFrame:
    """All columns in one, ``row``, so that no name of theirs meets one of an operator's; its text is a string."""
    own = {"text": "string"} if "text" in df.columns and dict(df.dtypes)["text"] != "string" else {}
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    return df.select(F.struct(*[c.cast(own[n]).alias(n) if n in own else c for n, c in zip(df.columns, columns, strict=True)]).alias("row"))


def row_type(rows: DataFrame) -> str:
    """The type of ``row`` for results that carry it."""
    fields = rows.schema["row"].dataType.fields
    return "struct<" + ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in fields) + ">"


def row_columns(columns: list[str], **instead: Column) -> list[Column]:
    """The columns of ``row`` again, some replaced."""
    return [instead[c].alias(c) if c in instead else F.col("row").getField(c).alias(c) for c in columns]


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], text: str | None, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches into runs of rows with about ``limit`` bytes of the column ``text`` (None: the text of ``row``), each with its byte view."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("row").field("text") if text is None else batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at), texts(column.slice(at, to - at))
            at = to
    give_back()


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every ``width``-word shingle; a shorter word sequence counts as one shingle."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    n = len(h)
    out_h, out_r = [], []
    if n >= width:
        acc = np.zeros(n - width + 1, dtype=np.uint64)
        for j in range(width):
            acc = (acc ^ h[j : n - width + 1 + j]) * np.uint64(0x9FB21C651E98DF25)
            acc ^= acc >> np.uint64(29)
        same = row[: n - width + 1] == row[width - 1 :]
        out_h.append(mix64(acc[same]))
        out_r.append(row[: n - width + 1][same])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        acc = np.full(len(short), 0x5851F42D4C957F2D, dtype=np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            acc[has] = mix64(acc[has] * np.uint64(31) + h[first[short[has]] + j])
        out_h.append(acc)
        out_r.append(short)
    if not out_h:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_r), np.concatenate(out_h)


def distinct_sorted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, by row and then by hash as signed numbers."""
    v = h.view(np.int64)
    order = np.lexsort((v, row))
    row, v = row[order], v[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
    return row[keep], v[keep]


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Int64 lists of the given lengths."""
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=pa.int64()))


def packed(data: bytes) -> bytes:
    """Compressed bytes for a shuffle or a table."""
    return zstandard.compress(data, 3)


def unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)
