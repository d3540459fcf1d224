"""Substring dedup by content-defined chunking.

A gear hash of the last 16 bytes is rolled over each text; a byte whose hash
is the smallest within ``RADIUS`` bytes on either side ends a chunk, which
bounds how far chunks of varied text can stretch. Boundaries depend on nearby
content alone, so text inserted before or inside a passage moves only the
chunks it touches. Chunks
are compared by a 128-bit digest: the first occurrence (by doc_id, then place)
stays. Later ones go where adjacent repeated chunks make a run of at least
``min_run`` bytes, so single chance chunks leave clean texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.bytetext import Texts, as_row, mix64, row_columns, row_type, sliced
from simloom.scratch import materialize

#: A boundary's hash is the smallest this far around: chunks of about 33 bytes.
RADIUS = 16
#: Shorter runs of repeated chunks stay.
MIN_RUN = 64

_GEAR = (mix64(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(40)).astype(np.uint32)


def boundaries(t: Texts, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each chunk; empty texts have none."""
    n = len(t.buf)
    h = _GEAR[t.buf]
    for step in (1, 2, 4, 8):  # h becomes the sum of gear[b[i - j]] << j over the last 2 * step bytes
        older = np.zeros_like(h)
        older[step:] = h[:-step] if n > step else older[step:]
        h = h + (older << np.uint32(step))
    # A text's first bytes must not see the document before.
    for k in range(15):
        at = t.off[:-1] + k
        at = at[at < t.off[1:]]
        acc = np.zeros(len(at), dtype=np.uint32)
        for j in range(k + 1):
            acc += _GEAR[t.buf[at - j]] << np.uint32(j)
        h[at] = acc
    order = (mix64(h.astype(np.uint64)) >> np.uint64(33)).astype(np.uint32)
    # Texts stand apart by more than a radius of largest values.
    place = np.arange(n) + (radius + 1) * (t.row_of(np.arange(n)) + 1)
    wide = np.full(n + (radius + 1) * (t.rows + 1), 0xFFFFFFFF, dtype=np.uint32)
    wide[place] = order
    low, have = wide, 1
    while have * 2 <= radius:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < radius:
        low = np.minimum(low[: len(low) - (radius - have)], low[radius - have :])
    # low[i] is the smallest of wide[i : i + radius]; of equal hashes the first one is the boundary.
    cut = (order < low[place - radius]) & (order <= low[np.minimum(place + 1, len(low) - 1)]) if n else np.zeros(0, bool)
    ends = np.flatnonzero(cut) + 1
    ends = np.unique(np.concatenate([ends, t.off[1:][t.off[1:] > t.off[:-1]]]))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return starts, ends, t.row_of(starts)


def _row_keys(t: Texts) -> np.ndarray:
    return t.hashes(t.off[:-1], t.off[1:]).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in sliced(batches, "text"):
        start, end, row = boundaries(t)
        digest = t.digests(start, end)
        ids = part.column("doc_id").take(pa.array(row))
        cols = [ids, pa.array(_row_keys(t)[row]), pa.array((start - t.off[row]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row_key", "at", "size", "d1", "d2"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in sliced(batches, "text"):
        start, _, row = boundaries(t)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_row_keys(t)), pa.array(np.diff(t.off)), pa.array(t.per_row(row))], names=["doc_id", "row_key", "n_bytes", "n_chunks"])


def removed_runs(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, row_key, at, size`` of each run of repeated bytes to delete."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = source.where(F.col("doc_id").isNotNull()).mapInArrow(_chunks, "doc_id long, row_key long, at int, size int, d1 long, d2 long")
    first = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "at")).alias("f"), F.count(F.lit(1)).alias("c"))
    first = first.where("c > 1").select("d1", "d2", F.col("f.doc_id").alias("f_doc"), F.col("f.at").alias("f_at"))
    later = chunks.join(materialize(first, "repeated-chunks"), ["d1", "d2"]).where((F.col("doc_id") != F.col("f_doc")) | (F.col("at") != F.col("f_at")))
    order = Window.partitionBy("doc_id", "row_key").orderBy("at")
    runs = later.select("doc_id", "row_key", "at", "size").distinct()
    runs = runs.withColumn("new", (F.coalesce(F.lag(F.col("at") + F.col("size")).over(order), F.lit(-1)) != F.col("at")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "row_key", "run").agg(F.min("at").cast("long").alias("at"), F.sum("size").alias("size"))
    return runs.where(F.col("size") >= min_run).drop("run")


def chunk_dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_chunks, n_removed, n_spans, spans`` (start-end pairs, comma-joined).

    Rows of one doc_id with equal texts get equal results and do not delete
    each other's chunks at the same place. Null texts count as empty; a row
    without doc_id neither deletes nor loses anything; an empty table gives an
    empty result. Whole texts are cut, however long. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = source.mapInArrow(_sizes, "doc_id long, row_key long, n_bytes long, n_chunks long")
    runs = removed_runs(docs, min_run).groupBy("doc_id", "row_key").agg(F.sum("size").alias("n_removed"), F.count(F.lit(1)).alias("n_spans"), F.array_sort(F.collect_list(F.struct("at", "size"))).alias("r"))
    spans = F.array_join(F.transform("r", lambda x: F.concat_ws("-", x["at"].cast("string"), (x["at"] + x["size"]).cast("string"))), ",")
    out = sizes.join(runs, ["doc_id", "row_key"], "left")
    return out.select("doc_id", "n_bytes", "n_chunks", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce(spans, F.lit("")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("row").field("text"), batch.column("runs"), strict=True):
            b, cut, at = (text.as_py() or "").encode(), [], 0
            for r in runs.as_py() or []:
                cut.append(b[at : r["at"]])
                at = r["at"] + r["size"]
            out.append(b"".join([*cut, b[at:]]).decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "kept"])


def cleaned(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeated runs cut from their texts (a character split by a cut goes).

    All columns stay, whatever they are called; a text that loses nothing stays as it is.
    """
    rows = as_row(docs)
    row = row_type(rows)
    keyed = rows.mapInArrow(_keyed, f"row {row}, key long")
    runs = removed_runs(docs, min_run).groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("runs"))
    joined = keyed.join(runs, (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.col("key") == F.col("row_key")), "left")
    cut = joined.where("runs is not null").select("row", "runs").mapInArrow(_cut, f"row {row}, kept string")
    same = joined.where("runs is null").select("row", F.col("row.text").alias("kept"))
    return cut.unionByName(same).select(*row_columns(docs.columns, text=F.col("kept")))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in sliced(batches, None):
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_row_keys(t))], names=[*part.schema.names, "key"])
