"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements
and one failure bit a rule; a policy is a named, versioned set of bits, so
another policy, or the effect of leaving a rule out, costs integer operations
on the ledger and never another look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.bytetext import Texts, as_row, row_columns, row_type, shingles, sliced

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_digits", "n_bullet_lines")
#: Rule name -> failure test on the measurements; the position is the rule's bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 4 * n_lines",
    "capitals": "10 * n_capitals > 4 * n_letters",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "n_words > 0 and word_chars < 2 * n_words",
    "digits": "n_digits > n_letters",
    "bullets": "n_lines >= 4 and 10 * n_bullet_lines > 9 * n_lines",
}
BASE = ("few_words", "repeated_windows")
#: Bytes of text measured together; the arrays of places take some fifty times that.
MEASURED_BYTES = 1 << 18


@dataclass(frozen=True)
class Policy:
    """A version of the acceptance rule: documents failing any of ``rules`` go."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        order = list(RULES)
        return reduce(lambda m, r: m | 1 << order.index(r), self.rules, 0)


POLICIES = {
    "base": Policy("base", 1, BASE),
    "default": Policy("default", 1, ("few_words", "repeated_windows", "symbols", "repeated_lines", "capitals", "long_words")),
    "strict": Policy("strict", 1, tuple(RULES)),
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BULLETS = np.array([ord(c) for c in "-*+>"], dtype=np.uint8)


def _measure(t: Texts) -> dict[str, np.ndarray]:
    count_rows = lambda at: t.per_row(t.row_of(at))
    start, end, row = t.words()
    word_hash = t.hashes(start, end)
    chars = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
    word_chars = np.bincount(row, weights=chars[end] - chars[start], minlength=t.rows).astype(np.int64)

    l_start, l_end, l_row = t.lines()
    before = np.searchsorted(start, l_start), np.searchsorted(start, l_end)
    full = before[1] > before[0]
    bullets = t.per_row(l_row[full][np.isin(t.buf[start[before[0][full]]], _BULLETS)])
    l_row, l_hash = l_row[full], t.hashes(l_start[full], l_end[full])
    order = np.lexsort((l_hash, l_row))
    same = (l_row[order][1:] == l_row[order][:-1]) & (l_hash[order][1:] == l_hash[order][:-1])
    dup_lines = t.per_row(l_row[order][1:][same])

    repeated = np.zeros(len(row), dtype=bool)
    if len(row) >= 3:
        inside = np.flatnonzero(row[:-2] == row[2:])
        at_row, h = shingles(word_hash, row, t.rows, 3)
        h, at_row = h[: len(inside)], at_row[: len(inside)]  # shorter texts follow the windows
        order = np.lexsort((h, at_row))
        same = (at_row[order][1:] == at_row[order][:-1]) & (h[order][1:] == h[order][:-1])
        twice = np.zeros(len(inside), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            repeated[inside[twice] + j] = True
    capital = (t.buf >= 65) & (t.buf <= 90)
    letter = capital | ((t.buf >= 97) & (t.buf <= 122)) | (t.buf >= 0xC0)
    return {
        "n_words": t.per_row(row),
        "word_chars": word_chars,
        "n_symbols": count_rows(np.flatnonzero(_SYMBOL[t.buf])),
        "n_dup_lines": dup_lines,
        "n_repeat_words": t.per_row(row[repeated]),
        "n_lines": t.per_row(l_row),
        "n_letters": count_rows(np.flatnonzero(letter)),
        "n_capitals": count_rows(np.flatnonzero(capital)),
        "n_digits": count_rows(np.flatnonzero((t.buf >= 48) & (t.buf <= 57))),
        "n_bullet_lines": bullets,
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in sliced(batches, None, MEASURED_BYTES):
        found = _measure(t)
        yield pa.RecordBatch.from_arrays([part.column("row")] + [pa.array(found[m]) for m in MEASURES], names=["row", *MEASURES])


def _with_ledger(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), the measurements and ``failed_rules``: one pass, no shuffle or join."""
    rows = as_row(docs)
    measured = rows.mapInArrow(_measured, f"row {row_type(rows)}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(RULES.values())]
    return measured.withColumn("failed_rules", reduce(Column.bitwiseOR, bits).cast("int"))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``failed_rules`` with one bit a rule.

    One row per input row, whatever its doc_id (null included); a null text
    counts as empty and fails ``few_words``; whole texts are measured, however
    long; an empty table gives an empty ledger. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_ledger(source).select("row.doc_id", *MEASURES, "failed_rules")


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("failed_rules").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents only it rejects."""
    hit = F.col("failed_rules").bitwiseAND(F.lit(policy.mask))
    order = list(RULES)
    per_pattern = led.groupBy(hit.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** rules rows
    rules = led.sparkSession.createDataFrame([(r, 1 << order.index(r)) for r in policy.rules], "rule string, bit int")
    joined = per_pattern.join(F.broadcast(rules), F.col("bits").bitwiseAND(F.col("bit")) != 0, "right")
    return joined.groupBy("rule").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("failing"), F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this")
    )


def judged(docs: DataFrame, policy: Policy = POLICIES["default"]) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    return ledger(docs).withColumns({"base_failed": ~passes(POLICIES["base"]), "kept": passes(POLICIES["base"]) & passes(policy)})


def accepted(docs: DataFrame, policy: Policy = POLICIES["default"]) -> DataFrame:
    """The rows of ``docs``, all their columns whatever they are called, whose ledger row passes the policy."""
    return _with_ledger(docs).where(passes(policy)).select(*row_columns(docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup, count(*) AS n_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
wins AS (
  SELECT doc_id, i, ws[i:i+2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         len(regexp_extract_all(t, '[A-Za-z]|[^\x00-\x7F]'))::BIGINT AS n_letters, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR (n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines) OR 10 * n_capitals > 4 * n_letters OR word_chars > 15 * n_words) AS kept
FROM m
"""
