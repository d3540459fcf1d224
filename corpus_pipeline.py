"""Training-corpus pipeline: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read back as the next stage's ``docs``. All but the
last return the columns of ``documents``, further columns of any name included.
Null and empty texts have no words and go with the quality rules, as do rows
whose text fails them; a row without doc_id is never a copy of another and
removes no lines; rows repeated with one doc_id and text are treated alike, so
they stay or go together; empty tables give empty results. Texts are read
whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import bpe, decontaminate, line_dedup, minhash, quality
from simloom.llm.bytetext import as_row, row_columns
from simloom.scratch import materialize

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ledger row fails the default policy go."""
    return quality.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines, and single long lines, that stand at an earlier place are cut; documents left without a word go."""
    out = line_dedup.cleaned(docs, long_lines=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each near-duplicate group stays."""
    kept = minhash.near_duplicates(docs, width=5, num=80, den=100).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = as_row(docs)
    found = rows.join(kept, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left_semi")
    return found.union(rows.where("row.doc_id is null")).select(*row_columns(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("bpe", tokenized),
]
#: Token ids and connected components have no SQL form; the stages are held against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
