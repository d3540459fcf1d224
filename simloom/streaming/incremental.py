"""Incremental duplicate detection over a stream of documents.

Each micro-batch is joined with the digests seen before and appended to them;
replays of a batch are harmless, because digests are written per batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from simloom.functions import text as T


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(T.normalize_basic(F.col("text")), 256).alias("digest"))


def duplicate_stream(docs: DataFrame, store: str, out: str) -> DataStreamWriter:
    """Writer that files ``doc_id, first_id`` of repeated documents under ``out``."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        digests(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store}/batch={number}")
        seen = spark.read.schema("doc_id long, digest string, batch long").parquet(store).where(F.col("batch") <= number)
        first = seen.groupBy("digest").agg(F.min(F.struct("batch", "doc_id")).alias("f")).select("digest", F.col("f.doc_id").alias("first_id"))
        hits = seen.where(F.col("batch") == number).join(first, "digest").where(F.col("doc_id") != F.col("first_id"))
        hits.select("doc_id", "first_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch)
