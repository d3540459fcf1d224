"""Intermediate tables that survive the loss of an executor.

``materialize`` cuts lineage by writing a Parquet table below the folder that
the cluster names in ``spark.checkpoint.dir`` (or ``setCheckpointDir``). Only
where neither is set and Spark runs in one local process (as in tests) does the
library choose a folder of its own. ``release`` deletes tables that nothing
reads any more, ``clear`` all that this application has written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, from the session's settings."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = sc._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(scratch_dir, "_own", None)
        if found is None:
            found = scratch_dir._own = tempfile.mkdtemp(prefix="simloom-")
    return f"{found.rstrip('/')}/simloom/{sc.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like ``materialize``, with the rows of each bucket of ``key`` in one file: joins on ``key`` leave them in place."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{table}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table))
    _TABLES.append(table)
    return spark.table(table)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            _delete(t.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver has collected their plans."""
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results not yet written elsewhere are lost."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    _delete(spark, scratch_dir(spark))
