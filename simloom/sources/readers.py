"""Sources and sinks: files, issue reports, listings, CSV, and the model view of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions import text as T

REPORT_SCHEMA = "filePath string, messages array<struct<rule:string>>"
# Folders of dependencies and tools that are not analysed.
SKIPPED_DIRS = ("node_modules", "oh_modules")


def source_files(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """``file, content, error`` of whole files as UTF-8; expected files that were not read carry an error."""
    read = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))
    if expected is None:
        return read
    missing = expected.join(read, "file", "left_anti").select("file", F.lit(None).cast("string").alias("content"), F.lit("not read").alias("error"))
    return read.unionByName(missing)


def diagnostics(files: DataFrame) -> DataFrame:
    """Read failures per phase."""
    return files.where("error is not null").groupBy(F.lit("read").alias("phase")).agg(F.count(F.lit(1)).alias("failed"))


def issue_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Issue reports of any number of scans as one bag: ``filePath, rule``."""
    raw = spark.read.schema(REPORT_SCHEMA).json(list(paths), multiLine=True)
    return raw.select("filePath", F.explode("messages.rule").alias("rule"))


def child_dirs(names: DataFrame, hidden: bool = False, include: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Project folders by ``name``: no dependency folders, no hidden ones unless asked, sorted."""
    kept = names.where(~F.col("name").isin(*SKIPPED_DIRS))
    kept = kept if hidden else kept.where(~F.col("name").startswith("."))
    kept = kept.where(F.col("name").isin(include)) if include else kept
    kept = kept.orderBy("name")
    return kept.limit(limit) if limit else kept


def with_report(dirs: DataFrame, files: DataFrame, report: str = "issuesReport.json") -> DataFrame:
    """Folders (``dir``) in which the report file exists."""
    return dirs.join(files.where(T.base_name(F.col("file")) == report).select(F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("dir")), "dir", "left_semi")


def project_of(path: Column, root: str) -> Column:
    """First path part below ``root``; empty where the path lies elsewhere."""
    base = root.rstrip("/").replace("\\", "\\\\")
    return F.regexp_extract(path, rf"^\Q{base}\E/([^/]+)", 1)


def code_lines(files: DataFrame) -> DataFrame:
    """Lines of code per file: neither blank nor only a comment."""
    lines = F.split(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), "\r?\n")
    code = F.filter(lines, lambda x: ~x.rlike(rf"^{T.SPACE}*(//.*)?$"))
    return files.select("file", F.size(code).cast("long").alias("loc"))


def count_by_extension(files: DataFrame, extensions: list[str], excluded: str = r"(^|/)(node_modules|oh_modules|build)/") -> DataFrame:
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(~F.col("file").rlike(excluded)).groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files")).where(F.col("extension").isin(extensions))


def write_csv(df: DataFrame, path: str) -> None:
    """Report rows as one CSV with a header; reports are small by nature."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# The model over the test tables: a document is a file, its non-blank lines are statements.


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, file, project, stmts, content``: one method a document."""
    stmts = F.filter(F.split("text", "\n"), lambda x: T.trimmed(x) != "")
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("project"), "lang", "text", stmts.alias("stmts"))
    return d.withColumn("content", T.type1_text(F.col("stmts")))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, tokens``: whitespace-separated words of each document."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), T.words(F.col("text")).alias("tokens"))
