"""Scans of many projects: one job over all of them, its summary, split scans, merged reports and the metrics export."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.operators import report
from simloom.plans import rules
from simloom.scratch import materialize
from simloom.sources import readers
from simloom.sources.program import tables_of

# Source files that are analysed, folders left out of the export, columns of the export by rule.
EXTENSIONS = ("ts", "ets")
EXPORT_EXCLUDED = r"(^|/)(ohosTest|test|node_modules|build|hvigorfile|oh_modules|\.preview)/"
SMELLS = {
    "long-method-check": "long_method", "feature-envy-check": "feature_envy", "switch-statement-check": "switch_statement",
    "code-clone-fragment-check": "code_clone_fragment", "code-clone-type1-check": "code_clone_type1", "code-clone-type2-check": "code_clone_type2",
}
SPLIT_MS = 120_000


def batch_scan(files: DataFrame, root: str, settings: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Issues of all projects below ``root`` with their ``project``, and the files with theirs.

    ``files``: file, content, error. ``settings`` maps the rules to run to their
    settings. Projects never meet in a rule that compares files: each file is
    compared within its own project's scan only where the rule says so, which
    is why project-level rules run on files named below their project.
    """
    placed = files.withColumn("project", readers.project_of(F.col("file"), root)).where("project <> ''")
    tables = tables_of(placed.where("error is null"))
    parts = [rules.run(tables, rule_id, own) for rule_id, own in settings.items()]
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    issues = report.distinct_issues(issues).withColumn("project", readers.project_of(F.col("file_path"), root))
    return materialize(issues, "scan-issues"), placed


def scan_summary(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Per project: files, files that failed, issues, and success (nothing failed)."""
    read = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    found = issues.groupBy("project").agg(F.count(F.lit(1)).alias("issues"))
    return read.join(found, "project", "left").select("project", "files", "failed", F.coalesce("issues", F.lit(0)).alias("issues"), (F.col("failed") == 0).alias("success"))


def outcome_counts(items: DataFrame) -> DataFrame:
    """``total, succeeded, failed`` of rows with ``success``."""
    ok = F.coalesce("success", F.lit(False))
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def with_splits(attempts: DataFrame, slow_ms: int = SPLIT_MS, max_depth: int | None = None) -> DataFrame:
    """Scan attempts (success, timed_out, duration_ms, depth, child_dirs) with ``split_reasons`` and ``split``.

    An attempt that timed out, failed or was slow is split if it has child
    folders and may go deeper; its children are scanned in its stead.
    """
    reason = lambda hit, name: F.when(F.coalesce(hit, F.lit(False)), F.lit(name))
    reasons = F.array_compact(F.array(reason(F.col("timed_out"), "timeout"), reason(~F.col("success"), "failed"), reason(F.col("duration_ms") > slow_ms, "slow")))
    deeper = F.lit(True) if max_depth is None else F.col("depth") < max_depth
    return attempts.withColumn("split_reasons", reasons).withColumn("split", deeper & (F.col("child_dirs") > 0) & (F.size("split_reasons") > 0))


def leaves(attempts: DataFrame) -> DataFrame:
    """Attempts that were not split; the issues of a split scan are the union of those of its successful leaves."""
    return attempts.where(~F.col("split"))


def merged_report(spark: SparkSession, out: str, arrays: list[str] = (), lines: list[str] = ()) -> int:
    """Write the issue reports of many scans as one bag of files; the number of issues.

    ``arrays`` are report files of one JSON array, ``lines`` reports as ``write_report`` makes them.
    """
    schema = f"filePath string, messages array<{MESSAGE}>"
    parts = [spark.read.schema(schema).json(list(p), multiLine=many) for p, many in ((arrays, True), (lines, False)) if p]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    both.write.mode("overwrite").json(out)
    return spark.read.schema(schema).json(out).agg(F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("n")).first().n


MESSAGE = "struct<line:int,column:int,endColumn:int,severity:int,rule:string,message:string,mergeKey:string>"


def write_report(issues: DataFrame, path: str) -> None:
    """Issues as report files: one object a source file, on a line of its own, with its messages."""
    message = F.struct("line", F.col("start_col").alias("column"), F.col("end_col").alias("endColumn"), "severity", F.col("rule_id").alias("rule"), F.col("description").alias("message"), report.merge_key().alias("mergeKey"))
    issues.groupBy(F.col("file_path").alias("filePath")).agg(F.array_sort(F.collect_list(message)).alias("messages")).write.mode("overwrite").json(path)


def export_rows(files: DataFrame, issues: DataFrame, root: str) -> DataFrame:
    """One row a project: files by extension, lines of code, issues by rule, lines of code an issue as text."""
    kept = files.where(~F.col("file").rlike(EXPORT_EXCLUDED)).withColumn("project", readers.project_of(F.col("file"), root))
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    loc = readers.code_lines(kept.where(ext.isin(*EXTENSIONS)))
    sizes = kept.join(loc, "file", "left").groupBy("project").agg(*[F.count_if(ext == e).alias(f"{e}_file_count") for e in EXTENSIONS], F.coalesce(F.sum("loc"), F.lit(0)).alias("code_lines"))
    counts = report.rule_columns(issues.select("project", F.col("rule_id").alias("rule")), SMELLS)
    wide = sizes.join(counts, "project", "left").na.fill(0)
    total = sum((F.col(c) for c in SMELLS.values()), F.lit(0))
    average = lambda n: report.average_text(F.col("code_lines"), n)
    out: list[Column] = [F.col("project"), *[F.col(f"{e}_file_count") for e in EXTENSIONS], sum((F.col(f"{e}_file_count") for e in EXTENSIONS), F.lit(0)).alias("file_count_total"), F.col("code_lines"), total.alias("smell_total"), average(total).alias("avg_loc_per_smell_total")]
    for c in SMELLS.values():
        out += [F.col(c).alias(f"{c}_count"), average(F.col(c)).alias(f"{c}_avg_loc_per_issue")]
    return wide.select(*out)
