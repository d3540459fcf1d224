"""The program model: source files as tables of methods, statements and fields.

``methods``: seq, file, class_name, class_kind, class_decorators, decorators,
method_name, start_line, start_col, end_line, has_body, has_view_tree, code.
``stmts``: method (a seq), file, idx, line, col, text, is_branch, calls,
end_line (of the method). ``fields``: file, class_name, name, type, seq. Any
front end may fill these tables; ``tables_of`` reads them from source texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.program import read_programs
from simloom.operators.order import numbered
from simloom.scratch import materialize


@dataclass(frozen=True)
class Tables:
    """What a rule reads; ``uses`` holds the statements of ``operators.envy`` where a front end resolves them."""

    files: DataFrame
    methods: DataFrame
    stmts: DataFrame
    fields: DataFrame
    uses: DataFrame | None = None


def flatten(programs: DataFrame) -> DataFrame:
    """One row a method of ``file, classes``, with its class and both positions."""
    classes = programs.select("file", F.posexplode("classes").alias("class_pos", "c"))
    methods = classes.select("file", "class_pos", "c.class_name", "c.class_kind", F.col("c.decorators").alias("class_decorators"), F.posexplode("c.methods").alias("method_pos", "m"))
    return methods.select("file", "class_pos", "class_name", "class_kind", "class_decorators", "method_pos", "m.*")


def end_lines(methods: DataFrame, stmts: DataFrame) -> DataFrame:
    """``methods`` (seq, start_line) with ``end_line``: the last line on which a statement starts, or the first line."""
    last = stmts.groupBy(F.col("method").alias("__m")).agg(F.max("line").alias("__last"))
    joined = methods.join(last, F.col("seq") == F.col("__m"), "left")
    return joined.withColumn("end_line", F.greatest("start_line", F.coalesce("__last", F.col("start_line")))).drop("__m", "__last")


def build_methods(methods: DataFrame) -> DataFrame:
    """``build`` of structs and all builders, as a bag: a builder called build comes twice and is one issue by its merge key."""
    return methods.where("class_kind = 'STRUCT' and method_name = 'build'").unionByName(methods.where(F.array_contains("decorators", "Builder")))


def tables_of(files: DataFrame) -> Tables:
    """Tables of source files (``file, content``), methods numbered by file, class and place."""
    programs = materialize(read_programs(files), "programs")
    flat = numbered(flatten(programs), "seq", "file", "class_pos", "method_pos")
    flat = materialize(flat, "methods")
    stmts = flat.select(F.col("seq").alias("method"), "file", F.explode("stmts").alias("s")).select("method", "file", "s.*")
    methods = end_lines(flat.drop("stmts", "class_pos", "method_pos"), stmts).withColumn("has_view_tree", F.lit(False))
    stmts = stmts.join(methods.select(F.col("seq").alias("method"), "end_line"), "method")
    fields = programs.select("file", F.explode("classes").alias("c")).select("file", "c.class_name", F.posexplode("c.fields").alias("seq", "f")).select("file", "class_name", "seq", "f.name", "f.type")
    return Tables(files.select("file", "content"), materialize(methods, "methods-placed"), materialize(stmts, "stmts"), fields)
