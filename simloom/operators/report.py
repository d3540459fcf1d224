"""Issue rows, their texts and keys, and summaries by rule and project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.text import base_name

ISSUE_SCHEMA = (
    "line int, start_col int, end_col int, description string, severity int, rule_id string, file_path string, rule_doc_path string, "
    "disabled boolean, checked boolean, fixable boolean, method_name string, show_ignore_icon boolean"
)
DEFAULTS = {"disabled": True, "checked": False, "fixable": False, "show_ignore_icon": True}


def issues(df: DataFrame, **columns: Column) -> DataFrame:
    """Issue rows with defaults for what is not given."""
    names = [f.split()[0] for f in ISSUE_SCHEMA.split(", ")]
    types = dict(f.split() for f in ISSUE_SCHEMA.split(", "))
    value = lambda n: columns.get(n, F.lit(DEFAULTS.get(n)))
    return df.select(*[value(n).cast(types[n]).alias(n) for n in names])


def fix_key() -> Column:
    return F.concat_ws("%", "line", "start_col", "end_col", "rule_id")


def merge_key() -> Column:
    return F.concat_ws("%", F.concat(F.col("file_path"), fix_key()), "description")


def distinct_issues(df: DataFrame) -> DataFrame:
    """One row per merge key."""
    return df.withColumn("merge_key", merge_key()).dropDuplicates(["merge_key"]).drop("merge_key")


def with_severity(df: DataFrame, override: Column, alert: Column, default: int) -> DataFrame:
    return df.withColumn("severity", F.coalesce(override, alert, F.lit(default)).cast("int"))


def js_round(x: Column) -> Column:
    """Nearest whole number, halves upwards (also below zero)."""
    return F.floor(x + 0.5)


def to_fixed(x: Column, digits: int = 2, even: bool = False) -> Column:
    """Fixed digits; halves go away from zero by the exact binary value, not by its shortest decimal text (1.005 is 1.00).

    With ``even``, exact halves go to the even digit, as C's printf writes them (0.125 is 0.12).
    """
    x, scale = F.abs(x), float(10**digits)
    n = F.floor(x * scale + 0.5)
    # x * 2 * scale = p + e exactly, so the sign of r tells whether n - 0.5 <= x * scale.
    big = x * 134217729.0
    high = big - (big - x)
    p = x * (2 * scale)
    r = (p - (n * 2 - 1)) + ((high * (2 * scale) - p) + (x - high) * (2 * scale))
    low = (r < 0) | ((r == 0) & (n % 2 == 1)) if even else r < 0
    n = F.when(low, n - 1).when(r >= 2, n + 1).otherwise(n).cast("long")
    whole = F.concat(F.floor(n / F.lit(10**digits)).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0"))
    return whole


def signed_fixed(x: Column, digits: int = 2) -> Column:
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), to_fixed(x, digits))


def safe_name(name: Column) -> Column:
    """A name fit for files: everything but letters, digits, dot, underscore and hyphen becomes an underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def clone_kind(normalize_identifiers: bool, normalize_literals: bool) -> str:
    return "Type-2" if normalize_identifiers or normalize_literals else "Type-1"


def location_text(file: Column, cls: Column, method: Column, start: Column, end: Column, full: bool = False) -> Column:
    path = file if full else base_name(file)
    span = F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    named = F.when(cls.isNotNull() & method.isNotNull(), F.concat(F.lit(" > "), cls, F.lit("."), method, F.lit("()"))).when(cls.isNotNull(), F.concat(F.lit(" > "), cls)).otherwise("")
    return F.concat(path, named, span)


# The texts of the issues below.
FOR_EACH_TEXT = "For performance purposes, set keyGenerator for ForEach."


def fragment_text(kind: Column, scope: Column, left: Column, right: Column, tokens: Column, lines: Column, similarity: Column | None = None) -> Column:
    pct = F.lit("") if similarity is None else F.when(similarity < 1, F.concat(F.lit(", "), js_round(similarity * 100).cast("string"), F.lit("% similar"))).otherwise("")
    return F.concat(
        F.lit("Code Clone "), kind, F.lit(" ("), scope, F.lit("): "), left, F.lit(" is similar to "), right, F.lit(". ("),
        tokens.cast("string"), F.lit(" tokens, "), lines.cast("string"), F.lit(" lines"), pct, F.lit(")"),
    )


def method_text(kind: str, name: Column, start: Column, end: Column, cls2: Column, name2: Column, file2: Column, start2: Column, end2: Column, stmts: Column, similarity: Column | None = None) -> Column:
    """Text of a duplicate-method issue; only Type-2 tells similarity and renaming."""
    anchor = F.format_string("Method '%s' (lines %d-%d)", name, start, end)
    target = F.format_string("'%s.%s' in %s:%d-%d", cls2, name2, file2 if kind == "Type-2" else base_name(file2), start2, end2)
    if kind == "Type-1":
        return F.format_string("Code Clone Type-1: %s is identical to %s. (%d statements)", anchor, target, stmts)
    same = F.format_string("Code Clone Type-2: %s is structurally identical to %s. (%d statements, renamed identifiers)", anchor, target, stmts)
    if similarity is None:
        return same
    near = F.format_string("Code Clone Type-2: %s is similar to %s. (%d statements, %d%% similar)", anchor, target, stmts, js_round(similarity * 100))
    return F.when(similarity < 1, near).otherwise(same)


def rule_columns(df: DataFrame, columns: dict[str, str], count: Column | None = None) -> DataFrame:
    """Issues per ``project`` in the columns that ``columns`` gives rules; other rules are dropped. ``count`` adds up rows that stand for several."""
    names = list(dict.fromkeys(columns.values()))
    mapped = df.replace(columns, subset=["rule"]).where(F.col("rule").isin(names))
    return mapped.groupBy("project").pivot("rule", names).agg(F.count(F.lit(1)) if count is None else count).na.fill(0)


def rule_matrix(df: DataFrame, projects: list[str], count: Column | None = None) -> DataFrame:
    """Rules by projects with a total, in order of rule."""
    wide = df.where(F.col("project").isin(projects)).groupBy("rule").pivot("project", projects).agg(F.count(F.lit(1)) if count is None else count).na.fill(0)
    return wide.withColumn("total", sum((F.col(f"`{p}`") for p in projects), F.lit(0))).orderBy("rule")


def average_text(loc: Column, count: Column) -> Column:
    return F.when(count > 0, F.format_string("%.2f", loc / count)).otherwise("")


def long_method_text(name: Column, lines: Column, limit: Column) -> Column:
    return F.format_string("Method '%s' is too long. Consider refactoring. (Current: %d lines, Max: %d)", name, lines, limit)


def switch_text(cases: Column, name: Column, summary: Column) -> Column:
    return F.format_string("Switch statement with %d cases detected in method '%s'. Consider using polymorphism or strategy. Case line counts: %s.", cases, name, summary)


def chain_text(branches: Column, name: Column) -> Column:
    return F.format_string("Long if-else chain with %d branches detected in method '%s'. Consider using polymorphism or strategy.", branches, name)


def envy_text(name: Column, provider: Column, atfd: Column, lda: Column, cpfd: Column, even: bool = False) -> Column:
    return F.format_string("Method '%s' is feature-envious toward '%s' (ATFD=%d, LDA=%s, CPFD=%d). Consider moving logic or introducing delegation.", name, provider, atfd, to_fixed(lda, even=even), cpfd)


def class_text(kind: str, number: Column, size: Column, members: Column, scope: Column | None = None) -> Column:
    """Text of a clone class; fragments also tell their scope."""
    head = F.lit(f"Code Clone {kind} ") if scope is None else F.concat(F.lit(f"Code Clone {kind} ("), scope, F.lit(") "))
    return F.concat(head, F.format_string("[Class #%d, %d members]: ", number, size), members, F.lit("."))


def member_text(cls: Column, method: Column, file: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s.%s() in %s:%d-%d", cls, method, base_name(file), start, end)
