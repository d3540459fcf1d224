"""Text normalisers and predicates as Column -> Column functions.

Word classes and boundaries are spelled out as ASCII, because Java's ``\\b``
and ``\\w`` treat accented letters differently from the semantics wanted here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of the language's \s, identifier syntax.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: A border between a word character and another, in ASCII.
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*(?![A-Za-z0-9_])"
# Keywords of the language, built-in names kept when identifiers are renamed.
KEYWORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with implements interface let package private "
    "protected public static yield abstract accessor as asserts assert any async await boolean constructor declare get infer intrinsic is "
    "keyof module namespace never out readonly require number object satisfies set string symbol type undefined unique unknown using from "
    "global bigint override of struct"
).split()
KEPT_NAMES = (
    "undefined NaN Infinity length push pop map filter forEach indexOf console log toFixed trim toString Array Object String Number Boolean "
    "Map Set Promise Date RegExp Error JSON Math"
).split()
KEPT = sorted({w.lower() for w in [*KEYWORDS, *KEPT_NAMES, *(f"parameter{i}" for i in range(10))]})
# Type names that never count as a foreign provider.
IGNORED_TYPES = (
    "string number boolean object array date math regexp json symbol bigint error promise record map set weakmap weakset null undefined void"
).split()


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_basic(c: Column) -> Column:
    """Collapse white space, trim, and blank out file, class and closure names."""
    steps = ((f"{SPACE}+", " "), (r"^ | $", ""), (r"(?i)@[^:\s]+\.[a-z]+:", "@FILE:"), (r"this: @FILE: [A-Za-z0-9_]+", "this: @FILE: CLASS"), (r"%AC[0-9]+", "%AC"))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def normalize_literals(c: Column) -> Column:
    steps = (
        (rf"(?<![A-Za-z0-9_])[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?{BORDER}", "NUM"), (r"(?<![A-Za-z0-9_])0x[0-9a-fA-F]+(?![A-Za-z0-9_])", "NUM"),
        ('"[^"]*"', "STR"), ("'[^']*'", "STR"),
    )
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def strip_types(c: Column) -> Column:
    typed = F.regexp_replace(c, rf":{SPACE}*[A-Za-z_][A-Za-z0-9_]*({SPACE}*<[^>]*>)?({SPACE}*\[\])*", "")
    return F.regexp_replace(typed, rf"(?<![A-Za-z0-9_])as(?![A-Za-z0-9_]){SPACE}+[A-Za-z_][A-Za-z0-9_]*", "")


def strip_decorators(c: Column) -> Column:
    return F.regexp_replace(c, rf"@[A-Za-z_][A-Za-z0-9_]*({SPACE}*\([^)]*\))?", "")


def rename_identifiers(c: Column, rename_single: bool = False) -> Column:
    """Identifiers become ID_1, ID_2, ... by first appearance; keywords, built-ins and ALL-CAPS words stay."""
    words, gaps = F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0)), F.split(c, IDENTIFIER, -1)
    stays = lambda w: F.lower(w).isin(KEPT) | ((F.length(w) <= 1) & F.lit(not rename_single)) | ((w == F.upper(w)) & (F.length(w) > 1))
    order = F.array_distinct(F.filter(words, lambda w: ~stays(w)))
    named = F.transform(words, lambda w: F.when(stays(w), w).otherwise(F.concat(F.lit("ID_"), F.array_position(order, w).cast("string"))))
    return F.array_join(F.zip_with(gaps, F.concat(named, F.array(F.lit(""))), lambda g, w: F.concat(g, w)), "")


def type1_text(stmts: Column, ignore_types: bool = False, ignore_decorators: bool = False) -> Column:
    """Content compared by exact matching: statements normalised and joined."""

    def one(s: Column) -> Column:
        s = normalize_basic(s)
        s = strip_types(s) if ignore_types else s
        return strip_decorators(s) if ignore_decorators else s

    return F.array_join(F.transform(stmts, one), "|")


def type2_text(stmts: Column, ignore_types: bool = False, ignore_decorators: bool = False, ignore_literals: bool = False) -> Column:
    """Content compared after renaming; numbering runs over all statements."""
    renamed = rename_identifiers(type1_text(stmts, ignore_types, ignore_decorators))
    return normalize_literals(renamed) if ignore_literals else renamed


def djb2(c: Column) -> Column:
    """31 h + unit over UTF-16 units with 32-bit wrap, as signed hexadecimal text."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    wrap = lambda h, u: F.pmod(h * 31 + F.conv(u, 16, 10).cast("long") + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    h = F.aggregate(units, F.lit(0).cast("long"), wrap)
    return F.concat(F.when(h < 0, F.lit("-")).otherwise(F.lit("")), F.lower(F.hex(F.abs(h))))


def base_name(c: Column) -> Column:
    last = F.element_at(F.split(c, r"[\\/]"), -1)
    return F.when(last == "", c).otherwise(last)


def is_log(c: Column) -> Column:
    """A statement that is nothing but a call of a logger."""
    return c.rlike(rf"(?is)^{SPACE}*(console|hilog|logger)\.[A-Za-z0-9_]+{SPACE}*\(.*\){SPACE}*$")


def code_line_count(code: Column, stmt_count: Column, has_body: Column) -> Column:
    """Lines that are neither blank nor a lone brace; statements where there is no text; 0 without a body."""
    lines = F.filter(F.transform(F.split(code, "\r?\n"), trimmed), lambda x: ~x.isin("", "{", "}"))
    return F.when(~has_body, 0).otherwise(F.coalesce(F.size(F.when(code != "", lines)).cast("int"), stmt_count, F.lit(0))).cast("long")


def distinct_parts(content: Column) -> Column:
    """Distinct parts of a content split at white space and bars."""
    return F.size(F.array_distinct(F.filter(F.split(content, rf"{SPACE}+|\|"), lambda x: x != ""))).cast("long")


def case_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?<![A-Za-z0-9_])(?:case|default)(?![A-Za-z0-9_])")).cast("long")


def contains_switch(c: Column) -> Column:
    return c.rlike(rf"(?<![A-Za-z0-9_])switch{SPACE}*\(")


def brace_delta(c: Column) -> Column:
    return (F.regexp_count(c, F.lit(r"\{")) - F.regexp_count(c, F.lit(r"\}"))).cast("long")


def union_parts(c: Column) -> Column:
    """Parts of a type union at the top level of <> and (), outer parentheses removed."""
    bare = unwrapped(c)

    def step(s: Column, ch: Column) -> Column:
        angle = s["angle"] + F.when(ch == "<", 1).when((ch == ">") & (s["angle"] > 0), -1).otherwise(0)
        paren = s["paren"] + F.when(ch == "(", 1).when((ch == ")") & (s["paren"] > 0), -1).otherwise(0)
        cut = (ch == "|") & (angle == 0) & (paren == 0)
        return F.struct(
            F.when(cut, F.concat(s["parts"], F.array(s["now"]))).otherwise(s["parts"]).alias("parts"),
            F.when(cut, F.lit("")).otherwise(F.concat(s["now"], ch)).alias("now"), angle.alias("angle"), paren.alias("paren"),
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"), F.lit(0).alias("angle"), F.lit(0).alias("paren"))
    parts = F.aggregate(F.split(bare, ""), start, step, lambda s: F.concat(s["parts"], F.array(s["now"])))
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def unwrapped(c: Column) -> Column:
    """A type name without the parentheses around it, however many."""

    def step(x: Column, _: Column) -> Column:
        return F.when(x.startswith("(") & x.endswith(")"), trimmed(x.substr(F.lit(2), F.length(x) - 2))).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(c)), trimmed(c), step)


def is_ignored_type(c: Column) -> Column:
    """Empty, unknown, synthetic or built-in types; a union counts if all its parts do."""
    one = lambda p: p.startswith("%") | (p == "unknown") | F.lower(p).isin(IGNORED_TYPES)
    parts = union_parts(c)
    return F.coalesce(c == "", F.lit(True)) | F.forall(F.transform(parts, unwrapped), one)


def type_name(class_name: Column, name: Column, text: Column) -> Column:
    """Class name of a type: of its signature, else its own name, else its text, else empty."""
    return F.coalesce(F.nullif(class_name, F.lit("")), F.nullif(name, F.lit("")), text, F.lit(""))


def offset_line(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and 0-based column of a character offset."""
    head = F.left(text, offset)
    lines = F.size(F.split(head, "\n"))
    return lines.cast("long"), F.length(F.element_at(F.split(head, "\n"), -1)).cast("long")


def words(c: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(c, r"[\x09-\x0D\x20]+"), lambda w: w != "")
