"""A lexer for the analysed language as one regular expression, and token filters.

Follows the public scanner contract without re-scans: ``>`` is always a token
of its own, ``/`` never starts a regular expression, and text after a
template's ``${`` is lexed as code. Comments and kinds outside the three sets
are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.text import KEYWORDS

# Operators and punctuation that count; longer unknown ones vanish whole.
OPERATORS = "=== !== ... == != => ** ++ -- <= += -= *= /= %= && || ?? ?. + - * / % < > = & | ^ ~ ! ? .".split()
PUNCTUATION = "( ) { } [ ] ; : ,".split()
UNKNOWN = ["<<=", "<<", "**=", "&&=", "||=", "??=", "&=", "|=", "^="]
TOKEN_TYPE = "array<struct<value:string,type:string,line:int,column:int>>"

_ops = "|".join(re.escape(o) for o in sorted([*OPERATORS, *UNKNOWN, *PUNCTUATION], key=len, reverse=True))
_MASTER = re.compile(
    r"(?P<comment>//[^\n\r]*|/\*.*?(?:\*/|\Z))|(?P<space>\s+)"
    r"|(?P<string>\"(?:\\.|[^\"\\\n\r])*\"?|'(?:\\.|[^'\\\n\r])*'?|`(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{|\Z))"
    r"|(?P<number>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?)"
    r"|(?P<private>\#[^\W\d][\w$]*)|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<at>@)|(?P<op>" + _ops + r")|(?P<other>.)",
    re.S,
)
_NAMES = dict.fromkeys(KEYWORDS, "KEYWORD") | dict.fromkeys(("true", "false", "null"), "LITERAL")
_OPS = dict.fromkeys(OPERATORS, "OPERATOR") | dict.fromkeys(PUNCTUATION, "PUNCTUATION") | dict.fromkeys(UNKNOWN)
#: The same with whole templates, whose ``${...}`` may hold braces one level deep: for readers that match brackets.
_WHOLE = re.compile(_MASTER.pattern.replace(r"`(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{|\Z)", r"`(?:\\.|\$\{(?:[^{}`]|\{[^{}`]*\}|`[^`]*`)*\}|[^`\\])*(?:`|\Z)"), re.S)


def scan(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, offset) of everything in a text, white space, comments and whole templates included."""
    return [(m.lastgroup, m[0], m.start()) for m in _WHOLE.finditer(text)]


def is_kind(token_type: Column, *kinds: str) -> Column:
    """Whether a token's type is one of ``kinds`` (KEYWORD, IDENTIFIER, LITERAL, ...)."""
    return token_type.isin(*kinds)


def lexed(text: str | None, rename: bool = False, literals: bool = False, rename_single: bool = False) -> Iterator[tuple[str, str, int, int]]:
    """(value, type, line from 1, column from 0) of each token, one at a time."""
    names: dict[str, str] = {}
    line, begin = 1, 0
    for m in _MASTER.finditer(text or ""):
        kind, value, start = m.lastgroup, m[0], m.start()
        if kind == "name":
            of = _NAMES.get(value)
            if of is None:
                if rename and (rename_single or len(value) > 1):
                    value = names.setdefault(value, f"ID_{len(names)}")
                yield value, "IDENTIFIER", line, start - begin
            elif literals and of == "LITERAL":
                yield "NULL" if value == "null" else "BOOL", of, line, start - begin
            else:
                yield value, of, line, start - begin
        elif kind == "op":
            if of := _OPS.get(value):
                yield value, of, line, start - begin
        elif kind == "number":
            yield "NUM" if literals else value, "LITERAL", line, start - begin
        elif kind == "at":
            yield value, "DECORATOR", line, start - begin
        elif kind in ("space", "string", "comment"):  # only these hold line breaks
            if kind == "string":
                yield "STR" if literals else value, "LITERAL", line, start - begin
            if "\n" in value:
                line, begin = line + value.count("\n"), start + value.rindex("\n") + 1


def tokenize(
    text: str | None, rename: bool = False, literals: bool = False, rename_single: bool = False, drop_types: bool = False, drop_decorators: bool = False
) -> list[tuple[str, str, int, int]]:
    """The tokens of a text as a list, without decorators and types if so asked."""
    out = list(lexed(text, rename, literals, rename_single))
    out = without_decorators(out) if drop_decorators else out
    return without_types(out) if drop_types else out


def without_decorators(tokens: list) -> list:
    """Tokens without ``@name(...)``."""
    kept, depth, state = [], 0, "code"
    for t in tokens:
        if state == "name":
            state = "args"
            if t[1] == "IDENTIFIER":
                continue
        if state == "args":
            if t[:2] == ("(", "PUNCTUATION"):
                state, depth = "inside", 1
                continue
            state = "code"
        if state == "inside":
            if t[1] == "PUNCTUATION" and t[0] in "()":
                depth += 1 if t[0] == "(" else -1
                state = "inside" if depth else "code"
            continue
        if t[1] == "DECORATOR":
            state = "name"
        else:
            kept.append(t)
    return kept


def without_types(tokens: list) -> list:
    """Tokens without what follows ``:`` or ``as`` up to the end of the annotation."""
    kept, skipping, depth = [], False, 0
    for t in tokens:
        if skipping:
            if t[:2] == ("<", "OPERATOR"):
                depth += 1
                continue
            if t[:2] == (">", "OPERATOR") and depth:
                depth -= 1
                continue
            ends = t[1] == "OPERATOR" and t[0] in ("=", "=>", ">") or t[1] == "PUNCTUATION" and t[0] in (",", ")", "{", ";", "(")
            if depth or not ends:
                continue
            skipping = False
        if t[:2] == (":", "PUNCTUATION") or t[:2] == ("as", "KEYWORD"):
            skipping, depth = True, 0
        else:
            kept.append(t)
    return kept


def with_tokens(df: DataFrame, text: str = "content", **options: bool) -> DataFrame:
    """``df`` with its ``tokens``, lexed in Arrow batches."""

    @F.pandas_udf(TOKEN_TYPE)
    def lex(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("value", "type", "line", "column"), x, strict=True)) for x in tokenize(t, **options)])

    return df.withColumn("tokens", lex(text))


#: Tokens that leave a worker at once.
_AT_ONCE = 1 << 15
_ROW = {"value": pa.string(), "type": pa.string(), "line": pa.int32(), "column": pa.int32()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, files, spans, rows = batch.schema.field("file").type, [], [], []

        def made() -> pa.RecordBatch:
            pos = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in spans])
            file = pa.array(files, kind).take(pa.array(np.repeat(np.arange(len(files)), [b - a for a, b in spans])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW.values(), strict=True)]
            return pa.RecordBatch.from_arrays([file, pa.array(pos), *columns], names=["file", "pos", *_ROW])

        for i in range(batch.num_rows):
            tokens, at = lexed(batch.column("content")[i].as_py()), 0
            while True:
                had = len(rows)
                rows.extend(islice(tokens, _AT_ONCE - had))
                if len(rows) == had:
                    break
                files.append(batch.column("file")[i].as_py())
                spans.append((at, at := at + len(rows) - had))
                if len(rows) < _AT_ONCE:
                    break
                yield made()
                files, spans, rows = [], [], []
        if rows:
            yield made()


def token_rows(df: DataFrame, text: str = "content") -> DataFrame:
    """``file, pos, value, type, line, column``: a row a token, lexed one text at a time and sent on in short batches."""
    kind = dict(df.dtypes)["file"]
    return df.select("file", F.col(text).alias("content")).mapInArrow(_rows, f"file {kind}, pos int, value string, type string, line int, column int")
