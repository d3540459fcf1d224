"""Classes, methods, fields and statements of source files, read from their tokens.

This is a reader for what the rules need, not a compiler: it follows braces,
decorators, member heads and statement ends. Functions outside classes belong
to the class ``%dflt``; closures stay part of the statement they stand in.
A head (``if (...)``, ``switch (...)``) is a statement of its own; its text
runs to the brace that opens its block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.lexer import scan

CALL = "struct<class_name:string,method_name:string,nargs:int>"
STMT = f"struct<idx:int,line:int,col:int,text:string,is_branch:boolean,calls:array<{CALL}>>"
METHOD = f"struct<method_name:string,decorators:array<string>,start_line:int,start_col:int,has_body:boolean,code:string,stmts:array<{STMT}>>"
FIELD = "struct<name:string,type:string>"
CLASS = f"struct<class_name:string,class_kind:string,decorators:array<string>,fields:array<{FIELD}>,methods:array<{METHOD}>>"
PROGRAM = f"array<{CLASS}>"

# Words before a member's name, words that begin a branching statement, class-like declarations.
MODIFIERS = frozenset("public private protected static async readonly abstract override export default declare get set".split())
BRANCHES = frozenset("if for while switch catch do case".split())
KINDS = {"class": "CLASS", "struct": "STRUCT", "interface": "INTERFACE", "enum": "ENUM"}
_CLOSER = {"(": ")", "[": "]", "{": "}"}


class _Source:
    """Tokens of a text with their places, and the partner of every bracket."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [(value, kind, at) for kind, value, at in scan(text) if kind not in ("comment", "space", "other")]
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.partner, stack = {}, []
        for i, (value, kind, _) in enumerate(self.tokens):
            if kind == "op" and value in _CLOSER:
                stack.append(i)
            elif kind == "op" and value in (")", "]", "}"):
                if stack and _CLOSER[self.tokens[stack[-1]][0]] == value:
                    self.partner[stack.pop()] = i
        self.end = len(self.tokens)

    def value(self, i: int) -> str:
        return self.tokens[i][0] if i < self.end else ""

    def close(self, i: int) -> int:
        """The partner of the bracket at ``i``; the end where it is never closed."""
        return self.partner.get(i, self.end)

    def place(self, i: int) -> tuple[int, int]:
        at = self.tokens[i][2]
        line = bisect_right(self.breaks, at - 1)
        return line + 1, at - (self.breaks[line - 1] + 1 if line else 0)

    def piece(self, a: int, b: int) -> str:
        """Text from token a up to and with token b."""
        b = min(b, self.end - 1)
        return self.text[self.tokens[a][2] : self.tokens[b][2] + len(self.tokens[b][0])] if a <= b else ""

    def line_between(self, i: int) -> bool:
        """Whether a line ends between token i - 1 and i."""
        a = self.tokens[i - 1][2] + len(self.tokens[i - 1][0])
        return "\n" in self.text[a : self.tokens[i][2]]


def _calls(s: _Source, a: int, b: int) -> list[dict]:
    """Calls ``name(...)`` and ``x.name(...)`` among the tokens a to b; a bare capitalised name is the creation of that component."""
    out = []
    for i in range(a, min(b, s.end - 1) + 1):
        if s.tokens[i][1] != "name" or s.value(i + 1) != "(":
            continue
        close, n, k = s.close(i + 1), 0, i + 2
        while k < close:
            n = n or 1
            if s.value(k) == ",":
                n += 1
            k = s.close(k) + 1 if s.value(k) in _CLOSER else k + 1
        if s.value(close - 1) == ",":
            n -= 1
        name = s.value(i)
        owner = s.value(i - 2) if i >= 2 and s.value(i - 1) == "." else None
        bare = owner is None and name[:1].isupper()
        out.append({"class_name": name if bare else owner or "", "method_name": "create" if bare else name, "nargs": n})
    return out


def _statements(s: _Source, a: int, b: int) -> list[dict]:
    """Statements between the tokens a and b (a body without its braces)."""
    out, i = [], a
    while i < b:
        first = s.value(i)
        if first in ("{", "}", ";"):
            i += 1
            continue
        j, done = i, False
        while j < b and not done:
            v = s.value(j)
            if v in ("(", "["):
                j = min(s.close(j) + 1, b)
            elif v == "{":
                before = s.value(j - 1) if j > i else ""
                if before in (")", "else", "try", "finally", "do") or first in ("else", "try", "finally", "do"):
                    break  # a block follows
                j = min(s.close(j) + 1, b)
                if before == "=>" or j >= b or s.line_between(j):
                    done = j >= b or s.value(j) not in (".", ",", ")", "?.")
            elif v in (";", "}"):
                break
            elif v == ":" and first in ("case", "default"):
                j, done = j + 1, True
            else:
                j += 1
            if not done and i < j < b and s.line_between(j) and _ends(s, j):
                done = True
        line, col = s.place(i)
        if j > i:
            out.append({"idx": len(out), "line": line, "col": col, "text": s.piece(i, j - 1), "is_branch": first in BRANCHES or first == "else" and s.value(i + 1) == "if", "calls": _calls(s, i, j - 1)})
        i = max(j, i + 1)
    return out


_GOES_ON = frozenset("= == === != !== + - * / % && || ?? ? : , . ?. => < > <= >= | & ^ ( [ {".split())


def _ends(s: _Source, j: int) -> bool:
    """Whether a line end before token j ends the statement."""
    return s.value(j - 1) not in _GOES_ON and s.value(j) not in _GOES_ON - {"{", "(", "["} and s.value(j) not in (")", "]", "{")


def _decorators(s: _Source, i: int) -> tuple[list[str], int]:
    found = []
    while s.value(i) == "@":
        found.append(s.value(i + 1))
        i += 2
        if s.value(i) == "(":
            i = s.close(i) + 1
    return found, i


def _method(s: _Source, start: int, name: int, decorators: list[str]) -> tuple[dict, int]:
    """The method whose name is the token ``name`` and whose head begins at ``start``; and where to go on."""
    i = name + 1
    if s.value(i) == "<":
        while i < s.end and s.value(i) != "(":
            i += 1
    i = s.close(i) + 1
    while i < s.end and s.value(i) not in ("{", ";", "}") and not s.line_between(i):
        i = s.close(i) + 1 if s.value(i) in ("(", "[") else i + 1
    line, col = s.place(name)
    body = s.value(i) == "{"
    last = s.close(i) if body else i - 1
    row = {"method_name": s.value(name), "decorators": decorators, "start_line": line, "start_col": col, "has_body": body, "code": s.piece(start, last), "stmts": _statements(s, i + 1, min(last, s.end)) if body else []}
    return row, (last + 1 if body else i)


def _members(s: _Source, a: int, b: int) -> tuple[list[dict], list[dict]]:
    fields, methods, i = [], [], a
    while i < b:
        decorators, i = _decorators(s, i)
        start = i
        while s.value(i) in MODIFIERS and s.value(i + 1) not in ("(", ":", "=", ";"):
            i += 1
        if i < b and s.tokens[i][1] in ("name", "string", "private") and s.value(i + 1) in ("(", "<"):
            row, i = _method(s, start, i, decorators)
            methods.append(row)
            continue
        if i < b and s.tokens[i][1] in ("name", "private"):
            name, j, kind = s.value(i), i + 1, ""
            if s.value(j) in ("?", "!"):
                j += 1
            if s.value(j) == ":":
                k, angle = j + 1, 0
                while k < b and (angle or s.value(k) not in ("=", ";", "}", ",") and not (k > j + 1 and s.line_between(k) and s.value(k) != "|")):
                    angle += (s.value(k) == "<") - (s.value(k) == ">")
                    k = s.close(k) + 1 if s.value(k) in _CLOSER else k + 1
                kind, j = s.piece(j + 1, k - 1), k
            while j < b and s.value(j) not in (";", "}") and not (s.line_between(j) and _ends(s, j)):
                j = s.close(j) + 1 if s.value(j) in _CLOSER else j + 1
            fields.append({"name": name, "type": kind})
            i = max(j, i + 1)
            continue
        i += 1
    return fields, methods


def parse(text: str | None) -> list[dict]:
    """Classes of a source text, the default class first."""
    s = _Source(text or "")
    out, top, i, decorators = [], [], 0, []
    while i < s.end:
        found, i = _decorators(s, i)
        decorators += found
        v = s.value(i)
        if v in KINDS and i + 1 < s.end and s.tokens[i + 1][1] == "name":
            name, j = s.value(i + 1), i + 2
            while j < s.end and s.value(j) != "{":
                j += 1
            fields, methods = _members(s, j + 1, s.close(j)) if v != "enum" else ([], [])
            out.append({"class_name": name, "class_kind": KINDS[v], "decorators": decorators, "fields": fields, "methods": methods})
            i, decorators = s.close(j) + 1, []
        elif v == "function" and i + 1 < s.end and s.tokens[i + 1][1] == "name":
            row, i = _method(s, i, i + 1, decorators)
            top.append(row)
            decorators = []
        else:
            if v not in MODIFIERS:
                decorators = []
            i = s.close(i) + 1 if v in _CLOSER else i + 1
    return [{"class_name": "%dflt", "class_kind": "CLASS", "decorators": [], "fields": [], "methods": top}, *out]


def read_programs(files: DataFrame) -> DataFrame:
    """``files`` (file, content) with their ``classes``; a null content has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"file": f["file"], "classes": [parse(x) for x in f["content"]]})

    return files.select("file", F.col("content")).where("content is not null").mapInPandas(run, f"file string, classes {PROGRAM}")
