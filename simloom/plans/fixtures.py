"""Inline inputs for operators whose meaning is source code; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

NL = "' || chr(10) || '"


def values(columns: str, *rows: tuple) -> str:
    """``SELECT * FROM (VALUES ...)`` of plain literals; newlines become chr(10)."""

    def one(v) -> str:
        if v is None:
            return "CAST(NULL AS STRING)"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v)
        parts = v.split("\n")
        quoted = [q for i, p in enumerate(parts) for q in ([] if i == 0 else ["chr(10)"]) + _quoted(p)]
        return "concat(" + ", ".join(quoted) + ")" if len(quoted) > 1 else quoted[0]

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def _quoted(p: str) -> list[str]:
    """Text as literals without quotes or backslashes inside, which the dialects escape differently."""
    out, now = [], ""
    for ch in p:
        if ch in "'\\":
            out += ([f"'{now}'"] if now else []) + [f"chr({ord(ch)})"]
            now = ""
        else:
            now += ch
    return out + ([f"'{now}'"] if now or not out else [])


STATEMENTS = values(
    "id, text",
    (1, 'console.log("a")'), (2, "  hilog.info(0, 'x', y)  "), (3, 'Logger.debug("debug")'), (4, 'doSomething() && console.log("done")'), (5, "LOGGER.warn(\n  1\n)"),
    (6, "logger.x"), (7, ""), (8, "let   x   =   1"), (9, "@/path/to/file.ets: SomeClass"), (10, "%AC123 some text %AC456"), (11, "this: @entry/src/A.ets: Foo bar"),
    (12, "let foo = bar + foo"), (13, 'config.set("timeout", 3000)'), (14, "1.5e-3 0x1A2B 7 a9"), (15, "let a: Map<string, number>[] = b as Foo"), (16, "@Component(a, b) struct X @State y"),
    (17, "const MAX_SIZE = limit; i = Limit + 'it''s' + \"q\""), (18, "return null || undefined"), (19, None),
)
TYPES = values(
    "id, type", (1, "string"), (2, "Foo"), (3, "string | null"), (4, "Foo | null"), (5, "(string | number)"), (6, "Map<string | Foo, Bar>"), (7, "%unk"), (8, "unknown"), (9, ""), (10, "((Promise))"), (11, "Array|Date"), (12, "unknown2")
)
CALLS = values(
    "id, line, col, class_name, method_name, nargs, text",
    (1, 10, 4, "ForEach", "create", 2, "  ForEach(a, b)"), (2, 11, 0, "ForEach", "create", 3, "ForEach(a, b, c)"), (3, 12, 2, "LazyForEach", "create", 1, "LazyForEach(x)"),
    (4, 13, 1, "ForEach", "create", 1, "none"), (5, 14, 0, "ForEach", "pop", 0, "ForEach.pop()"),
)
LOGGED = values(
    "method, idx, line, end_line, text",
    ("m1", 0, 3, 12, "a = 1"), ("m1", 1, 4, 12, "console.log(1)"), ("m1", 2, 7, 12, "b = 2"), ("m1", 3, 9, 12, "hilog.info(2)"), ("m2", 0, 20, 20, "Logger.x(1)"), ("m3", 0, 5, 9, "c()"),
)
SWITCH = "function f(x) {\n  switch (x) {\n    case 1:\n      a();\n      break;\n    case 2:\n      b();\n    default:\n      c();\n  }\n\n}"
SOURCES = values(
    "id, text",
    (1, SWITCH), (2, "no branches here"), (3, "switch (a) { case 1: x(); }\nnext();\n}"), (4, "} } switch (q) {\ncase 1:\n}"), (5, "switch (u) {\n case 'a':\n  if (v) {\n  }"), (6, "x();\nswitch(a) {\ncase 1: {\n}\n}\nswitch(b) {\ncase 2:\n}"),
)
BRACES = values(
    "file, pos, value",
    *[("a", i, v) for i, v in enumerate("if { } else if { } else if { } else { if { } else if { } } if { }".split())],
    *[("b", i, v) for i, v in enumerate("} } if { if { } else if { } else { } } else if { } if { }".split())],
)
