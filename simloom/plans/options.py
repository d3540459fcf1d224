"""Rule options: frozen records filled from user settings field by field.

A setting counts only if its type and range fit; otherwise the field keeps
its default. ``field`` metadata holds aliases, bounds and a transform.
"""

from __future__ import annotations

import argparse
import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any


def opt(default: Any, *aliases: str, low: float | None = None, high: float | None = None, nan: bool = False, valid: Callable | None = None, then: Callable | None = None):
    return field(default=default, metadata={"aliases": aliases, "low": low, "high": high, "nan": nan, "valid": valid, "then": then})


def _fits(default: Any, value: Any, meta: dict) -> bool:
    if isinstance(default, bool):
        return isinstance(value, bool)
    if isinstance(default, str):
        return isinstance(value, str)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return False
    if not meta["nan"] and not math.isfinite(value):
        return False
    return not ((meta["low"] is not None and value < meta["low"]) or (meta["high"] is not None and value > meta["high"]))


def parse(defaults: Any, settings: Any) -> Any:
    """``defaults`` with the fields that the first element of ``settings`` sets rightly."""
    if not isinstance(settings, list) or not settings or not isinstance(settings[0], dict):
        return defaults
    given, changes = settings[0], {}
    for f in fields(defaults):
        key = next((k for k in (f.name, *f.metadata["aliases"]) if k in given), None)
        if key is None:
            continue
        value, m = given[key], f.metadata
        if _fits(getattr(defaults, f.name), value, m) and (m["valid"] is None or m["valid"](value)):
            changes[f.name] = m["then"](value) if m["then"] else value
    return replace(defaults, **changes)


@dataclass(frozen=True)
class MethodCloneOptions:
    min_stmts: int = opt(6, "minStmts", low=1)
    ignore_logs: bool = opt(True, "ignoreLogs")
    ignore_types: bool = opt(False, "ignoreTypes")
    ignore_decorators: bool = opt(False, "ignoreDecorators")
    ignore_literals: bool = opt(False, "ignoreLiterals")
    min_complexity: int = opt(0, "minComplexity", low=0)
    similarity: float = opt(1.0, "similarityThreshold", low=0, high=1)
    classes: bool = opt(False, "enableCloneClasses")


@dataclass(frozen=True)
class FragmentOptions:
    minimum_tokens: int = opt(100, "minimumTokens", low=1)
    normalize_identifiers: bool = opt(True, "normalizeIdentifiers")
    normalize_literals: bool = opt(False, "normalizeLiterals")
    ignore_types: bool = opt(False, "ignoreTypes")
    ignore_decorators: bool = opt(False, "ignoreDecorators")
    ignore_logs: bool = opt(True, "ignoreLogs")
    min_token_types: int = opt(3, "minDistinctTokenTypes", low=0)
    similarity: float = opt(1.0, "similarityThreshold", low=0, high=1)
    classes: bool = opt(False, "enableCloneClasses")


@dataclass(frozen=True)
class LongMethodOptions:
    max_lines: float = opt(math.nan, "maxLines", low=0)
    max_stmts: float = opt(math.nan, "maxStmts", low=0)
    ui_soft: int = opt(80, "maxUIStmtsSoft", "uiSoftLimit", low=0)
    ui_hard: int = opt(120, "maxUIStmtsHard", "uiHardLimit", low=0)

    @property
    def limit(self) -> int:
        return int(next((x for x in (self.max_lines, self.max_stmts) if math.isfinite(x)), 50))


@dataclass(frozen=True)
class EnvyOptions:
    atfd: int = opt(4, "atfdThreshold", low=0)
    lda: float = opt(0.33, "ldaThreshold", low=0, high=1)
    cpfd: int = opt(2, "cpfdThreshold", low=0)


@dataclass(frozen=True)
class SwitchOptions:
    min_cases: int = opt(6, "minCases", low=1)


@dataclass(frozen=True)
class ForEachOptions:
    min_args: int = opt(3, "minArgs", low=1)


def arguments(argv: list[str]) -> dict[str, str]:
    """``--key=value`` and bare ``--flag`` (the text true)."""
    rest = argparse.ArgumentParser(add_help=False).parse_known_args(argv)[1]
    return {k: v if eq else "true" for k, eq, v in (a.removeprefix("--").partition("=") for a in rest if a.startswith("--"))}


def projects(value: Any) -> list[str]:
    """A non-empty list of non-empty names, else ValueError."""
    if not isinstance(value, list) or not value or not all(isinstance(p, str) and p.strip() for p in value):
        raise ValueError("projects must be a non-empty list of non-empty strings")
    return value
