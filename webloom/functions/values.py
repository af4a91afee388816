"""The field processors for single values: what rows nested in a page hold cannot be a
column, so the same chain runs over plain values there."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from typing import Any

from webloom.functions.processors import TRUTHS


def _texts(value: Any, f: Callable[[str], Any]) -> Any:
    """``f`` over a text or the texts of a list; anything else as it is."""
    if isinstance(value, list):
        return [f(x) if isinstance(x, str) else x for x in value]
    return f(value) if isinstance(value, str) else value


def _regex(value: Any, pattern: str, group: int = 1) -> Any:
    if not isinstance(value, str):
        return value
    try:
        found = re.search(pattern, value)
        return found.group(group) if found else value
    except (re.error, IndexError):
        return value


def _cast(value: Any, to: str) -> Any:
    if value is None or value == "":
        return None
    try:
        if to == "bool":
            return value.lower() in TRUTHS if isinstance(value, str) else bool(value)
        return {"int": int, "float": float, "str": str}[to](value)
    except KeyError:
        return value
    except (TypeError, ValueError, OverflowError):
        return None


def _datetime(value: Any, format: str | None = None, **_: Any) -> Any:
    if not isinstance(value, str) or not value.strip():
        return None
    from dateutil import parser

    try:
        return (datetime.strptime(value.strip(), format) if format else parser.parse(value.strip())).isoformat()
    except (ValueError, OverflowError):
        return None


STEPS: dict[str, Callable[..., Any]] = {
    "strip": lambda v: _texts(v, str.strip),
    "lowercase": lambda v: _texts(v, str.lower),
    "replace": lambda v, old, new="": _texts(v, lambda x: x.replace(old, new)),
    "regex": _regex,
    "cast": _cast,
    "join": lambda v, separator=" ": separator.join(str(x) for x in v if x is not None) if isinstance(v, list) else v,
    "default": lambda v, default: default if v is None or v == "" or v == [] else v,
    "parse_datetime": _datetime,
}


def chain(value: Any, steps: list[dict[str, Any]]) -> Any:
    """The steps from left to right; those of no known type are skipped."""
    for step in steps:
        if f := STEPS.get(step.get("type") or ""):
            value = f(value, **{k: v for k, v in step.items() if k != "type"})
    return value
