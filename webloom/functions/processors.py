"""The field processors: a closed library of Column builders and their chain.

A processor takes a column and a configuration and gives a column; whether the
value is a list is known from the column's type when a plan is compiled, so each
builder gets ``many``. Entries without a known type are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+$"
# Texts that mean true.
TRUTHS = ("true", "1", "yes", "on")
# Strptime directives and their pattern letters.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%y": "yy", "%z": "xx", "%j": "DDD", "%%": "'%'"}


def _each(c: Column, many: bool, f: Callable[[Column], Column]) -> Column:
    return F.transform(c, f) if many else f(c)


def strip(c: Column, many: bool = False) -> Column:
    """Without white space at both ends, in the wide sense of Unicode."""
    return _each(c, many, lambda x: F.regexp_replace(x, _EDGES, ""))


def replace(c: Column, old: str, new: str = "", many: bool = False) -> Column:
    """Every literal ``old`` replaced; an empty ``old`` stands between all characters."""
    if old == "":
        return _each(c, many, lambda x: F.regexp_replace(x, "(?s)(?=.)|$", re.sub(r"([\\$])", r"\\\1", new)))
    return _each(c, many, lambda x: F.replace(x, F.lit(old), F.lit(new)))


def java_pattern(pattern: str) -> str:
    r"""A Python pattern in Java's dialect: named groups and \Z, Unicode classes."""
    return "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z"))


def regex(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group. Without a match, with a bad pattern or a group the
    pattern does not have, the input; null where an optional group stayed out."""
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return c
    if not 0 <= group <= groups:
        return c
    java = java_pattern(pattern)
    found = F.regexp_extract(c, java, group)
    if group and re.search(r"\)[?*]|\|", pattern):
        found = _optional(c, pattern, group, found)
    return F.when(c.rlike(java), found).otherwise(c)


def _optional(c: Column, pattern: str, group: int, found: Column) -> Column:
    """An optional group's text; where it is empty, one Arrow call tells a group that matched
    nothing from one that stayed out."""

    @F.pandas_udf("boolean")
    def took_part(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return pd.Series([t is not None and (m := compiled.search(t)) is not None and m.group(group) is not None for t in texts])

    return F.when(found != "", found).when(took_part(F.when(found == "", c)), found)


def cast(c: Column, to: str, kind: str = "string") -> Column:
    """int, float, bool or str; null and empty texts give null, failures too.
    Texts are true only as one of ``TRUTHS``; numbers if not zero."""
    text = kind == "string"
    bare = F.regexp_replace(c, _EDGES, "") if text else c
    if to == "int":
        out = F.when(bare.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint")) if text else F.when(c.isNotNull(), (F.floor(F.abs(c)) * F.signum(c)).try_cast("bigint"))
    elif to == "float":
        number = r"(?i)^[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*(\.(\d+)?)?(e[+-]?\d+)?|inf|infinity|nan)$"
        out = F.when(bare.rlike(number), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")) if text else c.try_cast("double")
    elif to == "bool":
        out = F.lower(c).isin(*TRUTHS) if text else c.cast("double") != 0
    elif to == "str":
        out = c.cast("string")
    else:
        return c
    return F.when(c.isNotNull() & (c != "") if text else c.isNotNull(), out)


def join(c: Column, separator: str = " ", many: bool = True) -> Column:
    """A list as one text, nulls left out; anything else as it is. Truth values are written
    True and False."""
    if not many:
        return c
    text = F.transform(c, lambda x: F.when(F.typeof(x) == "boolean", F.initcap(x.cast("string"))).otherwise(x.cast("string")))
    return F.array_join(text, separator)


def default(c: Column, value: Any, kind: str = "string", many: bool = False) -> Column:
    """``value`` for null, the empty text and the empty list, not for 0 or false."""
    empty = c.isNull()
    if many:
        return F.when(empty | (F.size(c) == 0), F.lit(value)).otherwise(c)
    return F.when(empty | (c == ""), F.lit(value)).otherwise(c) if kind == "string" else F.coalesce(c, F.lit(value))


def lowercase(c: Column, many: bool = False) -> Column:
    return _each(c, many, F.lower)


def parse_datetime(c: Column, format: str | None = None, languages: list[str] | None = None, as_of: Column | None = None) -> Column:
    """A timestamp without zone. With a format only that format. Else the free-text reader:
    ISO forms, day and month orders (month first where all is numeric), month names in nine
    languages, zones and offsets converted to UTC, numbers since 1970; with ``as_of`` also
    ``n days ago``, ``yesterday`` and the like in English. ``languages`` is accepted: names
    of months differ enough to need no choice."""
    bare = F.regexp_replace(c, _EDGES, "")
    if format:
        literal = re.sub(r"%[A-Za-z%]|[A-Za-z]+", lambda m: DIRECTIVES.get(m.group(), "") if m.group()[0] == "%" else f"'{m.group()}'", format)
        return F.try_to_timestamp(bare, F.lit(literal)).cast("timestamp_ntz")
    from webloom.operators.timestamps import read_instant

    found = read_instant(bare, "MDY")
    if as_of is None:
        return found
    low = F.lower(bare)
    ago = r"^(?:about |around )?(\d+|an?) (second|minute|hour|day|week|month|year)s? ago$"
    n = F.when(F.regexp_extract(low, ago, 1).startswith("a"), 1).otherwise(F.regexp_extract(low, ago, 1).try_cast("int"))
    unit = F.regexp_extract(low, ago, 2)
    at = as_of.cast("timestamp_ntz")
    months = F.when(unit == "month", n).when(unit == "year", 12 * n)
    seconds = n * F.when(unit == "second", 1).when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 604800)
    past = F.coalesce(F.when(months.isNotNull(), at - F.make_ym_interval(F.lit(0), months)), F.timestamp_add("SECOND", -seconds, at))
    word = F.when(low == "yesterday", F.timestamp_add("DAY", F.lit(-1), at)).when(low.isin("today", "now", "just now"), at)
    return F.coalesce(found, F.when(low.rlike(ago), past), word)


def chain(c: Column, steps: list[dict[str, Any]], many: bool = False) -> Column:
    """The steps from left to right; the type is followed along the chain."""
    kind = "string"
    for step in steps:
        options = {k: v for k, v in step.items() if k != "type"}
        name = step.get("type")
        if name == "strip" and kind == "string":
            c = strip(c, many)
        elif name == "replace" and kind == "string":
            c = replace(c, options["old"], options.get("new", ""), many)
        elif name == "regex" and kind == "string" and not many:
            c = regex(c, options["pattern"], options.get("group", 1))
        elif name == "cast" and not many:
            c = cast(c, options["to"], kind)
            kind = options["to"] if options["to"] in ("int", "float", "bool") else "string"
        elif name == "join" and many:
            c, many = join(c, options.get("separator", " ")), False
        elif name == "default":
            c = default(c, options["default"], kind, many)
        elif name == "lowercase" and kind == "string":
            c = lowercase(c, many)
        elif name == "parse_datetime" and kind == "string" and not many:
            c, kind = parse_datetime(c, options.get("format"), options.get("languages")), "timestamp"
    return c
