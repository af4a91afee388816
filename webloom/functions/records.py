"""Functions over JSON, texts, authors and settings of records."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.processors import strip


def json_at(c: Column, dotted: str) -> Column:
    """The value at a dotted path; a segment of digits is a list index."""
    path = "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in dotted.split("."))
    return F.get_json_object(c, path)


def without_tags(c: Column) -> Column:
    """Tags removed and the ends stripped, only where there is a ``<``."""
    return F.when(c.contains("<"), strip(F.regexp_replace(c, r"<[^>]+>", ""))).otherwise(c)


def joined_authors(names: Column) -> Column:
    """A list of names as ``A, B``: stripped, URLs and repeats left out, null if none."""
    bare = F.filter(F.transform(names, lambda x: strip(x)), lambda x: (x != "") & ~x.startswith("http"))
    return F.nullif(F.array_join(F.array_distinct(bare), ", "), F.lit(""))


def clean_pdf_text(c: Column) -> Column:
    """Text of a PDF: soft hyphens go with a line break behind them, words broken at line
    ends and lines broken within sentences are joined, blanks and empty lines are
    thinned out."""
    gap = r"[ \t]*\n[ \t]*"
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"\u00ad[ \t]*\n?[ \t]*", "")
    c = F.regexp_replace(c, rf"(?U)(\w)-{gap}(\w)", "$1$2")
    c = F.regexp_replace(c, rf"([^\n.!?:;]){gap}([a-z])", "$1 $2")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n +", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def pdf_text(data: Column) -> Column:
    """The cleaned text of PDF bytes: the pages' texts, a line break between them. Empty
    for other bytes, PDFs without text, and where no PDF library is installed."""

    @F.pandas_udf("string")
    def read(files: pd.Series) -> pd.Series:
        try:
            import pypdfium2
        except ImportError:
            return pd.Series([""] * len(files), dtype=object)
        out = []
        for data in files:
            try:
                pages = pypdfium2.PdfDocument(bytes(data)) if data else []
                out.append("\n".join(pages[n].get_textpage().get_text_range() for n in range(len(pages))))
            except Exception:  # whatever a broken file makes the library raise
                out.append("")
        return pd.Series(out, dtype=object)

    return clean_pdf_text(read(data))


def decoded_setting(value: Column) -> Column:
    """A stored setting as JSON text: JSON as it is, then true and false in any
    case, then whole numbers, else a text."""
    low = F.lower(value)
    as_json = F.when(F.try_parse_json(value).isNotNull(), value)
    return F.coalesce(as_json, F.when(low.isin("true", "false"), low), F.when(value.rlike(r"^\d+$"), value), F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"')))


def short_time(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "HH:mm dd-MM-yy"), F.lit("-"))


def ago(seconds: Column) -> Column:
    """An age in its largest whole unit."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    unit = lambda n, u: F.concat((F.floor(s / n)).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def truncated_list(c: Column, most: int = 3) -> Column:
    """A list as JSON, a longer one by its number of items."""
    return F.when(F.size(c) > most, F.concat(F.lit("["), F.size(c).cast("string"), F.lit(" items]"))).otherwise(F.to_json(c))


def query_string(c: Column) -> Column:
    """A map as a URL's query, keys and values encoded."""
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def crawl_stamp(c: Column) -> Column:
    """The day of a time as crawl files name it."""
    return F.date_format(c, "ddMMyyyy")


def truncated(c: Column, length: int = 100) -> Column:
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length)), F.lit("..."))).otherwise(c)


def preview(c: Column, length: int = 150) -> Column:
    """The start of a text on one line."""
    return F.concat(strip(F.replace(F.left(c, F.lit(length)), F.lit("\n"), F.lit(" "))), F.when(F.length(c) > length, F.lit("...")).otherwise(F.lit("")))


def since(spec: str, as_of: Column) -> Column | None:
    """A bound from ``<n>y``, ``<n>m``, ``<n>d`` before ``as_of``, or from a date;
    None for anything else. Day 31 and 29 February give the month's last day."""
    n, unit = spec[:-1], spec[-1:]
    if n.isdigit() and unit in "ymd":
        span = f"INTERVAL '{n}' DAY" if unit == "d" else f"INTERVAL '{int(n) * (12 if unit == 'y' else 1)}' MONTH"
        return as_of - F.expr(span)
    try:
        when = pd.Timestamp(spec)
    except ValueError:
        return None
    return F.lit(when.tz_localize(None).to_pydatetime()).cast("timestamp_ntz")


def find_key(value: Any, key: str) -> Any:
    """The first non-empty value under a key anywhere, an object before its parts."""
    if isinstance(value, dict):
        if value.get(key):
            return value[key]
        value = list(value.values())
    if isinstance(value, list):
        for part in value:
            if found := find_key(part, key):
                return found
    return None


def key_anywhere(c: Column, key: str) -> Column:
    """``find_key`` over JSON texts, the value as JSON."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                found = find_key(json.loads(t), key) if t else None
            except ValueError:
                found = None
            out.append(None if found is None else json.dumps(found, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return find(c)
