"""Main body of page texts by two passes over their lines.

A line is a block. Pass one decides blocks by length, stop-word density and link
density (in plain text: the share of words in menu items, that is, short items
between separators or behind bullets), and by what the corpus shows of the line.
Pass two lets ambiguous short blocks inherit the label of the nearest decided
neighbours; lines under a heading of teasers belong to it.

There is no list of furniture. ``site_lines`` counts the lines of each source by their
letters: furniture is what stands in a share of a source's pages and around different
articles (so the copies of one article are none), or what several sources repeat. A
repeated line that open lines of other wording usually follow is a heading of teasers.
Stop words are no list either: they are the words that most samples of a language
share (``stop_words``), so other languages need only other samples.

Defined results: null and empty texts have no lines; empty lines are never
reported; lines of residue (see ``residue``) belong to the body; null sources are one
source; a source of fewer than ``least`` pages repeats nothing, so its pages are judged
by their blocks alone; repeated rows give repeated results unless the caller keeps
distinct ones.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.repeated_lines import common_lines, letters_key
from webloom.llm.residue import line_holds, may_hold
from webloom.session import shipped, stored

_DECORATION = re.compile(r"^[\s>*\-–—\[(•·]+|[\s\])…!]+$")
_SEPARATOR = re.compile(r"\s+[|/·>»•›]\s+|\s+[|/·>»•›]$")
_SEPARATORS = frozenset("|/·>»•›")
_LIST_ITEM = re.compile(r"^\s*(?:[-–*•]|\d{1,2}[.)])\s+")
_END = re.compile(r"[.!?…][\"'”’»“)\]]*$")
_ENDED = r"[.!…][\"'”’»“)\]]*\s*$"
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, SHORT, HEADING = 1, 2, 3, 4
#: What the corpus shows of a line: nothing, repeated, a heading of teasers, a teaser behind one.
REPEATED, TEASERS, TEASER = 1, 2, 3


def stop_words(samples: DataFrame, share: float = 0.1, longest: int = 5) -> frozenset[str]:
    """Words of at most ``longest`` letters in at least ``share`` of the samples of
    some language. Bounded: at most 1/share x the words of a sample each language."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    sized = samples.groupBy("lang").agg(F.count("*").alias("n"))
    counted = samples.select("lang", F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("k"))
    rows = counted.join(F.broadcast(sized), "lang").where((F.col("k") >= share * F.col("n")) & (F.length("w") <= longest)).select("w").distinct().collect()
    return frozenset(r[0] for r in rows)


def _shapes(content: Column) -> Column:
    """Of each non-empty line its key and whether it is open: short and without an end."""
    open_ = lambda x: (F.length(x) < 110) & ~x.rlike(_ENDED)
    return F.transform(F.filter(F.split(content, "\n", -1), lambda x: x.rlike(r"\S")), lambda x: F.struct(letters_key(x).alias("k"), open_(x).alias("o"), F.length(x).alias("n")))


def site_lines(rows: DataFrame, source: str, content: str, least: int = 4, share: float = 0.05, follow: float = 0.6, sources: int = 3, of_sources: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(own, everywhere): own (source, _common, _heads) has the keys of each source's
    repeated lines and of its headings of teasers; everywhere is one row (_all,
    _all_heads) with those that at least ``sources`` sources repeat (two for a heading)
    and ``of_sources`` of them, so it has at most 1 / ``of_sources`` x the mean of a source.

    A line is repeated if it stands in ``least`` pages of its source and ``share`` of
    them, with ``least`` different longest lines beside it (counted approximately, which is
    exact for so few). It is a heading if lines that
    are open and not repeated follow ``follow`` of its occurrences. Counts are combined
    before they are shuffled; contexts are counted for common lines only."""
    lines = stored(rows.where(F.col(content).isNotNull()).select(F.col(source), _shapes(F.col(content)).alias("_lines")), "blocks")
    common = common_lines(lines.select(source, F.col("_lines.k").alias("_keys")), source, least, share).withColumnRenamed(source, "_source")
    met = lines.join(common, lines[source].eqNullSafe(common["_source"]))
    around = F.array_max(F.transform("_lines", lambda x: F.struct(x["n"], x["k"])))["k"]
    after = F.get("_lines", F.col("_at") + 1)
    placed = met.select("_source", "_lines", "_common", around.alias("_around"), F.posexplode("_lines").alias("_at", "_one")).where(F.array_contains("_common", F.col("_one.k")))
    opens = F.coalesce(after["o"] & after["k"].isNotNull() & ~F.array_contains("_common", after["k"]), F.lit(False))
    seen = placed.select("_source", F.col("_one.k").alias("k"), "_around", opens.cast("int").alias("_open"))
    seen = seen.groupBy("_source", "k").agg(F.approx_count_distinct("_around").alias("c"), F.avg("_open").alias("f")).where(F.col("c") >= least)
    seen = stored(seen.select("_source", "k", (F.col("f") >= follow).alias("head")), "furniture")
    own = seen.groupBy("_source").agg(F.collect_list("k").alias("_common"), F.collect_list(F.when(F.col("head"), F.col("k"))).alias("_heads"))
    total = F.lit(of_sources) * seen.select("_source").distinct().count()
    wide = seen.groupBy("k").agg(F.count("*").alias("n"), F.count_if("head").alias("h"))
    heads = F.when((F.col("h") >= 2) & (F.col("h") >= total), F.col("k"))
    everywhere = wide.where((F.col("n") >= total) & ((F.col("n") >= sources) | heads.isNotNull())).agg(F.collect_list(F.when(F.col("n") >= sources, F.col("k"))).alias("_all"), F.collect_list(heads).alias("_all_heads"))
    return own, everywhere


def with_evidence(rows: DataFrame, source: str, content: str, **options) -> DataFrame:
    """``rows`` with ``_flags``: what the corpus shows of each line of ``content``. There is
    one row of repeated lines a source; Spark broadcasts them while they are small."""
    own, everywhere = site_lines(rows, source, content, **options)
    joined = rows.join(own, rows[source].eqNullSafe(own["_source"]), "left").join(F.broadcast(everywhere), F.lit(True))  # one row
    has = lambda arrays, k: F.coalesce(F.array_contains(arrays[0], k), F.lit(False)) | F.array_contains(arrays[1], k)
    repeated, heads = ("_common", "_all"), ("_heads", "_all_heads")
    keys = F.transform(F.split(content, "\n", -1), lambda x: F.struct(letters_key(x).alias("k"), F.when(x.contains(":"), letters_key(F.substring_index(x, ":", 1))).alias("lead")))
    flag = lambda x: F.when(has(heads, x["k"]), TEASERS).when(x["lead"].isNotNull() & has(heads, x["lead"]), TEASER).when(has(repeated, x["k"]), REPEATED).otherwise(0)
    return joined.select(*rows.columns, F.transform(keys, lambda x: flag(x).cast("tinyint")).alias("_flags"))


def _first_pass(line: str, stops: frozenset[str], flag: int, residue: int) -> int:
    if residue and line_holds(line, residue):
        return GOOD
    if flag:
        return HEADING if flag == TEASERS else BAD
    # Ended prose of some length without separators: the tests below would say the same.
    if len(line) >= 60 and line[0].isalpha() and line[-1] in ".!…" and line.count(" ") >= 8 and _SEPARATORS.isdisjoint(line):
        return GOOD
    bare = _DECORATION.sub("", line.lower())
    words = _WORD.findall(bare)
    if not words or (len(bare) <= 8 and all(len(w) <= 2 for w in words)):
        return BAD if len(line) <= 40 else SHORT
    ended = bool(_END.search(line))
    items = [x for x in _SEPARATOR.split(_LIST_ITEM.sub("", line)) if x and x.strip()]
    if len(items) > 1 and not any(x.strip(" )]").isdigit() for x in items):
        sizes = [len(_WORD.findall(x)) for x in items]
        linked = sum(n for n in sizes if n <= 3)
        path = len(items) >= 3 and max(sizes[:-1]) <= 3
        if path or linked > 0.5 * len(words) or (len(items) == 2 and len(words) <= 5 and not ended):
            return BAD
    if line[0] in "→»©" or (line[0] == "•" and len(words) <= 4):
        return BAD
    question = line[-1] == "?" and len(words) <= 16 and not re.search(r"[.!?] ", _LIST_ITEM.sub("", line))
    density = sum(w in stops for w in words) / len(words)
    if ended and not question and len(words) >= 4 and (density >= 0.1 or len(line) >= 40):
        return GOOD
    if len(line) >= 110 and (density >= 0.1 or ended):
        return GOOD
    return SHORT


def label_lines(text: str, stops: frozenset[str], flags: list[int] | None = None) -> list[bool | None]:
    """For each line whether it belongs to the body; None for empty lines."""
    residue = may_hold(text)
    lines = text.replace("\r", "").split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    first = [_first_pass(lines[i].strip(), stops, flags[i] if flags else 0, residue) for i in full]
    size = [len(_WORD.findall(lines[i])) if k == SHORT else 9 for i, k in zip(full, first)]
    label = [None if k == SHORT else k == GOOD for k in first]
    # A run of short entries is a menu, whatever stands beside it.
    start = 0
    while start < len(full):
        stop = start
        while stop < len(full) and first[stop] == SHORT and size[stop] <= 3 and (stop == start or full[stop] == full[stop - 1] + 1):
            stop += 1
        if stop - start >= 3:
            label[start:stop] = [False] * (stop - start)
        start = max(stop, start + 1)
    before: list[tuple[bool, bool] | None] = []
    seen: tuple[bool, bool] | None = None
    for n, k in enumerate(first):
        before.append(seen)
        if label[n] is not None:
            seen = (label[n], k == HEADING)
    after: list[bool | None] = [None] * len(full)
    nxt: bool | None = None
    for n in range(len(full) - 1, -1, -1):
        after[n] = nxt
        if label[n] is not None:
            nxt = label[n]
    body = [n for n, x in enumerate(label) if x]
    for n in range(len(full)):
        if label[n] is not None:
            continue
        left, right = before[n], after[n]
        if left is not None and left[1]:  # under a heading of teasers
            label[n] = False
        elif left is None and right is None:
            label[n] = True
        elif left is None or right is None or left[0] == right:
            label[n] = right if left is None else left[0]
            if label[n] and left is None and size[n] <= 2:
                label[n] = False
            # A subheading between two notes still has body before and after it.
            if not label[n] and size[n] > 3 and body and body[0] < n < body[-1]:
                label[n] = True
        else:  # between body and furniture
            label[n] = size[n] > 3 or any(c.isdigit() for c in lines[full[n]])
    out: list[bool | None] = [None] * len(lines)
    for n, i in enumerate(full):
        out[i] = label[n]
    return out


def _map(rows: DataFrame, keys: list[str], content: str, source: str | None, stops: frozenset[str], schema: tuple, make) -> DataFrame:
    shared = shipped(rows.sparkSession, stops)

    def run(batches):
        stops = shared()
        for batch in batches:
            kept, made = [], []
            for n, (text, flags) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                for one in make(text, label_lines(text, stops, flags) if text else []):
                    kept.append(n)
                    made.append(one)
            if kept:
                own = [batch.column(i).take(pa.array(kept)) for i in range(len(keys))]
                kinds = [f for f in zip(*made)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(k, t) for k, t in zip(kinds, schema[1]))], names=[*keys, *schema[2]])

    named = rows.select(*keys, F.col(content).alias("_content"), F.col(source).alias("_site") if source else F.lit(None).cast("string").alias("_site"))
    known = with_evidence(named, "_site", "_content") if source else named.withColumn("_flags", F.lit(None).cast("array<tinyint>"))
    return known.select(*keys, "_content", "_flags").mapInArrow(run, schema[0])


def furniture_lines(rows: DataFrame, stops: frozenset[str], keys: list[str], content: str = "content", source: str | None = None) -> DataFrame:
    """(keys, line_no INT): every non-empty line outside the main body. ``source`` is the
    column that names a page's site; without one pages are judged by their blocks alone."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    make = lambda text, labels: [(i + 1,) for i, x in enumerate(labels) if x is False]
    return _map(rows, keys, content, source, stops, (f"{kinds}, line_no INT", [pa.int32()], ["line_no"]), make)


def main_body(rows: DataFrame, stops: frozenset[str], keys: list[str], content: str = "content", source: str | None = None) -> DataFrame:
    """(keys, body STRING): each text without its furniture; null stays null."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def make(text, labels):
        if text is None:
            return [(None,)]
        kept = [x for x, good in zip(text.split("\n"), labels) if good is not False]
        return [(re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n"),)]

    return _map(rows, keys, content, source, stops, (f"{kinds}, body STRING", [pa.string()], ["body"]), make)
