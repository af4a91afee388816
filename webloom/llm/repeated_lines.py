"""Lines and blocks of lines that a source repeats across its documents.

Line identifiers are hashes of a line's letters in lower case. A line is common
when it stands in at least ``least`` of its source's documents and in at least
``share`` of them. A repeated block can only consist of common lines, so the
suffix array of a source's concatenated line identifiers is built over the runs
of common lines alone: every other line is a unique separator, which no common
prefix can cross.

The array is distributed by its suffixes' first identifier: suffixes are counted
first (equal ones become one row with a weight), then each bucket is sorted, and
the longest common prefixes of neighbours give the blocks. A bucket holds the distinct
suffixes that begin with the same two common lines, not their occurrences; single lines
are counted over all of theirs.

Defined results: null contents have no lines, an empty one counts as a document;
lines without letters are never common; of a document's equal lines each
position is reported; repeated rows are documents of their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import stored


def _letters(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"\P{L}+", ""))


def _hashed(letters: Column) -> Column:
    return F.when(letters != "", F.xxhash64(letters))


def letters_key(line: Column) -> Column:
    """The identifier of a line: a hash of its letters in lower case, null without letters."""
    return F.get(F.transform(F.array(_letters(line)), _hashed), F.lit(0))


def line_keys(content: Column) -> Column:
    """The identifier of each line in order."""
    return F.transform(F.transform(F.split(content, "\n", -1), _letters), _hashed)


def keyed(docs: DataFrame, source: str, key: str, content: str) -> DataFrame:
    """(source, key, _keys) of documents with content; null sources are one source."""
    return docs.where(F.col(content).isNotNull()).select(F.col(source), F.col(key), line_keys(F.col(content)).alias("_keys"))


def common_lines(lines: DataFrame, source: str, least: int = 4, share: float = 0.1) -> DataFrame:
    """(source, _common): the common identifiers of each source, an array of at
    most (mean lines a document) / share entries. Counts are combined before the
    shuffle, so a source with a third of all rows sends one row a task and line."""
    totals = lines.groupBy(source).agg(F.count("*").alias("_docs"))
    once = lines.select(source, F.explode(F.array_distinct(F.filter("_keys", lambda k: k.isNotNull()))).alias("_line"))
    counts = once.groupBy(source, "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    kept = counts.join(totals, counts[source].eqNullSafe(totals[source])).where(F.col("_n") >= share * F.col("_docs"))
    return kept.groupBy(counts[source]).agg(F.array_sort(F.collect_list("_line")).alias("_common"))


def marked(lines: DataFrame, common: DataFrame, source: str) -> DataFrame:
    """``lines`` with ``_runs``: the common identifiers in place, others null.
    ``common`` has one row a source; Spark broadcasts it while it is small and
    otherwise splits the rows of a large source (skew join)."""
    small = common.withColumnRenamed(source, "_source")
    joined = lines.join(small, lines[source].eqNullSafe(small["_source"]), "left").drop("_source")
    return joined.withColumn("_runs", F.transform("_keys", lambda k: F.when(F.array_contains("_common", k), k))).drop("_common")


def repeated_blocks(lines: DataFrame, common: DataFrame, source: str, least: int = 4) -> DataFrame:
    """(source, block ARRAY<BIGINT>, docs): the blocks of common lines that at
    least ``least`` documents share and none of them can be prolonged in all of
    these documents: the intervals of common prefixes in the suffix array.

    A suffix starts at every common line. A document in which a block stands several times
    counts once: of its sorted suffixes, the common prefix of each two neighbours is taken
    off again, which leaves one for every prefix the document holds."""
    runs = marked(lines, common, source).select(source, "_runs")

    # Suffixes are bound as a lambda's variable; as a column the optimizer would put their
    # computation in place of each use. Only documents with a line that stands twice have
    # suffixes with a common prefix, so only theirs are sorted.
    each = F.expr(
        """transform(array(transform(
             filter(sequence(0, size(_runs) - 1), i -> _runs[i] IS NOT NULL),
             i -> slice(_runs, i + 1, coalesce(nullif(array_position(transform(slice(_runs, i + 1, size(_runs)), x -> x IS NULL), true), 0) - 1, size(_runs))))),
           u -> CASE WHEN size(array_distinct(transform(u, x -> x[0]))) = size(u) THEN transform(u, x -> struct(x AS suffix, 1 AS n))
             ELSE transform(array(array_sort(u)), a -> concat(
               transform(a, x -> struct(x AS suffix, 1 AS n)),
               transform(filter(transform(
                 sequence(1, size(a) - 1),
                 i -> slice(a[i], 1, coalesce(nullif(array_position(transform(arrays_zip(a[i - 1], a[i]), z -> NOT (z['0'] <=> z['1'])), true), 0) - 1, size(a[i])))), x -> size(x) > 0),
                 x -> struct(x AS suffix, -1 AS n))))[0] END)[0]"""
    )
    every = runs.where(F.exists("_runs", lambda x: x.isNotNull())).select(source, F.inline(each))
    weighed = every.groupBy(source, "suffix").agg(F.sum("n").alias("docs"))
    weighed = weighed.withColumn("first", F.get("suffix", F.lit(0))).withColumn("second", F.get("suffix", F.lit(1)))
    # A line is a block of its own unless the same line follows it everywhere.
    lone = weighed.groupBy(source, "first").agg(F.sum("docs").alias("docs"), (F.count_if(F.col("second").isNull()) > 0).alias("_ends"), (F.min("second") != F.max("second")).alias("_parts"))
    single = lone.where((F.col("docs") >= least) & (F.col("_ends") | F.col("_parts"))).select(source, F.array("first").alias("block"), "docs")

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        array = sorted(zip((tuple(x) for x in pdf["suffix"]), pdf["docs"]))
        found: list[tuple[tuple, int]] = []
        stack: list[list[int]] = []  # open intervals: prefix length, documents
        seen: tuple = ()

        def close(down_to: int) -> None:
            while stack and stack[-1][0] > down_to:
                length, docs = stack.pop()
                if docs >= least:
                    found.append((seen[:length], docs))
                if stack and stack[-1][0] >= down_to:
                    stack[-1][1] += docs
                elif down_to:
                    stack.append([down_to, docs])

        for suffix, docs in array:
            shared = next((n for n, (x, y) in enumerate(zip(seen, suffix)) if x != y), min(len(seen), len(suffix)))
            close(shared)
            stack.append([len(suffix), int(docs)])
            seen = suffix
        close(0)
        return pd.DataFrame({source: [pdf[source].iloc[0]] * len(found), "block": pd.Series([list(x) for x, _ in found], dtype=object), "docs": pd.Series([d for _, d in found], dtype="int64")})

    kind = lines.schema[source].dataType.simpleString()
    longer = weighed.where(F.col("second").isNotNull()).groupBy(source, "first", "second").applyInPandas(bucket, f"{source} {kind}, block ARRAY<BIGINT>, docs BIGINT")
    return single.unionByName(longer)


def repeated(docs: DataFrame, source: str, key: str, content: str, least: int = 4, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(lines, found): the documents' lines as ``keyed``, and (source, _common) with
    the lines of every block that spans ``least`` documents and ``share`` of them."""
    lines = stored(keyed(docs, source, key, content), "lines")
    totals = lines.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_docs"))
    blocks = repeated_blocks(lines, common_lines(lines, source, least, share), source, least)
    wide = blocks.join(totals, blocks[source].eqNullSafe(totals["_source"])).where(F.col("docs") >= share * F.col("_docs"))
    found = wide.select(source, F.explode("block").alias("_line")).groupBy(source).agg(F.array_sort(F.collect_set("_line")).alias("_common"))
    return lines, found


def repeated_positions(docs: DataFrame, source: str, key: str, content: str, least: int = 4, share: float = 0.1) -> DataFrame:
    """(key, line_no INT): every line that belongs to a block its source repeats. A
    common line is a block by itself, so no common line is left out."""
    lines, found = repeated(docs, source, key, content, least, share)
    runs = marked(lines, found, source)
    return runs.select(key, F.posexplode("_runs").alias("_at", "_line")).where(F.col("_line").isNotNull()).select(key, (F.col("_at") + 1).cast("int").alias("line_no"))


def without_repeated(docs: DataFrame, source: str, key: str, content: str, least: int = 4, share: float = 0.1) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``content``; all rows stay."""
    common = repeated(docs, source, key, content, least, share)[1].withColumnRenamed(source, "_source")
    joined = docs.join(common, docs[source].eqNullSafe(common["_source"]), "left")
    text = F.split(content, "\n", -1)
    kept = F.transform(F.filter(F.arrays_zip(text.alias("text"), line_keys(F.col(content)).alias("line")), lambda x: ~F.coalesce(F.array_contains("_common", x["line"]), F.lit(False))), lambda x: x["text"])
    cleaned = F.when(F.col("_common").isNull() | F.col(content).isNull(), F.col(content)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(content, cleaned).select(*docs.columns)
