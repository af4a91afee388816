"""Stored tables as snapshots: inserts, queue, upserts, deletes, exports.

Every mutator takes snapshots and gives the next one; the caller writes it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls

#: Tables that free SQL may name.
TABLES = ("spiders", "spider_rules", "spider_settings", "scraped_items", "crawl_queue", "alembic_version")


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_absent(new: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows to append: the first of each key that is not stored yet."""
    return first_of(new.dropna(subset=keys), keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")


def quarantined(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and the others; a condition that is null is not met."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def search(items: DataFrame, url: str | None = None, title: str | None = None, text: str | None = None) -> DataFrame:
    """Items whose URL, title, or title or content hold a text, in any case; ``%``
    and ``_`` in it are wildcards."""
    if url:
        items = items.where(F.col("url").ilike(f"%{url}%"))
    if title:
        items = items.where(F.col("title").ilike(f"%{title}%"))
    if text:
        items = items.where(F.coalesce(F.col("title").ilike(f"%{text}%"), F.lit(False)) | F.coalesce(F.col("content").ilike(f"%{text}%"), F.lit(False)))
    return items


def latest(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.col("scraped_at").desc_nulls_last(), "id").limit(n)


def spider_named(spiders: DataFrame, name: str, project: str) -> DataFrame:
    """The spider of a name and project, the one of smallest id if there are several."""
    return spiders.where((F.col("name") == name) & (F.col("project") == project)).orderBy("id").limit(1)


def spiders_of(spiders: DataFrame, project: str | None = None) -> DataFrame:
    """Spiders by name, of one project or of all."""
    return (spiders.where(F.col("project") == project) if project else spiders).orderBy("name", "project")


def queue_open(queue: DataFrame, status: str | None = None, every: bool = False, limit: int = 0) -> DataFrame:
    """Entries of a status, else the open ones or all, the most urgent first; a ``limit`` of
    0 lists all."""
    if status:
        queue = queue.where(F.col("status") == status)
    elif not every:
        queue = queue.where(F.col("status").isin("pending", "processing"))
    queue = queue.orderBy(F.col("priority").desc(), "created_at", "id")
    return queue.limit(limit) if limit else queue


def queue_next(queue: DataFrame, limit: int = 1) -> DataFrame:
    """The next pending entries of each project. Ranking reads three columns; the
    planner keeps the best of each task before the shuffle, so a dominant project
    sends few rows."""
    w = Window.partitionBy("project_name").orderBy(F.col("priority").desc(), "created_at", "id")
    return queue.where("status = 'pending'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def queue_claim(queue: DataFrame, worker: str, now: Column, limit: int = 1) -> DataFrame:
    """The queue with the next entries marked as taken by a worker."""
    taken = queue_next(queue, limit).select("id", F.lit(True).alias("_t"))
    return _updated(queue.join(taken, "id", "left"), F.col("_t").isNotNull(), queue, {"status": F.lit("processing"), "processing_by": F.lit(worker), "locked_at": now, "updated_at": now})


def _updated(rows: DataFrame, where: Column, like: DataFrame, values: dict[str, Column]) -> DataFrame:
    return rows.select(*[(F.when(where, values[c].cast(like.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c)) for c in like.columns])


def queue_complete(queue: DataFrame, ids: list[int], now: Column) -> DataFrame:
    return _updated(queue, F.col("id").isin(ids), queue, {"status": F.lit("completed"), "completed_at": now, "updated_at": now})


def queue_fail(queue: DataFrame, ids: list[int], message: str, now: Column) -> DataFrame:
    return _updated(queue, F.col("id").isin(ids), queue, {"status": F.lit("failed"), "error_message": F.lit(message), "updated_at": now})


def queue_retry(queue: DataFrame, where: Column, now: Column) -> DataFrame:
    none = F.lit(None)
    return _updated(queue, where, queue, {"status": F.lit("pending"), "retry_count": F.col("retry_count") + 1, "error_message": none, "processing_by": none, "locked_at": none, "updated_at": now})


def queue_cleanup(queue: DataFrame, project: str, done: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    return queue.where(~((F.col("project_name") == project) & F.col("status").isin(*done)))


def queue_additions(queue: DataFrame, new: DataFrame) -> DataFrame:
    """(project_name, website_url, ...) of new entries: with a URL, once each, and
    not queued in any state."""
    return insert_absent(new, queue, ["project_name", "website_url"], ["priority", "website_url"])


def queue_to_spiders(queue: DataFrame, spiders: DataFrame) -> DataFrame:
    """Queue entries whose spider exists in their project, by the queue's naming."""
    named = queue.withColumn("_name", urls.queue_name(F.col("website_url")))
    known = spiders.select(F.col("name").alias("_name"), F.col("project").alias("project_name"))
    return named.join(known, ["_name", "project_name"], "left_semi").select(*queue.columns)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of the same key; others stay."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def cascade_delete(spiders: DataFrame, children: dict[str, DataFrame], where: Column) -> dict[str, DataFrame]:
    """All tables without the spiders that meet a condition and their rows."""
    gone = spiders.where(where).select(F.col("id").alias("spider_id"))
    out = {"spiders": spiders.where(~F.coalesce(where, F.lit(False)))}
    return out | {name: child.join(gone, "spider_id", "left_anti") for name, child in children.items()}


def remapped(parent: DataFrame, child: DataFrame, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both tables with new parent ids in the order of the old ones. Numbers are
    made per range of ids and then shifted, so no single task numbers them all."""
    bucket = F.floor(F.col("id") / 100_000)
    own = parent.select("id", bucket.alias("_b"))
    counts = own.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    numbers = own.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("id"))).join(shifts, "_b")
    ids = numbers.select(F.col("id").alias("_old"), (F.col("_s") + F.col("_r") + first_id - 1).cast("bigint").alias("_new"))
    moved = parent.join(ids, parent["id"] == ids["_old"]).select(F.col("_new").alias("id"), *[c for c in parent.columns if c != "id"])
    children = child.join(ids, child["spider_id"] == ids["_old"]).select(*[F.col("_new").alias(c) if c == "spider_id" else F.col(c) for c in child.columns])
    return moved, children


# The fields of an item that are columns of the store or bookkeeping, those
# never stored, and the columns exports put first.
STANDARD = ("url", "title", "content", "author", "published_date", "spider_id", "spider_name", "source", "metadata", "html", "extracted_at", "_callback", "scraped_at")
INTERNAL = ("clean_html",)
CORE = ("title", "content", "author", "published_date")


def _member(name: str, c: Column) -> Column:
    """``"name":value`` as JSON; timestamps in ISO form at any depth, nulls kept."""
    text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})
    text = F.regexp_replace(text, r'(T\d\d:\d\d:\d\d)\.000000"', '$1"')
    return F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), text.substr(F.lit(6), F.length(text) - 6))


def packed(items: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Items as the store keeps them: standard fields as columns, all others as members
    of ``metadata_json``. Members that ``metadata`` (JSON) already has win over fields."""
    others = [c for c in items.columns if c not in STANDARD and c not in INTERNAL]
    known = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>")) if metadata in items.columns else F.array().cast("array<string>")
    inner = F.when(F.size(known) > 0, F.regexp_extract(metadata, r"(?s)^\s*\{(.*)\}\s*$", 1)) if metadata in items.columns else F.lit(None).cast("string")
    members = [F.when(~F.array_contains(known, c), _member(c, F.col(c))) for c in others]
    if "_callback" in items.columns:
        members.append(F.when(F.col("_callback").isNotNull(), _member("_callback", F.col("_callback"))))
    joined = F.array_join(F.filter(F.array(inner, *members), lambda m: m.isNotNull()), ",")
    return items.select(*[c for c in ("spider_id", "url", *CORE) if c in items.columns], F.concat(F.lit("{"), joined, F.lit("}")).alias("metadata_json"))


def metadata_keys(items: DataFrame, metadata: str = "metadata_json") -> list[str]:
    """The member names of all metadata, sorted. They are fields of configurations, so
    their number does not grow with the rows."""
    return sorted(r[0] for r in items.select(F.explode(F.json_object_keys(metadata)).alias("k")).distinct().collect())


def flattened(items: DataFrame, fields: list[str] | None = None, metadata: str = "metadata_json") -> DataFrame:
    """Items with members of their metadata as columns, unless the name is taken; all
    members there are where ``fields`` is not given."""
    names = metadata_keys(items, metadata) if fields is None else fields
    new = [f for f in names if f not in items.columns and f != "_callback"]
    return items.select(*[c for c in items.columns if c != metadata], *[_at(metadata, f).alias(f) for f in sorted(new)])


def _at(metadata: str, member: str) -> Column:
    return F.get_json_object(metadata, "$['" + member.replace("'", "\\'") + "']")


def exported(items: DataFrame, callbacks: dict[str, dict], metadata: str = "metadata_json") -> DataFrame:
    """Rows for export: id, url, scraped_at, then by the callback that made a row the
    fields it extracts (core names from their columns) and ``callback``; rows of no known
    callback have the core columns. Other members of the metadata follow. The rows of all
    callbacks are one table whose columns are the union, missing ones null."""
    rows = items.withColumn("_by", _at(metadata, "_callback"))
    parts = [(None, rows.where(F.col("_by").isNull() | ~F.col("_by").isin(list(callbacks))), CORE)]
    parts += [(name, rows.where(F.col("_by") == name), tuple(config.get("extract") or {})) for name, config in callbacks.items()]
    out: DataFrame | None = None
    for name, part, fields in parts:
        base = ["id", "url", "scraped_at"]
        own = [F.col(f) if f in CORE else _at(metadata, f).alias(f) for f in fields if f not in base]
        extra = [k for k in metadata_keys(part, metadata) if k not in {*base, *fields, "_callback", "callback"}]
        shown = part.select(*base, *([F.lit(name).alias("callback")] if name else []), *own, *[_at(metadata, k).alias(k) for k in extra])
        out = shown if out is None else out.unionByName(shown, allowMissingColumns=True)
    return out


def with_provenance(items: DataFrame, spider: str, as_of: Column) -> DataFrame:
    """Items with the spider that made them and the time they were made."""
    return items.withColumn("scraped_at", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")).withColumn("source", F.lit(spider))


def _named_tables(text: str) -> set[str]:
    """The tables a statement reads: names after FROM, JOIN and commas between them,
    without those that WITH defines."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", text, flags=re.S)
    defined = {m.lower() for m in re.findall(r"(?is)(?:\bwith\b(?:\s+recursive\b)?|\)\s*,)\s*(\w+)(?:\s*\([^)]*\))?\s+as\s*\(", bare)}
    names = set()
    for start in re.finditer(r"(?i)\b(?:from|join)\b(?!\s*\()\s*", bare):
        rest = bare[start.end() :]
        while m := re.match(r"[`\"]?([\w.]+)[`\"]?(?:\s+(?:as\s+)?(?!(?:on|using|where|group|order|having|limit|inner|left|right|full|cross|join|union|except|intersect|lateral|natural|window)\b)\w+)?\s*(,(?!\s*\()\s*)?", rest, re.I):
            names.add(m[1].lower())
            if not m[2]:
                break
            rest = rest[m.end() :]
    return names - defined


def checked_sql(spark: SparkSession, text: str, tables: tuple[str, ...] | None = TABLES) -> DataFrame:
    """A SELECT over the known tables; anything else is refused."""
    if not re.match(r"(?is)^\s*(select|with)\b", text):
        raise ValueError("only SELECT statements are run")
    if tables is not None and (unknown := _named_tables(text) - set(tables)):
        raise ValueError(f"unknown tables {sorted(unknown)}")
    return spark.sql(text)


# Functions within SQL; Spark puts their bodies into the plan, so nothing is called by row.
_FUNCTIONS = {
    "url_host(u STRING) RETURNS STRING": r"lower(regexp_replace(regexp_replace(nullif(regexp_extract(u, r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), r'^.*@', ''), r':\d*$', ''))",
    "url_is_pdf(u STRING) RETURNS BOOLEAN": r"endswith(lower(regexp_replace(u, r'[?#].*', '')), '.pdf')",
    "spider_name(u STRING) RETURNS STRING": r"translate(regexp_replace(nullif(regexp_extract(u, r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), r'^[w.]+', ''), '.-', '__')",
    "has_text(t STRING) RETURNS BOOLEAN": r"coalesce(regexp_replace(t, r'(?U)^\s+|\s+$', '') <> '', false)",
    "without_tags(t STRING) RETURNS STRING": r"CASE WHEN contains(t, '<') THEN regexp_replace(regexp_replace(t, r'<[^>]+>', ''), r'(?U)^\s+|\s+$', '') ELSE t END",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Registers the engine's functions for SQL in a session; their names."""
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in _FUNCTIONS]


def _statement(text: str) -> tuple[str, str | None, str | None]:
    """(table, assignments or None, condition or None) of an UPDATE or DELETE."""
    m = re.match(r"(?is)^\s*(?:update\s+(\w+)\s+set\s+(.+?)|delete\s+from\s+(\w+))(?:\s+where\s+(.*))?$", text.strip().rstrip(";"))
    if not m:
        raise ValueError("neither UPDATE nor DELETE")
    name = (m[1] or m[3]).lower()
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return name, m[2], m[4]


def affected(spark: SparkSession, statement: str) -> DataFrame:
    """(affected): how many rows an UPDATE or DELETE would touch."""
    name, _, where = _statement(statement)
    rows = spark.table(name)
    return (rows.where(where) if where else rows).agg(F.count("*").alias("affected"))


def rewritten(spark: SparkSession, statement: str) -> DataFrame:
    """The table's next snapshot after an UPDATE or DELETE; the caller writes it."""
    name, assignments, where = _statement(statement)
    rows = spark.table(name)
    met = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    if assignments is None:
        return rows.where(~met)
    values: dict[str, Column] = {}
    for part in re.split(r",(?=(?:[^']|'[^']*')*$)(?=\s*\w+\s*=)", assignments):
        column, _, value = part.partition("=")
        if column.strip() not in rows.columns:
            raise ValueError(f"unknown column {column.strip()}")
        values[column.strip()] = F.expr(value.strip())
    return _updated(rows, met, rows, values)
