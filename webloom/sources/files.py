"""Readers and writers of crawl files, exports and URL lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from webloom.functions.processors import strip
from webloom.functions.urls import is_pdf

ITEM = "url STRING, title STRING, content STRING, author STRING, published_date STRING, metadata STRING"
QUEUE = "url STRING, custom_instruction STRING, priority INT"
# The columns exports put first, and the tables of a store.
STANDARD = ("id", "url", "title", "content", "author", "published_date", "scraped_at", "callback", "metadata")
STORE = ("spiders", "spider_rules", "spider_settings", "scraped_items", "crawl_queue")


def read_jsonl(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    """One object a line; blank and broken lines are skipped, a missing path has none."""
    reader = spark.read.option("ignoreMissingFiles", True)
    try:
        lines = reader.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    good = lines.where(F.trim("value").startswith("{")).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("value").alias("ok"))
    return good.where("ok IS NOT NULL").select("r.*")


def crawl_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)/([^/]+)/crawls/[^/]+$") -> DataFrame:
    """(project, spider, total, with_content, eligible, modified) of the newest crawl file of
    every project and spider; their names stand in the file's path."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_modification_time").alias("modified"))
    named = rows.select("value", "_f", "modified", F.regexp_extract("_f", pattern, 1).alias("project"), F.regexp_extract("_f", pattern, 2).alias("spider"))
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    has = F.coalesce(strip(F.get_json_object("value", "$.content")) != "", F.lit(False))
    page = ~F.coalesce(is_pdf(F.get_json_object("value", "$.url")), F.lit(False))
    each = named.groupBy("project", "spider", "_f", "modified").agg(F.count_if(good).alias("total"), F.count_if(good & has).alias("with_content"), F.count_if(good & page).alias("eligible"))
    counted = ("total", "with_content", "eligible", "modified")
    return each.groupBy("project", "spider").agg(F.max_by(F.struct(*counted), F.struct("modified", "_f")).alias("r")).select("project", "spider", *[f"r.{c}" for c in counted])


def read_store(spark: SparkSession, path: str | None = None, url: str | None = None, tables: tuple[str, ...] = STORE, **options: str) -> dict[str, DataFrame]:
    """The tables of another store: parquet below a path, or a database reached by JDBC with
    the options its driver needs."""
    if url:
        return {t: spark.read.jdbc(url, t, properties=options) for t in tables}
    return {t: spark.read.parquet(f"{path}/{t}.parquet") for t in tables}


def described(df: DataFrame) -> DataFrame:
    """(position, column, type, nullable) of a table's columns."""
    rows = [(n, f.name, f.dataType.simpleString(), f.nullable) for n, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position INT, column STRING, type STRING, nullable BOOLEAN")


def latest_file(spark: SparkSession, path: str) -> DataFrame:
    """(file): the newest of the files below a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("file"))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue entries of a CSV file with a header or a JSON list; without a URL none."""
    if path.endswith(".json"):
        rows = spark.read.schema(QUEUE.replace("INT", "STRING")).option("multiLine", True).json(path)
    else:
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    for c in ("url", "custom_instruction", "priority"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.select(F.trim("url").alias("url"), "custom_instruction", F.coalesce(F.col("priority").try_cast("int"), F.lit(5)).alias("priority"))
    return rows.where("url <> ''")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of saved pages, a whole file each; the file is the URL."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def sitemap_urls(pages: DataFrame) -> DataFrame:
    """(url, loc, lastmod, type) of sitemaps among (url, html): the root tag in the
    first 4000 characters decides. Broken ones give nothing."""
    head = F.lower(F.left("html", F.lit(4000)))
    kind = F.when(head.contains("<sitemapindex"), "sitemapindex").when(head.contains("<urlset"), "urlset")
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)
    entry = pages.withColumn("type", kind).where("type IS NOT NULL").select("url", "type", F.explode(blocks).alias("b"))
    value = lambda tag: F.nullif(F.trim(F.regexp_extract("b", rf"(?is)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)), F.lit(""))
    loc = value("loc")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        loc = F.replace(loc, F.lit(a), F.lit(b))
    return entry.select("url", loc.alias("loc"), value("lastmod").alias("lastmod"), "type").where("loc IS NOT NULL")


def extracted_urls(pages: DataFrame) -> DataFrame:
    """(page, url): the addresses in sitemaps and the links of other pages (url, html), each
    once; links as they stand."""
    from webloom.functions.html import pages as html_pages

    head = F.lower(F.left("html", F.lit(4000)))
    is_map = head.contains("<sitemapindex") | head.contains("<urlset")
    maps = sitemap_urls(pages.where(is_map)).select(F.col("url").alias("page"), F.col("loc").alias("url"))
    plain = pages.where(~is_map).select(F.col("url").alias("page"), F.explode(html_pages.page_links(F.lit(""), F.col("html"), None, None, ("a",))).alias("url"))
    return maps.unionByName(plain).distinct()


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines) with a total, whose file is null."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"))
    return lines.rollup("file").agg(F.count("*").alias("lines"))


def ordered_columns(df: DataFrame) -> list[str]:
    """Standard columns first, the others by name."""
    return [c for c in STANDARD if c in df.columns] + sorted(c for c in df.columns if c not in STANDARD)


def _plain(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.to_json(c).alias(c) if isinstance(kinds[c], (ArrayType, MapType, StructType)) else F.col(c) for c in ordered_columns(df)])


def write_csv(df: DataFrame, path: str) -> None:
    _plain(df).write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, compress: bool = False) -> None:
    df.select(*ordered_columns(df)).write.option("ignoreNullFields", False).option("compression", "gzip" if compress else "none").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Each part file is one JSON array, an object a line; nulls and letters beyond ASCII
    stay. A table of one partition gives one array."""
    ordered = df.select(*ordered_columns(df))
    lines = ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def join(batches):
        first = True
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([("[\n" if first else ",\n") + ",\n".join(own)])], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "\n]"])], names=["value"])

    lines.mapInArrow(join, "value STRING").write.option("lineSep", " ").text(path)


def rendered(df: DataFrame, form: str = "table") -> Iterator[str]:
    """The lines of a table, JSON or CSV form, row by row as they come in. Columns of a table
    are as wide as their widest value, found by an aggregate."""
    import csv
    import io

    names = df.columns
    shown = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")).alias(c) for c in names])
    if form == "json":
        opened = "["
        for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            yield opened + row[0]
            opened = ","
        yield "]" if opened == "," else "[]"
    elif form == "csv":
        for row in _chained(names, shown):
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(row)
            yield out.getvalue()
    else:
        widest = shown.agg(*[F.max(F.length(F.col(f"`{c}`"))) for c in names]).first()
        widths = [max(len(c), w or 0) for c, w in zip(names, widest)]
        for n, row in enumerate(_chained(names, shown)):
            yield " | ".join(str(v).ljust(w) for v, w in zip(row, widths))
            if n == 0:
                yield "-" * (sum(widths) + 3 * (len(widths) - 1))


def _chained(names: list[str], df: DataFrame) -> Iterator[list[str]]:
    yield names
    for row in df.toLocalIterator():
        yield list(row)


def write_parquet(df: DataFrame, path: str) -> None:
    df.select(*ordered_columns(df)).write.parquet(path)


def append_crawl(df: DataFrame, path: str) -> None:
    """Records appended to a dataset with a directory a project, spider and day."""
    df.withColumn("crawl_date", F.date_format("scraped_at", "ddMMyyyy")).write.mode("append").partitionBy("project", "spider", "crawl_date").json(path)


def write_urls(df: DataFrame, path: str) -> None:
    """The distinct values of ``url`` in order, a line each."""
    df.select("url").where("url <> ''").distinct().orderBy("url").write.text(path)
