"""The queries of the core, by name, with the same result in SQL where it has one.

Inputs too small to be tables are rows in both forms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import processors as proc
from webloom.functions import records, urls
from webloom.functions.html import pages as html_pages
from webloom.operators import routing, stats, store
from webloom.plans import cases, timestamp_queries
from webloom.session import shared_dir, table
from webloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name. DuckDB's ``count_if`` is wider
    than a BIGINT; the filtered count says the same."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return put


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


items, queue, spiders, rules, settings, events, orders = (_t(n) for n in ("scraped_items", "crawl_queue", "spiders", "spider_rules", "spider_settings", "events", "orders"))
NOW = "2026-03-01 00:00:00"
_now = lambda: F.lit(NOW).cast("timestamp_ntz")
#: White space in the wide sense, as RE2 has to be told.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_PATH = r"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


# Statistics and health


@query(rf"""SELECT spider_id, count(*) AS total, count_if(coalesce(trim(content, E' \t\n\r\f\v') <> '', false)) AS with_content,
  count_if(NOT coalesce(lower({_PATH.format(c="url")}) LIKE '%.pdf', false)) AS eligible,
  CAST(floor(100 * count_if(coalesce(trim(content, E' \t\n\r\f\v') <> '', false)) / nullif(count_if(NOT coalesce(lower({_PATH.format(c="url")}) LIKE '%.pdf', false)), 0)) AS BIGINT) AS pct
  FROM scraped_items GROUP BY spider_id""")  # fmt: skip
def crawl_stats(spark, d):
    return stats.crawl_stats(items(spark, d))


@query("""SELECT spider_id, count(*) AS items, CAST(arg_max(coalesce(length(content), 0), (scraped_at, id)) AS BIGINT) AS newest_chars,
  CASE WHEN count(*) < 3 THEN 'crawling' WHEN arg_max(coalesce(length(content), 0), (scraped_at, id)) < 50 THEN 'extraction' ELSE 'passed' END AS verdict
  FROM scraped_items GROUP BY spider_id""")  # fmt: skip
def health(spark, d):
    return stats.health(items(spark, d))


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN count(*) < 3 THEN 'crawling' WHEN arg_max(coalesce(length(content), 0), (scraped_at, id)) < 50 THEN 'extraction' ELSE 'passed' END AS verdict
  FROM scraped_items GROUP BY spider_id) GROUP BY verdict""")  # fmt: skip
def health_summary(spark, d):
    return stats.health(items(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""SELECT spider_id, count_if(title IS NULL OR title = '') AS missing_title, count_if(author IS NULL OR author = '') AS missing_author,
  count_if(published_date IS NULL OR published_date = '') AS missing_published_date FROM scraped_items GROUP BY spider_id""")
def required_audit(spark, d):
    return stats.missing_fields(items(spark, d), ["title", "author", "published_date"])


@query("""SELECT coalesce(a.project, b.project) AS project, coalesce(n_spiders, 0) AS n_spiders, coalesce(n_queue, 0) AS n_queue
  FROM (SELECT project, count(*) AS n_spiders FROM spiders WHERE project IS NOT NULL GROUP BY 1) a
  FULL JOIN (SELECT project_name AS project, count(*) AS n_queue FROM crawl_queue WHERE project_name IS NOT NULL GROUP BY 1) b ON a.project = b.project""")
def project_counts(spark, d):
    return stats.project_counts(spiders(spark, d), queue(spark, d))


@query("SELECT DISTINCT project FROM (SELECT project FROM spiders UNION ALL SELECT project_name FROM crawl_queue) WHERE project IS NOT NULL")
def projects(spark, d):
    return spiders(spark, d).select("project").union(queue(spark, d).select("project_name")).where("project IS NOT NULL").distinct()


@query("""SELECT count(*) AS total, count_if(status = 'pending') AS pending, count_if(status = 'processing') AS processing,
  count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed FROM crawl_queue""")
def status_counts(spark, d):
    return stats.status_counts(queue(spark, d))


@query("SELECT project_name, status, count(*) AS n FROM crawl_queue GROUP BY ROLLUP (project_name, status)")
def queue_rollup(spark, d):
    return queue(spark, d).rollup("project_name", "status").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT project) AS n_projects, count(*) AS n_spiders, count_if(active) AS n_active FROM spiders")
def catalog_counts(spark, d):
    return spiders(spark, d).agg(F.countDistinct("project").alias("n_projects"), F.count("*").alias("n_spiders"), F.count_if("active").alias("n_active"))


_TABLES = ("spiders", "spider_rules", "spider_settings", "scraped_items", "crawl_queue")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Store


@query("SELECT id, url, scraped_at FROM scraped_items WHERE url ILIKE '%market%' ORDER BY scraped_at DESC NULLS LAST, id LIMIT 20")
def show_latest(spark, d):
    return store.latest(store.search(items(spark, d), url="market"), 20).select("id", "url", "scraped_at")


@query("SELECT id FROM scraped_items WHERE coalesce(title ILIKE '%flood barrier%', false) OR coalesce(content ILIKE '%flood barrier%', false)")
def search_text(spark, d):
    return store.search(items(spark, d), text="flood barrier").select("id")


@query(r"""SELECT id, CASE WHEN length(title) > 30 THEN left(title, 30) || '...' ELSE title END AS title,
  regexp_replace(replace(left(content, 150), chr(10), ' '), '^\s+|\s+$', '', 'g') || CASE WHEN length(content) > 150 THEN '...' ELSE '' END AS preview FROM scraped_items""")
def preview(spark, d):
    return items(spark, d).select("id", records.truncated(F.col("title"), 30).alias("title"), records.preview(F.col("content")).alias("preview"))


@query("""SELECT id, url, title, author, metadata_json->>'$.lang' AS lang, metadata_json->>'$.top_image' AS top_image FROM scraped_items""")
def export_flat(spark, d):
    rows = store.flattened(items(spark, d), ["lang", "top_image", "title"])
    return rows.select("id", "url", "title", "author", "lang", "top_image")


@query("SELECT spider_id, url, min_by(id, (scraped_at, id)) AS id FROM scraped_items WHERE url IS NOT NULL AND spider_id IS NOT NULL GROUP BY 1, 2")
def dedup_first(spark, d):
    return store.first_of(items(spark, d).select("spider_id", "url", "scraped_at", "id").dropna(subset=["spider_id", "url"]), ["spider_id", "url"], ["scraped_at", "id"]).select("spider_id", "url", "id")


@query("""WITH s AS (SELECT * FROM scraped_items WHERE scraped_at < TIMESTAMP '2025-06-01'), n AS (SELECT * FROM scraped_items WHERE scraped_at >= TIMESTAMP '2025-06-01')
  SELECT min_by(id, (scraped_at, id)) AS id FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.spider_id = n.spider_id AND s.url = n.url) GROUP BY spider_id, url""")
def insert_absent(spark, d):
    rows = items(spark, d).select("id", "spider_id", "url", "scraped_at")
    cut = F.lit("2025-06-01").cast("timestamp_ntz")
    return store.insert_absent(rows.where(F.col("scraped_at") >= cut), rows.where(F.col("scraped_at") < cut), ["spider_id", "url"], ["scraped_at", "id"]).select("id")


@query("SELECT CASE WHEN coalesce(url LIKE 'http%' AND length(content) > 0, false) THEN 'good' ELSE 'quarantine' END AS part, count(*) AS n FROM scraped_items GROUP BY 1")
def quarantine(spark, d):
    good, bad = store.quarantined(items(spark, d), F.col("url").startswith("http") & (F.length("content") > 0))
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("part"), "n").unionByName(bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("quarantine").alias("part"), "n"))


@query("SELECT id, project_name, status FROM crawl_queue WHERE status IN ('pending', 'processing')")
def queue_list(spark, d):
    return store.queue_open(queue(spark, d)).select("id", "project_name", "status")


@query("SELECT id, priority FROM crawl_queue WHERE status = 'failed' ORDER BY priority DESC, created_at, id LIMIT 15")
def queue_urgent(spark, d):
    return store.queue_open(queue(spark, d), status="failed", limit=15).select("id", "priority")


@query("SELECT id, name FROM spiders WHERE project = 'newsdesk' ORDER BY name, project")
def spiders_by_name(spark, d):
    return store.spiders_of(spiders(spark, d), "newsdesk").select("id", "name")


@query("SELECT min(id) AS id, project FROM spiders WHERE (name, project) = (SELECT (name, project) FROM spiders WHERE id = 3) GROUP BY project")
def spider_named(spark, d):
    own = spiders(spark, d)
    known = own.where("id = 3").select("name", "project").first()
    return store.spider_named(own, known["name"], known["project"]).select("id", "project")


@query("""SELECT spider_id, arg_max(struct_pack(t := title), (scraped_at, id)).t AS title, left(arg_max(coalesce(content, ''), (scraped_at, id)), 100) AS content, arg_max(struct_pack(t := author), (scraped_at, id)).t AS author,
  arg_max(struct_pack(t := url), (scraped_at, id)).t AS url, arg_max(struct_pack(t := published_date), (scraped_at, id)).t AS date FROM scraped_items GROUP BY spider_id""")
def health_sample(spark, d):
    return stats.health_sample(items(spark, d))


@query("""SELECT spider_id, count(*) AS items, CAST(arg_max(coalesce(length(content), 0), (scraped_at, id)) AS BIGINT) AS newest_chars,
  CASE WHEN spider_id % 7 = 0 THEN 'schema_coverage' WHEN count(*) < 3 THEN 'crawling' WHEN arg_max(coalesce(length(content), 0), (scraped_at, id)) < 50 THEN 'extraction' ELSE 'passed' END AS verdict FROM scraped_items GROUP BY spider_id""")
def health_with_schema(spark, d):
    """Spiders whose configuration leaves required fields unfilled fail before anything else."""
    problems = spiders(spark, d).where("id % 7 = 0").select(F.col("id").alias("spider_id"), F.lit("byline").alias("problem"))
    return stats.health(items(spark, d), problems=problems)


@query("SELECT s.id, s.name FROM spiders s WHERE NOT EXISTS (SELECT 1 FROM crawl_queue q WHERE q.project_name = s.project AND q.status = 'completed')")
def spiders_without_files(spark, d):
    done = queue(spark, d).where("status = 'completed'").select(F.col("project_name").alias("project"))
    return stats.without_files(spiders(spark, d), done, ["project"]).select("id", "name")


@query("SELECT id, project_name FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY priority DESC, created_at, id) AS n FROM crawl_queue WHERE status = 'pending') WHERE n <= 2")
def queue_next(spark, d):
    return store.queue_next(queue(spark, d), 2).select("id", "project_name")


@query(f"""SELECT q.id, CASE WHEN c.id IS NULL THEN status ELSE 'processing' END AS status, CASE WHEN c.id IS NULL THEN processing_by ELSE 'w1' END AS processing_by, CASE WHEN c.id IS NULL THEN locked_at ELSE TIMESTAMP '{NOW}' END AS locked_at
  FROM crawl_queue q LEFT JOIN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project_name ORDER BY priority DESC, created_at, id) AS n FROM crawl_queue WHERE status = 'pending') WHERE n <= 1) c ON q.id = c.id""")
def queue_claim(spark, d):
    return store.queue_claim(queue(spark, d), "w1", _now()).select("id", "status", "processing_by", "locked_at")


@query(f"""SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN status = 'failed' THEN NULL ELSE error_message END AS error_message,
  CASE WHEN status = 'failed' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM crawl_queue""")
def queue_retry(spark, d):
    return store.queue_retry(queue(spark, d), F.col("status") == "failed", _now()).select("id", "status", "retry_count", "error_message", "updated_at")


@query("SELECT id, CASE WHEN id IN (1, 2, 3) THEN 'completed' WHEN id IN (4, 5) THEN 'failed' ELSE status END AS status, CASE WHEN id IN (4, 5) THEN 'timeout' ELSE error_message END AS error_message FROM crawl_queue")
def queue_finish(spark, d):
    done = store.queue_complete(queue(spark, d), [1, 2, 3], _now())
    return store.queue_fail(done, [4, 5], "timeout", _now()).select("id", "status", "error_message")


@query("SELECT id FROM crawl_queue WHERE NOT coalesce(project_name = 'newsdesk' AND status IN ('completed', 'failed'), false)")
def queue_cleanup(spark, d):
    return store.queue_cleanup(queue(spark, d), "newsdesk").select("id")


@query("""SELECT project_name, website_url, min(priority) AS priority FROM (SELECT project_name, website_url || CASE WHEN id % 2 = 0 THEN '' ELSE '?new' END AS website_url, priority FROM crawl_queue WHERE website_url IS NOT NULL AND project_name IS NOT NULL) n
  WHERE NOT EXISTS (SELECT 1 FROM crawl_queue q WHERE q.project_name = n.project_name AND q.website_url = n.website_url) GROUP BY 1, 2""")
def queue_bulk(spark, d):
    own = queue(spark, d)
    new = own.select("project_name", F.concat("website_url", F.when(F.col("id") % 2 == 0, "").otherwise("?new")).alias("website_url"), "priority")
    return store.queue_additions(own, new)


@query("""SELECT q.id FROM crawl_queue q WHERE EXISTS (SELECT 1 FROM spiders s WHERE s.project = q.project_name AND
  s.name = translate(regexp_replace(regexp_extract(q.website_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[w.]+', ''), '.-', '__'))""")
def queue_verified(spark, d):
    return store.queue_to_spiders(queue(spark, d), spiders(spark, d)).select("id")


@query("SELECT id, name, project, CASE WHEN id % 5 = 0 THEN NOT active ELSE active END AS active FROM spiders")
def spider_upsert(spark, d):
    rows = spiders(spark, d).select("id", "name", "project", "active")
    return store.upsert(rows, rows.where("id % 5 = 0").withColumn("active", ~F.col("active")), ["name", "project"])


@query("""SELECT 'spiders' AS tbl, count(*) AS n FROM spiders WHERE NOT coalesce(project = 'prices', false)
  UNION ALL SELECT 'rules', count(*) FROM spider_rules WHERE spider_id NOT IN (SELECT id FROM spiders WHERE project = 'prices')
  UNION ALL SELECT 'items', count(*) FROM scraped_items WHERE spider_id IS NULL OR spider_id NOT IN (SELECT id FROM spiders WHERE project = 'prices')""")
def cascade_delete(spark, d):
    left = store.cascade_delete(spiders(spark, d), {"rules": rules(spark, d), "items": items(spark, d)}, F.col("project") == "prices")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH m AS (SELECT id AS old, row_number() OVER (ORDER BY id) + 999 AS new FROM spiders)
  SELECT r.id, m.new AS spider_id, s.name FROM spider_rules r JOIN m ON r.spider_id = m.old JOIN spiders s ON s.id = m.old""")
def transfer_remap(spark, d):
    moved, child = store.remapped(spiders(spark, d), rules(spark, d), 1000)
    return child.join(moved.select(F.col("id").alias("spider_id"), "name"), "spider_id").select("id", "spider_id", "name")


@query(r"""SELECT id, coalesce(CASE WHEN json_valid(value) THEN value END, CASE WHEN lower(value) IN ('true', 'false') THEN lower(value) END, '"' || value || '"') AS decoded FROM spider_settings""")
def settings_decoded(spark, d):
    return settings(spark, d).select("id", records.decoded_setting(F.col("value")).alias("decoded"))


@query("SELECT spider_id, max(CASE WHEN key = 'DATE_ORDER' THEN value END) AS date_order, max(CASE WHEN key = 'SITE_TIMEZONE' THEN value END) AS site_timezone FROM spider_settings GROUP BY spider_id")
def settings_pivot(spark, d):
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return settings(spark, d).groupBy("spider_id").agg(pick("DATE_ORDER").alias("date_order"), pick("SITE_TIMEZONE").alias("site_timezone"))


# URLs and routing


@query(rf"SELECT {_HOST.format(c='url')} AS host, count(*) AS n FROM scraped_items GROUP BY 1")
def host_counts(spark, d):
    return items(spark, d).groupBy(urls.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(r"""SELECT website_url, translate(regexp_replace(n, '^[w.]+', ''), '.-', '__') AS queue_name, translate(replace(n, 'www.', ''), '.', '_') AS expected_name
  FROM (SELECT DISTINCT website_url, regexp_extract(website_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS n FROM crawl_queue WHERE website_url LIKE 'http%')""")
def spider_names(spark, d):
    u = F.col("website_url")
    return queue(spark, d).where(u.startswith("http")).select(u).distinct().select(u, urls.queue_name(u).alias("queue_name"), urls.expected_name(u).alias("expected_name"))


@query("""WITH r AS (SELECT id, spider_id, coalesce(allow_patterns, []) AS a, coalesce(deny_patterns, []) AS d, callback, priority FROM spider_rules),
  m AS (SELECT i.id, r.id AS rule_id, r.callback, row_number() OVER (PARTITION BY i.id ORDER BY r.priority DESC, r.id) AS n FROM scraped_items i JOIN r ON r.spider_id = i.spider_id
    WHERE (len(r.a) = 0 OR len(list_filter(r.a, lambda p: regexp_matches(i.url, p))) > 0) AND len(list_filter(r.d, lambda p: regexp_matches(i.url, p))) = 0)
  SELECT i.id, m.rule_id, m.callback FROM scraped_items i LEFT JOIN m ON m.id = i.id AND m.n = 1""")
def rule_route(spark, d):
    return routing.route(items(spark, d).select("id", "spider_id", "url"), rules(spark, d)).select("id", "rule_id", "callback")


@query(rf"""SELECT i.id FROM scraped_items i JOIN spiders s ON s.id = i.spider_id WHERE coalesce(len(s.allowed_domains), 0) = 0
  OR len(list_filter(s.allowed_domains, lambda x: {_HOST.format(c="i.url")} = lower(x) OR {_HOST.format(c="i.url")} LIKE '%.' || lower(x))) > 0""")
def onsite(spark, d):
    return routing.onsite(items(spark, d).select("id", "spider_id", "url"), spiders(spark, d)).select("id")


_URLS = ["https://a.example/x.PDF?y=1", "http://www.b.example/s/a+b%20c.pdf", "https://c.example/sitemap.xml", "https://d.example/pic.jpg", "ftp://e.example/", "http://localhost/x", "http://10.0.0.1/", "https://wwf.example/p?q#f", "notaurl", "https://f.example/data.json"]
_URL_ROWS = "(VALUES " + ", ".join(f"('{u}')" for u in _URLS) + ") t(url)"


@query(rf"""SELECT url, lower(regexp_replace(url, '[?#].*', '')) LIKE '%.pdf' AS is_pdf, regexp_matches(lower(url), '\.(xml|json|txt)([?#]|$)') OR lower({_PATH.format(c="url")}) LIKE '%/sitemap%' AS not_html,
  coalesce(regexp_matches(url, '^(?i)https?://[^/?#]+') AND NOT regexp_matches({_HOST.format(c="url")}, '^(localhost|10\..*|127\..*)$'), false) AS fetchable FROM {_URL_ROWS}""")
def url_predicates(spark, d):
    u = F.col("url")
    return spark.createDataFrame([(x,) for x in _URLS], "url STRING").select(u, urls.is_pdf(u).alias("is_pdf"), urls.is_not_html(u).alias("not_html"), urls.fetchable(u).alias("fetchable"))


@query("""SELECT count(*) AS total, count_if(lastmod IS NULL) AS no_lastmod, count_if(denied) AS denied, count_if(old) AS old, count_if(NOT denied AND NOT old) AS kept FROM (
  SELECT CASE WHEN id % 7 = 0 THEN NULL ELSE strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN id % 3 = 0 THEN '+02:00' ELSE '' END END AS lastmod,
  regexp_matches(url, '/story/') AS denied, CASE WHEN id % 7 = 0 THEN false ELSE date_trunc('second', scraped_at) < TIMESTAMP '2025-03-01' END AS old FROM scraped_items WHERE url IS NOT NULL)""")
def sitemap_filter(spark, d):
    stamp = F.when(F.col("id") % 7 != 0, F.concat(F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("id") % 3 == 0, "+02:00").otherwise("")))
    entries = items(spark, d).where("url IS NOT NULL").select(F.col("url").alias("loc"), stamp.alias("lastmod"), F.lit("urlset").alias("type"))
    seen = routing.sitemap_entries(entries, since=records.since("1y", F.lit("2026-03-01").cast("timestamp_ntz")), deny=["/story/", "(broken"])
    return seen.agg(F.count("*").alias("total"), F.count_if("no_lastmod").alias("no_lastmod"), F.count_if("denied").alias("denied"), F.count_if("old").alias("old"), F.count_if("kept").alias("kept"))


@query("""SELECT 'https://a.example/' || c || '/' || strftime(day, '%Y/%m/%d') || '?page=' || p AS url FROM (SELECT unnest(['news', 'sport']) AS c),
  (SELECT unnest(generate_series(DATE '2025-02-26', DATE '2025-03-04', INTERVAL 3 DAY)) AS day), (SELECT unnest(range(0, 11, 5)) AS p)""")
def generated_urls(spark, d):
    spec = {"c": {"values": ["news", "sport"]}, "day": {"type": "date", "from": "2025-02-26", "to": "2025-03-04", "step_days": 3, "format": "%Y/%m/%d"}, "p": {"type": "range", "from": 0, "to": 10, "step": 5}}
    return routing.generated(spark, "https://a.example/{c}/{day}?page={p}", spec).select("url")


@query("SELECT 'https://a.example/q' AS url, 'k=' || k || '&n=' || n AS form FROM (SELECT unnest(['x', 'y']) AS k), (SELECT unnest(range(1, 4)) AS n)")
def generated_requests(spark, d):
    rows = routing.generated(spark, "https://a.example/q", {"k": {"values": ["x", "y"]}, "n": {"type": "range", "from": 1, "to": 3}}, {"k": "{k}", "n": "{n}"})
    return rows.select("url", F.concat(F.lit("k="), F.col("formdata")["k"], F.lit("&n="), F.col("formdata")["n"]).alias("form"))


@query("SELECT id, nullif(regexp_extract(url, '/([a-z]+)/', 1), '') AS section, nullif(regexp_extract(url, '-(\\d+)$', 1), '') AS number FROM scraped_items")
def url_context(spark, d):
    from webloom.plans.config import from_context

    found = from_context(F.col("url"), {"section": "/([a-z]+)/", "number": r"-(\d+)$"})
    return items(spark, d).select("id", *[c.alias(n) for n, c in found.items()])


# Processors and scalar functions

_VALUES = ["3.7", " 42 ", "1_000", "12d", "on", "", "Yes", "abc", "-5", "1e3", "Price: $99.99", "\n\t a b \n"]
_VALUE_ROWS = "(VALUES " + ", ".join("(E'" + v.replace("\n", "\\n").replace("\t", "\\t") + "')" for v in _VALUES) + ") t(v)"
_BARE = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"


def _values(spark):
    return spark.createDataFrame([(v,) for v in _VALUES], "v STRING")


@query(rf"""SELECT v, CASE WHEN v <> '' AND regexp_matches({_BARE}, '^[+-]?\d+(_\d+)*$') THEN CAST(replace({_BARE}, '_', '') AS BIGINT) END AS as_int,
  CASE WHEN v <> '' AND regexp_matches({_BARE}, '^[+-]?\d+(_\d+)*(\.\d*)?(e[+-]?\d+)?$') THEN CAST(replace({_BARE}, '_', '') AS DOUBLE) END AS as_float,
  CASE WHEN v <> '' THEN lower(v) IN ('true', '1', 'yes', 'on') END AS as_bool FROM {_VALUE_ROWS}""")
def cast_values(spark, d):
    v = F.col("v")
    return _values(spark).select(v, proc.cast(v, "int").alias("as_int"), proc.cast(v, "float").alias("as_float"), proc.cast(v, "bool").alias("as_bool"))


@query(rf"""SELECT v, {_BARE} AS stripped, replace(v, 'a', 'xy') AS replaced, CASE WHEN regexp_matches(v, '(\d+)') THEN regexp_extract(v, '(\d+)', 1) ELSE v END AS matched,
  CASE WHEN v = '' THEN 'none' ELSE v END AS filled, lower(v) AS low, CASE WHEN regexp_matches(v, '\$(\d+\.\d+)') THEN CAST(regexp_extract(v, '\$(\d+\.\d+)', 1) AS DOUBLE) WHEN regexp_matches({_BARE}, '^-?\d[\d_]*(\.\d+)?(e\d+)?$') THEN CAST(replace({_BARE}, '_', '') AS DOUBLE) END AS price
  FROM {_VALUE_ROWS}""")
def processor_chain(spark, d):
    v = F.col("v")
    price = proc.chain(v, [{"type": "regex", "pattern": r"\$(\d+\.\d+)"}, {"type": "unknown"}, {"type": "cast", "to": "float"}])
    return _values(spark).select(v, proc.strip(v).alias("stripped"), proc.replace(v, "a", "xy").alias("replaced"), proc.regex(v, r"(\d+)").alias("matched"), proc.default(v, "none").alias("filled"), proc.lowercase(v).alias("low"), price.alias("price"))


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS parsed FROM orders")
def parse_datetime(spark, d):
    text = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")
    return orders(spark, d).select("o_orderkey", proc.parse_datetime(text, "%d/%m/%Y %H:%M").alias("parsed"))


@query("SELECT id, coalesce(strftime(locked_at, '%H:%M %d-%m-%y'), '-') AS stamp, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age FROM (SELECT *, greatest(date_diff('second', date_trunc('second', updated_at), TIMESTAMP '2026-03-01'), 0) AS s FROM crawl_queue)")
def ages(spark, d):
    s = F.expr(f"timestampdiff(SECOND, date_trunc('SECOND', updated_at), TIMESTAMP_NTZ '{NOW}')")
    return queue(spark, d).select("id", records.short_time(F.col("locked_at")).alias("stamp"), records.ago(s).alias("age"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM events")
def json_path(spark, d):
    return events(spark, d).select("event_id", records.json_at(F.col("props"), "k").try_cast("bigint").alias("k"), records.json_at(F.col("props"), "missing").alias("missing"))


@query("SELECT id, k, CAST(p AS INTEGER) AS pos FROM (SELECT id, unnest(CAST(metadata_json->'$.keywords' AS VARCHAR[])) AS k, generate_subscripts(CAST(metadata_json->'$.keywords' AS VARCHAR[]), 1) AS p FROM scraped_items WHERE metadata_json IS NOT NULL)")
def json_array_rows(spark, d):
    words = F.from_json(F.get_json_object("metadata_json", "$.keywords"), "array<string>")
    return items(spark, d).select("id", F.posexplode(words).alias("pos", "k")).select("id", "k", (F.col("pos") + 1).cast("int").alias("pos"))


@query(rf"SELECT id, CASE WHEN contains(title, '<') THEN regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') ELSE title END AS bare FROM scraped_items")
def tag_strip(spark, d):
    return items(spark, d).select("id", records.without_tags(F.col("title")).alias("bare"))


@query(rf"""SELECT id, nullif(array_to_string(list_distinct_ordered, ', '), '') AS authors FROM (SELECT id, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS list_distinct_ordered FROM (
  SELECT id, list_filter(list_transform(regexp_split_to_array(author, '[/&,]'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, 'http')) AS parts FROM scraped_items))""")
def author_lists(spark, d):
    return items(spark, d).select("id", records.joined_authors(F.split("author", "[/&,]")).alias("authors"))


_W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, E'\r\n?', E'\n', 'g'), chr(173) || '[ \t]*\n?[ \t]*', '', 'g') AS t FROM documents),
  b AS (SELECT doc_id, regexp_replace(t, '({_W})-[ \t]*\n[ \t]*({_W})', '\1\2', 'g') AS t FROM a), c AS (SELECT doc_id, regexp_replace(t, '([^\n.!?:;])[ \t]*\n[ \t]*([a-z])', '\1 \2', 'g') AS t FROM b),
  e AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n ', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g') AS t FROM c) SELECT doc_id, regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS cleaned FROM e""")
def pdf_text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", records.clean_pdf_text(F.col("text")).alias("cleaned"))


# State


@query("""SELECT user_id, event_id, blocked, via_proxy, blocked AND via_proxy AS failed FROM (SELECT user_id, event_id, event_type = 'error' AS blocked,
  coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS via_proxy FROM events)""")
def block_learning(spark, d):
    return stats.block_learning(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "blocked", "via_proxy", "failed")


@query("""WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 404 ELSE 200 END AS status FROM events),
  l AS (SELECT user_id, status, status = 403 AS blocked, coalesce(bool_or(status = 403) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS via FROM s)
  SELECT count_if(via) AS attempts, count_if(via AND status = 200) AS successes, count_if(NOT via) AS direct, count_if(NOT via AND blocked) AS retries, count(DISTINCT CASE WHEN via AND blocked THEN user_id END) AS failed_domains,
  array_to_string(list_sort(list(DISTINCT CAST(user_id AS VARCHAR)) FILTER (WHERE NOT via AND blocked)), ', ') AS needed, CAST(round_even(100 * count_if(via AND status = 200) / count_if(via), 0) AS BIGINT) AS pct FROM l""")
def proxy_stats(spark, d):
    status = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "signup", 404).otherwise(200)
    log = events(spark, d).withColumn("status", status)
    return stats.proxy_stats(stats.block_learning(log, "user_id", ["ts", "event_id"], F.col("status") == 403), "user_id", F.col("status"))


@query("""SELECT event_id FROM (SELECT event_id, coalesce(bool_or(event_type <> 'error') OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stored FROM events) WHERE NOT stored""")
def delta_skip(spark, d):
    return stats.not_stored_before(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], F.col("event_type") != "error").select("event_id")


@query("SELECT id FROM (SELECT id, id % 10 = 0 AS bypass, row_number() OVER (PARTITION BY url, id % 10 = 0 ORDER BY scraped_at, id) AS n FROM scraped_items) WHERE n = 1 OR bypass")
def dup_filter(spark, d):
    return stats.without_repeats(items(spark, d).select("id", "url", "scraped_at"), "url", F.col("id") % 10 == 0, ["scraped_at", "id"]).select("id")


@query("""WITH p AS (SELECT user_id AS k, CAST(extract(day FROM ts) AS INTEGER) AS page, event_type AS url FROM events), f AS (SELECT k, url, min(page) AS page FROM p GROUP BY 1, 2),
  e AS (SELECT p.k, p.page, count(f.url) AS n FROM (SELECT DISTINCT k, page FROM p) p LEFT JOIN f ON f.k = p.k AND f.page = p.page GROUP BY 1, 2),
  s AS (SELECT k, min(page) AS stop FROM e WHERE n = 0 AND page > 1 GROUP BY 1) SELECT e.k, e.page, e.n FROM e LEFT JOIN s ON s.k = e.k WHERE s.stop IS NULL OR e.page < s.stop""")
def paginator_stop(spark, d):
    pages = events(spark, d).select(F.col("user_id").alias("k"), F.dayofmonth("ts").alias("page"), F.col("event_type").alias("url"))
    return routing.first_seen_pages(pages, "k", "page", "url").select("k", "page", F.size("urls").cast("bigint").alias("n"))


@query("""SELECT id, CAST(length(content) AS BIGINT) AS n, (id % 50 = 0) OR content IS NULL OR trim(content, E' \t\r\n\f\v') = '' OR regexp_matches(lower(content), 'checking your browser|just a moment|cf-browser-verification|/cdn-cgi/challenge-platform|sorry, you have been blocked|attention required|error 1020|error 1015')
  OR (length(content) < 5000 AND contains(lower(content), 'cloudflare')) AS blocked FROM scraped_items""")
def blocked_pages(spark, d):
    status = F.when(F.col("id") % 50 == 0, 403).otherwise(200)
    return items(spark, d).select("id", F.length("content").cast("bigint").alias("n"), routing.blocked(status, F.col("content")).alias("blocked"))


@query("""WITH RECURSIVE c AS (SELECT id, id // 4 AS parent_id FROM crawl_queue), t AS (SELECT id, 0 AS depth FROM c WHERE parent_id = 0 UNION ALL SELECT c.id, t.depth + 1 FROM c JOIN t ON c.parent_id = t.id) SELECT id, depth FROM t""")
def comment_tree(spark, d):
    comments = queue(spark, d).select("id", F.floor(F.col("id") / 4).alias("parent_id"))
    return stats.comment_tree(comments).select("id", "depth")


@query("SELECT p.id, count(c.id) AS n, coalesce(string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.id), '') AS replies FROM crawl_queue p LEFT JOIN crawl_queue c ON c.id // 4 = p.id GROUP BY p.id")
def nested_replies(spark, d):
    comments = queue(spark, d).select("id", F.floor(F.col("id") / 4).alias("parent_id"))
    return stats.nested_replies(comments).select("id", F.size("replies").cast("bigint").alias("n"), F.array_join(F.col("replies").cast("array<string>"), ",").alias("replies"))


@query("""WITH j AS (SELECT event_id, 'job:' || event_type || ':u' || user_id AS label FROM events), l AS (SELECT split_part(label, ':', 2) AS project, split_part(label, ':', 3) AS spider, max(event_id) AS task FROM j GROUP BY 1, 2),
  f AS (SELECT event_type AS project, 'u' || user_id AS spider, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2) SELECT l.project, l.spider, l.task, coalesce(f.n, 0) AS n FROM l LEFT JOIN f ON f.project = l.project AND f.spider = l.spider""")
def job_newest(spark, d):
    ev = events(spark, d)
    jobs = ev.select("event_id", stats.label_parts(F.concat(F.lit("job:"), "event_type", F.lit(":u"), F.col("user_id").cast("string"))).alias("l"))
    newest = jobs.groupBy("l.project", "l.spider").agg(F.max("event_id").alias("task"))
    files = ev.where("value > 50").groupBy(F.col("event_type").alias("project"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("spider")).agg(F.count("*").alias("n"))
    return newest.join(files, ["project", "spider"], "left").select("project", "spider", "task", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_rates(spark, d):
    return events(spark, d).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events))
  SELECT user_id, min(ts) AS began, count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark, d):
    return events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.min("ts").alias("began")).select("user_id", "began", "n")


# HTML


def _pages(spark, d) -> DataFrame:
    """Pages made of the items' titles, urls and authors."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><head><title>x</title></head><body><nav><a href='/a'>A</a><li>m</nav><article><h1 class='t'>"), esc(F.col("title")), F.lit("</h1><p class='by'>"), esc(F.col("author")), F.lit("<p>"), esc(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")), F.lit("</p></article><a href='"), F.col("url"), F.lit("?a=1'>self</a></body>"))
    return items(spark, d).where("url IS NOT NULL").select("id", "url", html.alias("html"))


@query(r"SELECT id, nullif(coalesce(title, ''), '') AS title, nullif(regexp_replace(coalesce(author, ''), '^\s+|\s+$', '', 'g'), '') AS author, url || '?a=1' AS link FROM scraped_items WHERE url IS NOT NULL")
def html_fields(spark, d):
    fields = {"title": {"css": "article h1.t::text"}, "author": {"css": "p.by", "to_text": True, "own_text": True}, "link": {"xpath": "//body/a/@href"}}
    return _pages(spark, d).select("id", html_pages.extract(F.col("html"), fields).alias("x")).select("id", "x.*")


@query("SELECT id, regexp_extract(url, '^https?://[^/]+', 0) || '/a' AS first, url || '?a=1' AS second FROM scraped_items WHERE url IS NOT NULL")
def html_links(spark, d):
    found = _pages(spark, d).select("id", html_pages.page_links(F.col("url"), F.col("html")).alias("l"))
    return found.select("id", F.get("l", F.lit(0)).alias("first"), F.get("l", F.lit(1)).alias("second"))


def _bare(c: str) -> str:
    return rf"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _flat(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(coalesce({c}, ''), '([\x1c-\x1f]|{_SPACE})+', ' ', 'g'), '^ | $', '', 'g'), '')"


@query(f"""WITH p AS (SELECT id, nullif({_bare("coalesce(title, '')")}, '') AS head, {_flat("title")} AS t, {_flat("author")} AS a, {_flat("content")} AS c, coalesce(length(author), 0) + coalesce(length(content), 0) AS n FROM scraped_items WHERE url IS NOT NULL)
  SELECT id, CASE WHEN n > 0 AND coalesce(t, a, c) IS NOT NULL THEN coalesce(head, 'x') END AS title, CASE WHEN n > 0 THEN nullif(concat_ws(E'\n\n', t, a, c), '') END AS content, CASE WHEN n > 0 AND coalesce(t, a, c) IS NOT NULL THEN 'trafilatura' END AS source FROM p""")
def html_articles(spark, d):
    return _pages(spark, d).select("id", html_pages.articles(F.col("html")).alias("a")).select("id", "a.title", "a.content", "a.source")


@query(f"""SELECT url, 'parse_section_2' AS _callback, nullif(coalesce(title, ''), '') AS name, lower(nullif({_bare("coalesce(author, '')")}, '')) AS byline FROM scraped_items WHERE url LIKE '%/item/%' OR url LIKE '%/topic/%'""")
def html_records(spark, d):
    from webloom.plans.config import records as compiled

    by = {"css": "p.by", "to_text": True, "own_text": True, "processors": [{"type": "lowercase"}]}
    config = {"name": "demo", "source_url": "https://a.example/", "allowed_domains": ["a.example"], "start_urls": ["https://a.example/"], "sections": [{"match": ["/list/"], "priority": 9}, {"match": ["/item/", "/topic/"], "extract": {"name": {"css": "h1::text"}, "byline": by}}]}
    return compiled(_pages(spark, d).select("url", "html"), config)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS d, event_id % 2 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  t AS (SELECT user_id, n, event_id, CAST(0 AS INTEGER) AS lane, true AS opened, [struct_pack(d := d, s := s, l := CAST(0 AS INTEGER))] AS held FROM e WHERE n = 1
    UNION ALL SELECT user_id, n, event_id, lane, opened, list_append(list_filter(held, lambda x: x.l <> lane), struct_pack(d := d, s := s, l := lane)) FROM (
      SELECT user_id, n, event_id, d, s, held, CAST(CASE WHEN len(hit) > 0 THEN hit[1].l WHEN len(held) < 3 THEN len(held) ELSE held[1].l END AS INTEGER) AS lane, len(hit) = 0 OR hit[1].s <> s AS opened FROM (
        SELECT e.user_id, e.n, e.event_id, e.d, e.s, t.held, list_filter(t.held, lambda x: x.d = e.d) AS hit FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)))
  SELECT user_id, event_id, lane, opened FROM t""")
def lane_assignment(spark, d):
    log = events(spark, d).select("user_id", "event_id", "event_type", (F.col("event_id") % 2).alias("s"))
    return stats.lanes(log, "user_id", "event_id", "event_type", "s", 3)


@query("SELECT id, spider_id FROM (SELECT id, spider_id, row_number() OVER (PARTITION BY spider_id ORDER BY scraped_at, id) AS n FROM scraped_items) WHERE n <= 5")
def item_limit(spark, d):
    return stats.item_limit(items(spark, d).select("id", "spider_id", "scraped_at"), 5, ["scraped_at", "id"]).select("id", "spider_id")


@query(rf"""WITH r AS (SELECT id, spider_id, coalesce(allow_patterns, []) AS a, coalesce(deny_patterns, []) AS d, priority FROM spider_rules),
  u AS (SELECT id, spider_id, url || CASE id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG?x' ELSE '' END AS url FROM scraped_items),
  m AS (SELECT u.id, r.id AS rule_id, row_number() OVER (PARTITION BY u.id ORDER BY r.priority DESC, r.id) AS n FROM u JOIN r ON r.spider_id = u.spider_id
    WHERE NOT regexp_matches(lower({_PATH.format(c="u.url")}), '\.jpg$') AND (len(r.a) = 0 OR len(list_filter(r.a, lambda p: regexp_matches(u.url, p))) > 0) AND len(list_filter(r.d, lambda p: regexp_matches(u.url, p))) = 0)
  SELECT u.id, m.rule_id FROM u LEFT JOIN m ON m.id = u.id AND m.n = 1""")
def rule_route_endings(spark, d):
    """File endings that are no pages are taken by no rule; here PDFs are let through."""
    ending = F.when(F.col("id") % 3 == 0, ".pdf").when(F.col("id") % 3 == 1, ".JPG?x").otherwise("")
    links = items(spark, d).select("id", "spider_id", F.concat("url", ending).alias("url"))
    return routing.route(links, rules(spark, d), keep_pdf=True).select("id", "rule_id")


@query(rf"""SELECT id, {_HOST.format(c="url")} AS host, lower(regexp_replace(url, '[?#].*', '')) LIKE '%.pdf' AS pdf, translate(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[w.]+', ''), '.-', '__') AS spider,
  regexp_replace(coalesce(content, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') <> '' AS filled FROM scraped_items""")
def sql_functions(spark, d):
    """The engine's functions within SQL."""
    store.register_functions(spark)
    items(spark, d).createOrReplaceTempView("scraped_items")
    return store.checked_sql(spark, "SELECT id, url_host(url) AS host, url_is_pdf(url) AS pdf, spider_name(url) AS spider, has_text(content) AS filled FROM scraped_items")


# Free SQL

_SQL = {
    "sql_join": "SELECT n_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_semi_anti": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS late FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "sql_window": "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS r, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS q FROM lineitem",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_set_ops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "sql_full_join": "SELECT coalesce(s_nationkey, c_nationkey) AS k, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL OUTER JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey",
    "sql_cte": "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM t GROUP BY n",
    "sql_topk": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
}


def _sql(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        for name in ("orders", "customer", "nation", "region", "lineitem", "supplier", "part"):
            if name in text:
                table(spark, d, name).createOrReplaceTempView(name)
        return store.checked_sql(spark, text, ("orders", "customer", "nation", "region", "lineitem", "supplier", "part"))

    return run


for _name, _text in _SQL.items():
    QUERIES[_name] = _sql(_text)
    ORACLE_SQL[_name] = _text


@query("SELECT count(*) AS affected FROM crawl_queue WHERE status = 'failed' AND retry_count > 1")
def affected_rows(spark, d):
    queue(spark, d).createOrReplaceTempView("crawl_queue")
    return store.affected(spark, "UPDATE crawl_queue SET status = 'pending' WHERE status = 'failed' AND retry_count > 1")


def _changed(spark, d, statement: str) -> DataFrame:
    queue(spark, d).createOrReplaceTempView("crawl_queue")
    return store.rewritten(spark, statement)


@query("SELECT id, CASE WHEN status = 'failed' AND retry_count > 1 THEN 'pending, again' ELSE status END AS status, CASE WHEN status = 'failed' AND retry_count > 1 THEN priority + 1 ELSE priority END AS priority FROM crawl_queue")
def sql_update(spark, d):
    return _changed(spark, d, "UPDATE crawl_queue SET status = 'pending, again', priority = priority + 1 WHERE status = 'failed' AND retry_count > 1;").select("id", "status", "priority")


@query("SELECT id FROM crawl_queue WHERE NOT coalesce(status = 'completed' OR error_message LIKE '%timeout%', false)")
def sql_delete(spark, d):
    return _changed(spark, d, "delete from crawl_queue where status = 'completed' or error_message like '%timeout%'").select("id")


def _streamed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Events read as a stream of files, in one pass over what is there, through snapshots."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    read = spark.readStream.schema(events(spark, d).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")
    streams.to_snapshots(make(read), f"{root}/out", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out/*")


@query(ORACLE_SQL["block_learning"])
def stream_block_learning(spark, d):
    """The stateful stream gives what the batch form gives."""
    got = _streamed(spark, d, lambda s: streams.block_learning(s.withColumn("blocked", F.col("event_type") == "error"), "user_id", "blocked", ["ts", "event_id"]))
    return got.select("user_id", "event_id", "blocked", "via_proxy", "failed")


@query(ORACLE_SQL["delta_skip"])
def stream_delta_skip(spark, d):
    got = _streamed(spark, d, lambda s: streams.not_stored_before(s.withColumn("s", F.col("event_type") != "error"), ["user_id", "event_type"], "s", ["ts", "event_id"]))
    return got.select("event_id")


QUERIES |= timestamp_queries.QUERIES | cases.QUERIES
ORACLE_SQL |= cases.ORACLE_SQL

