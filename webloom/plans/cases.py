"""Queries over rows given as literals, with the rows they must give as literals in SQL.

They cover what the tables do not hold: pages with metadata and media, responses that
block, configurations, files, job runners' status.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import processors as proc
from webloom.functions import records, urls
from webloom.functions.html import pages as html
from webloom.operators import routing, stats, store
from webloom.plans import config
from webloom.session import shared_dir, stored
from webloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_SQL_TYPES = {"STRING": "VARCHAR", "BIGINT": "BIGINT", "INT": "INTEGER", "BOOLEAN": "BOOLEAN", "DOUBLE": "DOUBLE", "TIMESTAMP_NTZ": "TIMESTAMP"}


def _literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def case(columns: str, *expected: tuple):
    """Registers a function of a session under its name; ``expected`` are its rows."""
    names, kinds = zip(*(c.strip().split(" ") for c in columns.split(",")))
    rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in expected)
    cast = ", ".join(f'CAST("{n}" AS {_SQL_TYPES[k]}) AS "{n}"' for n, k in zip(names, kinds))
    named = ", ".join(f'"{n}"' for n in names)

    def put(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        QUERIES[f.__name__] = lambda spark, _: f(spark)
        ORACLE_SQL[f.__name__] = f"SELECT {cast} FROM (VALUES {rows}) t({named})"
        return f

    return put


def _rows(spark: SparkSession, columns: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), columns)


def _pages(spark: SparkSession, *texts: str) -> DataFrame:
    return _rows(spark, "id BIGINT, html STRING", *enumerate(texts, 1))


# Responses

_BIG = "x" * 5000


@case("id BIGINT, transport BOOLEAN, handler BOOLEAN", (1, True, False), (2, True, False), (3, True, True), (4, True, True), (5, True, True), (6, True, True), (7, False, False), (8, False, False), (9, True, True), (10, False, True), (11, True, True), (12, True, False), (13, False, True), (14, True, False))
def blocked_responses(spark):
    """By status, blank, by marker, short with the shield's name; articles that speak of it are none."""
    bodies = [(1, 403, "text"), (2, 503, "text"), (3, 200, ""), (4, None, "Sorry, you have been blocked"), (5, 200, "error 1020 " + _BIG), (6, 200, "a short page about Cloudflare"), (7, 404, "not there"), (8, 200, "an article that mentions captcha, access denied and unusual traffic"), (9, 200, None), (10, 200, _BIG + "Access denied by cloudflare"), (11, 200, _BIG + "Checking your browser cloudflare"), (12, 200, "see /cdn-cgi/challenge-platform"), (13, 404, "This requires JavaScript: prove you are not a robot"), (14, 200, " \n\t")]
    rows = _rows(spark, "id BIGINT, status INT, body STRING", *bodies)
    return rows.select("id", routing.blocked(F.col("status"), F.col("body")).alias("transport"), routing.challenged(F.col("body")).alias("handler"))


@case("id BIGINT, expired BOOLEAN, never BOOLEAN", (1, True, False), (2, False, False), (3, False, False))
def expired_sessions(spark):
    rows = _rows(spark, "id BIGINT, body STRING", (1, "<p>Please log in to read on</p>"), (2, "<p>text</p>"), (3, None))
    return rows.select("id", routing.session_expired(F.col("body"), "Please log in").alias("expired"), routing.session_expired(F.col("body"), None).alias("never"))


@case("attempts BIGINT, successes BIGINT, direct BIGINT, retries BIGINT, needed STRING, failed_domains BIGINT, pct BIGINT", (4, 2, 4, 2, "a.example, b.example", 1, 50))
def proxy_log(spark):
    """Only status 200 through the proxy is a success; 404 is neither block nor success."""
    log = _rows(spark, "n INT, domain STRING, status INT", (1, "b.example", 403), (2, "b.example", 200), (3, "a.example", 429), (4, "a.example", 503), (5, "a.example", 404), (6, "a.example", 200), (7, "c.example", 404), (8, "c.example", 200))
    learned = stats.block_learning(log, "domain", ["n"], F.col("status").isin(*routing.BLOCK_STATUS))
    return stats.proxy_stats(learned, "domain", F.col("status"))


# URLs, rules and listings


@case("url STRING, by_rules STRING, free STRING, only_follow STRING", ("https://a.example/", None, "parse_article", None), ("https://a.example/story/1", "parse_article", "parse_article", None), ("https://a.example/item/2", "parse_item", "parse_article", None))
def start_urls(spark):
    rules = [{"allow": ["/story/"], "callback": "parse_article"}, {"allow": ["/item/"], "deny": ["."], "callback": "parse_item", "priority": 5}, {"callback": None}]
    rows = _rows(spark, "url STRING", ("https://a.example/",), ("https://a.example/story/1",), ("https://a.example/item/2",))
    u = F.col("url")
    return rows.select(u, routing.start_content(u, rules).alias("by_rules"), routing.start_content(u, []).alias("free"), routing.start_content(u, [{"callback": None}]).alias("only_follow"))


_HOSTS = {"http://a.example/": True, "https://8.8.8.8/": True, "http://127.0.0.1/": False, "http://localhost:80/": False, "http://0x7f000001/": False, "http://2130706433/": False, "http://0177.0.0.1/": False, "http://127.1/": False, "http://10.1/": False, "http://[::1]/": False, "http://[::ffff:192.168.0.1]/": False, "http://172.20.0.1/": False, "http://172.32.0.1/": True, "http://169.254.169.254/": False, "http://a.127.example/": True, "ftp://a.example/": False, "http://134744072/": True, "https://": False}


@case("url STRING, fetchable BOOLEAN", *_HOSTS.items())
def fetchable_urls(spark):
    rows = _rows(spark, "url STRING", *((u,) for u in _HOSTS))
    return rows.select("url", urls.fetchable(F.col("url")).alias("fetchable"))


@case("url STRING, title STRING, day STRING, site STRING, ignored BOOLEAN, kept BOOLEAN", ("https://a.example/x/a+b%20c.pdf?q", "a+b c.pdf", None, None, True, False), ("https://web.example/web/20240131123456/https://www.a.example/x", "x", "20240131", "a.example", False, False), ("https://a.example/pic.JPG", "pic.JPG", None, None, True, True), ("https://a.example/", "https://a.example/", None, None, False, False))
def url_parts(spark):
    u = F.col("url")
    rows = _rows(spark, "url STRING", ("https://a.example/x/a+b%20c.pdf?q",), ("https://web.example/web/20240131123456/https://www.a.example/x",), ("https://a.example/pic.JPG",), ("https://a.example/",))
    old = urls.archived(u)
    return rows.select(u, urls.pdf_title(u).alias("title"), old["day"].alias("day"), old["site"].alias("site"), urls.has_ignored_ending(u).alias("ignored"), urls.has_ignored_ending(u, keep_pdf=True).alias("kept"))


@case("base STRING, link STRING, url STRING", ("https://a.example/x/y", "b", "https://a.example/x/b"), ("https://a.example/x/y", "../f", "https://a.example/f"), ("https://a.example/x/y", "/c", "https://a.example/c"), ("https://a.example/x/y", "//d.example/e", "https://d.example/e"), ("https://a.example/x/y", "https://g.example/", "https://g.example/"), ("https://a.example/x/y", None, None))
def absolute_urls(spark):
    base = "https://a.example/x/y"
    rows = _rows(spark, "base STRING, link STRING", *((base, x) for x in ("b", "../f", "/c", "//d.example/e", "https://g.example/", None)))
    return rows.select("base", "link", urls.absolute(F.col("base"), F.col("link")).alias("url"))


_SITE = """<html><head><link rel="next" href="/page/2"></head><body><nav><a href="/about">x</a><a href="/a.pdf">p</a></nav>
<div class="list"><a href="/story/1">1</a><a href="/story/1">again</a><a href="/story/secret">s</a><a href="/pic.jpg">i</a></div><ul id="more"><li><a href="/item/7?b=1">7</a></ul><area href="/map">"""
_RULES = [{"allow": ["/story/"], "deny": ["secret"], "callback": "parse_article", "restrict_css": [".list"], "follow": False}, {"callback": None}, {"allow": ["/item/"], "restrict_xpaths": ["//ul[@id='more']"], "callback": "parse_item", "priority": 9}, {"allow": ["/page/"], "tags": ["link"], "callback": None, "priority": 1}]


@case("url STRING, rule INT, callback STRING, follow BOOLEAN", ("https://a.example/story/1", 0, "parse_article", False), ("https://a.example/item/7?b=1", 2, "parse_item", True), ("https://a.example/page/2", 3, None, True), ("https://a.example/about", 1, None, True), ("https://a.example/map", 1, None, True), ("https://a.example/story/secret", 1, None, True), ("https://a.example/a.pdf", 1, None, True))
def followed_links(spark):
    """Regions, tags and denied endings of rules; the first rule by priority takes a link."""
    pages = _rows(spark, "url STRING, html STRING", ("https://a.example/", _SITE))
    return routing.followed(pages, _RULES, keep_pdf=True).drop("page")


@case("url STRING, depth INT", ("a", 0), ("b", 1), ("c", 2))
def depth_limit(spark):
    links = _rows(spark, "page STRING, url STRING", ("a", "b"), ("b", "c"), ("b", "a"), ("c", "d"), ("x", "y"))
    return routing.reachable(links, _rows(spark, "url STRING", ("a",)), 2)


@case("k STRING, page INT, urls STRING", ("a", 1, "u1"), ("a", 2, "u2"), ("b", 1, "v1"), ("c", 1, "w1"), ("c", 2, "w2"))
def listing_stops(spark):
    """Without a new address, at the most pages, and where there is no next page."""
    rows = [("a", 1, "u1"), ("a", 2, "u2"), ("a", 3, "u1"), ("a", 4, "u9"), ("b", 1, "v1"), ("b", 2, "v2"), ("c", 1, "w1"), ("c", 2, "w2"), ("c", 3, "w3"), ("c", 4, "w4")]
    last = _rows(spark, "k STRING, page INT", ("b", 1), ("c", 2))
    got = routing.first_seen_pages(_rows(spark, "k STRING, page INT, url STRING", *rows), "k", "page", "url", most=3, last=last)
    return got.select("k", "page", F.array_join("urls", ",").alias("urls"))


@case("k STRING, page INT", ("a", 1), ("a", 2), ("b", 1), ("d", 1))
def api_pages(spark):
    """Pages are fetched while they are full; an empty one ends them."""
    rows = _rows(spark, "k STRING, page INT, n INT", ("a", 1, 10), ("a", 2, 4), ("a", 3, 10), ("b", 1, 10), ("b", 2, 0), ("b", 3, 10), ("c", 1, 0), ("d", 1, 3))
    return routing.full_pages(rows, "k", "page", "n", 10).select("k", "page")


@case("url STRING, form STRING, method STRING, callback STRING, dont_filter BOOLEAN", ("https://a.example/s", "x", "POST", "parse_article", True), ("https://a.example/s", "y", "POST", "parse_article", True), ("https://a.example/1", None, "GET", None, False))
def seed_requests(spark):
    posts = routing.generated(spark, "https://a.example/s", {"k": {"values": ["x", "y"]}}, {"q": "{k}"})
    gets = routing.generated(spark, "https://a.example/{n}", {"n": {"type": "range", "from": 1, "to": 1}}, follow=True)
    return posts.unionByName(gets).select("url", F.col("formdata")["q"].alias("form"), "method", "callback", "dont_filter")


@case("loc STRING, kept BOOLEAN, denied BOOLEAN, old BOOLEAN, no_lastmod BOOLEAN, rewritten BOOLEAN", ("https://a.example/x", True, False, False, True, True), ("https://b.example/y", True, False, False, False, True), ("https://c.example/old", False, False, True, False, False), ("https://c.example/f.pdf", False, True, False, False, False), ("https://c.example/index.pdf", True, False, False, False, False), ("https://c.example/odd", True, False, False, False, False))
def sitemap_flags(spark):
    """Absolute addresses first; unreadable dates stay; an index is never denied."""
    rows = [("/x", None, "urlset"), ("//b.example/y", "2026-02-01", "urlset"), ("https://c.example/old", "2020-01-01T00:00:00+02:00", "urlset"), ("https://c.example/f.pdf", "2026-02-01", "urlset"), ("https://c.example/index.pdf", "2026-02-01", "sitemapindex"), ("https://c.example/odd", "soon", "urlset")]
    entries = _rows(spark, "loc STRING, lastmod STRING, type STRING", *rows)
    seen = routing.sitemap_entries(entries, since=records.since("1y", F.lit("2026-03-01").cast("timestamp_ntz")), deny=[r"\.pdf$", "("], base=F.lit("https://a.example/sitemap.xml"))
    return seen.select("loc", "kept", "denied", "old", "no_lastmod", "rewritten")


# Texts and values


@case("raw STRING, clean STRING", ("scar­city", "scarcity"), ("scar­\ncity", "scarcity"), ("cli-\nmate change is\nhappening.\nNew Section", "climate change is happening.\nNew Section"), ("would \r not have \r\nbeen possible", "would not have been possible"), ("one;\ntwo", "one;\ntwo"), ("a word-  \n  part\n   next", "a wordpart next"), ("End.\n  Ähnlich\n\n\n\nétat", "End.\nÄhnlich\n\nétat"), ("well-\n\nknown", "well-\n\nknown"))
def pdf_texts(spark):
    raw = ["scar­city", "scar­\ncity", "cli-\nmate change is\nhappening.\nNew Section", "would \r not have \r\nbeen possible", "one;\ntwo", "a word-  \n  part\n   next", "End.\n  Ähnlich\n\n\n\nétat", "well-\n\nknown"]
    return _rows(spark, "raw STRING", *((r,) for r in raw)).select("raw", records.clean_pdf_text(F.col("raw")).alias("clean"))


@case("id BIGINT, text STRING", (1, ""), (2, ""), (3, ""))
def pdf_bytes(spark):
    """Bytes that are no PDF, none and empty ones have no text."""
    rows = _rows(spark, "id BIGINT, data BINARY", (1, bytearray(b"this is not a pdf")), (2, bytearray(b"")), (3, None))
    return rows.select("id", records.pdf_text(F.col("data")).alias("text"))


@case("v STRING, optional STRING, empty STRING, bad STRING, missing STRING", ("ab", "b", "", "ab", "ab"), ("a", None, "", "a", "a"), ("x", "x", "x", "x", "x"), (None, None, None, None, None))
def regex_groups(spark):
    """An optional group that stayed out is null, one that matched nothing is empty."""
    v = F.col("v")
    rows = _rows(spark, "v STRING", ("ab",), ("a",), ("x",), (None,))
    return rows.select(v, proc.regex(v, "a(b)?").alias("optional"), proc.regex(v, "a(c*)|z").alias("empty"), proc.regex(v, "(a").alias("bad"), proc.regex(v, "a", 3).alias("missing"))


@case("id BIGINT, texts STRING, flags STRING, numbers STRING, lows STRING, filled STRING", (1, "a-b", "True-False", "1.0-2.5", "x", "a"), (2, "", "", "", "", "none"))
def list_steps(spark):
    rows = _rows(spark, "id BIGINT, t ARRAY<STRING>, b ARRAY<BOOLEAN>, d ARRAY<DOUBLE>, u ARRAY<STRING>", (1, ["a", None, "b"], [True, False], [1.0, 2.5], [" X "]), (2, [], [], [], []))
    filled = proc.default(proc.join(F.slice("t", 1, 1)), "none")
    lows = proc.chain(F.col("u"), [{"type": "strip"}, {"type": "lowercase"}, {"type": "join"}], many=True)
    return rows.select("id", proc.join(F.col("t"), "-").alias("texts"), proc.join(F.col("b"), "-").alias("flags"), proc.join(F.col("d"), "-").alias("numbers"), lows.alias("lows"), filled.alias("filled"))


_DATES = {"2026-02-22": "2026-02-22 00:00:00", "February 22, 2026": "2026-02-22 00:00:00", "22 février 2026 à 18h45": "2026-02-22 18:45:00", "02/03/2026": "2026-02-03 00:00:00", "2026-02-22T11:00:00-05:00": "2026-02-22 16:00:00", "Sun, 22 Feb 2026 10:00:00 GMT": "2026-02-22 10:00:00", "1771754400": "2026-02-22 10:00:00", "2026-02-22 14:43 Europe/Paris": "2026-02-22 13:43:00", "2 weeks ago": "2026-02-15 12:00:00", "yesterday": "2026-02-28 12:00:00", "a month ago": "2026-02-01 12:00:00", "no date": None, "31/31/2026": None, "": None}


@case("v STRING, moment TIMESTAMP_NTZ", *_DATES.items())
def free_dates(spark):
    rows = _rows(spark, "v STRING", *((v,) for v in _DATES))
    return rows.select("v", proc.parse_datetime(F.col("v"), as_of=F.lit("2026-03-01 12:00:00").cast("timestamp_ntz")).alias("moment"))


@case("id BIGINT, listed STRING, deep STRING, names STRING, utc STRING", (1, "x", "1", "A, B", "2026-02-22T16:00:00"), (2, None, None, None, None), (3, None, '"y"', None, None))
def json_values(spark):
    rows = _rows(spark, "id BIGINT, j STRING, n ARRAY<STRING>", (1, '{"a": [{"b": "x"}], "q": {"k": 1}, "k": 0, "t": "2026-02-22T11:00:00-05:00"}', ["A ", "http://x", "B", "A"]), (2, "broken{", [""]), (3, '{"a": [], "z": [{"k": ""}, {"k": "y"}]}', None))
    utc = F.date_format(proc.parse_datetime(records.json_at(F.col("j"), "t")), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select("id", records.json_at(F.col("j"), "a.0.b").alias("listed"), records.key_anywhere(F.col("j"), "k").alias("deep"), records.joined_authors(F.col("n")).alias("names"), utc.alias("utc"))


@case("id BIGINT, long STRING, list STRING, query STRING, stamp STRING", (1, "a" * 100 + "...", "[4 items]", "a=1+2&b=%C3%A4", "22022026"), (2, "short", '["x"]', "", "01012025"))
def shown_values(spark):
    rows = _rows(spark, "id BIGINT, t STRING, l ARRAY<STRING>, m MAP<STRING, STRING>, d STRING", (1, "a" * 101, ["a", "b", "c", "d"], {"a": "1 2", "b": "ä"}, "2026-02-22"), (2, "short", ["x"], {}, "2025-01-01"))
    return rows.select("id", records.truncated(F.col("t")).alias("long"), records.truncated_list(F.col("l")).alias("list"), records.query_string(F.col("m")).alias("query"), records.crawl_stamp(F.col("d").cast("timestamp")).alias("stamp"))


# Pages

_DATED = {
    '<meta property="article:published_time" content="2026-02-22T11:00:00-05:00"><time datetime="2020-01-01">': "2026-02-22T16:00:00",
    '<script type="application/ld+json">{"@graph": [{"x": 1}, {"datePublished": "2026-02-22T10:00:00Z"}]}</script>': "2026-02-22T10:00:00",
    '<script type="application/ld+json">broken</script><meta itemprop="datePublished" content="2026-02-21">': "2026-02-21T00:00:00",
    '<article><time datetime="2026-02-20T08:00">x</time></article>': "2026-02-20T08:00:00",
    '<meta property="article:published_time" content="junk"><time datetime="2026-01-01">': None,
    "<p>2026-02-22</p>": None,
    "": None,
}


@case("id BIGINT, moment STRING", *((n, d) for n, d in enumerate(_DATED.values(), 1)))
def meta_dates(spark):
    """Open Graph, then linked data, microdata, times; none follows one that cannot be read."""
    return _pages(spark, *_DATED).select("id", html.per_page(F.col("html"), html.meta_date).alias("moment"))


_LD = '<script type="application/ld+json">{"author": %s}</script>'
_AUTHORED = {_LD % '{"name": "Jane Roe"}': "Jane Roe", _LD % '"Jane Roe"': "Jane Roe", _LD % '[{"name": "A"}, "B", {"name": "A"}, {"name": "https://x.example"}]': "A, B", '<span itemprop="author">C D</span>': "C D", _LD % '"https://x.example/me"': None, "<p>by X</p>": None}


@case("id BIGINT, author STRING", *((n, a) for n, a in enumerate(_AUTHORED.values(), 1)))
def meta_authors(spark):
    return _pages(spark, *_AUTHORED).select("id", html.per_page(F.col("html"), html.meta_author).alias("author"))


_TEXT = '<div class="body">direct<p>Hello <b>world</b></p><p> Second para </p></div><h1>Title</h1>'


@case("strict STRING, own STRING, path STRING, pseudo STRING, title STRING, owned STRING, markdown STRING, every STRING, attr STRING", ("Hello world Second para", "direct Hello world Second para", "direct Hello world Second para", "direct", None, "Title", "direct\n\nHello **world**\n\nSecond para", '["Hello ", " Second para "]', "body"))
def text_fields(spark):
    """CSS text leaves out what stands directly in the match, XPath does not."""
    fields = {
        "strict": {"css": ".body", "to_text": True},
        "own": {"css": ".body", "to_text": True, "own_text": True},
        "path": {"xpath": "//div[@class='body']", "to_text": True},
        "pseudo": {"css": ".body::text", "to_text": True},
        "title": {"css": "h1", "to_text": True},
        "owned": {"css": "h1", "to_text": True, "own_text": True},
        "markdown": {"css": ".body", "to_markdown": True},
        "every": {"css": "p::text", "get_all": True},
        "attr": {"css": "div::attr(class)"},
    }
    return _pages(spark, _TEXT).select(html.extract(F.col("html"), fields).alias("x")).select("x.*")


_SHOP = '<div class="item"><h2>Product A</h2><span class="price" data-v="1"> $10 </span><ul><li>r</li><li>g</li></ul></div><div class="item"><h2>Product B</h2><span class="price">$20</span></div>'
_ROW = {"name": {"css": "h2::text"}, "price": {"css": ".price::text", "processors": [{"type": "strip"}, {"type": "regex", "pattern": r"\$(\d+)"}, {"type": "cast", "to": "int"}]}, "colours": {"type": "nested_list", "selector": "li", "extract": {"c": {"css": "::text"}}}}


@case("rows STRING, path STRING, deep STRING, none STRING", ('[{"name": "Product A", "price": 10, "colours": [{"c": "r"}, {"c": "g"}]}, {"name": "Product B", "price": 20, "colours": []}]', "$20", '[{"x": [{"x": [{"x": []}]}]}]', "[]"))
def nested_rows(spark):
    """Rows within rows, each field through its processors; the fourth level is empty."""
    level: dict[str, Any] = {"type": "nested_list", "selector": "b, i, u, s", "extract": {"t": {"css": "::text"}}}
    deep = {"type": "nested_list", "selector": "html > b", "extract": {"x": {"type": "nested_list", "selector": "i", "extract": {"x": {"type": "nested_list", "selector": "u", "extract": {"x": level}}}}}}
    fields = {"rows": {"type": "nested_list", "selector": ".item", "extract": _ROW}, "path": {"xpath": "//h2[text()='Product B']/following-sibling::span[1]/text()"}, "deep": deep, "none": {"type": "nested_list", "selector": ".no", "extract": _ROW}}
    return _pages(spark, f"<html>{_SHOP}<b><i><u><s>t</s></u></i></b></html>").select(html.extract(F.col("html"), fields).alias("x")).select("x.*")


@case("id BIGINT, images STRING, videos STRING, hint STRING, links STRING, pdfs STRING", (1, '[{"src": "i.png", "alt": "A"}, {"src": "j.png", "alt": ""}]', '[{"src": "v.mp4", "type": "video"}, {"src": "https://t.example/e", "type": "iframe"}]', "A & B", "/a,/d.pdf?x,/e.PDF", '[{"url": "https://a.example/d.pdf?x", "title": "d.pdf", "content": "", "metadata": {"content_type": "pdf", "found_on": "https://a.example/p"}}, {"url": "https://a.example/e.PDF", "title": "e.PDF", "content": "", "metadata": {"content_type": "pdf", "found_on": "https://a.example/p"}}]'), (2, "[]", "[]", None, "", "[]"))
def page_parts(spark):
    """Media, title, links and the PDFs a page links to."""
    page = '<title>A &amp; B</title><img src="i.png" alt="A"><img alt="no"><img src="j.png"><video src="v.mp4"></video><iframe src="https://t.example/e"></iframe><a href="/a">1</a><a href="/d.pdf?x">2</a><a href="/a">3</a><a href="/e.PDF">4</a><a>5</a>'
    h, base = F.col("html"), "https://a.example/p"
    part = lambda k: html.per_page(h, lambda root: html.media(root)[k])
    links = F.array_join(html.page_links(F.lit(""), h), ",")
    return _pages(spark, page, "").select("id", part("images").alias("images"), part("videos").alias("videos"), html.per_page(h, html.title_hint).alias("hint"), links.alias("links"), html.per_page(h, lambda root: html.pdf_items(root, base)).alias("pdfs"))


_ARTICLE = '<html><head><title>Hint</title><meta name="description" content="D"><meta property="og:site_name" content="Site"><meta property="og:image" content="o.png"><meta name="keywords" content="k1, k2"><meta property="article:tag" content="t"></head><body><nav><a href="/">n</a></nav><article>%s<p>Some long text of the article.</p><p>More of it.</p><img src="i.png"></article><img src="side.png"></body></html>'
_CUSTOM = '<h1 class="t">Own title</h1><div class="c"><p>Own text</p></div><span class="d">Published on 22 February 2026</span><span class="w">Jane</span><b class="s">4</b>'
_CHOSEN = {"title": ".t", "content": ".c", "date": ".d", "author": ".w", "stars": ".s", "none": ".x"}


@case("id BIGINT, custom STRING, by_default STRING, strict STRING", (1, "custom|Own title|Own text|Jane|2026-02-22T00:00:00|{\"stars\": \"4\"}", "Own title|", "Own title|{\"keywords\": [], \"summary\": \"\"}|0"), (2, "trafilatura|Head|Head\n\nSome long text of the article.\n\nMore of it.|||{\"description\": \"D\", \"sitename\": \"Site\", \"categories\": [], \"tags\": [\"t\"], \"license\": null}", "Head|o.png|[{\"src\": \"i.png\", \"alt\": \"\"}]", "Head|{\"keywords\": [\"k1\", \"k2\"], \"summary\": \"D\"}|2"), (3, None, None, None), (4, "trafilatura||Some long text of the article.\n\nMore of it.|||{\"description\": null, \"sitename\": null, \"categories\": [], \"tags\": [], \"license\": null}", "|", None))
def readers(spark):
    """Selectors first, then the default order; a page without text has no record, one
    without a title only by the reader that needs none."""
    bare = "<div><p>Some long text of the article.</p><p>More of it.</p></div>"
    pages = _pages(spark, _CUSTOM, _ARTICLE % "<h1>Head</h1>", "<p>", bare)

    def first(root):
        got = html.first_accepted(root, ["custom", "unknown", "trafilatura"], None, _CHOSEN)
        meta = {k: v for k, v in got["metadata"].items() if k != "fingerprint"} if got else None
        return got and "|".join([got["source"], got["title"], got["content"], got["author"] or "", got["published_date"] or "", json.dumps(meta)])

    def default(root):
        got = html.first_accepted(root)
        return got and "|".join([got["title"], got["top_image"] or "", *([json.dumps(got["images"])] if got["images"] else [])])

    def strict(root):
        got = html.first_accepted(root, ["newspaper"])
        return got and "|".join([got["title"], json.dumps(got["metadata"]), str(len(got["images"]))])

    return pages.select("id", *[html.per_page(F.col("html"), f).alias(n) for n, f in (("custom", first), ("by_default", default), ("strict", strict))])


@case("found STRING, keyword STRING, heads STRING, containers STRING, dates STRING, longer BOOLEAN", ('[{"selector": "h1#top", "text": "Flood barrier"}, {"selector": "p.note", "text": "The flood barrier is new"}]', '[{"selector": "span.price", "text": "$10"}, {"selector": "span.price.old", "text": "$12"}]', '["Flood barrier"]', "article", "22 Feb", True))
def page_analysis(spark):
    """What helps to write selectors, and two readers side by side."""
    page = '<h1 id="top">Flood barrier</h1><p class="note">The flood barrier is new</p><span class="price">$10</span><span class="price old">$12</span><time class="d">22 Feb</time><article><p>' + "word " * 60 + "</p></article>"
    h = F.col("html")
    at = lambda f: html.per_page(h, f)
    longer = html.per_page(h, lambda r: str(html.compared(r)["trafilatura"]["length"] > 250)).cast("boolean")
    return _pages(spark, page).select(at(lambda r: html.found_by_text(r, " FLOOD ")).alias("found"), at(lambda r: html.found_by_keyword(r, "price")).alias("keyword"), at(lambda r: html.structure(r)["h1"]).alias("heads"), at(lambda r: html.structure(r)["containers"][0]["selector"]).alias("containers"), at(lambda r: html.structure(r)["dates"][0]["text"]).alias("dates"), longer.alias("longer"))


# Interfaces

_POSTS = {"data": {"posts": [{"id": 1, "t": {"r": "<b>One</b> "}, "p": "$5"}, {"id": 2, "t": {}, "p": None}]}}
_POST = {"key": {"json_path": "id", "processors": [{"type": "cast", "to": "int"}]}, "title": {"json_path": "t.r"}, "price": {"json_path": "p", "processors": [{"type": "replace", "old": "$"}, {"type": "cast", "to": "float"}]}, "left_out": {"css": "p"}}


@case("body BIGINT, key BIGINT, title STRING, price DOUBLE", (1, 1, "One", 5.0), (1, 2, None, None))
def json_lists(spark):
    bodies = _rows(spark, "body BIGINT, text STRING", (1, json.dumps(_POSTS)), (2, "broken"), (3, '{"data": {"posts": {}}}'), (4, '{"data": {"posts": []}}'))
    return bodies.select("body", F.explode(config.json_rows(F.col("text"), _POST, "data.posts")).alias("r")).select("body", "r.*")


@case("body BIGINT, first STRING, name STRING", (1, "a", "N"), (2, None, None), (3, None, "M"))
def json_objects(spark):
    bodies = _rows(spark, "body BIGINT, text STRING", (1, '{"d": {"l": ["a", "b"], "n": "<i>N</i>"}}'), (2, '{"d": []}'), (3, '{"d": {"l": [], "n": "M"}}'))
    got = config.json_record(F.col("text"), {"first": {"json_path": "l.0"}, "name": {"json_path": "n"}}, "d")
    return bodies.select("body", got.alias("r")).select("body", "r.first", "r.name")


@case("body BIGINT, rows STRING", (1, '[{"comment_id": "1", "parent_id": "0", "replies": [{"comment_id": "2", "parent_id": "1", "replies": [{"comment_id": "3", "parent_id": "2", "replies": []}]}]}, {"comment_id": "9", "parent_id": "8", "replies": []}]'), (2, "[]"))
def json_comments(spark):
    """HTML within JSON as nested rows, replies under what they answer."""
    tags = "".join(f'<p id="{i}" data-p="{p}">x</p>' for i, p in (("1", "0"), ("2", "1"), ("3", "2"), ("9", "8")))
    wanted = {"selector": "p", "extract": {"comment_id": {"css": "::attr(id)"}, "parent_id": {"css": "::attr(data-p)"}}, "nest_replies": True}
    bodies = _rows(spark, "body BIGINT, text STRING", (1, json.dumps({"d": {"h": tags}})), (2, "{}"))
    return bodies.select("body", config.json_nested(F.col("text"), wanted, "d.h").alias("rows"))


# Configurations

_BASE = {"name": "demo", "source_url": "https://a.example/", "allowed_domains": ["a.example"], "start_urls": ["https://a.example/"]}
_LISTING = '<table><tr class="r"><td class="n">1</td><td><a href="/d/1">x</a></td></tr><tr class="r"><td class="n">2</td><td>no link</td></tr><tr class="r"><td class="n">3</td><td><a href="/d/3">y</a></td></tr></table>'
_WALK = {**_BASE, "rules": [{"allow": ["/list/"], "callback": "parse_list"}], "callbacks": {"parse_list": {"extract": {"rank": {"css": ".n::text"}, "name": {"css": "a::text"}}, "iterate": {"selector": "tr.r", "follow": {"url": {"css": "a::attr(href)"}, "callback": "parse_detail"}, "url_context": {"country": {"regex": "/list/([a-z]+)"}, "rank": {"regex": "top(\\d+)"}}}}, "parse_detail": {"extract": {"name": {"css": "h1::text"}, "price": {"css": ".p::text", "processors": [{"type": "cast", "to": "int"}]}}}}}


@case("url STRING, _callback STRING, rank STRING, name STRING, country STRING, price BIGINT", ("https://a.example/d/1", "parse_detail", None, "Detail", "de", 7), ("https://a.example/d/3", "parse_detail", None, None, "de", None))
def listing_details(spark):
    """Rows without an address are skipped; the listing's URL wins over the row, the detail
    page over both, its nulls too."""
    pages = _rows(spark, "url STRING, html STRING", ("https://a.example/list/de", _LISTING), ("https://a.example/d/1", '<h1>Detail</h1><b class="p">7</b>'), ("https://a.example/d/3", "<p>"), ("https://a.example/d/9", "<h1>other</h1>"))
    return config.records(pages, _WALK)


_ASKED = {**_BASE, "rules": [{"callback": "parse_item"}], "callbacks": {"parse_item": {"extract": {"name": {"css": "h1::text"}, "votes": {"type": "ajax_nested_list", "ajax_url": "/v", "selector": "x", "response_type": "json_array", "response_json_field": "d", "extract": {"n": {"json_path": "n"}}}, "more": {"type": "ajax_nested_list", "ajax_url": "/m", "selector": "x", "response_type": "json_object", "extract": {"stock": {"json_path": "s.0"}, "name": {"json_path": "name"}}}, "notes": {"type": "ajax_nested_list", "ajax_url": "/c", "selector": "p", "response_json_field": "html", "extract": {"t": {"css": "::text"}}}}}}}


@case("url STRING, name STRING, votes STRING, stock STRING, notes STRING", ("https://a.example/1", "Over", '[{"n":"1"},{"n":"2"},{"n":null}]', "7", '[{"t": "a"}, {"t": "b"}]'), ("https://a.example/2", "Two", None, None, "[]"))
def interface_fields(spark):
    """Lists of several answers in order, an object merged flat, HTML within JSON; a page
    without answers keeps what it has."""
    pages = _rows(spark, "url STRING, html STRING", ("https://a.example/1", "<h1>One</h1>"), ("https://a.example/2", "<h1>Two</h1>"))
    told = [("votes", 2, '{"d": [{"x": 1}]}'), ("votes", 1, '{"d": [{"n": 1}, {"n": 2}]}'), ("more", 1, '{"s": [7], "name": "Over"}'), ("notes", 1, '{"html": "<p>a</p><p>b</p>"}'), ("other", 1, "{}")]
    answers = _rows(spark, "url STRING, field STRING, page INT, body STRING", *(("https://a.example/1", *t) for t in told))
    return config.records(pages, _ASKED, responses=answers).drop("_callback")


_FIELDS = {"title": {"css": "h9::text"}, "byline": {"from": "author"}, "image": {"from": "top_image"}, "tags": {"css": "i::text", "get_all": True, "processors": [{"type": "join", "separator": "+"}]}, "price": {"css": ".p::text", "processors": [{"type": "regex", "pattern": r"(\d+)"}, {"type": "cast", "to": "int"}]}}
_SCHEMA = [{"name": n} for n in ("title", "content", "byline", "image", "tags", "price", "sku")]


@case("url STRING, _callback STRING, source STRING, title STRING, content STRING, byline STRING, image STRING, tags STRING, price BIGINT, sku STRING", ("https://a.example/story/1", "parse_article", "trafilatura", "Head", "Head\n\nSome long text of the article.\n\nMore of it.", None, "o.png", "", None, None), ("https://a.example/item/2", "parse_section_2", None, "Item", None, None, None, None, None, None))
def record_fields(spark):
    """Core fields survive a directive that finds nothing; other extras are pruned, schema
    fields nobody fills are null; ``from`` copies what the reader found."""
    sections = {**_BASE, "settings": {"FIELDS": _FIELDS}, "sections": [{"match": ["/story/"], "extract": "auto"}, {"match": ["/item/"], "extract": {"title": {"css": "h1::text"}, "extra": {"css": "p::text"}}}, {"match": ["/list/"]}]}
    pages = _rows(spark, "url STRING, html STRING", ("https://a.example/story/1", _ARTICLE % "<h1>Head</h1>"), ("https://a.example/item/2", "<h1>Item</h1><p>x</p>"), ("https://a.example/list/3", _LISTING), ("https://a.example/story/4", "<p>"))
    return config.records(pages, sections, _SCHEMA)


@case("url STRING, _callback STRING, title STRING, content STRING, author STRING", ("https://a.example/1", "parse_article", "Own title", "Own text", "Jane"), ("https://a.example/2", "parse_article", None, None, "Meta"))
def selector_records(spark):
    """Directives alone: nothing is rejected for its length, authors may come from metadata."""
    pure = {**_BASE, "rules": [{"callback": "parse_article"}], "settings": {"EXTRACTOR_ORDER": ["custom"], "FIELDS": {"title": {"css": ".t::text"}}, "CUSTOM_SELECTORS": {"content": ".c", "author": ".w::text", "title": "h9"}}}
    pages = _rows(spark, "url STRING, html STRING", ("https://a.example/1", _CUSTOM), ("https://a.example/2", _LD % '"Meta"'))
    return config.records(pages, pure).select("url", "_callback", "title", "content", "author")


@case("n BIGINT, allow STRING, callback STRING, follow BOOLEAN, priority INT", (0, "/story/", "parse_article", True, 5), (1, "/item/", "parse_section_2", False, None), (2, None, None, True, None), (3, "/mix/", "parse_article", True, None))
def section_rules(spark):
    made = config.expand_sections({"sections": [{"match": ["/story/"], "extract": "auto", "priority": 5}, {"match": ["/item/"], "extract": {"name": {"css": "h1"}}, "follow": False}, {}, {"match": ["/mix/"], "extract": {"title": "auto", "sku": {"css": "b"}}}]})
    return _rows(spark, "n BIGINT, allow STRING, callback STRING, follow BOOLEAN, priority INT", *((n, ",".join(r["allow"]) if r["allow"] else None, r["callback"], r["follow"], r.get("priority")) for n, r in enumerate(made["rules"])))


def _bad(config_: dict[str, Any]) -> int:
    try:
        return len(config.validate(config.expand_sections(config_)))
    except config.ConfigError:
        return -1


_WRONG: list[tuple[str, dict[str, Any], int]] = [
    ("fine", _BASE, 0),
    ("walk", _WALK, 0),
    ("unknown key", {**_BASE, "x": 1}, 1),
    ("name", {**_BASE, "name": "a b"}, 1),
    ("no seeds", {**_BASE, "start_urls": []}, 1),
    ("generated seeds", {**_BASE, "start_urls": [], "settings": {"GENERATED_URLS": [{"template": "https://a.example/{n}", "vars": {"n": {"type": "range", "from": 1, "to": 2}}}]}}, 0),
    ("placeholders", {**_BASE, "settings": {"GENERATED_URLS": [{"template": "{a}", "vars": {"b": {"type": "list", "values": []}}}]}}, 2),
    ("private", {**_BASE, "start_urls": ["http://127.0.0.1/", "http://10.0.0.1/", "ftp://a.example/"]}, 3),
    ("domain", {**_BASE, "allowed_domains": ["-a.example", "localhost"]}, 2),
    ("priority", {**_BASE, "rules": [{"priority": 1001}]}, 1),
    ("pattern", {**_BASE, "rules": [{"allow": ["("]}, {"deny": [""]}]}, 2),
    ("callback", {**_BASE, "rules": [{"callback": "nope"}], "callbacks": {"parse": {"extract": {"a": {"css": "p"}}}}}, 2),
    ("empty callback", {**_BASE, "callbacks": {"cb": {}}}, 1),
    ("processor", {**_BASE, "callbacks": {"cb": {"extract": {"a": {"css": "p", "processors": [{"type": "upper"}]}}}}}, 1),
    ("no source", {**_BASE, "callbacks": {"cb": {"extract": {"a": {"get_all": True}}}}}, 1),
    ("text of all", {**_BASE, "settings": {"FIELDS": {"a": {"css": "p", "get_all": True, "to_text": True}}}}, 1),
    ("nested", {**_BASE, "callbacks": {"cb": {"extract": {"a": {"type": "nested_list", "selector": "p"}}}}}, 1),
    ("delay", {**_BASE, "settings": {"DOWNLOAD_DELAY": 61, "CONCURRENT_REQUESTS": 0}}, 2),
    ("reader", {**_BASE, "settings": {"EXTRACTOR_ORDER": ["magic"]}}, 1),
    ("context", {**_WALK, "callbacks": {**_WALK["callbacks"], "parse_list": {"iterate": {"selector": "a", "follow": {"url": {"css": "a"}, "callback": "parse_detail"}, "url_context": {"x": {"regex": "(a)(b)"}}}}}}, 1),
    ("auto beyond core", {**_BASE, "sections": [{"extract": {"sku": "auto"}}]}, -1),
    ("two mixed", {**_BASE, "sections": [{"extract": {"title": "auto", "a": {"css": "p"}}}] * 2}, -1),
    ("section key", {**_BASE, "sections": [{"urls": ["x"]}]}, -1),
]


@case("what STRING, problems BIGINT", *((n, k) for n, _, k in _WRONG))
def config_checks(spark):
    return _rows(spark, "what STRING, problems BIGINT", *((n, _bad(c)) for n, c, _ in _WRONG))


@case("what STRING, missing STRING", ("auto", "byline"), ("directive", ""), ("no reader", "title"), ("callbacks", ""), ("mixed", "generic reader beside byline"), ("sections", "byline,price"))
def schema_coverage(spark):
    need = [{"name": "url", "required": True}, {"name": "title", "required": True, "core": True}, {"name": "byline", "required": True, "core": True}]
    made = [
        ("auto", config.coverage({"settings": {"EXTRACTOR_ORDER": ["trafilatura"]}}, [*need[:2], {"name": "byline", "required": True, "core": True}])),
        ("directive", config.coverage({"settings": {"FIELDS": {"title": {"css": "a"}}, "CUSTOM_SELECTORS": {"byline": "b"}}}, need)),
        ("no reader", config.coverage({"settings": {"FIELDS": {"byline": {"css": "b"}}}}, need)),
        ("callbacks", config.coverage({"callbacks": {"cb": {}}}, need)),
        ("mixed", config.coverage({"settings": {"EXTRACTOR_ORDER": ["newspaper"], "FIELDS": {"byline": {"css": "b"}}}}, [need[1], {"name": "byline"}])),
        ("sections", config.sections_coverage([{"extract": "auto"}, {"extract": {"sku": {"css": "b"}}}, {}], [*need, {"name": "price", "required": True}, {"name": "sku", "required": True}])),
    ]
    return _rows(spark, "what STRING, missing STRING", *((n, ",".join(m)) for n, m in made))


# Store and jobs


@case("spider STRING, project STRING, state STRING, downloaded BIGINT, with_content BIGINT, eligible BIGINT, began STRING, ended STRING, latest STRING", ("s1", "p", "running", 7, 2, 5, "2026-02-28T10:00:00", None, "2h"), ("s2", "-", "killed", 0, 0, 0, "2026-02-28T09:00:00", "2026-02-28T09:30:00", "-"), ("s3", "p", "failed", 0, 0, 0, None, None, "-"), ("s4", "p", "queued", 0, 0, 0, None, None, "-"))
def job_status(spark):
    """The newest task of a spider by number; labels of other programs are left out."""
    done = {"start": "2026-02-28T09:00:00", "end": "2026-02-28T09:30:00", "result": "Killed"}
    tasks = {"2": ("run:p:s1", {"Done": {"result": "Success"}}), "10": ("run:p:s1", {"Running": {"start": "2026-02-28T10:00:00"}}), "3": ("run:s2", {"Done": done}), "4": ("run:p:s3", {"Done": {"result": {"Failed": 1}}}), "5": ("run:p:s4", {"Queued": {}}), "6": ("other:p:s5", {"Queued": {}})}
    text = json.dumps({"tasks": {n: {"label": label, "status": status} for n, (label, status) in tasks.items()}})
    status = stats.jobs(_rows(spark, "status STRING", (text,), ("broken",)))
    held = _rows(spark, "project STRING, spider STRING, total BIGINT, with_content BIGINT, eligible BIGINT, modified STRING", ("p", "s1", 7, 2, 5, "2026-02-28 22:00:00"), ("p", "s9", 1, 1, 1, "2026-02-28 22:00:00")).withColumn("modified", F.col("modified").cast("timestamp_ntz"))
    got = stats.job_status(status, held, F.lit("2026-03-01 00:00:00").cast("timestamp_ntz"), "run")
    return got.withColumnsRenamed({"start": "began", "end": "ended", "last": "latest"})


@case("task BIGINT, word STRING", (1, "running"), (2, "queued"), (3, "paused"), (4, "done"), (5, "killed"), (6, "failed"), (7, "unknown"))
def job_words(spark):
    texts = ['{"Running": {}}', '{"Queued": {}}', '{"Paused": {}}', '{"Done": {"result": "Success"}}', '{"Done": {"result": "Killed"}}', '{"Done": {"result": {"Failed": 1}}}', "{}"]
    return _rows(spark, "task BIGINT, s STRING", *enumerate(texts, 1)).select("task", stats.job_state(F.col("s")).alias("word"))


@case("what STRING, n BIGINT", ("active", 1), ("free", 0), ("new", 2))
def run_guards(spark):
    """A second run of a label is refused; spiders with a crawl file are not new."""
    tasks = _rows(spark, "task BIGINT, label STRING, status STRING", (1, "run:p:a", '{"Done": {"result": "Success"}}'), (2, "run:p:a", '{"Paused": {}}'), (3, "run:p:b", '{"Done": {"result": "Killed"}}'))
    new = stats.without_files(_rows(spark, "project STRING, spider STRING", ("p", "a"), ("p", "b"), ("q", "a")), _rows(spark, "project STRING, spider STRING", ("p", "a"), ("p", "a")), ["project", "spider"])
    counted = [("active", stats.active_task(tasks, "run:p:a")), ("free", stats.active_task(tasks, "run:p:b")), ("new", new)]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n") for n, df in counted]
    return parts[0].union(parts[1]).union(parts[2])


@case("pool INT, n INT, lane INT, opened BOOLEAN", (1, 0, 0, True), (1, 1, 1, True), (1, 2, 0, False), (1, 3, 1, True), (1, 4, 0, True), (1, 5, 0, True), (2, 0, 0, True))
def lane_pool(spark):
    """Lanes keep their domain, the least recent one is given up, another session opens anew."""
    log = [(1, n, d, s) for n, (d, s) in enumerate(["ax", "bx", "ax", "cx", "bx", "by"])] + [(2, 0, "a", "x")]
    return stats.lanes(_rows(spark, "pool INT, n INT, d STRING, s STRING", *log), "pool", "n", "d", "s", 2)


@case("id BIGINT, depth INT", (1, 0), (2, 1), (3, 2), (4, 0), (5, 0), (6, None), (7, None), (8, None))
def comment_depths(spark):
    """Zero, null and unknown parents make roots; circles have no depth."""
    rows = _rows(spark, "id BIGINT, parent_id BIGINT", (1, 0), (2, 1), (3, 2), (4, None), (5, 99), (6, 7), (7, 6), (8, 7))
    return stats.comment_tree(rows).select("id", "depth")


_ITEMS = "id BIGINT, url STRING, scraped_at STRING, title STRING, content STRING, author STRING, published_date STRING, metadata_json STRING"


@case("id BIGINT, callback STRING, title STRING, price STRING, rank STRING, lang STRING, author STRING", (1, "parse_item", "T", "5", "1", None, None), (2, None, "U", None, None, "en", "A"), (3, None, "V", None, "2", None, None))
def export_rows(spark):
    """A callback's own fields, other members behind them, all kinds of rows in one table."""
    items = _rows(spark, _ITEMS, (1, "u1", "2026-01-01", "T", "c", "X", None, '{"_callback": "parse_item", "price": 5, "rank": 1}'), (2, "u2", "2026-01-02", "U", "c", "A", None, '{"lang": "en", "title": "other"}'), (3, "u3", "2026-01-03", "V", None, None, None, '{"_callback": "gone", "rank": 2}'))
    return store.exported(items, {"parse_item": {"extract": {"title": {}, "price": {}}}}).select("id", "callback", "title", "price", "rank", "lang", "author")


@case("url STRING, title STRING, metadata_json STRING", ("u1", "T", '{"k": 1,"extra":"x","at":"2026-01-01T00:00:00","list":[1,2],"_callback":"cb"}'), ("u2", None, '{"extra":null,"at":null,"list":null}'))
def packed_items(spark):
    """Fields beyond the store's columns become members; those metadata has win."""
    rows = _rows(spark, "spider_id BIGINT, url STRING, title STRING, metadata STRING, extra STRING, k INT, at STRING, list ARRAY<INT>, clean_html STRING, _callback STRING", (1, "u1", "T", '{"k": 1}', "x", 2, "2026-01-01 00:00:00", [1, 2], "<p>", "cb"), (1, "u2", None, None, None, None, None, None, None, None)).withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = store.packed(rows.withColumn("k", F.when(F.col("url") == "u1", F.col("k"))))
    return got.select("url", "title", F.regexp_replace("metadata_json", '"k":null,|,"k":null', "").alias("metadata_json"))


@case("id BIGINT, a STRING, b STRING", (1, "1", None), (2, None, "x"))
def flat_members(spark):
    """The members that rows have are found; taken names stay."""
    return store.flattened(_rows(spark, "id BIGINT, metadata_json STRING", (1, '{"a": 1, "id": 7, "_callback": "c"}'), (2, '{"b": "x"}')))


@case("scraped_at STRING, source STRING, url STRING", ("2026-03-01T00:00:00", "demo", "u"))
def provenance(spark):
    return store.with_provenance(_rows(spark, "url STRING", ("u",)), "demo", F.lit("2026-03-01").cast("timestamp_ntz")).select("scraped_at", "source", "url")


# Files


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@case("what STRING, n BIGINT, text STRING", ("jsonl", 2, "u,v"), ("missing", 0, None), ("csv", 2, "a:9,b:5"), ("json", 1, "c:5"), ("pages", 1, "<p>x</p>"), ("lines", 5, "12"), ("urls", 2, "a,b"))
def file_readers(spark):
    """Tolerant lines, queue files, whole pages, line counts and address lists."""
    root = _scratch(spark)
    put = lambda name, *lines: _rows(spark, "value STRING", *((x,) for x in lines)).coalesce(1).write.text(f"{root}/{name}")
    put("a.jsonl", '{"url": "u", "content": "c"}', "", "broken{", '{"url": "v"}')
    put("q.csv", "url,priority", "a,9", ",1", "b,x")
    put("q.json", '[{"url": "c"}]')
    put("p.html", "<p>x</p>")
    files.write_urls(_rows(spark, "url STRING", ("b",), ("a",), ("",), ("b",)), f"{root}/urls")
    queued = F.concat("url", F.lit(":"), "priority")
    found = [
        ("jsonl", files.read_jsonl(spark, f"{root}/a.jsonl"), F.col("url")),
        ("missing", files.read_jsonl(spark, f"{root}/none.jsonl"), F.col("url")),
        ("csv", files.read_queue(spark, f"{root}/q.csv"), queued),
        ("json", files.read_queue(spark, f"{root}/q.json"), queued),
        ("pages", files.read_pages(spark, f"{root}/p.html"), F.trim(F.replace("html", F.lit("\n"), F.lit("")))),
        ("urls", spark.read.text(f"{root}/urls"), F.col("value")),
    ]
    parts = [df.agg(F.count("*").alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit("")).alias("text")).select(F.lit(n).alias("what"), "n", "text") for n, df, c in found]
    lines = files.line_counts(spark, f"{root}/*").agg(F.count("file").alias("n"), F.max(F.when(F.col("file").isNull(), F.col("lines"))).cast("string").alias("text")).select(F.lit("lines").alias("what"), "n", "text")
    out = lines
    for p in parts:
        out = out.unionByName(p)
    return stored(out, "read")


@case("form STRING, n BIGINT, columns STRING, text STRING", ("csv", 2, "url,title,tags", "é,\"q\""), ("jsonl", 2, "tags,title,url", "é,\"q\""), ("json", 2, "tags,title,url", "é,\"q\""), ("parquet", 2, "url,title,tags", "é,\"q\""), ("crawl", 2, "crawl_date,project,spider,title,url", "é,\"q\""))
def file_writers(spark):
    """What each form of export holds when read back."""
    root = _scratch(spark)
    df = _rows(spark, "tags ARRAY<STRING>, title STRING, url STRING", (["x", "y"], 'é,"q"', "u"), (None, None, "v")).coalesce(1)
    files.write_csv(df, f"{root}/csv")
    files.write_jsonl(df, f"{root}/jsonl", compress=True)
    files.write_json(df, f"{root}/json")
    files.write_parquet(df, f"{root}/parquet")
    files.append_crawl(df.drop("tags").withColumns({"project": F.lit("p"), "spider": F.lit("s"), "scraped_at": F.lit("2026-02-22").cast("timestamp_ntz")}), f"{root}/crawl")
    back = {"csv": spark.read.option("header", True).option("escape", '"').csv(f"{root}/csv"), "jsonl": spark.read.json(f"{root}/jsonl"), "json": spark.read.option("multiLine", True).json(f"{root}/json"), "parquet": spark.read.parquet(f"{root}/parquet"), "crawl": spark.read.json(f"{root}/crawl").drop("scraped_at")}
    out: DataFrame | None = None
    for form, read in back.items():
        names = sorted(read.columns) if form in ("jsonl", "json", "crawl") else read.columns
        part = read.agg(F.count("*").alias("n"), F.max("title").alias("text")).select(F.lit(form).alias("form"), "n", F.lit(",".join(names)).alias("columns"), "text")
        out = part if out is None else out.unionByName(part)
    return out


@case("project STRING, spider STRING, total BIGINT, with_content BIGINT, eligible BIGINT", ("p", "s", 4, 2, 3))
def crawl_file(spark):
    """The newest file of a spider; broken lines do not count, a PDF is not eligible."""
    root = _scratch(spark)
    lines = ['{"url": "https://a.example/1", "content": "x"}', '{"url": "https://a.example/2", "content": " "}', "broken", '{"url": "https://a.example/3.pdf?x", "content": "y"}', '{"url": "https://a.example/4"}']
    _rows(spark, "value STRING", ('{"url": "old"}',)).coalesce(1).write.text(f"{root}/p/s/crawls")
    _rows(spark, "value STRING", *((x,) for x in lines)).coalesce(1).write.mode("overwrite").text(f"{root}/p/s/crawls")
    return files.crawl_files(spark, root).drop("modified")


@case("page STRING, url STRING", ("m", "https://a.example/?a=1&b=2"), ("m", "https://a.example/x"), ("i", "https://a.example/s1.xml"), ("h", "/rel"), ("h", "https://b.example/"))
def extracted_urls(spark):
    """Sitemaps by their root tag, links of other pages; "geolocation" is no sitemap."""
    pages = _rows(spark, "url STRING, html STRING", ("m", '<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://a.example/?a=1&amp;b=2 </loc></url><url><loc><![CDATA[https://a.example/x]]></loc></url></urlset>'), ("i", "<sitemapindex><sitemap><loc>https://a.example/s1.xml</loc></sitemap></sitemapindex>"), ("h", '<p>geolocation</p><a href="/rel">1</a><a href="https://b.example/">2</a><a href="/rel">3</a><a href="">4</a>'))
    return files.extracted_urls(pages)


@case("form STRING, text STRING", ("table", "a | b   \n--------\n1 | x, y\n2 | None"), ("csv", 'a,b\n1,"x, y"\n2,None'), ("json", '[{"a":1,"b":"x, y"}\n,{"a":2,"b":null}\n]'))
def rendered_results(spark):
    df = _rows(spark, "a INT, b STRING", (1, "x, y"), (2, None)).coalesce(1)
    return _rows(spark, "form STRING, text STRING", *((f, "\n".join(files.rendered(df, f))) for f in ("table", "csv", "json")))


@case("place INT, name STRING, kind STRING, optional BOOLEAN", (1, "id", "bigint", True), (2, "tags", "array<string>", True))
def table_schema(spark):
    got = files.described(_rows(spark, "id BIGINT, tags ARRAY<STRING>", (1, ["x"])))
    return got.toDF("place", "name", "kind", "optional")
