"""Which URLs are taken, and by which rule."""

from __future__ import annotations

import itertools
import re
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.html import pages as html_pages
from webloom.functions.processors import java_pattern, strip
from webloom.session import stored

# Statuses and wording of pages that block a fetch.
BLOCK_STATUS = (403, 429, 503)
BLOCK_MARKERS = ("checking your browser", "just a moment", "cf-browser-verification", "/cdn-cgi/challenge-platform", "sorry, you have been blocked", "attention required", "error 1020", "error 1015")
# Wording of challenge pages; all of a group must stand in the page.
CHALLENGE_MARKERS = (
    ("cloudflare", "checking your browser"),
    ("just a moment", "cloudflare"),
    ("<title>just a moment...</title>",),
    ("this requires javascript", "not a robot"),
    ("sorry, you have been blocked",),
    ("access denied", "cloudflare"),
    ("error 1020",),
    ("error 1015",),
)
#: A page this short that names the shield is a block.
SHORT_PAGE = 5000


def route(links: DataFrame, rules: DataFrame, url: str = "url", owner: str = "spider_id", keep_pdf: bool | None = None) -> DataFrame:
    """(links.*, rule_id, callback, follow): the first rule of a link's owner that
    takes it, by priority and then rule id; nulls where none does. With ``keep_pdf`` set,
    links with file endings that are no pages are taken by none; it lets PDFs through.

    A rule takes a URL that matches one of its allow patterns (or has none) and
    none of its deny patterns. Rules are kept as one array an owner, so links are
    joined once and never multiplied; owners' rules are few."""
    packed = F.struct((-F.col("priority")).alias("_p"), F.col("id").alias("rule_id"), F.coalesce("allow_patterns", F.array().cast("array<string>")).alias("_a"), F.coalesce("deny_patterns", F.array().cast("array<string>")).alias("_d"), "callback", "follow")
    own = rules.groupBy(F.col(owner).alias("_owner")).agg(F.array_sort(F.collect_list(packed)).alias("_rules"))
    joined = links.join(own, links[owner] == own["_owner"], "left")
    takes = lambda r: ((F.size(r["_a"]) == 0) | F.exists(r["_a"], lambda p: F.regexp_like(F.col(url), p))) & ~F.exists(r["_d"], lambda p: F.regexp_like(F.col(url), p))
    first = F.get(F.filter("_rules", takes), F.lit(0))
    if keep_pdf is not None:
        first = F.when(~urls.has_ignored_ending(F.col(url), keep_pdf), first)
    return joined.withColumn("_r", first).select(*links.columns, F.col("_r.rule_id"), F.col("_r.callback"), F.col("_r.follow"))


def takes(url: Column, rule: dict[str, Any]) -> Column:
    """Whether a constant rule takes a URL: one of its patterns allows it, or it has none,
    and none denies it."""
    allow = [url.rlike(java_pattern(p)) for p in rule.get("allow") or []]
    deny = [url.rlike(java_pattern(p)) for p in rule.get("deny") or []]
    return (_any(allow) if allow else F.lit(True)) & ~_any(deny)


def routed_by(url: Column, rules: list[dict[str, Any]]) -> Column:
    """The callback of the first of a few constant rules that takes a URL, by priority
    and then place."""
    out = None
    for rule in sorted(rules, key=lambda r: -(r.get("priority") or 0)):
        value = F.lit(rule.get("callback")).cast("string")
        out = F.when(takes(url, rule), value) if out is None else out.when(takes(url, rule), value)
    return out if out is not None else F.lit(None).cast("string")


def onsite(links: DataFrame, spiders: DataFrame, url: str = "url") -> DataFrame:
    """Links whose host is within their spider's domains; none listed allows all."""
    own = spiders.select(F.col("id").alias("_id"), "allowed_domains")
    joined = links.join(own, links["spider_id"] == own["_id"])
    free = F.coalesce(F.size("allowed_domains"), F.lit(0)) <= 0
    return joined.where(free | urls.within(urls.hostname(F.col(url)), F.col("allowed_domains"))).select(*links.columns)


def sitemap_entries(entries: DataFrame, since: Column | None = None, deny: list[str] = (), base: Column | None = None) -> DataFrame:
    """Entries (loc, lastmod, type) with ``kept`` and the flags behind it: denied
    (never an index), old (a missing or unreadable lastmod never is), no_lastmod, rewritten
    (the address was not absolute)."""
    good = []
    for p in deny:
        try:
            re.compile(p)
            good.append(java_pattern(p))
        except re.error:
            continue
    loc = urls.absolute(base, F.col("loc")) if base is not None else F.col("loc")
    out = entries.withColumn("_as_given", F.col("loc")).withColumn("loc", loc)
    denied = F.lit(False)
    for p in good:
        denied = denied | F.col("loc").rlike(p)
    when = F.regexp_replace("lastmod", r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    out = out.withColumn("denied", denied & (F.coalesce("type", F.lit("urlset")) != "sitemapindex"))
    out = out.withColumn("no_lastmod", F.col("lastmod").isNull()).withColumn("rewritten", ~F.col("loc").eqNullSafe(F.col("_as_given")))
    out = out.withColumn("old", F.coalesce(when < since, F.lit(False)) if since is not None else F.lit(False))
    return out.withColumn("kept", ~F.col("denied") & ~F.col("old")).drop("_as_given")


def expand_variable(spec: dict[str, Any]) -> Column:
    """An array of a variable's texts: a list, a range of numbers, or of dates."""
    kind = spec.get("type", "list")
    if kind == "range":
        a, b, step = int(spec["from"]), int(spec["to"]), max(int(spec.get("step", 1)), 1)
        values = F.sequence(F.lit(a), F.lit(b), F.lit(step)) if a <= b else F.array().cast("array<int>")
        return F.transform(values, lambda x: x.cast("string"))
    if kind == "date":
        a, b, step = date.fromisoformat(spec["from"]), date.fromisoformat(spec["to"]), max(int(spec.get("step_days", 1)), 1)
        return F.array(*[F.lit((a + timedelta(n)).strftime(spec.get("format", "%Y-%m-%d"))) for n in range(0, (b - a).days + 1, step)]) if a <= b else F.array().cast("array<string>")
    return F.array(*[F.lit(str(v)) for v in spec["values"]])


def generated(spark: SparkSession, template: str, variables: dict[str, dict[str, Any]], form: dict[str, str] | None = None, callback: str | None = None, follow: bool = False) -> DataFrame:
    """(url, formdata, method, callback, dont_filter): every combination of the variables
    put into the template and the form. The values are arrays that are exploded one after
    the other, so the product is made by the workers. Requests with a form are POSTs, which
    the filter of repeats lets through; with ``follow`` the rules route the response."""
    if follow and callback:
        raise ValueError("follow and callback exclude each other")
    wanted = set(re.findall(r"\{(\w+)\}", template + " ".join((form or {}).values())))
    if wanted != set(variables):
        raise ValueError(f"placeholders {sorted(wanted)} and variables {sorted(variables)} differ")
    df = spark.range(1).select(F.lit(template).alias("url"), F.lit(None).cast("map<string,string>").alias("formdata"))
    if form:
        df = df.withColumn("formdata", F.create_map(*itertools.chain(*[(F.lit(k), F.lit(v)) for k, v in form.items()])))
    for name, spec in variables.items():
        mark = F.lit("{" + name + "}")
        df = df.withColumn("_v", F.explode(expand_variable(spec)))
        df = df.withColumn("url", F.replace("url", mark, F.col("_v"))).withColumn("formdata", F.transform_values("formdata", lambda k, v: F.replace(v, mark, F.col("_v")))).drop("_v")
    target = None if follow else callback or "parse_article"
    return df.select("url", "formdata", F.lit("POST" if form else "GET").alias("method"), F.lit(target).cast("string").alias("callback"), F.lit(bool(form)).alias("dont_filter"))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def blocked(status: Column, body: Column) -> Column:
    """Whether a response blocks: by status, or a success that is blank or carries
    a marker, or is short and names the shield."""
    low = F.lower(body)
    blank = F.coalesce(strip(body) == "", F.lit(True))
    soft = blank | _any([low.contains(m) for m in BLOCK_MARKERS]) | ((F.length(body) < SHORT_PAGE) & low.contains("cloudflare"))
    return F.coalesce(status.isin(*BLOCK_STATUS), F.lit(False)) | ((status.isNull() | (status == 200)) & soft)


def challenged(body: Column) -> Column:
    """Whether a page is a challenge: missing, empty, with all markers of a group, or short
    and naming the shield."""
    low = F.lower(body)
    groups = []
    for group in CHALLENGE_MARKERS:
        test = F.lit(True)
        for marker in group:
            test = test & low.contains(marker)
        groups.append(test)
    found = _any(groups) | ((F.length(body) < SHORT_PAGE) & low.contains("cloudflare"))
    return F.coalesce(found, F.lit(True)) | F.coalesce(body == "", F.lit(True))


def session_expired(body: Column, signal: str | None) -> Column:
    """Whether a page holds the text that shows a login has ended; never without a signal."""
    return F.coalesce(body.contains(signal), F.lit(False)) if signal else F.lit(False)


def start_content(url: Column, rules: list[dict[str, Any]]) -> Column:
    """The callback that parses a start URL: the first content rule whose pattern it
    matches, ``parse_article`` where there are no rules at all, else null."""
    if not rules:
        return F.lit("parse_article")
    content = [r for r in rules if r.get("callback")]
    return routed_by(url, [r | {"deny": []} for r in content])


def followed(pages: DataFrame, rules: list[dict[str, Any]], keep_pdf: bool = False) -> DataFrame:
    """(page, url, rule, callback, follow): the links of pages (url, html), each by the
    first rule that takes it. A rule looks at its regions and tags, leaves out file
    endings that are no pages, and takes what one of its patterns allows and none denies."""
    ordered = sorted(enumerate(rules), key=lambda r: (-(r[1].get("priority") or 0), r[0]))
    every: DataFrame | None = None
    for place, (n, rule) in enumerate(ordered):
        links = html_pages.page_links(F.col("url"), F.col("html"), rule.get("restrict_css"), rule.get("restrict_xpaths"), tuple(rule.get("tags") or ("a", "area")))
        own = pages.select(F.col("url").alias("page"), F.explode(links).alias("url"))
        own = own.where(~urls.has_ignored_ending(F.col("url"), keep_pdf) & takes(F.col("url"), rule))
        own = own.select("page", "url", F.struct(F.lit(place).alias("at"), F.lit(n).alias("rule"), F.lit(rule.get("callback")).cast("string").alias("callback"), F.lit(rule.get("follow", True)).alias("follow")).alias("r"))
        every = own if every is None else every.unionByName(own)
    if every is None:
        return pages.where("false").selectExpr("url AS page", "url", "0 AS rule", "CAST(NULL AS STRING) AS callback", "true AS follow")
    return every.groupBy("page", "url").agg(F.min("r").alias("r")).select("page", "url", "r.rule", "r.callback", "r.follow")


def reachable(links: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(url, depth): what a crawl of recorded ``links`` (page, url) reaches from ``seeds``
    (url) within ``limit`` steps; 0 sets no limit. Each level is written to the shared folder."""
    level = stored(seeds.select("url", F.lit(0).alias("depth")).distinct(), "level")
    seen, depth = level, 0
    while not limit or depth < limit:
        depth += 1
        step = links.join(level.select(F.col("url").alias("page")), "page").select("url").distinct()
        level = stored(step.join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def first_seen_pages(pages: DataFrame, key: str, page: str, url: str, most: int | None = None, last: DataFrame | None = None) -> DataFrame:
    """Pages of a listing until the first one after page 1 without a new URL, page ``most``
    and the page without a next one (``last``: key, page): (key, page, urls) with the URLs
    first seen there."""
    if most is not None:
        pages = pages.where(F.col(page) <= most)
    if last is not None:
        ends = last.groupBy(F.col(key).alias("_k")).agg(F.min(page).alias("_end"))
        pages = pages.join(ends, pages[key] == ends["_k"], "left").where(F.col("_end").isNull() | (F.col(page) <= F.col("_end"))).drop("_k", "_end")
    first = pages.groupBy(key, url).agg(F.min(page).alias(page))
    fresh = first.groupBy(key, page).agg(F.array_sort(F.collect_list(url)).alias("urls"))
    every = pages.select(key, page).distinct().join(fresh, [key, page], "left")
    stops = every.where(F.col("urls").isNull() & (F.col(page) > 1)).groupBy(F.col(key).alias("_k")).agg(F.min(page).alias("_stop"))
    kept = every.join(stops, every[key] == stops["_k"], "left").where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop")))
    return kept.select(key, page, F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))


def full_pages(pages: DataFrame, key: str, page: str, rows: str, per_page: int) -> DataFrame:
    """Pages of an interface that are fetched: up to the first one with fewer than
    ``per_page`` rows, an empty one not counted; without ``per_page`` only the first."""
    if not per_page:
        return pages.where((F.col(page) == 1) & (F.col(rows) > 0))
    short = pages.where(F.coalesce(F.col(rows), F.lit(0)) < per_page).groupBy(F.col(key).alias("_k")).agg(F.min(page).alias("_end"))
    kept = pages.join(short, pages[key] == short["_k"], "left").where(F.col("_end").isNull() | (F.col(page) <= F.col("_end")))
    return kept.where(F.col(rows) > 0).select(*pages.columns)
