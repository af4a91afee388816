"""Crawl, health, proxy and stateful statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.processors import strip
from webloom.functions.records import ago
from webloom.session import stored


def crawl_stats(items: DataFrame, by: str = "spider_id") -> DataFrame:
    """Rows, rows with content, rows that could have content, and the percentage
    in whole numbers; a PDF counts only in the first two."""
    has = F.coalesce(strip(F.col("content")) != "", F.lit(False))
    eligible = ~F.coalesce(F.lower(urls.path(F.col("url"))).endswith(".pdf"), F.lit(False))
    out = items.groupBy(by).agg(F.count("*").alias("total"), F.count_if(has).alias("with_content"), F.count_if(eligible).alias("eligible"))
    return out.withColumn("pct", F.when(F.col("eligible") > 0, F.floor(100 * F.col("with_content") / F.col("eligible"))))


def health(items: DataFrame, least: int = 3, characters: int = 50, by: str = "spider_id", problems: DataFrame | None = None) -> DataFrame:
    """One verdict a spider: ``schema_coverage`` if ``problems`` (by, problem) names it,
    ``crawling`` below ``least`` items, ``extraction`` if the newest item's content is
    shorter than ``characters``, else ``passed``.

    The newest item is an aggregate and not a sort, so it is combined per task."""
    newest = F.max_by(F.coalesce(F.length("content"), F.lit(0)), F.struct("scraped_at", "id"))
    out = items.groupBy(by).agg(F.count("*").alias("items"), newest.cast("bigint").alias("newest_chars"))
    verdict = F.when(F.col("items") < least, "crawling").when(F.col("newest_chars") < characters, "extraction").otherwise("passed")
    if problems is not None:
        out = out.join(problems.select(by, F.lit(True).alias("_bad")).distinct(), by, "left")
        verdict = F.when(F.col("_bad"), "schema_coverage").otherwise(verdict)
    return out.withColumn("verdict", verdict).drop("_bad")


def health_sample(items: DataFrame, by: str = "spider_id") -> DataFrame:
    """(by, title, content, author, url, date): the newest item of each spider, its content
    cut to 100 characters."""
    newest = F.max_by(F.struct("title", F.left(F.coalesce("content", F.lit("")), F.lit(100)).alias("content"), "author", "url", F.col("published_date").alias("date")), F.struct("scraped_at", "id"))
    return items.groupBy(by).agg(newest.alias("_s")).select(by, "_s.*")


def missing_fields(items: DataFrame, required: list[str], by: str = "spider_id") -> DataFrame:
    """How many rows lack each required field."""
    return items.groupBy(by).agg(*[F.count_if(F.col(f).isNull() | (F.col(f) == "")).alias(f"missing_{f}") for f in required])


def project_counts(spiders: DataFrame, queue: DataFrame) -> DataFrame:
    """Spiders and queue entries of every project of either table."""
    a = spiders.where("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("n_spiders"))
    b = queue.where("project_name IS NOT NULL").groupBy(F.col("project_name").alias("project")).agg(F.count("*").alias("n_queue"))
    return a.join(b, "project", "full").select("project", F.coalesce("n_spiders", F.lit(0)).alias("n_spiders"), F.coalesce("n_queue", F.lit(0)).alias("n_queue"))


def status_counts(queue: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return queue.agg(F.count("*").alias("total"), *[n(s) for s in ("pending", "processing", "completed", "failed")])


def _first(log: DataFrame, keys: list[str], order: list[str], when: Column) -> DataFrame:
    """``log`` with ``_first``, the first moment of each key at which a condition holds. It is
    a minimum that is combined per task, so a hot key is no sort in one task; the join
    back is split by Spark where it is skewed."""
    hits = log.where(F.coalesce(when, F.lit(False))).groupBy(*[F.col(k).alias(f"_key_{n}") for n, k in enumerate(keys)]).agg(F.min(F.struct(*order)).alias("_first_moment"))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & log[k].eqNullSafe(hits[f"_key_{n}"])
    return log.join(hits, same, "left").select(*log.columns, "_first_moment")


def block_learning(log: DataFrame, domain: str, order: list[str], blocks: Column) -> DataFrame:
    """The log with ``via_proxy``: whether an earlier request of the domain was
    blocked; and ``failed``: blocked although it went through the proxy. ``order`` must
    tell requests apart."""
    learned = _first(log.withColumn("blocked", blocks), [domain], order, F.col("blocked"))
    via = F.coalesce(F.col("_first_moment") < F.struct(*order), F.lit(False))
    return learned.withColumn("via_proxy", via).withColumn("failed", F.col("blocked") & F.col("via_proxy")).drop("_first_moment")


def proxy_stats(learned: DataFrame, domain: str, status: Column) -> DataFrame:
    """Attempts through the proxy, successes (status 200), their rate (half to even),
    direct requests, blocked and retried ones, domains that needed the proxy (sorted) and
    how many failed with it."""
    via = F.col("via_proxy")
    retried = F.coalesce(F.col("blocked") & ~via, F.lit(False))
    needed = F.array_join(F.array_sort(F.collect_set(F.when(retried, F.col(domain).cast("string")))), ", ")
    out = learned.agg(F.count_if(via).alias("attempts"), F.count_if(via & (status == 200)).alias("successes"), F.count_if(~via).alias("direct"), F.count_if(retried).alias("retries"), needed.alias("needed"), F.countDistinct(F.when(F.col("failed"), F.col(domain))).alias("failed_domains"))
    return out.withColumn("pct", F.when(F.col("attempts") > 0, F.bround(100 * F.col("successes") / F.col("attempts")).cast("bigint")))


def not_stored_before(requests: DataFrame, keys: list[str], order: list[str], stores: Column) -> DataFrame:
    """Requests whose key no earlier request stored."""
    known = _first(requests, keys, order, stores)
    return known.where(F.col("_first_moment").isNull() | (F.struct(*order) <= F.col("_first_moment"))).drop("_first_moment")


def without_repeats(requests: DataFrame, fingerprint: str, bypass: Column, order: list[str]) -> DataFrame:
    """The first request of each fingerprint, and all that bypass the filter."""
    w = Window.partitionBy(fingerprint).orderBy(*order)
    kept = requests.where(~bypass).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.unionByName(requests.where(bypass))


def jobs(status: DataFrame, column: str = "status") -> DataFrame:
    """(task, label, status) of a job runner's status: a JSON object whose ``tasks`` holds an
    object with ``label`` and ``status`` for each task id. Broken JSON has no tasks."""
    tasks = F.from_json(F.get_json_object(column, "$.tasks"), "map<string, struct<label: string, status: string>>")
    return status.select(F.explode(tasks).alias("task", "_t")).select(F.col("task").try_cast("bigint").alias("task"), "_t.label", "_t.status")


def job_state(status: Column) -> Column:
    """One word for a job's status JSON: its first key, or how it was done; ``unknown`` for
    an empty object."""
    key = F.coalesce(F.lower(F.get(F.json_object_keys(status), F.lit(0))), F.lit("unknown"))
    done = F.get_json_object(status, "$.Done.result")
    return F.when(key != "done", key).when(done == "Success", "done").when(done == "Killed", "killed").otherwise("failed")


def job_times(status: Column) -> Column:
    """(start, end) of a job's status JSON, nulls where it has none."""
    inner = F.get(F.map_values(F.from_json(status, "map<string, string>")), F.lit(0))
    return F.struct(F.get_json_object(inner, "$.start").alias("start"), F.get_json_object(inner, "$.end").alias("end"))


def label_parts(label: Column, prefix: str | None = None) -> Column:
    """(project, spider) of ``name:project:spider``, or of ``name:spider`` without a project;
    null for other names than ``prefix``."""
    p = F.split(label, ":")
    pair = lambda a, b: F.struct(a.alias("project"), b.alias("spider"))
    parts = F.when(F.size(p) == 3, pair(p[1], F.element_at(p, 3))).when(F.size(p) >= 2, pair(F.lit(None).cast("string"), p[1]))
    return F.when(label.startswith(f"{prefix}:"), parts) if prefix else parts


def job_status(tasks: DataFrame, files: DataFrame, as_of: Column, prefix: str = "webloom") -> DataFrame:
    """(spider, project, state, downloaded, with_content, eligible, start, end, last): the
    newest task of every spider with what its crawl file holds. ``files`` is (project,
    spider, total, with_content, eligible, modified); a missing one counts as empty."""
    named = tasks.withColumn("_l", label_parts(F.col("label"), prefix)).where("_l IS NOT NULL")
    newest = named.groupBy("_l.project", "_l.spider").agg(F.max_by("status", "task").alias("status"))
    same = newest["project"].eqNullSafe(files["project"]) & (newest["spider"] == files["spider"])
    age = F.floor(F.expr("CAST(_as_of AS TIMESTAMP)").cast("double") - F.col("modified").cast("timestamp").cast("double"))
    joined = newest.join(files, same, "left").withColumn("_as_of", as_of).withColumn("_t", job_times(F.col("status")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select(newest["spider"], F.coalesce(newest["project"], F.lit("-")).alias("project"), job_state(F.col("status")).alias("state"), zero("total").alias("downloaded"), zero("with_content"), zero("eligible"), "_t.start", "_t.end", F.when(age.isNotNull(), ago(age)).otherwise("-").alias("last"))


def item_limit(items: DataFrame, most: int, order: list[str], by: str = "spider_id") -> DataFrame:
    """The first ``most`` items of each spider: what a crawl that stops at a number of items
    keeps. Each task keeps its own first ones before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def active_task(tasks: DataFrame, label: str) -> DataFrame:
    """(task): the tasks of a label that are not finished; a run with one is refused."""
    return tasks.where((F.col("label") == label) & ~job_state(F.col("status")).isin("done", "killed", "failed")).select("task")


def without_files(spiders: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Spiders that have no crawl file yet."""
    return spiders.join(files.select(*keys).distinct(), keys, "left_anti")


def lanes(log: DataFrame, pool: str, order: str, domain: str, session: str, size: int) -> DataFrame:
    """(pool, order, lane, opened): lanes of each pool by least recent use; a lane
    serves one domain and session until it is reused. Order matters, so each pool
    is replayed in one task; ``pool`` must have many values."""
    import pandas as pd

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        held: dict[object, tuple[int, object]] = {}  # by domain, least recently used first
        lanes, opened = [], []
        for want, by in zip(pdf[domain], pdf[session]):
            had = held.pop(want, None)
            if had is None:
                lane = len(held) if len(held) < size else held.pop(next(iter(held)))[0]
            else:
                lane = had[0]
            held[want] = (lane, by)
            lanes.append(lane)
            opened.append(had is None or had[1] != by)
        return pd.DataFrame({pool: pdf[pool], order: pdf[order], "lane": lanes, "opened": opened})

    kinds = {f: log.schema[f].dataType.simpleString() for f in (pool, order)}
    return log.select(pool, order, domain, session).groupBy(pool).applyInPandas(replay, f"{pool} {kinds[pool]}, {order} {kinds[order]}, lane INT, opened BOOLEAN")


def comment_tree(comments: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(key, parent, depth): an unknown, zero or null parent makes a root of depth 0. Each
    round doubles how far every comment knows its ancestors, so a thread of depth n takes
    log n rounds; each is written to the shared folder. Comments on a circle of parents or
    below one never reach a root: their depth is null."""
    ids = comments.select(F.col(key).alias("_p"))
    known = comments.join(ids, (comments[parent] == ids["_p"]) & (comments[parent] != 0), "left").select(key, F.col("_p").alias(parent))
    up = stored(known.select(key, parent, F.col(parent).alias("_above"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth")), "comments")
    open_ = up.where("_above IS NOT NULL").count()
    while open_:
        over = up.select(F.col(key).alias("_k"), F.col("_above").alias("_next"), F.col("depth").alias("_more"))
        up = stored(up.join(over, up["_above"] == over["_k"], "left").select(key, parent, F.col("_next").alias("_above"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "comments")
        left = up.where("_above IS NOT NULL").count()
        if left == open_:
            break
        open_ = left
    return up.select(key, parent, F.when(F.col("_above").isNull(), F.col("depth")).alias("depth"))


def nested_replies(comments: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(key, replies): each comment's children in order; children of one comment
    are one array, as the result asks."""
    kids = comments.where(F.col(parent) != 0).groupBy(F.col(parent).alias("_p")).agg(F.array_sort(F.collect_list(key)).alias("replies"))
    return comments.join(kids, comments[key] == kids["_p"], "left").select(key, F.coalesce("replies", F.array().cast("array<bigint>")).alias("replies"))


def parallel_degree(memory_mb: int, cores: int, plain: int, rendered: int) -> int:
    """How many crawls fit: by memory (200 MB a plain crawl, 500 a rendered one, on
    average) and by cores, between 2 and 20."""
    each = (plain * 200 + rendered * 500) // max(plain + rendered, 1) or 200
    return max(2, min(20, memory_mb // each, cores))


def health_report(verdicts: DataFrame, by: str = "spider_id") -> str:
    """Markdown of ``health``'s verdicts, failures first: all spiders, row by row."""
    counts = {r[0]: r[1] for r in verdicts.groupBy("verdict").count().collect()}
    lines = ["# Health", "", ", ".join(f"{n} {v}" for v, n in sorted(counts.items())), ""]
    for title, test in (("Failed", "verdict <> 'passed'"), ("Passed", "verdict = 'passed'")):
        lines += [f"## {title}", "", *(f"- {r[by]}: {r.verdict}, {r['items']} items" for r in verdicts.where(test).orderBy(by).toLocalIterator()), ""]
    return "\n".join(lines)
