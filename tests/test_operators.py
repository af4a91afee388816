import json
import os
import subprocess
import sys

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom import session
from webloom.functions import processors as proc
from webloom.functions import records, urls
from webloom.functions.html import dom, pages, selectors
from webloom.operators import routing, stats, store
from webloom.plans import config
from webloom.sources import files
from webloom.streaming import streams


def one(spark, values, column, kind="STRING"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_processors(spark):
    assert one(spark, ["  a\n", "", None], proc.strip) == ["a", "", None]
    assert one(spark, ["aXa"], lambda c: proc.replace(c, "a", "$1")) == ["$1X$1"]
    assert one(spark, ["ab"], lambda c: proc.replace(c, "", "-")) == ["-a-b-"]
    assert one(spark, ["Price: $99.99", "none", None], lambda c: proc.regex(c, r"\$([\d.]+)")) == ["99.99", "none", None]
    assert one(spark, ["x"], lambda c: proc.regex(c, "(x", 1)) == ["x"]
    assert one(spark, ["x"], lambda c: proc.regex(c, "x", 4)) == ["x"]
    assert one(spark, ["3.7", " 42 ", "1_000", "", None, "x"], lambda c: proc.cast(c, "int")) == [None, 42, 1000, None, None, None]
    assert one(spark, ["12d", "1e3", " -2.5"], lambda c: proc.cast(c, "float")) == [None, 1000.0, -2.5]
    assert one(spark, ["on", "2", "", "TRUE"], lambda c: proc.cast(c, "bool")) == [True, False, None, True]
    assert one(spark, [-3.9], lambda c: proc.cast(c, "int", "float"), "DOUBLE") == [-3]
    assert one(spark, [["a", None, "b"], []], lambda c: proc.join(c, "-"), "ARRAY<STRING>") == ["a-b", ""]
    assert one(spark, [None, "", "0"], lambda c: proc.default(c, "d")) == ["d", "d", "0"]
    assert one(spark, ["2026-02-22 10:00", "x"], lambda c: proc.parse_datetime(c, "%Y-%m-%d %H:%M"))[1] is None


def test_urls(spark):
    assert one(spark, ["https://wwf.org/a", "https://www.b-c.org"], urls.queue_name) == ["f_org", "b_c_org"]
    assert one(spark, ["https://www.b-c.org/"], urls.expected_name) == ["b-c_org"]
    assert one(spark, ["https://U:p@Host.example:80/x"], urls.hostname) == ["host.example"]
    assert one(spark, ["http://127.0.0.1/", "http://a.example", None], urls.fetchable) == [False, True, False]
    base = F.lit("https://a.example/x/y")
    assert one(spark, ["b", "/c", "//d.example/e", "../f", "https://g.example/"], lambda c: urls.absolute(base, c)) == ["https://a.example/x/b", "https://a.example/c", "https://d.example/e", "https://a.example/f", "https://g.example/"]


def test_records(spark):
    assert one(spark, [["A ", "http://x", "B", "A"], [""]], records.joined_authors, "ARRAY<STRING>") == ["A, B", None]
    assert one(spark, ["exam-\nple text\nthat goes on.\n\n\n\nNext"], records.clean_pdf_text) == ["example text that goes on.\n\nNext"]
    assert one(spark, ['{"a": [{"b": "x"}]}'], lambda c: records.json_at(c, "a.0.b")) == ["x"]
    assert one(spark, ['{"q": {"k": 1}, "k": 0}'], lambda c: records.key_anywhere(c, "k")) == ["1"]
    assert one(spark, ["True", "12", "x", "[1]"], records.decoded_setting) == ["true", "12", '"x"', "[1]"]


PAGE = """<html><head><title>T</title><meta property="article:published_time" content="2026-02-22T11:00:00-05:00">
<script type="application/ld+json">{"@graph": [{"author": [{"name": "A"}, "B", {"name": "http://x"}]}]}</script></head><body>
<div class="item"><h2>P1</h2><span class="price" data-v="1">$10</span></div><div class="item"><h2>P2</h2><span class="price">$20</span></div>
<article><h1>Head</h1><p>Hello <b>world</b> of text that is long enough<p>Second para with more text</article><img src="i.png"><a href="/d.pdf?x">d</a></body>"""


def test_html():
    root = dom.parse(PAGE)
    assert selectors.css(root, "div.item > h2::text") == ["P1", "P2"]
    assert selectors.css(root, ".price::attr(data-v)") == ["1"]
    assert selectors.xpath(root, "//div[@class='item'][2]/span/text()") == ["$20"]
    assert selectors.xpath(root, "//h2[text()='P1']/following-sibling::span[1]/text()") == ["$10"]
    rows = {"selector": ".item", "extract": {"n": {"css": "h2::text", "processors": [{"type": "lowercase"}]}}}
    assert pages.nested(root, rows) == [{"n": "p1"}, {"n": "p2"}]
    assert pages.nested(root, rows, depth=3) == pages.nested(root, {"selector": ".item"}) == []
    assert pages.meta_date(root) == "2026-02-22T16:00:00"
    assert pages.meta_author(root) == "A, B"
    assert pages.to_text(root, "article") == "Head Hello world of text that is long enough Second para with more text"
    assert pages.to_text(root, "article p") == "world" and pages.to_text(root, "article p", own=True) == "Hello world of text that is long enough Second para with more text"
    assert "**world**" in pages.to_markdown(selectors.css_nodes(root, "article")[0])
    assert pages.article(root)["title"] == "Head"
    assert pages.pdf_links(root, "https://a.example/") == [{"url": "https://a.example/d.pdf?x", "title": "d.pdf"}]
    assert pages.media(root)["images"] == [{"src": "i.png", "alt": ""}]
    assert pages.found_by_text(root, "P2")[0]["text"] == "P2"
    assert pages.found_by_keyword(root, "price") == [{"selector": "span.price", "text": "$10"}, {"selector": "span.price", "text": "$20"}]
    assert pages.structure(root)["h1"] == ["Head"]
    assert pages.first_accepted(root, ["custom", "newspaper"], chosen={"title": "h9", "content": "h9"})["title"] == "Head"
    assert pages.first_accepted(dom.parse("<p>"), ["newspaper", "trafilatura"]) is None
    assert pages.links(root, "https://a.example/", paths=["//div"]) == pages.links(root, "https://a.example/", within=["article"]) == [] and len(pages.links(root, "https://a.example/")) == 1
    assert pages.compared(root)["newspaper"]["title"] == "Head" and pages.pdf_items(root, "https://a.example/")[0]["metadata"]["content_type"] == "pdf"


@given(st.text(alphabet="<>/ab=\"' &;!-pdiv", max_size=200))
def test_any_text_parses(text):
    root = dom.parse(text)
    pages.first_accepted(root)
    pages.to_markdown(root)


BASE = {"name": "demo", "source_url": "https://a.example/", "allowed_domains": ["a.example"], "start_urls": ["https://a.example/"]}


def test_config(spark):
    schema = [{"name": "title", "required": True}, {"name": "sku"}, {"name": "price", "required": True}]
    c = {**BASE, "sections": [{"match": ["/story/"], "extract": "auto", "priority": 5}, {"match": ["/item/"], "extract": {"title": {"css": "h1::text"}, "price": {"css": ".price::text", "processors": [{"type": "regex", "pattern": r"\$(\d+)"}, {"type": "cast", "to": "int"}]}}}, {"match": ["/list/"]}]}
    df = spark.createDataFrame([("https://a.example/item/1", PAGE), ("https://a.example/story/1", PAGE), ("https://a.example/list/1", PAGE)], "url STRING, html STRING")
    rows = {r.url[-6:]: r for r in config.records(df, c, schema).collect()}
    assert (rows["item/1"].price, rows["item/1"].title, rows["item/1"].sku) == (10, "Head", None)
    assert rows["tory/1"].title == "Head" and len(rows) == 2
    whole = config.records(df, {**BASE, "rules": [{"callback": "parse_article"}]}, include_html=True).first()
    assert whole.html == PAGE and whole.source == "trafilatura" and json.loads(whole.images) == []
    with pytest.raises(config.ConfigError):
        config.records(df, {**BASE, "name": "a b"})
    assert config.reader_order({"EXTRACTOR_ORDER": "['custom']", "INFINITE_SCROLL": True}) == ["custom", "playwright"]


def test_routing_and_lanes(spark):
    with pytest.raises(ValueError):
        routing.generated(spark, "{a}", {"b": {"values": [1]}})
    assert routing.generated(spark, "x{a}", {"a": {"type": "range", "from": 3, "to": 1}}).count() == 0
    flags = spark.createDataFrame([(403, "x"), (200, " "), (200, "Just a moment"), (404, ""), (200, "fine text"), (None, None)], "s INT, b STRING").select(routing.blocked(F.col("s"), F.col("b"))).collect()
    assert [r[0] for r in flags] == [True, True, True, False, False, True]
    log = spark.createDataFrame([(1, n, d, "s") for n, d in enumerate("abacb")], "p INT, n INT, d STRING, s STRING")
    got = stats.lanes(log, "p", "n", "d", "s", 2).orderBy("n").collect()
    assert [(r.lane, r.opened) for r in got] == [(0, True), (1, True), (0, False), (1, True), (0, True)]


def test_onsite_first_in_a_session(sf):
    """The first columns of a session have the numbers a lambda's variables can get."""
    code = f"""
from webloom.plans import registry
from webloom.session import local_session
spark = local_session(2, "1g", 2)
print("rows", registry.QUERIES["onsite"](spark, {sf!r}).count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")}  # a JVM of its own
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200\n" in ran.stdout, ran.stderr[-2000:]


def test_within(spark):
    rows = [("a.example", ["A.example"]), ("b.a.example", ["x", "a.example"]), ("ba.example", ["a.example"]), ("a.example", []), ("a.example", None), (None, ["a.example"]), ("a.example", [None, "a.example"])]
    df = spark.createDataFrame(rows, "h STRING, d ARRAY<STRING>")
    assert [r[0] for r in df.select(urls.within(F.col("h"), F.col("d"))).collect()] == [True, True, False, False, None, None, True]


def test_fleet(spark):
    assert stats.parallel_degree(4000, 8, 3, 1) == 8 and stats.parallel_degree(300, 8, 0, 5) == 2
    verdicts = spark.createDataFrame([(1, 5, "passed"), (2, 1, "crawling")], "spider_id INT, items INT, verdict STRING")
    report = stats.health_report(verdicts)
    assert report.index("- 2: crawling") < report.index("- 1: passed")
    many = spark.range(3000).selectExpr("CAST(id AS INT) AS spider_id", "3 AS items", "'passed' AS verdict")
    assert stats.health_report(many).count("\n- ") == 3000
    assert one(spark, ["https://web.archive.org/web/20240131123456/https://www.a.example/x", "https://a.example"], urls.archived) == [("20240131", "a.example"), (None, None)]


def test_store(spark):
    with pytest.raises(ValueError):
        store.checked_sql(spark, "DROP TABLE x")
    new = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (2, "a", 4)], "spider_id INT, url STRING, n INT")
    assert [r.n for r in store.insert_absent(new, new.where("n = 4"), ["spider_id", "url"], ["n"]).collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u", "content": "c"}\n\nbroken{\n{"url": "v"}\n')
    assert sorted(r.url for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == ["u", "v"]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "q.csv").write_text("url,priority\nhttps://a.example,9\n,1\nhttps://b.example,x\n")
    assert sorted((r.url[8], r.priority) for r in files.read_queue(spark, str(tmp_path / "q.csv")).collect()) == [("a", 9), ("b", 5)]
    (tmp_path / "q.json").write_text(json.dumps([{"url": "https://c.example"}]))
    assert files.read_queue(spark, str(tmp_path / "q.json")).first().priority == 5
    maps = spark.createDataFrame([("s", "<urlset><url><loc> https://a.example/?a=1&amp;b=2 </loc><lastmod>2025-01-01</lastmod></url></urlset>"), ("h", "<p>geolocation</p>")], "url STRING, html STRING")
    assert [(r.loc, r.lastmod, r.type) for r in files.sitemap_urls(maps).collect()] == [("https://a.example/?a=1&b=2", "2025-01-01", "urlset")]
    df = spark.createDataFrame([(1, "u", ["x"])], "zeta INT, url STRING, tags ARRAY<STRING>")
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["url", "tags", "zeta"]


def test_streams(spark, sf, tmp_path):
    """The stream gives what the batch form gives."""
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("blocked", F.col("event_type") == "error").repartition(5)
    batch.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    learned = run(streams.block_learning(read(), "user_id", "blocked", ["ts", "event_id"]), "learned")
    want = stats.block_learning(batch, "user_id", ["ts", "event_id"], F.col("blocked"))
    pick = lambda df: sorted((r.event_id, r.via_proxy, r.failed) for r in df.select("event_id", "via_proxy", "failed").collect())
    assert pick(learned) == pick(want)
    fresh = run(streams.not_stored_before(read().withColumn("s", F.lit(True)), ["user_id", "event_type"], "s", ["ts", "event_id"]), "fresh")
    firsts = stats.not_stored_before(batch, ["user_id", "event_type"], ["ts", "event_id"], F.lit(True))
    assert {r.event_id for r in fresh.collect()} == {r.event_id for r in firsts.collect()}
    once = run(streams.without_repeats(streams.timed(read()), ["user_id"]), "once")
    assert once.count() >= batch.select("user_id").distinct().count()
    through = run(streams.without_repeats(streams.timed(read()), ["user_id"], F.col("blocked")), "through")
    assert through.where("blocked").count() == batch.where("blocked").count()


def test_state_matches_windows(spark):
    """First moments against the plain window, with null keys, ties in time and hot keys."""
    from pyspark.sql import Window

    rows = [(n, None if n % 11 == 0 else "hot" if n % 3 else f"d{n % 7}", n // 2, n % 13 == 5) for n in range(400)]
    log = spark.createDataFrame(rows, "n INT, d STRING, t INT, b BOOLEAN").withColumn("_first", F.lit("clash")).drop("_first")
    w = Window.partitionBy("d").orderBy("t", "n").rowsBetween(Window.unboundedPreceding, -1)
    want = log.withColumn("via_proxy", F.coalesce(F.max("b").over(w), F.lit(False)))
    got = stats.block_learning(log, "d", ["t", "n"], F.col("b"))
    assert sorted((r.n, r.via_proxy) for r in got.collect()) == sorted((r.n, r.via_proxy) for r in want.collect())
    kept = stats.not_stored_before(log, ["d"], ["t", "n"], F.col("b"))
    assert sorted(r.n for r in kept.collect()) == sorted(r.n for r in want.where("NOT via_proxy").collect())
    assert stats.block_learning(log.limit(0), "d", ["t", "n"], F.col("b")).count() == 0


def test_deep_comments(spark):
    chain = spark.range(1, 201).selectExpr("id", "id - 1 AS parent_id")
    assert sorted(r.depth for r in stats.comment_tree(chain).collect()) == list(range(200))
    assert stats.comment_tree(chain.limit(0)).count() == 0


def test_scratch_folder_needs_a_shared_one():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())


def test_sql_gate(spark):
    known = ("orders", "t")
    for text in ("SELECT * FROM secret", "SELECT 1 FROM orders o, secret s", "WITH a AS (SELECT 1) SELECT * FROM a JOIN b USING (x)", "SELECT (SELECT max(x) FROM hidden) FROM orders"):
        with pytest.raises(ValueError, match="unknown"):
            store.checked_sql(spark, text, known)
    assert store._named_tables("WITH a AS (SELECT 'from x' AS v FROM orders), b(c) AS (SELECT 1) SELECT * FROM a, b, orders o LEFT JOIN (SELECT * FROM t) u ON true -- from nothing") == {"orders", "t"}
    spark.createDataFrame([(1, "x", 5), (2, None, 6)], "id INT, status STRING, priority INT").createOrReplaceTempView("crawl_queue")
    got = store.rewritten(spark, "UPDATE crawl_queue SET status = 'a, b = c', priority = priority * 2 WHERE status IS NOT NULL")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a, b = c", 10), (2, None, 6)]
    for text in ("UPDATE crawl_queue SET nope = 1", "DELETE FROM secret", "INSERT INTO crawl_queue VALUES (1)"):
        with pytest.raises(ValueError):
            store.rewritten(spark, text)


def test_scratch_tables_are_deleted(spark):
    kept = session.stored(spark.range(3), "kept")
    with session.scratch(spark):
        gone = session.stored(spark.range(2), "gone")
        assert gone.count() == 2
        path = gone.inputFiles()[0]
    import os

    assert kept.count() == 3 and not os.path.exists(path.removeprefix("file:").replace("//", "/"))


def test_empty_and_odd_inputs(spark):
    """Every new operator over empty tables, nulls and clashing names."""
    items = spark.createDataFrame([(1, 1, None, None, None, None, None), (2, None, "u", "t" * 100_000, "", "x", "{broken")], "id BIGINT, spider_id BIGINT, url STRING, content STRING, title STRING, _first_moment STRING, metadata_json STRING")
    assert store.flattened(items).count() == 2 and store.exported(items.withColumns({"scraped_at": F.lit(""), "author": F.lit(""), "published_date": F.lit("")}), {}).count() == 2
    assert stats.item_limit(items, 1, ["id"]).count() == 2 and stats.health(items.withColumn("scraped_at", F.lit(None).cast("timestamp"))).count() == 2
    none = items.limit(0)
    assert store.exported(none.withColumns({"scraped_at": F.lit(""), "author": F.lit(""), "published_date": F.lit("")}), {"a": {"extract": {"x": {}}}}).count() == 0
    assert store.packed(none).count() == 0 and stats.jobs(none.select(F.col("url").alias("status"))).count() == 0
    pages = none.select("url", F.col("content").alias("html"))
    assert config.records(pages, {**BASE, "rules": [{"callback": "parse_article"}]}).count() == 0
    assert routing.followed(pages, [{"allow": ["x"]}]).count() == 0 and routing.reachable(pages.select(F.col("url").alias("page"), "url"), pages.select("url"), 3).count() == 0
    assert list(files.rendered(none.select("id"), "json")) == ["[]"]
