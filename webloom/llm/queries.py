"""Queries of the problems this subpackage solves, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import hostname
from webloom.llm import boilerplate, language, mixing, mojibake, names, neardup, packing, repeated_lines, residue
from webloom.llm.tokens import token_counts
from webloom.session import stored, table

EXPORT = "export_26022026_231803"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scraped_items")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of long contents whose label is missing or wrong or which are mixed."""
    return language.wrong_labels(_items(spark, sf_dir), language.train(table(spark, sf_dir, "lang_samples")))


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every title, content and segment of mixed content."""
    return language.label(_items(spark, sf_dir), language.train(table(spark, sf_dir, "lang_samples")))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of mixed contents: where each begins and ends (in characters), its
    language and confidence."""
    found = p2_languages(spark, sf_dir).select("id", F.posexplode("segments").alias("segment", "s"))
    return found.select("id", "segment", "s.start", "s.stop", "s.lang", "s.confidence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that share at least 0.6 of their runs of three words."""
    return neardup.similar_pairs(_items(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every long enough row."""
    return neardup.groups(_items(spark, sf_dir))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account of the groups: every long enough row is in one, copies are together."""
    items = _items(spark, sf_dir)
    grouped = neardup.groups(items).join(items.select("id", F.xxhash64("content").alias("text")), "id")
    each = grouped.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("g"))
    return each.agg(F.sum("n").alias("rows"), F.count("*").alias("texts"), F.max("g").alias("most"))


P3_COPIES_SQL = "SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT content) AS texts, CAST(1 AS BIGINT) AS most FROM scraped_items WHERE length(content) >= 500"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated within their spider."""
    return repeated_lines.repeated_positions(_items(spark, sf_dir), "spider_id", "id", "content")


P4_SQL = r"""
WITH docs AS (SELECT id, spider_id, content FROM scraped_items WHERE content IS NOT NULL),
split AS (SELECT id, spider_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM docs),
keyed AS (SELECT id, spider_id, line_no, lower(regexp_replace(line, '\P{L}+', '', 'g')) AS k FROM split),
common AS (
  SELECT spider_id, k FROM keyed WHERE k <> '' GROUP BY spider_id, k
  HAVING count(DISTINCT id) >= 4 AND count(DISTINCT id) >= 0.1 * (SELECT count(*) FROM docs d WHERE d.spider_id IS NOT DISTINCT FROM keyed.spider_id))
SELECT id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN common ON keyed.spider_id IS NOT DISTINCT FROM common.spider_id AND keyed.k = common.k
"""


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents without the lines their spiders repeat."""
    return repeated_lines.without_repeated(_items(spark, sf_dir), "spider_id", "id", "content").select("id", "content")


P4_CLEAN_SQL = P4_SQL.split("SELECT id, CAST(line_no")[0].replace("SELECT id, spider_id, line_no, lower(", "SELECT id, spider_id, line, line_no, lower(") + """
, kept AS (SELECT keyed.id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM keyed WHERE NOT EXISTS (SELECT 1 FROM common WHERE keyed.spider_id IS NOT DISTINCT FROM common.spider_id AND keyed.k = common.k) GROUP BY keyed.id)
SELECT i.id, CASE WHEN i.content IS NULL THEN NULL ELSE coalesce(kept.content, '') END AS content FROM scraped_items i LEFT JOIN kept ON kept.id = i.id
"""


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated blocks of lines of each spider, with the documents they span."""
    lines = stored(repeated_lines.keyed(_items(spark, sf_dir), "spider_id", "id", "content"), "lines")
    return repeated_lines.repeated_blocks(lines, repeated_lines.common_lines(lines, "spider_id"), "spider_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose title or content a template or server left."""
    return residue.detect(_items(spark, sf_dir)).select("id").distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that hold no residue."""
    return residue.without_residue(_items(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of author spellings that name the same person or organisation."""
    return names.variant_pairs(_items(spark, sf_dir))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every author spelling that names one."""
    return names.entities(_items(spark, sf_dir))


def p7_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, site, content) of items and export rows with at least 500 characters; the
    site is the host of the URL."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), "id", hostname(F.col("url")).alias("site"), "content") for t in ("scraped_items", EXPORT)]
    return parts[0].unionByName(parts[1]).where(F.length("content") >= 500)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines outside the main body; equal lines of rows that stand twice count once."""
    stops = boilerplate.stop_words(table(spark, sf_dir, "lang_samples"))
    return boilerplate.furniture_lines(p7_rows(spark, sf_dir), stops, ["tbl", "id"], source="site").distinct()


def p7_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each row."""
    stops = boilerplate.stop_words(table(spark, sf_dir, "lang_samples"))
    return boilerplate.main_body(p7_rows(spark, sf_dir), stops, ["tbl", "id"], source="site")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of each capacity."""
    sizes = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(sizes, table(spark, sf_dir, "token_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and room left of each capacity."""
    packed = p8_containers(spark, sf_dir).where("container_id IS NOT NULL").groupBy("budget_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    filled = packed.join(table(spark, sf_dir, "token_budgets"), "budget_id")
    return filled.select("budget_id", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def p8_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account of the containers: texts that take part, containers beyond their capacity,
    texts split that would fit, and texts whose pieces leave gaps."""
    packed = stored(p8_containers(spark, sf_dir), "packed")
    budgets = table(spark, sf_dir, "token_budgets").select("budget_id", F.col("capacity_tokens").alias("cap"))
    load = packed.where("container_id IS NOT NULL").groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(budgets, "budget_id")
    over = load.groupBy("budget_id").agg(F.count_if(F.col("n") > F.col("cap")).alias("overfull"))
    text = packed.groupBy("budget_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.min("token_start").alias("start")).join(budgets, "budget_id")
    own = text.groupBy("budget_id").agg(F.count("*").alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("cap"))).alias("split"), F.count_if((F.col("end") != F.col("n")) | (F.col("start") != 0)).alias("gaps"))
    return own.join(over, "budget_id").select("budget_id", "texts", "overfull", "split", "gaps")


P8_ACCOUNT_SQL = "SELECT budget_id, (SELECT count(*) FROM documents) AS texts, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS gaps FROM token_budgets"


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = stored(token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")), "sizes")
    return mixing.mix(sizes, table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mixed collection with their repeats."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mixed collection reaches."""
    return mixing.shares(*_mixed(spark, sf_dir))


def p9_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account of the mix: no target's texts are repeated too often, and the shares add
    up to one."""
    shares = p9_shares(spark, sf_dir)
    whole = shares.agg(F.round(F.sum("actual_share"), 6).alias("whole"))
    return shares.join(F.broadcast(whole), F.lit(True)).select("source", (F.col("repeats") <= F.greatest(F.lit(1), F.col("max_repeats"))).alias("within"), "whole")  # one row


P9_ACCOUNT_SQL = "SELECT source, true AS within, CAST(1.0 AS DOUBLE) AS whole FROM mix_targets"


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one character from a wrong decoding."""
    return mojibake.damaged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples")).select("doc_id").distinct()


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged texts, restored where that is possible."""
    return mojibake.repaired(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


_ALL = (p2_found, p2_languages, p2_segments, p3_found, p3_groups, p3_copies, p4_found, p4_blocks, p4_clean, p5_found, p5_clean, p6_found, p6_entities, p7_found, p7_bodies, p8_containers, p8_fill, p8_account, p9_mix, p9_shares, p9_account, p10_found, p10_repaired)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"p4_found": P4_SQL, "p3_copies": P3_COPIES_SQL, "p4_clean": P4_CLEAN_SQL, "p8_account": P8_ACCOUNT_SQL, "p9_account": P9_ACCOUNT_SQL}
