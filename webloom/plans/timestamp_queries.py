"""Queries of problem 1: published dates in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import timestamps as ts
from webloom.session import table

EXPORT = "export_26022026_231803"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.published_rows(table(spark, sf_dir, "scraped_items"), table(spark, sf_dir, EXPORT), EXPORT)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that names a definite instant, with it in UTC. The settings name the
    candidates for each source's offset history (UTC where they name none); where
    they name several, ingestion times decide. p1_zone_histories chooses freely."""
    rows = _rows(spark, sf_dir).where(F.col("published_date").isNotNull())
    out = ts.normalise_published(rows, table(spark, sf_dir, "spider_settings"), ingested="scraped_at")
    return out.where(F.col("utc").isNotNull()).select("tbl", "id", "utc").distinct()


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where(F.col("published_date").isNotNull())


def p1_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose time names no zone, converted by the offset history its source's
    ingestion times fit best among all IANA histories, and whether the setting agrees."""
    return ts.estimated(_dated(spark, sf_dir), table(spark, sf_dir, "spider_settings"))[0].select("tbl", "id", "utc", "agrees").distinct()


def p1_zone_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every spider the estimated history beside the configured zone, and for how many
    of its rows both give the same instant."""
    return ts.estimated(_dated(spark, sf_dir), table(spark, sf_dir, "spider_settings"))[1]


QUERIES = {"p1_found": p1_found, "p1_estimated": p1_estimated, "p1_zone_histories": p1_zone_histories}
