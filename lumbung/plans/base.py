"""What the queries share: current rows of tables that deliver rows again, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.sources.tables import read_table

#: One row of each article: the delivery harvested last, equal ones by the columns that may differ.
ARTICLES = """a AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_harvested_at DESC NULLS LAST, updated_at DESC NULLS LAST,
    processing_status DESC NULLS LAST, chunk_count DESC NULLS LAST, first_seen_at DESC NULLS LAST) AS rn FROM articles) WHERE rn = 1)"""
#: Distinct audit rows.
LOG = "q AS (SELECT DISTINCT * FROM query_log)"
ERRORS = "e AS (SELECT DISTINCT * FROM ingest_errors)"
#: The UTC day of a time.
DAY = "(DATE '1970-01-01' + CAST(floor(epoch_us({}) / 86400000000) AS INTEGER))"


def current_articles(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """One row of each id, by an aggregate over the columns asked for; others aren't read. ``where`` may only use columns
    that all deliveries of an id share (texts, names, labels, dates): it is applied before, and so reaches the scan."""
    order = ["last_harvested_at", "updated_at", "processing_status", "chunk_count", "first_seen_at"]
    df = read_table(spark, sf_dir, "articles")
    wanted = [c for c in (columns or df.columns) if c != "id"]
    best = (df if where is None else df.filter(where)).groupBy("id").agg(F.max_by(F.struct(*wanted), F.struct(*order)).alias("r"))
    return best.select("id", *(F.col(f"r.{c}").alias(c) for c in wanted))


def audit_log(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Distinct audit rows: a row delivered twice is one by its id."""
    df = read_table(spark, sf_dir, "query_log")
    return df.dropDuplicates(["id"]).select(*(columns or df.columns))


def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "ingest_errors").dropDuplicates(["id"])
