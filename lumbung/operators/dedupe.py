"""Linking duplicates in layers: identifier, content, title with year. Rows are linked, never merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.session import cut

LAYERS = ("doi", "content_hash", "title_year")


def relink(articles: DataFrame, *, id_col: str = "id") -> DataFrame:
    """``articles`` with new duplicate_of_id and duplicate_reason.

    Input columns: the id, first_seen_at, source_id, doc_type, doi, content_hash, dedup_key; optional: archived, and
    duplicate_of_id with duplicate_reason, of which rows with the reason ``manual`` are kept as they are (they may be
    canonical). In each layer the first row by (first_seen_at, source_id, id) is canonical; a later layer sees only rows
    without a link. Titles link only across sources or kinds. Keys that are null link nothing.
    """
    have = set(articles.columns)
    base = articles.withColumn("archived__", F.coalesce("archived", F.lit(False)) if "archived" in have else F.lit(False))
    manual = F.coalesce(F.col("duplicate_reason") == "manual", F.lit(False)) if "duplicate_reason" in have else F.lit(False)
    old = F.col("duplicate_of_id") if "duplicate_of_id" in have else F.lit(None)
    kind = articles.schema[id_col].dataType
    state = base.select(F.col(id_col).alias("id"), "first_seen_at", "source_id", "doc_type", F.lower("doi").alias("doi"), "content_hash", F.col("dedup_key").alias("title_year"), "archived__", manual.alias("manual"), F.when(manual, old).cast(kind).alias("to"), F.when(manual, F.lit("manual")).alias("why"))
    for layer in LAYERS:
        open_ = F.col(layer).isNotNull() & ~F.col("archived__") & F.col("to").isNull()
        # pre-aggregated by key, then joined back: a key that many rows share is never one task's window
        firsts = state.filter(open_).groupBy(F.col(layer).alias("k__")).agg(F.min(F.struct("first_seen_at", "source_id", "id"))["id"].alias("first__"), ((F.min("source_id") != F.max("source_id")) | (F.min("doc_type") != F.max("doc_type"))).alias("spread__"), F.count("*").alias("n__")).filter("n__ > 1")
        if layer == "title_year":
            firsts = firsts.filter("spread__")
        # rows outside the layer look up their own id, so that a common null is no hot key
        state = state.withColumn("k__", F.when(open_ & ~F.col("manual"), F.col(layer)).otherwise(F.concat(F.lit("\u0000"), F.col("id").cast("string"))))
        state = state.join(firsts.select("k__", "first__"), "k__", "left")
        hit = F.col("first__").isNotNull() & (F.col("first__") != F.col("id"))
        state = state.withColumns({"why": F.when(hit, F.lit(layer)).otherwise(F.col("why")), "to": F.when(hit, F.col("first__")).otherwise(F.col("to"))}).drop("k__", "first__")
    links = state.select(F.col("id").alias(id_col), F.col("to").alias("duplicate_of_id"), F.col("why").alias("duplicate_reason"))
    return articles.drop("duplicate_of_id", "duplicate_reason").join(links, id_col)


def link_counts(linked: DataFrame) -> DataFrame:
    return linked.filter("duplicate_reason is not null").groupBy("duplicate_reason").agg(F.count("*").alias("links"))


def cut_links(linked: DataFrame) -> DataFrame:
    """The links alone, as a table that later stages read."""
    return cut(linked.filter("duplicate_of_id is not null").select("id", "duplicate_of_id", "duplicate_reason"), "links")
