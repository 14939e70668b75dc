"""What each stage of an ingest still has to do, as filters and joins over the stage's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A record whose text couldn't be read this often is left alone.
MOST_ATTEMPTS = 3


def pending_pdfs(articles: DataFrame, failures: DataFrame) -> DataFrame:
    """Articles (id, doc_type, pdf_url, processing_status, full_text_status) whose PDF is to be read: journal articles with
    an address, not archived, not done, and not among those that ``failures`` (article_id, one row a failure) holds
    MOST_ATTEMPTS times."""
    given_up = failures.groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= MOST_ATTEMPTS)
    open_ = F.col("pdf_url").isNotNull() & (F.col("doc_type") == "journal-article") & ~F.col("processing_status").eqNullSafe("archived") & ~F.col("full_text_status").eqNullSafe("extracted")
    return articles.filter(open_).join(given_up, "id", "left_anti")


def pending_chunking(articles: DataFrame, links: DataFrame, states: tuple[str, ...] = ("pending", "processing", "ready")) -> DataFrame:
    """Articles in one of the states that duplicate no other (``links``: id, duplicate_of_id) and have no chunk."""
    open_ = F.col("processing_status").isin(*states) & (F.coalesce("chunk_count", F.lit(0)) == 0)
    return articles.filter(open_).join(links.filter("duplicate_of_id is not null").select("id"), "id", "left_anti")


def pending_vectors(chunks: DataFrame, vectors: DataFrame, model: str | None = None) -> DataFrame:
    """Chunks (item_id) without a vector; with ``model``, also those whose vector (item_id, model) is of another one."""
    done = vectors if model is None else vectors.filter(F.col("model").eqNullSafe(model))
    return chunks.join(done.select("item_id"), "item_id", "left_anti")


def pending_topics(articles: DataFrame, links: DataFrame, again: bool = False) -> DataFrame:
    """Articles (id, topic, processing_status) that are to be classified: not archived, no duplicates, not labelled by hand
    (topic_source), and without a label, or all of these ``again``."""
    by_hand = F.col("topic_source").eqNullSafe("manual") if "topic_source" in articles.columns else F.lit(False)
    open_ = ~F.col("processing_status").eqNullSafe("archived") & ~by_hand & (F.lit(again) | (F.coalesce(F.trim("topic"), F.lit("")) == ""))
    return articles.filter(open_).join(links.filter("duplicate_of_id is not null").select("id"), "id", "left_anti")


def pending_analysis(items: DataFrame, monitored: DataFrame, analysis: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """(issue_id, article_id) pairs that lack an analysis: items (article_id, outlet_id, published_at) of the outlets that an
    issue monitors (issue_id, outlet_id), of the last ``days`` days. Both keys of a pair must agree."""
    at = F.lit(as_of).cast("timestamp")
    recent = items.filter(F.col("published_at") > at - F.expr(f"INTERVAL {days} DAYS"))
    return recent.join(monitored, "outlet_id").select("issue_id", "article_id").join(analysis.select("issue_id", "article_id"), ["issue_id", "article_id"], "left_anti")
