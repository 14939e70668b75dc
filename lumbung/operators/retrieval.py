"""Hybrid retrieval: vector search, rank fusion, reranking, diversity, evidence, citations, context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbung.functions import vectors
from lumbung.functions.text import snippet

RRF_K = 60
RECENCY_YEARS = 8
PER_ARTICLE = 2
# How much a kind of document weighs; others weigh OTHER_KIND.
KIND_WEIGHTS = {
    "journal-article": 1.00, "brief-report": 0.92, "book": 0.90, "opinion": 0.82, "archive": 0.78, "post": 0.75, "works-archive": 0.70,
    "e-newsletter": 0.62, "media-coverage": 0.58, "podcast": 0.55, "infographic": 0.55,
}
OTHER_KIND = 0.7
BONUS = {"coverage": 0.25, "phrase": 0.15, "title": 0.10, "recency": 0.05}


def vector_search(df: DataFrame, id_col: str, vector_col: str, query: list[float], limit: int = 60, allowed: DataFrame | None = None) -> DataFrame:
    """(item_id, score) of the nearest vectors by exact cosine, ties by id; null and zero vectors have no score. A scan
    that keeps ``limit`` rows of each partition."""
    slim = df.select(F.col(id_col).alias("item_id"), F.col(vector_col).alias("v"))
    if allowed is not None:
        slim = slim.join(allowed.select("item_id"), "item_id", "left_semi")
    scored = slim.select("item_id", vectors.cosine(F.col("v"), vectors.literal(query)).alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), "item_id").limit(limit)


def ranked(channel: DataFrame) -> DataFrame:
    """Adds rank, from 1, to the rows (item_id, score) of a channel, which is bounded by its limit."""
    return channel.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))


def fuse(semantic: DataFrame, lexical: DataFrame, *, k: int = RRF_K, w_semantic: float = 1.0, w_lexical: float = 1.0, limit: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of two bounded channels: (item_id, rrf, semantic, lexical, rank_semantic,
    rank_lexical). Ties go to the better semantic rank, then to the better lexical one."""
    s = ranked(semantic).select("item_id", F.col("score").alias("semantic"), F.col("rank").alias("rank_semantic"))
    x = ranked(lexical).select("item_id", F.col("score").alias("lexical"), F.col("rank").alias("rank_lexical"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    out = s.join(x, "item_id", "full_outer").withColumn("rrf", part(w_semantic, "rank_semantic") + part(w_lexical, "rank_lexical"))
    if limit:
        out = out.orderBy(F.desc("rrf"), F.asc_nulls_last("rank_semantic"), F.asc_nulls_last("rank_lexical"), "item_id").limit(limit)
    return out.select("item_id", "rrf", "semantic", "lexical", "rank_semantic", "rank_lexical")


def kind_weight(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(OTHER_KIND))


def coverage(words: Column, query_terms: list[str]) -> Column:
    """Share of the query's terms among the words; 0 without terms or words."""
    wanted = sorted(set(query_terms))
    if not wanted:
        return F.lit(0.0)
    return F.coalesce(F.size(F.array_intersect(words, F.array(*map(F.lit, wanted)))) / F.lit(len(wanted)), F.lit(0.0))


def rerank_scores(candidates: DataFrame, query: str, query_terms: list[str], *, has_date_filter: bool = False) -> DataFrame:
    """Adds the signals and ``rerank`` to candidates (rrf, lexemes, title, keywords, content, doc_type, published_year):
    the fused score, raised by how much of the query they hold, times the squared weight of their kind."""
    quoted = [q.lower() for q in re.findall(r'"([^"]{3,})"', query)]
    phrase = F.lit(0.0)
    for q in quoted:
        phrase = F.when(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(q)), F.lit(1.0)).otherwise(phrase)
    title = F.split(F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")), r"\s+")
    newest = F.max("published_year").over(Window.partitionBy(F.lit(1)))  # candidates are a bounded set
    age = newest - F.col("published_year")
    recency = F.when(F.col("published_year").isNull() | F.lit(has_date_filter), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - age / F.lit(float(RECENCY_YEARS)))))
    out = candidates.withColumns({"coverage": coverage(F.col("lexemes"), query_terms), "phrase": phrase, "title_overlap": coverage(title, query_terms), "kind_weight": kind_weight(F.col("doc_type")), "recency": recency})
    bonus = 1.0 + BONUS["coverage"] * F.col("coverage") + BONUS["phrase"] * F.col("phrase") + BONUS["title"] * F.col("title_overlap") + BONUS["recency"] * F.col("recency")
    return out.withColumn("rerank", F.col("rrf") * bonus * F.col("kind_weight") * F.col("kind_weight"))


def diversify(scored: DataFrame, top_k: int, *, article: str = "article_id", score: str = "rerank", tie: list[str] | None = None, per_article: int = PER_ARTICLE) -> DataFrame:
    """The best ``top_k`` rows with at most ``per_article`` of an article; rows over that only fill what is left. Adds
    ``position``, from 1."""
    ties = [F.asc_nulls_last(c) for c in tie or ["item_id"]]
    within = F.row_number().over(Window.partitionBy(article).orderBy(F.desc(score), *ties))
    over = scored.withColumn("over_cap", within > per_article)
    best = over.orderBy("over_cap", F.desc(score), *ties).limit(top_k)
    return best.withColumn("position", F.row_number().over(Window.orderBy("over_cap", F.desc(score), *ties))).drop("over_cap")


def best_per_article(rows: DataFrame, *, article: str = "article_id", score: str = "rerank", tie: str = "item_id") -> DataFrame:
    """One row of each article: the best, the first on equal scores."""
    n = F.row_number().over(Window.partitionBy(article).orderBy(F.desc(score), tie))
    return rows.withColumn("n__", n).filter("n__ = 1").drop("n__")


def evidence(rows: DataFrame, *, least_similarity: float, least_rerank: float, least_rows: int = 2) -> DataFrame:
    """One row (max_similarity, strong_rows, has_evidence) of the returned rows; a null similarity counts as 0."""
    out = rows.agg(F.coalesce(F.max(F.coalesce("semantic", F.lit(0.0))), F.lit(0.0)).alias("max_similarity"), F.count_if(F.col("rerank") >= least_rerank).alias("strong_rows"))
    return out.withColumn("has_evidence", (F.col("max_similarity") >= least_similarity) & (F.col("strong_rows") >= least_rows))


def fit_context(citations: DataFrame, budget: int, *, group: list[str] | None = None) -> DataFrame:
    """Citations (position, tokens) from the front whose running sum stays within the budget, the first always, with a
    new ``index`` from 1."""
    keys = group or []
    w = Window.partitionBy(*keys).orderBy("position")
    kept = citations.withColumn("running", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumns({"index": F.row_number().over(w), "original_index": F.col("position")})
    return kept.filter((F.col("running") <= budget) | (F.col("index") == 1))


def cited(answer: Column) -> Column:
    """The numbers in square brackets of a text, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,3})\]"), 1), lambda x: x.cast("int"))


def check_citations(answers: DataFrame, answer: str, sources: str) -> DataFrame:
    """Adds checked_answer, used, invalid and grounded: numbers above the count in ``sources`` are taken out of the text;
    an answer is grounded if it cites a source or has at most 200 characters."""
    text, most = F.coalesce(F.col(answer), F.lit("")), F.col(sources)
    found = cited(text)
    invalid = F.filter(found, lambda x: (x < 1) | (x > most))
    plain = F.aggregate(F.array_distinct(invalid), text, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"\[0*"), x.cast("string"), F.lit(r"\]")), F.lit("")))
    clean = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s+([.,;:])", "$1"), r"[ \t]{2,}", " "))
    used = F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= most))))
    return answers.withColumns({"checked_answer": clean, "used": used, "invalid": invalid}).withColumn("grounded", (F.size("used") > 0) | (F.length("checked_answer") <= 200))


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (5, 10), by: list[str] | None = None) -> DataFrame:
    """Recall at each k and the mean reciprocal rank of (rank), null where nothing relevant was found."""
    out = ranks.groupBy(*(by or [])).agg(*(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("questions"))
    return out


def distinct_ranks(hits: DataFrame, key: str, group: str, at: str) -> DataFrame:
    """(key, group, rank): the place of each group among the distinct groups of a ranked list, by its first hit."""
    first = hits.groupBy(key, group).agg(F.min(at).alias("at__"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("at__", group))).drop("at__")


#: The columns that a page may be sorted by.
SORTABLE = ("title", "published_at", "updated_at", "chunk_count")


def page(rows: DataFrame, sort: str, *, ascending: bool = False, limit: int = 25, offset: int = 0, tie: str = "id") -> DataFrame:
    """One page of a list: sorted by one of SORTABLE, nulls last, equals by id."""
    if sort not in SORTABLE:
        raise ValueError(f"not to be sorted by: {sort}")
    by = F.asc_nulls_last(sort) if ascending else F.desc_nulls_last(sort)
    return rows.orderBy(by, tie).offset(offset).limit(limit)


def build_citations(ranked: DataFrame, terms: list[str]) -> DataFrame:
    """What an answer may cite of ranked rows (position, article_id, item_id, title, publisher, journal, source_name,
    published_at, url, content, rerank): numbered from 1 in their order, with the sentences that hold most of the terms,
    the score to five places, and the whole content for the model."""
    day = F.date_format("published_at", "yyyy-MM-dd")
    return ranked.select(F.row_number().over(Window.orderBy("position")).alias("index"), "article_id", F.col("item_id").alias("chunk_id"), "title", "publisher", F.coalesce("journal", "source_name").alias("source"), day.alias("published_at"), "url", "content", snippet(F.col("content"), terms).alias("snippet"), F.round(F.coalesce("rerank", F.lit(0.0)), 5).alias("score"))  # a handful of rows
