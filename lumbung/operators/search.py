"""Composite operators: hybrid retrieval from filters to reranked rows, and answers to catalogue asks."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.operators import bm25, retrieval
from lumbung.operators.filters import Filters, predicate, with_topics
from lumbung.operators.metadata import Listing

LIST_LIMIT = 50


@dataclass(frozen=True)
class Corpus:
    """What a search runs on: ``chunks`` (item_id, article_id, content, lexemes), ``articles`` (id and the columns of
    filters.predicate, title, keywords), the BM25 index of the chunks, ``vectors`` (item_id, embedding) and ``topics``
    (article_id, topic_slug)."""

    chunks: DataFrame
    articles: DataFrame
    index: bm25.Bm25Index
    vectors: DataFrame
    topics: DataFrame | None = None


def allowed_items(corpus: Corpus, f: Filters) -> DataFrame | None:
    """(item_id) of the chunks of the articles that pass, or None without a filter. It masks both channels before their
    ranking, so that a narrow filter still gives full lists."""
    if f.is_empty():
        return None
    articles = corpus.articles.filter(predicate(f))
    if f.topics:
        if corpus.topics is None:
            raise ValueError("a filter on topics needs the topics table")
        articles = with_topics(articles, corpus.topics, f.topics)
    return corpus.chunks.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi").select("item_id")


def retrieve(corpus: Corpus, query: str, variants: list[list[str]], vectors: list[list[float]], f: Filters | None = None, *, top_k: int = 8, candidates: int = 60, mode: str = "hybrid", per_article: int = retrieval.PER_ARTICLE) -> DataFrame:
    """The ``top_k`` chunks for a query: each variant's terms by BM25 and each vector by cosine, merged by the best score,
    fused by rank, the best of them reranked with their articles' fields, at most ``per_article`` of an article.

    ``mode``: hybrid, semantic or keyword; the last two give the other channel no weight. Each channel is bounded by
    ``candidates`` before the two meet; only the channels' own scans touch the whole corpus.
    """
    if mode not in ("hybrid", "semantic", "keyword"):
        raise ValueError(f"no such mode: {mode}")
    f = f or Filters()
    allowed = allowed_items(corpus, f)
    lexical = [bm25.search(corpus.index, words, candidates, allowed) for words in variants]
    semantic = [retrieval.vector_search(corpus.vectors, "item_id", "embedding", v, candidates, allowed) for v in vectors]
    if not lexical or not semantic:
        raise ValueError("a search needs terms and a vector; pass an empty list of terms for none")
    top = lambda channels: bm25.merge_by_max(*channels).orderBy(F.desc("score"), "item_id").limit(candidates)
    weights = {"w_semantic": 0.0 if mode == "keyword" else 1.0, "w_lexical": 0.0 if mode == "semantic" else 1.0}
    fused = retrieval.fuse(top(semantic), top(lexical), limit=max(candidates, 4 * top_k), **weights).filter("rrf > 0")
    details = corpus.articles.select(F.col("id").alias("article_id"), "title", "keywords", "doc_type", "published_at", F.year("published_at").alias("published_year"))
    rows = corpus.chunks.join(F.broadcast(fused), "item_id").join(details, "article_id")  # fused: at most max(candidates, 4 top_k) rows
    terms = sorted({t for words in variants for t in words})
    scored = retrieval.rerank_scores(rows, query, terms, has_date_filter=bool(f.date_from or f.date_to))
    return retrieval.diversify(scored, top_k, tie=["rank_semantic", "rank_lexical", "item_id"], per_article=per_article)


def listing_filters(intent: Listing, given: Filters | None = None) -> Filters:
    """The filters of a catalogue ask: the stated years replace their own side only."""
    f = given or Filters()
    return replace(f, date_from=date(intent.year_from, 1, 1) if intent.year_from else f.date_from, date_to=date(intent.year_to, 12, 31) if intent.year_to else f.date_to)


def list_articles(articles: DataFrame, f: Filters, limit: int = LIST_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(the newest articles that pass, up to ``limit``; one row with the true total)."""
    hits = articles.filter(predicate(f))
    return hits.orderBy(F.desc_nulls_last("published_at"), F.asc_nulls_last("title"), "id").limit(limit), hits.agg(F.count("*").alias("total"))


def list_about(corpus: Corpus, query: str, variants: list[list[str]], vectors: list[list[float]], f: Filters, *, least_similarity: float, limit: int = LIST_LIMIT) -> DataFrame:
    """A catalogue ask with a subject: retrieval decides, one row of each article; nothing if the best similarity is
    below the floor."""
    rows = retrieve(corpus, query, variants, vectors, f, top_k=limit, per_article=limit)
    best = rows.agg(F.max(F.coalesce("semantic", F.lit(0.0))).alias("best")).scalar()
    kept = rows.filter(best >= least_similarity)
    return retrieval.best_per_article(kept)


# The sentences of a catalogue's answer.
ANSWERS = {
    "en": {"none": "No articles{scope} were found in the collection.", "some": "There are {total} articles{scope} in the collection:", "first": " (the first {shown})", "in": " published in {a}", "both": " published between {a} and {b}", "since": " published since {a}", "until": " published up to {b}", "about": ' about "{topic}"', "untitled": "(untitled)"},
    "id": {"none": "Tidak ditemukan artikel{scope} dalam koleksi.", "some": "Terdapat {total} artikel{scope} dalam koleksi:", "first": " ({shown} yang pertama)", "in": " yang terbit pada tahun {a}", "both": " yang terbit antara {a} dan {b}", "since": " yang terbit sejak {a}", "until": " yang terbit sampai {b}", "about": ' tentang "{topic}"', "untitled": "(tanpa judul)"},
}


def catalogue_answer(intent: Listing, rows: list[dict], total: int) -> str:
    """The answer to a catalogue ask: how many articles there are, and those listed (title, publisher, published_at,
    doc_type), each with its number in square brackets. ``rows`` are the at most LIST_LIMIT of list_articles."""
    say = ANSWERS.get(intent.language, ANSWERS["en"])
    a, b = intent.year_from, intent.year_to
    years = "" if not (a or b) else say["in" if a == b else "both" if a and b else "since" if a else "until"]
    scope = (years + (say["about"] if intent.topic else "")).format(a=a, b=b, topic=intent.topic)
    if not rows:
        return say["none"].format(scope=scope)
    lines = [(say["some"] + (say["first"] if total > len(rows) else "")).format(total=total, scope=scope, shown=len(rows))]
    for n, r in enumerate(rows, 1):
        title = (r.get("title") or say["untitled"]).replace("*", "")  # a star would set bold type
        details = ", ".join(str(x) for x in (r.get("publisher"), r.get("published_at")) if x)
        kind = f" · {r['doc_type'].replace('-', ' ')}" if r.get("doc_type") else ""
        lines.append(f"**{n}. {title}**" + (f" — {details}" if details else "") + f"{kind} [{n}]")
    return "\n\n".join(lines)
