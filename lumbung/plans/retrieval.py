"""Queries of retrieval: language, BM25, vectors, fusion, reranking, evidence, context, chunks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions import language, lexer, text, vectors
from lumbung.operators import bm25, chunks, pdf, retrieval, store
from lumbung.operators.filters import retrievable
from lumbung.plans.base import ARTICLES, audit_log, current_articles
from lumbung.plans.catalog import _LAYERS, duplicate_links
from lumbung.session import work_dir
from lumbung.sources.tables import read_dimension, read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TERMS = ["solar", "inverter", "clipping", "modul", "surya"]
INDONESIAN = "lang = 'id'"
VARIANT = ["wind", "farm", "kebun", "angin"]
_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_LEX = f"""d AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), lambda w: length(w) > 1 AND w NOT IN {_LIST(lexer.STOPWORDS)}) AS lex FROM documents),
n AS (SELECT count(*) AS n, avg(len(lex)) AS avg_len FROM d WHERE len(lex) > 0)"""


def _bm25_sql(words: list[str], where: str = "true", name: str = "b") -> str:
    return f"""{name}_p AS (SELECT doc_id, len(lex) AS doc_len, unnest(lex) AS term FROM d), {name}_f AS (SELECT term, ln(1 + (n.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}_p, n WHERE term IN {_LIST(words)} GROUP BY term, n.n),
{name} AS (SELECT p.doc_id AS item_id, sum(f.idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * p.doc_len / n.avg_len))) AS score FROM {name}_p p JOIN {name}_f f ON f.term = p.term, n WHERE p.doc_id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY 1)"""


def _published(spark: SparkSession, sf_dir: str, name: str, build) -> bm25.Bm25Index:
    """The index published under ``name``; published at its first use in an application. Later searches only read it."""
    base = f"{work_dir(spark)}/index/{name}/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    if not bm25.published(spark, base):
        bm25.publish_index(build(), base)
    return bm25.read_index(spark, base)


def _index(spark: SparkSession, sf_dir: str) -> bm25.Bm25Index:
    return _published(spark, sf_dir, "documents", lambda: bm25.build_index(read_table(spark, sf_dir, "documents"), "doc_id", "text"))


_READY = f"""{ARTICLES}, {_LAYERS}, ok AS (SELECT a.id, a.title, a.abstract, a.full_text, a.source_slug FROM a JOIN m3 ON m3.id = a.id WHERE a.processing_status = 'ready' AND coalesce(to1, to2, to3) IS NULL)"""


def retrievable_articles(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Ready articles that duplicate no other."""
    a = current_articles(spark, sf_dir, ["processing_status", *columns])
    return a.join(duplicate_links(spark, sf_dir).select("id", "duplicate_of_id"), "id", "left").filter(retrievable()).select("id", *columns)


@query(f"WITH {_READY} SELECT id, source_slug FROM ok")
def retrievable_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrievable_articles(spark, sf_dir, ["source_slug"])


ASKED = ["field", "notes", "solar", "panel", "stasiun"]


@query(f"""WITH {_READY}, d AS (SELECT id AS doc_id, list_filter(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, abstract, full_text)), '[a-z0-9]+')), lambda w: length(w) > 1 AND w NOT IN {_LIST(lexer.STOPWORDS)}) AS lex FROM ok),
n AS (SELECT count(*) AS n, avg(len(lex)) AS avg_len FROM d WHERE len(lex) > 0), documents AS (SELECT doc_id FROM d), {_bm25_sql(ASKED)} SELECT item_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, item_id LIMIT 60""")
def search_ready_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index holds ready articles only, so no search returns others."""

    def build() -> bm25.Bm25Index:
        a = retrievable_articles(spark, sf_dir, ["title", "abstract", "full_text"])
        return bm25.build_index(a.select("id", F.concat_ws(" ", "title", "abstract", "full_text").alias("text")), "id", "text")

    return bm25.search(_published(spark, sf_dir, "articles", build), ASKED).select("item_id", F.round("score", 6).alias("score"))


@query(f"WITH {_LEX}, p AS (SELECT unnest(lex) AS term FROM d) SELECT term, count(*) AS df, round(ln(1 + (n.n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, n GROUP BY term, n.n")
def bm25_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequencies(_index(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_LEX} SELECT count(*) AS documents, sum(len(lex))::BIGINT AS terms, round(avg(len(lex)), 6) AS avg_len FROM d WHERE len(lex) > 0")
def bm25_doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).lengths.agg(F.count("*").alias("documents"), F.sum("doc_len").alias("terms"), F.round(F.avg("doc_len"), 6).alias("avg_len"))


@query(f"WITH {_LEX}, {_bm25_sql(TERMS)} SELECT item_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, item_id LIMIT 60")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(_index(spark, sf_dir), TERMS).select("item_id", F.round("score", 6).alias("score"))


@query(f"WITH {_LEX}, {_bm25_sql(TERMS, INDONESIAN)} SELECT item_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, item_id LIMIT 60")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = read_table(spark, sf_dir, "documents").filter("lang = 'id'").select(F.col("doc_id").alias("item_id"))
    return bm25.search(_index(spark, sf_dir), TERMS, allowed=allowed).select("item_id", F.round("score", 6).alias("score"))


@query(f"WITH {_LEX}, {_bm25_sql(TERMS)}, {_bm25_sql(VARIANT, name='v')}, u AS (SELECT * FROM b UNION ALL SELECT * FROM v) SELECT item_id, round(max(score), 6) AS score FROM u GROUP BY 1")
def bm25_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return bm25.merge_by_max(bm25.search(index, TERMS, None), bm25.search(index, VARIANT, None)).select("item_id", F.round("score", 6).alias("score"))


@query(f"WITH {_LEX} SELECT doc_id FROM d WHERE list_has_all(lex, ['solar', 'wind'])")
def fts_match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", lexer.terms(F.col("text")).alias("lex"))
    return d.filter(F.array_contains("lex", "solar") & F.array_contains("lex", "wind")).select("doc_id")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(read_table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


_COS = "qv AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS item_id, label, list_cosine_similarity(embedding::DOUBLE[], qv.v) AS score FROM embeddings, qv)"


@query(f"WITH {_COS} SELECT item_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, item_id LIMIT 60")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return retrieval.vector_search(e, "vec_id", "embedding", _query_vector(spark, sf_dir)).select("item_id", F.round("score", 6).alias("score"))


@query(f"WITH {_COS} SELECT item_id, round(score, 6) AS score FROM s WHERE label IN (1, 3) ORDER BY s.score DESC, item_id LIMIT 60")
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    allowed = e.filter("label in (1, 3)").select(F.col("vec_id").alias("item_id"))
    return retrieval.vector_search(e, "vec_id", "embedding", _query_vector(spark, sf_dir), allowed=allowed).select("item_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def l2_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.try_element_at(vectors.l2_normalize(F.col("embedding")), F.lit(1)), 6).alias("first"))


_FUSE = f"""{_LEX}, {_bm25_sql(TERMS)}, {_COS},
lx AS (SELECT item_id, score AS lexical, row_number() OVER (ORDER BY score DESC, item_id) AS rl FROM b QUALIFY rl <= 60),
sm AS (SELECT item_id, score AS semantic, row_number() OVER (ORDER BY score DESC, item_id) AS rs FROM s QUALIFY rs <= 60),
fu AS (SELECT coalesce(lx.item_id, sm.item_id) AS item_id, coalesce(1.0 / (60 + rs), 0) + coalesce(1.0 / (60 + rl), 0) AS rrf, semantic, lexical, rs, rl FROM lx FULL OUTER JOIN sm ON lx.item_id = sm.item_id)"""


def _fused(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Documents and vectors share ids here only as numbers: the channels stand for two views of one item."""
    lexical = bm25.search(_index(spark, sf_dir), TERMS)
    semantic = retrieval.vector_search(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir))
    return retrieval.fuse(semantic, lexical, limit=limit)


@query(f"WITH {_FUSE} SELECT item_id, round(rrf, 9) AS rrf, CAST(rs AS INTEGER) AS rank_semantic, CAST(rl AS INTEGER) AS rank_lexical FROM fu")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("item_id", F.round("rrf", 9).alias("rrf"), "rank_semantic", "rank_lexical")


_KINDS = "CASE d.doc_type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in retrieval.KIND_WEIGHTS.items()) + f" ELSE {retrieval.OTHER_KIND} END"
_RERANK = f"""{_FUSE}, top AS (SELECT * FROM fu ORDER BY rrf DESC, rs NULLS LAST, rl NULLS LAST, item_id LIMIT 60),
c AS (SELECT top.*, d.source AS article_id, x.lex, lower(coalesce(d.section, '')) AS title, coalesce(year(d.published_at), NULL) AS y, {_KINDS} AS k FROM top JOIN documents d ON d.doc_id = top.item_id JOIN d x ON x.doc_id = top.item_id),
r AS (SELECT *, rrf * (1 + 0.25 * len(list_intersect(lex, {TERMS!r})) / {len(TERMS)} + 0.10 * (CASE WHEN title IN {_LIST(TERMS)} THEN 1 ELSE 0 END) / {len(TERMS)} + 0.05 * CASE WHEN y IS NULL THEN 0 ELSE greatest(0, least(1, 1 - (max(y) OVER () - y) / 8.0)) END) * k * k AS rerank FROM c)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("article_id"), "doc_type", F.col("section").alias("title"), F.col("text").alias("content"), F.year("published_at").alias("published_year"), lexer.terms(F.col("text")).alias("lexemes"))
    rows = F.broadcast(_fused(spark, sf_dir, 60)).join(d, "item_id").withColumn("keywords", F.array().cast("array<string>"))  # 60 rows
    return retrieval.rerank_scores(rows, " ".join(TERMS), TERMS)


@query(f"WITH {_RERANK} SELECT item_id, round(rerank, 9) AS rerank FROM r")
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("item_id", F.round("rerank", 9).alias("rerank"))


_TIES = ["rank_semantic", "rank_lexical", "item_id"]


@query(f"WITH {_RERANK}, o AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY rerank DESC, rs NULLS LAST, rl NULLS LAST, item_id) > 2 AS over FROM r) SELECT item_id, CAST(row_number() OVER (ORDER BY over, rerank DESC, rs NULLS LAST, rl NULLS LAST, item_id) AS INTEGER) AS position FROM o QUALIFY position <= 8")
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: both channels, fused, reranked, at most two of a source, the best eight."""
    return retrieval.diversify(_reranked(spark, sf_dir), 8, tie=_TIES).select("item_id", "position")


@query(f"WITH {_RERANK} SELECT article_id, arg_max(item_id, (rerank, -item_id)) AS item_id FROM r GROUP BY article_id")
def best_chunk_per_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_per_article(_reranked(spark, sf_dir)).select("article_id", "item_id")


@query(f"WITH {_RERANK} SELECT round(max(coalesce(semantic, 0)), 6) AS max_similarity, count(*) FILTER (WHERE rerank >= 0.012) AS strong_rows, max(coalesce(semantic, 0)) >= 0.82 AND count(*) FILTER (WHERE rerank >= 0.012) >= 2 AS has_evidence FROM r")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.evidence(_reranked(spark, sf_dir), least_similarity=0.82, least_rerank=0.012).withColumn("max_similarity", F.round("max_similarity", 6))


@query("WITH t AS (SELECT doc_id, source, published_at, floor(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: length(w) > 0)) * 1.4::DOUBLE)::INTEGER + 1 AS tokens FROM documents WHERE source IS NOT NULL), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source, published_at ORDER BY doc_id) AS run, row_number() OVER (PARTITION BY source, published_at ORDER BY doc_id) AS n FROM t) SELECT doc_id, tokens, CAST(n AS INTEGER) AS index FROM r WHERE run <= 1200 OR n = 1")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source published on a day, as the sources of one answer."""
    d = read_table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", "source", "published_at", F.col("doc_id").alias("position"), text.estimated_tokens(F.col("text")).alias("tokens"))
    return retrieval.fit_context(d, 1_200, group=["source", "published_at"]).select("doc_id", "tokens", "index")


@query("""WITH q AS (SELECT DISTINCT * FROM query_log), t AS (SELECT id, unnest(retrieved_chunk_ids) AS c, generate_subscripts(retrieved_chunk_ids, 1) AS rank FROM q), r AS (SELECT q.endpoint, q.id, min(t.rank) FILTER (WHERE t.c % 7 = q.id % 7) AS rank FROM q LEFT JOIN t ON t.id = q.id GROUP BY 1, 2)
SELECT endpoint, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) AS questions FROM r GROUP BY 1""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the first relevant chunk of each logged search; chunks whose id agrees with the query's modulo 7 stand
    for relevant ones, since there is no judgement in the tables."""
    q = audit_log(spark, sf_dir, ["id", "endpoint", "retrieved_chunk_ids"])
    hits = F.transform("retrieved_chunk_ids", lambda c, i: F.when(c % 7 == F.col("id") % 7, i + 1))
    ranks = q.select("endpoint", F.array_min(F.filter(hits, lambda x: x.isNotNull())).alias("rank"))
    out = retrieval.recall_at(ranks, by=["endpoint"])
    return out.select("endpoint", *(F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")), "questions")


_ID, _EN, _IDC = (_LIST(w) for w in (language.ID_WORDS, language.EN_WORDS, sorted({*language.ID_WORDS, *language.ID_CONTENT})))


@query(f"""WITH t AS (SELECT doc_id, length(trim(text)) AS n, regexp_extract_all(lower(trim(text)), '[a-zÀ-ɏ]+') AS w FROM documents),
h AS (SELECT doc_id, n, len(w) AS k, len(list_filter(w, lambda x: x IN {_ID})) AS i, len(list_filter(w, lambda x: x IN {_EN})) AS e, len(list_filter(w, lambda x: x IN {_IDC})) + len(list_filter(w, lambda x: regexp_matches(x, '{language.ID_AFFIXES}'))) AS s FROM t)
SELECT doc_id, CASE WHEN n < 12 OR k = 0 THEN NULL WHEN n >= 200 AND i + e > 0 THEN CASE WHEN i > e THEN 'id' ELSE 'en' END WHEN s <> e THEN CASE WHEN s > e THEN 'id' ELSE 'en' END END AS language,
CASE WHEN n < 12 OR k = 0 THEN 0.0 WHEN n >= 200 AND i + e > 0 THEN round_even(abs(i - e) / (i + e)::DOUBLE, 3) WHEN s <> e THEN round_even(least(0.6, abs(s - e) / greatest(k, 1)::DOUBLE * 3), 3) ELSE 0.0 END AS confidence FROM h""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", language.detect(F.col("text")).alias("x"))
    return d.select("doc_id", "x.language", "x.confidence")


@query(f"WITH {ARTICLES} SELECT id, CASE WHEN substr(lower(trim(language)), 1, 3) IN ('en', 'eng') THEN 'en' WHEN substr(lower(trim(language)), 1, 3) IN ('id', 'ind', 'in') THEN 'id' WHEN url LIKE '%/id/%' THEN 'id' WHEN url LIKE '%/en/%' THEN 'en' END AS declared FROM a WHERE substr(lower(trim(language)), 1, 3) IN ('en', 'eng', 'id', 'ind', 'in') OR url LIKE '%/id/%' OR url LIKE '%/en/%'")
def language_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["language", "full_text", "url", "title"])
    r = a.select("id", language.resolve(F.col("language"), F.col("full_text"), F.col("url"), F.col("title")).alias("x"))
    return r.filter("x.source = 'declared'").select("id", F.col("x.language").alias("declared"))


@query()
def chunked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every article's body, or abstract, or title."""
    return chunks.chunk_documents(current_articles(spark, sf_dir, ["full_text", "abstract", "title"]), "id", ["full_text", "abstract", "title"])


@query()
def stemmed_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", lexer.lexemes(F.col("text"), F.col("lang")).alias("lexemes"))


@query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = bm25.search(_index(spark, sf_dir), TERMS)
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return F.broadcast(best).join(d, "item_id").select("item_id", text.snippet(F.col("text"), TERMS).alias("snippet"))  # 60 rows


@query(f"WITH {ARTICLES}, t AS (SELECT id, full_text AS x FROM a WHERE full_text IS NOT NULL) SELECT id, CASE WHEN length(x) >= 500 AND length(regexp_replace(x, '[^\\p{{L}}\\s]', '', 'g')) >= length(x) * 0.60 THEN 'extracted' ELSE 'poor' END AS quality FROM t")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_articles(spark, sf_dir, ["full_text"]).filter("full_text is not null").select("id", pdf.quality(F.col("full_text")).alias("quality"))


@query()
def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with page breaks, as pages: without running lines and page numbers, references cut off."""
    a = current_articles(spark, sf_dir, ["full_text"]).filter("full_text is not null")
    pages = F.split(F.replace("full_text", F.lit("\r\n"), F.lit("\n")), "\f")
    return a.select("id", pdf.without_references(pdf.join_pages(pages)).alias("text"))


@query(f"WITH {ARTICLES}, t AS (SELECT slug, sort_order, unnest(keywords) AS k FROM topics WHERE is_active), h AS (SELECT a.id, t.slug, t.sort_order, count(*) AS n FROM a JOIN t ON contains(lower(coalesce(a.title, '') || ' ' || coalesce(a.abstract, '')), lower(t.k)) GROUP BY 1, 2, 3), r AS (SELECT id, slug, row_number() OVER (PARTITION BY id ORDER BY n DESC, sort_order, slug) AS p FROM h) SELECT a.id, coalesce(r.slug, 'other') AS primary_topic FROM a LEFT JOIN r ON r.id = a.id AND r.p = 1")
def topic_rule_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumbung.operators.media import topic_prior

    a = current_articles(spark, sf_dir, ["title", "abstract"])
    words = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return topic_prior(a, read_table(spark, sf_dir, "topics"), text=words).select("id", "primary_topic")


@query("WITH e AS (SELECT DISTINCT * FROM ingest_errors), s AS (SELECT article_id, run_id, stage, row_number() OVER (PARTITION BY article_id ORDER BY created_at, id) AS seq FROM e WHERE article_id IS NOT NULL) SELECT article_id, run_id, stage, CAST(seq AS INTEGER) AS seq FROM s")
def next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each article numbered in their order, as messages of a session are."""
    e = read_table(spark, sf_dir, "ingest_errors").dropDuplicates(["id"]).filter("article_id is not null")
    nothing = e.select("article_id", F.lit(0).alias("seq")).filter("false")
    return store.append_numbers(e.select("article_id", "run_id", "stage", "created_at", "id"), nothing, "article_id", ["created_at", "id"]).select("article_id", "run_id", "stage", "seq")


def topic_rows(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    """(slug, labels) for metadata.explicit_filters."""
    return [(r["slug"], r["label_en"], r["label_id"]) for r in read_dimension(spark, sf_dir, "topics") if r["is_active"]]


