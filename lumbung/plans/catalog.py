"""Queries of the catalogue and its administration: filters, joins, facets, pages, audit, duplicates, snapshots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions import text as X
from lumbung.operators import dedupe, store
from lumbung.operators.filters import Filters, predicate, websearch, with_topics
from lumbung.plans.base import ARTICLES, DAY, ERRORS, LOG, audit_log, current_articles, ingest_errors
from lumbung.sources.tables import read_table

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


@query(f"WITH {ARTICLES} SELECT a.id, a.title, s.name AS source_name, a.published_at FROM a JOIN sources s ON s.slug = a.source_slug WHERE a.language IN ('en', 'id') AND a.published_at BETWEEN DATE '2010-01-01' AND DATE '2020-12-31' ORDER BY a.published_at DESC NULLS LAST, a.title NULLS LAST, a.id LIMIT 50")
def catalogue_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = predicate(Filters(languages=["en", "id"], date_from=date(2010, 1, 1), date_to=date(2020, 12, 31)))
    hits = current_articles(spark, sf_dir, ["title", "source_slug", "published_at"], where=wanted)
    s = read_table(spark, sf_dir, "sources").select(F.col("slug").alias("source_slug"), F.col("name").alias("source_name"))
    return hits.join(s, "source_slug").select("id", "title", "source_name", "published_at").orderBy(F.desc_nulls_last("published_at"), F.asc_nulls_last("title"), "id").limit(50)


@query(f"WITH {ARTICLES} SELECT count(*) AS total FROM a WHERE language IN ('en', 'id') AND published_at >= DATE '2010-01-01'")
def catalogue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = predicate(Filters(languages=["en", "id"], date_from=date(2010, 1, 1)))
    return read_table(spark, sf_dir, "articles").filter(wanted).agg(F.count_distinct("id").alias("total"))


def _facet(column: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return current_articles(spark, sf_dir, [column]).groupBy(column).agg(F.count("*").alias("articles"))

    run.__name__ = f"facet_{column}"
    return query(f"WITH {ARTICLES} SELECT {column}, count(*) AS articles FROM a GROUP BY 1")(run)


for _c in ("language", "doc_type", "processing_status", "full_text_status", "topic"):
    _facet(_c)


@query(f"WITH {ARTICLES} SELECT CAST(year(published_at) AS INTEGER) AS published_year, count(*) AS articles FROM a GROUP BY 1")
def facet_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_articles(spark, sf_dir, ["published_at"]).groupBy(F.year("published_at").alias("published_year")).agg(F.count("*").alias("articles"))


@query(f"WITH {ARTICLES} SELECT s.slug, s.name, count(a.id) AS articles FROM sources s LEFT JOIN a ON a.source_slug = s.slug AND a.doc_type = 'podcast' GROUP BY 1, 2")
def facet_source_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "articles").filter("doc_type = 'podcast'").groupBy("source_slug").agg(F.count_distinct("id").alias("n"))
    return read_table(spark, sf_dir, "sources").join(a, F.col("slug") == F.col("source_slug"), "left").select("slug", "name", F.coalesce("n", F.lit(0)).alias("articles"))


@query(f"WITH {ARTICLES} SELECT t.slug, t.label_en, count(a.id) AS articles FROM topics t LEFT JOIN a ON a.topic = t.slug AND a.full_text_status = 'extracted' WHERE t.is_active GROUP BY 1, 2")
def facet_topic_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["topic", "full_text_status"]).filter("full_text_status = 'extracted'").groupBy("topic").agg(F.count("*").alias("n"))
    return read_table(spark, sf_dir, "topics").filter("is_active").join(a, F.col("slug") == F.col("topic"), "left").select("slug", "label_en", F.coalesce("n", F.lit(0)).alias("articles"))


@query(f"WITH {ARTICLES} SELECT id, published_at FROM a WHERE len(list_filter(authors, lambda x: lower(x) IN ('vera suduvudun', 'zoë rajajagar', 'rini pinbiwaton'))) > 0")
def filter_author_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = predicate(Filters(authors=["Vera Suduvudun", "Zoë Rajajagar", "Rini Pinbiwaton"]))
    return current_articles(spark, sf_dir, ["published_at"], where=wanted)


@query(f"WITH {ARTICLES}, l AS (SELECT id AS article_id, unnest(keywords) AS k FROM a) SELECT a.id FROM a WHERE EXISTS (SELECT 1 FROM l JOIN topics t ON list_contains(t.keywords, l.k) WHERE l.article_id = a.id AND t.slug IN ('health', 'water'))")
def filter_topic_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["keywords"])
    words = read_table(spark, sf_dir, "topics").select(F.col("slug").alias("topic_slug"), F.explode("keywords").alias("k"))
    links = a.select(F.col("id").alias("article_id"), F.explode("keywords").alias("k")).join(words, "k").select("article_id", "topic_slug")
    return with_topics(a, links, ["health", "water"]).select("id")


@query(f"WITH {ARTICLES}, w AS (SELECT id, ' ' || array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') || ' ' AS t FROM a) SELECT id FROM w WHERE (contains(t, ' field ') AND contains(t, ' notes ') AND NOT contains(t, ' bay ')) OR contains(t, ' rooftop solar ')")
def fts_web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), 0)
    return current_articles(spark, sf_dir, ["title"]).filter(websearch('field notes -bay or "rooftop solar"', words)).select("id")


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 0), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"WITH {ARTICLES}, t AS (SELECT id, {_TRI.format('title')} AS x, {_TRI.format(chr(39) + 'Field notes, Utara to Selatan' + chr(39))} AS y FROM a WHERE title IS NOT NULL), s AS (SELECT id, len(list_intersect(x, y)) AS b, len(x) AS lx, len(y) AS ly FROM t) SELECT id, round(CAST(b AS DOUBLE) / (lx + ly - b), 6) AS similarity FROM s WHERE CAST(b AS DOUBLE) / (lx + ly - b) >= 0.3")
def trigram_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.trigram_similarity(F.col("title"), F.lit("Field notes, Utara to Selatan"))
    return current_articles(spark, sf_dir, ["title"]).filter("title is not null").select("id", s.alias("s")).filter("s >= 0.3").select("id", F.round("s", 6).alias("similarity"))


@query(f"WITH {ARTICLES} SELECT id, title FROM a WHERE title ILIKE '%bay%' AND source_slug = 'wenguyig-jrn'")
def title_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_articles(spark, sf_dir, ["title"], where=F.col("title").ilike("%bay%") & (F.col("source_slug") == "wenguyig-jrn"))


@query(f"WITH {ARTICLES} SELECT id, title, published_at FROM a WHERE doc_type = 'journal-article' ORDER BY title DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def admin_page_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["title", "published_at"], where=F.col("doc_type") == "journal-article")
    return a.orderBy(F.desc_nulls_last("title"), "id").offset(40).limit(20).select("id", "title", "published_at")


@query(f"WITH {ARTICLES} SELECT count(DISTINCT publisher) AS publishers, min(published_at) AS first_date, max(published_at) AS last_date, count(*) AS articles FROM a")
def distinct_publishers_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_articles(spark, sf_dir, ["publisher", "published_at"]).agg(F.count_distinct("publisher").alias("publishers"), F.min("published_at").alias("first_date"), F.max("published_at").alias("last_date"), F.count("*").alias("articles"))


@query(f"WITH {ARTICLES} SELECT a.id, a.title, s.name AS source_name, t.label_en AS topic_label, CAST(len(a.authors) AS INTEGER) AS n_authors FROM a JOIN sources s ON s.id = a.source_id LEFT JOIN topics t ON t.slug = a.topic")
def article_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["title", "source_id", "topic", "authors"])
    s = read_table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    t = read_table(spark, sf_dir, "topics").select(F.col("slug").alias("topic"), F.col("label_en").alias("topic_label"))
    return a.join(s, "source_id").join(t, "topic", "left").select("id", "title", "source_name", "topic_label", F.when(F.col("authors").isNotNull(), F.size("authors")).alias("n_authors"))


@query(f"WITH {ARTICLES}, {ERRORS} SELECT a.id FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.article_id = a.id)")
def articles_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ingest_errors(spark, sf_dir).select(F.col("article_id").alias("id")).filter("id is not null")
    return current_articles(spark, sf_dir, ["source_slug"]).join(e, "id", "left_anti").select("id")


@query(f"WITH {ERRORS} SELECT s.slug, e.stage, count(*) AS errors FROM e LEFT JOIN sources s ON s.id = e.source_id GROUP BY 1, 2")
def errors_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), "slug")
    counts = ingest_errors(spark, sf_dir).groupBy("source_id", "stage").agg(F.count("*").alias("n"))
    return counts.join(s, "source_id", "left").groupBy("slug", "stage").agg(F.sum("n").alias("errors"))


@query(f"WITH {ARTICLES}, {ERRORS} SELECT a.id, (SELECT count(*) FROM e WHERE e.article_id = a.id) AS error_count FROM a")
def correlated_error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ingest_errors(spark, sf_dir).groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n"))
    return current_articles(spark, sf_dir, ["source_slug"]).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("error_count"))


@query(f"WITH {ERRORS} SELECT run_id, count(*) AS errors, count(DISTINCT external_id) AS records, max(epoch_us(created_at)) AS last_us FROM e GROUP BY run_id HAVING count(*) >= 3")
def runs_with_many_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ingest_errors(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("errors"), F.count_distinct("external_id").alias("records"), F.unix_micros(F.max("created_at")).alias("last_us"))
    return e.filter("errors >= 3")


@query(f"WITH {LOG} SELECT {DAY.format('created_at')} AS day, endpoint, count(*) AS asked, count(*) FILTER (WHERE had_evidence) AS with_evidence, count(*) FILTER (WHERE latency_ms > 1000) AS slow FROM q GROUP BY 1, 2")
def audit_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = audit_log(spark, sf_dir)
    return q.groupBy(F.to_date("created_at").alias("day"), "endpoint").agg(F.count("*").alias("asked"), F.count_if("had_evidence").alias("with_evidence"), F.count_if(F.col("latency_ms") > 1000).alias("slow"))


@query(f"WITH {LOG} SELECT user_id, count(*) AS asked, count(DISTINCT lower(trim(query))) AS questions, round(avg(latency_ms), 6) AS avg_latency FROM q GROUP BY 1")
def audit_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the distinct questions first, so that a user of very many rows is pre-aggregated
    q = audit_log(spark, sf_dir, ["user_id", "query", "latency_ms"])
    per = q.groupBy("user_id", F.lower(F.trim("query")).alias("question")).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("ms"), F.count("latency_ms").alias("k"))
    return per.groupBy("user_id").agg(F.sum("n").alias("asked"), F.count("question").alias("questions"), F.round(F.sum("ms") / F.nullif(F.sum("k"), F.lit(0)), 6).alias("avg_latency"))


@query(f"WITH {LOG}, c AS (SELECT unnest(retrieved_chunk_ids) AS chunk_id, id FROM q) SELECT chunk_id, count(*) AS hits, count(DISTINCT id) AS searches FROM c GROUP BY 1 HAVING count(*) >= 5")
def audit_chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = audit_log(spark, sf_dir, ["id", "retrieved_chunk_ids"]).select("id", F.explode("retrieved_chunk_ids").alias("chunk_id"))
    return c.groupBy("chunk_id").agg(F.count("*").alias("hits"), F.count_distinct("id").alias("searches")).filter("hits >= 5")


@query(f"WITH {LOG} SELECT id, CAST(len(retrieved_chunk_ids) AS INTEGER) AS chunks, round(CAST(top_scores[1] AS DOUBLE), 5) AS best, json_extract_string(filters, '$.languages[0]') AS language FROM q WHERE had_evidence")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = audit_log(spark, sf_dir).filter("had_evidence")
    return q.select("id", F.when(F.col("retrieved_chunk_ids").isNotNull(), F.size("retrieved_chunk_ids")).alias("chunks"), F.round(F.try_element_at("top_scores", F.lit(1)).cast("double"), 5).alias("best"), F.get_json_object("filters", "$.languages[0]").alias("language"))


@query(f"WITH {LOG} SELECT endpoint, max(index_version) AS latest_version, max(epoch_us(created_at)) AS last_us FROM q GROUP BY 1")
def latest_index_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_log(spark, sf_dir).groupBy("endpoint").agg(F.max("index_version").alias("latest_version"), F.unix_micros(F.max("created_at")).alias("last_us"))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM q WHERE user_id IS NOT NULL) SELECT user_id, id, CAST(n AS INTEGER) AS n FROM r WHERE n <= 6")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    # the rank filter lets Spark keep six rows of a user in each task before the shuffle
    q = audit_log(spark, sf_dir, ["user_id", "id", "created_at"]).filter("user_id is not null")
    return q.withColumn("n", F.row_number().over(w)).filter("n <= 6").select("user_id", "id", "n")


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(replace(coalesce({0}, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')), '<[^>]+>', ' ', 'g'), '[^a-z0-9 \\t\\n\\f\\r]+', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g'))"
_STOP = "(" + ", ".join(f"'{w}'" for w in X.TITLE_STOPWORDS) + ")"
_KEY = f"sha256(array_to_string(list_sort(list_distinct(list_filter(string_split({_NORM.format('title')}, ' '), lambda w: length(w) > 2 AND w NOT IN {_STOP}))), ' ') || '|' || CAST(coalesce(year(published_at), 0) AS VARCHAR))"
_HASH = "sha256(lower(trim(regexp_replace(coalesce(title, '') || chr(10) || coalesce(full_text, ''), '[ \\t\\n\\f\\r]+', ' ', 'g'))))"


@query(f"WITH {ARTICLES} SELECT id, {_NORM.format('title')} AS title_normalized, {_KEY} AS dedup_key, {_HASH} AS content_hash FROM a")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["title", "full_text", "published_at"])
    return a.select("id", X.normalize_title(F.col("title")).alias("title_normalized"), X.dedup_key(F.col("title"), F.col("published_at")).alias("dedup_key"), X.content_hash(F.col("title"), F.col("full_text")).alias("content_hash"))


_LAYERS = f"""f AS (SELECT id, first_seen_at, source_id, doc_type, lower(doi) AS doi, {_HASH} AS h, {_KEY} AS t FROM a),
l1 AS (SELECT *, CASE WHEN doi IS NOT NULL THEN first_value(id) OVER (PARTITION BY doi ORDER BY first_seen_at NULLS FIRST, source_id NULLS FIRST, id) END AS c FROM f),
m1 AS (SELECT * EXCLUDE (c), CASE WHEN c <> id THEN c END AS to1 FROM l1),
l2 AS (SELECT *, first_value(id) OVER (PARTITION BY h ORDER BY first_seen_at NULLS FIRST, source_id NULLS FIRST, id) AS c FROM m1 WHERE to1 IS NULL),
m2 AS (SELECT m1.*, CASE WHEN l2.c <> m1.id THEN l2.c END AS to2 FROM m1 LEFT JOIN l2 ON l2.id = m1.id),
g AS (SELECT t, arg_min(id, (first_seen_at, source_id, id)) AS c FROM m2 WHERE to1 IS NULL AND to2 IS NULL GROUP BY t HAVING count(*) > 1 AND (count(DISTINCT source_id) > 1 OR count(DISTINCT doc_type) > 1)),
m3 AS (SELECT m2.*, CASE WHEN to1 IS NULL AND to2 IS NULL AND g.c <> m2.id THEN g.c END AS to3 FROM m2 LEFT JOIN g ON g.t = m2.t)"""


@query(f"WITH {ARTICLES}, {_LAYERS} SELECT id, coalesce(to1, to2, to3) AS duplicate_of_id, CASE WHEN to1 IS NOT NULL THEN 'doi' WHEN to2 IS NOT NULL THEN 'content_hash' ELSE 'title_year' END AS duplicate_reason FROM m3 WHERE coalesce(to1, to2, to3) IS NOT NULL")
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["title", "full_text", "published_at", "first_seen_at", "source_id", "doc_type", "doi"])
    keyed = a.withColumns({"content_hash": X.content_hash(F.col("title"), F.col("full_text")), "dedup_key": X.dedup_key(F.col("title"), F.col("published_at"))}).drop("title", "full_text", "published_at")
    return dedupe.cut_links(dedupe.relink(keyed))


@query("SELECT id, count(*) AS deliveries, count(DISTINCT processing_status) AS states FROM articles GROUP BY id HAVING count(*) > 1")
def redelivered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "articles")
    return a.groupBy("id").agg(F.count("*").alias("deliveries"), F.count_distinct("processing_status").alias("states")).filter("deliveries > 1")


_SPLIT = "row_number() OVER (PARTITION BY id ORDER BY last_harvested_at NULLS FIRST, updated_at NULLS FIRST, processing_status NULLS FIRST, chunk_count NULLS FIRST)"


@query(f"""WITH d AS (SELECT id, processing_status, chunk_count, epoch_us(first_seen_at) AS seen_us, title, {_SPLIT} AS n FROM articles),
old AS (SELECT * FROM d WHERE n = 1), new AS (SELECT * FROM d x WHERE n = (SELECT max(n) FROM d y WHERE y.id = x.id))
SELECT old.id, new.processing_status, coalesce(new.chunk_count, old.chunk_count) AS chunk_count, old.seen_us, CASE WHEN new.n > 1 THEN 'updated' ELSE 'kept' END AS action FROM old JOIN new ON new.id = old.id""")
def upsert_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries as the stored snapshot, the last ones upserted: the first-seen time stays, a null count keeps the
    stored one."""
    order = F.struct("last_harvested_at", "updated_at", "processing_status", "chunk_count")
    row = F.struct("processing_status", "chunk_count", F.unix_micros("first_seen_at").alias("seen_us"))
    both = read_table(spark, sf_dir, "articles").groupBy("id").agg(F.min_by(row, order).alias("a"), F.max_by(row, order).alias("b"), F.count("*").alias("n"))
    old, new = both.select("id", "a.*"), both.filter("n > 1").select("id", "b.*")
    return store.upsert(old, new, ["id"], insert_only=["seen_us"], keep_if_null=["chunk_count"])


@query(f"WITH {ARTICLES} SELECT id, title, published_at FROM (SELECT a.*, row_number() OVER (PARTITION BY source_slug ORDER BY published_at DESC NULLS LAST, id) AS n FROM a) WHERE n <= 3")
def newest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source_slug").orderBy(F.desc_nulls_last("published_at"), "id")
    a = current_articles(spark, sf_dir, ["title", "published_at", "source_slug"])
    return a.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("id", "title", "published_at")


@query(f"WITH {ARTICLES} SELECT id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '') AS host, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM a WHERE url LIKE '%//%' AND title IS NOT NULL")
def url_hosts_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["url", "title"]).filter(F.col("url").contains("//") & F.col("title").isNotNull())
    return a.select("id", X.domain_of(F.col("url")).alias("host"), X.slugify(F.col("title"), 10_000).alias("slug"))
