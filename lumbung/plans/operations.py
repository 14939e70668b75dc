"""Queries of running the corpus: what is pending, the media scope with its dashboard, lists of the administration, writes.

Articles are the media items, topics the issues, sources the outlets; an issue monitors the outlets of three kinds. Users
are those of the audit log.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbung.functions import lexer
from lumbung.functions import text as X
from lumbung.operators import media, pending, retrieval, store
from lumbung.operators.filters import Filters, between_days, predicate, scoped
from lumbung.plans.base import ARTICLES, ERRORS, LOG, audit_log, current_articles, ingest_errors
from lumbung.plans.catalog import _LAYERS, duplicate_links
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


# pending work


@query(f"""WITH {ARTICLES}, {ERRORS}, n AS (SELECT article_id, count(*) AS n FROM e WHERE stage = 'pdf_text' GROUP BY 1)
SELECT a.id, a.pdf_url FROM a LEFT JOIN n ON n.article_id = a.id WHERE a.pdf_url IS NOT NULL AND a.doc_type = 'journal-article' AND a.processing_status IS DISTINCT FROM 'archived' AND a.full_text_status IS DISTINCT FROM 'extracted' AND coalesce(n.n, 0) < 3""")
def pending_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["doc_type", "pdf_url", "processing_status", "full_text_status"])
    return pending.pending_pdfs(a, ingest_errors(spark, sf_dir).filter("stage = 'pdf_text'")).select("id", "pdf_url")


_DUPES = f"{ARTICLES}, {_LAYERS}, dup AS (SELECT id FROM m3 WHERE coalesce(to1, to2, to3) IS NOT NULL)"


@query(f"WITH {_DUPES} SELECT id FROM a WHERE processing_status IN ('pending', 'processing', 'ready') AND coalesce(chunk_count, 0) = 0 AND id NOT IN (SELECT id FROM dup)")
def pending_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["processing_status", "chunk_count"])
    return pending.pending_chunking(a, duplicate_links(spark, sf_dir)).select("id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def pending_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    done = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    return pending.pending_vectors(chunks, done).select(F.col("item_id").alias("doc_id"))


@query(f"WITH {_DUPES} SELECT id FROM a WHERE processing_status IS DISTINCT FROM 'archived' AND coalesce(trim(topic), '') = '' AND id NOT IN (SELECT id FROM dup)")
def pending_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.pending_topics(current_articles(spark, sf_dir, ["processing_status", "topic"]), duplicate_links(spark, sf_dir)).select("id")


# the media scope

KINDS = ("website", "newsletter", "archive")
AS_OF, PERIOD = "2019-06-30 00:00:00", 365
#: Kinds of documents as narratives, with their slugs.
NARRATIVES = {1: "opinion", 2: "post", 3: "media-coverage", 4: "brief-report"}


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(issue_id, outlet_id): the seeds, an active issue with each outlet of KINDS, without a join."""
    outlets = [int(r["id"]) for r in read_dimension(spark, sf_dir, "sources") if r["kind"] in KINDS]
    return read_table(spark, sf_dir, "topics").filter("is_active").select(F.col("id").alias("issue_id"), F.explode(F.array(*map(F.lit, outlets)).cast("array<smallint>")).alias("outlet_id"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as items, with the issue that their stored topic names."""
    a = current_articles(spark, sf_dir, ["title", "source_id", "published_at", "topic", "language", "doc_type", "processing_status", "keywords"])
    issues = read_table(spark, sf_dir, "topics").select(F.col("id").alias("issue_id"), F.col("slug").alias("topic_slug"))
    narrative = F.try_element_at(F.create_map(*(F.lit(x) for k, v in NARRATIVES.items() for x in (v, k))), F.col("doc_type"))
    a = a.withColumn("topic_slug", F.replace(F.lower("topic"), F.lit("_"), F.lit("-")))
    return a.join(issues, "topic_slug").select("issue_id", F.col("id").alias("article_id"), F.col("source_id").alias("outlet_id"), "title", F.col("published_at").cast("timestamp").alias("published_at"), F.col("language").alias("region"), narrative.alias("narrative_id"), (F.col("processing_status") == "ready").alias("is_relevant"), F.coalesce("keywords", F.array().cast("array<string>")).alias("actors"))


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed items of the outlets that their issue monitors."""
    outlets = read_table(spark, sf_dir, "sources").select(F.col("id").alias("outlet_id"), F.col("kind").alias("media_type"), F.col("name").alias("outlet_name"))
    return items(spark, sf_dir).join(monitored(spark, sf_dir), ["issue_id", "outlet_id"]).join(outlets, "outlet_id")


_MON = "mon AS (SELECT t.id AS issue_id, s.id AS outlet_id FROM topics t, sources s WHERE t.is_active AND s.kind IN ('website', 'newsletter', 'archive'))"
_NAR = "CASE a.doc_type " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in NARRATIVES.items()) + " END"
_SCOPE = f"""{ARTICLES}, {_MON}, it AS (SELECT t.id AS issue_id, a.id AS article_id, a.source_id AS outlet_id, a.title, a.published_at, a.language AS region, {_NAR} AS narrative_id, a.processing_status = 'ready' AS is_relevant FROM a JOIN topics t ON t.slug = replace(lower(a.topic), '_', '-')),
sc AS (SELECT it.*, s.kind AS media_type, s.name AS outlet_name FROM it JOIN mon ON mon.issue_id = it.issue_id AND mon.outlet_id = it.outlet_id JOIN sources s ON s.id = it.outlet_id),
nar AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{v}')" for k, v in NARRATIVES.items())}) n(narrative_id, slug))"""


def narratives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NARRATIVES.items()), "narrative_id int, slug string")


@query("WITH " + _MON + " SELECT * FROM mon")
def monitored_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitored(spark, sf_dir)


@query(f"WITH {_SCOPE} SELECT issue_id, article_id, outlet_id, media_type FROM sc WHERE is_relevant")
def media_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope(spark, sf_dir).filter("is_relevant").select("issue_id", "article_id", "outlet_id", "media_type")


@query(f"WITH {_SCOPE} SELECT issue_id, article_id, region FROM sc WHERE published_at >= DATE '2015-03-01' AND published_at < DATE '2018-07-01'")
def media_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope(spark, sf_dir).filter(between_days("published_at", date(2015, 3, 1), date(2018, 6, 30))).select("issue_id", "article_id", "region")


@query(f"WITH {_SCOPE} SELECT sc.issue_id, sc.article_id FROM sc JOIN nar ON nar.narrative_id = sc.narrative_id WHERE nar.slug = 'opinion' AND sc.media_type = 'website' AND sc.region = 'en'")
def media_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(scope(spark, sf_dir), media_type="website", region="en", narrative="opinion", narratives=narratives(spark)).select("issue_id", "article_id")


@query(f"WITH {_SCOPE} SELECT sc.issue_id, sc.article_id, sc.title, sc.outlet_name, nar.slug AS narrative FROM sc LEFT JOIN nar ON nar.narrative_id = sc.narrative_id WHERE is_relevant AND issue_id = 1 ORDER BY sc.published_at DESC NULLS LAST, sc.article_id LIMIT 40")
def evidence_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = scope(spark, sf_dir).filter("is_relevant and issue_id = 1").join(narratives(spark).withColumnRenamed("slug", "narrative"), "narrative_id", "left")
    return feed.orderBy(F.desc_nulls_last("published_at"), "article_id").limit(40).select("issue_id", "article_id", "title", "outlet_name", "narrative")


@query(f"WITH {_SCOPE} SELECT nar.slug, sc.issue_id, count(*) AS articles, count(DISTINCT sc.outlet_id) AS outlets FROM nar JOIN sc ON sc.narrative_id = nar.narrative_id AND sc.is_relevant GROUP BY 1, 2")
def narrative_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scope(spark, sf_dir).filter("is_relevant").join(narratives(spark), "narrative_id")
    return rows.groupBy("slug", "issue_id").agg(F.count("*").alias("articles"), F.count_distinct("outlet_id").alias("outlets"))


@query(f"WITH {_SCOPE} SELECT it.issue_id, it.article_id FROM it JOIN mon ON mon.outlet_id = it.outlet_id AND mon.issue_id = it.issue_id WHERE NOT is_relevant AND it.published_at > DATE '2019-04-01'")
def pending_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready items stand for analysed ones."""
    rows = items(spark, sf_dir)
    pairs = pending.pending_analysis(rows.drop("issue_id"), monitored(spark, sf_dir), rows.filter("is_relevant"), "2019-06-30 00:00:00", days=90)
    return pairs.join(rows.filter("not is_relevant").select("issue_id", "article_id"), ["issue_id", "article_id"])


@query(f"""WITH {_SCOPE}, r AS (SELECT * FROM sc WHERE is_relevant), cur AS (SELECT * FROM r WHERE published_at > TIMESTAMP '2019-06-30' - INTERVAL 365 DAYS), pre AS (SELECT * FROM r WHERE published_at > TIMESTAMP '2019-06-30' - INTERVAL 730 DAYS AND published_at <= TIMESTAMP '2019-06-30' - INTERVAL 365 DAYS),
k AS (SELECT issue_id, media_type, count(*) AS n FROM cur GROUP BY 1, 2), d AS (SELECT issue_id, published_at AS day, count(*) AS n FROM cur WHERE published_at > DATE '2019-06-30' - 365 AND published_at <= DATE '2019-06-30' GROUP BY 1, 2),
p AS (SELECT issue_id, arg_min(day, (-n, day)) AS peak_day, max(n) AS peak_total FROM d GROUP BY 1), i AS (SELECT DISTINCT issue_id FROM r)
SELECT i.issue_id, (SELECT count(*) FROM cur WHERE cur.issue_id = i.issue_id) AS current, (SELECT count(*) FROM pre WHERE pre.issue_id = i.issue_id) AS previous, (SELECT count(DISTINCT outlet_id) FROM cur WHERE cur.issue_id = i.issue_id) AS outlets,
(SELECT string_agg(media_type || '=' || n, ',' ORDER BY n DESC, media_type) FROM k WHERE k.issue_id = i.issue_id) AS by_type, p.peak_day, p.peak_total FROM i LEFT JOIN p ON p.issue_id = i.issue_id""")
def media_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scope(spark, sf_dir)
    board = media.dashboard(rows, AS_OF, PERIOD, list(KINDS))
    kinds = F.array_join(F.transform("by_type", lambda x: F.concat_ws("=", x["media_type"], x["mentions"].cast("string"))), ",")
    return board.select("issue_id", "current", "previous", "outlets", F.nullif(kinds, F.lit("")).alias("by_type"), "peak_day", "peak_total")


# lists


@query("SELECT t.slug, coalesce(list(s.slug ORDER BY s.slug) FILTER (WHERE s.kind IN ('website', 'newsletter', 'archive') AND t.is_active), []) AS outlets, CAST(row_number() OVER (ORDER BY t.sort_order, t.slug) AS INTEGER) AS position FROM topics t, sources s GROUP BY t.slug, t.sort_order")
def issues_with_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monitored(spark, sf_dir).join(read_table(spark, sf_dir, "sources").select(F.col("id").alias("outlet_id"), F.col("slug").alias("s")), "outlet_id")
    of = m.groupBy("issue_id").agg(F.sort_array(F.collect_list("s")).alias("outlets"))  # bounded by the table of outlets
    t = read_table(spark, sf_dir, "topics").select(F.col("id").alias("issue_id"), "slug", "sort_order").join(of, "issue_id", "left")
    n = F.row_number().over(Window.orderBy("sort_order", "slug"))  # a fixed table of subjects
    return t.select("slug", F.coalesce("outlets", F.array().cast("array<string>")).alias("outlets"), n.alias("position"))


@query(f"WITH {ARTICLES} SELECT s.slug, count(a.id) AS articles, CAST(row_number() OVER (ORDER BY s.publisher IS NULL DESC, s.kind, lower(s.name), s.slug) AS INTEGER) AS position FROM sources s LEFT JOIN a ON a.source_id = s.id GROUP BY s.slug, s.publisher, s.kind, s.name")
def outlets_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = current_articles(spark, sf_dir, ["source_id"]).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    n = F.row_number().over(Window.orderBy(F.col("publisher").isNull().desc(), "kind", F.lower("name"), "slug"))  # a fixed table
    return read_table(spark, sf_dir, "sources").join(counts, "id", "left").select("slug", F.coalesce("n", F.lit(0)).alias("articles"), n.alias("position"))


@query(f"WITH {ERRORS} SELECT e.id, e.stage = 'embed' AS pending, s.name AS resolver FROM e LEFT JOIN sources s ON s.id = e.source_id ORDER BY (e.stage = 'embed') DESC, e.created_at DESC, e.id LIMIT 30")
def alerts_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as alerts, those of a stage as pending ones: these first, then the newest."""
    e = ingest_errors(spark, sf_dir).withColumn("pending", F.col("stage") == "embed")
    s = read_table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("resolver"))
    return e.join(s, "source_id", "left").orderBy(F.desc("pending"), F.desc("created_at"), "id").limit(30).select("id", "pending", "resolver")


@query(f"WITH {LOG}, s AS (SELECT user_id, min(created_at) AS created, max(created_at) FILTER (WHERE endpoint = 'chat') AS last FROM q WHERE user_id IS NOT NULL GROUP BY 1) SELECT user_id, epoch_us(coalesce(last, created)) AS at_us FROM s ORDER BY coalesce(last, created) DESC, user_id LIMIT 50")
def sessions_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = audit_log(spark, sf_dir, ["user_id", "endpoint", "created_at"]).filter("user_id is not null").groupBy("user_id").agg(F.min("created_at").alias("created"), F.max(F.when(F.col("endpoint") == "chat", F.col("created_at"))).alias("last"))
    return s.withColumn("at", F.coalesce("last", "created")).orderBy(F.desc("at"), "user_id").limit(50).select("user_id", F.unix_micros("at").alias("at_us"))


@query(f"""WITH {LOG}, u AS (SELECT user_id, min(epoch_us(created_at)) AS since_us FROM q WHERE user_id IS NOT NULL GROUP BY 1), m AS (SELECT user_id, max(id) AS last_chat FROM q WHERE endpoint = 'chat' AND user_id IS NOT NULL GROUP BY 1), f AS (SELECT query, count(*) AS poor FROM q WHERE result_count = 0 GROUP BY 1)
SELECT q.id, u.since_us, m.last_chat, f.poor FROM q LEFT JOIN u ON u.user_id = q.user_id LEFT JOIN m ON m.user_id = q.user_id LEFT JOIN f ON f.query = q.query""")
def audit_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each audit row with its user's first day, last chat, and how often its question found nothing. Rows without a user
    skip the joins, so that they are no hot key."""
    q = audit_log(spark, sf_dir, ["id", "user_id", "endpoint", "query", "result_count", "created_at"])
    users = q.filter("user_id is not null").groupBy("user_id").agg(F.unix_micros(F.min("created_at")).alias("since_us"), F.max(F.when(F.col("endpoint") == "chat", F.col("id"))).alias("last_chat"))
    poor = q.filter("result_count = 0").groupBy("query").agg(F.count("*").alias("poor"))
    out = q.select("id", "query", F.coalesce("user_id", F.concat(F.lit("\u0000"), F.col("id").cast("string"))).alias("user_id"))
    return out.join(users, "user_id", "left").join(poor, "query", "left").select("id", "since_us", "last_chat", "poor")


@query("SELECT o_orderpriority, coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2)) / 1), 0)::DECIMAL(38, 2) AS total FROM orders GROUP BY 1")
def decimal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(0)).cast("decimal(38,2)").alias("total"))


@query(f"WITH {ARTICLES} SELECT a.id, a.title, s.name AS source_name, t.label_en FROM a JOIN sources s ON s.slug = a.source_slug LEFT JOIN topics t ON t.slug = a.topic WHERE a.processing_status IS DISTINCT FROM 'archived' AND a.title ILIKE '%a%' AND a.source_slug IN ('wenguyig-jrn', 'gurnurlu-web') AND a.doc_type IN ('post', 'opinion', 'journal-article') AND a.processing_status = 'ready' AND a.topic IN ('wind-solar', 'storage', 'health', 'money') AND a.language IN ('en', 'id') AND a.published_at BETWEEN DATE '1990-01-01' AND DATE '2024-12-31' AND a.full_text IS NOT NULL ORDER BY a.published_at NULLS LAST, a.id LIMIT 25")
def admin_page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight filters of the administration; duplicates are listed too."""
    wanted = predicate(Filters(source_slugs=["wenguyig-jrn", "gurnurlu-web"], doc_types=["post", "opinion", "journal-article"], languages=["en", "id"], date_from=date(1990, 1, 1), date_to=date(2024, 12, 31)))
    shared = wanted & F.col("title").ilike("%a%") & F.col("topic").isin("wind-solar", "storage", "health", "money") & F.col("full_text").isNotNull()
    a = current_articles(spark, sf_dir, ["title", "source_slug", "topic", "published_at", "processing_status"], where=shared).filter("processing_status = 'ready'")
    s = read_table(spark, sf_dir, "sources").select(F.col("slug").alias("source_slug"), F.col("name").alias("source_name"))
    t = read_table(spark, sf_dir, "topics").select(F.col("slug").alias("topic"), "label_en")
    return retrieval.page(a.join(s, "source_slug").join(t, "topic", "left"), "published_at", ascending=True, limit=25).select("id", "title", "source_name", "label_en")


@query(f"WITH {LOG}, c AS (SELECT id, unnest(retrieved_chunk_ids[1:6]) AS doc_id FROM q) SELECT c.id, c.doc_id, d.source FROM c JOIN documents d ON d.doc_id = c.doc_id")
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six retrieved ids of each audit row, looked up."""
    c = audit_log(spark, sf_dir, ["id", "retrieved_chunk_ids"]).select("id", F.explode(F.slice("retrieved_chunk_ids", 1, 6)).alias("doc_id"))
    return c.join(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("id", "doc_id", "source")


@query(f"WITH {ERRORS}, w AS (SELECT list(id ORDER BY id) AS all_ids FROM sources) SELECT r.run_id, list_sort(list_filter(w.all_ids, lambda x: NOT list_contains(r.got, x))) AS missing FROM (SELECT run_id, list(DISTINCT source_id) AS got FROM e WHERE source_id IS NOT NULL GROUP BY 1) r, w")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which a run left no trace."""
    wanted = sorted(int(r["id"]) for r in read_dimension(spark, sf_dir, "sources"))
    got = ingest_errors(spark, sf_dir).filter("source_id is not null").groupBy("run_id").agg(F.collect_set("source_id").alias("got"))  # bounded by the sources
    return got.select("run_id", F.array_sort(F.array_except(F.array(*map(F.lit, wanted)).cast("array<smallint>"), F.col("got").cast("array<smallint>"))).alias("missing"))


@query(f"WITH {_SCOPE} SELECT DISTINCT issue_id, region FROM sc WHERE region IS NOT NULL")
def distinct_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope(spark, sf_dir).select("issue_id", "region").filter("region is not null").distinct()


@query(f"WITH {ARTICLES} SELECT id, list_filter(list_transform(keywords, lambda x: substr(trim(x), 1, 12)), lambda x: length(x) > 0)[1:2] AS keywords FROM a WHERE keywords IS NOT NULL")
def cleaned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_articles(spark, sf_dir, ["keywords"]).filter("keywords is not null").select("id", X.cleaned_list(F.col("keywords"), 2, 12).alias("keywords"))


ALIASES = {"thermal power institute": "Institute for Thermal Power", "LHT Jarjisinda": "Lembaga Hukum Tambang Jarjisinda", "lemb. hukum tambang jarjisinda": "Lembaga Hukum Tambang Jarjisinda"}
_ALIAS = "CASE lower(trim(publisher)) " + " ".join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in ALIASES.items()) + " ELSE nullif(trim(publisher), '') END"


@query(f"WITH {ARTICLES} SELECT {_ALIAS} AS publisher, count(*) AS articles FROM a GROUP BY 1")
def publishers_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_articles(spark, sf_dir, ["publisher"]).groupBy(X.publisher_name(F.col("publisher"), ALIASES).alias("publisher")).agg(F.count("*").alias("articles"))


@query(f"WITH {ARTICLES} SELECT id, CAST(year(published_at) AS INTEGER) AS published_year, list_sort(list_filter(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z0-9]+')), lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in lexer.STOPWORDS)}))) AS search_terms FROM a")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current_articles(spark, sf_dir, ["title", "abstract", "published_at"])
    return a.select("id", F.year("published_at").alias("published_year"), F.array_sort(lexer.terms(F.concat_ws(" ", "title", "abstract"))).alias("search_terms"))


# writes


@query(f"WITH {LOG} SELECT user_id, endpoint, arg_max(id, (created_at, id)) AS id, arg_max(query, (created_at, id)) AS query FROM q WHERE user_id IS NOT NULL GROUP BY 1, 2")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key overwrites those before."""
    q = audit_log(spark, sf_dir, ["user_id", "endpoint", "id", "query", "created_at"]).filter("user_id is not null")
    return store.latest(q, ["user_id", "endpoint"], [F.negate(F.unix_micros("created_at")), F.negate("id")]).select("user_id", "endpoint", "id", "query")


@query(f"WITH {ARTICLES} SELECT id, CASE WHEN doc_type = 'podcast' THEN 'archived' ELSE processing_status END AS processing_status, doc_type = 'podcast' AS deleted, CASE WHEN doc_type = 'podcast' THEN 0 ELSE coalesce(chunk_count, 0) END AS chunks FROM a")
def archived_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Podcasts are archived: their rows stay, their chunks go."""
    a = current_articles(spark, sf_dir, ["doc_type", "processing_status", "chunk_count"])
    chunks = a.filter("chunk_count > 0").select(F.col("id").alias("article_id"), F.explode(F.sequence(F.lit(1), "chunk_count")).alias("chunk"))
    rows, left = store.archive(a, chunks, a.filter("doc_type = 'podcast'").select("id"), F.lit("2026-01-01").cast("timestamp"))
    n = left.groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n"))
    return rows.join(n, "id", "left").select("id", "processing_status", F.col("deleted_at").isNotNull().alias("deleted"), F.coalesce("n", F.lit(0)).alias("chunks"))


@query(f"WITH {_SCOPE}, w AS (SELECT issue_id, outlet_id, min((published_at, article_id)) AS s FROM sc WHERE published_at IS NOT NULL GROUP BY 1, 2), r AS (SELECT issue_id, outlet_id, row_number() OVER (PARTITION BY issue_id ORDER BY s[1], CAST(outlet_id AS VARCHAR)) AS n FROM w) SELECT issue_id, CAST(outlet_id AS VARCHAR) AS slug FROM r WHERE n <= 5")
def narratives_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlets of an issue as narratives that a model names, five at most."""
    w = scope(spark, sf_dir).filter("published_at is not null").select("issue_id", F.col("outlet_id").cast("string").alias("slug"), F.col("title").alias("label"), F.lit("llm").alias("created_by"), F.col("published_at").alias("seen_at"))
    none = w.select("issue_id", "slug", "created_by").filter("false")
    return store.get_or_create(none, w, most=5).select("issue_id", "slug")


@query(f"""WITH {ARTICLES}, x AS (SELECT id AS article_id, unnest(keywords) AS slug, generate_subscripts(keywords, 1) AS pos FROM a), k AS (SELECT DISTINCT unnest(keywords) AS slug FROM topics),
p AS (SELECT article_id, x.slug, min(pos) AS pos FROM x JOIN k ON k.slug = x.slug GROUP BY 1, 2 UNION ALL SELECT id, 'other', -1 FROM a WHERE len(keywords) > 0 AND keywords[1] IS NOT NULL AND keywords[1] NOT IN (SELECT slug FROM k))
SELECT article_id, slug, CAST(row_number() OVER (PARTITION BY article_id ORDER BY pos) AS INTEGER) AS rank, row_number() OVER (PARTITION BY article_id ORDER BY pos) = 1 AS is_primary FROM p""")
def labels_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords as ranked labels, of which those of the taxonomy are known."""
    a = current_articles(spark, sf_dir, ["keywords"]).select(F.col("id").alias("article_id"), F.col("keywords").alias("topics")).filter("size(topics) > 0 and topics[0] is not null")
    known = read_table(spark, sf_dir, "topics").select(F.explode("keywords").alias("slug")).distinct()
    return store.ranked_labels(a, known)


@query(f"WITH {LOG}, s AS (SELECT user_id, min(query) AS title FROM q WHERE user_id IS NOT NULL GROUP BY 1), c AS (SELECT user_id, arg_max(mode, id) FILTER (WHERE mode IS NOT NULL) AS mode FROM q WHERE endpoint = 'chat' AND user_id IS NOT NULL GROUP BY 1) SELECT s.user_id, coalesce(c.mode, s.title) AS title FROM s LEFT JOIN c ON c.user_id = s.user_id")
def sessions_retitled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null in a change leaves the title as it is."""
    q = audit_log(spark, sf_dir, ["id", "user_id", "endpoint", "query", "mode"]).filter("user_id is not null")
    changes = q.filter("endpoint = 'chat'").select("user_id", F.col("mode").alias("title"), F.col("id").alias("at"))
    return store.overwrite_given(q.groupBy("user_id").agg(F.min("query").alias("title")), changes, "user_id", ["title"])


@query(f"WITH {ERRORS}, x AS (SELECT article_id, id, stage, created_at FROM e WHERE article_id IS NOT NULL), o AS (SELECT article_id, max(CAST(id AS INTEGER)) AS top FROM x WHERE stage = 'crawl' GROUP BY 1) SELECT x.id, CAST(coalesce(o.top, 0) + row_number() OVER (PARTITION BY x.article_id ORDER BY x.created_at, x.id) AS INTEGER) AS seq FROM x LEFT JOIN o ON o.article_id = x.article_id WHERE x.stage <> 'crawl'")
def numbers_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of later stages, numbered on from the ids of an article's crawl errors."""
    e = ingest_errors(spark, sf_dir).filter("article_id is not null")
    there = e.filter("stage = 'crawl'").select("article_id", F.col("id").cast("int").alias("seq"))
    return store.append_numbers(e.filter("stage <> 'crawl'"), there, "article_id", ["created_at", "id"]).select("id", "seq")


@query("SELECT s.slug, count(e.vec_id) AS embedded_count FROM sources s LEFT JOIN documents d ON d.source = s.slug LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def vectors_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are written to documents and counted for each source."""
    chunks = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("article_id"))
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.lit("m").alias("model"))
    sources = read_table(spark, sf_dir, "sources").select(F.col("slug").alias("id"))
    return store.roll_up_vectors(sources, chunks, vectors)[1].select(F.col("id").alias("slug"), "embedded_count")


@query("""WITH d AS (SELECT id, processing_status, chunk_count, row_number() OVER w AS n, count(*) OVER (PARTITION BY id) AS k FROM articles WINDOW w AS (PARTITION BY id ORDER BY last_harvested_at NULLS FIRST, updated_at NULLS FIRST, processing_status NULLS FIRST, chunk_count NULLS FIRST)), x AS (SELECT * FROM d WHERE n = 1 AND k > 1), y AS (SELECT * FROM d WHERE n = k AND k > 1)
SELECT x.id, list_sort(list_filter([CASE WHEN x.processing_status IS DISTINCT FROM y.processing_status THEN 'processing_status' END, CASE WHEN x.chunk_count IS DISTINCT FROM y.chunk_count THEN 'chunk_count' END, 'title'], lambda v: v IS NOT NULL)) AS locked FROM x JOIN y ON x.id = y.id WHERE x.processing_status IS DISTINCT FROM y.processing_status OR x.chunk_count IS DISTINCT FROM y.chunk_count""")
def fields_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that the last delivery of an article changed, with one that was locked before."""
    order = F.struct("last_harvested_at", "updated_at", "processing_status", "chunk_count")
    row = F.struct("processing_status", "chunk_count")
    both = read_table(spark, sf_dir, "articles").groupBy("id").agg(F.min_by(row, order).alias("a"), F.max_by(row, order).alias("b"), F.count("*").alias("n")).filter("n > 1")
    changed = store.field_changes(both.select("id", "a.*"), both.select("id", "b.*"), "id", ["processing_status", "chunk_count"])
    return changed.select("id", F.array_sort(store.lock_fields(F.array(F.lit("title")), F.map_keys("changed"))).alias("locked"))


@query(f"WITH {ERRORS}, b AS (SELECT run_id, id, stage, row_number() OVER (PARTITION BY run_id ORDER BY id) AS position FROM e) SELECT id, CASE WHEN position % 2 = 0 THEN stage ELSE 'unknown' END AS verdict FROM b")
def verdicts_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second item of a batch has an answer; the others get the fallback."""
    b = ingest_errors(spark, sf_dir).select(F.col("run_id").alias("batch"), "id", "stage").withColumn("position", F.row_number().over(Window.partitionBy("batch").orderBy("id")))
    verdicts = b.filter("position % 2 = 0").select("batch", "position", F.col("stage").alias("verdict"))
    return store.matched_by_position(b.drop("stage"), verdicts, F.lit("unknown")).select("id", "verdict")


@query(f"WITH {ARTICLES}, h AS (SELECT DISTINCT regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '') AS host FROM a WHERE url IS NOT NULL), s AS (SELECT regexp_replace(regexp_extract(lower(base_url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '') AS host FROM sources WHERE kind = 'journal') SELECT host FROM h WHERE host <> '' AND host NOT IN (SELECT host FROM s)")
def outlets_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New outlets of the articles' hosts, one a host, where only journals are known."""
    known = read_table(spark, sf_dir, "sources").filter("kind = 'journal'")
    a = current_articles(spark, sf_dir, ["url"]).filter("url is not null")
    return media.discovered_outlets(media.attribute_outlets(a, known, url="url")).select("host")


@query(f"""WITH {LOG}, t AS (SELECT id, unnest(retrieved_chunk_ids) AS c, generate_subscripts(retrieved_chunk_ids, 1) AS r FROM q), g AS (SELECT t.id, d.source, min(r) AS r FROM t JOIN documents d ON d.doc_id = t.c GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS rank FROM g),
m AS (SELECT q.id, q.endpoint, CASE WHEN regexp_matches(lower(q.query), '(di|dan|yang|untuk|pada)') THEN 'id' ELSE 'en' END AS half, min(k.rank) FILTER (WHERE k.source = 'wenguyig-jrn') AS rank FROM q LEFT JOIN k ON k.id = q.id GROUP BY 1, 2, 3)
SELECT endpoint, half, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) AS questions FROM m GROUP BY 1, 2""")
def recall_by_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the first relevant source among the distinct sources retrieved, for each channel and half of the questions;
    one source stands for the relevant one, as the tables hold no judgement."""
    q = audit_log(spark, sf_dir, ["id", "endpoint", "query", "retrieved_chunk_ids"])
    hits = q.select("id", F.posexplode("retrieved_chunk_ids").alias("at", "item_id"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("article_id"))
    ranks = retrieval.distinct_ranks(hits.join(docs, "item_id"), "id", "article_id", "at").filter("article_id = 'wenguyig-jrn'").select("id", "rank")
    half = F.when(F.lower("query").rlike("(di|dan|yang|untuk|pada)"), "id").otherwise("en")
    out = retrieval.recall_at(q.select("id", "endpoint", half.alias("half")).join(ranks, "id", "left"), by=["endpoint", "half"])
    return out.select("endpoint", "half", F.round("recall_at_5", 6).alias("recall_at_5"), F.round("mrr", 6).alias("mrr"), "questions")
