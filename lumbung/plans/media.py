"""Queries of media monitoring, on mentions derived from the events table, and their streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbung.operators import media
from lumbung.session import work_dir
from lumbung.sources.tables import read_table
from lumbung.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF, PERIOD = "2024-01-31 00:00:00", 7
KINDS = ["national", "regional", "print"]


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mentions: the user stands for the outlet and the issue, the type for an actor, the value for relevance."""
    e = read_table(spark, sf_dir, "events")
    outlet = (F.col("user_id") % 18).cast("int")
    return e.select(
        (F.col("user_id") % 3).cast("int").alias("issue_id"), F.col("event_id").alias("article_id"), outlet.alias("outlet_id"),
        F.when(outlet < 10, "national").when(outlet < 15, "regional").otherwise("print").alias("media_type"), F.col("ts").alias("published_at"),
        (F.col("value") / 500).alias("relevance"), (F.col("value") / 500 >= 0.5).alias("is_relevant"),
        (F.coalesce(F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999")).cast("int"), F.lit(0)) % 6).alias("narrative_id"),
        F.array(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("actors"),
    )


M = """m AS (SELECT CAST(user_id % 3 AS INTEGER) AS issue_id, event_id AS article_id, CAST(user_id % 18 AS INTEGER) AS outlet_id,
CASE WHEN user_id % 18 < 10 THEN 'national' WHEN user_id % 18 < 15 THEN 'regional' ELSE 'print' END AS media_type, CAST(ts AS TIMESTAMP) AS published_at, value / 500 AS relevance, value / 500 >= 0.5 AS is_relevant,
CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) % 6 AS INTEGER) AS narrative_id, [event_type, 'u' || user_id] AS actors FROM events)"""
_AT = f"TIMESTAMP '{AS_OF}'"
_NOW = f"published_at > {_AT} - INTERVAL {PERIOD} DAY"
_THEN = f"published_at <= {_AT} - INTERVAL {PERIOD} DAY AND published_at > {_AT} - INTERVAL {2 * PERIOD} DAY"
_PCT = "CASE WHEN {1} > 0 THEN round_even(({0} - {1}) * 100.0::DOUBLE / {1}, 1) END"


@query(f"WITH {M}, t AS (SELECT issue_id, count(*) FILTER (WHERE {_NOW}) AS current, count(*) FILTER (WHERE {_THEN}) AS previous FROM m WHERE is_relevant GROUP BY 1) SELECT *, {_PCT.format('current', 'previous')} AS delta_pct FROM t")
def media_totals_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.totals(mentions(spark, sf_dir), AS_OF, PERIOD)


@query(f"WITH {M} SELECT issue_id, media_type, count(*) AS mentions, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY issue_id), 1) AS share_pct FROM m WHERE is_relevant AND {_NOW} GROUP BY 1, 2")
def media_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.split_by(mentions(spark, sf_dir), AS_OF, PERIOD, "media_type")


_SERIES = f"""c AS (SELECT DISTINCT issue_id, CAST(unnest(generate_series(CAST({_AT} AS DATE) - {PERIOD - 1}, CAST({_AT} AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM m),
d AS (SELECT c.issue_id, c.day, count(*) FILTER (WHERE media_type = 'national') AS national, count(*) FILTER (WHERE media_type = 'regional') AS regional, count(*) FILTER (WHERE media_type = 'print') AS print, count(article_id) AS total FROM c LEFT JOIN m ON m.issue_id = c.issue_id AND CAST(m.published_at AS DATE) = c.day AND is_relevant AND {_NOW} GROUP BY 1, 2)"""


@query(f"WITH {M}, {_SERIES} SELECT * FROM d")
def media_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.daily_series(mentions(spark, sf_dir), AS_OF, PERIOD, KINDS)


@query(f"WITH {M}, {_SERIES} SELECT issue_id, arg_min(day, (-total, day)) AS peak_day, max(total) AS peak_total FROM d GROUP BY 1")
def media_peak_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.peak_day(media.daily_series(mentions(spark, sf_dir), AS_OF, PERIOD, KINDS))


@query(f"WITH {M}, t AS (SELECT issue_id, narrative_id, count(*) FILTER (WHERE {_NOW}) AS current, count(*) FILTER (WHERE {_THEN}) AS previous FROM m WHERE is_relevant GROUP BY 1, 2 HAVING count(*) FILTER (WHERE {_NOW}) > 0) SELECT *, {_PCT.format('current', 'previous')} AS delta_pct FROM t")
def narrative_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, then = media.rolling("published_at", AS_OF, PERIOD), media.rolling("published_at", AS_OF, PERIOD, 1)
    out = mentions(spark, sf_dir).filter("is_relevant").groupBy("issue_id", "narrative_id").agg(F.count_if(now).alias("current"), F.count_if(then).alias("previous")).filter("current > 0")
    return out.withColumn("delta_pct", media.delta_pct(F.col("current"), F.col("previous")))


@query(f"WITH {M}, x AS (SELECT issue_id, published_at, unnest(actors) AS actor FROM m WHERE is_relevant), t AS (SELECT issue_id, actor, count(*) FILTER (WHERE {_NOW}) AS current, count(*) FILTER (WHERE {_THEN}) AS previous FROM x GROUP BY 1, 2) SELECT issue_id, actor, current, previous, {_PCT.format('current', 'previous')} AS delta_pct FROM t WHERE current > 0 QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY current DESC, actor) <= 12")
def actor_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.actor_trend(mentions(spark, sf_dir), AS_OF, PERIOD)


@query(f"WITH {M}, x AS (SELECT issue_id, outlet_id, narrative_id, unnest(actors) AS actor FROM m WHERE is_relevant AND {_NOW}) SELECT issue_id, count(DISTINCT outlet_id) AS outlets, count(DISTINCT narrative_id) AS narratives, count(DISTINCT actor) AS actors FROM x GROUP BY 1")
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.active_counts(mentions(spark, sf_dir), AS_OF, PERIOD)


def _fresh(a: int, b: int) -> tuple[str, str]:
    return f"published_at > {_AT} - INTERVAL {a} DAY", f"published_at <= {_AT} - INTERVAL {a} DAY AND published_at > {_AT} - INTERVAL {a + b} DAY"


@query(f"WITH {M}, t AS (SELECT issue_id, count(*) FILTER (WHERE {_fresh(3, 14)[0]}) AS recent, count(*) FILTER (WHERE {_fresh(3, 14)[1]}) AS baseline FROM m WHERE is_relevant GROUP BY 1), r AS (SELECT *, (recent / 3.0::DOUBLE) / greatest(baseline / 14.0::DOUBLE, 0.5) AS ratio FROM t) SELECT issue_id, recent, baseline, round_even(ratio, 6) AS ratio, CASE WHEN ratio >= 3 THEN 'high' ELSE 'medium' END AS severity, round_even(least(0.5 + least(ratio / 10, 0.45), 0.99), 2) AS confidence, 'volume_spike:2024-W05' AS dedup_key FROM r WHERE recent >= 1 AND ratio >= 0.2")
def alert_volume_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With lower bounds than the rule's defaults, since the events don't rise."""
    return media.volume_spikes(mentions(spark, sf_dir), AS_OF, ratio=0.2, least=1)


@query(f"WITH {M}, x AS (SELECT issue_id, published_at, unnest(actors) AS actor FROM m WHERE is_relevant), t AS (SELECT issue_id, actor, count(*) FILTER (WHERE {_fresh(7, 30)[0]}) AS fresh, count(*) FILTER (WHERE {_fresh(7, 30)[1]}) AS prior FROM x GROUP BY 1, 2) SELECT issue_id, actor, fresh, round_even(0.5 + least(fresh / 15.0::DOUBLE, 0.4), 2) AS confidence, 'new_actor:' || substr(replace(lower(actor), ' ', '-'), 1, 60) AS dedup_key FROM t WHERE fresh >= 1 AND prior = 0")
def alert_new_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.new_actors(mentions(spark, sf_dir), AS_OF, least=1)


@query(f"WITH {M}, t AS (SELECT issue_id, count(*) FILTER (WHERE media_type = 'regional' AND {_fresh(7, 30)[0]}) AS fresh_regional, count(*) FILTER (WHERE {_fresh(7, 30)[0]}) AS fresh_total, count(*) FILTER (WHERE media_type = 'regional' AND {_fresh(7, 30)[1]}) AS pr, count(*) FILTER (WHERE {_fresh(7, 30)[1]}) AS pt FROM m WHERE is_relevant GROUP BY 1), r AS (SELECT *, fresh_regional::DOUBLE / nullif(fresh_total, 0) AS fs, coalesce(pr::DOUBLE / nullif(pt, 0), 0) AS ps FROM t) SELECT issue_id, fresh_regional, fresh_total, round_even(fs, 6) AS fresh_share, round_even(ps, 6) AS prior_share, round_even(0.5 + least(fs, 0.4), 2) AS confidence FROM r WHERE fresh_regional >= 1 AND fs >= 0.05 AND fs >= 0.3 * greatest(ps, 0.02)")
def alert_regional_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.regional_spread(mentions(spark, sf_dir), AS_OF, least=1, share=0.05, growth=0.3)


@query(f"WITH {M}, n AS (SELECT narrative_id, min(published_at) AS first_seen FROM m GROUP BY 1) SELECT m.issue_id, m.narrative_id, 'n' || m.narrative_id AS slug, count(*) AS articles, round_even(0.55 + least(count(*) / 20.0::DOUBLE, 0.35), 2) AS confidence, 'new_narrative:n' || m.narrative_id AS dedup_key FROM m JOIN n ON n.narrative_id = m.narrative_id WHERE is_relevant AND n.first_seen > {_AT} - INTERVAL 60 DAY GROUP BY 1, 2 HAVING count(*) >= 3")
def alert_new_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    n = m.groupBy("narrative_id").agg(F.min("published_at").alias("first_seen_at")).withColumns({"slug": F.concat(F.lit("n"), F.col("narrative_id").cast("string")), "created_by": F.lit("llm")})
    return media.new_narratives(m, n, AS_OF, fresh=60)


@query(f"WITH {M} SELECT article_id, issue_id, round_even(relevance, 6) AS relevance FROM m WHERE is_relevant AND {_fresh(3, 1)[0]} QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY relevance DESC, published_at DESC, article_id) <= 6")
def alert_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = mentions(spark, sf_dir).filter(F.col("is_relevant") & media.rolling("published_at", AS_OF, 3))
    w = Window.partitionBy("issue_id").orderBy(F.desc("relevance"), F.desc("published_at"), "article_id")
    return m.withColumn("n", F.row_number().over(w)).filter("n <= 6").select("article_id", "issue_id", F.bround("relevance", 6).alias("relevance"))


@query("WITH q AS (SELECT DISTINCT id, query FROM query_log), k AS (SELECT * FROM (VALUES (1, ['solar', 'wind']), (2, ['health', 'clinic', 'puskesmas']), (3, ['data'])) t(issue_id, keywords)), h AS (SELECT k.issue_id, q.id AS article_id, len(list_filter(keywords, lambda w: contains(lower(coalesce(q.query, '')), w))) AS hits FROM q, k) SELECT issue_id, article_id, CASE WHEN hits >= 2 THEN 0.55::DOUBLE WHEN hits = 1 THEN 0.35::DOUBLE ELSE 0::DOUBLE END AS relevance, hits >= 2 AS is_relevant FROM h")
def keyword_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged questions, judged for three issues by their keywords."""
    q = read_table(spark, sf_dir, "query_log").dropDuplicates(["id"]).select(F.col("id").alias("article_id"), "query", F.lit(None).cast("string").alias("via_keyword"))
    issues = spark.createDataFrame([(1, ["solar", "wind"]), (2, ["health", "clinic", "puskesmas"]), (3, ["data"])], "issue_id int, keywords array<string>")
    return media.analyse_keywords(q, issues, text=F.col("query"))


_ART = "x AS (SELECT DISTINCT id, url FROM articles WHERE url IS NOT NULL), o AS (SELECT id AS outlet, regexp_replace(regexp_extract(lower(base_url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '') AS host FROM sources)"


@query(f"WITH {_ART}, h AS (SELECT id, regexp_replace(regexp_extract(lower(CASE WHEN contains(url, '//') THEN url ELSE 'https://' || url END), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '') AS host FROM x) SELECT h.id AS article_id, CAST(o.outlet AS SMALLINT) AS outlet_id FROM h LEFT JOIN o ON o.host = h.host AND h.host <> ''")
def domain_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "articles").select(F.col("id").alias("article_id"), "url").filter("url is not null").distinct()
    s = read_table(spark, sf_dir, "sources").select("id", "base_url")
    return media.attribute_outlets(a, s, url="url").select("article_id", "outlet_id")


def _events_schema(spark: SparkSession, sf_dir: str) -> T.StructType:
    return spark.read.parquet(f"{sf_dir}/events.parquet").schema


def _run(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Runs a stream over all that is there, into the shared folder, and reads what came out."""
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("SELECT epoch_us(date_trunc('day', CAST(ts AS TIMESTAMP))) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling day windows over a stream of the events."""
    s = ingest.stream_table(spark, f"{sf_dir}/events.parquet*", _events_schema(spark, sf_dir), "ts")
    out = _run(ingest.windowed_counts(s, "ts", ["event_type"]), spark, "complete")
    return out.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query("SELECT epoch_us(d) - k * 86400000000 AS start_us, count(*) AS n FROM (SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS d FROM events), (VALUES (0), (1), (2)) o(k) GROUP BY 1")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three days that slide by one."""
    s = ingest.stream_table(spark, f"{sf_dir}/events.parquet*", _events_schema(spark, sf_dir), "ts")
    out = _run(ingest.windowed_counts(s, "ts", [], length="3 days", slide="1 day"), spark, "complete")
    return out.select(F.unix_micros("window_start").alias("start_us"), "n")


@query("SELECT id, endpoint FROM (SELECT DISTINCT * FROM query_log)")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log as a stream, each row once. Rows may come months late, so no key is forgotten."""
    schema = spark.read.parquet(f"{sf_dir}/query_log.parquet").schema
    s = ingest.stream_table(spark, f"{sf_dir}/query_log.parquet*", schema, "created_at").select("id", "endpoint", "created_at")
    return _run(ingest.first_deliveries(s, "created_at", ["id"], None), spark, "append").select("id", "endpoint")
