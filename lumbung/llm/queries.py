"""Queries of the operators for language-model text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbung import session
from lumbung.llm import encoding, langid, mixing, names, neardup, packing, pieces, scans, topics
from lumbung.sources.tables import read_dimension, read_table


TEXT_COLUMNS = ["title", "abstract", "full_text"]


def size_limit(spark: SparkSession, sf_dir: str, name: str) -> dict:
    """The row of ``size_limits`` for ``name``."""
    return next(r.asDict() for r in read_dimension(spark, sf_dir, "size_limits") if r["limit_name"] == name)


def _heads(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["name"] for r in read_dimension(spark, sf_dir, "sources") if r["name"]]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.scan_damage(read_table(spark, sf_dir, "articles"), "id", "title", "full_text", heads=_heads(spark, sf_dir))
    return found.withColumnRenamed("item_id", "article_id")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of every article as continuous paragraphs."""
    return scans.repair_scans(read_table(spark, sf_dir, "articles"), "id", "title", "full_text", heads=_heads(spark, sf_dir)).withColumnRenamed("item_id", "article_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read_table(spark, sf_dir, "articles")
    return names.variant_pairs(names.resolve_names(names.occurrences(articles, ["authors", "publisher"])))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read_table(spark, sf_dir, "articles")
    return names.entity_sizes(names.resolve_names(names.occurrences(articles, ["authors", "publisher"])))


_fitted: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, fit: Callable[[], object]) -> object:
    """A fitted model, kept for this application's other queries on the same tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _fitted:
        _fitted[key] = fit()
    return _fitted[key]


def _language_model(spark: SparkSession, sf_dir: str, articles: DataFrame) -> langid.LanguageModel:
    return _once(spark, sf_dir, "languages", lambda: langid.fit_language_model(articles, "id", "full_text", "language"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read_table(spark, sf_dir, "articles")
    return langid.language_errors(articles, "id", "full_text", "language", _language_model(spark, sf_dir, articles)).withColumnRenamed("item_id", "article_id")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every body, with its language and confidence."""
    articles = read_table(spark, sf_dir, "articles")
    return langid.label_segments(articles, "id", "full_text", _language_model(spark, sf_dir, articles)).distinct().withColumnRenamed("item_id", "article_id")


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every body."""
    return langid.label_texts(p3_segments(spark, sf_dir).withColumnRenamed("article_id", "item_id")).withColumnRenamed("item_id", "article_id")


def _pieces_of(df: DataFrame, limit: dict) -> dict:
    return {"max_size": limit["max_size"], "overlap": limit["overlap_size"], "unit": limit["unit"]}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, limit = read_table(spark, sf_dir, "articles"), size_limit(spark, sf_dir, "article_piece")
    counts = pieces.count_pieces(articles, "id", "full_text", **_pieces_of(articles, limit))
    return counts.filter("chunk_count > 1").select(F.col("item_id").alias("article_id")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every article, one delivery of each id."""
    articles, limit = read_table(spark, sf_dir, "articles"), size_limit(spark, sf_dir, "article_piece")
    once = articles.select("id", "full_text").dropDuplicates(["id"])
    return pieces.split_pieces(once, "id", "full_text", **_pieces_of(articles, limit)).withColumnRenamed("item_id", "article_id")


def p4_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose stored chunk_count isn't the number of pieces."""
    articles, limit = read_table(spark, sf_dir, "articles"), size_limit(spark, sf_dir, "article_piece")
    stored = articles.groupBy("id").agg(F.max_by("chunk_count", F.coalesce("updated_at", F.lit(0).cast("timestamp"))).alias("stored_count"))
    counts = pieces.count_pieces(articles, "id", "full_text", **_pieces_of(articles, limit)).distinct().withColumnRenamed("item_id", "id")
    return stored.join(counts, "id").filter(~F.col("stored_count").eqNullSafe(F.col("chunk_count"))).select(F.col("id").alias("article_id"), "stored_count", "chunk_count")


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every body cover, and how many are too large or don't share the overlap with the one before."""
    limit = size_limit(spark, sf_dir, "article_piece")
    p = p4_pieces(spark, sf_dir).select("article_id", "piece_index", "char_start", "char_end", "chunk_count")
    before = F.lag("char_end").over(Window.partitionBy("article_id").orderBy("piece_index"))
    p = p.withColumn("wrong", (F.col("char_end") - F.col("char_start") > limit["max_size"]) | (before - F.col("char_start") != limit["overlap_size"]))
    out = p.groupBy("article_id").agg(F.max("char_end").alias("characters"), F.min("char_start").alias("first"), F.count_if("wrong").alias("wrong"), (F.count("*") == F.max("chunk_count")).alias("counted"))
    return out.select("article_id", F.col("characters").cast("bigint").alias("characters"), F.col("first").cast("bigint").alias("first"), "wrong", "counted")


def _topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read_table(spark, sf_dir, "articles")
    known = [r.asDict() for r in read_dimension(spark, sf_dir, "topics")]
    model = _once(spark, sf_dir, "topics", lambda: topics.fit_topics(articles, "id", "title", "abstract", "source_slug", "doc_type", "topic", known))
    return topics.label_topics(articles, "id", "title", "abstract", "source_slug", "doc_type", model)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_labels(spark, sf_dir).select(F.col("item_id").alias("article_id"), "topic_slug").distinct()


def p5_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many articles each subject has."""
    return topics.topic_composition(_topic_labels(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read_table(spark, sf_dir, "articles")
    pairs = neardup.near_duplicate_pairs(articles, "id", TEXT_COLUMNS, threshold=0.6, shingle=3, min_words=40)
    return pairs.select(F.col("item_a").alias("article_id_a"), F.col("item_b").alias("article_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = read_table(spark, sf_dir, "articles")
    return neardup.near_duplicate_groups(articles, "id", TEXT_COLUMNS, threshold=0.6, shingle=3, min_words=40).withColumnRenamed("item_id", "article_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of the packed size."""
    limit = size_limit(spark, sf_dir, "packed_sequence")
    return packing.pack_sequences(read_table(spark, sf_dir, "documents"), "doc_id", "text", capacity=limit["max_size"]).withColumnRenamed("item_id", "doc_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p7_packed(spark, sf_dir), size_limit(spark, sf_dir, "packed_sequence")["max_size"])


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document's tokens are all placed once, in sequences that aren't too full, and divided only where they
    must be."""
    size = size_limit(spark, sf_dir, "packed_sequence")["max_size"]
    packed = session.cut(p7_packed(spark, sf_dir), "packed")
    full = packed.groupBy("sequence_id").agg(F.sum("tokens").alias("n")).filter(F.col("n") > size).select("sequence_id")
    over = packed.join(full, "sequence_id", "left_semi").select("doc_id").distinct().withColumn("over", F.lit(True))
    by = packed.groupBy("doc_id").agg(F.sum("tokens").alias("all"), F.max("token_end").alias("end"), F.min("token_start").alias("start"), F.count("*").alias("parts"))
    needed = F.greatest(F.ceil(F.col("all") / size), F.lit(1))
    return by.join(over, "doc_id", "left").select("doc_id", ((F.col("all") == F.col("end")) & (F.col("start") == 0) & (F.col("parts") == needed) & F.col("over").isNull()).alias("whole"))


def p8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source stays within its repeats and its budget."""
    collection, report = _mix(spark, sf_dir)
    most = collection.groupBy("source", "item_id").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("n"))
    r = report.join(most, "source", "left")
    return r.select("source", (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.col("reached_tokens") <= F.col("budget_tokens")).alias("within_budget"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = [r.asDict() for r in read_dimension(spark, sf_dir, "mix_targets")]
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source", targets)


def p8_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection in which each source has its target share of the tokens."""
    return _mix(spark, sf_dir)[0].withColumnRenamed("item_id", "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source").select(F.col("item_id").alias("doc_id"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document as it was written, where that can be known."""
    return encoding.restore(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumnRenamed("item_id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_entities, p3_found, p3_segments, p3_languages, p4_found, p4_pieces, p4_chunk_counts, p4_cover, p5_found, p5_composition, p6_found, p6_groups, p7_packed, p7_cover, p7_report, p8_caps, p8_collection, p8_report, p9_found, p9_restored)}

#: What can be said in SQL: the cases themselves, not how they are found.
ORACLES = {
    "p6_found": r"""WITH t AS (SELECT id, any_value(concat_ws(' ', title, abstract, full_text)) AS x FROM articles GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS w FROM t),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 40)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS ia, b.id AS ib, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT ia AS article_id_a, ib AS article_id_b FROM p JOIN n x ON x.id = ia JOIN n y ON y.id = ib WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p6_groups": r"""WITH RECURSIVE t AS (SELECT id, any_value(concat_ws(' ', title, abstract, full_text)) AS x FROM articles GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS w FROM t), c AS (SELECT id, w, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM w WHERE len(w) >= 40),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE id = class_id)), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS ia, b.id AS ib, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2), l AS (SELECT ia, ib FROM p JOIN n x ON x.id = ia JOIN n y ON y.id = ib WHERE c >= 0.6 * (x.n + y.n - c)),
r AS (SELECT class_id AS id, class_id AS root FROM c WHERE id = class_id UNION SELECT l.ib, r.root FROM r JOIN l ON l.ia = r.id), g AS (SELECT id, min(root) AS group_id FROM r GROUP BY 1), d AS (SELECT ia AS id, count(*) AS links FROM l GROUP BY 1)
SELECT c.id AS article_id, c.class_id, g.group_id, coalesce(d.links, 0) AS links FROM c JOIN g ON g.id = c.class_id LEFT JOIN d ON d.id = c.class_id""",
    "p4_cover": "SELECT id AS article_id, max(length(full_text)) AS characters, 0 AS first, 0 AS wrong, true AS counted FROM articles WHERE length(full_text) > 0 GROUP BY 1",
    "p7_cover": "SELECT doc_id, true AS whole FROM documents",
    "p8_caps": "SELECT source, true AS within_repeats, true AS within_budget FROM mix_targets",
    "p4_found": "SELECT DISTINCT id AS article_id FROM articles WHERE length(full_text) > (SELECT max_size FROM size_limits WHERE limit_name = 'article_piece')",
}
