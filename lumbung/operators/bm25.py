"""BM25 over plain tables: postings, document frequencies, lengths; built in one go, or published and read by term."""

from __future__ import annotations

import posixpath
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions.lexer import terms
from lumbung.operators.store import exists, remove, versions
from lumbung.session import cut

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Bm25Index:
    """postings (item_id, term, tf, doc_len) and lengths (item_id, doc_len). A published index also has the postings'
    ``shard`` of a term, the frequencies (term, df, shard) and one row of totals (n, avg_len)."""

    postings: DataFrame
    lengths: DataFrame
    shards: int = 0
    frequencies: DataFrame | None = None
    totals: DataFrame | None = None

    def of_terms(self, table: DataFrame, words: list[str]) -> DataFrame:
        """The rows of some terms; of a published table, only the files of their shards are read."""
        if not words:
            return table.filter(F.lit(False))
        here = F.col("term").isin(words)
        return table.filter(F.col("shard").isin(sorted({zlib.crc32(w.encode()) % self.shards for w in words})) & here) if self.shards else table.filter(here)


def build_index(df: DataFrame, id_col: str, text_col: str, *, lexer=terms, raw_tf: bool = False) -> Bm25Index:
    """The index of a table's texts. Terms are distinct in a document, so tf is 1, unless ``raw_tf`` counts repeats.
    Documents without a term aren't in the index. The terms are made once and written to the shared folder; lengths,
    frequencies and postings are read from there."""
    slim = cut(df.select(F.col(id_col).alias("item_id"), lexer(F.col(text_col)).alias("terms"), *([F.col(text_col).alias("text")] if raw_tf else [])).withColumn("doc_len", F.size("terms")), "terms")
    if raw_tf:
        counted = slim.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("term"), "terms").filter(F.array_contains("terms", F.col("term")))
        postings = counted.groupBy("item_id", "term").agg(F.count("*").alias("tf")).join(slim.select("item_id", "doc_len"), "item_id")
    else:
        postings = slim.select("item_id", F.explode("terms").alias("term"), F.lit(1).cast("bigint").alias("tf"), "doc_len")
    lengths = slim.select("item_id", "doc_len").filter("doc_len > 0")
    return Bm25Index(postings, lengths)


def publish_index(index: Bm25Index, base: str, *, shards: int = 64, keep: int = 3) -> int:
    """Writes the next version of an index under ``base`` and returns its number. Postings and frequencies lie in
    ``shards`` folders by a hash of the term, sorted by term, so that a search reads little more than its terms' rows. A
    version counts once its last part, the totals, is whole; older ones than ``keep`` go."""
    spark = index.postings.sparkSession
    there = published(spark, base)
    version = (there[-1] if there else 0) + 1
    at = posixpath.join(base, f"version={version}")
    shard = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(shards)).cast("int").alias("shard")
    postings = index.postings.select("term", "item_id", "tf", "doc_len", shard)
    postings.repartition(shards, "shard").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{at}/postings")
    frequencies = spark.read.parquet(f"{at}/postings").groupBy("shard", "term").agg(F.count("*").alias("df"))
    frequencies.repartition(min(shards, 64), "shard").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{at}/frequencies")
    index.lengths.write.mode("overwrite").parquet(f"{at}/lengths")
    totals = spark.read.parquet(f"{at}/lengths").agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"), F.sum("doc_len").alias("terms"), F.lit(shards).alias("shards"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{at}/totals")
    for old in there:
        if old <= version - keep:
            remove(spark, posixpath.join(base, f"version={old}"))
    return version


def published(spark: SparkSession, base: str) -> list[int]:
    """Whole versions of an index, oldest first."""
    return [v for v in versions(spark, base, whole=False) if exists(spark, posixpath.join(base, f"version={v}", "totals", "_SUCCESS"))]


def read_index(spark: SparkSession, base: str) -> Bm25Index:
    """The newest whole version under ``base``. A reader keeps its version; the next call sees a newer one."""
    there = published(spark, base)
    if not there:
        raise FileNotFoundError(f"no index is published under {base}")
    at = posixpath.join(base, f"version={there[-1]}")
    totals = spark.read.parquet(f"{at}/totals")
    return Bm25Index(spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/lengths"), totals.first()["shards"], spark.read.parquet(f"{at}/frequencies"), totals)


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def corpus_stats(index: Bm25Index) -> DataFrame:
    """(n, avg_len) of the whole index."""
    if index.totals is not None:
        return index.totals.select("n", "avg_len")
    return index.lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))


def document_frequencies(index: Bm25Index, words: list[str] | None = None) -> DataFrame:
    """(term, df, idf) of all terms or of some."""
    if index.frequencies is not None:
        counts = index.frequencies if words is None else index.of_terms(index.frequencies, words)
    else:
        counts = (index.postings if words is None else index.of_terms(index.postings, words)).groupBy("term").agg(F.count("*").alias("df"))
    return counts.select("term", "df", idf(corpus_stats(index).select("n").scalar(), F.col("df")).alias("idf"))


def search(index: Bm25Index, words: list[str], limit: int | None = 60, allowed: DataFrame | None = None, *, k1: float = K1, b: float = B) -> DataFrame:
    """(item_id, score) of the best documents for a query's terms, ties by id. Only the query's postings are read.

    ``allowed`` (item_id) masks documents before the ranking; frequencies and the mean length stay those of all
    documents. No terms give an empty result.
    """
    postings = index.of_terms(index.postings, words)
    weights = document_frequencies(index, words or [])
    if allowed is not None:
        postings = postings.join(allowed.select("item_id"), "item_id", "left_semi")
    mean = corpus_stats(index).select("avg_len").scalar()
    hits = postings.join(F.broadcast(weights), "term")  # one row a query term
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / mean))
    out = hits.groupBy("item_id").agg(F.sum(part).alias("score")).filter("score > 0")
    return out.orderBy(F.desc("score"), "item_id").limit(limit) if limit else out


def merge_by_max(*channels: DataFrame) -> DataFrame:
    """(item_id, score): the best score of each item over the variants of a query."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out.groupBy("item_id").agg(F.max("score").alias("score"))
