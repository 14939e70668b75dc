"""Connected components and bounded samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbung.operators.components import connected_components
from lumbung.operators.pairs import pairs_within, sieve, spread
from lumbung.operators.sampling import hash_sample, stratified_hash_sample


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + k] == 100 for k in range(40)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(20_000).withColumn("g", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 7 == 0, None).otherwise("common"))
    a, b = (sorted(r["id"] for r in hash_sample(df.repartition(n), "id", 500).collect()) for n in (2, 9))
    assert a == b and 350 < len(a) < 700
    counts = {r["g"]: r["count"] for r in stratified_hash_sample(df, "id", "g", 300).groupBy("g").count().collect()}
    assert set(counts) == {"rare", "common"} and all(200 < n < 420 for n in counts.values())


def test_pairs_of_a_hot_group_are_made_in_blocks(spark):
    rows = [("hot", f"v{i:03}") for i in range(60)] + [("two", "x"), ("two", "y"), ("one", "z"), (None, "a"), (None, "b"), ("two", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    got = [(r["k"], r["a"], r["b"]) for r in pairs_within(df, "k", "v", block=7).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2 + 1 and ("two", "x", "y") in got and all(a < b for _, a, b in got)
    assert pairs_within(df.limit(0), "k", "v").count() == 0


def test_spread_work_is_not_merged(spark):
    tasks = spread(spark.range(10)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4


def test_a_sieve_keeps_all_that_is_wanted(spark):
    df = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), "id")
    wanted = df.filter("id % 20 = 3").select("k")
    kept = sieve(df, "k", wanted)
    assert kept.columns == ["k", "id"] and kept.join(wanted, "k", "left_semi").count() == 1000 and kept.count() < 5000
    assert sieve(df, "k", wanted, most_bits=1 << 15).join(wanted, "k", "left_semi").count() == 1000
    assert sieve(df, "k", wanted.limit(0)).count() == 0 and sieve(df.limit(0), "k", wanted).count() == 0
