"""Hybrid retrieval, listings, prompts and runs as wholes."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from lumbung.functions import prompts
from lumbung.functions.lexer import terms
from lumbung.operators import bm25, runs, search
from lumbung.operators.filters import Filters
from lumbung.operators.metadata import listing_intent


@pytest.fixture(scope="module")
def corpus(spark):
    articles = spark.createDataFrame([(f"a{i}", f"Title {i}", ["k"], "journal-article" if i % 2 else "post", date(2010 + i, 1, 1) if i else None, "s", ["Jane"], "en") for i in range(8)], "id string, title string, keywords array<string>, doc_type string, published_at date, source_slug string, authors array<string>, language string")
    rows = [(i, f"a{i // 3}", "solar roof " * (1 + i % 2) + f"word{i}") for i in range(20)] + [(20, "a7", "wind farm")]
    chunks = spark.createDataFrame(rows, "item_id int, article_id string, content string").withColumn("lexemes", terms(F.col("content")))
    vectors = spark.createDataFrame([(i, [1.0, i / 20]) for i in range(21)], "item_id int, embedding array<double>")
    topics = spark.createDataFrame([("a1", "sun"), ("a2", "sun"), ("a2", "law")], "article_id string, topic_slug string")
    return search.Corpus(chunks, articles, bm25.build_index(chunks, "item_id", "content"), vectors, topics)


def test_retrieve(corpus):
    got = search.retrieve(corpus, "solar", [["solar"]], [[1.0, 0.0]], top_k=5).orderBy("position").collect()
    assert len(got) == 5 and [r["position"] for r in got] == [1, 2, 3, 4, 5]
    assert max(sum(r["article_id"] == x["article_id"] for r in got) for x in got) <= 2
    only = search.retrieve(corpus, "wind", [["wind"]], [[1.0, 0.0]], mode="keyword").collect()
    assert [r["item_id"] for r in only] == [20]
    about = search.retrieve(corpus, "solar", [["solar"]], [[1.0, 0.0]], Filters(topics=["sun", "law"]), top_k=20, per_article=20)
    assert {r["article_id"] for r in about.collect()} == {"a1", "a2"} and about.select("item_id").distinct().count() == about.count() == 6
    assert search.retrieve(corpus, "solar", [["solar"]], [[1.0, 0.0]], Filters(languages=["fr"])).count() == 0
    with pytest.raises(ValueError):
        search.retrieve(corpus, "x", [["x"]], [[1.0, 0.0]], mode="other")


def test_listings(corpus):
    f = search.listing_filters(listing_intent("daftar artikel sejak 2014"), Filters(date_to=date(2016, 1, 1)))
    rows, total = search.list_articles(corpus.articles, f, 2)
    assert [r["id"] for r in rows.collect()] == ["a6", "a5"] and total.first()["total"] == 3
    found = search.list_about(corpus, "solar", [["solar"]], [[1.0, 0.0]], Filters(), least_similarity=0.5)
    assert found.count() == found.select("article_id").distinct().count() > 3
    assert search.list_about(corpus, "solar", [["solar"]], [[1.0, 0.0]], Filters(), least_similarity=1.1).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([([(1, 'A "b" <c>', 2020, "x & y"), (2, None, None, None)], [("user", "q1"), ("assistant", "z" * 700), ("user", "q2")], "see [1] and [2]")], "s array<struct<index:int,title:string,year:int,content:string>>, h array<struct<role:string,content:string>>, a string")
    block, history, answer = df.select(prompts.source_block(F.col("s")), prompts.history_block(F.col("h"), 2), prompts.restate_citations(F.col("a"), F.col("s"))).first()
    assert '<source index="1" title="A &quot;b&quot; &lt;c&gt;" year="2020">\nx &amp; y\n</source>' in block
    assert history.startswith("assistant: zzz") and "…\nuser: q2" in history and "q1" not in history
    assert answer == 'see [A "b" <c>, 2020] and []'


def test_runs(spark, tmp_path):
    log = str(tmp_path / "runs")

    def broken():
        raise ValueError("no feed")

    got = runs.run_stages(spark, "r1", "full", [("crawl", lambda: {"inserted": 3}), ("media", broken), ("index", lambda: None)], log)
    assert got["status"] == "partial" and got["stats"]["crawl"]["inserted"] == 3 and "no feed" in got["errors"]["media"]
    assert runs.run_stages(spark, "r2", "full", [("crawl", broken)], log)["status"] == "failed"
    assert {r["run_id"]: r["status"] for r in runs.current_runs(spark, log).collect()} == {"r1": "partial", "r2": "failed"}
    spark.createDataFrame([("r3", "full", "running", *[__import__("datetime").datetime.now(__import__("datetime").timezone.utc)] * 2, "{}", "{}")], runs.RUN_SCHEMA).write.mode("append").parquet(log)
    with pytest.raises(RuntimeError):
        runs.run_stages(spark, "r4", "full", [], log)
