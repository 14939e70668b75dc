"""Writes, runs, alerts, sources and streams: on inline rows, with failures, late rows and races."""

from __future__ import annotations

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumbung.functions import text
from lumbung.operators import bm25, media, pending, retrieval, runs, search, store
from lumbung.operators.filters import Filters, between_days, retrievable, scoped
from lumbung.operators.metadata import Listing
from lumbung.sources import feeds
from lumbung.streaming import ingest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_manual_links(spark):
    links = spark.createDataFrame([("a", "b", "doi")], "id string, duplicate_of_id string, duplicate_reason string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(store.set_duplicate(links, "a", "c", known), "id", "duplicate_of_id", "duplicate_reason") == [("a", "c", "manual")]
    assert rows(store.set_duplicate(links, "a", None, known), "id", "duplicate_of_id", "duplicate_reason") == [("a", None, "manual")]
    for target in ("a", "nowhere"):
        with pytest.raises(ValueError):
            store.set_duplicate(links, "a", target, known)


def test_narratives_up_to_a_cap(spark):
    have = spark.createDataFrame([(1, "old", "llm"), (1, "hand", "manual")], "issue_id int, slug string, created_by string")
    want = spark.createDataFrame([(1, "old", "x", "llm", 1), (1, "n1", "y" * 200, "llm", 2), (1, "n1", "z", "llm", 3), (1, "n2", "", "llm", 4), (1, "mine", "m", "manual", 9), (2, "n1", "q", "llm", 1)], "issue_id int, slug string, label string, created_by string, seen_at int")
    got = store.get_or_create(have, want, most=2)
    assert rows(got, "issue_id", "slug") == [(1, "mine"), (1, "n1"), (2, "n1")]
    assert got.filter("slug = 'n1' and issue_id = 1").first()["label"] == "y" * 120


def test_labels_changes_and_vectors(spark):
    a = spark.createDataFrame([("p", ["x", "lost", "x", "y"]), ("q", ["lost", "y"]), ("r", []), ("s", None)], "article_id string, topics array<string>")
    got = store.ranked_labels(a, spark.createDataFrame([("x",), ("y",)], "slug string"))
    assert rows(got, "article_id", "slug", "rank") == [("p", "x", 1), ("p", "y", 2), ("q", "other", 1), ("q", "y", 2), ("r", "other", 1), ("s", "other", 1)]
    current = spark.createDataFrame([("s1", "old", "auto"), ("s2", "kept", "auto")], "id string, title string, title_source string")
    changes = spark.createDataFrame([("s1", "new", None, 1), ("s1", None, "manual", 2), ("s9", "z", "z", 1)], "id string, title string, title_source string, at int")
    assert rows(store.overwrite_given(current, changes, "id", ["title", "title_source"]), "id", "title", "title_source") == [("s1", "new", "manual"), ("s2", "kept", "auto")]
    failures = store.record_failures(spark.createDataFrame([("e" * 3000,), (None,)], "message string"))
    assert sorted(len(r["message"]) for r in failures.collect()) == [0, 2000]
    rows_, left = store.archive(spark.createDataFrame([("a", "ready"), ("b", "ready")], "id string, processing_status string"), spark.createDataFrame([("a", 1), ("b", 1)], "article_id string, n int"), spark.createDataFrame([("a",)], "id string"), F.current_timestamp())
    assert rows(store.visible(rows_), "id") == [("b",)] and rows(left, "article_id") == [("b",)]


def test_pending_vectors_of_another_model(spark):
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    have = spark.createDataFrame([(1, "old"), (2, "new"), (3, None)], "item_id int, model string")
    assert rows(pending.pending_vectors(chunks, have, "new"), "item_id") == [(1,), (3,)]


def mentions(spark):
    at = lambda d: datetime(2024, 1, d, 12)
    out = [(1, f"m{i}", i % 3, "regional" if i % 2 else "national", at(29 + i % 2), True, 7, ["Ana", "Budi"]) for i in range(12)]
    out += [(1, f"o{i}", 0, "national", at(12 + i), True, None, ["Budi"]) for i in range(4)] + [(2, "x", 0, "national", at(30), True, None, ["Cy"]), (1, "no", 0, "national", at(30), False, 7, ["Ana"])]
    return spark.createDataFrame(out, "issue_id int, article_id string, outlet_id int, media_type string, published_at timestamp, is_relevant boolean, narrative_id int, actors array<string>")


def test_alerts_are_found_once(spark):
    m = mentions(spark)
    named = spark.createDataFrame([(7, "new-tale" + "x" * 300, "llm", datetime(2024, 1, 28))], "narrative_id int, slug string, created_by string, first_seen_at timestamp")
    none = spark.createDataFrame([], "issue_id int, dedup_key string")
    found = media.detect_alerts(m, named, none, "2024-01-31 00:00:00")
    got = {r["rule"]: r for r in found.collect()}
    assert set(got) == {"volume_spike", "new_narrative", "new_actor", "regional_spread"}
    assert all(r["issue_id"] == 1 and len(r["title"]) <= 200 and 0 < r["confidence"] <= 0.99 and len(r["evidence_ids"]) == 6 for r in got.values())
    assert got["new_actor"]["title"].endswith("Ana") and got["volume_spike"]["dedup_key"] == "volume:2024-W05"
    assert media.detect_alerts(m, named, found, "2024-01-31 00:00:00").count() == 0
    assert media.detect_alerts(m.limit(0), named, none, "2024-01-31 00:00:00").count() == 0


def test_scope_filters(spark):
    m = mentions(spark).withColumn("region", F.lit("north"))
    tales = spark.createDataFrame([(7, "tale")], "narrative_id int, slug string")
    assert scoped(m, narrative="tale", narratives=tales).count() == 13 and scoped(m, narrative="gone", narratives=tales).count() == 0
    assert scoped(m, media_type="regional", region="north").count() == 6 and scoped(m, region="south").count() == 0
    assert m.filter(between_days("published_at", date(2024, 1, 12), date(2024, 1, 15))).count() == 4 and m.filter(between_days("published_at")).count() == m.count()
    board = {r["issue_id"]: r for r in media.dashboard(m, "2024-01-31 00:00:00", 7, ["national", "regional"]).collect()}
    assert board[1]["current"] == 12 and board[1]["outlets"] == 3 and {x["media_type"]: x["mentions"] for x in board[1]["by_type"]} == {"national": 6, "regional": 6}


def test_retrievable(spark):
    df = spark.createDataFrame([(1, "ready", None), (2, "ready", 1), (3, "pending", None), (4, None, None)], "id int, processing_status string, duplicate_of_id int")
    assert rows(df.filter(retrievable()), "id") == [(1,)]


def test_published_index_reads_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"solar panel number{i} " + ("wind farm" if i % 3 else "tidal")) for i in range(60)] + [(99, None), (100, "")], "id int, t string")
    index = bm25.build_index(docs, "id", "t")
    base = str(tmp_path / "index")
    assert [bm25.publish_index(index, base, shards=8) for _ in range(5)] == [1, 2, 3, 4, 5] and bm25.published(spark, base) == [3, 4, 5]
    there = bm25.read_index(spark, base)
    for words in (["tidal", "panel"], ["unknown"], []):
        want, got = ([(r["item_id"], round(r["score"], 9)) for r in bm25.search(i, words).collect()] for i in (index, there))
        assert want == got
    plan = bm25.search(there, ["tidal"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "WriteFiles" not in plan
    assert rows(bm25.document_frequencies(there, ["tidal"]), "df") == [(20,)]


def test_citations_and_catalogue_answers(spark):
    ranked = spark.createDataFrame([(9, "a", 1, "T", "P", None, "S", date(2020, 1, 2), "u", "Wind. " * 90 + "Solar roof here. " + "Sea. " * 30, 0.123456789), (12, "b", 2, None, None, "J", "S", None, None, None, None)], "position int, article_id string, item_id int, title string, publisher string, journal string, source_name string, published_at date, url string, content string, rerank double")
    a, b = retrieval.build_citations(ranked, ["solar"]).orderBy("index").collect()
    assert (a["index"], a["source"], a["published_at"], a["score"], b["index"], b["source"], b["score"]) == (1, "S", "2020-01-02", 0.12346, 2, "J", 0.0) and "Solar roof" in a["snippet"]
    kept = retrieval.fit_context(spark.createDataFrame([(3, 500), (5, 600), (8, 700)], "position int, tokens int"), 1200)
    assert rows(kept, "index", "original_index") == [(1, 3), (2, 5)]
    assert search.catalogue_answer(Listing(2018, 2018, "", "en"), [], 0) == "No articles published in 2018 were found in the collection."
    said = search.catalogue_answer(Listing(2018, None, "solar", "id"), [{"title": "A *b*", "publisher": "P", "published_at": date(2019, 1, 1), "doc_type": "brief-report"}], 3)
    assert said.startswith('Terdapat 3 artikel yang terbit sejak 2018 tentang "solar" dalam koleksi: (1 yang pertama)') and said.endswith("**1. A b** — P, 2019-01-01 · brief report [1]")
    with pytest.raises(ValueError):
        retrieval.page(ranked, "abstract")


def test_names_lists_and_filters(spark):
    df = spark.createDataFrame([(" ABC ", [" a ", "", "b" * 200, "c"]), ("Else", []), ("", None)], "p string, k array<string>")
    assert [r[0] for r in df.select(text.publisher_name(F.col("p"), {"abc": "A B C"})).collect()] == ["A B C", "Else", None]
    assert df.select(text.cleaned_list(F.col("k"), 2)).first()[0] == ["a", "b" * 120]
    assert Filters(source_slugs=["s"], date_from=date(2020, 1, 1)).describe() == {"sources": ["s"], "date_from": "2020-01-01"} and Filters().is_empty()


def test_one_run_at_a_time(spark, tmp_path):
    log = str(tmp_path / "log")
    seen = []

    def inner():
        with pytest.raises(RuntimeError):
            runs.run_stages(spark, "r2", "full", [], log)
        seen.append(1)

    assert runs.run_stages(spark, "r1", "full", [("a", inner), ("b", lambda: 1 / 0), ("c", lambda: {"n": 1})], log)["status"] == "partial" and seen
    assert runs.run_stages(spark, "r3", "full", [("c", lambda: None)], log)["status"] == "ok"
    assert rows(runs.current_runs(spark, log), "run_id", "status") == [("r1", "partial"), ("r3", "ok")]
    assert runs.next_run(datetime(2024, 1, 1, 17, 59, tzinfo=timezone.utc), "Asia/Jakarta") == datetime(2024, 1, 1, 18, 0, tzinfo=timezone.utc)
    assert runs.next_run(datetime(2024, 1, 1, 18, 0, tzinfo=timezone.utc), "Asia/Jakarta") == datetime(2024, 1, 2, 18, 0, tzinfo=timezone.utc)


def test_an_ingest_from_deliveries_to_index(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "id string, title string, abstract string, full_text string, published_at date, first_seen_at timestamp, source_id int, doc_type string, doi string, updated_at timestamp"
    first = [("a", "Solar roofs", None, "Solar roofs grow. " * 20, date(2020, 1, 1), at, 1, "post", "d1", at), ("b", "Solar roofs", None, "Solar roofs grow. " * 20, date(2020, 1, 1), at, 2, "post", "D1", at), ("c", "Tides", "Tidal power.", None, None, at, 1, "post", None, at)]
    second = [("c", "Tides", None, "Tidal power pays. " * 20, None, datetime(2025, 1, 1), 1, "post", None, datetime(2025, 1, 1))]
    base = str(tmp_path / "corpus")
    for n, delivery in enumerate((first, second)):
        out = runs.run_stages(spark, f"r{n}", "full", runs.ingest_stages(spark, spark.createDataFrame(delivery, schema), base), str(tmp_path / "log"))
        assert out["status"] == "ok", out
    assert out["stats"]["store"]["updated"] == 1 and out["stats"]["dedupe"]["links"] == 1
    a = {r["id"]: r for r in store.read_latest(spark, f"{base}/articles").collect()}
    assert a["c"]["first_seen_at"] == at and a["c"]["abstract"] == "Tidal power." and a["c"]["full_text"].startswith("Tidal power pays")
    hits = bm25.search(bm25.read_index(spark, f"{base}/index"), ["tidal"]).collect()
    assert {r["item_id"].split("#")[0] for r in hits} == {"c"}
    assert [n for n, _ in runs.ingest_stages(spark, spark.createDataFrame(first, schema), base, skip=frozenset({"chunk", "index"}))] == ["store", "dedupe"]


def test_following_a_published_table(spark, tmp_path):
    base = str(tmp_path / "t")
    store.publish(spark.range(5), base)
    reader = store.Newest(spark, base, least_rows=3)
    assert reader.table().count() == 5 and not reader.refresh()
    store.publish(spark.range(1), base)
    assert not reader.refresh() and reader.version == 1
    store.publish(spark.range(7), base)
    assert reader.refresh() and reader.table().count() == 7
    seeds = [("002", "b", spark.range(1)), ("001", "a", spark.range(2))]
    assert store.apply_seeds(spark, base + "s", seeds) == ["001", "002"] and store.apply_seeds(spark, base + "s", seeds) == []
    with pytest.raises(ValueError):
        store.apply_seeds(spark, base + "s", [("001", "changed", spark.range(2))])


def test_broken_pages_are_recorded(spark, tmp_path):
    (tmp_path / "wp").mkdir()
    (tmp_path / "wp" / "good.json").write_text('[{"id": 1, "title": {"rendered": "A"}}, {"title": {"rendered": "no id"}}]')
    (tmp_path / "wp" / "bad.json").write_text('[{"id": 2, "title"')
    assert rows(feeds.read_wordpress(spark, str(tmp_path / "wp")), "external_id") == [("1",)]
    dead = {r["path"].rsplit("/", 1)[1]: r["message"] for r in feeds.wordpress_failures(spark, str(tmp_path / "wp")).collect()}
    assert set(dead) == {"good.json", "bad.json"} and dead["good.json"] == "no id"

    def fetch(url):
        if "page=2" in url and "books" in url:
            raise TimeoutError("slow")
        return (b"{}" if "posts" in url else b"[]"), {"X-WP-TotalPages": "3"}

    saved = []
    count, failed = feeds.stage_wordpress(fetch, "https://s.example/", ["books", "posts"], lambda name, body: saved.append(name), since="2024-01-01")
    assert count == 2 and saved == ["books-00001.json", "books-00003.json"] and len(failed) == 4
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"one|!|three")
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"X")

    def extract(data):
        if data == b"X":
            raise ValueError("no such format")
        return [(lambda p=p: 1 / 0 if p == "!" else p) for p in data.decode().split("|")]

    got = {r["path"][-5:]: r for r in feeds.read_pdfs(spark, str(tmp_path / "pdf"), extract).collect()}
    assert got["a.pdf"]["pages"] == ["one", "", "three"] and got["a.pdf"]["failed_pages"] == [2] and "page 2" in got["a.pdf"]["error"]
    assert got["b.pdf"]["pages"] == [] and "no such format" in got["b.pdf"]["error"]
    (tmp_path / "news.xml").write_text('<rss><channel><item><title>Sun rises - Paper</title><link>https://n.example/1</link><source url="https://paper.example">Paper</source><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item><item><title>No source</title><link>x</link></item></channel></rss>')
    assert rows(feeds.read_search(spark, str(tmp_path / "news.xml")), "title", "source_url") == [("Sun rises", "https://paper.example")]


def test_an_unreadable_snapshot_is_not_an_empty_one(spark, tmp_path):
    schema = "k int, v int, ts timestamp"
    target, state, source = (str(tmp_path / x) for x in ("out", "state", "in"))

    def deliver(values, n):
        spark.createDataFrame([(k, v, datetime(2024, 1, 1, n)) for k, v in values], schema).coalesce(1).write.mode("append").parquet(source)
        s = ingest.stream_table(spark, source, spark.createDataFrame([], schema).schema, "ts")
        return ingest.upsert_stream(s, target, ["k"], state, order=[-F.unix_micros("ts")])

    for n in range(6):
        deliver([(n, n), (0, 10 * n)], n).awaitTermination()
    assert rows(spark.read.parquet(f"{target}/batch=5"), "k", "v") == [(0, 50), *((k, k) for k in range(1, 6))]
    assert not (tmp_path / "out" / "batch=0").exists() and (tmp_path / "out" / "batch=2").exists()
    (tmp_path / "out" / "batch=5" / "_SUCCESS").unlink()
    with pytest.raises(Exception):
        deliver([(9, 9)], 7).awaitTermination()
    assert not (tmp_path / "out" / "batch=6").exists()


def test_late_rows_in_a_later_batch(spark, tmp_path):
    schema = "id int, ts timestamp"
    source = str(tmp_path / "in")
    got = {}
    for lateness in ("2 days", None):
        for n, part in enumerate(([(1, datetime(2024, 3, 1)), (2, datetime(2024, 3, 1))], [(3, datetime(2024, 1, 1)), (1, datetime(2024, 3, 1)), (4, datetime(2024, 3, 2))])):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}-{lateness}/{n}")
            s = ingest.stream_table(spark, f"{source}-{lateness}/*", spark.createDataFrame([], schema).schema, "ts")
            out = str(tmp_path / f"out-{lateness}")
            ingest.first_deliveries(s, "ts", ["id"], lateness).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
        got[lateness] = [r[0] for r in rows(spark.read.parquet(out), "id")]
    assert got[None] == [1, 2, 3, 4] and got["2 days"] == [1, 2, 4]


def test_answer_sections():
    text_ = "skip <answer>Solar <b>grows</b> [1].</answer> x <findings>\n- One\n* Two\n- One\n</findings>"
    for size in (1, 3, 50):
        s = ingest.AnswerStream()
        out = [e for i in range(0, len(text_), size) for e in s.feed(text_[i : i + size])]
        assert "".join(v for k, v in out if k == "delta") == "Solar <b>grows</b> [1]." and [v for k, v in out if k == "finding"] == ["One", "Two"]
    s = ingest.AnswerStream()
    assert [e for p in ("<no_evi", "dence>none ", "here</no_evidence><answer>x</answer>") for e in s.feed(p)] == [("no_evidence", "none here")]
