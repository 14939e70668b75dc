"""Functions, retrieval, stores, media rules, feeds and streams, on small frames."""

from __future__ import annotations

import io
import urllib.error
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbung.functions import language, lexer, text, vectors
from lumbung.operators import bm25, chunks, dedupe, media, pdf, retrieval, store
from lumbung.operators.filters import Filters, predicate, websearch, with_topics
from lumbung.operators.metadata import explicit_filters, listing_intent
from lumbung.sources import feeds
from lumbung.streaming import ingest


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_titles_hashes_and_keys(spark):
    rows = [("The “Café” &amp; <b>Grid</b>", date(2020, 1, 2)), (None, None), ("", date(2020, 5, 5)), ("Grid of the Cafe", date(2020, 9, 9)), ("x" * 100_000, None)]
    got = one(spark, rows, "t string, d date", text.normalize_title(F.col("t")), text.dedup_key(F.col("t"), F.col("d")))
    assert got[0][0] == "the caf grid" and got[1][0] == "" and got[3][0] == "grid of the cafe"
    assert got[1][1] != got[2][1] and len(got[4][1]) == 64
    same = one(spark, [("A  b", "C\n d"), ("a b", "c d")], "t string, b string", text.content_hash(F.col("t"), F.col("b")))
    assert same[0] == same[1]


def test_dates_domains_slugs_tokens(spark):
    got = one(spark, [("2018-05-04",), ("2018-05-04T10:00:00",), ("2018/05/04",), ("2018",), ("1970-01-01",), ("no date",), (None,)], "d string", text.parse_date(F.col("d")))
    assert [g[0] for g in got] == [date(2018, 5, 4)] * 3 + [date(2018, 1, 1), None, None, None]
    got = one(spark, [("https://www.Example.com/a?b",), ("example.org",), ("",), (None,)], "u string", text.domain_of(F.col("u")))
    assert [g[0] for g in got] == ["example.com", "example.org", None, None]
    assert one(spark, [("Ünder  the Sun!",)], "s string", text.slugify(F.col("s")))[0][0] == "nder-the-sun"
    assert [g[0] for g in one(spark, [("a b c",), ("",)], "s string", text.estimated_tokens(F.col("s")))] == [5, 1]
    got = one(spark, [("Tue, 05 Mar 2024 10:00:00 GMT",), ("2024-03-05T10:00:00+00:00",), ("soon",)], "s string", text.feed_time(F.col("s")))
    assert got[0] == got[1] == (datetime(2024, 3, 5, 10),) and got[2] == (None,)


def test_html_and_snippets(spark):
    page = "<p>One &amp; two<br>three</p><script>x</script><figure>pic<figcaption>Foto</figcaption></figure><div>four</div>"
    assert text.strip_html(page) == "One & two\nthree\npic\nfour"
    assert text.strip_html(None) == "" and text.strip_html("a <b") .startswith("a")
    body = "First sentence here. " * 20 + "The solar inverter clips. " + "Last one. " * 20
    s = text.best_snippet(body, {"solar", "inverter"})
    assert "solar inverter" in s and s.startswith("…") and s.endswith("…") and len(s) <= 330
    assert text.best_snippet("short", set()) == "short" and text.best_snippet(None, {"a"}) == ""
    assert one(spark, [(page,), (None,)], "h string", text.html_to_text("h"))[1][0] == ""


def test_trigrams(spark):
    got = one(spark, [("word", "word"), ("word", "wood"), ("", ""), (None, "a")], "a string, b string", text.trigram_similarity(F.col("a"), F.col("b")))
    assert got[0][0] == 1.0 and 0 < got[1][0] < 1 and got[2][0] == 0.0


def test_stems():
    assert [lexer.stem_english(w) for w in ("caresses", "ponies", "running", "relational", "hopefulness", "cry", "flies")] == ["caress", "poni", "run", "relat", "hope", "cri", "fli"]
    assert [lexer.stem_indonesian(w) for w in ("pembiayaan", "menulis", "makanan", "bukunya", "dibaca")] == ["biaya", "tulis", "makan", "buku", "baca"]


def test_lexemes_and_language(spark):
    long_id = "yang dan untuk dengan pada dari ini itu tidak akan " * 6
    rows = [("The turbines are running", "en"), ("pembiayaan dan energi", "id"), (None, "en"), ("", None)]
    got = one(spark, rows, "t string, l string", lexer.lexemes(F.col("t"), F.col("l")))
    assert got[0][0] == ["run", "turbin"] and "biaya" in got[1][0] and got[2][0] == [] and got[3][0] == []
    rows = [(long_id,), ("the of and to in is that for with as " * 6,), ("Solusi kurangi pemakaian minyak",), ("short",), ("9999999999999999",), (None,), ("zzzz yyyy xxxx wwww",)]
    got = [r[0]["language"] for r in one(spark, rows, "t string", language.detect(F.col("t")))]
    assert got == ["id", "en", "id", None, None, None, None]
    rows = [("eng", None, None, None), (None, None, "https://x/id/a", None), (None, long_id, None, None), (None, None, None, "the report of the grid and the law"), (None, None, None, None)]
    got = [(r[0]["language"], r[0]["source"]) for r in one(spark, rows, "d string, t string, u string, h string", language.resolve(*map(F.col, "dtuh")))]
    assert got == [("en", "declared"), ("id", "declared"), ("id", "detected"), ("en", "detected"), ("en", "detected")]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])]
    got = one(spark, rows, "a array<float>, b array<float>", vectors.cosine(F.col("a"), F.col("b")))
    assert got[0][0] == pytest.approx(0.70710678) and got[1][0] is None and got[2][0] is None
    with pytest.raises(ValueError):
        vectors.literal([1.0, float("nan")])


SOURCES, TOPICS = [("pmc-web", "Port Moresby Centre"), ("ije", "IJE")], [("electricity-grid", "Electricity & Grid", "Kelistrikan")]


@pytest.mark.parametrize("ask, lo, hi", [
    ("Show articles published in 2026 about subsidy reform", date(2026, 1, 1), date(2026, 12, 31)),
    ("Artikel energi terbaru 2026", date(2026, 1, 1), date(2026, 12, 31)),
    ("articles published since 2020", date(2020, 1, 1), None),
    ("articles published between 2020 and 2023", date(2020, 1, 1), date(2023, 12, 31)),
    ("articles year:2026 date_from:2026-03-01 date_to:2026-06-30", date(2026, 3, 1), date(2026, 6, 30)),
    ("articles date_from:2026-02-31", date(2026, 1, 1), date(2026, 12, 31)),
    ("Indonesia 2045 energy strategy", None, None),
])
def test_years_in_queries(ask, lo, hi):
    f = explicit_filters(ask, SOURCES, TOPICS)
    assert (f.date_from, f.date_to) == (lo, hi)


def test_labels_in_queries():
    f = explicit_filters('articles from Port Moresby Centre by "Jane Doe" in category Electricity & Grid', SOURCES, TOPICS)
    assert (f.source_slugs, f.authors, f.topics) == (["pmc-web"], ["Jane Doe"], ["electricity-grid"])
    f = explicit_filters('source:PMC topic:"Electricity & Grid" lang:English', SOURCES, TOPICS, Filters(doc_types=["book"], languages=["id"]))
    assert (f.source_slugs, f.topics, f.languages, f.doc_types) == (["pmc-web"], ["electricity-grid"], ["en"], ["book"])
    assert explicit_filters("Indonesia 2045 energy strategy", SOURCES, TOPICS).is_empty()
    with pytest.raises(ValueError):
        Filters(date_from=date(2021, 1, 1), date_to=date(2020, 1, 1))


def test_listings():
    assert listing_intent("list artikel di 2018").year_from == 2018
    assert listing_intent("daftar publikasi tentang solar").topic == "solar"
    assert listing_intent("artikel apa saja yang terbit sejak 2019").year_to is None
    assert listing_intent("Sebutkan tantangan utama dalam laporan 2023") is None
    assert listing_intent("") is None and listing_intent("list articles " * 40) is None


def test_predicates(spark):
    rows = [(1, "a", ["Jane Doe"], "book", "en", date(2020, 1, 1)), (2, "b", None, "post", "id", None), (3, "a", [], None, None, date(2021, 1, 1))]
    df = spark.createDataFrame(rows, "id int, source_slug string, authors array<string>, doc_type string, language string, published_at date")
    f = Filters(source_slugs=["a"], authors=["JANE DOE"], doc_types=["book"], languages=["en"], date_from=date(2019, 1, 1), date_to=date(2020, 1, 1))
    assert [r["id"] for r in df.filter(predicate(f)).collect()] == [1]
    assert set(f.describe()) == {"sources", "authors", "doc_types", "languages", "date_from", "date_to"}
    assert df.filter(predicate(Filters())).count() == 3
    links = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "article_id int, topic_slug string")
    assert [r["id"] for r in with_topics(df, links, ["x", "y"]).collect()] == [1]
    words = spark.createDataFrame([(["solar", "power", "plant"],), (["wind", "farm"],), ([],)], "w array<string>")
    hit = lambda q: [bool(r[0]) for r in words.select(websearch(q, F.col("w"))).collect()]
    assert hit('"solar power"') == [True, False, False] and hit("solar or farm") == [True, True, False] and hit("wind -farm") == [False] * 3 and hit("") == [False] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60))
def test_chunks_stay_under_the_cap(lengths):
    body = " ".join(("Word " + "word " * n).strip() + "." for n in lengths)
    got = list(chunks.chunk_text(body, 100, 20))
    assert got and all(c[3] <= 512 for c in got)
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))
    assert got[0][1] == 0


def test_chunk_edges(spark):
    assert list(chunks.chunk_text(None)) == [] and list(chunks.chunk_text("  ")) == []
    assert len(list(chunks.chunk_text("Two short. Sentences here."))) == 1
    assert [c[3] for c in chunks.chunk_text("word " * 900)][0] <= 450
    assert len(list(chunks.chunk_text("See Fig. 3 for it. Next one."))) == 1
    body = "INTRODUCTION\n\n" + "A sentence of some words is here. " * 80 + "\n\nMETHODS\n\n" + "Another sentence follows there. " * 90
    assert {c[4] for c in chunks.chunk_text(body)} == {"Introduction", "Methods"}
    df = spark.createDataFrame([(1, None, "title"), (2, "", "other"), (3, None, None)], "id int, full_text string, content string")
    assert {r["item_id"]: r["content"] for r in chunks.chunk_documents(df, "id", ["full_text", "content"]).collect()} == {1: "title", 2: "other"}
    done = spark.createDataFrame([(1, "h1"), (1, "h1"), (2, "old")], "article_id int, chunked_hash string")
    now = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3"), (4, None)], "id int, content_hash string")
    assert {r["id"] for r in chunks.pending_chunks(now, done).collect()} == {2, 3}


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "solar solar wind"), (2, "wind farm rotor"), (3, None), (4, "the of")], "id int, text string")
    index = bm25.build_index(df, "id", "text")
    got = {r["item_id"]: r["score"] for r in bm25.search(index, ["solar"]).collect()}
    import math

    assert got == {1: pytest.approx(math.log1p(1.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2.5)))}
    assert bm25.search(index, []).count() == 0
    allowed = spark.createDataFrame([(2,)], "item_id int")
    assert [r["item_id"] for r in bm25.search(index, ["wind"], allowed=allowed).collect()] == [2]
    assert {r["term"]: r["tf"] for r in bm25.build_index(df, "id", "text", raw_tf=True).postings.filter("item_id = 1").collect()} == {"solar": 2, "wind": 1}
    assert {r["item_id"]: round(r["score"], 3) for r in bm25.merge_by_max(bm25.search(index, ["solar"]), bm25.search(index, ["wind"])).collect()}.keys() == {1, 2}


def test_fusion_rerank_cap_gate(spark):
    sem = spark.createDataFrame([(1, 0.9), (2, 0.8)], "item_id int, score double")
    lex = spark.createDataFrame([(3, 9.0), (1, 5.0)], "item_id int, score double")
    fused = {r["item_id"]: r for r in retrieval.fuse(sem, lex).collect()}
    assert fused[1]["rrf"] == pytest.approx(1 / 61 + 1 / 62) and fused[3]["rank_semantic"] is None
    assert [r["item_id"] for r in retrieval.fuse(sem, lex, limit=3).collect()] == [1, 3, 2]  # 3: 1/61 > 2: 1/62
    rows = [(i, a, float(10 - i), 0.9 - i / 100) for i, a in enumerate("aaaabc")]
    got = retrieval.diversify(spark.createDataFrame(rows, "item_id int, article_id string, rerank double, semantic double"), 5).orderBy("position").collect()
    assert [r["item_id"] for r in got] == [0, 1, 4, 5, 2]
    cands = [(1, 0.02, ["solar", "wind"], "A solar plan", ["x"], "the solar wind", "journal-article", 2020), (2, 0.02, None, None, None, None, None, None)]
    df = spark.createDataFrame(cands, "item_id int, rrf double, lexemes array<string>, title string, keywords array<string>, content string, doc_type string, published_year int")
    got = {r["item_id"]: r["rerank"] for r in retrieval.rerank_scores(df, 'plan "solar wind"', ["solar", "wind"]).collect()}
    assert got[1] == pytest.approx(0.02 * (1 + 0.25 + 0.15 + 0.10 * 0.5 + 0.05)) and got[2] == pytest.approx(0.02 * 0.49)
    gate = retrieval.evidence(spark.createDataFrame([(0.9, 0.02), (None, 0.02), (0.1, 0.001)], "semantic double, rerank double"), least_similarity=0.82, least_rerank=0.015).first()
    assert gate["has_evidence"] and gate["strong_rows"] == 2
    assert not retrieval.evidence(df.filter("false").select(F.lit(1.0).alias("semantic"), F.lit(1.0).alias("rerank")), least_similarity=0.5, least_rerank=0.5).first()["has_evidence"]


def test_context_and_citations(spark):
    df = spark.createDataFrame([(1, 9000), (2, 2000), (3, 2000)], "position int, tokens int")
    assert [r["index"] for r in retrieval.fit_context(df, 12_000).orderBy("index").collect()] == [1, 2]
    assert retrieval.fit_context(df, 10).count() == 1
    rows = [("Solar grew [1] and fell [9] , again [2].", 2), ("x" * 300, 2), (None, 0), ("see [10] and [1]", 1)]
    got = retrieval.check_citations(spark.createDataFrame(rows, "answer string, n int"), "answer", "n").collect()
    assert got[0]["checked_answer"] == "Solar grew [1] and fell, again [2]." and got[0]["used"] == [1, 2] and got[0]["invalid"] == [9] and got[0]["grounded"]
    assert not got[1]["grounded"] and got[2]["grounded"] and got[3]["checked_answer"] == "see and [1]"
    ranks = spark.createDataFrame([(1,), (7,), (None,), (2,)], "rank int")
    r = retrieval.recall_at(ranks).first()
    assert (r["recall_at_5"], r["recall_at_10"], round(r["mrr"], 4)) == (0.5, 0.75, round((1 + 1 / 7 + 0.5) / 4, 4))


def test_relink_layers(spark):
    t = datetime(2020, 1, 1)
    rows = [("a", t, 1, "x", "10.1/A", "h1", "k1", None, None), ("b", t, 2, "y", "10.1/a", "h2", "k2", None, None), ("c", t, 1, "x", None, "h1", "k3", None, None), ("d", t, 2, "y", None, "h4", "k3", None, None), ("e", t, 1, "x", None, "h5", "k4", None, None), ("f", t, 1, "x", None, "h6", "k4", None, None), ("g", t, 1, "x", None, "h1", "k9", None, "manual"), ("h", t, 1, "x", None, None, None, "a", "manual")]
    df = spark.createDataFrame(rows, "id string, first_seen_at timestamp, source_id int, doc_type string, doi string, content_hash string, dedup_key string, duplicate_of_id string, duplicate_reason string")
    got = {r["id"]: (r["duplicate_of_id"], r["duplicate_reason"]) for r in dedupe.relink(df).collect()}
    assert got["b"] == ("a", "doi") and got["c"] == ("a", "content_hash") and got["d"] == (None, None)
    assert got["e"] == got["f"] == (None, None) and got["g"] == (None, "manual") and got["h"] == ("a", "manual")
    again = {r["id"]: (r["duplicate_of_id"], r["duplicate_reason"]) for r in dedupe.relink(dedupe.relink(df)).collect()}
    assert again == got and dedupe.relink(df.limit(0)).count() == 0


def test_upserts(spark):
    cur = spark.createDataFrame([(1, "a", "t1", "x", ["title"]), (2, "b", "t1", "y", None)], "id int, title string, first string, doi string, locked array<string>")
    new = spark.createDataFrame([(1, "A", "t2", None, None), (3, "c", "t2", None, None), (3, "c", "t2", None, None)], cur.schema)
    got = {r["id"]: r for r in store.upsert(cur, new, ["id"], insert_only=["first"], keep_if_null=["doi"], locked="locked").collect()}
    assert (got[1]["title"], got[1]["first"], got[1]["doi"], got[1]["action"]) == ("a", "t1", "x", "updated")
    assert got[2]["action"] == "kept" and got[3]["action"] == "inserted" and len(got) == 3
    once = store.upsert(cur, new, ["id"], insert_only=["first"], keep_if_null=["doi"], locked="locked").drop("action")
    twice = store.upsert(once, new, ["id"], insert_only=["first"], keep_if_null=["doi"], locked="locked").drop("action")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert store.upsert(cur.limit(0), new, ["id"]).count() == 2
    assert store.insert_absent(cur, new, ["id"]).count() == 1
    bad = spark.createDataFrame([("e1", None), (None, "t")], "external_id string, title string")
    ok, dead = store.split_valid(bad, F.col("external_id").isNotNull() & F.col("title").isNotNull(), "validate", "no title")
    assert ok.count() == 0 and dead.count() == 2
    items = spark.createDataFrame([(1, "T", "g", 1, "x"), (1, "t", "g", 2, "y"), (1, "Old", "g", 3, "z"), (1, "Old", "f", 4, "w")], "outlet_id int, title string, via string, published_at int, external_id string")
    kept = store.skip_known_titles(items, spark.createDataFrame([(1, "OLD")], "outlet_id int, title string"), only=F.col("via") == "g")
    assert {r["external_id"] for r in kept.collect()} == {"x", "w"}
    a = store.field_changes(cur, new.dropDuplicates(["id"]), "id", ["title", "doi"]).first()
    assert a["changed"]["title"]["before"] == "a" and a["changed"]["doi"]["after"] is None
    numbered = store.append_numbers(spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "k string, o int"), spark.createDataFrame([("s", 4)], "k string, seq int"), "k", ["o"])
    assert {(r["k"], r["o"]): r["seq"] for r in numbered.collect()} == {("s", 1): 5, ("s", 2): 6, ("t", 1): 1}
    assert store.replace_groups(cur, new.limit(1), ["id"]).count() == 2
    assert store.event_frame("delta", {"t": "a\nb"}) == 'event: delta\ndata: {"t": "a\\nb"}\n\n'


def test_published_versions(spark, tmp_path):
    base = str(tmp_path / "index")
    for n in range(5):
        assert store.publish(spark.range(n), base) == n + 1
    assert store.versions(spark, base) == [3, 4, 5] and store.read_latest(spark, base).count() == 4
    with pytest.raises(FileNotFoundError):
        store.read_latest(spark, str(tmp_path / "none"))


def test_media_rules(spark):
    rows = [(1, i, 1, "regional" if i % 2 else "national", datetime(2024, 1, 30, i), True, 0.9, 1, ["New"]) for i in range(9)]
    rows += [(1, 50, 2, "national", datetime(2024, 1, 10), True, 0.9, 1, []), (1, 60, 2, "national", datetime(2024, 1, 30), False, 0.1, 1, ["Noise"] * 9)]
    m = spark.createDataFrame(rows, "issue_id int, article_id int, outlet_id int, media_type string, published_at timestamp, is_relevant boolean, relevance double, narrative_id int, actors array<string>")
    at = "2024-01-31 00:00:00"
    spike = media.volume_spikes(m, at).first()
    assert spike["severity"] == "high" and spike["dedup_key"] == "volume_spike:2024-W05"
    assert [r["actor"] for r in media.new_actors(m, at).collect()] == ["New"]
    assert media.regional_spread(m, at, least=4).count() == 1
    n = spark.createDataFrame([(1, "n", "llm", datetime(2024, 1, 29)), (2, "o", "seed", datetime(2024, 1, 29))], "narrative_id int, slug string, created_by string, first_seen_at timestamp")
    assert media.new_narratives(m, n, at).first()["articles"] == 10
    total = media.totals(m, at, 7).first()
    assert (total["current"], total["previous"], total["delta_pct"]) == (9, 0, None)
    series = media.daily_series(m, at, 7, ["national", "regional"])
    assert series.count() == 7 and series.agg(F.sum("total")).first()[0] == 9
    assert media.volume_spikes(m.limit(0), at).count() == 0
    kinds = one(spark, [("sumut.network.com",), ("balipost.com",), ("paper.com",)], "d string", media.guess_kind(F.col("d"), ("network.com",)))
    assert [tuple(k[0]) for k in kinds] == [("regional", "Sumatera Utara"), ("regional", "Bali"), ("national", None)]


def test_pdf_cleaning(spark):
    pages = [f"Journal X\nPage {n * 7} opens\nBody {n} of the conver-\nsion text.\nIt ends {n * 9}\n{n}" for n in range(1, 5)]
    got = one(spark, [(pages,), ([],), (["a\n1", "b"],)], "p array<string>", pdf.running_lines(F.col("p")), pdf.join_pages(F.col("p")))
    assert got[0][0] == ["Journal X"] and "conversion text." in got[0][1] and "Journal X" not in got[0][1] and "\n3" not in got[0][1]
    assert got[1][1] == "" and got[2][1] == "a\n\nb"
    rows = [("body " * 50 + "\nReferences\nx",), ("References\n" + "body " * 50,), ("no heading",)]
    got = one(spark, rows, "t string", pdf.without_references(F.col("t")))
    assert got[0][0].endswith("body") and got[1][0].startswith("References") and got[2][0] == "no heading"
    assert [g[0] for g in one(spark, [("word " * 200,), ("12 34 " * 200,), ("short",)], "t string", pdf.quality(F.col("t")))] == ["extracted", "poor", "poor"]


OAI = """<OAI-PMH><ListRecords>
<record><header><identifier>oai:1</identifier><datestamp>2020-01-01</datestamp></header><metadata><oai_dc:dc xmlns:oai_dc="a" xmlns:dc="b"><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:identifier>https://j.example/article/view/1</dc:identifier><dc:identifier>10.1/x</dc:identifier><dc:relation>https://j.example/article/view/1/2</dc:relation><dc:source>J; Vol. 3 No. 2 (2018): N; 5-21</dc:source><dc:source>1234-567X</dc:source><dc:date>2018-05-01</dc:date></oai_dc:dc></metadata></record>
<record><header status="deleted"><identifier>oai:2</identifier></header></record>
<record><header><identifier>oai:3</identifier></header></record>
</ListRecords></OAI-PMH>"""
RSS = "<rss><channel><item><title>Sun - Paper</title><link>https://p.example/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Text&lt;/p&gt;</description></item><item><title></title><link>x</link></item></channel></rss>"


def test_feeds(spark, tmp_path):
    (tmp_path / "oai.xml").write_text(OAI)
    got = {r["external_id"]: r for r in feeds.read_oai(spark, str(tmp_path / "oai.xml")).collect()}
    r = got["oai:1"]
    assert set(got) == {"oai:1", "oai:3"} and got["oai:3"]["empty"]
    assert (r["authors"], r["doi"], r["url"], r["pdf_url"], r["galley_id"]) == (["A", "B"], "10.1/x", "https://j.example/article/view/1", "https://j.example/article/download/1/2", "2")
    assert (r["journal"], r["volume"], r["issue"], r["pages"], r["issn"], r["published_at"]) == ("J", "3", "2", "5-21", ["1234-567X"], date(2018, 5, 1))
    (tmp_path / "wp.json").write_text('[{"id": 1, "date": "2020-01-02T00:00:00", "link": "u", "title": {"rendered": "A &amp; B"}, "content": {"rendered": ""}, "excerpt": {"rendered": "<p>E</p>"}, "_post_type": "book"}, {"id": 2, "title": {"rendered": ""}}]')
    got = {r["external_id"]: r for r in feeds.read_wordpress(spark, str(tmp_path / "wp.json")).collect()}
    assert got["1"]["title"] == "A & B" and got["1"]["full_text"] == "E" and got["1"]["full_text_status"] == "abstract" and got["2"]["full_text_status"] == "none"
    (tmp_path / "feed.xml").write_text(RSS)
    got = feeds.read_feed(spark, str(tmp_path / "feed.xml")).collect()
    assert len(got) == 1 and got[0]["summary"] == "Text" and got[0]["published_at"] == datetime(2024, 3, 5, 10)
    assert one(spark, [("Sun - Paper", "Paper")], "t string, s string", feeds.news_title(F.col("t"), F.col("s")))[0][0] == "Sun"
    assert feeds.search_seeds(spark.createDataFrame([(1, [str(i) for i in range(20)])], "issue_id int, keywords array<string>")).count() == 15
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "pdf/b.pdf").write_bytes(b"\xff")
    got = {r["path"][-5:]: r["pages"] for r in feeds.read_pdfs(spark, str(tmp_path / "pdf"), lambda b: b.decode().split("\f")).collect()}
    assert got == {"a.pdf": ["one", "two"], "b.pdf": []}


def test_retries():
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return io.BytesIO(b"ok")

    assert feeds.get_with_retry("u", wait=0, open_=flaky) == b"ok" and len(calls) == 3
    with pytest.raises(urllib.error.HTTPError):
        feeds.get_with_retry("u", wait=0, open_=lambda u: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "gone", {}, None)))


def test_tag_stream():
    s = ingest.TagStream()
    out = [e for piece in ["Hel", "lo <fin", "ding>a", "b</findi", "ng> x<no_ev", "idence/> y <"] for e in s.feed(piece)] + list(s.close())
    assert "".join(v for k, v in out if k == "delta") == "Hello  x y <" and ("finding", "ab") in out and ("no_evidence", "") in out


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, datetime(2024, 1, 1 + i % 5, i % 24)) for i in range(200)] + [(0, datetime(2024, 1, 1))] * 3
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    q = ingest.upsert_stream(ingest.stream_table(spark, str(tmp_path / "in"), df.schema, "ts"), target, ["k"], str(tmp_path / "state"), order=[F.col("ts")])
    q.awaitTermination()
    assert spark.read.parquet(f"{target}/batch=0").count() == 7
    batch = ingest.windowed_counts(df, "ts", ["k"])
    assert batch.agg(F.sum("n")).first()[0] == 203
    assert ingest.first_deliveries(df, "ts", ["k"]).count() == 7
    runs = spark.createDataFrame([("ok", "full", "a", datetime(2024, 3, 5)), ("failed", "full", "a", datetime(2024, 4, 5))], "status string, kind string, source string, started_at timestamp")
    assert ingest.harvest_since(runs, "a").first()[0] == date(2024, 3, 3) and ingest.harvest_since(runs, "b").first()[0] is None
