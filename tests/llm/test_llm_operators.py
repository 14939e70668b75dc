"""The operators for language-model text: round trips, held-out accuracy, and the cases that data really has."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbung.llm import encoding, langid, mixing, packing, scans, topics
from lumbung.llm.ftrl import Ftrl, softmax, temperature
from lumbung.llm.tokens import VOCABULARY, count_tokens

EN = ["The cost of the regional station rose to 12 tonnes, which narrows the local forecast.", "Visitors from the harbour asked why the cable had not been repaired since March.", "This section describes how the coastal agreement and the boundary were weighted.", "Only a few of the sites visited had a working boiler and a meter."]
ID = ["Biaya stasiun daerah naik menjadi 12 ton, sehingga mempersempit prakiraan lokal.", "Pengunjung dari pelabuhan bertanya mengapa kabel itu tidak diperbaiki sejak Maret.", "Bagian ini menerangkan bagaimana perjanjian pesisir dan batas diberi bobot.", "Hanya sedikit lokasi yang dikunjungi memiliki ketel dan meteran yang berfungsi."]
NL = ["De kosten van het regionale station stegen naar 12 ton, wat de plaatselijke raming verzwakt.", "Bezoekers uit de haven vroegen waarom de kabel sinds maart niet was hersteld.", "Dit deel beschrijft hoe de akkoorden en de grenzen werden gewogen.", "Slechts enkele van de bezochte plaatsen hadden een werkende ketel en een meter."]
FR = ["Le coût de la station régionale est monté à 12 tonnes, ce qui réduit la prévision locale.", "Les visiteurs du port ont demandé pourquoi le câble n'était pas réparé depuis mars.", "Cette partie décrit comment les accords et les limites ont été pondérés.", "Seuls quelques sites visités avaient une chaudière et un compteur en service."]
ALL = {"en": EN, "id": ID, "nl": NL, "fr": FR}


# regression by follow-the-regularised-leader


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    model = Ftrl(50, 2, l1=12.0)
    rows = [np.append(rng.choice(49, 8, replace=False) + 1, 0) for _ in range(2000)]
    labels = [int(3 in r) for r in rows]
    for r, y in zip(rows, labels):
        model.step(r, np.ones(9), np.eye(2)[y])
    w = model.weights()
    assert np.mean([softmax(w[r].sum(axis=0)).argmax() == y for r, y in zip(rows, labels)]) > 0.95
    assert (w == 0).mean() > 0.3
    assert temperature(np.array([[5.0, 0.0]] * 10), np.array([0] * 6 + [1] * 4)) < 0.5 and temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


# scanned pages

WIDE = "Under the regional framework the southern committee must report detailed forecast agreement twice a year"


def scanned() -> list[tuple]:
    rng = random.Random(1)
    words = sorted({w.lower() for w in WIDE.split()} | {"station", "harbour", "consumer", "permanent", "municipality", "laboratory", "inventory"})
    rows = []
    for i in range(60):
        body = [" ".join(rng.choice(words) for _ in range(8)).capitalize() + "." for _ in range(12)]
        rows.append((f"clean{i:02}", f"Report {i}", " ".join(body[:6]) + "\n\n" + " ".join(body[6:])))
        lines = ["\n".join(b for b in body[:4])]
        rows.append((f"lines{i:02}", f"Report {i}", "\n".join(lines) + "\n\nYear\n2001\n745\n822\n397"))
    page = "Sun Journal (3/2020)\nThe regional frame-\nwork of the munici-\npality and the permanent\nstation closed.\n12\n\x0cSun Journal (3/2020)\nThe comrnittee of the harbour and the perrnanent\nc o n s u m e r reported in 2O2l.\n13\n\x0cSun Journal (3/2020)\nThe southern laboratory\nclosed.\n14"
    rows += [("scan", "Report", page), ("compound", "Report", "The long-\nterm forecast of the short-term\nstation and the long-term agreement, long-term."), ("code", "Report", "units GT80B and H2O tanks; rack l12O."), ("null", None, None), ("empty", "", ""), (None, "t", "x"), ("scan", "Report", page)]
    rows += [(f"y{i}", "Report", f"The committee reported in 20{i:02}. The agreement in 19{i:02} of the committee. The long-term forecast.") for i in range(30)]
    return rows


def test_scan_damage_and_repair(spark):
    df = spark.createDataFrame(scanned(), "id string, title string, word string").withColumn("n", F.lit(1))
    got = {(r["item_id"], r["damage"]) for r in scans.scan_damage(df, "id", "title", "word", heads=["Sun Journal"]).collect()}
    assert got == {("scan", "hyphenation"), ("scan", "furniture"), ("scan", "characters")}
    fixed = {r["item_id"]: r for r in scans.repair_scans(df, "id", "title", "word", heads=["Sun Journal"]).collect()}
    assert fixed["scan"]["repaired_text"] == "The regional framework of the municipality and the permanent station closed. The committee of the harbour and the permanent consumer reported in 2021. The southern laboratory closed."
    for key, _, text in scanned():
        if key not in ("scan", None):
            assert fixed[key]["repaired_text"] == text and not fixed[key]["damaged"]


def test_short_and_capital_words_are_repaired(spark):
    rows = scanned() + [(f"more{i}", "Report", f"This only came from the notes to the station, karena itu; we took H{i}20 of stock.") for i in range(120)]
    rows += [("odd", "Report", "Thi5 came FR0M THE N0TES T0 the station, karena ltu; on1y B4 blends of B41 blends, B35 blends and rack l7O."), ("head", "Report", "The regional committee\nof the station closed.\n\n12\n\x0cThi5 Journal 12\nThe southern laboratory\nclosed.\n\n13\n\x0cThi5 Journal 13\nThe harbour.")]
    df = spark.createDataFrame(rows, "id string, title string, text string")
    found = scans.scan_findings(df, "id", "title", "text", heads=["This Journal"])["characters"].collect()
    assert {(r["word"], r["right"]) for r in found if r["item_id"] == "odd"} == {("Thi5", "this"), ("FR0M", "from"), ("N0TES", "notes"), ("T0", "to"), ("ltu", "itu"), ("on1y", "only")}
    assert {(r["word"], r["right"]) for r in found if r["item_id"] == "head"} == {("Thi5", "this")}
    fixed = {r["item_id"]: r["repaired_text"] for r in scans.repair_scans(df, "id", "title", "text", heads=["This Journal"]).collect()}
    assert fixed["odd"] == "This came FROM THE NOTES TO the station, karena itu; only B4 blends of B41 blends, B35 blends and rack l7O."


def test_copies_of_a_misread_body_count_once(spark):
    rows = [(f"right{i}", "Report", f"The committee met {i} times.") for i in range(20)] + [(f"copy{i:03}", "Report", "The comrnittee met.") for i in range(300)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "id string, title string, text string").repartition(parts)
        found = scans.scan_findings(df, "id", "title", "text", heads=[])["characters"].collect()
        assert {(r["item_id"], r["word"], r["right"]) for r in found} == {(f"copy{i:03}", "comrnittee", "committee") for i in range(300)}


def test_scans_of_nothing(spark):
    df = spark.createDataFrame([], "id string, title string, text string")
    assert scans.scan_damage(df, "id", "title", "text", heads=[]).count() == 0
    assert scans.repair_scans(df, "id", "title", "text", heads=[]).count() == 0


def test_rare_and_common_misreadings_are_found_in_any_partitioning(spark):
    """A misreading in 1 % of the texts, one with five digits, and a running head wider than a hundred letters."""
    rows = [(f"r{i:03}", "Report", f"The government met {i} times and the organizations of the harbour closed.") for i in range(297)]
    rows += [(f"m{i}", "Report", f"The govemment met {i} hundred times and the 0rgan1zat10n5 of the harbour closed.") for i in range(3)]
    head = "Proceedings of the regional assembly of harbour keepers, station masters and permanent inspectors of the archipelago"
    rows.append(("wide", "Report", "\f".join(f"{head} {n}\nThe government of the harbour met many times in the permanent station of the regional assembly, where it\nclosed the harbour and the station and the archipelago for all the permanent inspectors.\n" for n in range(3))))
    seen = []
    for parts in (1, 8, 64):
        df = spark.createDataFrame(rows, "id string, title string, text string").repartition(parts)
        found = scans.scan_findings(df, "id", "title", "text", heads=[])
        seen.append({(r["item_id"], r["word"], r["right"]) for r in found["characters"].collect()})
        assert {r["item_id"] for r in found["furniture"].collect()} == {"wide"}
    assert seen[0] == seen[1] == seen[2] == {(f"m{i}", w, r) for i in range(3) for w, r in (("govemment", "government"), ("0rgan1zat10n5", "organizations"))}


def test_corrections():
    assert "from" in scans.corrections("frorn") and "dari" in scans.corrections("clari") and "yang" in scans.corrections("yan9") and "fr0m" not in scans.corrections("fr0m")
    assert scans.corrections("1234567") == set() and scans.corrections("") == set()


# languages


def language_rows(n: int = 90, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for code, sents in ALL.items():
        for i in range(n):
            rows.append((f"{code}{i}", code if i % 10 else rng.choice([c for c in ALL if c != code]), " ".join(rng.choice(sents) for _ in range(5))))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_language_model(spark.createDataFrame(language_rows(), "id string, language string, text string"), "id", "text", "language", per_language=200)


def test_wrong_labels_are_unlearned(model):
    score = langid.Scorer(model)
    for k, code in enumerate(langid.LANGUAGES):
        logp = score([w for s in ALL[code] for _, _, w in langid.sentences(s)])
        assert (logp.argmax(axis=1) == k).all()


def test_language_errors(spark, model):
    rows = [("ok", "EN-gb", " ".join(EN)), ("old", "in", " ".join(ID)), ("none", None, " ".join(NL)), ("und", "und", " ".join(FR)), ("wrong", "de", " ".join(EN)), ("mixed", "en", " ".join(EN[:3]) + "\n\n" + " ".join(FR[:3])), ("remark", "id", ID[0] + " " + ID[1][:-1] + "; the café at the quay closed. " + ID[2]), ("null", None, None), ("empty", None, ""), ("digits", None, "12 34. 56 78."), (None, None, " ".join(EN)), ("ok", "EN-gb", " ".join(EN)), ("bare", "id", " ".join(s.rstrip(".") for s in ID * 3))]
    df = spark.createDataFrame(rows, "id string, language string, text string").withColumn("text_language", F.lit("x"))
    got = {(r["item_id"], r["text_language"]) for r in langid.language_errors(df, "id", "text", "language", model).collect()}
    assert got == {("none", "nl"), ("und", "fr"), ("wrong", "en"), ("mixed", "en"), ("mixed", "fr")}
    seg = langid.label_segments(df, "id", "text", model)
    assert seg.filter("item_id = 'mixed'").count() == 2 and seg.agg(F.min("confidence")).first()[0] > 0.4
    labels = {r["item_id"]: r["text_language"] for r in langid.label_texts(seg).collect()}
    assert labels["ok"] == "en" and labels["bare"] == "id" and "null" not in labels
    assert langid.label_segments(df.limit(0), "id", "text", model).count() == 0


@pytest.mark.parametrize("name, code", [("Bahasa Indonesia", "id"), ("IND", "id"), ("in_ID", "id"), ("Dutch", "nl"), ("fr-CA", "fr"), ("und", None), ("", None), (None, None), ("  EN ", "en"), ("German", "de")])
def test_language_codes(name, code):
    assert langid.language_code(name) == code


# subjects


def topic_rows() -> tuple[list[dict], list[tuple]]:
    rng = random.Random(4)
    kinds = {"sun": ["solar roof", "inverter clip", "module dust"], "law": ["court ruling", "statute text", "judge bench"], "farm": ["rice mill", "seed dryer", "cassava peel"]}
    taxonomy = [{"slug": k, "label_en": k.title(), "label_id": k, "keywords": v[:1]} for k, v in kinds.items()]
    filler = ["the northern station was moved to the harbour after many days", "only some of the sites had a working meter", "the cost of the outage rose again in spring"]
    rows = []
    for i in range(900):
        about = rng.sample(sorted(kinds), 2 if i % 6 == 0 else 1)
        sents = [f"Interviews in Place{rng.randrange(400)} dealt with {a} and {b}." for t in about for a, b in [rng.sample(kinds[t], 2)]]
        aside = rng.choice([k for k in kinds if k not in about])
        if i % 2:
            sents.append(f"Matters such as {rng.choice(kinds[aside])} lie outside the scope.")
        sents += [f.capitalize() + f" {rng.randrange(99)}." for f in rng.sample(filler, 2)]
        rng.shuffle(sents)
        label = about[0] if rng.random() > 0.2 else rng.choice([*kinds, None])
        rows.append((f"a{i}", f"Notes {i}", " ".join(sents), f"s{i % 3}", "post", label, tuple(sorted(about))))
    return taxonomy, rows


def test_subjects_held_out(spark):
    taxonomy, rows = topic_rows()
    df = spark.createDataFrame([r[:6] for r in rows], "id string, title string, abstract string, source string, kind string, topic string")
    model = topics.fit_topics(df.filter("cast(substr(id, 2) as int) < 600"), "id", "title", "abstract", "source", "kind", "topic", taxonomy)
    got: dict = {}
    for r in topics.label_topics(df, "id", "title", "abstract", "source", "kind", model).collect():
        got.setdefault(r["item_id"], set()).add(r["topic_slug"])
    right = [got[r[0]] == set(r[6]) for r in rows[600:]]
    assert np.mean(right) > 0.95
    odd = spark.createDataFrame([("x", None, None, None, None), ("y", "", "", "s", "k"), (None, "t", "a", "s", "k"), ("z", "w " * 50_000, None, "s", "k"), ("x", None, None, None, None)], "id string, title string, abstract string, source string, kind string").withColumn("topic_slug", F.lit(1))
    labels = topics.label_topics(odd, "id", "title", "abstract", "source", "kind", model)
    assert {r["item_id"] for r in labels.collect()} == {"x", "y", "z"}
    assert topics.topic_composition(labels).agg(F.sum("documents")).first()[0] >= 3
    assert topics.label_topics(odd.limit(0), "id", "title", "abstract", "source", "kind", model).count() == 0


def test_co_occurrence_decides_what_words_leave_open():
    """"cooling plan" stands in texts on power and in texts on health; texts on power with it are on health too, those
    on farming with it aren't. A vote of words can't tell them apart; the chain can."""
    rng = random.Random(8)
    own = {"power": ["steam well", "wind farm", "relay room"], "farm": ["rice mill", "seed dryer", "manure pit"], "health": ["night clinic", "midwife course", "fever ward"]}
    taxonomy = [{"slug": k, "label_en": k.title(), "label_id": k, "keywords": v[:1]} for k, v in own.items()]

    def document(about: set[str], open_word: bool) -> dict:
        shown = sorted(about - {"health"}) if open_word else sorted(about)
        sents = [f"Interviews in Place{rng.randrange(4000)} dealt with {a} and {'cooling plan' if open_word else b}." for s in shown for a, b in [rng.sample(own[s], 2)]]
        return {"t": f"Notes {rng.randrange(999)}", "a": " ".join(sents), "s": f"s{rng.randrange(3)}", "d": "post", "l": rng.choice(sorted(about)) if rng.random() > 0.1 else rng.choice(sorted(own))}

    kinds = [({"power"}, False), ({"farm"}, False), ({"health"}, False), ({"power", "health"}, True), ({"farm"}, True)]
    model = topics.fit_documents([document(*kinds[i % 5]) for i in range(1500)], taxonomy)
    right = [0, 0]
    held = [(about, document(about, word)) for about, word in kinds[3:] for _ in range(60)]
    for about, d in held:
        rows = [model.index[g] for g in model.features(d["t"], d["a"], d["s"], d["d"]) if g in model.index]
        base = model.weights[[*rows, 0]].sum(axis=0)[None, :]
        chain = {model.topics[k] for k in np.flatnonzero(topics.beam_decode(base, model.links, model.factor)[0][0])}
        vote = {model.topics[model.topical[g[2:]]] for g in model.features(d["t"], d["a"], d["s"], d["d"]) if g.startswith("t:") and g[2:] in model.topical}
        right = [n + (s == about) for n, s in zip(right, (chain, vote))]
    assert right[0] >= 0.95 * len(held) and right[1] <= 0.6 * len(held)


def test_wrong_labels_are_not_learned_by_heart():
    taxonomy, rows = topic_rows()
    model = topics.fit_documents([{"t": r[1], "a": r[2], "s": r[3], "d": r[4], "l": r[5]} for r in rows if r[5]], taxonomy)
    assert 0.04 < model.noise < 0.35


def test_beam_finds_the_likeliest_set():
    rng = np.random.default_rng(2)
    base, links = rng.normal(0, 2, (40, 5)), np.triu(rng.normal(0, 1, (5, 5)), 1)
    best, marginal = topics.beam_decode(base, links, 1.0, width=32)
    sets = np.array([[(m >> i) & 1 for i in range(5)] for m in range(1, 32)], float)
    for row, got in zip(base, best):
        x = row + sets @ links
        score = (sets * -np.logaddexp(0, -x) + (1 - sets) * -np.logaddexp(0, x)).sum(axis=1)
        assert (sets[score.argmax()] == got).all()
    assert ((marginal >= 0) & (marginal <= 1)).all()


# packing and mixing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 150))
def test_packing_fits(sizes, capacity):
    part = packing.pack(sizes, capacity)
    sums = np.bincount(np.array(part, int), weights=np.array(sizes, float)) if sizes else np.zeros(1)
    assert len(part) == len(sizes) and sums.max() <= capacity
    assert len(sums) <= 2 * max(1, -(-sum(sizes) // capacity)) + 1


def test_differencing_example():
    part = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum(s for s, p in zip([8, 7, 6, 5, 4], part) if p == k) for k in (0, 1)) == [14, 16]


needs_vocabulary = pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no vocabulary here")


@needs_vocabulary
def test_sequences(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["solar"] * rng.randint(1, 90))) for i in range(300)] + [(900, "wind " * 500), (901, None), (902, ""), (None, "a b"), (5, "again")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("tokens", F.lit(0))
    got = packing.pack_sequences(df, "id", "text", capacity=128, shard_items=64)
    assert got.filter("sequence_id is null").select("item_id").distinct().count() == 2
    sums = got.filter("sequence_id is not null").groupBy("sequence_id").agg(F.sum("tokens").alias("n"))
    assert sums.agg(F.max("n")).first()[0] <= 128
    parts = got.groupBy("item_id", "part_index", "token_start").count()
    assert got.filter("item_id = 900").agg(F.sum("tokens"), F.count("*")).first()[:] == (count_tokens(df.filter("id = 900"), "id", "text").first()["tokens"], 4)
    assert parts.filter("item_id < 300 and part_index > 0").count() == 0
    report = packing.packing_report(got, 128).first()
    assert report["fill"] > 0.9 and report["tokens"] == count_tokens(df, "id", "text").agg(F.sum("tokens")).first()[0]
    assert packing.pack_sequences(df.limit(0), "id", "text", capacity=128).count() == 0


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["word"] * rng.randint(1, 40)), "big" if i % 3 else "mid") for i in range(3000)] + [(5000 + i, "word " * 20, "small") for i in range(20)] + [(9000, "x", None), (9001, None, "big"), (9002, "y", "other")]
    df = spark.createDataFrame(rows, "id int, text string, source string").withColumn("epoch", F.lit(7))
    targets = [{"source": "big", "target_share": 0.5, "max_repeats": 1}, {"source": "mid", "target_share": 0.3, "max_repeats": 1}, {"source": "small", "target_share": 0.2, "max_repeats": 4}, {"source": "gone", "target_share": 0.0, "max_repeats": 2}]
    collection, report = mixing.mix_sources(df, "id", "text", "source", targets, range_items=100)
    got = {r["source"]: r for r in report.collect()}
    for t in targets:
        assert got[t["source"]]["reached_share"] == pytest.approx(t["target_share"], abs=0.01)
    assert got["small"]["uses"] == 80 and collection.groupBy("item_id").count().agg(F.max("count")).first()[0] == 4
    assert collection.filter("item_id in (9000, 9001, 9002)").count() == 0
    more, wide = mixing.mix_sources(df, "id", "text", "source", targets, total_tokens=10_000)
    assert {r["source"]: r["uses"] for r in wide.collect()}["small"] == 80
    nothing, zero = mixing.mix_sources(df.limit(0), "id", "text", "source", targets)
    assert nothing.count() == 0 and zero.agg(F.sum("reached_tokens")).first()[0] == 0


# encodings

PLAIN = ["Le café du château près de Öresvik a coûté 5 € – voilà", "señor Íñigo paid £43 × 2 naïve façade", "the so‑called ‘flood year’ … returned to Grünhöhe", "«Тихая станция» и сеть северного района", "√(x²+y²) ≤ 4 and ¬p ∧ q", "SÃO CALVÃO, EDIÇÃO", "plain words only", "Thị trấn Đồi Mây"]


def test_garbled_texts_are_found_and_restored(spark):
    rows = [(i, t, f"s{i % 3}", None) for i, t in enumerate(PLAIN * 12)]
    bad = [t.encode().decode(page, errors="ignore") for t in (PLAIN[0], PLAIN[1]) for page in ("latin-1", "cp1252", "mac_roman", "cp437")] + [PLAIN[2].encode().decode("cp1251", errors="ignore"), PLAIN[1].encode().decode("latin-1").encode().decode("latin-1"), PLAIN[0][:20] + "�"]
    start = len(rows)
    rows += [(start + i, t, f"s{i % 3}", None) for i, t in enumerate(bad)]
    rows += [(9000, None, "s0", None), (9001, "", None, None), (None, bad[0], "s1", None), (start, bad[0], "s0", None)]
    df = spark.createDataFrame(rows, "id int, text string, source string, token string")
    found = {r["item_id"] for r in encoding.find_garbled(df, "id", "text", "source").collect()}
    assert found == set(range(start, start + len(bad)))
    fixed = {r["item_id"]: r for r in encoding.restore(df, "id", "text", "source").collect()}
    assert fixed[start]["restored_text"] == PLAIN[0] and fixed[start + 4]["restored_text"] == PLAIN[1] and fixed[start + 9]["restored_text"] == PLAIN[1]
    assert all(fixed[i]["restored_text"] == t and not fixed[i]["garbled"] for i, t in enumerate(PLAIN * 12))
    assert fixed[start + len(bad) - 1]["lost"] and fixed[9000]["restored_text"] is None
    assert encoding.find_garbled(df.limit(0), "id", "text", "source").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abé ñüß€…—Łø", max_size=30), st.sampled_from(["latin-1", "cp437", "mac_roman"]))
def test_undoing_a_misreading(text, page):
    assert encoding.undo_utf8(text.encode().decode(page), page) == text


GREEK = ["Η επιτροπή συζήτησε το νέο σχέδιο για την ενέργεια", "Το εργοστάσιο της πόλης έκλεισε μετά την καταιγίδα", "Οι κάτοικοι της πόλης ζήτησαν νέο σχέδιο ενέργειας"]
RUSSIAN = ["Комитет обсудил новый план развития города", "Станция закрылась после долгой зимней бури", "Жители города просили новый план развития станции"]


def test_pages_read_for_one_another_are_restored(spark):
    """Greek read in cp1251, Russian in cp437 and cp1250, and a text garbled in two ways."""
    clean = [(f"c{k}.{i}", t, f"s{i % 3}") for i in range(30) for k, t in enumerate([*GREEK, *RUSSIAN, *PLAIN])]
    bad, right = [], {}
    for n, (text, written, read) in enumerate([(GREEK[0], "cp1253", "cp1251"), (GREEK[1], "cp1253", "cp1251"), (RUSSIAN[0], "cp1251", "cp437"), (RUSSIAN[1], "cp1251", "cp437"), (RUSSIAN[2], "cp1251", "cp1250")]):
        bad.append((f"b{n}", text.encode(written).decode(read), f"s{n % 3}"))
        right[f"b{n}"] = text
    bad.append(("two", GREEK[2].encode("cp1253").decode("cp1251") + "\n" + PLAIN[1].encode().decode("mac_roman"), "s1"))
    right["two"] = GREEK[2] + "\n" + PLAIN[1]
    df = spark.createDataFrame(clean + bad, "id string, text string, source string")
    fixed = {r["item_id"]: r for r in encoding.restore(df, "id", "text", "source").collect()}
    assert {i for i, r in fixed.items() if r["garbled"]} == set(right)
    assert {i: fixed[i]["restored_text"] for i in right} == right


def test_garbled_texts_held_out(spark):
    """Recall and precision on texts garbled at random in one of many ways."""
    rng = random.Random(12)
    words = sorted({w for t in PLAIN for w in t.split()})
    rows, bad = [], set()
    for i in range(600):
        text = " ".join(rng.choices(words, k=12))
        if rng.random() < 0.15 and not text.isascii():
            new = text.encode().decode(rng.choice(["cp1252", "latin-1", "mac_roman", "cp437", "cp1250"]), errors="ignore")
            if new != text:
                text = new
                bad.add(f"d{i}")
        rows.append((f"d{i}", text, f"s{i % 4}"))
    found = {r["item_id"] for r in encoding.find_garbled(spark.createDataFrame(rows, "id string, text string, source string"), "id", "text", "source").collect()}
    assert len(found & bad) >= 0.98 * len(bad) and len(found & bad) >= 0.98 * len(found)


def test_garbled_text_in_references(spark):
    garbled = "".join(c if c.isascii() else f"&#{ord(c)};" for c in PLAIN[0].encode().decode("cp1252", errors="ignore"))
    rows = [(i, t, "s") for i, t in enumerate(PLAIN * 20)] + [(900, garbled, "s"), (901, "caf&#233; of the ch&#xE2;teau &#38; more", "s")]
    fixed = {r["item_id"]: r for r in encoding.restore(spark.createDataFrame(rows, "id int, text string, source string"), "id", "text", "source").collect()}
    assert {i for i, r in fixed.items() if r["garbled"]} == {900} and fixed[901]["restored_text"] == rows[-1][1]
    assert fixed[900]["restored_text"] == PLAIN[0]


def test_languages_held_out(spark, model):
    """Recall and precision of errors on bodies that the model hasn't seen, a third of them in two languages."""
    rng = random.Random(31)
    rows, want = [], set()
    for i in range(240):
        a, b = rng.sample(sorted(ALL), 2)
        mixed = i % 3 == 0
        text = " ".join(rng.sample(ALL[a], 3)) + ("\n\n" + " ".join(rng.sample(ALL[b], 3)) if mixed else "")
        label = rng.choice([a, None, b])
        rows.append((f"t{i}", label, text))
        if mixed or label != a:
            want |= {(f"t{i}", a)} | ({(f"t{i}", b)} if mixed else set())
    df = spark.createDataFrame(rows, "id string, language string, text string")
    got = {(r["item_id"], r["text_language"]) for r in langid.language_errors(df, "id", "text", "language", model).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
