"""Pieces, near duplicates and names: against brute force, and in the cases that data really has."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbung.llm import names, neardup, pieces

VOCABULARY = [f"w{i}" for i in range(800)]


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# pieces


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab .\ń", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text_within_the_limit(text, most, overlap):
    spans = pieces.split_spans(text, most, overlap)
    assert (spans == []) == (text == "")
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= most for a, b in spans)
        assert all(x[1] - y[0] == overlap for x, y in zip(spans, spans[1:]))


def test_pieces_prefer_paragraphs_then_sentences():
    text = "A" * 30 + ". " + "B" * 20 + "\n\n" + "C" * 40
    assert pieces.split_spans(text, 60, 5)[0] == (0, 54)
    assert pieces.split_spans("x" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)]


def test_pieces_in_words():
    text = "one two three four five six seven"
    spans = pieces.split_spans(text, 3, 1, "words")
    assert [len(text[a:b].split()) for a, b in spans] == [3, 3, 3]


def test_pieces_reject_an_overlap_that_never_ends():
    with pytest.raises(ValueError):
        pieces.split_spans("abc", 5, 5)


def test_pieces_of_a_table(spark):
    rows = [("a", "x" * 50, 1), ("b", None, 2), ("c", "", 3), (None, "y" * 20, 4), ("a", "x" * 50, 1), ("d", "z " * 30_000, 5)]
    df = spark.createDataFrame(rows, "id string, text string, chunk_count int")
    got = {r["item_id"]: r["chunk_count"] for r in pieces.count_pieces(df, "id", "text", max_size=20, overlap=5).collect()}
    assert got["a"] == 3 and got["b"] == 0 and got["c"] == 0 and got[None] == 1 and got["d"] > 3000
    full = pieces.split_pieces(df, "id", "text", max_size=20, overlap=5)
    assert full.filter("item_id = 'd'").agg(F.max("piece_size")).first()[0] <= 20
    assert pieces.split_pieces(df.limit(0), "id", "text", max_size=20, overlap=5).count() == 0


# near duplicates


def shingles(text: str) -> set:
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], w[2:]))


def test_covering_masks_cover():
    for radius in (1, 2, 3):
        masks = neardup.covering_masks(radius)
        width = (1 << (radius + 1)) - 1
        rng = random.Random(radius)
        for _ in range(300):
            differing = set(rng.sample(range(width), radius))
            assert any(not differing & set(m) for m in masks)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = text_of(rng, 120).split()
        for k in (0, 4, 14, 30):
            new = list(base)
            for _ in range(k):
                new[rng.randrange(len(new))] = rng.choice(VOCABULARY)
            texts.append(" ".join(new))
    rows = [(f"d{i:03}", t, None, "x") for i, t in enumerate(texts)] + [("d000", texts[0], None, "x"), (None, texts[1], None, "x"), ("short", "a b c", None, "x"), ("none", None, None, None), ("copy", texts[4].upper(), "", "y")]
    df = spark.createDataFrame(rows, "id string, title string, abstract string, keys string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", ["title", "abstract"]).collect()}
    known = {r[0]: shingles(r[1]) for r in rows if r[0] and r[1] and len(r[1].split()) >= 40}
    ids = sorted(known)
    true = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(known[a] & known[b]) / len(known[a] | known[b]) >= 0.6}
    assert got == true and ("copy", "d004") in got


def test_near_duplicate_groups_count_links_not_copies(spark):
    rng = random.Random(9)
    base = text_of(rng, 100).split()
    near = base[:95] + ["zz"] * 5
    rows = [("a", " ".join(base)), ("b", " ".join(base)), ("c", " ".join(base)), ("d", " ".join(near)), ("e", text_of(rng, 100))]
    got = {r["item_id"]: r for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "id string, text string"), "id", ["text"]).collect()}
    assert {got[k]["group_id"] for k in "abcd"} == {"a"} and got["e"]["group_id"] == "e"
    assert got["b"]["class_id"] == "a" and got["b"]["links"] == 1 and got["e"]["links"] == 0


def test_hot_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 8)
    rng = random.Random(2)
    base = text_of(rng, 200).split()
    rows = []
    for i in range(60):
        new = list(base)
        new[rng.randrange(200)] = f"u{i}"
        rows.append((f"i{i:02}", " ".join(new)))
    got = neardup.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), "id", ["text"])
    assert got.count() == 60 * 59 // 2


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert neardup.near_duplicate_pairs(df, "id", ["text"]).count() == 0
    assert neardup.near_duplicate_groups(df, "id", ["text"]).count() == 0


# names


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9), st.integers(1, 3))
def test_banded_distance_is_the_distance(a, b, most):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert names.edit_distance(a, b, most) == min(d[-1][-1], most + 1)


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(250)})
    got = {(r["key_a"], r["key_b"]) for r in names.segment_join(spark.createDataFrame([(k,) for k in [*keys, None, "", "a"]], "key string"), edits=1).collect()}
    assert got == {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if names.edit_distance(a, b, 1) <= 1}


VARIANTS = {
    "laksmi": ["Laksmi Umar Nurpobenma", "Nurpobenma, L. U.", "L. U. Nurpobenma", "NURPOBENMA Laksmi Umar", "laksmi umar nurpobenma", "Dr. Laksmi U. Nurpobenma", "Laksmi Umar Nufpobenma", "Laksmi  Nurpobenma", "L.U. Nurpobenma"],
    "jose": ["José Kanjirtemo", "Pepe Kanjirtemo", "Jose Kanjirtemo", "José Kanjirtemo, Ph.D", "Kanjirtemo J", "José Kanjirtemo M.Eng"],
    "robert": ["Robert Wonetarse", "Bob Wonetarse", "Wonetarse, Rob"],
    "thermal": ["Institute for Thermal Power Kersomisu", "INSTITUTE FOR THERMAL POWER KERSOMISU", "Kersomisu Institute for Thermal Power", "Thermal Power Institute, Kersomisu", "Inst. for Thermal Power Kersomisu", "Institute for Thermla Power Kersomisu", "Institute for Thermal Power Kersomisu (resmi)"],
    "tidal": ["Institute for Tidal Power Kersomisu", "Tidal Power Institute, Kersomisu"],
    "hukum": ["Lembaga Hukum Tambang Jarjisinda", "LHT Jarjisinda", "Lemb. Hukum Tambang Jarjisinda", "Lembaga Hukum Tambang Jarjisinda (LHT)"],
    "zainal": ["Zainal Nurpobenma", "Nurpobenma Z"],
}


def test_variants_meet_and_others_stay_apart(spark):
    rows = [(n, [n]) for group in VARIANTS.values() for n in group] + [("", [None, ""]), (None, None), ("  ", ["--"])]
    df = spark.createDataFrame(rows, "publisher string, authors array<string>")
    got = {r["name"]: r["entity"] for r in names.resolve_names(names.occurrences(df, ["authors", "publisher"])).collect()}
    assert "" not in got and None not in got and "  " not in got and "--" not in got
    by = {k: {got[n] for n in v} for k, v in VARIANTS.items()}
    assert {k: len(v) for k, v in by.items()} == dict.fromkeys(VARIANTS, 1)
    assert len(set.union(*by.values())) == len(VARIANTS)


def test_an_initial_that_fits_two_people_stays_alone(spark):
    rows = [("Laksmi Tasewirgi",), ("Leonardus Tasewirgi",), ("L. Tasewirgi",), ("Tasewirgi L",), ("Laksmi Tasewirgi",)]
    got = {r["name"]: r["entity"] for r in names.resolve_names(spark.createDataFrame(rows, "name string")).collect()}
    assert got["L. Tasewirgi"] == got["Tasewirgi L"] and len(set(got.values())) == 3
    assert names.variant_pairs(names.resolve_names(spark.createDataFrame([], "name string"))).count() == 0


def test_misspelt_family_name_in_many_forms(spark):
    right = [f for x in ("Stephanie", "Robert", "Michael") for f in (f"{x} Yarobonha", f"Yarobonha, {x}", f"{x} {x[0]}. Yarobonha", f"Yarobonha, {x} {x[0]}.")]
    wrong = ["Stephanie Yarobohna", "Yarobohna, Stephanie", "Stephanie S. Yarobohna"]
    got = {r["name"]: r["entity"] for r in names.resolve_names(spark.createDataFrame([(r,) for r in right + wrong], "name string")).collect()}
    assert {got[w] for w in wrong} == {got["Stephanie Yarobonha"]}


def entities(spark, strings: list[str]) -> dict[str, str]:
    return {r["name"]: r["entity"] for r in names.resolve_names(spark.createDataFrame([(r,) for r in strings], "name string")).collect()}


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_misspelling_in_ten_forms(spark, parts):
    given = ["Ratna", "Budi", "Clara", "Dewi", "Erik", "Farah", "Gita", "Hadi", "Indah", "Joko"]
    right = [f for x in given for f in (f"{x} Wijayakusuma", f"Wijayakusuma, {x}", f"Dr. {x} Wijayakusuma")]
    wrong = [f"{x} Wijayakusumo" for x in given]
    df = spark.createDataFrame([(r,) for r in right + wrong], "name string").repartition(parts)
    got = {r["name"]: r["entity"] for r in names.resolve_names(df).collect()}
    assert all(got[f"{x} Wijayakusumo"] == got[f"{x} Wijayakusuma"] for x in given) and len(set(got.values())) == len(given)


def test_misspelling_in_three_forms_and_an_initial(spark):
    right = ["Ratna Wijayakusuma", "Wijayakusuma, Ratna", "Dr. Ratna Wijayakusuma", "Ratna Wijayakusuma, PhD", "WIJAYAKUSUMA Ratna", "ratna wijayakusuma"]
    wrong = ["Ratna Wijayakusumo", "Wijayakusumo, Ratna", "Dr. Ratna Wijayakusumo", "R. Wijayakusumo"]
    got = entities(spark, right + wrong)
    assert len(set(got.values())) == 1


def test_two_edits_in_a_long_name(spark):
    got = entities(spark, ["Ratna Wijayakusuma", "Wijayakusuma, Ratna", "Ratna Wijayekusumo"])
    assert len(set(got.values())) == 1


def test_people_of_five_names_are_people(spark):
    for name in ("Ahmad Budi Citra Dewi Eko", "Maria del Carmen Lopez Garcia Ruiz"):
        assert names.parse_name(name)[0] == "person"
    assert names.parse_name("Group for Study of Tides")[0] == "org"


def test_short_forms_are_learned_from_families(spark):
    rows = [f"{g} {f}" for f in ("Jongono", "Pertiwi", "Kusnadi") for g in ("Valentina", "Val")] + [f"Zoe {f}" for f in ("Abar", "Beno", "Cira", "Jongono")] + ["Zoeh Jongono"]
    got = entities(spark, rows)
    assert all(got[f"Val {f}"] == got[f"Valentina {f}"] for f in ("Jongono", "Pertiwi", "Kusnadi")) and got["Zoe Abar"] != got["Zoe Beno"]


def test_short_strings_have_all_their_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("ab", k=rng.randrange(1, 5))) for _ in range(60)}
    for edits in (1, 2):
        got = {(r["key_a"], r["key_b"]) for r in names.segment_join(spark.createDataFrame([(w,) for w in words], "key string"), edits=edits).collect()}
        assert got == {(a, b) for a in words for b in words if a < b and names.edit_distance(a, b, edits) <= edits}


def test_names_held_out(spark):
    """Recall and precision of pairs on people written at random in many ways, with misspellings."""
    rng = random.Random(21)
    syllables = ["wi", "jo", "kar", "tan", "sul", "mer", "bon", "ra", "di", "ken", "pur", "no"]
    families = sorted({"".join(rng.choices(syllables, k=4)) for _ in range(60)})
    given = ["Ratna", "Budiman", "Clarissa", "Dewanto", "Erikson", "Farida", "Gunawan", "Hadiyanto"]
    truth: dict[str, int] = {}
    for n, family in enumerate(families):
        for k, name in enumerate(rng.sample(given, 2)):
            who, f = n * 10 + k, family.capitalize()
            wrong = list(family)
            at = rng.randrange(2, len(wrong) - 2)
            wrong[at], wrong[at + 1] = wrong[at + 1], wrong[at]
            forms = [f"{name} {f}", f"{f}, {name}", f"Dr. {name} {f}", f"{f.upper()} {name}", f"{name} {f}, PhD", f"{name} {''.join(wrong).capitalize()}"]
            truth |= {s: who for s in rng.sample(forms[:-1], 4) + forms[-1:]}
    got = entities(spark, list(truth))
    names_ = sorted(truth)
    want = {(a, b) for i, a in enumerate(names_) for b in names_[i + 1 :] if truth[a] == truth[b]}
    found = {(a, b) for i, a in enumerate(names_) for b in names_[i + 1 :] if got[a] == got[b]}
    assert len(want & found) >= 0.97 * len(want) and len(want & found) >= 0.99 * len(found)
