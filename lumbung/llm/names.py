"""Variant spellings of the names of people and organisations, linked to entities.

1. Distinct strings are parsed on their own: titles, degrees and remarks go; family name, given name and initials, or the
   bag of an organisation's words, stay.
2. Misspelt family names, given names and organisation names are found by a segment join: each name is cut into k+1
   segments, an inverted index of the segments is probed with position-shifted substrings, and what meets is verified by
   banded edit distance. Two names within k edits share an unedited segment, so the join misses none.
3. Initials, nicknames and acronyms are resolved by joins to the full names of the same family name or place; a form
   that fits several entities stays by itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.operators.pairs import pairs_within, spread
from lumbung.session import cut

# Titles, degrees and remarks that are no part of a name.
TITLES = frozenset("dr dra drs prof ir mr mrs ms h hj kh rd".split())
DEGREES = frozenset("phd msc ma ba bsc mba md meng beng st mt se sh mh ssi msi skom mkom spd mpd mphil llm jr sr".split())
REMARKS = frozenset("resmi official".split())

# Words that mark an organisation, with the spellings they are brought to.
ORG_WORDS = {
    "institute": "institute", "inst": "institute", "institut": "institute",
    "centre": "centre", "center": "centre", "ctr": "centre",
    "foundation": "foundation", "fdn": "foundation", "found": "foundation",
    "society": "society", "soc": "society",
    "university": "university", "univ": "university",
    "association": "association", "assoc": "association",
    "department": "department", "dept": "department",
    "council": "council", "agency": "agency", "ministry": "ministry", "company": "company", "press": "press",
    "yayasan": "yayasan", "yay": "yayasan",
    "lembaga": "lembaga", "lemb": "lembaga", "lbg": "lembaga",
    "badan": "badan", "bdn": "badan",
    "pusat": "pusat", "pus": "pusat",
    "kementerian": "kementerian", "universitas": "universitas", "perhimpunan": "perhimpunan", "balai": "balai", "dinas": "dinas",
}
ORG_PHRASES = {"pusjian": ("pusat", "kajian"), "br": ("badan", "riset"), "pk": ("pusat", "kajian")}
LINK_WORDS = frozenset("for of the and dan untuk dari on in di van voor de des du la le et".split())
# Those of them that no person's name has.
ORG_LINKS = frozenset("for of the and dan untuk dari on".split())

# Pet forms of given names that are neither their beginning nor their end (those are found by a rule).
NICKNAMES = {
    "sandy": "alexander", "sasha": "alexander", "tony": "anthony", "ton": "anthony", "benny": "benjamin", "benji": "benjamin", "kit": "christopher",
    "liz": "elizabeth", "lizzy": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "ella": "elizabeth", "frits": "frederik",
    "freek": "frederik", "goris": "gregorius", "baim": "ibrahim", "jim": "james", "jimmy": "james", "jamie": "james", "hans": "johannes",
    "jan": "johannes", "yohanes": "johannes", "joe": "joseph", "joey": "joseph", "pepe": "jose", "pepito": "jose", "juergen": "jurgen",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "cathy": "katherine", "kitty": "katherine", "maggie": "margaret",
    "meg": "margaret", "peggy": "margaret", "marge": "margaret", "greta": "margaret", "mike": "michael", "mick": "michael", "mickey": "michael",
    "moh": "muhammad", "mochamad": "muhammad", "mohammad": "muhammad", "mohamad": "muhammad", "muhamad": "muhammad", "mohammed": "muhammad",
    "mohamed": "muhammad", "mhd": "muhammad", "md": "muhammad", "mamat": "muhammad", "nick": "nicolaas", "klaas": "nicolaas", "niek": "nicolaas",
    "claas": "nicolaas", "patty": "patricia", "trish": "patricia", "rick": "richard", "dick": "richard", "richie": "richard", "bob": "robert",
    "bobby": "robert", "robbie": "robert", "sammy": "samantha", "steffi": "stephanie", "fanny": "stephanie", "sue": "susanna", "susie": "susanna",
    "sanne": "susanna", "suzy": "susanna", "ted": "theodore", "teddy": "theodore", "tinka": "valentina", "bill": "william", "billy": "william",
    "wim": "william", "willy": "william", "willa": "wilhelmina", "minna": "wilhelmina", "helma": "wilhelmina", "ucup": "yusuf", "yusup": "yusuf",
    "evonne": "yvonne", "lusia": "lucja", "lucia": "lucja",
}

_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "’": "'", "‘": "'"})
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


#: A misspelling is outnumbered by its right spelling at this ratio; with one form or use each, order decides.
MISSPELT_RATIO = 2
#: Two edits are allowed from this length on.
LONG = 12


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().translate(_PLAIN)) if not unicodedata.combining(c))


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two strings, or ``most`` + 1; only a band is filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before[j - 2] + 1)
            new[j] = v
        if min(new[max(0, lo - 1) : hi + 1]) > most:
            return far
        before, row = row, new
    return min(row[len(b)], far)


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k+1 segments of nearly the same length; the longer ones last."""
    base, extra = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = base + (i > k - extra)
        out.append((at, n))
        at += n
    return out


def _index(batches: Iterator[pd.DataFrame], k: int, swaps: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(f"{len(s)}.{i}.{s[a : a + n]}", s) for s in batch["key"] for i, (a, n) in enumerate(segments(len(s), k))]
        out += [(f"=.{s}", s) for s in batch["key"]] if swaps else []
        yield pd.DataFrame(out, columns=["probe", "indexed"])


def _probe(batches: Iterator[pd.DataFrame], k: int, swaps: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = set()
        for r in batch["key"]:
            for length in range(max(1, len(r) - k), len(r) + 1):
                longer = len(r) - length
                for i, (a, n) in enumerate(segments(length, k)):
                    # at most i edits lie before segment i and k - i after it, for the first segment that is unedited
                    for at in range(max(0, a - i, a + longer - (k - i)), min(len(r) - n, a + i, a + longer + (k - i)) + 1):
                        out.add((f"{length}.{i}.{r[at : at + n]}", r))
            if swaps:
                out |= {(f"=.{r[:j]}{r[j + 1]}{r[j]}{r[j + 2:]}", r) for j in range(len(r) - 1) if r[j] != r[j + 1]}
        yield pd.DataFrame(list(out), columns=["probe", "probing"])


def _shortened(batches: Iterator[pd.DataFrame], edits: int) -> Iterator[pd.DataFrame]:
    """Each string with up to ``edits`` letters left out: two strings within so many edits have one of these in common."""
    for batch in batches:
        out = []
        for s in batch["key"]:
            level = {s}
            everything = set(level)
            for _ in range(edits):
                level = {x[:j] + x[j + 1 :] for x in level for j in range(len(x))}
                everything |= level
            out += [(x, s) for x in everything]
        yield pd.DataFrame(out, columns=["probe", "s"])


def _verify(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        d = [edit_distance(a, b, most) for a, b in zip(batch["key_a"], batch["key_b"])]
        yield batch.assign(distance=d).query(f"distance <= {most}")


def segment_join(keys: DataFrame, key: str = "key", *, edits: int = 1) -> DataFrame:
    """(key_a < key_b, distance) of all pairs of different strings within ``edits`` edits (a swap of neighbours is one).

    With one edit, strings are cut in two, and swaps are looked up as whole strings. With more, a swap can touch two
    segments, so strings are cut for two single edits per allowed edit. Strings too short to be cut so meet in the
    strings that are left when letters are taken out of them. Null and empty strings have no pair.
    """
    k, swaps = (1, True) if edits == 1 else (2 * edits, False)
    distinct = keys.select(F.col(key).alias("key")).filter(F.length("key") > 0).distinct()
    short = spread(distinct.filter(F.length("key") <= k + edits)).mapInPandas(lambda it: _shortened(it, edits), "probe string, s string")
    distinct = spread(distinct.filter(F.length("key") > k))
    index = distinct.mapInPandas(lambda it: _index(it, k, swaps), "probe string, indexed string")
    probe = distinct.mapInPandas(lambda it: _probe(it, k, swaps), "probe string, probing string")
    met = probe.join(index, "probe").filter("probing <> indexed").select(F.least("probing", "indexed").alias("key_a"), F.greatest("probing", "indexed").alias("key_b"))
    few = short.join(short.withColumnRenamed("s", "z"), "probe").filter("s < z").select(F.col("s").alias("key_a"), F.col("z").alias("key_b"))
    return met.unionByName(few).distinct().mapInPandas(lambda it: _verify(it, edits), "key_a string, key_b string, distance int")


def near_spellings(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key_a, key_b), both ways: strings one edit apart, or two where both have LONG letters."""
    near = segment_join(keys, key, edits=1).select("key_a", "key_b")
    long = segment_join(keys.filter(F.length(key) >= LONG), key, edits=2).select("key_a", "key_b")
    near = cut(near.unionByName(long).distinct(), "near")
    return near.unionByName(near.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))


def outnumbers(right: str, wrong: str) -> Column:
    """Whether one spelling (a struct of n, the forms, uses and the spelling) is the better attested one by
    MISSPELT_RATIO; the same at every size."""
    n = F.col(f"{right}.n") >= MISSPELT_RATIO * F.col(f"{wrong}.n") - (MISSPELT_RATIO - 1)
    return (F.col(right) > F.col(wrong)) & n


def _degree(word: str) -> bool:
    return fold(word.replace(".", "")) in DEGREES


def parse_name(name: str) -> tuple[str, str, str, str, str, str, str]:
    """(kind, family, first, middle, squeezed, bag, acronym) of a name; kind is person, org or none.

    For a person, ``first`` is the given name or its initial, ``middle`` the initial of a further given name or empty,
    and ``acronym`` is set where the string could also be an organisation's acronym with a place (``first`` the
    acronym's letters, see resolve). For an organisation, ``squeezed`` is the name without blanks, ``bag`` its sorted
    words, ``first`` the acronym of its words in the order written and ``family`` its possible places.
    """
    inside = [fold(m) for m in re.findall(r"\(([^()]*)\)", name)]
    plain = re.sub(r"\([^()]*\)", " ", name)
    # titles stand at the start; degrees after a comma or at the end, but only behind a whole name: "Family, J.R." has initials
    parts = [re.findall(r"[^\s,]+", p) for p in plain.split(",")]
    parts = [p for p in parts if any(c.isalnum() for t in p for c in t)]
    while len(parts) > 1 and len(parts[0]) > 1 and all(_degree(t) for t in parts[-1]):
        parts.pop()
    while parts and len(parts[-1]) > 2 and _degree(parts[-1][-1]) and len(parts[-1][-1]) > 2:
        parts[-1].pop()
    parts = [[t for w in p for t in _TOKEN.findall(w)] for p in parts]
    if parts and len(parts[0]) > 1:
        while len(parts[0]) > 1 and fold(parts[0][0]) in TITLES and (len(parts[0][0]) > 1 or len(parts[0]) > 3):
            parts[0].pop(0)
    tokens = [t for p in parts for t in p]
    if not tokens:
        return ("none", "", "", "", "", "", "")
    low = [fold(t) for t in tokens]
    words: list[str] = []
    for t in low:
        words += ORG_PHRASES.get(t, (ORG_WORDS.get(t, t),))
    marked = any(t in ORG_WORDS or (t in ORG_PHRASES and len(low) > 2) for t in low) or any(x in REMARKS for x in inside)
    near = len(low) >= 3 and any(len(t) > 5 and any(len(w) > 5 and edit_distance(t, w, 1) <= 1 for w in ORG_WORDS) for t in low)
    if marked or near or len(low) > 2 and any(t in ORG_LINKS for t in low):
        bag = sorted(w for w in words if w not in LINK_WORDS)
        stated = next((x for x in inside if re.fullmatch(r"[a-z]{2,6}", x) and x not in REMARKS), "")
        return ("org", " ".join(bag), "".join(w[0] for w in words if w not in LINK_WORDS), "", "".join(words), " ".join(bag), stated)
    caps = [t.isupper() and len(t) > 1 for t in tokens]
    if len(parts) > 1:
        family, given = "".join(fold(t) for t in parts[0]), [fold(t) for p in parts[1:] for t in p]
    elif len(low) == 1:
        family, given = low[0], []
    elif caps[0] and not all(caps) and not any(caps[1:]):
        family, given = low[0], low[1:]
    elif len(low[0]) > 1 and all(len(t) == 1 for t in low[1:]):
        family, given = low[0], low[1:]
    else:
        family, given = low[-1], low[:-1]
    first = given[0] if given else ""
    if len(given) == 1 and len(first) == 2 and caps[-1] and first not in NICKNAMES:  # "Family AB"
        given = list(first)
        first = given[0]
    middle = given[1][0] if len(given) > 1 else ""
    acronym = low[0] if len(tokens) == 2 and tokens[0].isupper() and 2 <= len(tokens[0]) <= 6 else ""
    return ("person", family, first, middle, "".join(low), low[-1] if acronym else "", acronym)


_PARSED = "name string, uses bigint, kind string, family string, first string, middle string, squeezed string, bag string, acronym string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _PARSED.split(", ")]
    for batch in batches:
        yield pd.DataFrame([(n, u, *parse_name(n)) for n, u in zip(batch["name"], batch["uses"])], columns=columns)


def _one(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows of ``by`` with exactly one distinct ``value``."""
    return df.groupBy(*by).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")


def _misspelt(forms: DataFrame, key: str, least_ratio: int) -> DataFrame:
    """(key, right): misspelt spellings of ``key`` and the better attested one near it, see near_spellings.

    ``forms`` has the columns ``key``, shape and uses. The neighbour must outnumber the spelling, and occur in at least
    ``least_ratio`` times as many shapes; equals go by use, then by order, so that no two spellings each stand for the
    other. In a name of one or two letters an edit leaves nothing to tell it by: it is no misspelling.
    """
    support = forms.filter(F.length(key) > 2).groupBy(F.col(key).alias("key")).agg(F.struct(F.count_distinct("shape").alias("n"), F.sum("uses").alias("uses"), F.first(key).alias("k")).alias("w"))
    support = cut(support, "support")
    both = near_spellings(support)
    both = both.join(support.select(F.col("key").alias("key_a"), F.col("w").alias("wa")), "key_a").join(support.select(F.col("key").alias("key_b"), F.col("w").alias("wb")), "key_b")
    both = both.filter((F.col("wb.n") >= F.col("wa.n") * least_ratio) & outnumbers("wb", "wa"))
    best = cut(both.groupBy(F.col("key_a").alias("key")).agg(F.max_by("key_b", "wb").alias("right")), "best")
    # a neighbour may itself be misspelt: one hop on, along the strict order
    on = best.select(F.col("key").alias("right"), F.col("right").alias("on"))
    return best.join(on, "right", "left").select("key", F.coalesce("on", "right").alias("right"))


def short_forms(known: DataFrame) -> DataFrame:
    """(first, meant): given names that are the beginning or the end of another one and occur, in half of the families
    that have them, together with it. ``known``: distinct (family, first)."""
    cuts = known.filter(F.length("first") > 3).select("family", F.col("first").alias("meant"), F.explode(F.expr("flatten(transform(sequence(2, length(first) - 1), i -> array(substring(first, 1, i), substring(first, i))))")).alias("first")).filter(F.length("first").between(2, F.length("meant") - 1)).distinct()
    together = cuts.join(known, ["family", "first"]).groupBy("first", "meant").agg(F.count("*").alias("n"))
    often = together.join(known.groupBy("first").agg(F.count("*").alias("all")), "first").filter("2 * n >= all")
    return often.groupBy("first").agg(F.max_by("meant", F.struct("n", "meant")).alias("meant"))


def resolve_names(names: DataFrame, *, name_col: str = "name") -> DataFrame:
    """(name, entity) of each distinct non-blank string: strings of one entity share its key.

    Strings count exactly as stored. Null strings, and strings without a letter or digit, name no one and are left out;
    repeated rows count once; an empty table gives an empty one; other columns are ignored. A form that fits several
    entities (an initial, a nickname, an acronym) is an entity of its own, shared only with equal forms.
    """
    distinct = names.select(F.col(name_col).alias("name")).filter("name is not null").groupBy("name").agg(F.count("*").alias("uses"))
    parsed = cut(distinct.mapInPandas(_parse, _PARSED).filter("kind <> 'none'"), "names")

    # organisations: the bag of words, then misspelt spellings by the segment join, then acronyms
    orgs = parsed.filter("kind = 'org'")
    support = orgs.groupBy("bag").agg(F.struct(F.count("*").alias("n"), F.sum("uses").alias("uses"), F.first("bag").alias("b")).alias("w"))
    spelt = cut(orgs.select("squeezed", "bag").distinct().join(support, "bag"), "spelt")
    near = near_spellings(spelt, "squeezed")
    same = spelt.select(F.col("squeezed").alias("key_a"), F.col("squeezed").alias("key_b")).distinct()  # blanks misplaced
    near = near.unionByName(same)
    near = near.join(spelt.select(F.col("squeezed").alias("key_a"), F.col("bag").alias("bag_a"), F.col("w").alias("wa")), "key_a").join(spelt.select(F.col("squeezed").alias("key_b"), F.col("bag").alias("bag_b"), F.col("w").alias("wb")), "key_b")
    right = near.filter((F.col("bag_a") != F.col("bag_b")) & outnumbers("wb", "wa")).groupBy(F.col("bag_a").alias("bag")).agg(F.max_by("bag_b", "wb").alias("right"))
    named = cut(orgs.join(right, "bag", "left").select("name", F.coalesce("right", "bag").alias("bag"), F.when(F.col("right").isNull(), F.col("first")).alias("letters"), "acronym"), "orgs")
    # an acronym stands for the words in the order written, less the place, which is the first or the last of them
    places = named.filter("letters is not null").select("bag", F.explode(F.split("bag", " ")).alias("place"), "letters", "acronym").withColumn("tail", F.expr("substring(letters, 1, length(letters) - 1)")).withColumn("stated", F.when(F.col("acronym") != "", F.col("acronym")))
    places = places.select("bag", "place", F.explode(F.array_compact(F.array("tail", "stated"))).alias("acronym")).distinct()
    short = parsed.filter("kind = 'person' and acronym <> ''").select("name", F.col("bag").alias("place"), "acronym")
    # the words of a bag that occur with the acronym as a place: only the rarest word is the place, so both must match
    acronyms = _one(short.join(places, ["place", "acronym"]).select("name", "bag"), ["name"], "bag")
    org_names = named.select("name", F.concat(F.lit("o:"), "bag").alias("entity")).unionByName(acronyms.select("name", F.concat(F.lit("o:"), "bag").alias("entity")))

    # people: misspelt family names, then given names
    people = parsed.filter("kind = 'person'").join(acronyms.select("name"), "name", "left_anti").select("name", "uses", "family", "first", "middle").withColumn("shape", F.when(F.length("first") > 1, F.col("name")))  # initials don't speak for a spelling
    people = cut(people, "people")
    full = people.filter(F.length("first") > 1)
    wrong = cut(_misspelt(people, "family", 1), "wrong")
    # only where the given name is also attested with the right family name
    attested = full.select(F.col("family").alias("right"), "first").distinct()
    fixed = full.join(wrong.withColumnRenamed("key", "family"), "family").join(attested, ["right", "first"], "left_semi").select("name", "right")
    # an initial goes with it where no full given name says that the family name is one of its own
    own = full.join(fixed, "name", "left_anti").select("family").distinct()
    moved = people.filter(F.length("first") <= 1).join(wrong.withColumnRenamed("key", "family"), "family").join(own, "family", "left_anti").select("name", "right")
    people = people.join(fixed.unionByName(moved), "name", "left").withColumn("family", F.coalesce("right", "family")).drop("right")
    people = cut(people, "people")

    nick = people.sparkSession.createDataFrame(sorted(NICKNAMES.items()), "first string, meant string")
    vocabulary = people.filter(F.length("first") > 1).select("first", "uses", F.col("family").alias("shape"))
    typos = cut(_misspelt(vocabulary, "first", 3).select(F.col("key").alias("first"), F.col("right").alias("meant")), "typos")
    spelt = vocabulary.join(typos, "first", "left").select(F.col("shape").alias("family"), F.coalesce("meant", "first").alias("first")).distinct()
    nick = cut(nick.unionByName(short_forms(spelt).join(nick.select("first"), "first", "left_anti")), "nick")
    other = nick.unionByName(typos).distinct()
    full = people.filter(F.length("first") > 1).select("family", "first", "middle")
    known = full.select("family", "first").distinct()
    # a nickname or misspelt given name stands for a name that is attested with the family name, if only one is
    meant = _one(known.join(other, "first").join(known.select("family", F.col("first").alias("meant")), ["family", "meant"]), ["family", "first"], "meant")
    # where none is attested, it stands for its own full name, so that all spellings of that name meet
    alone = nick.unionByName(typos.join(nick, "first", "left_anti")).select("first", F.col("meant").alias("long"))
    people = people.join(meant, ["family", "first"], "left").join(alone, "first", "left")
    people = people.withColumn("first", F.coalesce("meant", "long", "first")).drop("meant", "long")
    people = cut(people, "people")

    full = people.filter(F.length("first") > 1)
    middles = full.filter("middle <> ''").groupBy("family", "first").agg(F.count_distinct("middle").alias("n"), F.min("middle").alias("only"))
    full = full.join(middles, ["family", "first"], "left").withColumn("middle", F.when((F.col("middle") == "") & (F.col("n") == 1), F.col("only")).otherwise(F.col("middle")))
    full = full.select("name", "family", "first", "middle", F.concat_ws("|", F.lit("p:") , "family", "first", "middle").alias("entity"))
    whole = full.groupBy("family", F.substring("first", 1, 1).alias("initial"), "middle").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"))
    initials = people.filter(F.length("first") <= 1).select("name", "family", F.col("first").alias("initial"), "middle")
    # by both initials, where given; then by the one, if a single entity fits
    whole = cut(whole, "whole")
    exact = initials.filter("middle <> ''").join(whole, ["family", "initial", "middle"]).filter("n = 1").select("name", "entity")
    rest = initials.join(exact, "name", "left_anti")
    loose = rest.join(whole.select("family", "initial", F.col("middle").alias("m"), "n", "entity"), ["family", "initial"])
    loose = loose.filter("middle = '' or m = ''").groupBy("name").agg(F.sum("n").alias("n"), F.min("entity").alias("entity")).filter("n = 1").select("name", "entity")
    met = exact.unionByName(loose)
    alone = initials.join(met, "name", "left_anti").select("name", F.concat_ws("|", F.lit("i:"), "family", "initial", "middle").alias("entity"))
    return org_names.unionByName(full.select("name", "entity")).unionByName(met).unionByName(alone)


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """(name_a < name_b) of all strings of one entity, of the rows (name, entity) of resolve_names."""
    return pairs_within(resolved, "entity", "name").select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def occurrences(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name) of each non-null, non-empty string in the given string or string-array columns."""
    out = None
    for c in columns:
        array = df.schema[c].dataType.typeName() == "array"
        part = df.select((F.explode(c) if array else F.col(c)).alias("name")).filter("name is not null and name <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def entity_sizes(resolved: DataFrame) -> DataFrame:
    """(name, entity, variants): how many strings the entity of each string has."""
    return resolved.join(resolved.groupBy("entity").agg(F.count("*").alias("variants")), "entity").select("name", "entity", "variants")
