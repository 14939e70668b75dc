"""Words of a text as index terms: distinct, without stop words, optionally stemmed."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that no index holds, in Indonesian and English.
INDONESIAN = (
    "yang dan di ke dari untuk pada dengan ini itu atau juga akan telah sudah belum tidak bukan adalah ialah merupakan rupa dalam oleh "
    "sebagai karena sebab agar supaya hingga sampai namun tetapi tapi melainkan yaitu yakni serta para kami kita mereka dia ia saya anda "
    "nya sangat lebih paling hanya saja masih bisa dapat harus perlu boleh ada tersebut sebuah suatu seperti antara terhadap tentang "
    "mengenai bagi atas bawah setelah sebelum ketika saat selama guna melalui menjadi jadi lain lainnya yg dll dsb"
).split()
ENGLISH = (
    "the a an and or but of to in on at by for with from as is are was were be been being this that these those it its which who whom "
    "whose what when where why how all any both each few more most other some such no nor not only own same so than too very can will "
    "just should now also may might must shall would could have has had do does did we our they their there here into during between "
    "among within without about through"
).split()
STOPWORDS = tuple(sorted({*INDONESIAN, *ENGLISH}))


def terms(text: Column) -> Column:
    """Distinct terms of a text, unstemmed: runs of a-z and 0-9 of two or more characters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Suffixes of the published English stemming algorithm (steps 2 and 3) and what replaces them.
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = re.search(f"[{_VOWEL}][^{_VOWEL}]", word)
    return m.end() if m else len(word)


@lru_cache(200_000)
def stem_english(word: str) -> str:
    """Stem of an English word, by the published suffix-stripping algorithm (second version) without its exceptions."""
    if len(word) <= 2:
        return word
    w = re.sub(r"'s?$", "", word)
    w = re.sub(f"(^|(?<=[{_VOWEL}]))y", r"\1Y", w)
    r1 = _region(w)
    r2 = r1 + _region(w[r1:])
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif re.search(f"[{_VOWEL}].+s$", w) and not re.search("(us|ss)$", w):
        w = w[:-1]
    m = re.search("(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_VOWEL}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif r1 >= len(w) and re.search(f"(^[{_VOWEL}][^{_VOWEL}]|[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY])$", w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix, new in table:
            if w.endswith(suffix):
                if len(w) - len(suffix) >= r1:
                    w = w[: -len(suffix)] + new
                break
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if re.search("[st]ion$", w) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not re.search(f"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]e$", w))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _syllables(word: str) -> int:
    return len(re.findall("[aeiou]", word))


@lru_cache(200_000)
def stem_indonesian(word: str) -> str:
    """Stem of an Indonesian word, by the published affix-stripping rules: particle, possessive, prefix, suffix; a stem
    keeps two syllables."""
    w = word

    def cut(pattern: str, new: str = "") -> bool:
        nonlocal w
        m = re.search(pattern, w)
        if m and _syllables(w) > 2:
            left = re.sub(pattern, new, w, count=1)
            if _syllables(left) >= 2:
                w = left
                return True
        return False

    cut("(kah|lah|pun)$")
    cut("(ku|mu|nya)$")
    first = False
    for prefix, new in (("^meny", "s"), ("^peny", "s"), ("^meng", ""), ("^peng", ""), ("^mem(?=[aeiou])", "p"), ("^pem(?=[aeiou])", "p"), ("^mem", ""), ("^pem", ""), ("^men(?=[aeiou])", "t"), ("^pen(?=[aeiou])", "t"), ("^men", ""), ("^pen", ""), ("^me", ""), ("^di", ""), ("^ter", ""), ("^ke", "")):
        if re.search(prefix, w):
            first = cut(prefix, new)
            break
    suffix = cut("(kan|an|i)$") if first else False
    for prefix in ("^bel(?=ajar)", "^ber", "^be(?=[^aeiou]er)", "^per", "^pel(?=ajar)", "^pe"):
        if re.search(prefix, w):
            cut(prefix)
            break
    if not suffix:
        cut("(kan|an|i)$")
    return w


def lexemes(text: Column, language: Column | None = None) -> Column:
    """Sorted distinct stems of a text in its language ('id' or 'en'; both stems where it is neither), less stop words."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(words: pd.Series, languages: pd.Series) -> pd.Series:
        out = []
        for ws, lang in zip(words, languages):
            stems = set()
            for w in ws if ws is not None else ():
                if lang != "id":
                    stems.add(stem_english(w))
                if lang != "en":
                    stems.add(stem_indonesian(w))
            out.append(sorted(s for s in stems if len(s) > 1))
        return pd.Series(out)

    return run(terms(text), language if language is not None else F.lit(None).cast("string"))
