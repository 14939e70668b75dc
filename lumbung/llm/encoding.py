"""Garbled text from a wrong character encoding: found and restored.

A swap of code pages is a substitution cipher: it replaces letters by fixed characters, or by runs of them where UTF-8
was read in a single-byte page. What a source has suffered is unknown, so it is learned by expectation-maximisation
against character bigrams: the hidden variable is what each odd word was, its likelihood that of the word under the bigram
model, and the parameters are, for each source, the shares of the swaps and the mapping of garbled characters to letters,
and the bigram model itself. The code pages of Python's library, all of them, give the mappings to start from; swaps in
UTF-8 may lie up to three deep. The learned mapping is applied to the words by translate().
"""

from __future__ import annotations

import encodings.aliases
import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.functions.rows import map_keyed
from lumbung.operators.pairs import spread
from lumbung.session import cut

@lru_cache(None)
def code_pages() -> tuple[str, ...]:
    """All single-byte code pages that the library knows and whose lower half is ASCII, one of each that are equal; the
    ones that are met most first."""
    first = ["cp1252", "latin_1", "cp1250", "cp1251", "cp850", "cp437", "mac_roman", "cp1253", "koi8_r"]
    pages: dict[tuple, str] = {}
    for name in first + sorted(set(encodings.aliases.aliases.values()) - set(first)):
        try:
            if bytes(range(128)).decode(name) != bytes(range(128)).decode("ascii"):
                continue
            half = tuple(bytes([b]).decode(name, "ignore") for b in range(128, 256))
        except (LookupError, ValueError):  # not of characters, not here, or of several bytes
            continue
        if all(len(c) <= 1 for c in half) and sum(map(bool, half)) >= 60 and "\uff61" not in half:
            pages.setdefault(half, name)
    return tuple(pages.values())


@lru_cache(None)
def whole_runs(page: str) -> bool:
    """Whether clean words in the page are full of what could start a UTF-8 sequence: it has more letters of another
    script than of the Latin one. Only whole runs of odd characters are then taken for misread ones."""
    letters = [c for c in page_chars(page).values() if c.isalpha()]
    return sum("LATIN" not in unicodedata.name(c, "") for c in letters) > len(letters) / 2


LOST = "�"
SAME = "-"
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_ODD = re.compile(r"[^\x00-\x7f]+")
#: A word with a character beyond ASCII, or a numeric reference to a character, between ASCII blanks.
_REFERENCE = re.compile(r"&#(?:[xX][0-9A-Fa-f]{2,6}|[0-9]{2,7});")
_TOKEN = re.compile(rf"(?<![^\x00-\x20])[^\x00-\x20]*(?:[^\x00-\x7f]|{_REFERENCE.pattern})[^\x00-\x20]*")


@lru_cache(None)
def page_bytes(page: str) -> dict[int, str]:
    """Characters of a page as code points, to the character of their byte; undefined bytes stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = chr(b)
    for b in range(0x80, 0xA0):  # control characters that a sloppy reader let through
        out.setdefault(b, chr(b))
    return out


@lru_cache(None)
def page_chars(page: str) -> dict[int, str]:
    """Bytes of a page, to the characters that they are; undefined bytes are left out."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(100_000)
def starts_in(c: str) -> frozenset[str]:
    """The pages in which a character could be the first byte of a UTF-8 sequence."""
    return frozenset(p for p in code_pages() if "\xc2" <= page_bytes(p).get(ord(c), "") <= "\xf4")


def readings(text: str) -> list[str]:
    """The pages, usual ones first, in which some UTF-8 sequence of ``text`` may have been read."""
    possible = frozenset().union(*(starts_in(c) for c in text if c > "\x7f"))
    return [p for p in code_pages() if p in possible]


def undo_utf8(text: str, page: str) -> str:
    """``text`` with each valid UTF-8 sequence that was read in ``page`` put right; all else as it is."""
    table = page_bytes(page)

    def run(m: re.Match) -> str:
        raw = m[0].translate(table)
        if len(raw) != len(m[0]):
            return m[0]
        out, at = [], 0
        for s in _UTF8.finditer(raw):
            if any(ord(c) > 255 for c in s[0]):
                continue
            if s.start() > at and whole_runs(page):
                return m[0]
            out += [m[0][at : s.start()], s[0].encode("latin-1").decode("utf-8")]
            at = s.end()
        if at < len(m[0]) and whole_runs(page):
            return m[0]
        out.append(m[0][at:])
        return "".join(out) if sum(map(len, out)) < len(m[0]) else m[0]

    return _ODD.sub(run, text)


@lru_cache(200_000)
def run_swaps(before: str, run: str, after: str) -> tuple[tuple[str, str], ...]:
    """(swap, what it makes of the run) of a run of odd characters between characters of the kinds ``before`` and
    ``after``, for every page that it may have been read in and every one that it may have been written in; without
    what isn't letters of one script or signs of Western pages, or is much less likely beside these kinds."""
    out = []
    pages = code_pages()
    own = _fit(before, run, after)
    fits: dict[str, bool] = {}
    for i, read in enumerate(pages):
        table = page_bytes(read)
        raw = "".join(table.get(ord(c), "?") for c in run)
        if "?" in raw:
            continue
        for j, meant in enumerate(pages):
            chars = page_chars(meant)
            new = "".join(chars.get(ord(b), "\0") for b in raw)
            if new not in fits:
                scripts = {_script(kind(c))[:-1] for c in new if _script(kind(c))}
                odd = any(unicodedata.category(c)[0] == "C" or ord(c) > 255 and unicodedata.category(c) in ("So", "Sm", "Sk", "Lm", "No") for c in new)
                fits[new] = new != run and len(scripts) <= 1 and not odd and _fit(before, new, after) > own - 5
            if fits[new]:
                out.append((max(i, j), i + j, f"{read}/{meant}", new))
    return tuple((z, new) for _, _, z, new in sorted(out))


def _fit(before: str, run: str, after: str) -> float:
    """Log of how likely the kinds of a run's characters are beside the kinds ``before`` and ``after``."""
    k = [before, *map(kind, run), after]
    return sum(math.log(prior(x, y)) for x, y in zip(k, k[1:])) / (len(run) + 1) * 2


@lru_cache(50_000)
def candidates(token: str) -> dict[str, str]:
    """What a token may have been, with the swaps that lead there (SAME for the token itself)."""
    found = {token: SAME}
    todo = [(token, "")]
    for _ in range(3):
        more = []
        for text, chain in todo:
            for page in readings(text):
                new = undo_utf8(text, page)
                if new not in found:
                    found[new] = f"{chain}>{page}" if chain else page
                    more.append((new, found[new]))
        todo = more
    # one page read for another: all runs of odd characters by the same swap
    options: dict[str, list[str]] | None = None
    runs = list(_ODD.finditer(token))
    for m in runs:
        here = dict(run_swaps(kind(token[m.start() - 1]) if m.start() else "_", m[0], kind(token[m.end()]) if m.end() < len(token) else "_"))
        options = {z: [*(options or {}).get(z, []), new] for z, new in here.items() if options is None or z in options}
    parts, made = _ODD.split(token), set()
    for z, news in (options or {}).items():
        if (key := tuple(news)) not in made:
            made.add(key)
            found.setdefault("".join(x for pair in zip(parts, [*news, ""]) for x in pair), z)
    return found


@lru_cache(100_000)
def kind(c: str) -> str:
    """Class of a character, for transitions that were never seen."""
    o = ord(c)
    if o < 128:
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "_" if c in "^$" else "."
    if 0x80 <= o < 0xA0 or c == LOST:
        return "!"
    if c.isalpha() and unicodedata.category(c) not in ("Lm", "Lo"):
        script = unicodedata.name(c, "?").split(" ", 1)[0]
        if script == "LATIN":
            return "l" if c.islower() else "L"
        return f"{script}{'l' if c.islower() else 'L'}"
    if c.isalpha():
        return "O" if o > 0x2FF else "o"
    if 0x2010 <= o <= 0x205F or c in "«»·¿¡":
        return ","
    return "s" if o < 0x2190 else "S"


def _script(k: str) -> str:
    return "LATIN" if k in ("a", "A", "l", "L") else k if len(k) > 1 else ""


def prior(a: str, b: str) -> float:
    """How likely class b is after class a, before anything is seen: words keep to one script."""
    if _script(a) and _script(b):
        return 0.5 if _script(a)[:-1] == _script(b)[:-1] and not (a[-1].islower() and b[-1].isupper()) else 0.001
    if b == "!":
        return 1e-5
    if _script(a) and b in "sS":
        return 0.002
    return 0.05


class BigramModel:
    """Character bigrams of words with odd characters, smoothed by transitions between classes."""

    def __init__(self, counts: dict[tuple[str, str], float]) -> None:
        self.pairs, self.first = counts, Counter()
        self.classes, self.of_class, self.size = Counter(), Counter(), Counter()
        self.letters: dict[str, Counter] = defaultdict(Counter)
        for (a, b), n in counts.items():
            ka, kb = kind(a), kind(b)
            self.first[a] += n
            self.classes[ka, kb] += n
            self.of_class[ka] += n
            self.letters[kb][b] += n
            self.size[kb] += n
        self.known: dict[tuple[str, str], float] = {}
        self.scores: dict[str, float] = {}

    def log(self, a: str, b: str) -> float:
        if (a, b) not in self.known:
            ka, kb = kind(a), kind(b)
            coarse = (self.classes[ka, kb] + 20 * prior(ka, kb)) / (self.of_class[ka] + 20.0) * (self.letters[kb][b] + 0.5) / (self.size[kb] + 30.0)
            self.known[a, b] = math.log((self.pairs.get((a, b), 0.0) + 4.0 * coarse) / (self.first[a] + 4.0))
        return self.known[a, b]

    def score(self, word: str) -> float:
        x = self.scores.get(word)
        if x is None:
            if len(self.scores) > 200_000:  # a long task's memory is bounded
                self.scores.clear()
            w = f"^{word}$"
            x = self.scores[word] = sum(map(self.log, w, w[1:]))
        return x


@lru_cache(200_000)
def suspicious(token: str) -> bool:
    """Left out of the first bigram model: what decodes, or has three odd Latin letters in a row."""
    return LOST in token or any(undo_utf8(token, p) != token for p in readings(token)) or bool(re.search("[\x80-\x9f]|[À-ɏ]{3}", token))


def plain(token: str) -> str:
    """A token with its numeric references as the characters that they are: garbled text is often kept so."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), token) if "&#" in token else token


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = Counter()
        for key, source, text in zip(batch["item_id"], batch["source"], batch["text"]):
            if key is not None and text and (not text.isascii() or "&#" in text):
                for w in set(_TOKEN.findall(text)):
                    seen[key, source or "", w] += 1
        yield pd.DataFrame(list(seen), columns=["item_id", "source", "token"])


def _options(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        options = [list(candidates(plain(t)).items()) for t in b["token"]]
        yield b.assign(words=[[w for w, _ in o] for o in options], swaps=[[z for _, z in o] for o in options])


def garbled_units(token: str, word: str, swap: str) -> list[tuple[str, str]]:
    """(garbled character, letter) of the odd characters of a token that a swap of pages makes ``word``."""
    return [(x, y) for x, y in zip(token, word) if x > "\x7f"] if "/" in swap else []


@dataclass
class Learned:
    """What is known of each source: the shares of swaps, and the letters that its garbled characters stand for."""

    shares: dict[str, dict[str, float]]
    letters: dict[str, dict[str, dict[str, float]]]  # source -> garbled character -> letter -> expected count
    model: BigramModel

    def weigh(self, source: str, token: str, words: list[str], swaps: list[str]) -> list[float]:
        """Probabilities of the candidates of a token."""
        shares, letters = self.shares.get(source, {SAME: 0.9}), self.letters.get(source, {})
        scores = []
        for w, z in zip(words, swaps):
            x = self.model.score(w) + math.log(shares.get(z, 1e-5))
            for u, c in garbled_units(token, w, z):
                n = letters.get(u)
                x += math.log((n.get(c, 0.0) + 0.5) / (sum(n.values()) + 1.0)) if n else 0.0
            scores.append(x)
        best = max(scores)
        odds = [math.exp(x - best) for x in scores]
        total = sum(odds)
        return [x / total for x in odds]

    def table(self, source: str, token: str, word: str, swap: str) -> dict[int, str]:
        """The translation of the token's garbled characters: the letter that the source's mapping has for each, where
        there is one that is clearly the most frequent, or else the page's."""
        out = {}
        for u, c in garbled_units(token, word, swap):
            n = self.letters.get(source, {}).get(u) or {c: 1.0}
            best = max(n, key=lambda k: (n[k], k))
            out[ord(u)] = best if n[best] > 4 * n.get(c, 0.0) + 2 else c
        return out


OPEN_WEIGHT = 0.1


def learn_swaps(tokens: DataFrame, open_: DataFrame, rounds: int = 3, most_rows: int = 2_000_000) -> Learned:
    """Shares of the swaps and meanings of garbled characters in each source, and the bigram model. ``tokens`` (source,
    token, n, choice) of all texts; ``open_``: those that have a choice of what they were, with the columns words and
    swaps, their candidates.

    Each round is one distributed pass over the open tokens. What comes to the driver is bounded by the sources times the
    swaps and garbled characters, and by the pairs of characters in use; rather than lose some, it raises beyond
    ``most_rows``, which is more than any writing has.
    """

    def starting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, sources = Counter(), Counter()
            for source, token, n, choice in zip(b["source"], b["token"], b["n"], b["choice"]):
                if not choice:
                    sources[source, SAME] += n
                if not suspicious(token):
                    w = f"^{token}$"
                    for pair in zip(w, w[1:]):
                        out["o" if choice else "b", *pair] += n
            yield pd.DataFrame([(k, x, y, "", float(n)) for (k, x, y), n in out.items()] + [("z", s, z, "", float(n)) for (s, z), n in sources.items()], columns=["kind", "x", "y", "u", "n"])

    def stepping(learned: Learned):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out, swaps, units = defaultdict(float), defaultdict(float), defaultdict(float)
                for source, n, words, chains in zip(b["source"], b["n"], b["words"], b["swaps"]):
                    for word, z, p in zip(words, chains, learned.weigh(source, words[0], words, chains)):
                        if p > 1e-4:
                            swaps[source, z] += n * p
                            for u, c in garbled_units(words[0], word, z) if p > 1e-2 else ():
                                units[source, c, u] += n * p
                            if LOST not in word:
                                w = f"^{word}$"
                                for pair in zip(w, w[1:]):
                                    out[pair] += n * p
                yield pd.DataFrame([("b", x, y, "", n) for (x, y), n in out.items()] + [("z", s, z, "", n) for (s, z), n in swaps.items()] + [("u", s, c, u, n) for (s, c, u), n in units.items()], columns=["kind", "x", "y", "u", "n"])

        return step

    def run(tokens: DataFrame, f) -> dict[str, dict]:
        rows = tokens.mapInPandas(f, "kind string, x string, y string, u string, n double").groupBy("kind", "x", "y", "u").agg(F.sum("n").alias("n")).limit(most_rows).collect()
        if len(rows) == most_rows:
            raise ValueError("more pairs of characters than any writing has; is the text binary?")
        out: dict[str, dict] = {k: Counter({(r["x"], r["y"]): r["n"] for r in rows if r["kind"] == k}) for k in "boz"}
        out["u"] = {}
        for r in rows:
            if r["kind"] == "u":
                out["u"].setdefault(r["x"], {}).setdefault(r["u"], {})[r["y"]] = r["n"]
        return out

    start = run(tokens, starting)
    clear_pairs, clear_swaps = start["b"], start["z"]
    # words with a choice weigh little at first, so that a garbled word doesn't speak for itself
    learned = Learned({}, {}, BigramModel(clear_pairs + Counter({k: OPEN_WEIGHT * n for k, n in start["o"].items()})))
    for _ in range(rounds):
        step = run(open_, stepping(learned))
        swaps = clear_swaps + step["z"]
        totals, overall = Counter(), Counter()
        for (s, z), n in swaps.items():
            totals[s] += n
            overall[z] += n
        everything = sum(overall.values()) or 1.0
        # swaps seen in other sources are possible, if less likely, in this one
        shares = {s: {z: (swaps.get((s, z), 0.0) + 5.0 * overall[z] / everything) / (totals[s] + 5.0) for z in overall} for s in totals}
        learned = Learned(shares, step["u"], BigramModel(clear_pairs + step["b"]))
    return learned


#: Sum of log odds from which the odd words of a text, none of them sure by itself, show a swap of the whole text.
TEXT_ODDS = 5.5


def garbled_words(df: DataFrame, id_col: str, text_col: str, source_col: str, rounds: int = 3) -> DataFrame:
    """(item_id, token, decoded), distinct: the garbled words of each text, and what they were; where that is lost,
    ``decoded`` still holds U+FFFD. A word is garbled if a swap is likelier than none, given its source, or if the words
    of its text that would be likelier by the same swap outweigh TEXT_ODDS together."""
    words = cut(map_keyed(df, id_col, {"source": F.col(source_col).cast("string"), "text": F.col(text_col)}, _words, "source string, token string", drop_null=True), "words")
    tokens = words.groupBy("source", "token").agg(F.count("*").alias("n"))
    tokens = cut(spread(tokens, "token").mapInPandas(_options, "source string, token string, n bigint, words array<string>, swaps array<string>"), "tokens")
    # from here on, the first word is the token as it is read, and the token only its name
    choice = (F.size("words") > 1) | F.col("words")[0].contains(LOST)
    open_ = cut(spread(tokens.filter(choice), "token"), "open")
    learned = learn_swaps(tokens.select("source", F.col("words")[0].alias("token"), "n", choice.alias("choice")), open_, rounds)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, token, texts, swaps in zip(b["source"], b["token"], b["words"], b["swaps"]):
                read = texts[0]
                weights = learned.weigh(source, read, texts, swaps)
                wrong = sum(p for z, p in zip(swaps, weights) if z != SAME)
                best = max((p, w, z) for w, z, p in zip(texts, swaps, weights) if z != SAME) if wrong > 0.5 else None
                if best and "/" not in best[2]:
                    out.append((source, token, best[1], best[2], 99.0, True))
                elif LOST in read:
                    out.append((source, token, read, "", 99.0, True))
                else:  # not sure by itself: the words of a text are put right by the same swap
                    same = learned.model.score(read)
                    for w, z in zip(texts, swaps):
                        odds = learned.model.score(w) - same if z != SAME else 0.0
                        if odds > 0.5:
                            out.append((source, token, read.translate(learned.table(source, read, w, z)) if "/" in z else w, z, odds, bool(best) and z == best[2]))
            yield pd.DataFrame(out, columns=["source", "token", "decoded", "swap", "odds", "sure"])

    decided = cut(open_.mapInPandas(decide, "source string, token string, decoded string, swap string, odds double, sure boolean"), "decided")
    found = words.join(decided, ["source", "token"])
    clear = found.filter("swap = ''").select("item_id", "token", "decoded")
    maybe = found.filter("swap <> ''")
    # every swap that a text shows, as it may have been garbled in several ways; each word by the likeliest of them
    shown = maybe.groupBy("item_id", "swap").agg(F.sum("odds").alias("all"), F.max("sure").alias("sure")).filter(F.col("sure") | (F.col("all") > TEXT_ODDS)).select("item_id", "swap", F.struct("sure", "all").alias("by"))
    right = maybe.drop("sure").join(shown, ["item_id", "swap"]).groupBy("item_id", "token").agg(F.max_by("decoded", F.struct("by", "odds", "decoded")).alias("decoded"))
    return clear.select("item_id", "token", "decoded").unionByName(right).distinct()


def find_garbled(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(item_id), distinct: rows whose text holds garbled characters, restorable or not.

    A null id or text, an empty text and plain ASCII hold none; repeated rows count once; a null source is a source of
    its own; an empty table gives an empty one; other columns are ignored.
    """
    return garbled_words(df, id_col, text_col, source_col).select("item_id").distinct()


def restore(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(item_id, restored_text, garbled, lost) of each distinct non-null id: garbled words are put right, all else is left as it
    was; ``lost`` where a character can't be known any more. Null texts stay null. See find_garbled."""
    found = garbled_words(df, id_col, text_col, source_col).groupBy("item_id", "token").agg(F.min("decoded").alias("decoded"))
    maps = found.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "decoded"))).alias("map"))  # bounded by one text
    slim = df.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null").dropDuplicates(["item_id"]).join(maps, "item_id", "left")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, pairs in zip(b["item_id"], b["text"], b["map"]):
                table = dict(pairs) if pairs is not None else {}
                new = _TOKEN.sub(lambda m: table.get(m[0], m[0]), text) if table and text else text
                out.append((key, new, bool(table), bool(table) and LOST in (new or "")))
            yield pd.DataFrame(out, columns=["item_id", "restored_text", "garbled", "lost"])

    return map_keyed(slim, "item_id", {"text": F.col("text"), "map": F.col("map")}, apply, "restored_text string, garbled boolean, lost boolean")
