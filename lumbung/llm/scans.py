"""Damage of texts read from scanned pages: divided words, misread characters, page furniture; and its repair.

The lines of a text are labelled body, header (any page furniture) or break by a hidden Markov model over layout
features. Its probabilities are fitted by expectation-maximisation on a bounded sample of texts, from starting values
that say what the states are. Whether a divided or odd word is damage is decided with a lexicon of the whole corpus:
document frequencies of all words, by joins, so that nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.operators.sampling import hash_sample
from lumbung.session import cut

BODY, HEADER, BREAK, COLUMN = 0, 1, 2, 3  # a column of numbers is a kind of body
#: The layout features of a line, each true or false.
FEATURES = ("blank", "page_mark", "number_column", "repeated", "edge_number", "ends_sentence", "starts_lower", "short", "interrupts", "page_start", "known_head", "counts_on", "capitals")
# Starting values of P(feature | state) for body, header, break, column, and of the transitions.
_START = np.array([
    [0.00, 0.00, 0.98, 0.00],
    [0.01, 0.55, 0.00, 0.95],
    [0.02, 0.01, 0.00, 0.95],
    [0.01, 0.90, 0.30, 0.95],
    [0.03, 0.60, 0.00, 0.01],
    [0.30, 0.02, 0.00, 0.01],
    [0.40, 0.02, 0.00, 0.01],
    [0.15, 0.90, 0.90, 0.95],
    [0.01, 0.45, 0.00, 0.01],
    [0.03, 0.35, 0.05, 0.01],
    [0.01, 0.45, 0.00, 0.01],
    [0.00, 0.45, 0.00, 0.01],
    [0.01, 0.20, 0.00, 0.01],
])
_MOVES = np.array([[0.79, 0.04, 0.16, 0.01], [0.60, 0.25, 0.14, 0.01], [0.88, 0.08, 0.02, 0.02], [0.10, 0.01, 0.04, 0.85]])
_FIRST = np.array([0.89, 0.09, 0.01, 0.01])

_PAGE_MARK = re.compile(r"[\s\[(–—|-]*(?:(?:page|pg|p|hal|halaman|pagina|seite)\b\.?\s*)?\d{1,5}(?:\s*(?:of|dari|van|de|sur|/)\s*\d{1,5})?[\s\])–—|-]*", re.I)
_EDGE_NUMBER = re.compile(r"^\s*\d{1,4}(?:\s{2,}|\s*[|–—])\s*\S|\S(?:\s{2,}|\s*[|–—]\s*|,\s+)\d{1,4}\s*$|\(\d{1,2}/\d{4}\)|\bvol\.?\s*\d+|^\W*(?:diunduh|downloaded|printed|dicetak|gedownload|gedrukt|téléchargé|imprimé)\b", re.I)
_STAMP = re.compile(r"^\W*(?:diunduh|downloaded|printed|dicetak|gedownload|gedrukt|téléchargé|imprimé)\b\D{0,12}\d", re.I)
_LOADED = re.compile(r"\W*(?:diunduh|downloaded|printed|dicetak|gedownload|gedrukt|téléchargé|imprimé)\b", re.I)
_NUMBER, _NUMBER5 = re.compile(r"\d+"), re.compile(r"\d{1,5}")
_FIRST_NUMBER, _LAST_NUMBER = re.compile(r"\d{1,5}\b"), re.compile(r"\b\d{1,5}$")
_CLOSERS, _STOPS = "\"'”’»)]", tuple(".!?:;…")
_END = re.compile(r"[.!?:;…][\"'”’»)\]]*\s*$")
_LOW = re.compile(r"[\W\d]*[a-zß-öø-ÿ]")
_NUMERIC = re.compile(r"[\d.,%\s-]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"(?<![\w†])[^\W\d_]+(?:[-‑][^\W\d_]+)*(?![\w†])")
_TAIL = re.compile(r"([^\W\d_]+)([-‐‑¬­])\s*$")
_HEAD = re.compile(r"\s*([^\W\d_]+)")
_SPACED = re.compile(r"(?<![^\W_])(?<!†)(?:[^\W_] ){3,}[^\W_](?![^\W_])")
_SPACED_HINT = re.compile(r" [^\W_] [^\W_] ")
_DIGITS = re.compile(r"[\d†][\w†]*(?:[.,]\d[\w†]*)*")
_ANY_DIGIT = re.compile(r"[\d†]")
_LONE_DIGITS = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
_LETTER_LIKE = str.maketrans({"1": "l", "0": "o", "5": "s", "†": "t"})
_AFTER = re.compile(r"\s+([^\W\d_]+)")
_FRAGMENT = re.compile(r"(?<![\w†])[\w†]+[-‐‑¬­][^\S\n]*\n\s*[\w†]*")
_MISREAD = re.compile(r"[\w†|]+(?:-[\w†|]+)*(?:[.,][\dOlI]+)?")

# What a scanner reads in the place of what was printed.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("ii", "n"), ("nn", "m"), ("in", "m"), ("li", "h"), ("lt", "k"),
    ("c", "e"), ("e", "c"), ("c", "o"), ("o", "c"), ("h", "b"), ("b", "h"), ("l", "i"), ("i", "l"), ("t", "l"), ("l", "t"), ("f", "t"), ("t", "f"), ("n", "u"), ("u", "n"), ("a", "o"), ("o", "a"), ("y", "v"), ("v", "y"), ("q", "g"), ("j", "i"),
    ("ä", "a"), ("á", "a"), ("à", "a"), ("â", "a"), ("í", "i"), ("ì", "i"), ("î", "i"), ("ï", "i"), ("ó", "o"), ("ò", "o"), ("ö", "o"), ("ü", "u"), ("ú", "u"), ("é", "e"), ("è", "e"), ("ë", "e"), ("ê", "e"), ("ç", "c"), ("ñ", "n"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("6", "g"), ("8", "b"), ("9", "g"), ("9", "q"), ("4", "a"), ("3", "e"), ("7", "t"), ("2", "z"), ("†", "t"), ("|", "l"),
)
_READ = {(a, b) for a, b in CONFUSIONS if not a.isalpha()}
#: Letters that stand for digits in misread numbers.
DIGIT_LIKE = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "b": "6", "g": "9", "|": "1"})


_BY_FIRST: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _seen, _printed in CONFUSIONS:
    _BY_FIRST[_seen[0]].append((_seen, _printed))
_ODD = re.compile(r"[\d†|]")


def _single(word: str) -> set[str]:
    """``word`` with one confusion undone at one place."""
    return {word[:i] + p + word[i + len(s) :] for i, c in enumerate(word) for s, p in _BY_FIRST.get(c, ()) if word.startswith(s, i)}


#: Words with more odd characters than this have too many readings to list; they are looked up by canonical().
LISTED = 4


def corrections(word: str) -> set[str]:
    """Words that ``word`` (in lower case) may have been: one confusion undone; or each digit made the letter that it
    stands for, and one more confusion undone. Empty for more than LISTED digits and signs, see canonical."""
    odd = _ODD.findall(word)
    if not odd:
        return _single(word) - {word}
    if len(odd) > LISTED:
        return set()
    whole = [""]
    for c in word:
        whole = [w + x for w in whole for x in ([p for _, p in _BY_FIRST.get(c, ())] if _ODD.match(c) else (c,))]
    return set(whole) | {x for w in whole for x in _single(w)}


# Letters and the digits and signs that are read for them, brought to one character each.
_CANON_FROM, _CANON_TO = "oil|sbgq689zaet†7", "01115666666243777"


def canonical(word: Column) -> Column:
    """A form that is the same for a word and for all its readings with digits or signs in the place of letters."""
    return F.translate(word, _CANON_FROM, _CANON_TO)


def reads_as(seen: str, word: str) -> bool:
    """Whether each odd character of ``seen`` stands for the letter of ``word`` at its place, and all others are equal."""
    return len(seen) == len(word) and all(a == b or (a, b) in _READ for a, b in zip(seen, word))


def split_lines(text: str) -> list[str]:
    """Lines, with carriage returns removed and each page break (form feed) left at the start of its line."""
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


class Heads:
    """Word sets of what may run at the head of a page, and which of them hold a word."""

    def __init__(self, names: list[str]) -> None:
        self.of: dict[str, list[int]] = defaultdict(list)
        for i, name in enumerate(names):
            for w in {w.casefold() for w in _LETTERS.findall(name)}:
                self.of[w].append(i)

    def known(self, words: set[str], own: set[str]) -> bool:
        """Whether three fifths of a line's words, and two at least, are those of a text's ``own`` title or of one name."""
        least = max(2, 0.6 * len(words))
        if len(words) < 2:
            return False
        if own and len(words & own) >= least:
            return True
        shared = Counter(i for w in words if w in self.of for i in self.of[w])
        return bool(shared) and max(shared.values()) >= least


def title_words(title: object) -> set[str]:
    return {w.casefold() for w in _LETTERS.findall(title)} if isinstance(title, str) else set()


def _counting(b: str) -> re.Match | None:
    """The number that a line begins or ends with."""
    m = _FIRST_NUMBER.match(b) if b[0].isdecimal() else None
    return m or (_LAST_NUMBER.search(b, max(0, len(b) - 6)) if b[-1].isdecimal() else None)


def line_features(lines: list[str], heads: Heads, own: set[str]) -> list[int]:
    """Bit masks over FEATURES. ``heads``: what may run at the head of a page, with the words of the text's ``own`` title."""
    bare = [x.strip() for x in lines]
    lengths = sorted(len(b) for b in bare if b)
    wide = lengths[int(len(lengths) * 0.75)] if lengths else 0
    most = max(140, wide)  # what runs over a page's edges isn't longer than the lines between them
    marks, shapes, edges, words, ends = [], [], [], [], []
    for x, b in zip(lines, bare):
        n = len(b)
        digits = bool(_ANY_DIGIT.search(b))
        mark = digits and n < 40 and bool(_PAGE_MARK.fullmatch(b))
        marks.append(mark)
        small = 0 < n <= most
        letters = _LETTERS.findall((_LONE_DIGITS.sub(" ", b).translate(_LETTER_LIKE) if digits else b).casefold()) if small else []
        words.append(letters)
        # a line without its digits, case and signs, so that running heads with their page numbers are equal
        shapes.append(_NUMBER.sub("#", b) if mark else "".join(letters) if small else b)
        edges.append(small and bool(digits and _EDGE_NUMBER.search(x) or _LOADED.match(b)))
        ends.append(b.rstrip(_CLOSERS)[-1:] in _STOPS)
    often = Counter(s for s, b in zip(shapes, bare) if b)
    filled = [k for k, b in enumerate(bare) if b]
    before, after = dict(zip(filled[1:], filled)), dict(zip(filled, filled[1:]))
    # the neighbours in the running text: the nearest lines that don't look like furniture themselves
    plain = [k for k in filled if not (marks[k] or edges[k] or often[shapes[k]] > 1 and len(bare[k]) <= most)]
    left, right, at = {}, {}, 0
    for k in filled:
        while at < len(plain) and plain[at] < k:
            at += 1
        left[k] = plain[at - 1] if at else None
        nxt = at + (at < len(plain) and plain[at] == k)
        right[k] = plain[nxt] if nxt < len(plain) else None
    last: dict[str, int] = {}
    counts_on = set()
    where: dict[str, int] = {}
    for k in filled:
        if len(bare[k]) <= most:
            m = _NUMBER5.search(bare[k]) if marks[k] else _counting(bare[k])
            if m:
                number = int(m[0])
                if last.get(shapes[k]) == number - 1 and where[shapes[k]] < k - 1:
                    counts_on |= {k, where[shapes[k]]}
                last[shapes[k]], where[shapes[k]] = number, k
    out = []
    for k, (line, b) in enumerate(zip(lines, bare)):
        if not b:
            out.append(1 | (64 << 3 if "\x0c" in line else 0))
            continue
        mark, small, lower = marks[k], len(b) <= most, b[0].islower()
        column = mark and k not in counts_on and any(j is not None and abs(j - k) == 1 and _NUMERIC.fullmatch(bare[j]) for j in (before.get(k), after.get(k)))
        lt, rt = left[k], right[k]
        mid = not lower and lt is not None and rt is not None and not ends[lt] and bool(_LOW.match(bare[rt]))
        out.append(
            mark << 1 | bool(column) << 2 | (small and often[shapes[k]] > 1) << 3 | edges[k] << 4 | (ends[k] and not mark) << 5 | lower << 6 | (len(b) < 0.8 * wide) << 7
            | mid << 8 | ("\x0c" in line) << 9 | heads.known(set(words[k]), own) << 10 | (k in counts_on) << 11 | (small and b.isupper() and bool(_LETTERS.search(b))) << 12
        )
    return out


@dataclass(frozen=True)
class LineModel:
    """Hidden Markov model of the line labels; emissions are independent features."""

    first: np.ndarray
    moves: np.ndarray
    emit: np.ndarray  # features x states

    def log_emission(self, mask: int) -> np.ndarray:
        on = np.array([(mask >> i) & 1 for i in range(len(FEATURES))], float)
        return on @ np.log(self.emit) + (1 - on) @ np.log(1 - self.emit)

    @staticmethod
    def start() -> LineModel:
        return LineModel(_FIRST, _MOVES, np.clip(_START, 1e-3, 1 - 1e-3))

    def fit(self, texts: list[list[int]], rounds: int = 6, prior: float = 200.0) -> LineModel:
        """Expectation-maximisation on feature masks of texts. The starting values weigh as ``prior`` lines of each state."""
        model = self
        bits = lambda m: [(m >> i) & 1 for i in range(len(FEATURES))]
        for _ in range(rounds):
            first, moves = model.first * 10, model.moves * prior
            on, total = self.emit * prior, np.full(len(self.first), prior)
            known: dict[int, np.ndarray] = {}
            for masks in texts:
                e = np.exp(np.array([known.setdefault(m, model.log_emission(m)) for m in masks]))
                e /= e.max(axis=1, keepdims=True)
                n = len(masks)
                a, b = np.empty((n, len(first))), np.ones((n, len(first)))
                a[0] = model.first * e[0]
                a[0] /= a[0].sum()
                for t in range(1, n):
                    a[t] = (a[t - 1] @ model.moves) * e[t]
                    a[t] /= a[t].sum()
                for t in range(n - 2, -1, -1):
                    b[t] = model.moves @ (e[t + 1] * b[t + 1])
                    b[t] /= b[t].sum()
                g = a * b
                g /= g.sum(axis=1, keepdims=True)
                first = first + g[0]
                for t in range(n - 1):
                    x = model.moves * np.outer(a[t], e[t + 1] * b[t + 1])
                    moves = moves + x / x.sum()
                on = on + np.array([bits(m) for m in masks]).T @ g
                total = total + g.sum(axis=0)
            model = LineModel(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), np.clip(on / total, 1e-4, 1 - 1e-4))
        return model


class Labeller:
    """Most probable labels of lines; emissions are kept by feature mask."""

    def __init__(self, model: LineModel) -> None:
        self.model, self.known = model, {}
        self.first, self.moves = np.log(model.first).tolist(), np.log(model.moves).tolist()

    def __call__(self, masks: list[int]) -> list[int]:
        known, moves, states = self.known, self.moves, range(len(self.first))
        back, score = [], None
        for m in masks:
            e = known.get(m)
            if e is None:
                e = known[m] = self.model.log_emission(m).tolist()
            if score is None:
                score = [f + x for f, x in zip(self.first, e)]
                continue
            new, ways = [], []
            for s in states:
                options = [score[p] + moves[p][s] for p in states]
                w = options.index(max(options))
                ways.append(w)
                new.append(options[w] + e[s])
            back.append(ways)
            score = new
        if score is None:
            return []
        s = score.index(max(score))
        path = [s]
        for ways in reversed(back):
            s = ways[s]
            path.append(s)
        return [BODY if s == COLUMN else s for s in reversed(path)]


def number_tokens(text: str) -> Iterator[tuple[str, bool, str, str]]:
    """(token, whether it is a plain number, ``word #`` before it, ``# word`` after it) of the tokens with a digit that
    aren't part of a code with hyphens or slashes."""
    for m in _DIGITS.finditer(text):
        lo, hi = m.span()
        start = lo
        while start and (text[start - 1].isalpha() or text[start - 1] == "†"):
            start -= 1
        if start and (text[start - 1].isdigit() or text[start - 1] in "_-/.,"):
            continue
        if text[hi : hi + 1] in ("-", "/") and text[hi + 1 : hi + 2].isalnum():
            continue
        token = text[start:hi]
        # the word before, at most three signs away
        end = start
        while end and start - end < 3 and not (text[end - 1].isalnum() or text[end - 1] == "_"):
            end -= 1
        at = end
        while at and text[at - 1].isalnum() and not text[at - 1].isdecimal():
            at -= 1
        after = _AFTER.match(text, hi)
        yield token, not any(c.isalpha() or c == "†" for c in token), f"{text[at:end].lower()} #" if at < end < start else "", f"# {after[1].lower()}" if after else ""


def divided_words(lines: list[str], labels: list[int]) -> list[tuple[int, int, str, str, str]]:
    """(line, next line, left, right, sign) of each body line whose last word may go on in the next body line."""
    out = []
    body = [k for k, s in enumerate(labels) if s == BODY]
    for k, n in zip(body, body[1:]):
        line = lines[k]
        tail = _TAIL.search(line, max(0, len(line) - 40)) if line.rstrip()[-1:] in "-‐‑¬­" else None
        if tail and tail.start() == len(line) - 40:  # a longer word
            tail = _TAIL.search(line)
        if tail:
            head = _HEAD.match(lines[n])
            if head:
                out.append((k, n, tail[1], head[1], tail[2]))
    return out


def fit_line_model(df: DataFrame, id_col: str, title_col: str, text_col: str, heads: list[str], sample: int = 1000) -> LineModel:
    """The model, fitted on about ``sample`` texts of several lines, those of ids with low hashes."""
    lined = df.select(F.col(id_col).alias("i"), F.col(title_col).alias("t"), F.col(text_col).alias("x")).filter(F.col("x").contains("\n"))
    rows = sorted(hash_sample(lined, "i", sample).collect(), key=lambda r: (str(r["i"]), r["x"]))
    names = Heads(heads)
    masks = [line_features(split_lines(r["x"]), names, title_words(r["t"])) for r in rows]
    return LineModel.start().fit(masks) if masks else LineModel.start()


#: One row per finding of the first pass, see _findings.
_FOUND = "kind string, item_id string, word string, other string, left_word string, right_word string, n bigint"


def _findings(batches: Iterator[pd.DataFrame], model: LineModel, names: Heads) -> Iterator[pd.DataFrame]:
    """Findings of a partition. kind f: a header line; h: a word divided at a line's end, ``word`` joined, ``other`` with
    its hyphen; s: a spaced word; m: a word that mixes letters and digits, after the word ``other`` and before ``left_word``, in the body ``right_word``;
    d: the distinct words of a text, ``right_word``, with blanks between, and the body's digest, ``left_word``; p: n numbers stand by the word, ``a #`` after it or ``# a`` before it.
    Words are looked for in header lines too, but only body lines have divided words."""
    label = Labeller(model)
    follow = Counter()
    out, held = [], 0
    columns = [c.split()[0] for c in _FOUND.split(", ")]
    for batch in batches:
        for key, title, text in zip(batch["item_id"], batch["title"], batch["text"]):
            if key is None or not text:
                continue
            body = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            lines, headers, parts = split_lines(text), [], set()
            if len(lines) > 1:
                labels = label(line_features(lines, names, title_words(title)))
                if HEADER in labels:
                    out.append(("f", key, None, None, None, None, None))
                    headers = [x for x, s in zip(lines, labels) if s == HEADER]
                    lines = [x if s != HEADER else "" for x, s in zip(lines, labels)]
                cut_words = divided_words(lines, labels)
                for k, n, left, right, sign in cut_words:
                    joined, lo, ro = left + right, left.lower(), right.lower()
                    out.append(("h", key, joined.lower(), f"{lo}-{ro}", lo if sign in "-‐‑" else "¬", f"{ro}{'^' if right[0].isupper() else ''}", None))
                    lines[k] = _TAIL.sub(" ", lines[k])
                    lines[n] = _HEAD.sub(" ", lines[n], count=1)
                # header lines follow, apart from each other; what is left of words divided elsewhere is no word
                text = "".join(["\n".join(lines), *(f"\n\n|\n\n{x}" for x in headers)])
                parts = {p for m in _FRAGMENT.findall(text) for p in re.findall(r"[\w†]+", m)}
            if _SPACED_HINT.search(text):
                for m in _SPACED.findall(text):
                    out.append(("s", key, m.replace(" ", "").lower(), None, None, None, None))
                text = _SPACED.sub(" ", text)
            for token, number, before, after in number_tokens(text):
                if number:
                    follow[before] += 1
                    follow[after] += 1
                elif token not in parts or len(token) > 4:
                    out.append(("m", key, token, before, after, body, None))
            words = " ".join(sorted(set(_WORD.findall((_FRAGMENT.sub(" ", text) if parts else text).lower()))))
            if words:
                out.append(("d", key, None, None, body, words, None))
                held += len(words)
            if len(out) > 50_000 or held > 20_000_000:  # a long task's memory is bounded
                yield pd.DataFrame(out, columns=columns).astype({"n": "Int64"})
                out, held = [], 0
    out += [("p", None, w, None, None, None, n) for w, n in follow.items() if w]
    yield pd.DataFrame(out, columns=columns).astype({"n": "Int64"})


def _correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(w, n, c) for w, n in zip(batch["word"], batch["n"]) for c in corrections(w)]
        yield pd.DataFrame(out, columns=["word", "n", "right"])


def _reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        b = batch[["word", "n", "right", "attested"]]
        yield b[[reads_as(x, y) for x, y in zip(b["word"], b["right"])]]


_RIGHT = "word string, n bigint, right string"


def scan_findings(df: DataFrame, id_col: str, title_col: str, text_col: str, *, heads: list[str], sample: int = 1000, ratio: int = 10, least: int = 5) -> dict[str, DataFrame]:
    """What is damaged, as tables: ``furniture`` (item_id), ``hyphenation`` (item_id, left_word, right_word, word) and
    ``characters`` (item_id, word, right): the misread word as it stands, and what it was.

    A word divided at a line's end is damage unless its form with a hyphen is the better attested one. A word is misread
    if undoing a confusion of CONFUSIONS gives one that at least ``least`` texts and ``ratio`` times as many texts have
    (for words of two or three letters the square of ``ratio``); a word with digits in it is judged by its neighbours too.
    Texts are distinct bodies of the whole table: copies and redeliveries count once. Null ids and null or empty texts have no
    findings; repeated rows give equal findings; an empty table gives empty ones; other columns are ignored.
    """
    slim = df.select(F.col(id_col).cast("string").alias("item_id"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    model = fit_line_model(df, id_col, title_col, text_col, heads, sample)
    names = Heads(heads)
    found = cut(slim.mapInPandas(lambda it: _findings(it, model, names), _FOUND), "scan")
    docs = found.filter("kind = 'd'").select("item_id", F.col("left_word").alias("body"), F.col("right_word").alias("words"))
    once = docs.groupBy("body").agg(F.max("words").alias("words"))  # equal but where titles label lines differently
    lexicon = cut(once.select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "lexicon")

    h = found.filter("kind = 'h'").select("item_id", "word", "other", "left_word", "right_word").distinct()
    h = h.join(lexicon.withColumnRenamed("n", "joined"), "word", "left").join(lexicon.select(F.col("word").alias("other"), F.col("n").alias("whole")), "other", "left")
    parts = lexicon.filter(F.col("n") >= least)
    h = h.join(parts.select(F.col("word").alias("left_word"), F.col("n").alias("nl")), "left_word", "left").join(parts.select(F.col("word").alias("right_part"), F.col("n").alias("nr")), F.regexp_replace("right_word", r"\^$", "") == F.col("right_part"), "left")
    joined, whole = F.coalesce("joined", F.lit(0)), F.coalesce("whole", F.lit(0))
    soft = F.col("left_word") == "¬"
    capital = F.col("right_word").endswith("^")
    unknown = (joined == 0) & (whole == 0) & ~capital & ~(F.col("nl").isNotNull() & F.col("nr").isNotNull())
    hyphenation = h.filter(soft | (joined > whole) | unknown).select("item_id", "left_word", F.regexp_replace("right_word", r"\^$", "").alias("right_word"), "word").distinct()

    # misread words: candidates are looked up in the lexicon, on distinct words only
    spaced = found.filter("kind = 's'").select("item_id", "word").distinct()
    mixed = found.filter("kind = 'm'").select("item_id", "word", "other", F.col("left_word").alias("after"), F.col("right_word").alias("body")).distinct()
    # digits within a word, rather than a code: at least three small letters, and more letters than digits; or cased as a
    # word with as many letters as digits, where the words beside it don't mostly stand by codes (nor, if there aren't more
    # letters than digits, by numbers)
    letters_in, digits_in = F.length(F.regexp_replace("word", r"[^\p{L}†]", "")), F.length(F.regexp_replace("word", r"\D", ""))
    wordlike = (F.length(F.regexp_replace("word", r"[^\p{Ll}†]", "")) >= 3) & (letters_in > digits_in)
    cased = F.col("word").rlike(r"^(?:[\p{Ll}\d†]+|[\p{Lu}\d†]+|[\p{Lu}\d†][\p{Ll}\d†]+)$") & F.col("word").rlike(r"[\d†]") & (F.length("word") >= 2) & (letters_in >= digits_in)
    numbers = found.filter("kind = 'p'").groupBy("word").agg(F.sum("n").alias("numbers"))
    beside = F.explode(F.array("other", "after")).alias("slot")
    sure = mixed.filter(~wordlike & ~cased).select("item_id", beside).distinct().groupBy("slot").agg(F.count("*").alias("sure"))
    slots = mixed.filter(~wordlike & cased).select(beside).filter("slot <> ''").distinct()
    slots = slots.join(lexicon.select(F.col("word").alias("w__"), F.col("n").alias("texts")), F.regexp_replace("slot", "[ #]", "") == F.col("w__"), "left")
    slots = slots.join(sure, "slot", "left").join(numbers.withColumnRenamed("word", "slot"), "slot", "left").fillna(0, ["sure", "texts", "numbers"])
    slots = cut(slots.select("slot", (F.col("sure") * ratio >= F.greatest("texts", F.lit(1))).alias("coded"), (2 * F.col("numbers") >= F.greatest("texts", F.lit(1))).alias("counted")).filter("coded or counted"), "slots")
    doubtful = mixed.filter(~wordlike & cased).withColumn("even", letters_in <= digits_in)
    for side in ("other", "after"):
        doubtful = doubtful.join(slots.select(F.col("slot").alias(side), F.col("coded").alias("c__"), F.col("counted").alias("n__")), side, "left")
        doubtful = doubtful.filter(~(F.coalesce("c__", F.lit(False)) | (F.col("even") & F.coalesce("n__", F.lit(False))))).drop("c__", "n__")
    worded = cut(mixed.filter(wordlike).select("item_id", "word", "body", F.lit(True).alias("sure")).unionByName(doubtful.select("item_id", "word", "body", F.lit(False).alias("sure"))).distinct(), "worded")
    known = lexicon.filter(F.col("n") >= least).select(F.col("word").alias("right"), F.col("n").alias("attested"))
    words = lexicon.filter(F.length("word") >= 2)  # a letter by itself is an initial or a mark
    # short words have many neighbours, so that more must speak for them; a word with digits must be the rarer one
    words = words.select("word", (F.col("n") * F.when(F.length("word") < 4, ratio * ratio).otherwise(ratio)).alias("n"))
    words = words.unionByName(worded.groupBy(F.lower("word").alias("word")).agg(F.when(F.max("sure"), 0).otherwise(F.count_distinct("body")).alias("n")))
    right = words.mapInPandas(_correct, _RIGHT).join(known, "right")
    many = words.filter(F.length(F.regexp_replace("word", r"[^\d†|]", "")) > LISTED).withColumn("form", canonical(F.col("word")))
    many = many.join(known.withColumn("form", canonical(F.col("right"))), "form").drop("form").mapInPandas(_reading, f"{_RIGHT}, attested bigint")
    right = right.select("word", "n", "right", "attested").unionByName(many.select("word", "n", "right", "attested")).filter(F.col("attested") >= F.col("n"))
    right = cut(right.groupBy("word").agg(F.max_by("right", F.struct("attested", "right")).alias("right")), "right")
    # a number with letters in it: only where numbers, rather than codes, follow the word before it
    digits = mixed.withColumn("right", F.translate("word", "OolIiSsBZbg", "00111558269")).filter(F.col("right").rlike(r"^\d+([.,]\d+)?$") & F.col("word").rlike(r"\d"))
    codes = mixed.select(F.explode(F.array("other", "after")).alias("word"), F.col("word").alias("token")).groupBy("word").agg(F.count("*").alias("codes"))
    usual = numbers.join(codes, "word").filter(F.col("numbers") >= F.greatest(F.lit(least), F.col("codes"))).select("word")
    usual = cut(usual, "usual")
    digits = digits.join(usual.withColumnRenamed("word", "other"), "other", "left_semi")
    digits = digits.filter("after = ''").unionByName(digits.join(usual.withColumnRenamed("word", "after"), "after", "left_semi")).select("item_id", "word", "right")
    in_words = worded.withColumn("low", F.lower("word")).join(right.select(F.col("word").alias("low"), "right"), "low").select("item_id", "word", "right").join(digits.select("item_id", "word"), ["item_id", "word"], "left_anti")
    letters = docs.select("item_id", F.explode(F.split("words", " ")).alias("word")).filter(F.length("word") >= 2).join(right, "word").select("item_id", "word", "right")
    apart = spaced.join(known.select(F.col("right").alias("word")), "word").select("item_id", F.regexp_replace("word", "(?<=.)(?=.)", " ").alias("word"), F.col("word").alias("right"))
    characters = letters.unionByName(in_words).unionByName(digits).unionByName(apart).distinct()
    return {"furniture": found.filter("kind = 'f'").select("item_id").distinct(), "hyphenation": hyphenation, "characters": characters, "model": model, "names": names}


def scan_damage(df: DataFrame, id_col: str, title_col: str, text_col: str, **how) -> DataFrame:
    """(item_id, damage), distinct: the kinds of scan damage of each text. See scan_findings."""
    found = scan_findings(df, id_col, title_col, text_col, **how)
    out = [found[k].select("item_id", F.lit(k).alias("damage")) for k in ("hyphenation", "characters", "furniture")]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def rebuild(text: str, labels: list[int], joins: set[tuple[str, str]], words: dict[str, str]) -> str:
    """The continuous paragraphs of a damaged text: body lines are joined, divided words are made whole where their two
    parts are in ``joins``, misread words are replaced by ``words``; headers go, breaks divide paragraphs."""
    lines = split_lines(text)
    paragraphs: list[list[str]] = [[]]
    glue = False
    pending_break = False
    for line, s in zip(lines, labels):
        bare = line.strip()
        if s == HEADER:
            continue
        if not bare:
            pending_break = True
            continue
        if not glue and pending_break and paragraphs[-1] and not bare[0].islower() and _END.search(paragraphs[-1][-1]) or not glue and paragraphs[-1] and line.lstrip("\x0c").startswith("   ") and _END.search(paragraphs[-1][-1]):
            paragraphs.append([])
        pending_break = False
        if glue:
            paragraphs[-1][-1] += bare
            glue = False
        else:
            paragraphs[-1].append(bare)
        tail = _TAIL.search(paragraphs[-1][-1])
        if tail:
            glue = True
            paragraphs[-1][-1] = paragraphs[-1][-1].rstrip()
    out = []
    for p in paragraphs:
        t = " ".join(p)
        t = re.sub(r"([^\W\d_]+)([-‐‑¬­])(?=([^\W\d_]+))", lambda m: m[1] if m[2] in "¬­" or (m[1].lower(), m[3].lower()) in joins else m[0], t)
        if words:
            t = _SPACED.sub(lambda m: _recase(m[0].replace(" ", ""), words.get(m[0].lower(), m[0])) if m[0].lower() in words else m[0], t)
            t = _MISREAD.sub(lambda m: _cased(m, words.get(m[0], words.get(m[0].lower(), m[0]))), t)
        out.append(t)
    return "\n\n".join(x for x in out if x)


def _recase(seen: str, right: str) -> str:
    return right.capitalize() if seen[:1].isupper() and right.islower() else right


def _cased(m: re.Match, right: str) -> str:
    """``right`` in the case of the misread word; a single capital tells it only together with the words beside it."""
    seen = m[0]
    if right == seen or not right.islower():
        return right
    capitals = [c for c in seen if c.isalpha()]
    if capitals and all(c.isupper() for c in capitals):
        beside = _LETTERS.findall(m.string[max(0, m.start() - 30) : m.start()])[-1:] + _LETTERS.findall(m.string[m.end() : m.end() + 30])[:1]
        if len(capitals) > 1 or not seen[0].isalpha() or any(len(w) > 1 and w.isupper() for w in beside):
            return right.upper()
    return _recase(seen, right)


def repair_scans(df: DataFrame, id_col: str, title_col: str, text_col: str, **how) -> DataFrame:
    """(item_id, repaired_text, damaged) of each distinct id and text. Texts without damage come out as they are."""
    found = scan_findings(df, id_col, title_col, text_col, **how)
    model, names = found["model"], found["names"]
    fixes = found["hyphenation"].select("item_id", F.concat_ws(" ", F.lit("h"), "left_word", "right_word", "word").alias("fix"))
    fixes = fixes.unionByName(found["characters"].select("item_id", F.concat_ws("\t", F.lit("c"), "word", "right").alias("fix"))).unionByName(found["furniture"].select("item_id", F.lit("f").alias("fix")))
    fixes = fixes.groupBy("item_id").agg(F.collect_set("fix").alias("fixes"))  # bounded by the words of one text
    slim = df.select(F.col(id_col).cast("string").alias("item_id"), F.col(title_col).alias("title"), F.col(text_col).alias("text")).dropDuplicates(["item_id"])

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = Labeller(model)
        for batch in batches:
            texts = []
            for title, text, fix in zip(batch["title"], batch["text"], batch["fixes"]):
                if fix is None or text is None or not len(fix):
                    texts.append(text)
                    continue
                divided = [f.split(" ") for f in fix if f[0] == "h"]
                joins = {(x[1], x[2]) for x in divided if len(x) == 4}
                words = dict(f.split("\t")[1:] for f in fix if f[0] == "c")
                texts.append(rebuild(text, label(line_features(split_lines(text), names, title_words(title))), joins, words))
            yield pd.DataFrame({"item_id": batch["item_id"], "repaired_text": texts, "damaged": [f is not None and len(f) > 0 for f in batch["fixes"]]})

    return slim.join(fixes, "item_id", "left").mapInPandas(mend, "item_id string, repaired_text string, damaged boolean")
