"""Language of texts and of their stretches, with a confidence.

A sparse multinomial logistic regression on TF-IDF character n-grams, trained by follow-the-regularised-leader with
elastic net on a bounded sample of labelled texts, then calibrated by a temperature. The stored labels are partly wrong:
after a first fit, training sentences that contradict their label are dropped and the model is fitted anew. Since the
n-grams stay within words and the scores are linear, a sentence's score is a sum over its words, and each distinct word
is scored once. Sentences are then labelled together by the likeliest sequence, in which changes of language are rare.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.functions.rows import map_keyed
from lumbung.llm.ftrl import Ftrl, Rows, softmax, temperature
from lumbung.operators.sampling import stratified_hash_sample

LANGUAGES = ("en", "id", "nl", "fr")

# Codes (ISO 639-1, -2, -3, withdrawn ones too) and names of languages.
CODES = {
    "en": ("en", "eng", "english", "inggris", "bahasa inggris", "engels", "anglais", "ingles", "englisch"),
    "id": ("id", "ind", "in", "indonesian", "indonesia", "bahasa indonesia", "bahasa", "indonesisch", "indonésien", "indonesien"),
    "nl": ("nl", "nld", "dut", "dutch", "belanda", "bahasa belanda", "nederlands", "néerlandais", "neerlandais", "flemish", "vlaams"),
    "fr": ("fr", "fra", "fre", "french", "prancis", "perancis", "bahasa prancis", "frans", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch", "jerman", "duits", "allemand"),
    "es": ("es", "spa", "spanish", "español", "espanol", "spanyol", "spaans", "espagnol"),
    "pt": ("pt", "por", "portuguese", "português", "portugis", "portugees", "portugais"),
    "it": ("it", "ita", "italian", "italiano", "italia", "italiaans", "italien"),
    "ms": ("ms", "msa", "may", "malay", "melayu", "bahasa melayu", "maleis", "malais"),
    "jv": ("jv", "jav", "jw", "javanese", "jawa", "javaans"),
    "ja": ("ja", "jpn", "japanese", "jepang"),
    "zh": ("zh", "zho", "chi", "chinese", "mandarin"),
    "ar": ("ar", "ara", "arabic", "arab"),
    "ru": ("ru", "rus", "russian", "rusia"),
}
_BY_CODE = {c: k for k, names in CODES.items() for c in names}

#: Letters in a row; not those within codes and digests, which mix them with digits.
WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)*(?!\w)")
_STOP = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+(?=[\"“‘«(\[]*[^\W_])|\n[^\S\n]*\n\s*")
#: A longer stretch without a full stop is cut into windows of this many words.
WINDOW = 16
#: Sentences of fewer words tell little by themselves: what they say weighs less, so that they mostly go with their
#: neighbours. A sentence only counts as one of the language that is likeliest by its own words too.
LEAST_WORDS = 4
_SWITCH = math.log(0.1)


def language_code(name: str | None) -> str | None:
    """The code that a stored language stands for, whatever its case, region or spelling; None if it names none."""
    if name is None:
        return None
    plain = name.strip().casefold()
    return _BY_CODE.get(plain) or _BY_CODE.get(re.split(r"[-_@. (]", plain, maxsplit=1)[0] if plain else "")


def language_code_column(column: str) -> F.Column:
    """:func:`language_code` as a column."""
    pairs = F.create_map(*(F.lit(x) for c, k in _BY_CODE.items() for x in (c, k)))
    plain = F.lower(F.trim(F.col(column)))
    return F.coalesce(F.try_element_at(pairs, plain), F.try_element_at(pairs, F.regexp_extract(plain, r"^([^-_@. (]*)", 1)))


def grams(word: str) -> list[str]:
    """Character n-grams of a word (1 to 4 letters, with its bounds), and the word itself."""
    w = f"_{word}_"
    return [*word, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)), w]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words in lower case) of the sentences of a text; long stretches are cut into windows."""
    out, at = [], 0
    for m in [*_STOP.finditer(text), None]:
        end = m.start() if m else len(text)
        words = WORD.findall(text[at:end].lower())
        if len(words) > 3 * WINDOW:
            found = list(WORD.finditer(text, at, end))
            parts = max(2, round(len(found) / WINDOW))
            cuts = [len(found) * i // parts for i in range(parts + 1)]
            for lo, hi in zip(cuts, cuts[1:]):
                out.append((at if lo == 0 else found[lo].start(), end if hi == len(found) else found[hi].start(), [w[0].lower() for w in found[lo:hi]]))
        elif words:
            out.append((at, end, words))
        at = m.end() if m else end
    return out


@dataclass
class LanguageModel:
    """Weights of n-grams, already times their inverse document frequency; rows of ``weights`` by ``index``."""

    index: dict[str, int]
    weights: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    factor: float

    def word(self, word: str) -> np.ndarray:
        """Sum of the scores of a word's n-grams, and last the sum of their weights in the length of the text."""
        rows = [self.index[g] for g in grams(word) if g in self.index]
        out = np.zeros(len(LANGUAGES) + 1)
        if rows:
            out[:-1] = self.weights[rows].sum(axis=0)
            out[-1] = self.idf[rows].sum()
        return out


class Scorer:
    """Scores of many sentences at once; each distinct word is scored once and kept, up to a bound."""

    def __init__(self, model: LanguageModel, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES) + 1))

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """Calibrated log probabilities of each word list (none may be empty)."""
        if len(self.rows) > self.most:
            self.rows.clear()
        rows = self.rows
        flat = []
        for words in texts:
            for w in words:
                r = rows.get(w)
                if r is None:
                    r = rows[w] = len(rows)
                    if r >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[r] = self.model.word(w)
                flat.append(r)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
        sums = np.add.reduceat(self.table[np.array(flat)], starts, axis=0)
        logits = (sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9) * _SCALE + self.model.bias) * self.model.factor
        return np.log(np.maximum(softmax(logits), 1e-6))


#: The length of a sample's feature vector.
_SCALE = 20.0


class _Trainer:
    """Feature vectors of sentences, made once, for several fits."""

    def __init__(self, samples: list[tuple[list[str], int]], most_grams: int = 60_000) -> None:
        df = Counter(g for words, _ in samples for g in {g for w in set(words) for g in grams(w)})
        self.grams = [g for g, n in sorted(df.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:most_grams]
        self.index = {g: i + 1 for i, g in enumerate(self.grams)}  # row 0 is the bias
        self.idf = np.array([0.0, *(math.log((1 + len(samples)) / (1 + df[g])) + 0.3 for g in self.grams)])
        vectors = [self.vector(words) for words, _ in samples]
        self.rows = Rows([r for r, _ in vectors], [v for _, v in vectors])
        self.labels = np.array([y for _, y in samples], int)

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        index = self.index
        tf = Counter(index[g] for w in words for g in grams(w) if g in index)
        rows = np.fromiter(tf, np.int64, len(tf))
        values = np.fromiter(tf.values(), float, len(tf)) * self.idf[rows]
        return np.append(rows, 0), np.append(values / max(values.sum(), 1e-9) * _SCALE, 1.0)

    def fit(self, picked: list[int], epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
        """(weights, temperature); a tenth of the picked samples is held out for the temperature."""
        ftrl = Ftrl(len(self.grams) + 1, len(LANGUAGES), alpha=1.0, l1=0.01, l2=0.01)
        eye, rng = np.eye(len(LANGUAGES)), np.random.default_rng(seed)
        held, fit = np.array(picked[::10], int), np.array([i for k, i in enumerate(picked) if k % 10], int)
        for _ in range(epochs):
            order = rng.permutation(fit)
            for lo in range(0, len(order), 8):
                some = order[lo : lo + 8]
                ftrl.batch(*self.rows.take(some), lambda x, some=some: softmax(x) - eye[self.labels[some]])
        w = ftrl.weights()
        return w, min(temperature(self.rows.dot(w, held), self.labels[held]), 6.0)

    def model(self, w: np.ndarray, factor: float) -> LanguageModel:
        return LanguageModel({g: i for i, g in enumerate(self.grams)}, w[1:] * self.idf[1:, None], self.idf[1:], w[0], factor)


#: A label of less probability than this is contradicted by its sentence.
CONTRADICTED = 0.2


def train(samples: list[tuple[list[str], int]], *, texts: list[int] | None = None, cleanings: int = 3) -> LanguageModel:
    """Fits the model on (words, language index) of sentences. Labels may be wrong: after each of ``cleanings`` first
    fits, the sentences that contradict theirs are left out of the next fit. ``texts``: the number of the text that each
    sentence is of, by default its own."""
    trainer = _Trainer(samples)
    half = np.array(texts if texts is not None else range(len(samples)), int) % 2
    labels = trainer.labels
    everything = list(range(len(samples)))
    picked = everything
    for turn in range(cleanings):
        # every sentence is judged by a model that hasn't seen its text
        own = np.empty(len(labels))
        for side in (0, 1):
            w, factor = trainer.fit([i for i in picked if half[i] != side], 2, 7 + turn)
            other = np.flatnonzero(half == side)
            own[other] = softmax(trainer.rows.dot(w, other) * factor)[np.arange(len(other)), labels[other]]
        # a class that would lose most of its sentences isn't known well enough yet to be cleaned
        bad = {y: np.mean(own[labels == y] < CONTRADICTED) for y in set(labels.tolist())}
        picked = [i for i in everything if own[i] >= CONTRADICTED or bad[int(labels[i])] > 0.6]
    return trainer.model(*trainer.fit(picked, 3))


def fit_language_model(df: DataFrame, id_col: str, text_col: str, label_col: str, *, per_language: int = 400, most_sentences: int = 6, extra: list[tuple[str, str]] | None = None) -> LanguageModel:
    """The model, from about ``per_language`` texts of each stored language, those of ids with low hashes: of each,
    ``most_sentences`` sentences spread over the text. ``extra``: more (text, language) samples."""
    labelled = df.select(F.col(id_col).cast("string").alias("i"), language_code_column(label_col).alias("l"), F.col(text_col).alias("x")).filter(F.col("l").isin(*LANGUAGES) & F.col("x").isNotNull() & F.col("i").isNotNull())
    rows = {r["i"]: (r["x"], r["l"]) for r in stratified_hash_sample(labelled, "i", "l", per_language).collect()}
    samples, texts = [], []
    for number, (text, code) in enumerate([*(rows[i] for i in sorted(rows)), *(extra or [])]):
        found = [w for *_, w in sentences(text) if len(w) >= LEAST_WORDS]
        taken = found[:: max(1, len(found) // most_sentences)]
        samples += [(w, LANGUAGES.index(code)) for w in taken]
        texts += [number] * len(taken)
    return train(samples, texts=texts) if samples else LanguageModel({}, np.zeros((0, len(LANGUAGES))), np.zeros(0), np.zeros(len(LANGUAGES)), 1.0)


def _paths(logp: np.ndarray) -> list[int]:
    """The likeliest sequence of languages, changes being rare."""
    score, back = logp[0], []
    for row in logp[1:]:
        stay, best = score, int(score.argmax())
        change = score[best] + _SWITCH
        back.append(np.where(stay >= change, np.arange(len(row)), best))
        score = np.maximum(stay, change) + row
    s = int(score.argmax())
    path = [s]
    for b in reversed(back):
        s = int(b[s])
        path.append(s)
    return path[::-1]


_SEGMENTS = "segment_index int, char_start int, char_end int, sentences int, text_language string, confidence double"


def _segments(batches: Iterator[pd.DataFrame], model: LanguageModel) -> Iterator[pd.DataFrame]:
    if not model.index:  # nothing was there to learn from
        return
    score = Scorer(model)
    names = ["item_id", *(c.split()[0] for c in _SEGMENTS.split(", "))]
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.iloc[lo : lo + 500]
            keys, spans, words = [], [], []
            for key, text in zip(part["item_id"], part["text"]):
                if key is None or not text:
                    continue
                found = [s for s in sentences(text) if s[2]]
                if found:
                    keys.append(key)
                    spans.append(found)
                    words += [w for *_, w in found]
            if not keys:
                continue
            logp, at, out = score(words), 0, []
            for key, found in zip(keys, spans):
                own = logp[at : at + len(found)]
                at += len(found)
                size = np.array([len(w) for *_, w in found])
                path = _paths(own * np.minimum(1.0, size / LEAST_WORDS)[:, None] ** 2)
                counted = own.argmax(axis=1) == path
                k, n = 0, 0
                while k < len(path):
                    end = k
                    while end + 1 < len(path) and path[end + 1] == path[k]:
                        end += 1
                    p = own[k : end + 1]
                    out.append((key, n, found[k][0], found[end][1], int(counted[k : end + 1].sum()), LANGUAGES[path[k]], float(np.exp(p[:, path[k]]).mean())))
                    k, n = end + 1, n + 1
            yield pd.DataFrame(out, columns=names)


def label_segments(df: DataFrame, id_col: str, text_col: str, model: LanguageModel) -> DataFrame:
    """One row for each stretch of each text in one language: (item_id, segment_index, char_start, char_end, sentences,
    text_language, confidence). A map over the rows: no shuffle.

    A null id, and a text that is null, empty or without letters, has no stretch; nor has any with a model of no samples; repeated rows give equal rows; very long
    texts are one row's work; an empty table gives an empty one; other columns are ignored.
    """
    return map_keyed(df, id_col, {"text": F.col(text_col)}, lambda it: _segments(it, model), _SEGMENTS, drop_null=True)


def label_texts(segments: DataFrame) -> DataFrame:
    """(item_id, text_language, confidence, languages) of each text, from its distinct stretches: the language of most
    sentences, and all languages with two sentences in a row."""
    by = segments.distinct().groupBy("item_id", "text_language").agg(F.sum("sentences").alias("n"), F.max("sentences").alias("run"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"))
    out = by.groupBy("item_id").agg(F.max_by(F.struct("text_language", "confidence"), F.struct("n", "text_language")).alias("m"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sort_array(F.collect_set(F.when(F.col("run") >= 2, F.col("text_language")))).alias("languages"))
    return out.select("item_id", F.col("m.text_language").alias("text_language"), (F.col("m.confidence") * F.col("most") / F.col("all")).alias("confidence"), "languages")


def language_errors(df: DataFrame, id_col: str, text_col: str, label_col: str, model: LanguageModel) -> DataFrame:
    """(item_id, text_language), distinct: for texts whose stored language is missing or names none, names one that the
    text isn't written in, or whose text is in several: each language with at least two sentences in a row."""
    runs = label_segments(df.filter(F.col(text_col).isNotNull()), id_col, text_col, model).filter("sentences >= 2").groupBy("item_id").agg(F.collect_set("text_language").alias("languages"))
    stored = df.select(F.col(id_col).alias("item_id"), language_code_column(label_col).alias("stored")).groupBy("item_id").agg(F.min("stored").alias("stored"))
    wrong = F.col("stored").isNull() | (F.size("languages") > 1) | ~F.array_contains("languages", F.coalesce("stored", F.lit("")))
    return runs.join(stored, "item_id").filter(wrong).select("item_id", F.explode("languages").alias("text_language"))
