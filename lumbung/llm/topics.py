"""Subject areas of documents, by classifier chains with beam search.

Stored labels are single, partly missing and partly wrong. They are taken for what they are: a document has a hidden set
of subjects, and its stored label is one of them, or, with a probability that is estimated too, any subject at all.

1. On a bounded sample of labelled documents, word n-grams that go with one stored label are found.
2. A sentence whose subject words disagree with its document's label far more often than others, by its remaining words
   ("... lie outside the scope"), is taken to mention them in passing; a logistic model of those words learns this. Words
   of such sentences are features of their own kind.
3. A chain of logistic models, each over term, source and structure features and the subjects before it in the chain, is
   fitted by expectation-maximisation: the chain's beam gives the likely label sets of each document, the stored label
   weighs them by the noise model, and the chain is fitted to the weighed sets. The terms of a document never label it:
   all that is known of its subjects from outside is the stored label, and what other documents' labels say.
4. The chain's probabilities are calibrated by a temperature under which stored labels of held-out documents are likeliest.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm.ftrl import Ftrl, Rows
from lumbung.operators.sampling import stratified_hash_sample

_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
BEAM = 6


def sentence_parts(title: str | None, abstract: str | None, common: frozenset[str] | set[str] = frozenset()) -> list[tuple[str, list[str]]]:
    """(text, words in lower case) of the title and of the abstract's sentences, without the names in the abstract:
    capitals within a sentence that isn't all capitals, but for words that are ``common`` in small letters."""
    out = [(title, _WORD.findall(title.lower()))] if title else []
    for s in _SENTENCE.split(abstract) if abstract else ():
        shouted = s.isupper()
        out.append((s, [w.lower() for i, w in enumerate(_WORD.findall(s)) if i == 0 or shouted or not w[0].isupper() or w.lower() in common]))
    return [x for x in out if x[1]]


def common_words(texts: list[str], least: int = 3) -> frozenset[str]:
    """Words that stand within sentences in small letters ``least`` times, and more often than with a capital."""
    small, capital = Counter(), Counter()
    for text in texts:
        for s in _SENTENCE.split(text):
            if not s.isupper():
                for w in _WORD.findall(s)[1:]:
                    (capital if w[0].isupper() else small)[w.lower()] += 1
    return frozenset(w for w, n in small.items() if n >= least and n > capital[w])


def term_grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


def frame_grams(words: list[str], topical: dict[str, int]) -> list[str]:
    """The n-grams of what is left of a sentence when its subject words are replaced by a mark."""
    left: list[str] = []
    k = 0
    while k < len(words):
        pair = f"{words[k]} {words[k + 1]}" if k + 1 < len(words) else ""
        if pair in topical:
            k += 2
            mark = True
        else:
            mark = words[k] in topical
            k += 1
        if not mark:
            left.append(words[k - 1])
        elif not left or left[-1] != "#":
            left.append("#")
    return [*(w for w in left if w != "#"), *map(" ".join, zip(left, left[1:])), *map(" ".join, zip(left, left[1:], left[2:]))]


@dataclass
class TopicModel:
    """What apply() needs: subjects in chain order, the subject words, the frame model and the chain."""

    topics: list[str]
    topical: dict[str, int]
    frame_index: dict[str, int]
    frame_weights: np.ndarray
    frame_bias: float
    passing: float
    index: dict[str, int]
    weights: np.ndarray  # features x topics
    links: np.ndarray  # earlier topic x later topic
    factor: float  # of the logits, by calibration
    noise: float  # how often a stored label is any at all
    common: frozenset[str]

    def in_passing(self, words: list[str]) -> bool:
        """Whether a sentence only mentions its subject words in passing."""
        rows = [self.frame_index[g] for g in frame_grams(words, self.topical) if g in self.frame_index]
        if not rows:
            return False
        x = self.frame_weights[rows].sum() / math.sqrt(len(rows)) + self.frame_bias
        return 1 / (1 + math.exp(-x)) < self.passing

    def features(self, title: str | None, abstract: str | None, source: str | None, kind: str | None) -> set[str]:
        """Subject words of the sentences, those only mentioned in passing apart; source and structure."""
        length = 0 if not abstract else 1 + min(3, len(abstract) // 250)
        found = {f"s:{source}", f"d:{kind}", f"n:{length}", f"h:{bool(title)}"}
        for _, words in sentence_parts(title, abstract, self.common):
            grams = term_grams(words)
            shown = [g for g in grams if g in self.topical]
            if shown:
                found |= {f"p:{g}" for g in shown} if self.in_passing(words) else {f"t:{g}" for g in shown}
        return found


def _passing_model(rows: list[tuple[list[tuple[str, list[str]]], int]], topical: dict[str, int]) -> tuple[dict[str, int], np.ndarray, float, float]:
    """Logistic model of frames: does a sentence's subject agree with the document's label? Returns index, weights, bias
    and the probability under which a sentence is in passing: half of what is usual."""
    samples = []
    df: Counter = Counter()
    for sents, label in rows:
        for _, words in sents:
            votes = Counter(topical[g] for g in term_grams(words) if g in topical)
            if votes:
                frame = frame_grams(words, topical)
                df.update(set(frame))
                samples.append((frame, float(votes.most_common(1)[0][0] == label or label in votes)))
    kept = [g for g, n in sorted(df.items()) if n >= 5]
    index = {g: i + 1 for i, g in enumerate(kept)}
    ftrl = Ftrl(len(kept) + 1, 1, alpha=0.5, l1=0.3, l2=0.3)
    rows_ = [np.unique(np.array([index[g] for g in frame if g in index] + [0])) for frame, _ in samples]
    frames = Rows(rows_, [np.where(r == 0, 1.0, 1 / math.sqrt(max(1, len(r) - 1))) for r in rows_])
    agrees = np.array([a for _, a in samples])
    rng = np.random.default_rng(11)
    for _ in range(4):
        for picked in _batches(rng, len(samples), 32):
            ftrl.batch(*frames.take(picked), lambda x, picked=picked: 1 / (1 + np.exp(-np.clip(x, -30, 30))) - agrees[picked][:, None])
    d = ftrl.weights()[:, 0]
    usual = agrees.mean() if len(agrees) else 1.0
    return index, d, float(d[0]), 0.5 * float(usual)


def _batches(rng: np.random.Generator, n: int, size: int) -> list[np.ndarray]:
    order = rng.permutation(n)
    return [order[lo : lo + size] for lo in range(0, n, size)]


def _topical(rows: list[tuple[list[tuple[str, list[str]]], int]], topics: int, purity: float, surprise: float = 6.5) -> dict[str, int]:
    """N-grams that go with one subject: ``purity`` of the distinct sentences that have one stand under that label, more
    than the subject's share by ``surprise`` standard deviations. Sentences that copies repeat count once."""
    counts: dict[str, Counter] = defaultdict(Counter)
    seen: set[str] = set()
    share: Counter = Counter()
    for sents, label in rows:
        for said, words in sents:
            if said in seen:
                continue
            seen.add(said)
            share[label] += 1
            for g in term_grams(words):
                counts[g][label] += 1
    total = max(1, sum(share.values()))
    least = max(5, total // 2000)
    out = {}
    for g, c in counts.items():
        n = sum(c.values())
        label, k = c.most_common(1)[0]
        p = share[label] / total
        if n >= least and k / n >= purity and k - n * p >= surprise * math.sqrt(n * p * (1 - p)):
            out[g] = label
    return out


def fit_topics(df: DataFrame, id_col: str, title_col: str, abstract_col: str, source_col: str, kind_col: str, label_col: str, topics: list[dict], *, per_topic: int = 500) -> TopicModel:
    """The model, from about ``per_topic`` documents of each subject by stored label (slug or label, in any spelling), at
    most twice as many.

    ``topics``: rows with slug, label_en, label_id and keywords; the keywords count as subject words.
    """
    spelling = {}
    for t in topics:
        for name in (t["slug"], t["label_en"], t["label_id"]):
            if name:
                spelling[re.sub(r"[\s_-]+", "-", name.strip().lower())] = t["slug"]
    pairs = F.create_map(*(F.lit(x) for k, v in sorted(spelling.items()) for x in (k, v))) if spelling else F.create_map().cast("map<string,string>")
    label = F.try_element_at(pairs, F.regexp_replace(F.lower(F.trim(F.col(label_col))), r"[\s_-]+", "-"))
    slim = df.select(F.col(id_col).cast("string").alias("i"), F.col(title_col).alias("t"), F.col(abstract_col).alias("a"), F.col(source_col).alias("s"), F.col(kind_col).alias("d"), label.alias("l")).filter("l is not null and i is not null")
    docs = {r["i"]: r for r in stratified_hash_sample(slim, "i", "l", per_topic).collect()}
    return fit_documents([docs[i].asDict() for i in sorted(docs)], topics)


def fit_documents(docs: list[dict], topics: list[dict]) -> TopicModel:
    """The model of documents with t (title), a (abstract), s (source), d (kind) and l (a slug, the stored label)."""
    slugs = [t["slug"] for t in topics]
    order = [s for s, _ in Counter(r["l"] for r in docs).most_common()]
    order += [s for s in slugs if s not in order]
    number = {s: i for i, s in enumerate(order)}
    common = common_words([r["a"] for r in docs if r["a"]])
    rows = [(sentence_parts(r["t"], r["a"], common), number[r["l"]]) for r in docs]

    stated = {" ".join(_WORD.findall(k.lower())): number[t["slug"]] for t in topics for k in t["keywords"] or ()}
    topical = _topical(rows, len(order), purity=0.4) | stated
    passing = _passing_model(rows, topical)
    model = TopicModel(order, topical, *passing, {}, np.zeros((1, len(order))), np.zeros((len(order), len(order))), 1.0, 0.0, common)
    # once more without the sentences in passing
    clean = [([(x, w) for x, w in sents if not (any(g in topical for g in term_grams(w)) and model.in_passing(w))], y) for sents, y in rows]
    model.topical = _topical(clean, len(order), purity=0.45) | stated
    model.frame_index, model.frame_weights, model.frame_bias, model.passing = _passing_model(rows, model.topical)

    samples = [model.features(r["t"], r["a"], r["s"], r["d"]) for r in docs]
    df_ = Counter(g for f in samples for g in f)
    model.index = {g: i + 1 for i, g in enumerate(g for g, n in sorted(df_.items()) if n >= 4)}
    ready = Rows([np.array(sorted({model.index[g] for g in f if g in model.index} | {0})) for f in samples])
    labels = np.array([y for _, y in rows], int)
    fold = np.array([int(hashlib.blake2b(f"{r['t']}\n{r['a']}".encode("utf-8", "surrogatepass"), digest_size=4).hexdigest(), 16) % 7 for r in docs], int)
    fit_chain(model, ready, labels, np.minimum((fold + 1) // 2, 3))
    return model


def set_likelihood(sets: np.ndarray, labels: np.ndarray, noise: float) -> np.ndarray:
    """P(stored label | label set) of ``sets`` (documents x sets x topics): one of the set, or with ``noise`` any."""
    k = sets.shape[2]
    holds = np.take_along_axis(sets, labels[:, None, None], axis=2)[:, :, 0]
    return (1 - noise) * holds / np.maximum(sets.sum(axis=2), 1) + noise / k


def posterior(base: np.ndarray, links: np.ndarray, factor: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The likely non-empty label sets of each row, and their probabilities by the chain."""
    sets, score = beam_sets(base, links, factor, width)
    score = np.where(sets.any(axis=2), score, -np.inf)
    none = ~np.isfinite(score).any(axis=1)
    if none.any():
        sets[none] = 0
        sets[np.flatnonzero(none), 0, base[none].argmax(axis=1)] = 1
        score[none, 0] = 0.0
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return sets, p / p.sum(axis=1, keepdims=True)


def _fit_once(k: int, features: int, rows: Rows, document: np.ndarray, target: np.ndarray, weight: np.ndarray, seed: int, epochs: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, links) of a chain on weighed label sets: ``target[j]`` is one of the sets of ``document[j]``."""
    later = np.triu(np.ones((k, k), bool), 1)
    terms, links = Ftrl(features, k, alpha=0.5, l1=8.0, l2=0.3), Ftrl(k, k, alpha=0.1, l1=0.2, l2=0.1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for picked in _batches(rng, len(document), min(64, max(8, len(document) // 100))):
            z, w = target[picked], weight[picked][:, None]
            before = z @ links.weights()
            errors: list[np.ndarray] = []

            def error(x: np.ndarray, before: np.ndarray = before, z: np.ndarray = z, w: np.ndarray = w, errors: list[np.ndarray] = errors) -> np.ndarray:
                errors.append((1 / (1 + np.exp(-np.clip(x + before, -30, 30))) - z) * w)
                return errors[0]

            terms.batch(*rows.take(document[picked]), error)
            at, which = np.nonzero(z)
            links.batch(which, z[at, which], np.searchsorted(at, np.arange(len(z))), lambda _, errors=errors: errors[0], later)
    return terms.weights(), links.weights() * later


def whole_labels(base: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logits of having a subject, from those of being labelled with it (topics as columns) on documents that the model
    hasn't seen: the probability is divided by what documents with the label get on average (Elkan and Noto)."""
    p = 1 / (1 + np.exp(-np.clip(base, -30, 30)))
    own = np.zeros_like(p, bool)
    own[np.arange(len(p)), labels] = True
    often = np.array([p[own[:, t], t].mean() if own[:, t].any() else 1.0 for t in range(p.shape[1])])
    q = np.clip(p / np.maximum(often, 0.1), 1e-6, 0.98)
    return np.log(q / (1 - q))


def fit_chain(model: TopicModel, rows: Rows, labels: np.ndarray, fold: np.ndarray, *, rounds: int = 8, width: int = 12) -> None:
    """Fits the chain of ``model`` by expectation-maximisation over hidden label sets, see the module. A document's sets
    are always weighed by a chain that was fitted without its ``fold`` (equal texts share one), so that a wrong label
    can't be learned by heart. Fold 0 is held out for the calibration."""
    k, features, n = len(model.topics), len(model.index) + 1, len(rows)
    if not n:
        return
    folds = sorted(set(fold[fold > 0].tolist()))
    fit = np.flatnonzero(fold > 0) if len(folds) > 1 else np.arange(n)
    held = np.flatnonzero(fold == 0) if len(folds) > 1 and (fold == 0).any() else fit
    sets, p, noise = np.eye(k)[labels[fit]][:, None, :], np.ones((len(fit), 1)), 0.2

    def chain(keep: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        at, which = np.nonzero((p > 0.02) & keep[:, None])
        return _fit_once(k, features, rows, fit[at], sets[at, which], p[at, which], seed)

    for turn in range(rounds):
        new_sets, new_p = np.zeros((len(fit), width, k)), np.zeros((len(fit), width))
        for f in folds if len(folds) > 1 else [0]:
            weights, links = chain(fold[fit] != f if len(folds) > 1 else np.ones(len(fit), bool), 13 + turn)
            own = np.flatnonzero(fold[fit] == f) if len(folds) > 1 else np.arange(len(fit))
            base = rows.dot(weights, fit[own])
            if not turn:  # fitted to single labels, one model a topic
                base, links = whole_labels(base, labels[fit[own]]), np.zeros((k, k))
            s, q = posterior(base, links, 1.0, width)
            new_sets[own, : s.shape[1]], new_p[own, : s.shape[1]] = s, q
        told = set_likelihood(new_sets, labels[fit], noise)
        sets, p = new_sets, new_p * told
        p /= p.sum(axis=1, keepdims=True)
        noise = float(np.clip((p * (noise / k) / told).sum(axis=1).mean(), 0.01, 0.6))
    model.weights, model.links = chain(np.ones(len(fit), bool), 11)
    model.noise = noise
    base = rows.dot(model.weights, held)

    def loss(log_t: float) -> float:
        sets, p = posterior(base, model.links, math.exp(log_t), width)
        return -float(np.log((p * set_likelihood(sets, labels[held], noise)).sum(axis=1)).mean())

    model.factor = math.exp(min(np.linspace(-1.5, 1.5, 31), key=loss))


def beam_sets(base: np.ndarray, links: np.ndarray, factor: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` likeliest label sets of each row of ``base`` (documents x topics), and the logs of their
    probabilities. All documents are decoded together."""
    n, k = base.shape
    chosen, score = np.zeros((n, 1, k)), np.zeros((n, 1))
    for t in range(k):
        x = (base[:, t][:, None] + chosen @ links[:, t]) * factor
        yes, no = -np.logaddexp(0, -x), -np.logaddexp(0, x)
        both = np.concatenate([chosen, chosen], axis=1)
        both[:, chosen.shape[1] :, t] = 1
        total = np.concatenate([score + no, score + yes], axis=1)
        keep = np.argsort(-total, axis=1, kind="stable")[:, :width]
        chosen, score = np.take_along_axis(both, keep[:, :, None], axis=1), np.take_along_axis(total, keep, axis=1)
    return chosen, score


def beam_decode(base: np.ndarray, links: np.ndarray, factor: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest non-empty label set of each row, and each topic's probability summed over the beam."""
    sets, p = posterior(base, links, factor, width)
    best = sets[np.arange(len(sets)), p.argmax(axis=1)]
    return best.astype(bool), (sets * p[:, :, None]).sum(axis=1)


_LABELS = "item_id string, topic_slug string, probability double"


def label_topics(df: DataFrame, id_col: str, title_col: str, abstract_col: str, source_col: str, kind_col: str, model: TopicModel) -> DataFrame:
    """(item_id, topic_slug, probability): one or more subjects of each row. A map over the rows: no shuffle.

    A null id has none. A row whose title and abstract are null, empty or without subject words still gets the subject
    that its source and structure make likeliest. Repeated rows give equal rows; other columns are ignored.
    """
    slim = df.select(F.col(id_col).cast("string").alias("item_id"), F.col(title_col).alias("title"), F.col(abstract_col).alias("abstract"), F.col(source_col).alias("source"), F.col(kind_col).alias("kind")).filter("item_id is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            base = np.zeros((len(b), len(model.topics)))
            for n, (title, abstract, source, kind) in enumerate(zip(b["title"], b["abstract"], b["source"], b["kind"])):
                rows = [model.index[g] for g in model.features(title, abstract, source, kind) if g in model.index]
                base[n] = model.weights[[*rows, 0]].sum(axis=0)
            best, marginal = beam_decode(base, model.links, model.factor)
            i, t = np.nonzero(best)
            yield pd.DataFrame({"item_id": b["item_id"].to_numpy()[i], "topic_slug": np.array(model.topics)[t], "probability": marginal[i, t]})

    return slim.mapInPandas(run, _LABELS)


def topic_composition(labels: DataFrame, weigh: str | None = None) -> DataFrame:
    """(topic_slug, documents, expected) of distinct labels: how many documents have a subject, and the sum of the
    calibrated probabilities."""
    return labels.groupBy("item_id", "topic_slug").agg(F.max("probability").alias("p")).groupBy("topic_slug").agg(F.count("*").alias("documents"), F.round(F.sum("p"), 3).alias("expected"))
