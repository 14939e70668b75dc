"""Cutting documents into chunks of sentences under a token limit, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.functions.rows import map_keyed

TARGET, OVERLAP, LEAST, MOST = 450, 80, 24, 512
# Abbreviations after which a full stop ends no sentence, and section headings.
ABBREVIATIONS = frozenset("fig figs tab no vol eq ref refs etc al dr prof mr mrs ms sr jr vs hlm dkk approx est i.e e.g cf pp ed eds inc ltd co st".split())
HEADINGS = (
    "ABSTRACT ABSTRAK INTRODUCTION PENDAHULUAN BACKGROUND LITERATURE\\s+REVIEW TINJAUAN\\s+PUSTAKA METHOD METHODS METHODOLOGY METODE METODOLOGI "
    "RESULT RESULTS RESULTS?\\s+AND\\s+DISCUSSIONS? HASIL HASIL\\s+DAN\\s+PEMBAHASAN DISCUSSION DISCUSSIONS PEMBAHASAN CONCLUSION CONCLUSIONS KESIMPULAN "
    "RECOMMENDATION RECOMMENDATIONS SARAN ACKNOWLEDGEMENT ACKNOWLEDGEMENTS ACKNOWLEDGMENT ACKNOWLEDGMENTS UCAPAN\\s+TERIMA\\s+KASIH"
).split(" ")
_HEADING = re.compile(rf"^\s*(?:\d+\.?\s*)?({'|'.join(HEADINGS)})\s*:?\s*$", re.I | re.M)
_BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9À-ɏ])")
CHUNKS = "chunk_index int, content string, char_start int, char_end int, token_count int, section string"


def tokens(text: str) -> int:
    """1.4 tokens a word, rounded down, plus one."""
    return int(len(text.split()) * 1.4) + 1


def sentence_spans(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Spans of the sentences within a paragraph. A full stop after an abbreviation or an initial ends none."""
    cuts, start = [], lo
    for m in _BOUNDARY.finditer(text, lo, hi):
        word = re.search(r"([A-Za-z.]+)\.$", text[start : m.start()])
        if word and (word[1].rstrip(".").lower() in ABBREVIATIONS or len(word[1].rstrip(".")) == 1):
            continue
        cuts.append((start, m.start()))
        start = m.end()
    cuts.append((start, hi))
    out = []
    for a, b in cuts:
        part = text[a:b]
        if part.strip():
            out.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
    return out


def _units(text: str, target: int) -> list[tuple[int, int]]:
    """Spans of sentences; one above the target is cut into runs of words."""
    out, at = [], 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        for a, b in sentence_spans(text, at, m.start() if m else len(text)):
            if tokens(text[a:b]) <= target:
                out.append((a, b))
                continue
            first, count = None, 0
            for w in re.finditer(r"\S+", text[a:b]):
                first = w.start() if first is None else first
                count += 1
                if int(count * 1.4) + 1 >= target:
                    out.append((a + first, a + w.end()))
                    first, count = None, 0
            if first is not None:
                out.append((a + first, b))
        at = m.end() if m else len(text)
    return out


def chunk_spans(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of the units of each chunk, from the units' sizes in tokens, none above ``target``: found by binary
    search in their prefix sums. A chunk ends where the next unit doesn't fit; the next one goes back over whole units of
    up to ``overlap`` tokens, as far as the new unit leaves room."""
    sums = [0, *accumulate(sizes)]
    out, first = [], 0
    while first < len(sizes):
        end = bisect_right(sums, sums[first] + target) - 1
        out.append((first, end))
        if end == len(sizes):
            break
        first = bisect_left(sums, sums[end] - max(0, min(overlap, target - sizes[end])))
    return out


def chunk_text(text: str | None, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[tuple]:
    """(content, char_start, char_end, token_count, section) of each chunk: whole sentences, runs of words of those above
    the target. No chunk has more than MOST tokens. A last chunk under ``least`` tokens is left out unless it is the only
    one, as too short to be found by itself; 0 keeps every one."""
    if not text or not text.strip():
        return
    target = min(target, MOST)
    units = _units(text, target)
    heads = [(m.start(), m[1].title()) for m in _HEADING.finditer(text)]
    spans = chunk_spans([tokens(text[a:b]) for a, b in units], target, overlap)
    for k, (first, end) in enumerate(spans):
        content = " ".join(text[a:b] for a, b in units[first:end])
        n = tokens(content)
        if n < least and k and k == len(spans) - 1:
            return
        at = bisect_right(heads, (units[first][0], chr(0x10FFFF)))
        yield content, units[first][0], units[end - 1][1], n, heads[at - 1][1] if at else None


def chunk_documents(df: DataFrame, id_col: str, text_cols: list[str], *, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(item_id, CHUNKS) of each row's first non-empty text column. A map over the rows; null and empty texts have none."""
    text = F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in text_cols))
    names = ["item_id", *(c.split()[0] for c in CHUNKS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, *c) for k, t in zip(b["item_id"], b["text"]) for i, c in enumerate(chunk_text(t, target, overlap, least))], columns=names)

    return map_keyed(df, id_col, {"text": text}, run, CHUNKS)


def pending_chunks(articles: DataFrame, chunks: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Articles without chunks, or whose text changed since (null-safe): what is to be chunked again."""
    done = chunks.groupBy("article_id").agg(F.max("chunked_hash").alias("chunked_hash"))
    joined = articles.join(done.withColumnRenamed("article_id", "id"), "id", "left")
    return joined.filter(~F.col(hash_col).eqNullSafe(F.col("chunked_hash"))).drop("chunked_hash")
