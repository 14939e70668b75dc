"""Splitting texts that exceed a size limit at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.functions.rows import map_keyed

#: Strongest first: after a blank line, after a sentence, after a line. The weakest boundary is where a token begins.
BOUNDARIES = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"[.!?…][\"'”’»)\]]*\s+"), re.compile(r"\n\s*"))
_TOKEN = re.compile(r"\s*\S+\s*")
_MARKS = re.compile(r"[̀-ͯ‍️]")

PIECE_SCHEMA = "piece_index int, char_start int, char_end int, piece_text string, piece_size int, chunk_count int"


def token_starts(text: str) -> list[int]:
    """Prefix sums of the lengths of the tokens, each with the blanks after it: where every token begins, and the end."""
    offsets, at = [0], 0
    for m in _TOKEN.finditer(text):
        at = m.end()
        offsets.append(at)
    if offsets[-1] != len(text):
        offsets.append(len(text))
    return offsets


def split_spans(text: str, max_size: int, overlap: int, unit: str = "characters") -> list[tuple[int, int]]:
    """Character spans of the pieces of ``text``.

    A piece holds at most ``max_size`` units and ends at the last boundary of the strongest kind that lies in the later
    half of what fits, or else by a hard cut at the limit. Each piece after the first begins ``overlap`` units before
    the end of the one before. Units are code points or blank-separated ``words``. An empty text has no piece.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and less than max_size")
    if not text:
        return []
    if unit not in ("words", "characters"):
        raise ValueError(f"no such unit: {unit}")
    if len(text) <= max_size:  # no unit is shorter than a character
        return [(0, len(text))]
    starts = token_starts(text)  # prefix sums of the tokens' lengths
    words = unit == "words"
    size = len(starts) - 1 if words else len(text)
    if size <= max_size:
        return [(0, len(text))]
    to_char: Callable[[int], int] = starts.__getitem__ if words else int
    to_unit: Callable[[int], int] = (lambda c: bisect_right(starts, c) - 1) if words else int
    # sorted boundaries of each kind; where a token ends, the next begins
    ends = [*([m.end() for m in b.finditer(text)] for b in BOUNDARIES), starts[1:-1] + ([len(text)] if text[-1].isspace() else [])]
    spans, start = [], 0
    while True:
        limit = start + max_size
        if limit >= size:
            spans.append((to_char(start), len(text)))
            return spans
        least = start + max(overlap + 1, max_size // 2)
        end = None
        for kind in ends:
            k = bisect_right(kind, to_char(limit)) - 1
            if k >= 0 and kind[k] >= to_char(least):
                end = to_unit(kind[k])
                break
        if end is None or end <= start + overlap:
            end = limit
            if not words:  # not between a letter and its marks
                while end > least and _MARKS.match(text[end]):
                    end -= 1
        spans.append((to_char(start), to_char(end)))
        start = end - overlap


def _rows(batches: Iterator[pd.DataFrame], max_size: int, overlap: int, unit: str, texts: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, out = batch.columns[0], []
        for key, text in zip(batch[keys], batch[batch.columns[1]]):
            spans = split_spans(text, max_size, overlap, unit) if isinstance(text, str) else []
            if not texts:
                out.append((key, len(spans)))
            else:
                for k, (a, b) in enumerate(spans):
                    piece = text[a:b]
                    out.append((key, k, a, b, piece, len(piece) if unit == "characters" else len(piece.split()), len(spans)))
        names = [keys, "chunk_count"] if not texts else [keys, *(c.split()[0] for c in PIECE_SCHEMA.split(", "))]
        yield pd.DataFrame(out, columns=names)


def split_pieces(df: DataFrame, id_col: str, text_col: str, *, max_size: int, overlap: int, unit: str = "characters") -> DataFrame:
    """Ordered pieces of each text: the id and PIECE_SCHEMA. A row-wise map: no shuffle, any text length.

    Other columns are ignored, so clashing names don't matter. A null or empty text has no piece, a null id stays null,
    repeated rows give repeated pieces, and an empty table gives an empty one.
    """
    return map_keyed(df, id_col, {"text": F.col(text_col)}, lambda it: _rows(it, max_size, overlap, unit, True), PIECE_SCHEMA)


def count_pieces(df: DataFrame, id_col: str, text_col: str, *, max_size: int, overlap: int, unit: str = "characters") -> DataFrame:
    """(item_id, chunk_count) of each row: how many pieces :func:`split_pieces` makes. Null or empty texts count 0."""
    return map_keyed(df, id_col, {"text": F.col(text_col)}, lambda it: _rows(it, max_size, overlap, unit, False), "chunk_count int")
