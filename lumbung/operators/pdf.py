"""Cleaning of text extracted from PDF pages, as column expressions over an array of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_LINES, EDGE_LENGTH, REFERENCES_FROM, LEAST_CHARS, LEAST_ALPHA = 2, 120, 0.40, 500, 0.60
_REFERENCES = r"(?im)^[ \t]*(?:\d+\.?[ \t]*)?(?:references|bibliography|daftar[ \t]+pustaka|referensi|rujukan)[ \t]*:?[ \t]*$"


def _edges(page: Column) -> Column:
    lines = F.filter(F.transform(F.split(page, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    ends = F.concat(F.slice(lines, 1, EDGE_LINES), F.slice(lines, F.greatest(F.size(lines) - EDGE_LINES + 1, F.lit(1)), EDGE_LINES))
    return F.array_distinct(F.filter(ends, lambda x: F.length(x) < EDGE_LENGTH))


def running_lines(pages: Column) -> Column:
    """Lines at the edges of at least 60 % of three or more pages (two at least)."""
    edges = F.array_sort(F.flatten(F.transform(pages, _edges)))
    most = F.greatest(F.lit(2), F.floor(F.size(pages) * 0.6).cast("int"))
    # in their order, a line that is there so often stands again so many places on
    often = F.array_distinct(F.filter(edges, lambda x, i: F.coalesce(F.get(edges, i + most - 1) == x, F.lit(False))))
    return F.when(F.size(pages) >= 3, often).otherwise(F.array().cast("array<string>"))


def join_pages(pages: Column) -> Column:
    """The body of a document: no running lines, no lines of page numbers, divided words joined."""
    running = running_lines(pages)
    kept = F.transform(pages, lambda p: F.array_join(F.filter(F.split(p, "\n"), lambda x: ~F.array_contains(running, F.trim(x)) & ~x.rlike(r"^\s*\d{1,4}\s*$")), "\n"))
    text = F.array_join(kept, "\n\n")
    return F.trim(F.regexp_replace(text, r"(\p{L}+)-[ \t]*\n\s*(\p{L}+)", "$1$2"))


def without_references(text: Column) -> Column:
    """The text up to its last reference heading, if that stands after 40 % of it."""
    parts = F.split(text, _REFERENCES)
    tail = F.element_at(parts, -1)
    heading = F.element_at(F.regexp_extract_all(text, F.lit(f"({_REFERENCES})"), 1), -1)
    at = F.length(text) - F.length(tail) - F.length(heading)
    return F.when((F.size(parts) > 1) & (at >= F.length(text) * REFERENCES_FROM), F.regexp_replace(F.substring(text, F.lit(1), at), r"\s+$", "")).otherwise(text)


def quality(text: Column) -> Column:
    """'extracted' for a text of at least 500 characters, 60 % of them letters or blanks; else 'poor'."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return F.when((F.length(text) >= LEAST_CHARS) & (kept >= F.length(text) * LEAST_ALPHA), "extracted").otherwise("poor")
