"""Bounded samples that don't depend on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 40


def hash_below(key: str, share: float) -> Column:
    """True for about ``share`` of the values of ``key``, always the same ones."""
    return F.pmod(F.xxhash64(key), F.lit(_SPACE)) < F.lit(min(_SPACE, int(_SPACE * share)))


def hash_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows: those whose key has one of the lowest hashes; all rows if there aren't more.

    The count reads what the filters of ``df`` need; the rows are then filtered where they lie. What comes out depends on
    the keys only, not on partitions or order; its size varies by about the root of ``size``, and by what repeated keys
    add, as equal keys go together.
    """
    rows = df.count()
    return df if rows <= size else df.filter(hash_below(key, size / rows))


def stratified_hash_sample(df: DataFrame, key: str, group: str, size: int, *, most_groups: int = 10_000) -> DataFrame:
    """About ``size`` rows of each non-null value of ``group``, as hash_sample. More than ``most_groups`` values are
    refused: each is a condition of the filter."""
    counts = {r[group]: r["n"] for r in df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).limit(most_groups + 1).collect()}
    if len(counts) > most_groups:
        raise ValueError(f"more than {most_groups} values of {group}")
    wanted = F.lit(False)
    for value, rows in sorted(counts.items()):
        wanted = wanted | ((F.col(group) == value) & hash_below(key, min(1.0, size / rows)))
    return df.filter(wanted)
