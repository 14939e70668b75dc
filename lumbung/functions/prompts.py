"""Assembling what an answering model reads: numbered sources, history, restated citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    """Text that can't be taken for a tag."""
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def source_block(sources: Column) -> Column:
    """An array of struct(index, title, year, content) as one block, in its order."""
    one = lambda s: F.concat(F.lit('<source index="'), s["index"].cast("string"), F.lit('" title="'), F.replace(escape(s["title"]), F.lit('"'), F.lit("&quot;")), F.lit('" year="'), F.coalesce(s["year"].cast("string"), F.lit("")), F.lit('">\n'), escape(s["content"]), F.lit("\n</source>"))
    return F.concat(F.lit("<sources>\n"), F.array_join(F.transform(sources, one), "\n"), F.lit("\n</sources>"))


def history_block(turns: Column, last: int = 6, most: int = 600) -> Column:
    """An array of struct(role, content) as lines: the last turns; answers are cut at ``most`` characters."""
    kept = F.slice(turns, F.greatest(F.size(turns) - last + 1, F.lit(1)), last)
    line = lambda t: F.concat(t["role"], F.lit(": "), F.when((t["role"] == "assistant") & (F.length(t["content"]) > most), F.concat(F.substring(t["content"], 1, most), F.lit("…"))).otherwise(t["content"]))
    return F.array_join(F.transform(kept, line), "\n")


def restate_citations(answer: Column, labels: Column) -> Column:
    """``[n]`` made ``[title, year]`` by an array of struct(index, title, year), titles cut at 60 characters, so that a
    later turn's numbers can't be mistaken for them."""
    label = lambda s: F.concat(F.lit("["), F.substring(F.coalesce(s["title"], F.lit("")), 1, 60), F.when(s["year"].isNotNull(), F.concat(F.lit(", "), s["year"].cast("string"))).otherwise(F.lit("")), F.lit("]"))
    return F.aggregate(labels, answer, lambda text, s: F.replace(text, F.concat(F.lit("["), s["index"].cast("string"), F.lit("]")), label(s)))
