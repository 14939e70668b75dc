"""Mixing sources to target shares of all tokens.

Every text gets a random key from a hash, by which the texts of a source are ordered. The running sum of tokens in that
order is computed in three levels, over groups of ranges of the key, over the ranges of a group and within a range, so that
no task has more than a part of a source. Each source is used as often in full as its budget needs, then up to the text at
which the budget is met; where that text is too large, later texts that still fit take what is left of the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbung.llm.tokens import VOCABULARY, count_tokens
from lumbung.session import cut


#: Random keys are below this; texts of equal keys go by their ids.
KEYS = 1 << 48
#: Ranges in a group of them, for the running sums.
GROUP = 1024
#: How often what is left of the budgets is filled with later texts.
FILLINGS = 2


def source_budgets(available: dict[str, int], targets: list[dict], total_tokens: int | None = None) -> list[dict]:
    """The token budget of each target source. Without ``total_tokens``, the largest collection in which all shares are
    exactly as wanted: the source that is exhausted first, with its repeats, sets the size. With it, the sources that
    can't give their share give all that they may, and the others' budgets stay what they are."""
    wanted = [t for t in targets if t["source"] is not None and (t["target_share"] or 0) > 0]
    most = {t["source"]: available.get(t["source"], 0) * max(0, t["max_repeats"] or 0) for t in wanted}
    able = [t for t in wanted if most[t["source"]] > 0]
    share = sum(t["target_share"] for t in able) or 1.0
    if total_tokens is None:
        total_tokens = min((math.floor(most[t["source"]] * share / t["target_share"]) for t in able), default=0)
    out = []
    for t in targets:
        s = t["source"]
        rate = t["target_share"] / share if t in able else 0.0
        out.append({"source": s, "target_share": t["target_share"], "max_repeats": t["max_repeats"], "available_tokens": available.get(s, 0), "budget_tokens": min(round(total_tokens * rate), most.get(s, 0))})
    return out


def running_sums(sized: DataFrame, range_items: int) -> DataFrame:
    """``sized`` (source, mix_key, item_id, tokens, copy, and more) with ``at``, the tokens of the source before each text
    in the order of the keys."""
    ranges = max(1, math.ceil(sized.count() / range_items))
    wide = KEYS // ranges + 1
    ranged = sized.withColumn("range", F.floor(F.col("mix_key") / wide).cast("int"))
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("n")).withColumn("group", F.floor(F.col("range") / GROUP).cast("int"))
    groups = sums.groupBy("source", "group").agg(F.sum("n").alias("g"))
    groups = groups.select("source", "group", (F.sum("g").over(Window.partitionBy("source").orderBy("group")) - F.col("g")).alias("earlier"))
    before = sums.select("source", "group", "range", (F.sum("n").over(Window.partitionBy("source", "group").orderBy("range")) - F.col("n")).alias("before"))
    before = before.join(groups, ["source", "group"]).select("source", "range", (F.col("before") + F.col("earlier")).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("mix_key", "item_id", "tokens", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["source", "range"])
    return placed.withColumn("at", F.col("before") + F.col("inside")).drop("range", "inside", "before")


def mix_sources(df: DataFrame, id_col: str, text_col: str, source_col: str, targets: list[dict], *, total_tokens: int | None = None, range_items: int = 4096, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The collection (item_id, source, epoch, tokens, mix_key), one row for each use of a text, and the report (source,
    target_share, max_repeats, available_tokens, budget_tokens, reached_tokens, reached_share, texts, uses, unused_tokens,
    limits_total).

    A source's sum stays within its budget; but the smallest text of a source is used if there is any budget, so that no
    source with texts is lost. ``limits_total`` marks the source that is exhausted first and so sets the size of all,
    where no total is wanted; ``unused_tokens`` is what is left of a source. Texts of no target source, with
    a null source, or without tokens aren't used; repeated rows are texts of their own; an empty table gives an empty
    collection and a report of zeros; other columns are ignored.
    """
    spark = df.sparkSession
    names = [t["source"] for t in targets if t["source"] is not None]
    rows = df.filter(F.col(source_col).isin(names)).select(F.col(id_col).alias("id__"), F.col(source_col).alias("source"), F.col(text_col).alias("t__"))
    sized = count_tokens(rows, "id__", "t__", keep=["source"], vocabulary=vocabulary).filter("tokens > 0")
    # equal rows are numbered, so that each is a text of its own
    sized = sized.groupBy("item_id", "source", "tokens").agg(F.count("*").alias("n")).select("item_id", "source", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    sized = cut(sized.withColumn("mix_key", F.pmod(F.xxhash64("item_id", "source", "copy"), F.lit(KEYS))), "sized")
    totals = {r["source"]: (r["n"], r["k"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).collect()}
    budgets = source_budgets({s: n for s, (n, _) in totals.items()}, targets, total_tokens)
    plan = []
    for b in budgets:
        available = b["available_tokens"]
        if available and b["budget_tokens"]:
            times = min(b["budget_tokens"] // available, b["max_repeats"])
            plan.append((b["source"], int(times), int(b["budget_tokens"] - times * available), bool(times >= b["max_repeats"])))
    plan_df = spark.createDataFrame(plan, "source string, times int, remainder bigint, used_up boolean")

    used = running_sums(sized, range_items).join(plan_df, "source")
    part = ~F.col("used_up") & (F.col("remainder") > 0)
    again = part & (F.col("at") + F.col("tokens") <= F.col("remainder"))
    used = cut(used.withColumn("again", again), "used")
    # what the text at the cut leaves is filled by later texts that fit into it; then the next nearest, once
    for turn in range(FILLINGS):
        gap = used.groupBy("source").agg(F.first("remainder").alias("r"), F.sum(F.when(F.col("again"), F.col("tokens")).otherwise(0)).alias("s")).select("source", (F.col("r") - F.col("s")).alias("gap")).filter("gap > 0")
        free = used.filter(~F.col("again") & part).join(gap, "source").filter(F.col("tokens") <= F.col("gap")).select("item_id", "source", "tokens", "mix_key", "copy", "gap")
        more = running_sums(free, range_items).filter(F.col("at") + F.col("tokens") <= F.col("gap")).select("source", "item_id", "tokens", "copy", F.lit(True).alias("more"))
        keys = [F.col(f"u.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("source", "item_id", "tokens", "copy")]
        used = cut(used.alias("u").join(more.alias("m"), keys[0] & keys[1] & keys[2] & keys[3], "left").select(*(f"u.{c}" for c in used.columns if c != "again"), (F.col("u.again") | F.col("m.more").isNotNull()).alias("again")), "used")
    # at least one text of each source with a budget
    first = used.filter(part & (F.col("times") == 0)).groupBy("source").agg(F.max("again").alias("any"), F.min(F.struct("tokens", "mix_key", "item_id", "copy")).alias("least")).filter("not any").select("source", "least")
    used = used.join(first, "source", "left").withColumn("again", F.col("again") | F.coalesce(F.struct("tokens", "mix_key", "item_id", "copy") == F.col("least"), F.lit(False)))
    used = used.withColumn("uses", F.col("times") + F.when(F.col("again"), 1).otherwise(0)).filter("uses > 0")
    collection = used.select("item_id", "source", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("epoch"), "tokens", "mix_key")
    collection = cut(collection, "mix")

    got = collection.groupBy("source").agg(F.sum("tokens").alias("reached_tokens"), F.count_distinct("item_id").alias("texts"), F.count("*").alias("uses"), F.sum(F.when(F.col("epoch") == 1, F.col("tokens"))).alias("once"))
    base = spark.createDataFrame([(b["source"], b["target_share"], b["max_repeats"], int(b["available_tokens"]), int(b["budget_tokens"]), total_tokens is None and b["budget_tokens"] > 0 and b["budget_tokens"] >= b["available_tokens"] * (b["max_repeats"] or 0)) for b in budgets], "source string, target_share double, max_repeats int, available_tokens bigint, budget_tokens bigint, limits_total boolean")
    report = base.join(got, "source", "left").fillna(0, ["reached_tokens", "texts", "uses", "once"])
    total = report.agg(F.greatest(F.sum("reached_tokens"), F.lit(1)).alias("total")).scalar()
    report = report.select("source", "target_share", "max_repeats", "available_tokens", "budget_tokens", "reached_tokens", F.round(F.col("reached_tokens") / total, 6).alias("reached_share"), "texts", "uses", (F.col("available_tokens") - F.col("once")).alias("unused_tokens"), "limits_total")
    return collection, report
