"""Filling sequences of a fixed size with texts, by multiway number differencing.

Karmarkar-Karp: each item starts as a partition of its own, of which one part has the item and the others nothing. The
two partitions of the widest spread are merged again and again, the largest parts of the one with the smallest of the
other, until one is left: its parts are nearly equal. If one of them exceeds the size, there must be more parts.

Items are first spread over shards by a hash; the number of shards grows with the items, so that a shard's work is
bounded however many there are, and each shard leaves less than about one sequence of room.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm.tokens import VOCABULARY, count_tokens
from lumbung.session import cut


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part (0 .. parts-1) of each item, by Karmarkar-Karp multiway differencing."""
    if parts <= 1 or not sizes:
        return [0] * len(sizes)
    # a partition: sums of its parts in falling order less the smallest, and for each part the items as a linked list
    after = [-1] * len(sizes)  # next item in the same part
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, np.array([s], np.int64), np.array([i]), np.array([i])))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, sa, ha, ta = heapq.heappop(heap)
        _, _, sb, hb, tb = heapq.heappop(heap)
        # only parts that hold something are kept; all others are equal to zero, or to the least
        if len(sa) + len(sb) <= parts:  # none need share
            s, h, t = np.concatenate([sa, sb]), np.concatenate([ha, hb]), np.concatenate([ta, tb])
        else:
            # the largest parts of a with the smallest of b
            pa, pb = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
            pa[: len(sa)] = sa
            pb[parts - len(sb) :] = sb[::-1]
            s = pa + pb
            h, t = np.full(parts, -1), np.full(parts, -1)
            h[: len(ha)], t[: len(ta)] = ha, ta
            lo = parts - len(sb)
            for k in range(lo, parts):
                j = parts - 1 - k
                if h[k] >= 0:
                    after[t[k]] = int(hb[j])
                    t[k] = tb[j]
                else:
                    h[k], t[k] = hb[j], tb[j]
        order = np.argsort(-s, kind="stable")
        s, h, t = s[order], h[order], t[order]
        if len(s) == parts:
            s = s - s[-1]
        spread = int(s[0] - (s[-1] if len(s) == parts else 0))
        heapq.heappush(heap, (-spread, count, s, h, t))
        count += 1
    part = [0] * len(sizes)
    for k, head in enumerate(heap[0][3]):
        i = int(head)
        while i >= 0:
            part[i] = k
            i = after[i]
    return part


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item (none larger than ``capacity``): as few as differencing can fill without excess."""
    total = sum(sizes)
    parts = max(1, math.ceil(total / capacity))
    while True:
        part = difference(sizes, parts)
        sums = np.bincount(np.array(part, int), weights=np.array(sizes, float), minlength=parts) if sizes else np.zeros(1)
        over = np.maximum(sums - capacity, 0).sum()
        if over <= 0:
            return part
        if parts >= len(sizes):
            return list(range(len(sizes)))
        parts = min(len(sizes), parts + max(1, math.ceil(over / capacity)))


_PACKED = "item_id string, part_index int, token_start bigint, token_end bigint, tokens bigint, sequence_id string"


def pack_sequences(df: DataFrame, id_col: str, text_col: str, *, capacity: int, shard_items: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item_id, part_index, token_start, token_end, tokens, sequence_id): every text in sequences of at most
    ``capacity`` tokens. Only a text larger than that is divided: into full sequences and a rest that is packed.

    Shards hold about ``shard_items`` items each. A null or empty text has no token and so no sequence, but comes out once
    with a null sequence_id and 0 tokens; repeated rows are packed each; a null id is kept; an empty table gives an
    empty one; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = df.schema[id_col].dataType.simpleString()
    # rows that repeat an id are told apart by their number in it, which no split of the input changes: they only differ
    # in their size
    sized = cut(count_tokens(df, id_col, text_col, vocabulary=vocabulary), "sizes")
    again = sized.groupBy("item_id", "tokens").agg(F.count("*").alias("times"))
    sized = again.select("item_id", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("copy"))
    n = sized.count()
    shards = max(1, math.ceil(n / shard_items))
    # a large text's full sequences need no packing
    full = F.floor(F.col("tokens") / capacity).cast("bigint")
    cuts = F.sequence(F.lit(0).cast("bigint"), F.greatest(full - F.when(F.col("tokens") % capacity == 0, 1).otherwise(0), F.lit(0)).cast("bigint"))
    parts = sized.select("item_id", "copy", F.col("tokens").alias("all"), F.posexplode(cuts).alias("part_index", "k"))
    parts = parts.select("item_id", "copy", "all", "part_index", (F.col("k") * capacity).alias("token_start"), F.least(F.col("all"), (F.col("k") + 1) * capacity).alias("token_end"))
    parts = parts.withColumn("tokens", F.col("token_end") - F.col("token_start"))
    whole = (F.col("tokens") == capacity) | (F.col("tokens") == 0)
    alone = parts.filter(whole).withColumn("sequence_id", F.when(F.col("tokens") > 0, F.concat_ws("-", F.lit("f"), F.col("item_id").cast("string"), F.col("part_index").cast("string"), F.col("all").cast("string"), F.col("copy").cast("string"))))
    rest = parts.filter(~whole).withColumn("shard", F.pmod(F.xxhash64("item_id", "part_index", "all", "copy"), F.lit(shards)).cast("int"))

    def fill(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["tokens", "item_id", "part_index", "copy"], ascending=[False, True, True, True])
        part = pack(items["tokens"].tolist(), capacity)
        return items.drop(columns=["shard", "copy", "all"]).assign(sequence_id=[f"s{key[0]}-{p}" for p in part])

    # about one shard a task: a shard is few bytes but much work, and an explicit count isn't merged by bytes
    tasks = min(shards, max(1, 64 * df.sparkSession.sparkContext.defaultParallelism))
    packed = rest.withColumn("item_id", F.col("item_id").cast("string")).repartition(tasks, "shard").groupBy("shard").applyInPandas(fill, _PACKED).withColumn("item_id", F.col("item_id").cast(kind))
    return packed.unionByName(alone.select("item_id", "part_index", "token_start", "token_end", "tokens", "sequence_id"))


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(sequences, tokens, room, fill, fullest): how well the sequences are filled."""
    by = packed.filter("sequence_id is not null").groupBy("sequence_id").agg(F.sum("tokens").alias("n"))
    return by.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.max("n").alias("fullest")).select("sequences", "tokens", (F.col("sequences") * capacity - F.col("tokens")).alias("room"), F.round(F.col("tokens") / (F.col("sequences") * capacity), 4).alias("fill"), "fullest")
