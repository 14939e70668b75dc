"""Spreading work: pairs within groups of any size, and maps that cost time rather than bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups above this many members are compared in blocks of this size, so that no task has a whole hot group.
BLOCK = 1024


def pairs_within(members: DataFrame, key: str, value: str, block: int | None = None) -> DataFrame:
    """(``key``, a < b): all pairs of different values of one key, each once if the rows of ``members`` are distinct.

    A group's sizes are counted by an aggregate; a group above ``block`` members is cut into parts by a hash of the
    value, and every part meets all parts of its group in a task of its own. Null keys and values have no pair.
    """
    block = block or BLOCK
    m = members.select(F.col(key).alias("k__"), F.col(value).alias("v__")).filter("k__ is not null and v__ is not null")
    sizes = m.groupBy("k__").agg(F.count("*").alias("n")).filter("n > 1").select("k__", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    m = m.join(sizes.hint("merge"), "k__")
    left = m.select("k__", F.col("v__").alias("a"), F.pmod(F.xxhash64("v__"), "parts").cast("int").alias("part"))
    right = m.select("k__", F.col("v__").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["k__", "part"]).filter("a < b").select(F.col("k__").alias(key), "a", "b")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over two tasks a core, by an explicit count, which adaptive execution doesn't merge by bytes: for maps over
    few bytes that cost much time. ``by``: columns whose equal values go together, where a task can reuse their work."""
    return df.repartition(max(1, 2 * df.sparkSession.sparkContext.defaultParallelism), *by)


#: Bits of a sieve at most: 8 MB, whatever the data.
SIEVE_BITS = 1 << 26


def sieve(df: DataFrame, key: str, wanted: DataFrame, *, most_bits: int = SIEVE_BITS) -> DataFrame:
    """``df`` without most of the rows whose ``key`` isn't in ``wanted`` (a column of the same name): all that are in it, and
    a few that aren't. To be followed by the exact join, which then shuffles less: an inner join with the distinct keys, as
    the optimizer would do a left semi join before the sieve.

    The keys of ``wanted`` set bits of a bitmap by their hash, about eight bits a key and ``most_bits`` at most; the bitmap,
    never more than 8 MB, is broadcast. Beyond eight million keys it lets more and more through, and in the end all.
    """
    bits = min(most_bits, max(1 << 15, 1 << (8 * wanted.count()).bit_length()))
    at = (F.pmod(F.xxhash64(key), F.lit(bits)) + 1).alias("at__")
    marks = wanted.select(at).groupBy(F.bitmap_bucket_number("at__").alias("bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at__")).alias("map__"))
    rows = df.withColumn("at__", at).withColumn("bucket__", F.bitmap_bucket_number("at__")).withColumn("bit__", F.bitmap_bit_position("at__"))
    byte = F.conv(F.hex(F.substring("map__", (F.col("bit__") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), F.col("bit__") % 8).cast("int")) != 0
    return rows.join(F.broadcast(marks), "bucket__").filter(hit).select(*df.columns)
