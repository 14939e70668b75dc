"""Near-duplicate texts by covering locality-sensitive hashing over min-hash sketches.

A sketch holds ``blocks`` x (2^(radius+1) - 1) min-hash symbols. In each block, the positions are the non-zero vectors
of {0,1}^(radius+1), and for each such vector v one table keeps the positions whose inner product with v is odd. For
any set of at most ``radius`` positions there is a v orthogonal to all of them, so two blocks that differ in at most
``radius`` symbols agree in all positions that some table keeps: they are sure to collide. By the pigeonhole principle
two sketches that differ in at most blocks x (radius+1) - 1 symbols have such a block. With 10 blocks of radius 2, that
is 29 of 70 symbols (a similarity of 0.6 differs in 28 on average); beyond it a collision is still likely (99.8% at a
similarity of 0.6, all but 6 in a million at 0.7). Every colliding pair is then checked on its whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.operators.components import connected_components
from lumbung.operators.pairs import pairs_within, sieve
from lumbung.session import cut

WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
#: Buckets above this many members are split into blocks of this size that are compared block by block.
BUCKET_BLOCK = 1024


class _WordHashes(dict):
    """64-bit hashes of words; emptied when large, so that a long task's memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def covering_masks(radius: int) -> list[list[int]]:
    """For each non-zero vector v of {0,1}^(radius+1): the positions 0 .. 2^(radius+1)-2 that its table keeps."""
    width = 1 << (radius + 1)
    return [[p - 1 for p in range(1, width) if bin(p & v).count("1") % 2] for v in range(1, width)]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the words' hashes. Fewer words give one shorter run."""
    if len(words) < size:
        words = np.concatenate([words, np.zeros(size - len(words), np.uint64)])
    n = len(words) - size + 1
    x = words[:n] * _MIX[0]
    for k in range(1, size):
        x = x + words[k : n + k] * _MIX[k]
        x ^= x >> np.uint64(29)
        x *= _MIX[(k + 3) % len(_MIX)]
    return x ^ (x >> np.uint64(32))


def _sketch(batches: Iterator[pd.DataFrame], blocks: int, radius: int, size: int, least: int) -> Iterator[pd.DataFrame]:
    masks = covering_masks(radius)
    width = (1 << (radius + 1)) - 1
    rng = np.random.default_rng(20240229)
    mul = rng.integers(1, 1 << 63, blocks * width, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, blocks * width, np.uint64)
    of = _WordHashes()
    sent: set[str] = set()
    for batch in batches:
        ids, texts = batch["item_id"].tolist(), batch["text"].tolist()
        if len(sent) > 1_000_000:  # a long task's memory is bounded; a repeat then only costs its keys
            sent.clear()
        for lo in range(0, len(ids), 512):  # so that the arrays of one step stay in the cache
            kept, counts, parts, content = [], [], [], []
            for key, text in zip(ids[lo : lo + 512], texts[lo : lo + 512]):
                words = WORD.findall(text.lower()) if text else []
                if key is None or len(words) < least:
                    continue
                kept.append(key)
                counts.append(len(words))
                content.append(xxhash.xxh3_128_hexdigest(" ".join(words)))
                parts.append(shingle_hashes(np.fromiter(map(of.__getitem__, words), np.uint64, len(words)), size))
            if not kept:
                continue
            x = np.concatenate(parts)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
            symbols = np.empty((blocks * width, len(kept)), np.uint64)
            for j in range(blocks * width):
                symbols[j] = np.minimum.reduceat((x * mul[j] + add[j]) >> np.uint64(32), starts)
            keys = np.empty((len(kept), blocks * len(masks)), np.uint64)
            for b in range(blocks):
                for m, mask in enumerate(masks):
                    h = np.full(len(kept), b * len(masks) + m + 1, np.uint64) * _MIX[0]
                    for p in mask:
                        h = (h ^ symbols[b * width + p]) * _MIX[1]
                        h ^= h >> np.uint64(31)
                    keys[:, b * len(masks) + m] = h
            fresh = []
            for c in content:
                fresh.append(c not in sent)
                sent.add(c)
            yield pd.DataFrame({"item_id": kept, "words": np.array(counts, np.int32), "content": content, "keys": [k if f else None for k, f in zip(keys.view(np.int64), fresh)]})


def sketch_texts(df: DataFrame, id_col: str, text_cols: list[str], *, blocks: int = 10, radius: int = 2, shingle: int = 3, min_words: int = 40) -> DataFrame:
    """(item_id, words, content, keys) of each row that has an id and at least ``min_words`` words in its text columns,
    which are joined by blanks in their order; nulls are left out. ``keys`` is null where a task has had the content."""
    slim = df.select(F.col(id_col).cast("string").alias("item_id"), F.concat_ws(" ", *text_cols).alias("text"))
    return slim.mapInPandas(lambda it: _sketch(it, blocks, radius, shingle, min_words), "item_id string, words int, content string, keys array<bigint>")


def _colliding(sketches: DataFrame) -> DataFrame:
    """Distinct pairs (da < db) of contents, as hashes, that share a bucket, however large the bucket.

    The keys go straight into their buckets: a content that several tasks have seen is there once for each, which only
    the buckets that are shared anyway are then rid of. Two contents of one 64-bit hash would be missed as a pair.
    """
    members = sketches.filter("keys is not null").select(F.xxhash64("content").alias("d"), F.explode("keys").alias("bucket"))
    # counted by an aggregate and joined back, so that a hot bucket is split over tasks as any skewed join; always by a
    # shuffle, as the sizes grow with the texts
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("parts"))
    shared = cut(members.join(sizes.hint("merge"), "bucket").distinct(), "buckets")
    left = shared.select("bucket", F.col("d").alias("da"), F.pmod(F.xxhash64("d"), "parts").cast("int").alias("part"))
    right = shared.select("bucket", F.col("d").alias("db"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["bucket", "part"]).filter("da < db").select("da", "db").distinct()


def _similar(batches: Iterator[pd.DataFrame], size: int, threshold: float) -> Iterator[pd.DataFrame]:
    of = _WordHashes()

    def grams(text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.unique(shingle_hashes(np.fromiter(map(of.__getitem__, words), np.uint64, len(words)), size))

    for batch in batches:
        known: dict[str, np.ndarray] = {}
        score = np.empty(len(batch))
        for k, (a, b, ta, tb) in enumerate(zip(batch["item_a"], batch["item_b"], batch["text_a"], batch["text_b"])):
            if a not in known:
                known[a] = grams(ta)
            if b not in known:
                known[b] = grams(tb)
            x, y = known[a], known[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            score[k] = both / (len(x) + len(y) - both)
        yield batch.assign(similarity=score).loc[score >= threshold, ["item_a", "item_b", "similarity"]]


def near_duplicate_classes(df: DataFrame, id_col: str, text_cols: list[str], *, threshold: float = 0.6, shingle: int = 3, min_words: int = 40, blocks: int = 10, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Members (item_id, class_id) of each class of texts with the same words, and links (item_a, item_b, similarity)
    between class representatives of which ``threshold`` of the distinct runs of ``shingle`` words are shared.

    ``class_id`` is the smallest id of the class. Rows that repeat an id count once (their texts are taken to be the
    same); a null id, and texts of fewer than ``min_words`` words (null and empty ones too), belong to no class.
    Columns other than those named are ignored. Nothing is dropped: any bucket size is compared in blocks.
    """
    sk = cut(sketch_texts(df, id_col, text_cols, blocks=blocks, radius=radius, shingle=shingle, min_words=min_words), "sketches")
    members = sk.groupBy("item_id").agg(F.min("content").alias("content"))
    classes = cut(members.groupBy("content").agg(F.min("item_id").alias("class_id")), "classes")
    members = cut(members.join(classes, "content").select("item_id", "class_id"), "members")
    pairs = _colliding(sk.select("content", "keys"))
    names = classes.select(F.xxhash64("content").alias("d"), "class_id")
    pairs = pairs.join(names.select(F.col("d").alias("da"), F.col("class_id").alias("x")), "da").join(names.select(F.col("d").alias("db"), F.col("class_id").alias("y")), "db")
    pairs = cut(pairs.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")), "pairs")
    # the texts of only those that have a partner, once each
    partners = pairs.select(F.explode(F.array("item_a", "item_b")).alias("item_id")).distinct()
    texts = df.select(F.col(id_col).cast("string").alias("item_id"), F.concat_ws(" ", *text_cols).alias("text"))
    partners = cut(partners, "partners")
    texts = cut(sieve(texts, "item_id", partners).join(partners, "item_id").dropDuplicates(["item_id"]), "texts")
    sides = pairs.join(texts.select(F.col("item_id").alias("item_a"), F.col("text").alias("text_a")), "item_a")
    sides = sides.join(texts.select(F.col("item_id").alias("item_b"), F.col("text").alias("text_b")), "item_b")
    links = sides.mapInPandas(lambda it: _similar(it, shingle, threshold), "item_a string, item_b string, similarity double")
    return members, cut(links, "links")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_cols: list[str], **how) -> DataFrame:
    """All pairs (item_a < item_b) of ids whose texts are near duplicates, copies included. See near_duplicate_classes."""
    members, links = near_duplicate_classes(df, id_col, text_cols, **how)
    left = members.select(F.col("class_id").alias("item_a"), F.col("item_id").alias("x"))
    right = members.select(F.col("class_id").alias("item_b"), F.col("item_id").alias("y"))
    across = links.join(left, "item_a").join(right, "item_b").select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    return across.unionByName(pairs_within(members, "class_id", "item_id").select(F.col("a").alias("item_a"), F.col("b").alias("item_b")))


def near_duplicate_groups(df: DataFrame, id_col: str, text_cols: list[str], **how) -> DataFrame:
    """One row per text of a class: (item_id, class_id, group_id, links). Groups are the connected components of the
    links; ``links`` counts the classes that the row's class is linked to; copies aren't expanded into pairs."""
    members, links = near_duplicate_classes(df, id_col, text_cols, **how)
    groups = connected_components(links.select(F.col("item_a").alias("a"), F.col("item_b").alias("b")))
    degree = links.select(F.explode(F.array("item_a", "item_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    out = members.join(groups.select(F.col("node").alias("class_id"), "component"), "class_id", "left").join(degree, "class_id", "left")
    return out.select("item_id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
