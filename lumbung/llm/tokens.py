"""Sizes of texts in tokens of a public byte-level BPE."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.functions.rows import map_keyed

#: A file of ranks in the usual form: a base64 token and its rank on each line. Every executor must have it there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's texts were cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item_id, tokens, and the columns of ``keep``) of each row. A null text counts 0. Special tokens' strings in a
    text are ordinary text. A map over the rows: no shuffle."""
    keep = keep or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(vocabulary)
        for b in batches:
            sizes = [len(code.encode_ordinary(t)) if t else 0 for t in b["text__"]]
            yield b.drop(columns="text__").assign(tokens=sizes)

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return map_keyed(df, id_col, {**{c: F.col(c) for c in keep}, "text__": F.col(text_col)}, run, f"{kinds}tokens bigint")
