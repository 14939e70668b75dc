"""Row-wise maps in Python that keep a key's type."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_keyed(df: DataFrame, key: str, columns: dict[str, Column], f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, *, drop_null: bool = False) -> DataFrame:
    """``f`` over batches of (item_id, columns), where item_id is the key as a string (None for null); the result's
    item_id, which ``schema`` leaves out, gets the key's type again. A number column with nulls would reach pandas as
    floats, in which large keys aren't exact."""
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).cast("string").alias("item_id"), *(c.alias(n) for n, c in columns.items()))
    if drop_null:
        slim = slim.filter("item_id is not null")
    out = slim.mapInPandas(f, f"item_id string, {schema}")
    return out if kind == "string" else out.withColumn("item_id", F.col("item_id").cast(kind))
