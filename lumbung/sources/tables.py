"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table. Zone-less timestamps become UTC timestamps, so that all comparisons have one type."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def read_dimension(spark: SparkSession, sf_dir: str, name: str, most_rows: int = 10_000) -> list:
    """The rows of a small, fixed table (sources, topics, targets, limits), on the driver. Refuses a larger one."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"{name} has more than {most_rows} rows; it can't be used as a dimension")
    return rows
