"""Reading the Parquet tables and resolving the current row of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, keys: list[str], latest: str, keep: list[str]) -> DataFrame:
    """One row per key: the one with the latest time (null times are oldest; equal times fall to the largest values).

    A max over a struct combines map-side, so copies and hot keys shrink before the shuffle.
    Rows with a null in any key are dropped. Only keys and keep are read.
    """
    keep = [c for c in keep if c not in keys]
    best = F.max(F.struct(F.col(latest).alias("_t"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(keep)])).alias("_best")
    known = df.dropna(subset=keys).groupBy(*keys).agg(best)
    return known.select(*keys, *[F.col(f"_best._v{i}").alias(c) for i, c in enumerate(keep)])
