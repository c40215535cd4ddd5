"""Tables of one row: set side by side, or given to every row of another table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*ones: DataFrame) -> DataFrame:
    """One row with the columns of all."""
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), ones)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def with_scalars(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows, each with the columns of a table of one row."""
    return rows.withColumn("_k", F.lit(1)).join(F.broadcast(one.limit(1).withColumn("_k", F.lit(1))), "_k").drop("_k")
