"""Problem 7: capping records per dominant contributor.

Method: nested caps are a laminar matroid, so the greedy choice is right level by level: the best
records within the innermost contributor, then of what is left within the next, in successive
ranked window passes. A rank below a fixed cap is limited map-side before the shuffle, so a hot
contributor sends at most cap rows from each task.

Defined results: records without the exempting key are exempt; null and NaN scores rank last, equal scores by
smaller id; a null cap caps nothing; a cap written as a fraction is that share of all records given, cut to whole records; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


Level = tuple[list[str], "int | float | None"]


def counted(records: DataFrame, levels: list[Level]) -> list[Level]:
    """The levels with shares turned into counts of the records given."""
    if not any(isinstance(cap, float) for _, cap in levels):
        return levels
    total = records.count()
    return [(by, math.floor(cap * total + 1e-9) if isinstance(cap, float) else cap) for by, cap in levels]


def within(records: DataFrame, levels: list[Level], score: str, key: str) -> DataFrame:
    """The records that every cap keeps; innermost level first."""
    levels = counted(records, levels)
    best = [F.when(~F.isnan(score), F.col(score)).desc_nulls_last(), F.col(key).asc()]
    for by, cap in levels:
        if cap is not None:
            records = records.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("_rank") <= cap).drop("_rank")
    return records


def beyond(records: DataFrame, levels: list[Level], score: str, key: str) -> DataFrame:
    """The records that the caps remove."""
    slim = records.select(key, score, *dict.fromkeys(c for by, _ in levels for c in by))
    return records.join(within(slim, levels, score, key).select(key), key, "left_anti")


def day_of(written: Column) -> Column:
    """The first ten characters; null, blank and undated are one day."""
    bare = F.lower(F.trim(written))
    return F.when(written.isNull() | (bare == "") | (bare == "undated"), F.lit("undated")).otherwise(F.substring(F.trim(written), 1, 10))
