"""Ranks and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.operators.components import beside
from pilegrain.session import cut


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in a total order: a range-partitioned sort, the rows counted per partition, and an offset for each."""
    place = F.monotonically_increasing_id()
    held = cut(rows.orderBy(*order).withColumn("_p", F.shiftright(place, 33)).withColumn("_i", place.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = held.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return held.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i") + 1).drop("_p", "_i", "_o")


def running_sum(rows: DataFrame, rank: str, sums: dict[str, str], block: int = 100_000) -> DataFrame:
    """rows with running sums along rank: blocks of ranks are summed first, so that no window spans the table."""
    blocked = rows.withColumn("_b", F.floor((F.col(rank) - 1) / block))
    totals = blocked.groupBy("_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = Window.orderBy("_b")
    offsets = totals.select("_b", *[(F.sum(f"_t{i}").over(before) - F.col(f"_t{i}")).alias(f"_o{i}") for i in range(len(sums))])
    within = Window.partitionBy("_b").orderBy(rank)
    joined = blocked.join(offsets, "_b")
    for i, (name, c) in enumerate(sums.items()):
        joined = joined.withColumn(name, F.sum(c).over(within) + F.col(f"_o{i}"))
    return joined.drop("_b", *[f"_o{i}" for i in range(len(sums))])


def group_median(rows: DataFrame, by: str, value: str, name: str, bins: int = 1024) -> DataFrame:
    """(by, rows, name): how many rows each group has and the exact median of its values, null where it has none.

    The counts of bins between a group's least and largest value tell in which bins the middle lies; only these are sorted, so no task
    holds a group. NaN counts as no value.
    """
    v = F.when(~F.isnan(value), F.col(value))
    held = rows.select(by, v.cast("double").alias("_v"))
    ends = cut(held.groupBy(by).agg(F.count("*").alias("rows"), F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    known = ends.where("_n > 0").select(by, "_n", "_lo", "_hi")
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(F.lit(0)).cast("int")
    placed = beside(held.where("_v IS NOT NULL"), by, known).withColumn("_b", place)
    counts = placed.groupBy(by, "_b", "_n").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(by).orderBy("_b")) - F.col("_k")  # at most so many bins a group
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    within = lambda at: (at >= F.col("_before")) & (at < F.col("_before") + F.col("_k"))
    wanted = counts.withColumn("_before", before).where(within(low) | within(high)).select(by, "_b", "_before")
    order = Window.partitionBy(by, "_b").orderBy("_v")
    sought = placed.join(wanted, [by, "_b"]).withColumn("_at", F.col("_before") + F.row_number().over(order) - 1).where((F.col("_at") == low) | (F.col("_at") == high))
    middle = sought.groupBy(by).agg(F.avg("_v").alias(name))
    return ends.select(by, "rows").join(middle, by, "left")
