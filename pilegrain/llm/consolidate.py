"""Problem 5: pairwise matches consolidated into groups.

Method: vertices of degree one are stripped and chains of degree two compressed by list ranking in rounds on the pairs
themselves: a vertex of degree two or less leaves when its rank, degree first and then a random number, is below that of each
such neighbour (an independent set, so all leaves but one of a pair and about a third of a chain go each round); it is hooked to
a neighbour and, with two neighbours, leaves an edge between them. Rounds end when fewer than a fifth of the edges go. The
reduced core is solved by star contraction and the removed vertices get their labels back along their hooks, the
last round first, each from labels that are already there.

Scale: degrees, neighbours and ranks are minima and counts that combine map-side; edges are
dropped by the pair as key, so a hub with a third of all pairs is never a join key of its edges. Hooks are joined once each;
where they hang on one hub they meet a table of one row per vertex, which adaptive execution splits, and the label of a giant
group is joined back on salted keys. Nothing is collected; each round is checkpointed to the shared folder.

Defined results: null ends and loops are ignored, either order and copies allowed, an empty table gives an empty
result, extra columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pilegrain.operators.components import beside, components
from pilegrain.session import cut


def _rank(v: str, turn: int) -> Column:
    return F.struct("d", F.xxhash64(F.col(v), F.lit(turn)).alias("h"), F.col(v).alias("v"))


def consolidate(pairs: DataFrame, a: str, b: str, vertex: str = "vertex", group: str = "group_id", most_rounds: int = 40, least_gain: float = 0.2) -> DataFrame:
    """(vertex, group): the smallest vertex linked directly or indirectly, for every vertex with a pair."""
    x, y = F.col(a), F.col(b)
    edges = cut(pairs.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
    left, hooks = edges.count(), []
    while left and len(hooks) < most_rounds:  # what the rounds leave is the core's
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("e")).select("e.*")
        info = ends.groupBy("v").agg(F.count("*").alias("d"), F.min("n").alias("n1"), F.max("n").alias("n2"))
        low = cut(info.where("d <= 2").withColumn("p", _rank("v", len(hooks))))
        rival = low.select(F.explode(F.array_distinct(F.array("n1", "n2"))).alias("v"), "p").groupBy("v").agg(F.min("p").alias("rival"))
        gone = cut(low.join(rival, "v", "left").where("rival IS NULL OR p < rival").select("v", "d", "n1", "n2"))
        if gone.count() < max(1, least_gain * left):
            break
        hooks.append(gone.select("v", F.col("n1").alias("up")))
        cutting = gone.select(F.explode(F.array_distinct(F.array(*[F.struct(F.least("v", n).alias("a"), F.greatest("v", n).alias("b")) for n in ("n1", "n2")]))).alias("e")).select("e.*")
        bridges = gone.where("d = 2").select(F.col("n1").alias("a"), F.col("n2").alias("b"))
        edges = cut(edges.join(cutting, ["a", "b"], "left_anti").union(bridges).distinct())
        left = edges.count()
    labels = components(edges, vertex="v", label="l")
    for hook in reversed(hooks):
        told = cut(hook.join(labels.withColumnRenamed("v", "up"), "up", "left"))
        alone = told.where("l IS NULL").select(F.col("up").alias("v"), F.col("up").alias("l")).distinct()  # hooked to a vertex that lost its last edge
        labels = labels.union(told.select("v", F.coalesce("l", "up").alias("l"))).union(alone)
    labels = cut(labels)
    least = labels.groupBy("l").agg(F.min("v").alias("least"))
    return beside(labels, "l", least).select(F.col("v").alias(vertex), F.col("least").alias(group))
