"""Connected components of an edge table by alternating star contraction.

Every partition first contracts its own edges to a forest (a map-side combine: copies, hot
vertices and cliques shrink to at most one edge per vertex), then rounds of large-star and
small-star link each vertex to the smallest vertex it knows. Neighbours are never gathered: a round is two
group-by minima and two joins on vertex keys, so a vertex with a third of all edges costs no more than
its edges. Rounds end when the edge set no longer changes; each is checkpointed. Where the forests of all partitions
together have at most ONE_TASK edges (16 MB), one task finishes them in the same way: the result is the same.
A hot vertex is spread over SALTS keys where its smallest neighbour is joined back to its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilegrain.session import cut


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) of the edges given, by vectorised hooking and pointer jumping."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(ids))
    while len(u):
        pu, pv = parent[u], parent[v]
        low, high = np.minimum(pu, pv), np.maximum(pu, pv)
        open_ = low != high
        if not open_.any():
            break
        u, v, low, high = u[open_], v[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return ids, ids[parent]


#: Edges of all partitions' forests that a single task finishes.
ONE_TASK = 1_000_000
#: Keys that a vertex's edges are spread over in joins.
SALTS = 8


def contract(edges: DataFrame) -> DataFrame:
    """(v, u) with u < v: a forest with the components of each partition's edges (columns a and b)."""

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forest, "v long, u long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size > 2_000_000:
            held, size = [_shrink(held)], 0
    if held:
        v, u = _shrink(held)
        for i in range(0, len(v), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 100_000]), pa.array(u[i : i + 100_000])], ["v", "u"])


def _shrink(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    v, u = local_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
    keep = v != u
    return v[keep], u[keep]


def beside(rows: DataFrame, key: str, told: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of told, which has one row per key: each of them is copied to SALTS keys, so that no task has all rows of a hot key."""
    copies = told.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [key, "_s"], how).drop("_s")


def _large_star(forest: DataFrame) -> DataFrame:
    """Each larger neighbour of v is linked to the smallest vertex in v's neighbourhood."""
    both = forest.union(forest.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    return beside(both.where("u > v"), "v", least).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v > u")


def _small_star(forest: DataFrame) -> DataFrame:
    """The smaller neighbours of v and v itself are linked to the smallest of them."""
    least = forest.groupBy("v").agg(F.min("u").alias("m"))
    linked = beside(forest, "v", least).where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return linked.union(least.select("v", F.col("m").alias("u")))


def components(edges: DataFrame, a: str = "a", b: str = "b", vertex: str = "vertex", label: str = "component", most_rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex with an edge to another; component is its smallest vertex.

    Nulls and loops are ignored, copies and either order allowed, an empty table gives an empty result.
    """
    forest = cut(contract(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")).distinct())
    seen = None
    if forest.count() <= ONE_TASK:
        whole = cut(forest.coalesce(1).mapInArrow(_forest, "v long, u long"))
        return whole.select(F.col("v").alias(vertex), F.col("u").alias(label)).union(whole.select(F.col("u").alias(vertex), F.col("u").alias(label)).distinct())
    for _ in range(most_rounds):
        forest = cut(_small_star(_large_star(forest)).distinct())
        now = forest.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == seen:
            return forest.select(F.col("v").alias(vertex), F.col("u").alias(label)).union(forest.select(F.col("u").alias(vertex), F.col("u").alias(label)).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def nested_components(graph: DataFrame, cuts: list[float], src: str = "src", dst: str = "dst", sim: str = "sim") -> Iterator[tuple[float, DataFrame]]:
    """(cut, (vertex, component)) of the edges at or above each cut, the strictest first: each starts from the components of the one before and adds only the edges between the two cuts."""
    held: DataFrame | None = None
    above: float | None = None
    for t in sorted(set(cuts), reverse=True):
        between = graph.where(F.col(sim) >= t) if above is None else graph.where((F.col(sim) >= t) & (F.col(sim) < above))
        edges = between.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        if held is not None:
            edges = edges.union(held.select(F.col("vertex").alias("a"), F.col("component").alias("b")))
        held, above = cut(components(edges)), t
        yield t, held
