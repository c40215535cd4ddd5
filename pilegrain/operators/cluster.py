"""Grouping vectors: a registry of strategies over one similarity graph.

components scales with the edges. whispers and linkage never leave a connected component, so each
component is its own task; hdbscan needs the whole table in one task and refuses more rows than its limit.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilegrain.operators.components import components
from pilegrain.operators.vectors import neighbour_graph
from pilegrain.session import cut

ONE_TASK = 200_000


def by_components(vectors: DataFrame, graph: DataFrame, **_) -> DataFrame:
    """(id, label): connected groups of two or more; the label is the smallest id, noise is -1."""
    groups = components(graph, "src", "dst", "id", "label")
    return vectors.select("id").join(groups, "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def _per_component(vectors: DataFrame, graph: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], limit: int = 20 * ONE_TASK) -> DataFrame:
    """run on the edges of each component in a task of its own; a component of more edges than limit is refused, never cut."""
    groups = components(graph, "src", "dst", "id", "comp")
    rows = cut(graph.join(groups.withColumnRenamed("id", "src"), "src"))
    most = rows.groupBy("comp").count().agg(F.max("count")).first()[0] or 0
    if most > limit:
        raise ValueError(f"a component of {most} edges does not fit one task; raise the threshold or use components")
    labels = rows.groupBy("comp").applyInPandas(run, "id long, label long")
    return vectors.select("id").join(labels, "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def by_whispers(vectors: DataFrame, graph: DataFrame, rounds: int = 20, seed: int = 1, **_) -> DataFrame:
    """(id, label): asynchronous label propagation, each vertex taking the label of most weight among its neighbours, the lowest on ties.

    Vertices are visited in a seeded order of each component, so the groups do not depend on other components; groups of one are noise.
    """

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["src", "dst"])
        ids, flat = np.unique(np.concatenate([edges.src, edges.dst]), return_inverse=True)
        a, b, w = flat[: len(edges)], flat[len(edges) :], edges.sim.to_numpy()
        near: list[list[tuple[int, float]]] = [[] for _ in ids]
        for i, j, x in zip(a, b, w, strict=True):
            near[i].append((j, x))
            near[j].append((i, x))
        label = np.arange(len(ids))
        rng = np.random.default_rng([seed, int(ids[0]) & 0xFFFFFFFF])
        for _ in range(rounds):
            changed = False
            for i in rng.permutation(len(ids)):
                weight: dict[int, float] = {}
                for j, x in near[i]:
                    weight[label[j]] = weight.get(label[j], 0.0) + x
                best = min(weight, key=lambda k: (-weight[k], k))
                changed |= best != label[i]
                label[i] = best
            if not changed:
                break
        return _named(ids, label)

    return _per_component(vectors, graph, run)


def by_linkage(vectors: DataFrame, graph: DataFrame, distance: float = 0.8, **_) -> DataFrame:
    """(id, label): average linkage along the graph's edges while the mean distance of two groups (1 - cosine, 1 where no edge joins a pair) stays below distance."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["src", "dst"])
        ids, flat = np.unique(np.concatenate([edges.src, edges.dst]), return_inverse=True)
        links: list[dict[int, float]] = [{} for _ in ids]
        for i, j, x in zip(flat[: len(edges)].tolist(), flat[len(edges) :].tolist(), edges.sim.tolist(), strict=True):
            links[i][j] = links[j][i] = x
        size, into = [1] * len(ids), list(range(len(ids)))
        apart = lambda i, j: 1 - links[i][j] / (size[i] * size[j])
        heap = [(apart(i, j), i, j) for i in range(len(ids)) for j in links[i] if i < j]
        heapq.heapify(heap)
        while heap:
            d, i, j = heapq.heappop(heap)
            if d >= distance:
                break
            if j not in links[i] or apart(i, j) != d:  # merged or changed since; what holds now is in the heap as well
                continue
            for k, s in links[j].items():
                if k != i:
                    links[i][k] = links[k][i] = links[i].get(k, 0.0) + s
                links[k].pop(j, None)
            links[j] = {}
            size[i] += size[j]
            into[j] = i
            for k in links[i]:
                heapq.heappush(heap, (apart(i, k), i, k) if i < k else (apart(k, i), k, i))
        for i in range(len(ids)):  # a group is merged into a smaller one, so one pass upwards resolves all
            into[i] = into[into[i]]
        return _named(ids, np.array(into))

    return _per_component(vectors, graph, run)


def _named(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Smallest id of each group as its label; groups of one are -1."""
    frame = pd.DataFrame({"id": ids.astype(np.int64), "g": label})
    least, n = frame.groupby("g")["id"].transform("min"), frame.groupby("g")["id"].transform("size")
    return pd.DataFrame({"id": frame["id"], "label": np.where(n > 1, least, -1).astype(np.int64)})


def by_density(vectors: DataFrame, graph: DataFrame | None = None, least: int = 3, limit: int = ONE_TASK, epsilon: float = 0.0, **_) -> DataFrame:
    """(id, label, probability): hierarchical density clustering (mutual reachability, condensed tree, excess of mass); groups that part only below the distance epsilon stay together."""
    if vectors.count() > limit:
        raise ValueError(f"density clustering holds all vectors in one task; more than {limit} rows")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        label, probability = density_labels(np.stack(rows.v.to_numpy()).astype(np.float64), least, epsilon)
        return pd.DataFrame({"id": rows.id.to_numpy(), "label": label, "probability": probability})

    return vectors.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "id long, label long, probability double")


def density_labels(x: np.ndarray, least: int, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Labels from 0 (noise -1) and membership strengths."""
    n = len(x)
    if n < least:
        return np.full(n, -1, dtype=np.int64), np.zeros(n)
    square = (x * x).sum(axis=1)
    distance = lambda i: np.sqrt(np.maximum(0.0, square + square[i] - 2 * (x @ x[i])))
    core = np.array([np.partition(distance(i), min(least, n) - 1)[min(least, n) - 1] for i in range(n)])
    inside, best, to = np.zeros(n, dtype=bool), np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    tree, i = [], 0
    for _ in range(n - 1):  # spanning tree of mutual reachability
        inside[i] = True
        reach = np.maximum(np.maximum(distance(i), core[i]), core)
        nearer = ~inside & (reach < best)
        best[nearer], to[nearer] = reach[nearer], i
        i = int(np.argmin(np.where(inside, np.inf, best)))
        tree.append((best[i], int(to[i]), i))
    tree.sort()
    parent, size, top = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), list(range(n))
    children, height = {}, {}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, (d, a, b) in enumerate(tree):
        ra, rb, new = root(a), root(b), n + k
        children[new], height[new] = (ra, rb), d
        size[new] = size[ra] + size[rb]
        parent[ra] = parent[rb] = new
    del top
    lam = lambda d: 1.0 / max(d, 1e-12)

    def leaves(k: int) -> list[int]:
        stack, out = [k], []
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack += children[j]
        return out

    born, stability, sub, points, order = {2 * n - 2: 0.0}, {}, {}, {}, []
    stack = [2 * n - 2]
    while stack:  # condensed tree: a cluster lives until both sides of a split are large enough
        c = stack.pop()
        order.append(c)
        stability[c], points[c], sub[c], k = 0.0, {}, [], c
        while True:
            a, b = children[k]
            at = lam(height[k])
            large = [j for j in (a, b) if size[j] >= least]
            for j in (a, b):
                if j not in large:
                    for p in leaves(j):
                        points[c][p] = at
                        stability[c] += at - born[c]
            if len(large) == 2:
                for j in large:
                    stability[c] += size[j] * (at - born[c])
                    born[j] = at
                    sub[c].append(j)
                stack += large
                break
            if not large or large[0] < n:
                for j in large:
                    points[c][j] = at
                break
            k = large[0]
    chosen: dict[int, bool] = {}
    value: dict[int, float] = {}
    for c in reversed(order):
        below = sum(value[j] for j in sub[c] if j in value)
        chosen[c] = c != 2 * n - 2 and (not sub[c] or stability[c] >= below)
        value[c] = stability[c] if chosen[c] else below
    if epsilon > 0:  # a group born below epsilon gives way to the nearest one above it that was not, or to the last below the root
        above, stack, kept = {j: c for c in order for j in sub[c]}, [2 * n - 2], set()
        while stack:
            c = stack.pop()
            if not chosen[c]:
                stack += sub[c]
                continue
            while 1 / born[c] < epsilon and above[c] != 2 * n - 2:
                c = above[c]
            kept.add(c)
        chosen = {c: c in kept for c in order}
    label, strength = np.full(n, -1, dtype=np.int64), np.zeros(n)
    stack, number = [2 * n - 2], 0
    while stack:
        c = stack.pop()
        if not chosen[c]:
            stack += sub[c]
            continue
        held, under = dict(points[c]), list(sub[c])
        while under:
            j = under.pop()
            held |= points[j]
            under += sub[j]
        most = max(points[c].values(), default=max(held.values(), default=1.0))
        for p, at in held.items():
            label[p], strength[p] = number, min(at, most) / most if most else 0.0
        number += 1
    return label, strength


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"components": by_components, "whispers": by_whispers, "linkage": by_linkage, "density": by_density}


def group(vectors: DataFrame, algorithm: str = "components", least: float = 0.51, neighbours: int = 50, **options) -> DataFrame:
    """(id, label) by a strategy of the registry; vectors is (id, v) with unit vectors. An empty table gives an empty result."""
    if algorithm not in STRATEGIES:
        raise ValueError(f"unknown algorithm: {algorithm}")
    graph = None if algorithm == "density" else cut(neighbour_graph(vectors, neighbours, least))
    return STRATEGIES[algorithm](vectors, graph, **options)


def principal(vectors: DataFrame, k: int) -> DataFrame:
    """(id, v): centred, projected on the first k principal directions, at length one again."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from pilegrain.operators.vectors import unit

    rows = vectors.select("id", array_to_vector("v").alias("x"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="c").fit(rows).transform(rows)
    turned = PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred)
    return turned.select("id", unit(vector_to_array("p")).alias("v"))
