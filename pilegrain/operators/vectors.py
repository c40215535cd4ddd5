"""Vectors in columns: normalisation, cosines, nearest neighbours, group sums.

Cosines that are reported or compared with a threshold are folded in double precision inside the
JVM; matrix products in Python only choose candidates, with a margin, so the result does not depend on a BLAS.

spanning and closest compare a whole library with itself: vectors travel packed without loss in blocks, and a task reads the
two blocks of a cell where they were written (a cartesian product), so that nothing is copied to disk per pair of blocks and no pair of
vectors leaves its task. There the same fold in double precision, coordinate by coordinate, is done in Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.session import cut, width

MARGIN = 1e-4
#: Vectors of a block, and rows of one matrix product.
BLOCK, STRIP = 8192, 512
#: Blocks of a partition whose cells share a forest, at most, and edges of a forest before it is shrunk.
BESIDE, FOREST = 4, 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length one; a vector near zero stays as it is."""
    length = F.sqrt(dot(v, v))
    once = F.array(F.struct(v.alias("v"), F.when(length > 1e-9, length).otherwise(F.lit(1.0)).alias("n")))  # else the length is taken again for every element
    return F.transform(once, lambda r: F.transform(r["v"], lambda x: x.cast("double") / r["n"]))[0]


def usable(v: Column, dim: int) -> Column:
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def _stack(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(np.float64)


def blocked(left: DataFrame, right: DataFrame, k: int | None, least: float, block: int = 4096, same: bool = False) -> DataFrame:
    """(src, dst): for every row of left the rows of right whose cosine reaches least, the best k of each block where k is given.

    left and right are (id, v) with unit vectors. Both are cut into blocks by a hash and every pair of blocks is one task:
    a task holds two blocks, whatever the size of the tables. same leaves a row's own id out.
    """
    n_left, n_right = (max(1, math.ceil(x.count() / block)) for x in (left, right))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select(F.pmod(F.xxhash64("id"), F.lit(n_left)).cast("int").alias("x"), F.col("id"), F.col("v")).withColumn("y", every(n_right))
    b = right.select(F.pmod(F.xxhash64("id"), F.lit(n_right)).cast("int").alias("y"), F.col("id"), F.col("v")).withColumn("x", every(n_left))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if a.num_rows and b.num_rows:
            ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
            va, vb = _stack(a["v"].combine_chunks()), _stack(b["v"].combine_chunks())
            for i in range(0, len(ia), 512):
                s = va[i : i + 512] @ vb.T
                if same:
                    s[ia[i : i + 512, None] == ib[None, :]] = -np.inf
                low = np.full(len(s), least - MARGIN)
                if k is not None and k < s.shape[1]:
                    low = np.maximum(low, np.partition(s, -k, axis=1)[:, -k] - MARGIN)
                r, c = np.nonzero(s >= low[:, None])
                keep = s[r, c] > -np.inf
                out_a.append(ia[i : i + 512][r[keep]])
                out_b.append(ib[c[keep]])
        return pa.table({"src": np.concatenate(out_a), "dst": np.concatenate(out_b)})

    return a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInArrow(near, "src long, dst long")


def with_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs with their cosine, folded in double precision."""
    a = left.select(F.col("id").alias("src"), F.col("v").alias("_a"))
    b = right.select(F.col("id").alias("dst"), F.col("v").alias("_b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", dot(F.col("_a"), F.col("_b")).alias("sim"))


def edges(vectors: DataFrame, least: float) -> DataFrame:
    """(src, dst, sim), src < dst, of all pairs at or above least."""
    found = blocked(vectors, vectors, None, least, same=True).where("src < dst")
    return with_cosine(found, vectors, vectors).where(F.col("sim") >= least)


def nearest(left: DataFrame, right: DataFrame, k: int, least: float = -1.0, same: bool = False) -> DataFrame:
    """(src, dst, sim, place): the k nearest rows of right, ties by smaller id."""
    found = with_cosine(blocked(left, right, k, least, same=same), left, right).where(F.col("sim") >= least)
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def neighbour_graph(vectors: DataFrame, k: int, least: float) -> DataFrame:
    """(src, dst, sim), src < dst: the k nearest neighbours of each, made symmetric by the larger cosine, then cut at least."""
    found = nearest(vectors, vectors, k, same=True).where(F.col("sim") >= least)
    return found.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("sim").alias("sim"))


# ---------------------------------------------------------------- a library against itself


class Block(NamedTuple):
    """Ids, groups and unit vectors of a block, a column a vector, in order of the groups."""

    ids: np.ndarray
    group: np.ndarray
    v: np.ndarray
    single: np.ndarray


def packed(rows: DataFrame) -> DataFrame:
    """(id, g, w, e, q) of (id, v) or (id, v, g): q holds v without loss in w bytes a coordinate; of one byte they are multiples of 2^e."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stack(batch.column(1))
                e = np.ceil(np.log2(np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300) / 127)).astype(np.int64)
                scaled = np.ldexp(x, -e[:, None])
                small, single = (scaled == np.rint(scaled)).all(axis=1), (x == x.astype(np.float32)).all(axis=1)
                w = np.where(small, 1, np.where(single, 4, 8))
                q = [(scaled[i].astype("i1") if k == 1 else x[i].astype(f"<f{k}")).tobytes() for i, k in enumerate(w.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(w), pa.array(e), pa.array(q, pa.binary())], ["id", "g", "w", "e", "q"])

    group = F.col("g").cast("long") if "g" in rows.columns else F.lit(0).cast("long").alias("g")
    return rows.select(F.col("id").cast("long"), "v", group).mapInArrow(pack, "id long, g long, w long, e long, q binary")


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, n, head, q): packed rows in blocks by a hash of their ids, a row a block; head holds id, group, width and exponent of each vector, narrow vectors first."""
    parts = max(1, math.ceil(rows.count() / block))

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("w")
        head = np.stack([rows[c].to_numpy() for c in ("id", "g", "w", "e")])
        q = b"".join(rows["q"].to_pylist())
        return pa.table({"block": rows["block"][:1], "n": pa.array([rows.num_rows], pa.int64()), "head": pa.array([head.tobytes()], pa.binary()), "q": pa.array([q], pa.binary())})

    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(parts, "block")
    return cut(placed.groupBy("block").applyInArrow(gather, "block int, n long, head binary, q binary"))


def opened(n: int, head: bytes, q: bytes) -> Block:
    """The block with its vectors at length one, as unit gives them."""
    ids, group, w, e = np.frombuffer(head, dtype=np.int64).reshape(4, n)
    dim = len(q) // int(w.sum())
    x, at, row = np.empty((n, dim)), 0, 0
    for width, kind in ((1, "i1"), (4, "<f4"), (8, "<f8")):
        k = int((w == width).sum())
        part = np.frombuffer(q, dtype=kind, count=k * dim, offset=at).reshape(k, dim)
        x[row : row + k] = np.ldexp(part.astype(np.float64), e[row : row + k, None]) if width == 1 else part
        at, row = at + k * dim * width, row + k
    order = np.lexsort((ids, group))
    v = np.ascontiguousarray(x[order].T)
    length = np.sqrt(_folded(v, v, np.arange(n), np.arange(n)))
    v /= np.where(length > 1e-9, length, 1.0)
    return Block(ids[order], group[order], v, v.astype(np.float32))


def _folded(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of column i of a and column j of b, added up coordinate by coordinate as dot does."""
    out = np.zeros(len(i))
    for k in range(0, len(i), 65_536):
        some = slice(k, k + 65_536)
        for x, y in zip(a, b, strict=True):
            out[some] += x[i[some]] * y[j[some]]
    return out


def _crossed(blocks: DataFrame, run: Callable[[Block, Block, bool], Iterator[pa.RecordBatch]], schema: str, after: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """run on every two blocks, and on each with itself; a task reads its blocks where they are, nothing is shuffled. after gets what the cells of a task gave."""
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in "ab")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = one = None
        for batch in batches:
            for row in range(batch.num_rows):
                x, *left, y, n, head, q = (c[row].as_py() for c in batch.columns)
                if x != last:
                    last, one = x, opened(*left)
                yield from run(one, one if x == y else opened(n, head, q), x == y)

    return a.hint("shuffle_replicate_nl").join(b, F.col("block_a") <= F.col("block_b")).mapInArrow(lambda batches: after(cells(batches)), schema)


def _hits(a: Block, b: Block, same: bool, least: float, apart: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, cosine in single precision) of pairs at or above least less the margin, strip by strip, each pair once; apart: of two groups only."""
    for i in range(0, len(a.ids), STRIP):
        begin = i if same else 0
        s = a.single[:, i : i + STRIP].T @ b.single[:, begin:]
        if apart:
            group = a.group[i : i + STRIP]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            low, high = (np.searchsorted(b.group[begin:], group[first], side) for side in ("left", "right"))
            for r, end, lo, hi in zip(first, np.r_[first[1:], len(group)], low, high, strict=True):
                s[r:end, lo:hi] = -2
        at = np.flatnonzero(s >= np.float32(least - MARGIN))
        u, w = np.divmod(at, s.shape[1])
        sim = s.ravel()[at].astype(np.float64)
        if same:
            ahead = w > u
            u, w, sim = u[ahead], w[ahead], sim[ahead]
        yield u + i, w + begin, sim


def _sure(a: Block, b: Block, u: np.ndarray, w: np.ndarray, sim: np.ndarray, cuts: list[float]) -> np.ndarray:
    """sim, exact where it lies within the margin of a cut."""
    close = np.flatnonzero(np.any([np.abs(sim - c) <= 2 * MARGIN for c in cuts], axis=0))
    sim[close] = _folded(a.v, b.v, u[close], w[close])
    return sim


def _hooked(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root, the smallest place of each place's component, after the edges x, y."""
    while True:
        x, y = root[x], root[y]
        open_ = x != y
        if not open_.any():
            return root
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _told(ids: np.ndarray, roots: list[np.ndarray], levels: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a forest with the components that roots has at each level; a component of a stricter level is joined by its root alone."""
    held, out = np.arange(len(ids)), []
    for t, root in zip(levels, roots, strict=True):
        x = held[root[held] != held]
        p, q = ids[x], ids[root[x]]
        out.append((np.minimum(p, q), np.maximum(p, q), np.full(len(x), t)))
        held = held[root[held] == held]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _nested(levels: list[float], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from (src, dst, sim) to fewer edges with the same components at each level: one forest, or several of more than most / 2 edges."""

    def shrunk(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        src, dst, sim = (np.concatenate(c) for c in zip(*held, strict=True))
        ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
        u, w = flat[: len(src)], flat[len(src) :]
        root, roots = np.arange(len(ids)), []
        for t in levels:
            some = sim == t
            root = _hooked(root.copy(), u[some], w[some])
            roots.append(root)
        return _told(ids, roots, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size > most:
                held = [shrunk(held)]
                size = len(held[0][0])
                if size > most // 2:
                    yield from told(held[0])
                    held, size = [], 0
        if size:
            yield from told(shrunk(held))

    def told(edges: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(edges[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in edges], ["src", "dst", "sim"])

    return run


def spanning(blocks: DataFrame, cuts: list[float]) -> DataFrame:
    """(src, dst, sim), src < dst: edges that at each of the cuts have the components of all pairs at or above it; sim is the largest cut that joins them.

    The cells of a task end in one forest, and these forests, put together in a partition for every 16 blocks, in one each.
    """
    levels = sorted(set(cuts), reverse=True)
    spark = blocks.sparkSession
    parts = blocks.count()
    side = min(parts, max(math.ceil(parts / BESIDE), math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism))))

    def run(a: Block, b: Block, same: bool) -> Iterator[pa.RecordBatch]:
        ids = a.ids if same else np.concatenate([a.ids, b.ids])
        roots = [np.arange(len(ids)) for _ in levels]
        for u, w, sim in _hits(a, b, same, levels[-1]):
            sim = _sure(a, b, u, w, sim, levels)
            to = w if same else w + len(a.ids)
            for k, t in enumerate(levels):
                some = np.flatnonzero((sim >= t) & (roots[k][u] != roots[k][to]))
                roots[k] = _hooked(roots[k], u[some], to[some])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _told(ids, roots, levels)], ["src", "dst", "sim"])

    forests = _crossed(blocks.coalesce(max(1, side)), run, "src long, dst long, sim double", _nested(levels, FOREST))
    return forests.repartition(min(width(spark), math.ceil(parts / 16) or 1), "src").mapInArrow(_nested(levels, FOREST), "src long, dst long, sim double")


def closest(blocks: DataFrame, least: float) -> DataFrame:
    """(x, y, sim, pairs), x < y: the largest cosine and the number of pairs at or above least between every two groups that have one."""

    def run(a: Block, b: Block, same: bool) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        best, told = [(none, none, none, none, np.zeros(0))], [(none, none, none)]

        def grouped(x, y, sim):
            """Order by groups, where each begins, and whether a pair may be its groups' nearest."""
            order = np.lexsort((y, x))
            x, y, sim = x[order], y[order], sim[order]
            start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else none
            size = np.diff(np.r_[start, len(x)])
            top = np.maximum.reduceat(sim, start) if len(x) else sim
            return order, start, size, np.flatnonzero(sim >= np.repeat(top, size) - 2 * MARGIN)

        for u, w, sim in _hits(a, b, same, least, apart=True):
            sim = _sure(a, b, u, w, sim, [least])
            hit = sim >= least
            u, w, sim = u[hit], w[hit], sim[hit]
            x, y = np.minimum(a.group[u], b.group[w]), np.maximum(a.group[u], b.group[w])
            order, start, size, top = grouped(x, y, sim)
            told.append((x[order[start]], y[order[start]], size))
            top = order[top]
            best.append((x[top], y[top], u[top], w[top], sim[top]))
        x, y, u, w, sim = (np.concatenate(c) for c in zip(*best, strict=True))
        order, _, _, top = grouped(x, y, sim)
        top = order[top]
        exact = _folded(a.v, b.v, u[top], w[top])
        yield pa.RecordBatch.from_arrays([pa.array(x[top]), pa.array(y[top]), pa.array(exact), pa.array(np.zeros(len(top), dtype=np.int64))], ["x", "y", "sim", "pairs"])
        x, y, n = (np.concatenate(c) for c in zip(*told, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.float64()), pa.array(n)], ["x", "y", "sim", "pairs"])

    return _crossed(blocks, run, "x long, y long, sim double, pairs long").groupBy("x", "y").agg(F.max("sim").alias("sim"), F.sum("pairs").alias("pairs"))


def group_sums(rows: DataFrame, group: str, v: str, dim: int) -> DataFrame:
    """(group, n, s): count and vector sum of each group, in millionths as whole numbers, so that the order of rows does not matter.

    Each task sums its own groups before the shuffle, so a hot group sends one row per task.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, int] = {}
        sums, n = np.zeros((1024, dim), dtype=np.int64), np.zeros(1024, dtype=np.int64)
        for batch in batches:
            x = np.floor(_stack(batch.column(1)) * 1e6 + 0.5).astype(np.int64)
            at = np.array([groups.setdefault(g, len(groups)) for g in batch.column(0).to_pylist()], dtype=np.int64)
            while len(groups) > len(n):
                sums, n = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([n, np.zeros_like(n)])
            np.add.at(sums, at, x)
            np.add.at(n, at, 1)
        k = len(groups)
        if k:
            flat = pa.array(sums[:k].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int64()), pa.array(n[:k]), pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * dim, flat)], ["g", "n", "s"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        s = table["s"].combine_chunks().flatten().to_numpy().reshape(-1, dim).sum(axis=0)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([int(table["n"].to_numpy().sum())]), "s": pa.array([s], pa.list_(pa.int64()))})

    schema = "g long, n long, s array<long>"
    held = rows.select(F.col(group).cast("long").alias("g"), F.col(v).cast("array<double>").alias("v")).where("g IS NOT NULL").mapInArrow(partial, schema)
    return held.groupBy("g").applyInArrow(merge, schema).withColumnRenamed("g", group)


def tightness(sums: DataFrame) -> Column:
    """Mean cosine of the pairs of a group of unit vectors from its sum alone: no pair is formed."""
    square = F.aggregate(F.transform("s", lambda x: (x / 1e6) * (x / 1e6)), F.lit(0.0), lambda a, x: a + x)
    return (square - F.col("n")) / (F.col("n") * (F.col("n") - 1))
