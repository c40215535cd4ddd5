"""Stratified sampling of faces for labelling: strata, caps, reserve, greedy matching, composition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.operators.ranking import global_rank
from pilegrain.operators.scalars import with_scalars
from pilegrain.session import cut

#: Dimensions, their categories and default shares.
TARGETS: dict[str, dict[str, float]] = {
    "size": {"tiny": 0.15, "small": 0.24, "medium": 0.38, "large": 0.23},
    "pose": {"frontal": 0.55, "semi": 0.30, "profile": 0.15},
    "era": {"oldest": 0.35, "middle": 0.25, "recent": 0.35, "undated": 0.05},
    "kind": {"photo": 0.67, "forwarded": 0.33},
    "filtered": {"plain": 0.88, "beauty": 0.12},
    "group": {"solo": 0.85, "group": 0.15},
    "quality": {"good": 0.60, "marginal": 0.25, "bad": 0.15},
    "clustered": {"clustered": 0.70, "noise": 0.30},
}
SEED = 77_041


def bucket(value: Column, edges: list[float], names: list[str]) -> Column:
    """Half-open buckets; null falls into the first."""
    chosen = F.when(value.isNull(), names[0])
    for edge, name in zip(edges, names[:-1], strict=True):
        chosen = chosen.when(value < edge, name)
    return chosen.otherwise(names[-1])


def era_bounds(rows: DataFrame, year: str) -> DataFrame:
    """One row (recent_from, oldest_to) from the histogram of years: the newest year less one, and the last year of the oldest third."""
    years = rows.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("y")).agg(F.count("*").alias("n"))
    upto = years.withColumn("c", F.sum("n").over(Window.orderBy("y"))).withColumn("all", F.sum("n").over(Window.partitionBy()))  # one row per year
    at = F.greatest(F.lit(0), F.floor(F.col("all") / 3) - 1)
    return upto.agg(F.coalesce(F.max("y") - 1, F.lit(9999)).alias("recent_from"), F.coalesce(F.min(F.when(F.col("c") > at, F.col("y"))), F.lit(0)).alias("oldest_to"))


def unit_rank(rows: DataFrame, order: Column, key: str, name: str) -> DataFrame:
    """rows with the place of each in 0 to 1; ties by key. The count comes from the ranks, not from another pass."""
    ranked = global_rank(rows, [order, F.col(key).asc()], "_place")
    n = ranked.agg(F.max("_place").alias("_n"))
    return with_scalars(ranked, n).withColumn(name, (F.col("_place") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_place", "_n")


def strata(faces: DataFrame, beauty_marker: str = "beauty") -> DataFrame:
    """(face_id, cluster_id, det_score, day, one column per dimension).

    faces: face_id, interocular_px, yaw_deg, blur, det_score, dark_fraction, bright_fraction, kind, path, year, day, cluster_id, n_faces.
    """
    c = F.col
    faces = cut(faces)
    ranked = faces
    for value, name in ((F.coalesce(c("blur"), F.lit(0.0)), "_blur"), (c("det_score"), "_score")):  # only the value and the key are sorted
        ranked = ranked.join(unit_rank(faces.select("face_id", value.alias("_v")), c("_v").asc(), "face_id", name).select("face_id", name), "face_id")
    exposure = F.least(F.greatest(F.coalesce("dark_fraction", F.lit(0.0)) + F.coalesce("bright_fraction", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    quality = F.lit(0.45) * c("_blur") + F.lit(0.45) * c("_score") + F.lit(0.10) * (F.lit(1.0) - exposure)
    era = F.when(c("year").isNull(), "undated").when(c("year") >= c("recent_from"), "recent").when(c("year") <= c("oldest_to"), "oldest").otherwise("middle")
    rows = with_scalars(ranked, era_bounds(faces, "year"))
    return rows.select(
        "face_id", "cluster_id", "det_score", "day",
        bucket(c("interocular_px"), [20.0, 40.0, 80.0], ["tiny", "small", "medium", "large"]).alias("size"),
        bucket(F.abs(F.coalesce("yaw_deg", F.lit(0.0))), [15.0, 45.0], ["frontal", "semi", "profile"]).alias("pose"),
        era.alias("era"),
        F.when(c("kind") == "forwarded", "forwarded").otherwise("photo").alias("kind"),
        F.when(c("path").contains(beauty_marker), "beauty").otherwise("plain").alias("filtered"),
        F.when(c("n_faces") >= 4, "group").otherwise("solo").alias("group"),
        bucket(quality, [0.15, 0.40], ["bad", "marginal", "good"]).alias("quality"),
        F.when(c("cluster_id") == -1, "noise").otherwise("clustered").alias("clustered"),
    )


def cross_era(rows: DataFrame) -> DataFrame:
    """rows with cross_era: whether the cluster holds both the oldest and the most recent era."""
    spanning = rows.where("cluster_id <> -1").groupBy("cluster_id").agg((F.bool_or(F.col("era") == "oldest") & F.bool_or(F.col("era") == "recent")).alias("cross_era")).where("cross_era")
    return rows.join(spanning, "cluster_id", "left").withColumn("cross_era", F.coalesce("cross_era", F.lit(False)))


def random_order(key: str, seed: int = SEED) -> Column:
    """A fixed pseudo-random order that does not depend on partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def capped(rows: DataFrame, per_day: int = 3, total: int = 70, key: str = "face_id", seed: int = SEED) -> DataFrame:
    """rows cut to so many per cluster and day, then per cluster; noise is exempt. The limits apply map-side before each shuffle."""
    noise, grouped = rows.where("cluster_id = -1"), rows.where("cluster_id <> -1")
    order = [random_order(key, seed), F.col(key)]
    for by, cap in ((["cluster_id", "day"], per_day), (["cluster_id"], total)):
        grouped = grouped.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")
    return noise.unionByName(grouped)


def reserve(rows: DataFrame, size: int, lowest: int = 50, noise_share: float = 0.0, seed: int = SEED) -> DataFrame:
    """(face_id, reserved_for): the lowest scores, then a random share of the noise."""
    low = rows.orderBy("det_score", "face_id").limit(lowest).select("face_id", F.lit("detector_fp").alias("reserved_for"))
    noise = rows.where("cluster_id = -1").join(low, "face_id", "left_anti").orderBy(random_order("face_id", seed), "face_id").limit(int(size * noise_share))
    return low.union(noise.select("face_id", F.lit("noise_review").alias("reserved_for")))


def trimmed(chosen: DataFrame, size: int, pinned: DataFrame) -> DataFrame:
    """(face_id, pinned): at most size of chosen by id, pinned ones first; those are kept even where they alone are more."""
    marked = chosen.select("face_id").distinct().join(pinned.select("face_id", F.lit(True).alias("_pin")).distinct(), "face_id", "left")
    held = marked.select("face_id", F.coalesce("_pin", F.lit(False)).alias("pinned"))
    kept = held.where("pinned")
    room = max(0, size - kept.count())
    return kept.union(held.where("NOT pinned").orderBy("face_id").limit(room))


def greedy(rows: DataFrame, size: int, targets: dict[str, dict[str, float]] | None = None, bonus: float = 0.5, lowest: int = 50, noise_share: float = 0.0, pinned: DataFrame | None = None) -> DataFrame:
    """(face_id): greedy marginal matching, always the face that serves most deficits, then the smallest id.

    Pinned faces of rows are taken first and count towards the targets; they are never left out for the size.

    Scores depend on the joint cell and the bonus alone, so only the cell counts come to the driver; the dimensions bound
    their number. The faces of a cell are taken by rank.
    """
    targets = targets or TARGETS
    dims = list(targets)
    held = reserve(rows, size, lowest, noise_share).select("face_id")
    if pinned is not None:
        held = trimmed(rows.join(held.union(pinned.select("face_id")).distinct(), "face_id", "left_semi"), size, pinned).select("face_id")
    start = rows.join(held, "face_id", "left_semi")
    pool = rows.join(held, "face_id", "left_anti")
    cells = [*dims, "cross_era"]
    counts = {tuple(r[d] for d in cells): (r["n"], r["first"]) for r in pool.groupBy(*cells).agg(F.count("*").alias("n"), F.min("face_id").alias("first")).collect()}
    begun = {tuple(r[d] for d in dims): r["n"] for r in start.groupBy(*dims).agg(F.count("*").alias("n")).collect()}
    keys = sorted(counts, key=lambda k: counts[k][1])
    n = np.array([counts[k][0] for k in keys], dtype=np.int64)
    taken = np.zeros(len(keys), dtype=np.int64)
    names = {d: list(targets[d]) for d in dims}
    code = {d: np.array([names[d].index(k[i]) for k in keys], dtype=np.int64) for i, d in enumerate(dims)}
    have = {d: np.zeros(len(names[d])) for d in dims}
    for k, m in begun.items():
        for i, d in enumerate(dims):
            have[d][names[d].index(k[i])] += m
    total = min(size, int(n.sum()) + sum(begun.values()))
    quota = {d: np.array([s * total for s in targets[d].values()]) for d in dims}
    extra = np.array([bonus if k[-1] else 0.0 for k in keys])
    for _ in range(max(0, total - sum(begun.values()))):
        score = extra.copy()
        for d in dims:
            score += (np.maximum(0.0, quota[d] - have[d]) / max(1.0, total))[code[d]]
        score[taken >= n] = -np.inf
        best = int(np.argmax(score))
        if score[best] == -np.inf:
            break
        taken[best] += 1
        for d in dims:
            have[d][code[d][best]] += 1
    plan = [(*k, int(t)) for k, t in zip(keys, taken, strict=True) if t]
    schema = ", ".join(f"`{d}` string" for d in dims) + ", cross_era boolean, take long"
    wanted = F.broadcast(rows.sparkSession.createDataFrame(plan, schema))
    order = Window.partitionBy(*cells).orderBy("face_id")
    picked = pool.join(wanted, cells).withColumn("_r", F.row_number().over(order)).where("_r <= take").select("face_id")
    return held.union(picked)


def composition(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 0.05) -> DataFrame:
    """(dimension, category, faces, share, target, off): off where the share misses the target by more than the tolerance."""
    targets = targets or TARGETS
    goals = rows.sparkSession.createDataFrame([(d, c, float(t)) for d, cats in targets.items() for c, t in cats.items()], "dimension string, category string, target double")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in targets])
    held = rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.category").agg(F.count("*").alias("faces"))
    total = F.sum("faces").over(Window.partitionBy("dimension"))
    full = F.broadcast(goals).join(held, ["dimension", "category"], "left").withColumn("faces", F.coalesce("faces", F.lit(0)))
    share = F.when(total > 0, F.col("faces") / total).otherwise(0.0)
    return full.withColumn("share", share).withColumn("off", F.abs(F.col("share") - F.col("target")) > tolerance)
