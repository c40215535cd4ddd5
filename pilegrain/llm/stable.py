"""Problem 6: a reproducible sample that is stable as data grows.

Method: nested hash buckets. Every key belongs for good to one of 2^36 fine buckets by its hash, and the buckets are
ordered by a fixed permutation of the seed, read in three levels of 4096 places. A
sample is a prefix of that order which only ever grows: with each load the list is extended until the selected
buckets reach the target and is never shortened, so all earlier picks stay and keys of later loads
join only through buckets on the list. A fine bucket holds a key or none for any pool below some 10^10 keys, so
a sample passes its target by less than a bucket.

Scale: the plan holds bucket counts only: 4096 per run and load at each level, and of the second and third level only the
bucket in which a target is crossed. Counts of loads are running sums, so the work is linear in the loads. Selection is a
filter on the place without a shuffle of its own; a key is hashed once for all runs. The result does not depend on partitioning, order or reruns.

Defined results: copies of a key count once, at its earliest load; a null key is left out, a null load counts as the first;
a target above the pool takes all; an empty table gives an empty result; more than MOST_RUNS runs or MOST_LOADS
loads are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.llm.settings import few
from pilegrain.session import cut

BITS, LEVELS = 12, 3
PLACES = 1 << (BITS * LEVELS)
MOST_RUNS, MOST_LOADS = 1000, 10_000


def bucket_of(key: Column) -> Column:
    """0 to PLACES - 1: the key's bucket, the same in every run."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def permutation(seed: int | None) -> tuple[int, int]:
    """(factor, shift) of a one-to-one map of the buckets to their places; the factor is odd."""
    s = (seed or 0) % (1 << 31)
    return s * 40_503 % (1 << 26) * 2 + 1, s * 69_621 % PLACES


def _crossing(placed: DataFrame, open_: DataFrame, level: int) -> DataFrame:
    """(run, target, at, prefix, base): the bucket of this level in which the target is reached after load at, and the keys before it; null prefix where it is not."""
    shift = BITS * (LEVELS - 1 - level)
    inside = placed.join(F.broadcast(open_.select("run", "prefix").distinct()), "run") if level == 0 else placed.withColumn("prefix", F.shiftright("bucket", shift + BITS)).join(F.broadcast(open_.select("run", "prefix").distinct()), ["run", "prefix"])
    counts = cut(inside.groupBy("run", "prefix", F.shiftright("bucket", shift).alias("b"), "l").agg(F.count("*").alias("n")))
    grid = open_.join(counts.select("run", "prefix", "b").distinct(), ["run", "prefix"])
    both = counts.select("run", "prefix", "b", F.col("l").alias("at"), "n", F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("target")).unionByName(grid.select("run", "prefix", "b", "at", F.lit(0).cast("long").alias("n"), "base", "target"))
    loads = Window.partitionBy("run", "prefix", "b").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = both.withColumn("n", F.sum("n").over(loads)).where("base IS NOT NULL")
    along = Window.partitionBy("run", "at").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = upto.withColumn("sum", F.sum("n").over(along) + F.col("base"))
    met = F.min(F.when(F.col("sum") >= F.col("target"), F.struct("b", (F.col("sum") - F.col("n")).alias("before"))))
    return sums.groupBy("run", "target", "at").agg(met.alias("m")).select("run", "target", "at", F.col("m.b").alias("prefix"), F.col("m.before").alias("base"))


def grown_sample(pool: DataFrame, key: str, load: str, runs: DataFrame, run: str, target: str, seed: str) -> DataFrame:
    """(run, key, bucket, load, picked_at): picked_at is the load after which the key was first in the sample.

    runs has one row per sample: a configuration, not data. A null target or one below one takes nothing.
    """
    plans = [(r[run], r[target], r[seed]) for r in few(runs.select(run, target, seed).where(F.col(run).isNotNull()), MOST_RUNS) if r[target] and r[target] > 0]
    keys = pool.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.coalesce(F.min(load), F.lit(1)).alias("l"))
    keys = cut((keys if plans else keys.where(F.lit(False))).select("k", "l", bucket_of(F.col("k")).alias("_b")))
    places = [(r, t, *permutation(s)) for r, t, s in plans or [("", 0, 0)]]
    each = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(t).cast("long").alias("target"), ((F.col("_b") * F.lit(m).cast("long") + F.lit(c).cast("long")) % F.lit(PLACES)).alias("bucket")) for r, t, m, c in places])
    placed = keys.select("k", "l", F.explode(each).alias("p")).select("k", "l", "p.run", "p.target", "p.bucket")
    loads = [r["l"] for r in few(keys.select("l").distinct(), MOST_LOADS)]
    spark = pool.sparkSession
    rows = [(r, t, at, 0, 0) for r, t, _ in plans for at in loads]
    open_ = spark.createDataFrame(rows, "run string, target long, at long, prefix long, base long")
    short: DataFrame | None = None
    for level in range(LEVELS):
        found = cut(_crossing(placed, open_, level))
        if level == 0:
            short = found.where("prefix IS NULL").select("run", "at", F.lit(PLACES).alias("need"))
        open_ = found.where("prefix IS NOT NULL")
    need = open_.select("run", "at", F.col("prefix").alias("need")).union(short)
    listed = need.withColumn("last", F.max("need").over(Window.partitionBy("run").orderBy("at")))
    steps = listed.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "last"))).alias("steps"))
    first = F.expr("filter(steps, s -> s.at >= l AND s.last >= bucket)")
    picked = placed.join(F.broadcast(steps), "run").withColumn("first", first).where(F.size("first") > 0)
    return picked.select(F.col("run").alias(run), F.col("k").alias(key), "bucket", F.col("l").alias(load), F.col("first")[0]["at"].cast("int").alias("picked_at"))
