"""Problem 2: train, validation and test splits that keep related records together.

Method: minimum labels travel over the bipartite graph of records and entities (a person, a
photo): an entity takes the least label of its records, a record the least of its entities, and a
label takes over what its records learnt and jumps to its own label, until nothing changes. The bundles so found are then assigned
whole, so that the mix of strata in each split follows the whole.

Scale: labels are minima that combine map-side; an entity with more than a thousandth of all links
(at most a thousand such entities, by arithmetic) is spread over salted keys in the join back.
Bundles holding more than a thousandth of a split's records (a bounded number) are placed one by
one, largest first, on the driver; all others fall into 256 hash buckets per leading stratum, and
only the bucket counts are placed. Nothing that grows with the records is collected.

Defined results: a null record or entity gives no link, copies count once, an empty table an empty result;
ties fall to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pilegrain.llm.settings import few
from pilegrain.operators.components import beside
from pilegrain.session import cut

SALTS = 64
BUCKETS = 256
LARGE_SHARE = 1000
MOST_STRATA = 4096


def entity_key(written: Column) -> Column:
    """Hand-typed ids that differ only in case, blanks, punctuation or leading zeros give one key."""
    bare = F.regexp_replace(F.lower(written.cast("string")), r"[^\p{L}\p{N}]+", "")
    key = F.regexp_replace(bare, r"(^|\P{N})0+(?=\p{N})", "$1")
    return F.when(key != "", key).otherwise(F.trim(written))


def bundles(links: DataFrame, record: str, entity: str, bundle: str = "bundle", most_rounds: int = 200) -> DataFrame:
    """(record, bundle): the smallest record tied to it through shared entities, directly or not."""
    pairs = links.select(F.col(record).alias("r"), F.col(entity).alias("e")).where("r IS NOT NULL AND e IS NOT NULL").distinct()
    pairs = cut(pairs)
    hot = pairs.groupBy("e").count().where(F.col("count") > F.lit(pairs.count() // LARGE_SHARE + 100)).select("e", F.lit(True).alias("hot"))
    pairs = cut(pairs.join(F.broadcast(hot), "e", "left").select("r", "e", F.when(F.col("hot"), F.pmod(F.xxhash64("r"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("s"), F.coalesce("hot", F.lit(False)).alias("hot")).repartition("e", "s"))
    labels = cut(pairs.select("r", F.col("r").alias("l")).distinct().repartition("r"))
    for _ in range(most_rounds):
        known = pairs.join(labels, "r")
        least = known.groupBy("e", "hot").agg(F.min("l").alias("l"))
        spread = least.select("e", "l", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("s"))
        told = pairs.join(spread, ["e", "s"]).groupBy("r").agg(F.min("l").alias("new"))
        step = cut(labels.join(told, "r").select("r", "l", "new"))
        changed = step.where("new < l")
        if changed.isEmpty():
            return step.select(F.col("r").alias(record), F.col("l").alias(bundle))
        # A label that learnt of a smaller one takes it over for all its records, then jumps to the label of its label; giant labels are spread over salted keys.
        hooks = changed.groupBy("l").agg(F.min("new").alias("hook"))
        hooked = cut(beside(step, "l", hooks, "left").select("r", F.least("new", F.coalesce("hook", "new")).alias("new")))
        far = hooked.join(hooked.select(F.col("new").alias("r")).distinct(), "r", "left_semi").select(F.col("r").alias("new"), F.col("new").alias("far"))
        labels = cut(beside(hooked, "new", far, "left").select("r", F.least("new", F.coalesce("far", "new")).alias("l")))
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")


def assign(records: DataFrame, bundle: str, stratum: str, targets: dict[str, float], seed: int = 7) -> DataFrame:
    """records with a column split: bundles stay whole and every split's mix of strata follows the whole.

    A null stratum is a stratum of its own; more than MOST_STRATA of them are an error. Bundles too small to be placed one by
    one are placed by hash buckets, fewer per stratum where there are many.
    """
    spark = records.sparkSession
    names = sorted(targets)
    total = records.count()
    if not total or not names:
        return records.withColumn("split", F.lit(names[0] if names else None).cast("string"))
    label = F.coalesce(F.col(stratum).cast("string"), F.lit("(none)"))
    strata = {r["k"]: r["count"] for r in few(records.groupBy(label.alias("k")).count(), MOST_STRATA)}
    buckets = max(1, BUCKETS * 64 // max(64, len(strata)))
    cells = records.groupBy(F.col(bundle).alias("b"), label.alias("k")).count()
    sizes = cells.groupBy("b").agg(F.sum("count").alias("n"), F.max(F.struct("count", "k"))["k"].alias("lead"))
    bar = max(2, total // LARGE_SHARE)
    unit = F.when(F.col("n") >= bar, F.concat(F.lit("b"), F.col("b").cast("string"))).otherwise(F.concat(F.lit("h"), F.pmod(F.xxhash64("b", F.lit(seed)), F.lit(buckets)).cast("string"), F.lit("/"), F.col("lead")))
    units = cut(sizes.select("b", unit.alias("unit")))
    rows = cells.join(units, "b").groupBy("unit", "k").agg(F.sum("count").alias("n")).collect()  # at most 1000 large units, and BUCKETS * 64 buckets or one per stratum
    held: dict[str, dict[str, int]] = {}
    for r in rows:
        held.setdefault(r["unit"], {})[r["k"]] = r["n"]
    share = {s: targets[s] / (sum(targets.values()) or 1) for s in names}
    left = {s: {k: share[s] * n for k, n in strata.items()} for s in names}
    room = {s: share[s] * total for s in names}
    placed: dict[str, str] = {}
    for u, mix in sorted(held.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        n = sum(mix.values())

        def harm(s: str, mix: dict[str, int] = mix, n: int = n) -> tuple[float, str]:
            """How far placing the unit in s moves the splits from their targets, as a sum of squares."""
            apart = sum(((left[s][k] - m) ** 2 - left[s][k] ** 2) / max(1.0, strata[k] * share[s]) for k, m in mix.items())
            return apart + ((room[s] - n) ** 2 - room[s] ** 2) / max(1.0, total * share[s]), s

        best = min((s for s in names if share[s] > 0), key=harm)
        placed[u] = best
        room[best] -= n
        for k, m in mix.items():
            left[best][k] -= m
    chosen = spark.createDataFrame(sorted(placed.items()), "unit string, split string")
    return records.join(units.join(F.broadcast(chosen), "unit").select(F.col("b").alias(bundle), "split"), bundle)
