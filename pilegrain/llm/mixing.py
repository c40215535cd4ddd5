"""Problem 9: sources mixed to target weights.

Method: every source of a mix is a periodic task. Its records fall into blocks of about equal tokens; block i of a
source with weight w is released at i / w and due at (i + 1) / w, and earliest deadline first
among released blocks gives each source less than one block of deviation at any point. The schedule repeats: a
period has n turns of a source, its exact number x of blocks a period rounded up, and is computed once; block i of a source
takes turn floor(i * n / x), so that turns too many stay empty and any positive weight, however small, keeps
its exact rate.

A source gives its share of the total or, where that asks for more than its cap of repetitions allows, all it may give;
a mix is never filled up from other sources. Repetitions are whole passes, then a part of one
more in a fixed random order. Reached shares are reported.

Scale: tokens are counted once without a shuffle; running sums are taken in two levels (4096 hash buckets per source, then
within a bucket), so no source is one window. Bucket sums, sources and targets are the only tables
that are broadcast, bounded by the targets.

Defined results: null sources belong to none, sources are compared in lower case without outer blanks; empty
texts have no tokens and are never drawn; a source without tokens, a null share or cap gives nothing; an empty
table gives an empty mix; more than MOST_TARGETS targets are an error.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.llm.settings import few

BUCKETS = 4096
PERIOD = 10_000
MOST_TARGETS = 10_000


def folded(source: Column) -> Column:
    return F.lower(F.trim(source))


def source_tokens(sized: DataFrame) -> DataFrame:
    """(source, tokens) of the corpus; sized has a folded source and tokens."""
    return sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("source_tokens"))


def quotas(targets: DataFrame, per_source: DataFrame) -> DataFrame:
    """Targets with the tokens asked for, the most that the cap allows and what will be given."""
    asked = F.col("target_share") * F.col("total_tokens")
    most = F.coalesce("max_repeats", F.lit(0)).cast("long") * F.coalesce("source_tokens", F.lit(0))
    rows = targets.withColumn("source", folded(F.col("source"))).join(per_source, "source", "left")
    return rows.withColumn("asked", F.coalesce(asked, F.lit(0.0))).withColumn("most", most).withColumn("given", F.least(F.ceil("asked").cast("long"), F.col("most")))


def turns(weights: dict[str, float], period: int = PERIOD) -> tuple[int, dict[str, tuple[list[int], float]]]:
    """(slots of a period, per source the places of its turns in it and how many turns a block takes), by earliest deadline first among released turns."""
    total = sum(w for w in weights.values() if w > 0)
    exact = {s: w / total * period for s, w in weights.items() if w > 0}
    n = {s: max(1, math.ceil(x - 1e-9)) for s, x in exact.items()}
    slots = sum(n.values())
    release = sorted((i * slots // k, -(-(i + 1) * slots // k), s) for s, k in n.items() for i in range(k))
    places: dict[str, list[int]] = {s: [] for s in n}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(slots):
        while at < len(release) and release[at][0] <= slot:
            heapq.heappush(ready, release[at][1:])
            at += 1
        if ready:
            places[heapq.heappop(ready)[1]].append(slot)
    while ready or at < len(release):  # rounding of releases may leave a turn for after the last slot
        if not ready:
            heapq.heappush(ready, release[at][1:])
            at += 1
        places[heapq.heappop(ready)[1]].append(slots)
        slots += 1
    return slots, {s: (p, max(1.0, n[s] / exact[s])) for s, p in places.items()}


def mixed(sized: DataFrame, targets: DataFrame, key: str, block_tokens: int = 2048, seed: int = 11) -> DataFrame:
    """(mix_name, source, key, pass, tokens, block, position): the records of each mix and the slot of their block.

    sized: key, folded source, tokens. targets is a table of settings.
    """
    spark = sized.sparkSession
    sized = sized.where("source IS NOT NULL AND tokens > 0")
    goal = quotas(targets, source_tokens(sized)).where("given > 0 AND mix_name IS NOT NULL")
    goal = few(goal, MOST_TARGETS)
    by_mix: dict[str, dict[str, float]] = {}
    for r in goal:
        by_mix.setdefault(r["mix_name"], {})[r["source"]] = by_mix.get(r["mix_name"], {}).get(r["source"], 0) + r["given"]
    slots = []
    for mix, weights in by_mix.items():
        length, held = turns(weights)
        slots += [(mix, s, places, stride, length) for s, (places, stride) in held.items()]
    plan = F.broadcast(spark.createDataFrame([(r["mix_name"], r["source"], int(r["given"]), int(r["source_tokens"])) for r in goal], "mix_name string, source string, given long, source_tokens long"))
    period = F.broadcast(spark.createDataFrame(slots, "mix_name string, source string, places array<int>, stride double, slots long"))

    h = F.xxhash64(F.col(key), F.lit(seed))
    placed = sized.select(key, "source", "tokens", h.alias("_h"), F.shiftrightunsigned(h, 52).cast("int").alias("_b"))
    sums = placed.groupBy("source", "_b").agg(F.sum("tokens").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")) - F.col("_n")).select("source", "_b", "_before")
    inside = Window.partitionBy("source", "_b").orderBy(F.shiftrightunsigned("_h", 1), key, "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = placed.withColumn("_in", F.sum("tokens").over(inside) - F.col("tokens")).join(before, ["source", "_b"]).select(key, "source", "tokens", (F.col("_before") + F.col("_in")).alias("_start"))
    joined = start.join(plan, "source").withColumn("_passes", F.expr("CAST(ceil((given - _start) / source_tokens) AS INT)")).where("_passes > 0")
    passes = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)))
    block = F.floor((F.col("pass") * F.col("source_tokens") + F.col("_start")) / F.lit(block_tokens))
    rows = passes.withColumn("block", block).join(period, ["mix_name", "source"])
    rows = rows.withColumn("_t", F.floor(F.col("block") * F.col("stride")))
    turn = F.expr("(_t div size(places)) * slots + places[CAST(_t % size(places) AS INT)]")
    return rows.select("mix_name", "source", key, "pass", "tokens", "block", turn.alias("position"))


def report(mix: DataFrame, targets: DataFrame, per_source: DataFrame) -> DataFrame:
    """Reached tokens and shares beside the targets; share is of what the mix holds, fill of what was asked for."""
    got = mix.groupBy("mix_name", "source").agg(F.sum("tokens").alias("got"), F.max(F.col("pass") + 1).alias("passes"))
    rows = quotas(targets, per_source).join(got, ["mix_name", "source"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    total = F.sum("got").over(Window.partitionBy("mix_name"))
    return rows.select("mix_name", "source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.ceil("asked").cast("long").alias("asked_tokens"), (F.col("asked") > F.col("got")).alias("short"), F.col("got").alias("given_tokens"), F.coalesce("passes", F.lit(0)).alias("passes"), (F.col("got") / total).alias("share"), (F.col("got") / F.col("asked")).alias("fill"))
