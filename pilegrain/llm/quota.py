"""Problem 3: a sample that matches target category proportions in several dimensions at once.

Method: categories are counted; each dimension's targets become integer quotas by largest
remainder, with minimum floors and caps at what exists. As one sample must meet all dimensions, the
counts of joint cells are raked to these quotas, rounded down, and the remaining units
go to the cells whose categories lack most, many cells a turn. From each cell the records with the smallest
seeded random keys are taken. Shortfalls are what the quotas could not reach; they and the largest deviation are reported.

Scale: only cell counts reach the driver; a category that no target names counts as one category (other), so the
targets bound the number of cells. The smallest keys are taken behind a key threshold
that keeps a little more than the quota; where a cell yields too few, the selection runs again
without it, so the threshold never changes the result.

Defined results: a record counts once; categories are compared in lower case without outer blanks; null, blank
and unnamed categories are other; a target above what exists takes all of it and is reported; an
empty pool gives an empty sample; more than MOST_TARGETS targets, MOST_RUNS runs or MOST_CELLS joint cells are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilegrain.llm.settings import few
from pilegrain.session import cut

OTHER = "(other)"
MOST_TARGETS, MOST_RUNS, MOST_CELLS = 10_000, 1000, 1_000_000
#: How many goals of one record a missing record of a floor outweighs.
FLOOR_WEIGHT = 8


def folded(category: Column) -> Column:
    return F.lower(F.trim(category))


def availability(pool: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, category, available) over all records, in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), folded(c).alias("category")) for d, c in dimensions.items()])
    return pool.select(F.explode(pairs).alias("p")).select("p.*").where("category IS NOT NULL").groupBy("dimension", "category").agg(F.count("*").alias("available"))


def wanted(targets: DataFrame, config: DataFrame) -> DataFrame:
    """Targets with the number of records that each asks for."""
    sized = targets.join(F.broadcast(config.select("sample_run", "target_size", "random_seed")), "sample_run")
    ask = F.greatest(F.coalesce("min_count", F.lit(0)).cast("double"), F.round(F.col("target_share") * F.col("target_size"))).cast("long")
    return sized.withColumn("category", folded(F.col("category"))).withColumn("wanted", ask)


def unmet(pool: DataFrame, dimensions: dict[str, Column], targets: DataFrame, config: DataFrame) -> DataFrame:
    """(sample_run, dimension, category, wanted, available, quota) of the targets whose quota falls short of what they ask for because too few records exist."""
    held = availability(pool, dimensions)
    asked = few(wanted(targets, config).join(F.broadcast(held), ["dimension", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0))), MOST_TARGETS)
    groups: dict[tuple, list] = {}
    for r in asked:
        groups.setdefault((r["sample_run"], r["dimension"]), []).append(r)
    out = []
    for (run, dimension), rows in groups.items():
        rows = [r for r in rows if r["wanted"] is not None]
        _, short = allotted(rows, {r["category"]: r["available"] for r in rows}, int(rows[0]["target_size"] or 0) if rows else 0)
        out += [(run, dimension, k, w, have, got) for k, w, have, got in short]
    return pool.sparkSession.createDataFrame(out, "sample_run string, dimension string, category string, wanted long, available long, quota long")


def allotted(asked: list, available: dict, size: int) -> tuple[dict, list[tuple]]:
    """(quota by category, (category, wanted, available, quota) of the targets out of reach) of the targets of a run and dimension."""
    quota = quotas({r["category"]: float(r["target_share"] or 0) for r in asked}, {r["category"]: int(r["min_count"] or 0) for r in asked}, available, size)
    reach = {r["category"]: (int(r["wanted"] or 0), available.get(r["category"], 0)) for r in asked}
    return quota, [(k, w, have, quota[k]) for k, (w, have) in reach.items() if quota[k] <= have < w]


def quotas(shares: dict[str, float], floors: dict[str, int], available: dict[str, int], size: int) -> dict[str, int]:
    """Integer quotas by largest remainder: at least the floors, at most what exists, summing to size where possible."""
    names = sorted(shares)
    low = {k: min(floors.get(k, 0), available.get(k, 0)) for k in names}
    quota = {k: max(low[k], min(available.get(k, 0), int(shares[k] * size))) for k in names}
    while True:
        apart = size - sum(quota.values())
        open_ = [k for k in names if (quota[k] < available.get(k, 0) if apart > 0 else quota[k] > low[k])]
        if not apart or not open_:
            return quota
        lack = {k: shares[k] * size - quota[k] for k in open_}
        ranked = sorted(open_, key=lambda k: (-lack[k] if apart > 0 else lack[k], k))
        if abs(apart) <= len(ranked):
            for k in ranked[: abs(apart)]:
                quota[k] += 1 if apart > 0 else -1
            continue
        weight = sum(shares[k] for k in open_) or len(open_)
        for k in ranked:
            step = max(1, int(abs(apart) * (shares[k] if sum(shares[x] for x in open_) else 1) / weight))
            room = available.get(k, 0) - quota[k] if apart > 0 else quota[k] - low[k]
            step = min(step, room, abs(size - sum(quota.values())))
            quota[k] += step if apart > 0 else -step


def fit(cells: np.ndarray, counts: np.ndarray, goals: list[np.ndarray], size: int, rounds: int = 200, floors: list[np.ndarray] | None = None) -> np.ndarray:
    """Integer picks per cell. cells: one category code per dimension; goals: picks wanted per code and dimension; floors: picks that are to be had before the goals of others."""
    size = int(min(size, counts.sum()))
    x = counts * (size / max(1, counts.sum()))
    for _ in range(rounds):
        before = x
        for d, goal in enumerate(goals):
            held = np.bincount(cells[:, d], weights=x, minlength=len(goal))
            x = np.minimum(x * np.divide(goal, held, out=np.ones(len(goal)), where=held > 0)[cells[:, d]], counts)
        if np.abs(x - before).max(initial=0) < 1e-6:
            break
    pick = np.floor(x + 1e-9).astype(np.int64)
    lack = [goal - np.bincount(cells[:, d], weights=pick, minlength=len(goal)) for d, goal in enumerate(goals)]
    scale = [np.maximum(1.0, goal) for goal in goals]
    while (left := size - int(pick.sum())) != 0:
        up = 1 if left > 0 else -1
        need = sum((np.clip(g, -1, 1) + np.clip(g, -1e9, 1e9) / s)[cells[:, d]] for d, (g, s) in enumerate(zip(lack, scale, strict=True))) * up + 1e-3 * (x - pick) * up
        free = np.flatnonzero(pick < counts if up > 0 else pick > 0)
        if not len(free):
            break
        # The neediest cells first; of each category no more a turn than it lacks, so that a turn is as good as one cell at a time.
        order = free[np.argsort(-need[free], kind="stable")]
        order = order[need[order] >= need[order[0]] - 1]
        for d, g in enumerate(lack):
            code = cells[order, d]
            place = np.empty(len(order), dtype=np.int64)
            by = np.argsort(code, kind="stable")
            first = np.r_[0, np.flatnonzero(np.diff(code[by])) + 1]
            place[by] = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            order = order[place < np.maximum(1, np.abs(g[code]) / 2)]
        order = order[: abs(left)]
        pick[order] += up
        for d, goal in enumerate(goals):
            lack[d] -= up * np.bincount(cells[order, d], minlength=len(goal))
    held = [goal - g for goal, g in zip(goals, lack, strict=True)]
    floors = floors or [np.zeros(len(goal)) for goal in goals]
    cost = lambda d, k: np.abs(goals[d] - k) + FLOOR_WEIGHT * np.maximum(0.0, floors[d] - k)
    while True:  # exchanges that bring the marginals nearer, until none does; each lowers the cost, so they end
        up, down = ([cost(d, h + step) - cost(d, h) for d, h in enumerate(held)] for step in (1, -1))
        gain = -sum((u[cells[:, d]] for d, u in enumerate(up)), np.zeros(len(pick)))
        room, giving = np.flatnonzero(pick < counts), np.flatnonzero(pick > 0)
        if len(room) > 16:  # the first sixteen of a stable order
            room = room[gain[room] >= -np.partition(-gain[room], 15)[15]]
        best, swap = -1e-9, None
        for i in room[np.argsort(-gain[room], kind="stable")[:16]].tolist():
            change = np.zeros(len(giving))
            for d in range(len(goals)):
                mine, theirs = cells[i, d], cells[giving, d]
                change += np.where(theirs == mine, 0.0, up[d][mine] + down[d][theirs])
            change[giving == i] = np.inf
            j = int(np.argmin(change)) if len(change) else 0
            if len(change) and change[j] < best:
                best, swap = change[j], (i, int(giving[j]))
        if swap is None:
            break
        for k, step in zip(swap, (1, -1), strict=True):
            pick[k] += step
            for d in range(len(goals)):
                held[d][cells[k, d]] += step
    return pick


def matched_sample(pool: DataFrame, key: str, dimensions: dict[str, Column], targets: DataFrame, config: DataFrame) -> DataFrame:
    """(sample_run, key, one column per dimension): the sample of every run of config.

    targets and config are tables of settings.
    """
    spark = pool.sparkSession
    names = list(dimensions)
    goals = few(wanted(targets, config), MOST_TARGETS)
    known = {d: sorted({r["category"] for r in goals if r["dimension"] == d and r["category"]}) for d in names}
    code = {d: F.when(folded(c).isin(*known[d]), folded(c)).otherwise(F.lit(OTHER)) if known[d] else F.lit(OTHER) for d, c in dimensions.items()}
    coded = cut(pool.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[code[d].alias(d) for d in names]))
    counted = coded.groupBy(*names).count()
    rows = sorted(few(counted, MOST_CELLS), key=lambda r: tuple(r[d] for d in names))
    counts = np.array([r["count"] for r in rows], dtype=np.int64)
    cells = np.zeros((len(rows), len(names)), dtype=np.int64)
    for d, name in enumerate(names):
        at = {k: i for i, k in enumerate([*known[name], OTHER])}
        cells[:, d] = [at[r[name]] for r in rows]
    plan = []
    for c in few(config.select("sample_run", "target_size", "random_seed"), MOST_RUNS):
        run, size = c["sample_run"], int(c["target_size"] or 0)
        if run is None or not rows:
            continue
        wants, least = [], []
        for d, name in enumerate(names):
            cats = [*known[name], OTHER]
            at = {k: i for i, k in enumerate(cats)}
            have = np.bincount(cells[:, d], weights=counts, minlength=len(cats))
            asked = [r for r in goals if r["sample_run"] == run and r["dimension"] == name and r["category"]]
            if not asked:
                wants.append(have * min(1.0, size / max(1, counts.sum())))
                least.append(np.zeros(len(cats)))
                continue
            got, _ = allotted(asked, {r["category"]: int(have[at[r["category"]]]) for r in asked}, size)
            goal = np.array([float(got.get(k, 0)) for k in cats])
            goal[-1] = max(0, min(have[-1], size - goal.sum()))
            wants.append(goal)
            floor = {r["category"]: min(int(r["min_count"] or 0), int(have[at[r["category"]]])) for r in asked}
            least.append(np.array([float(floor.get(k, 0)) for k in cats]))
        for r, n in zip(rows, fit(cells, counts, wants, size, floors=least), strict=True):
            if n:
                share = min(1.0, n / r["count"] + 6 * (n / r["count"] ** 2) ** 0.5 + 30 / r["count"])
                plan.append((run, int(c["random_seed"] or 0), *[r[d] for d in names], int(n), float(share)))
    schema = "sample_run string, seed long, " + ", ".join(f"`{d}` string" for d in names) + ", quota long, share double"
    def chosen(plan: list[tuple]) -> DataFrame:
        """The smallest keys of each cell of the plan, as far as they lie below the cell's threshold."""
        placed = coded.join(spark.createDataFrame(plan, schema), names).withColumn("_h", F.shiftrightunsigned(F.xxhash64("seed", "_key"), 11))
        placed = placed.where(F.col("_h") / F.lit(float(1 << 53)) < F.col("share"))
        order = Window.partitionBy("sample_run", *names).orderBy("_h", "_key")
        return cut(placed.withColumn("_r", F.row_number().over(order)).where("_r <= quota").select("sample_run", F.col("_key").alias(key), *names))

    picked = chosen(plan)
    while True:
        held = {tuple(r[:-1]): r["count"] for r in few(picked.groupBy("sample_run", *names).count(), MOST_RUNS * MOST_CELLS)}
        short = [(*p[:-1], 2 * p[-1]) for p in plan if p[-1] < 1 and held.get((p[0], *p[2:-2]), 0) < p[-2]]
        if not short:
            return picked
        plan = short
        again = spark.createDataFrame([(p[0], *p[2:-2]) for p in short], "sample_run string, " + ", ".join(f"`{d}` string" for d in names))
        picked = picked.join(again, ["sample_run", *names], "left_anti").unionByName(chosen(short))


def composition(sample: DataFrame, dimensions: list[str], targets: DataFrame, config: DataFrame) -> DataFrame:
    """(sample_run, dimension, category, target_share, wanted, picked, share, deviation, lacking) of every target."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in dimensions])
    held = sample.select("sample_run", F.explode(pairs).alias("p")).groupBy("sample_run", "p.dimension", "p.category").agg(F.count("*").alias("picked"))
    sizes = sample.groupBy("sample_run").agg(F.count("*").alias("size"))
    rows = wanted(targets, config).join(F.broadcast(held), ["sample_run", "dimension", "category"], "left").join(F.broadcast(sizes), "sample_run", "left").withColumn("picked", F.coalesce("picked", F.lit(0)))
    share = F.col("picked") / F.col("size")
    return rows.select("sample_run", "dimension", "category", "target_share", "wanted", "picked", share.alias("share"), F.abs(share - F.col("target_share")).alias("deviation"), F.greatest(F.lit(0), F.col("wanted") - F.col("picked")).alias("lacking"))
