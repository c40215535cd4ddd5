import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pilegrain.llm.caps import beyond, day_of, within
from pilegrain.llm.mixing import mixed, quotas, report, source_tokens, turns
from pilegrain.llm.quota import composition, fit, matched_sample, unmet
from pilegrain.llm.quota import quotas as integer_quotas
from pilegrain.llm.stable import grown_sample

POOL = "k long, load int, extra string"


def test_sample_is_stable_as_loads_arrive(spark):
    runs = spark.createDataFrame([("a", 50, 1), ("b", 5, 2), ("all", 10_000, 3)], "run string, target long, seed long")
    rows = [(i, 1 + i // 250, "x") for i in range(1000)] + [(5, 4, "later copy"), (None, 1, "x"), (2000, None, "x")]
    pick = lambda data, n: {(r["run"], r["k"]) for r in grown_sample(spark.createDataFrame(data, POOL).repartition(n), "k", "load", runs, "run", "target", "seed").collect()}
    whole = pick(rows, 3)
    assert whole == pick(random.Random(1).sample(rows, len(rows)), 7)
    for load in (1, 2, 3):
        part = pick([r for r in rows if (r[1] or 1) <= load], 2)
        assert part <= whole
    first = pick([r for r in rows if r[1] == 1], 2)
    assert sum(r == "a" for r, _ in first) == 50 and sum(r == "b" for r, _ in first) == 5
    assert {k for r, k in whole if r == "all"} == set(range(1000)) | {2000}
    assert grown_sample(spark.createDataFrame([], POOL), "k", "load", runs, "run", "target", "seed").collect() == []


def test_a_small_sample_of_a_large_pool_meets_its_target(spark):
    runs = spark.createDataFrame([("few", 100, 1), ("none", 0, 1), (None, 5, 1)], "run string, target long, seed long")
    pool = spark.range(300_000).selectExpr("id AS k", "1 AS load", "'x' AS extra")
    assert grown_sample(pool, "k", "load", runs, "run", "target", "seed").count() == 100


def test_caps_against_a_greedy_one(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 1, 2, 3]), r.choice(["d1", "d2", None]), r.choice([0.1, 0.5, 0.9, None, float("nan")])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c long, d string, s double")
    got = {x["id"] for x in within(df, [(["c", "d"], 7), (["c"], 15)], "s", "id").collect()}
    key = lambda x: (x[3] is None or x[3] != x[3], -(x[3] if x[3] is not None and x[3] == x[3] else 0), x[0])
    left, want = {}, set()
    for c in {x[1] for x in rows}:
        kept = []
        for d in {x[2] for x in rows}:
            kept += sorted((x for x in rows if x[1] == c and x[2] == d), key=key)[:7]
        want |= {x[0] for x in sorted(kept, key=key)[:15]}
    del left
    assert got == want
    assert {x["id"] for x in beyond(df, [(["c", "d"], 7), (["c"], 15)], "s", "id").collect()} == {x[0] for x in rows} - want
    assert within(df, [(["c"], None)], "s", "id").count() == 300
    shares = within(df, [(["c", "d"], 0.05), (["c"], 0.1)], "s", "id").groupBy("c").count().collect()  # 15 of each cluster and day, 30 of each cluster
    assert max(r["count"] for r in shares) == 30
    assert beyond(df.limit(0), [(["c"], 1)], "s", "id").collect() == []


def test_days(spark):
    got = spark.createDataFrame([(x,) for x in ("2020-01-02T10:00:00", " 2020-01-02", "undated", " Undated", "", None)], "d string").select(day_of(F.col("d"))).collect()
    assert [r[0] for r in got] == ["2020-01-02", "2020-01-02", "undated", "undated", "undated", "undated"]


def test_integer_quotas():
    assert integer_quotas({"a": 0.5, "b": 0.3, "c": 0.2}, {}, {"a": 99, "b": 99, "c": 99}, 10) == {"a": 5, "b": 3, "c": 2}
    got = integer_quotas({"a": 0.98, "b": 0.02}, {"b": 5}, {"a": 1000, "b": 1000}, 100)
    assert got == {"a": 95, "b": 5}
    assert integer_quotas({"a": 0.9, "b": 0.1}, {}, {"a": 20, "b": 1000}, 100) == {"a": 20, "b": 80}
    assert sum(integer_quotas({x: 1 / 7 for x in "abcdefg"}, {}, dict.fromkeys("abcdefg", 1000), 100).values()) == 100


def test_fit_meets_several_marginals():
    cells = np.array([(i, j) for i in range(3) for j in range(2)])
    counts = np.array([500, 50, 300, 300, 20, 700])
    goals = [np.array([50.0, 30.0, 20.0]), np.array([60.0, 40.0])]
    pick = fit(cells, counts, goals, 100)
    assert pick.sum() == 100 and (pick <= counts).all()
    for d, goal in enumerate(goals):
        assert np.abs(np.bincount(cells[:, d], weights=pick) - goal).max() <= 1


def test_fit_of_many_cells_is_quick():
    import time

    r = np.random.default_rng(6)
    cells = np.stack([r.integers(0, k, 200_000) for k in (12, 9, 30, 6, 8, 40)], axis=1)
    counts = r.integers(1, 50, 200_000)
    size = 300_000
    goals = [size * (p := np.sort(r.dirichlet(np.full(k, 20.0)))) / p.sum() for k in (12, 9, 30, 6, 8, 40)]
    t = time.time()
    pick = fit(cells, counts, goals, size)
    assert time.time() - t < 20
    assert pick.sum() == size and (pick <= counts).all() and (pick >= 0).all()
    for d, goal in enumerate(goals):
        assert np.abs(np.bincount(cells[:, d], weights=pick) - goal).max() < 20


CONFIG = "sample_run string, target_size long, random_seed long"
TARGETS = "sample_run string, dimension string, category string, target_share double, min_count long"


def test_matched_sample_and_shortfalls(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["A ", "a", "b", None]), r.choice(["x", "y"])) for i in range(3000)]
    pool = spark.createDataFrame(rows, "face_id long, size string, pose string")
    config = spark.createDataFrame([("one", 200, 7)], CONFIG)
    targets = spark.createDataFrame([("one", "size", "a", 0.3, 0), ("one", "size", "b", 0.6, 0), ("one", "size", "c", 0.1, 9), ("one", "pose", "x", 0.9, 0), ("one", "pose", "y", 0.1, 30)], TARGETS)
    dims = {"size": F.col("size"), "pose": F.col("pose")}
    sample = matched_sample(pool, "face_id", dims, targets, config)
    got = sample.collect()
    assert len(got) == 200 and len({x["face_id"] for x in got}) == 200
    told = {(x["dimension"], x["category"]): x for x in composition(sample, ["size", "pose"], targets, config).collect()}
    assert told["pose", "y"]["picked"] >= 30 and told["size", "c"]["lacking"] == 20
    assert [(x["dimension"], x["category"]) for x in unmet(pool, dims, targets, config).collect()] == [("size", "c")]
    again = matched_sample(pool.repartition(6), "face_id", dims, targets, config)
    assert sorted(x["face_id"] for x in again.collect()) == sorted(x["face_id"] for x in got)
    assert matched_sample(pool.limit(0), "face_id", dims, targets, config).collect() == []


def test_turns_stay_within_one_block():
    weights = {"a": 0.5, **{f"s{i}": 0.01 for i in range(50)}}
    slots, held = turns(weights)
    assert sorted(x for p, _ in held.values() for x in p) == list(range(slots))
    for p, stride in held.values():
        w = len(p) / slots
        assert stride >= 1
        for i, at in enumerate(p):
            assert -1 < i - w * at < 1 and -1 < (i + 1) - w * (at + 1) < 1
    assert turns({}) == (0, {})


def test_any_positive_weight_keeps_its_rate():
    weights = {"a": 0.7, "b": 0.3 - 2e-5 - 1e-9, "c": 2e-5, "d": 1e-9}
    slots, held = turns(weights)
    for s, w in weights.items():
        places, stride = held[s]
        at = lambda i, p=places, k=stride: int(i * k) // len(p) * slots + p[int(i * k) % len(p)]
        blocks = 2000
        total = sum(len(p) / k for p, k in held.values())  # blocks of a period
        assert abs(at(blocks) / slots * total * w - blocks) < 2 + blocks * 1e-3
        assert len({at(i) for i in range(blocks)}) == blocks


def test_mix_of_a_tiny_share(spark):
    docs = [(i, "big", 10) for i in range(3000)] + [(5000 + i, "tiny", 10) for i in range(5)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "big", 0.99998, 1, 30_000), ("m", "tiny", 0.00002, 1, 30_000)], "mix_name string, source string, target_share double, max_repeats int, total_tokens long")
    told = {r["source"]: r for r in report(mixed(sized, targets, "doc_id", block_tokens=50), targets, source_tokens(sized)).collect()}
    assert told["tiny"]["given_tokens"] == 10 and told["big"]["given_tokens"] == 30_000
    assert not told["tiny"]["short"] and not told["big"]["short"]


def test_mix_reaches_targets_and_respects_caps(spark):
    docs = [(i, "big", 10) for i in range(2000)] + [(5000 + i, "small", 10) for i in range(20)] + [(6000, None, 10), (6001, "big", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "Big", 0.5, 1, 2000), ("m", " small", 0.3, 3, 2000), ("m", "none", 0.2, 9, 2000)], "mix_name string, source string, target_share double, max_repeats int, total_tokens long")
    mix = mixed(sized, targets, "doc_id", block_tokens=50)
    told = {r["source"]: r for r in report(mix, targets, source_tokens(sized)).collect()}
    assert told["big"]["given_tokens"] == 1000 and told["small"]["given_tokens"] == 600 and told["small"]["passes"] == 3 and told["none"]["given_tokens"] == 0
    uses = {}
    for r in mix.collect():
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    assert max(uses.values()) == 3 and max(uses[i] for i in uses if i < 5000) == 1
    positions = sorted({(r["source"], r["position"]) for r in mix.collect()}, key=lambda x: x[1])
    assert len({p for _, p in positions}) == len(positions)
    assert {r["source"] for r in quotas(targets, source_tokens(sized)).where("asked > most").collect()} == {"none"}
    assert {s for s, r in told.items() if r["short"]} == {"none"}
    assert mixed(sized.limit(0), targets, "doc_id").collect() == []


@pytest.mark.parametrize("seed", [0, 2, 3])
def test_cells_without_records_do_not_change_the_plan(seed):
    rng = np.random.default_rng(seed)
    cells = np.unique(rng.integers(0, 12, (400, 6)), axis=0)
    counts = rng.integers(1, 6, len(cells))
    goals = []
    for _ in range(6):
        goal = np.floor(rng.dirichlet(np.ones(12)) * 300)
        goal[0] += 300 - goal.sum()
        goals.append(goal)
    plan = fit(cells, counts, goals, 300, rounds=20)
    more = fit(np.r_[cells, np.zeros((400_000, 6), dtype=int)], np.r_[counts, np.zeros(400_000, dtype=int)], goals, 300, rounds=20)
    assert plan.sum() == 300 and (more[: len(cells)] == plan).all() and not more[len(cells) :].any()
