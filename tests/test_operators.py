import numpy as np
import pytest
from pyspark.sql import functions as F

from pilegrain.operators import cluster, dedup, review, sampling, vectors
from pilegrain.operators.ranking import global_rank, running_sum
from pilegrain.sources import results, scan
from pilegrain.sources.tables import current_rows


def planted(groups, lone, dim=32, seed=3):
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    rows, truth = [], {}
    for g, n in enumerate(groups):
        centre = unit(r.standard_normal(dim))
        for _ in range(n):
            truth[len(rows)] = g
            rows.append((len(rows), [float(x) for x in unit(centre + 0.05 * r.standard_normal(dim))]))
    for _ in range(lone):
        truth[len(rows)] = -1
        rows.append((len(rows), [float(x) for x in unit(r.standard_normal(dim))]))
    return rows, truth


@pytest.mark.parametrize("algorithm", ["components", "whispers", "linkage", "density"])
def test_planted_groups(spark, algorithm):
    rows, truth = planted([6, 5, 4], 5)
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["label"] for r in cluster.group(v, algorithm, 0.7, 10).collect()}
    assert set(got) == set(truth)
    for g in range(3):
        labels = {got[i] for i, t in truth.items() if t == g}
        assert len(labels) == 1 and -1 not in labels
    assert len({got[i] for i, t in truth.items() if t >= 0}) == 3
    if algorithm != "density":
        assert all(got[i] == -1 for i, t in truth.items() if t == -1)


def test_unknown_algorithm_and_limit(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    with pytest.raises(ValueError):
        cluster.group(v, "none")
    with pytest.raises(ValueError):
        cluster.by_density(v, limit=0)


def test_weak_bridge_splits_under_linkage_only(spark):
    edges = [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9), (4, 5, 0.9), (5, 6, 0.9), (4, 6, 0.9), (3, 4, 0.6)]
    v = spark.range(1, 8).select("id")
    graph = spark.createDataFrame(edges, "src long, dst long, sim double")
    joined = {r["id"]: r["label"] for r in cluster.by_components(v, graph).collect()}
    apart = {r["id"]: r["label"] for r in cluster.by_linkage(v, graph).collect()}
    assert joined == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: -1}
    assert apart == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: -1}


def test_blocks_do_not_change_neighbours(spark):
    rows, _ = planted([10, 7], 20)
    v = spark.createDataFrame(rows, "id long, v array<double>")
    x = np.array([r[1] for r in rows])
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:3]}
    found = vectors.with_cosine(vectors.blocked(v, v, 3, -1.0, block=8, same=True), v, v)
    assert want <= {(r["src"], r["dst"]) for r in found.collect()}
    assert {(r["src"], r["dst"]) for r in vectors.nearest(v, v, 3, same=True).collect()} == want


def _whole(n, seed=3):
    """Vectors of a byte, of single and of double precision around planted centres, with what all pairs say."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 16))
    x = centre[rng.integers(0, 6, n)] + 0.7 * rng.normal(size=(n, 16))
    x[: n // 2] = np.rint(x[: n // 2] * 16) / 32
    x[n // 2 : 3 * n // 4] = x[n // 2 : 3 * n // 4].astype(np.float32)
    group = rng.integers(0, 9, n)
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [(10 * i, x[i].tolist(), int(group[i])) for i in range(n)], np.triu(v @ v.T, 1) - np.tril(np.full((n, n), 9.0)), group


def test_spanning_edges_have_the_components_of_all_pairs(spark):
    rows, sims, _ = _whole(90)
    v = spark.createDataFrame(rows, "id long, v array<double>, g long")
    blocks = vectors.blocks_of(vectors.packed(v), block=20)
    assert blocks.count() > 2
    cuts = [0.9, 0.75, 0.6]
    found = vectors.spanning(blocks, cuts).cache()
    for t in cuts:
        s, d = np.nonzero(sims >= t)
        all_ = spark.createDataFrame([(10 * int(i), 10 * int(j), t) for i, j in zip(s, d, strict=True)], "src long, dst long, sim double")
        want, got = ({r["id"]: r["label"] for r in cluster.by_components(v, g).collect()} for g in (all_, found.where(F.col("sim") >= t)))
        assert got == want and len(set(want.values())) > 1
    assert found.count() < (sims >= min(cuts)).sum()


def test_spanning_edges_of_many_blocks_are_few(spark, monkeypatch):
    """Cells of a task share a forest, and forests are put together: the edges do not grow with the number of cells, also where a forest is told in parts."""
    rows, sims, _ = _whole(90)
    v = spark.createDataFrame(rows, "id long, v array<double>, g long")
    blocks = vectors.blocks_of(vectors.packed(v), block=6)
    parts, cuts = blocks.count(), [0.9, 0.6]
    found = vectors.spanning(blocks, cuts).collect()
    assert parts > 10 and len(found) < 90
    monkeypatch.setattr(vectors, "FOREST", 40)
    told = vectors.spanning(blocks, cuts).collect()
    for t in cuts:
        s, d = np.nonzero(sims >= t)
        all_ = spark.createDataFrame([(10 * int(i), 10 * int(j), t) for i, j in zip(s, d, strict=True)], "src long, dst long, sim double")
        want = {r["id"]: r["label"] for r in cluster.by_components(v, all_).collect()}
        for edges in (found, told):
            g = spark.createDataFrame(edges, "src long, dst long, sim double").where(F.col("sim") >= t)
            assert {r["id"]: r["label"] for r in cluster.by_components(v, g).collect()} == want


def test_closest_of_every_two_groups(spark):
    rows, sims, group = _whole(90)
    blocks = vectors.blocks_of(vectors.packed(spark.createDataFrame(rows, "id long, v array<double>, g long")), block=20)
    want = {}
    for i, j in zip(*np.nonzero(sims >= 0.8), strict=True):
        if group[i] != group[j]:
            at = tuple(sorted((int(group[i]), int(group[j]))))
            want[at] = (max(want.get(at, (0, 0))[0], sims[i, j]), want.get(at, (0, 0))[1] + 1)
    got = {(r["x"], r["y"]): (r["sim"], r["pairs"]) for r in vectors.closest(blocks, 0.8).collect()}
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-12) for k in want)


def test_packed_vectors_are_opened_without_loss(spark):
    rows, _, _ = _whole(40)
    v = spark.createDataFrame(rows, "id long, v array<double>, g long")
    block = vectors.opened(*vectors.blocks_of(vectors.packed(v)).drop("block").first())
    assert {r["w"] for r in vectors.packed(v).collect()} == {1, 4, 8}
    want = {r["id"]: list(r["u"]) for r in v.select("id", vectors.unit(F.col("v")).alias("u")).collect()}
    assert {i: x.tolist() for i, x in zip(block.ids.tolist(), block.v.T, strict=True)} == want


@pytest.mark.parametrize("name", ["closest_pairs", "experiment_slices", "experiment_run", "largest_pile_verdict"])
def test_a_library_meets_itself_without_a_shuffle_of_pairs(spark, sf, name, monkeypatch):
    from pilegrain.plans import experiments

    def refused(*_, **__):
        raise AssertionError("blocks of vectors are copied for every other block")

    monkeypatch.setattr(vectors, "blocked", refused)
    experiments.QUERIES[name](spark, sf).collect()


def test_principal_keeps_groups(spark):
    rows, truth = planted([8, 8], 0)
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: np.array(r["v"]) for r in cluster.principal(v, 3).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 and len(x) == 3 for x in got.values())
    assert np.mean([got[0] @ got[i] for i in truth if truth[i] == 0]) > np.mean([got[0] @ got[i] for i in truth if truth[i] == 1])


def test_sums_and_tightness(spark):
    rows, truth = planted([5, 4], 0)
    v = spark.createDataFrame([(truth[i], x) for i, x in rows], "g long, v array<double>")
    x = np.array([r[1] for r in rows])
    got = vectors.group_sums(v, "g", "v", 32).withColumn("t", vectors.tightness(None)).collect()
    for r in got:
        m = x[[i for i in truth if truth[i] == r["g"]]]
        s = m @ m.T
        assert r["n"] == len(m) and r["t"] == pytest.approx((s.sum() - np.trace(s)) / (len(m) * (len(m) - 1)), abs=1e-4)


def test_unit(spark):
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.unit(F.col("v"))).collect()
    assert [list(r[0]) for r in got] == [[0.6, 0.8], [0.0, 0.0]]


def test_ranks_and_sums(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id long, x long").repartition(5)
    ranked = global_rank(rows, [F.asc("x")], "r")
    got = sorted((r["r"], r["x"]) for r in ranked.collect())
    assert got == [(i + 1, i) for i in range(101)]
    summed = running_sum(ranked, "r", {"s": "x"}, block=10).collect()
    assert all(r["s"] == r["x"] * (r["x"] + 1) // 2 for r in summed)


def test_current_row(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (2, "c", None), (None, "d", 9)], "k int, v string, t int")
    assert sorted((r["k"], r["v"]) for r in current_rows(rows, ["k"], "t", ["v"]).collect()) == [(1, "b"), (2, "c")]


def _slow(rows, size, targets, bonus):
    dims, chosen, have = list(targets), [], {d: dict.fromkeys(c, 0) for d, c in targets.items()}
    left = sorted(rows, key=lambda r: r["face_id"])
    total = min(size, len(left))
    while len(chosen) < total:
        score = lambda r: (bonus if r["cross_era"] else 0.0) + sum(max(0.0, targets[d][r[d]] * total - have[d][r[d]]) / max(1.0, total) for d in dims)
        best = max(left, key=lambda r: (round(score(r), 12), -r["face_id"]))
        left.remove(best)
        chosen.append(best["face_id"])
        for d in dims:
            have[d][best[d]] += 1
    return chosen


def test_greedy_against_a_slow_one(spark):
    r = np.random.default_rng(5)
    targets = {"size": {"s": 0.3, "m": 0.5, "l": 0.2}, "era": {"old": 0.6, "new": 0.4}}
    rows = [{"face_id": i, "cluster_id": i % 7, "det_score": float(r.random()), "size": str(r.choice(["s", "m", "l"])), "era": str(r.choice(["old", "new"])), "cross_era": bool(r.random() < 0.2)} for i in range(120)]
    df = spark.createDataFrame(rows)
    got = sorted(x["face_id"] for x in sampling.greedy(df, 40, targets, lowest=0).collect())
    held = [x for x in rows if x["face_id"] in got]
    slow = [x for x in rows if x["face_id"] in _slow(rows, 40, targets, 0.5)]
    count = lambda xs: sorted((x["size"], x["era"], x["cross_era"]) for x in xs)
    assert len(got) == 40 and count(held) == count(slow)


def test_caps_and_reserve(spark):
    rows = spark.createDataFrame([(i, 1, 0.5 + i / 1000, f"d{i % 10}") for i in range(100)] + [(200 + i, -1, 0.1, "d") for i in range(9)], "face_id long, cluster_id long, det_score double, day string")
    kept = sampling.capped(rows, 3, 20)
    assert kept.where("cluster_id = 1").count() == 20 and kept.where("cluster_id = -1").count() == 9
    assert kept.where("cluster_id = 1").groupBy("day").count().agg(F.max("count")).first()[0] <= 3
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, sampling.capped(rows.repartition(3), 3, 20).collect()))
    low = sampling.reserve(rows, 20, lowest=2, noise_share=0.1).collect()
    assert sorted(r["reserved_for"] for r in low) == ["detector_fp"] * 2 + ["noise_review"] * 2


LOG = "face_id long, kind string, person_id string, at int, batch string"


def test_log_undo_and_protection(spark):
    log = spark.createDataFrame([(1, "person", "a", 1, "seed"), (2, "person", "a", 2, "b1"), (2, "unassigned", None, 3, "b2"), (3, "junk", None, 3, "b2")], LOG)
    now = {r["face_id"]: (r["kind"], r["person_id"]) for r in review.state(log).collect()}
    assert now == {1: ("person", "a"), 2: ("unassigned", None), 3: ("junk", None)}
    newest = review.newest_batch(log)
    assert newest.first()["batch"] == "b2"
    after = review.standing(log, newest.select("batch"))
    assert {r["face_id"]: r["kind"] for r in review.state(after).collect()} == {1: "person", 2: "person"}
    again = review.standing(after, review.newest_batch(after).select("batch"))
    assert review.newest_batch(again).collect() == [] and again.count() == 1
    skips = spark.createDataFrame([("7", 9)], "batch string, at int")
    assert review.newest_batch(log, skips).first()["what"] == "skip"


def test_open_owned_seeded(spark):
    log = spark.createDataFrame([(1, "person", "a", 1, "x"), (2, "unassigned", None, 1, "x")], LOG)
    now = review.state(log)
    members = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, -1)], "face_id long, pile_id long")
    assert sorted(r["face_id"] for r in review.open_faces(members, now).collect()) == [2, 3, 4]
    assert [r["face_id"] for r in review.owned(members, now, "a").collect()] == [1]
    gold = spark.createDataFrame([(1, "z"), (9, "z")], "face_id long, person_id string")
    assert [r["face_id"] for r in review.seeded(log, gold, F.lit(2)).collect()] == [9]
    assert review.act(members, "junk", F.lit(3), "b").columns == ["face_id", "kind", "person_id", "at", "batch"]
    assert [r["face_id"] for r in review.bucket_of(members, now, "lone").collect()] == [4]


def test_near_names(spark):
    names = ["Person 12", "person 13", "person 1", "perso 12x", "abcdef", "abcdfe", "", None, "xy"]
    got = {(r["a"], r["b"]) for r in review.near_names(spark.createDataFrame([(n,) for n in names], "n string"), "n", 2).collect()}

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    clean = sorted({n.strip().lower() for n in names if n and n.strip()})
    assert got == {(a, b) for a in clean for b in clean if a < b and distance(a, b) <= 2}


def test_near_duplicates_cover_every_id_within_two_edits(spark, tmp_path):
    from pilegrain.plans.reviews import name_near_duplicates

    names = ["person_15", "Person_1", "person_0015", "person_0915 ", "ann", "anna", "hanna", "bo", None, "  "]
    rows = [(i, "person", n) for i, n in enumerate(names)] + [(99, "unsure", "ann3")]
    spark.createDataFrame(rows, "face_id long, label string, person_id string").write.parquet(str(tmp_path / "gold_labels.parquet"))
    got = {tuple(r) for r in name_near_duplicates(spark, str(tmp_path)).collect()}
    assert got == {("person_1", "person_15", 1), ("person_0015", "person_15", 2), ("person_0915", "person_15", 2), ("person_0015", "person_0915", 1), ("ann", "anna", 1), ("ann", "hanna", 2), ("anna", "hanna", 1)}


def test_two_stage_duplicates(spark):
    long = "x" * 20_000
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, long + "y" + long), (5, long + "z" + long), (6, None), (7, "")], "id long, t string")
    got = {r["id"]: r["kept_id"] for r in dedup.two_stage(rows.where("t IS NOT NULL"), "id", "t").collect()}
    assert got == {2: 1}


def test_scan_and_upsert(spark, tmp_path):
    for name in ("a.jpg", "d/b.jpg", ".hidden/c.jpg", "d/.e"):
        (tmp_path / "lib" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / name).write_bytes(b"12345")
    found = scan.list_files(spark, str(tmp_path / "lib"))
    assert sorted((r["rel_path"], r["size_bytes"]) for r in found.collect()) == [("a.jpg", 5), ("d/b.jpg", 5)]
    known = found.where("rel_path = 'a.jpg'")
    assert [r["rel_path"] for r in scan.unseen(found, known, ["path", "size_bytes", "mtime"]).collect()] == ["d/b.jpg"]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, scan.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    where = scan.save_version(old, str(tmp_path / "t"), 1)
    assert spark.read.parquet(where).count() == 2


def test_results(spark, tmp_path):
    path = str(tmp_path / "results")
    results.append_result(spark.createDataFrame([("components", 0.9, 3.0, 1)], "algorithm string, bcubed_f1 double, seconds double, run_at int"), path)
    results.append_result(spark.createDataFrame([("components", 7.0, 4.0, 2, "x")], "algorithm string, bcubed_f1 double, seconds double, run_at int, note string"), path)
    sound, suspect = results.read_results(spark, path)
    assert (sound.count(), suspect.count()) == (1, 1)
    assert results.last_seconds(sound, "components").first()["seconds"] == 3.0
    split = spark.createDataFrame([("b", "tune"), ("a", "holdout")], "person string, side string")
    results.write_split(split, str(tmp_path / "split"))
    back = results.read_split(spark, str(tmp_path / "split"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "face_id long, person string")
    assert [r["face_id"] for r in results.only_side(rows, back, "tune").collect()] == [2]
    gold = tmp_path / "gold.csv"
    gold.write_text("face_id,label,person_id\n1,person,a\n2,person,\n3,non_face,\n4,unsure,\n")
    got = results.read_gold(spark, str(gold), "face_id long, label string, person_id string")
    assert [r["role"] for r in got.orderBy("face_id").collect()] == ["identity", "excluded", "contaminant", "excluded"]


def test_density_groups_that_part_below_epsilon_stay_together():
    import numpy as np

    from pilegrain.operators.cluster import density_labels

    r = np.random.default_rng(2)
    near = [r.normal(c, 0.02, (30, 2)) for c in ((0, 0), (0.4, 0), (5, 5), (5.4, 5))]
    x = np.vstack(near)
    fine, coarse = density_labels(x, 5)[0], density_labels(x, 5, 1.0)[0]
    groups = lambda label: [set(label[30 * i : 30 * i + 30]) - {-1} for i in range(4)]
    assert len(set.union(*groups(fine))) == 4
    a, b, c, d = groups(coarse)
    assert a == b and c == d and a != c and len(a) == len(c) == 1


def test_group_median_equals_the_exact_percentile(spark):
    import random

    from pyspark.sql import functions as F

    from pilegrain.operators.ranking import group_median

    r = random.Random(3)
    rows = [(g, r.choice([None, 1.0, 2.5, r.random() * 100, r.random() * 100, float(r.randrange(4))])) for g in (1, 2, 3) for _ in range(300 * g)]
    rows += [(4, 7.0)] * 9 + [(5, None)] * 3 + [(6, 2.0), (6, 5.0), (7, -3.0), (8, 1e300), (8, -1e300), (8, 0.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {x["g"]: (x["rows"], x["m"]) for x in group_median(df, "g", "v", "m", 16).collect()}
    want = {x["g"]: (x["n"], x["m"]) for x in df.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", 0.5).alias("m")).collect()}
    assert got.keys() == want.keys()
    for g, (n, m) in want.items():
        assert got[g][0] == n and (got[g][1] == m or abs(got[g][1] - m) < 1e-9)
    assert group_median(df.limit(0), "g", "v", "m").collect() == []
