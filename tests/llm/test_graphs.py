import random

import numpy as np
import pytest

from pilegrain.llm.consolidate import consolidate
from pilegrain.llm.piles import Signer, alike, banding, coded, described, divide, leaders, meeting, piles, quantised
from pilegrain.llm.splits import assign, bundles, entity_key


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(up)}


@pytest.mark.parametrize("seed", [3, 4])
def test_consolidate_chains_cycles_hubs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(3000, 3000 + i) for i in range(1, 60)] + [(5, None), (None, None), (7, 7), (1001, 1000)]
    rows = spark.createDataFrame([(*e, "x") for e in edges], "a long, b long, v string").repartition(5)
    got = {x[0]: x[1] for x in consolidate(rows, "a", "b", "v", "g").collect()}
    assert got == brute(edges)


def test_consolidate_empty(spark):
    assert consolidate(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_bundles_follow_every_entity(spark):
    links = [(1, "p:a"), (2, "p:a"), (2, "f:9"), (3, "f:9"), (4, "p:b"), (5, None), (None, "p:b"), (1, "p:a")] + [(100 + i, f"c:{i}") for i in range(30)] + [(101 + i, f"c:{i}") for i in range(30)]
    got = {r[0]: r[1] for r in bundles(spark.createDataFrame(links, "r long, e string"), "r", "e").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4} | {100 + i: 100 for i in range(31)}
    assert bundles(spark.createDataFrame([], "r long, e string"), "r", "e").collect() == []


def test_hot_entity_is_salted(spark):
    links = [(i, "hot") for i in range(3000)] + [(i, f"own:{i}") for i in range(3000)]
    got = bundles(spark.createDataFrame(links, "r long, e string"), "r", "e").collect()
    assert len(got) == 3000 and {r["bundle"] for r in got} == {0}


@pytest.mark.parametrize(("written", "key"), [("person_0950", "person950"), ("Person 950", "person950"), ("PERSON-950\t", "person950"), ("person 0", "person0"), ("00", "0"), ("Łuk 07", "łuk7"), ("?", "?"), (None, None)])
def test_entity_key(spark, written, key):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(written,)], "x string").select(entity_key(F.col("x"))).first()[0] == key


def test_assign_keeps_bundles_and_shares(spark):
    r = random.Random(1)
    rows = [(i, r.choice([i // 3, i // 7 + 10_000]), r.choice(["a", "b", None])) for i in range(6000)]
    done = assign(spark.createDataFrame(rows, "face_id long, b long, stratum string"), "b", "stratum", {"train": 0.7, "validation": 0.15, "test": 0.15}).collect()
    assert len(done) == 6000
    where = {}
    assert all(where.setdefault(x["b"], x["split"]) == x["split"] for x in done)
    for s, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
        assert abs(sum(x["split"] == s for x in done) / 6000 - share) < 0.02
        for k in ("a", "b", None):
            assert abs(sum(x["split"] == s and x["stratum"] == k for x in done) / sum(x["stratum"] == k for x in done) - share) < 0.04
    assert assign(spark.createDataFrame([], "face_id long, b long, stratum string"), "b", "stratum", {"train": 1.0}).collect() == []


def cloud(sizes, lone, dim=64, seed=1, noise=0.6):
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    x, truth = [], []
    for g, n in enumerate(sizes):
        centre = unit(r.standard_normal(dim))
        for _ in range(n):
            x.append(unit(centre + noise * unit(r.standard_normal(dim))))
            truth.append(g)
    for _ in range(lone):
        x.append(unit(r.standard_normal(dim)))
        truth.append(-1)
    return np.array(x), truth


def test_piles_find_planted_groups(spark):
    x, truth = cloud([300, 40, 9, 3, 2, 2], 60, dim=256)
    rows = [(i, 1, [float(y) for y in v * (2 if i % 5 == 0 else 1)]) for i, v in enumerate(x)]
    rows += rows[:7]  # copies
    rows += [(0, 0, [float(y) for y in -x[0]])]  # an older row of another direction
    rows += [(9000, 1, None), (9001, 1, []), (9002, 1, [0.0] * 256), (9003, 1, [float("nan")] * 256), (9004, 1, [1.0] * 128), (9005, 1, [float("inf")] + [0.0] * 255)]
    df = spark.createDataFrame(rows, "face_id long, t int, v array<float>").selectExpr("face_id", "timestamp_seconds(t) AS t", "v")
    members, parts = piles(quantised(df, "face_id", "t", "v", 256), 256)
    got = {r["key"]: r["pile"] for r in members.collect()}
    want = {i: truth.index(t) for i, t in enumerate(truth) if t >= 0}
    assert sum(got.get(i) == p for i, p in want.items()) >= 0.99 * len(want)
    assert all(i in want for i in got)
    told = {r["pile"]: r for r in described(members, parts, quantised(df, "face_id", "t", "v", 256), 256).collect()}
    assert told[0]["size"] == 300 and len(told[0]["typical"]) == 3 and set(told[0]["typical"]) <= set(range(300))


def test_piles_of_nothing(spark):
    empty = spark.createDataFrame([], "face_id long, t timestamp, v array<float>")
    members, parts = piles(quantised(empty, "face_id", "t", "v", 256), 256)
    assert members.collect() == parts.collect() == []


def planted(spark, x):
    rows = [(i, 1, [float(y) for y in v]) for i, v in enumerate(x)]
    return quantised(spark.createDataFrame(rows, "face_id long, t int, v array<float>").selectExpr("face_id", "timestamp_seconds(t) AS t", "v"), "face_id", "t", "v", 256)


def sets(members):
    held = {}
    for r in members.collect():
        held.setdefault(r["pile"], []).append(r["key"])
    assert all(p == min(m) for p, m in held.items())
    return sorted(sorted(m) for m in held.values())


@pytest.mark.parametrize("joined", ["chain", "hub"])
def test_a_component_of_more_items_than_a_task_takes_is_closed_exactly(spark, monkeypatch, joined):
    from pilegrain.llm import piles as module

    x, _ = cloud([2] * 60 + [3] * 10, 40, dim=256, noise=0.85)
    order = np.random.default_rng(3).permutation(len(x))
    x = x[order]
    want = divide(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x)
    chance = [(i, i + 1) if joined == "chain" else (0, i + 1) for i in range(len(x) - 1)]
    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "WIDE", 32)
    monkeypatch.setattr(module, "links", lambda *_: spark.createDataFrame(chance, "a long, b long"))
    got = sets(piles(planted(spark, x), 256)[0])
    assert got == sorted(sorted(int(i) for i in np.flatnonzero(want == p)) for p in set(want) - {-1})


def test_a_walk_of_connected_vectors_leaves_no_face_out(spark, monkeypatch):
    from pilegrain.llm import piles as module

    r = np.random.default_rng(4)
    x = np.cumsum(r.standard_normal((60, 256)), axis=0)[20:]  # each vector is like the next, so all are connected
    x = np.vstack([x, cloud([5], 0, dim=256)[0]])
    monkeypatch.setattr(module, "WIDE", 8)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = sets(piles(planted(spark, x), 256)[0])
    assert [40, 41, 42, 43, 44] in got
    of = [i for p in got for i in p]
    assert len(of) == len(set(of))
    for p in got:
        assert all((unit[i] @ unit[p].sum(axis=0) - 1) / (len(p) - 1) >= 0.509 for i in p)
    for i in set(range(len(x))) - set(of):  # no face that fits a pile is left
        assert all(unit[i] @ unit[p].mean(axis=0) < 0.511 for p in got)


def test_a_component_of_twenty_thousand(spark):
    """One pile of more records than a task divides at once, beside small ones and lone faces."""
    x, truth = cloud([20_000, 30, 5, 2], 500, dim=64, noise=0.8)
    keys = np.arange(len(x))
    packed = [(int(i), bytearray(np.rint(v * 32767).astype("<i2").tobytes())) for i, v in zip(keys, x, strict=True)]
    members, parts = piles(spark.createDataFrame(packed, "key long, q binary"), 64)
    held = {r["key"]: r["pile"] for r in members.collect()}
    want = {int(i): truth.index(t) for i, t in enumerate(truth) if t >= 0}
    assert sum(held.get(i) == p for i, p in want.items()) >= 0.99 * len(want)
    assert max(r["n"] for r in parts.collect()) == sum(p == 0 for p in held.values())


def test_records_that_the_first_bands_bring_together_meet_the_others_as_one(spark, monkeypatch):
    """Beyond FEW records most bands see the leaders' groups and what is in none; the piles are those of brute force."""
    from pilegrain.llm import piles as module

    x, _ = cloud([300, 40, 9, 3, 2, 2], 60, dim=256)
    x = x[np.random.default_rng(3).permutation(len(x))]
    want = divide(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x)
    seen, links = [], module.links
    monkeypatch.setattr(module, "FEW", 10)
    monkeypatch.setattr(module, "BLOCK", 128)  # the largest group is salted
    monkeypatch.setattr(module, "RECALL", 0.999)
    monkeypatch.setattr(module, "links", lambda items, dim, found, banded, seed: seen.append((found, items.count())) or links(items, dim, found, banded, seed))
    got = sets(piles(planted(spark, x), 256)[0])
    assert got == sorted(sorted(int(i) for i in np.flatnonzero(want == p)) for p in set(want) - {-1})
    assert [found for found, _ in seen] == [n for _, n in seen] and len(seen) == 2
    assert seen[0][0] == len(x) and seen[1][0] < len(x) / 2


def test_first_leaders_of_few_and_many_pairs_follow_one_rule():
    from pilegrain.llm.piles import _first_leaders

    r = np.random.default_rng(5)
    u, v = np.nonzero(np.triu(r.random((200, 200)) < 0.15, 1))
    assert len(u) > 2048
    to = {}
    for i, j in zip(u.tolist(), v.tolist(), strict=True):
        if i not in to and j not in to:
            to[j] = i
    a, b = _first_leaders(u, v, 200)
    assert dict(zip(b.tolist(), a.tolist(), strict=True)) == to
    few = u < 12
    a, b = _first_leaders(u[few], v[few], 200)
    assert 0 < few.sum() < 2048 and dict(zip(b.tolist(), a.tolist(), strict=True)) == {j: i for j, i in to.items() if i < 12}
    assert [len(z) for z in _first_leaders(u[:0], v[:0], 0)] == [0, 0]


def test_members_that_do_not_fit_a_merged_pile_leave(spark):
    from pilegrain.llm.piles import _verified

    x, _ = cloud([6], 1, dim=64)
    total = x.sum(axis=0).astype("<f4")
    vectors = spark.createDataFrame([(i, bytearray(np.rint(v * 32767).astype("<i2").tobytes())) for i, v in enumerate(x)], "key long, q binary")
    members = spark.createDataFrame([(i, 0) for i in range(7)], "key long, pile long")
    parts = spark.createDataFrame([(0, 7, bytearray(total.tobytes()))], "pile long, n long, s binary")
    m, p = _verified(members, parts, spark.createDataFrame([(0,)], "pile long"), vectors, 64, 0.51)
    assert sorted(r["key"] for r in m.collect()) == [0, 1, 2, 3, 4, 5] and [r["n"] for r in p.collect()] == [6]


def test_divide_splits_what_a_bridge_joins():
    x, truth = cloud([30, 20], 5, dim=128)
    bridge = x[:30].sum(axis=0) / 30 + x[30:50].sum(axis=0) / 20
    x = np.vstack([x, bridge / np.linalg.norm(bridge)])
    got = divide(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x)
    assert len(set(got[:30])) == 1 and len(set(got[30:50])) == 1 and got[0] != got[30]
    assert all(got[50:55] == -1)
    pile = got == got[0]
    s = x[pile].sum(axis=0)
    assert all((x[pile] @ s - 1) / (pile.sum() - 1) >= 0.51)


def test_leaders_link_each_record_once():
    x, _ = cloud([50], 50, dim=256)
    signer = Signer(256, 32, 2, 4)
    y = signer.turned(x.astype(np.float32))
    keys = np.zeros(len(x), dtype=np.uint64)
    lead, a, b = leaders(keys, np.arange(len(x)), coded(y), 160)
    assert len(lead) + len(b) == len(x) and len(set(b)) == len(b)
    assert signer.keys(signer.sets(y), range(1, 4)).shape == (100, 3)


def test_words_give_the_exact_jaccard_similarity():
    r = np.random.default_rng(5)
    y = r.standard_normal((60, 256)).astype(np.float32)
    y[30:] = y[:30] + 0.9 * y[30:]
    sets_ = [{(int(c), bool(v[c] > 0)) for c in np.argsort(-np.abs(v[:160]))[:80]} for v in y]
    words = coded(y)
    shared = [int(np.bitwise_count(words[i, 5:] & words[j, 5:]).sum()) - int(np.bitwise_count((words[i, :5] ^ words[j, :5]) & words[i, 5:] & words[j, 5:]).sum()) for i, j in ((0, 30), (0, 1))]
    assert [int(v) for v in shared] == [len(sets_[0] & sets_[30]), len(sets_[0] & sets_[1])]
    linked = alike(words[:30], words[30:], 160)
    cosine = np.array([a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(y[:30], y[30:], strict=True)])
    assert linked[cosine > 0.6].all()
    assert not alike(words[:29], words[1:30], 160).any()


@pytest.mark.parametrize("n", [25_000, 250_000, 1_000_000])
def test_pairs_at_the_rule_are_candidates(n):
    r = np.random.default_rng(8)
    a = r.standard_normal((400, 256))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((400, 256))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.55 * a + np.sqrt(1 - 0.55**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    top, rows, bands = banding(n)
    signer = Signer(256, top, rows, bands)
    ya, yb = signer.turned(a.astype(np.float32)), signer.turned(b.astype(np.float32))
    keys = [signer.keys(signer.sets(y), range(bands)) for y in (ya, yb)]
    share = (keys[0] == keys[1]).any(axis=1)
    assert (share & alike(coded(ya), coded(yb), 160)).mean() > 0.9


def test_banding_grows_with_less_than_the_records():
    bands = [banding(n)[2] for n in (10_000, 1_000_000, 100_000_000)]
    assert bands[0] < bands[1] < bands[2] < bands[0] * 1000
    assert 0.2 < meeting(64, 256, 0.51, 1, 1) < 0.25 and 0.05 < meeting(64, 256, 0.0, 1, 1) < 0.08
    assert all(meeting(t, 256, 0.51, r, b) >= 0.92 for t, r, b in (banding(n) for n in (1000, 1_000_000, 100_000_000)))


@pytest.mark.parametrize(("n", "most", "work"), [(250_000, 18, 85_000), (22_000_000, 150, 800_000)])
def test_bands_meet_at_the_rule_and_seldom_by_chance(n, most, work):
    top, rows, bands = banding(n)
    assert bands <= most and bands * (2500 + n * meeting(top, 256, 0.0, rows, 1) / 2) < work
    r = np.random.default_rng(9)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in r.standard_normal((2, 1000, 256)))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    c = 0.51 * a + np.sqrt(1 - 0.51**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    signer = Signer(256, top, rows, bands)
    ka, kc = (signer.keys(signer.sets(signer.turned(x.astype(np.float32))), range(bands)) for x in (a, c))
    assert (ka == kc).any(axis=1).mean() > 0.9
    assert abs((ka == kc).mean() / meeting(top, 256, 0.51, rows, 1) - 1) < 0.1


def test_consolidate_of_hubs_trees_and_grids(spark):
    edges = [(0, i) for i in range(1, 4000)] + [(i, 10_000 + i) for i in range(1, 500)]  # a hub with arms
    edges += [(20_000 + i, 20_000 + i // 2) for i in range(1, 300)]  # a tree
    edges += [(30_000 + 20 * i + j, 30_000 + 20 * i + j + 1) for i in range(20) for j in range(19)] + [(30_000 + 20 * i + j, 30_020 + 20 * i + j) for i in range(19) for j in range(20)]  # a core without leaves
    rows = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {x[0]: x[1] for x in consolidate(rows, "a", "b", "v", "g").collect()} == brute(edges)


def test_copies_of_copies_tie_faces(spark, tmp_path, sf):
    """A chain of eight copies and a circle: faces on either end are one bundle."""
    from datetime import datetime

    from pilegrain.llm.queries_splits import p2_found

    at = datetime(2020, 1, 1)
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table([(i, i - 1 if i > 1 else None) for i in range(1, 9)] + [(20, 21), (21, 20), (30, 30), (40, 41), (40, 42)], "id long, duplicate_of long", "photos")
    table([(100, 1, at), (108, 8, at), (200, 20, at), (201, 21, at), (300, 30, at), (401, 41, at), (402, 42, at)], "id long, photo_id long, created_at timestamp", "faces")
    table([(f, "person", f"p{f}", None, at) for f in (100, 108, 200, 201, 300, 401, 402)], "face_id long, label string, person_id string, occlusion string, labelled_at timestamp", "gold_labels")
    assert {r[0]: r[1] for r in p2_found(spark, str(tmp_path)).collect()} == {100: 100, 108: 100, 200: 200, 201: 200, 300: 300, 401: 401, 402: 401}


def test_more_strata_than_a_plan_holds_are_an_error(spark, monkeypatch):
    from pilegrain.llm import splits

    monkeypatch.setattr(splits, "MOST_STRATA", 3)
    rows = spark.createDataFrame([(i, i, str(i)) for i in range(5)], "face_id long, b long, s string")
    with pytest.raises(ValueError):
        assign(rows, "b", "s", {"a": 1.0})
