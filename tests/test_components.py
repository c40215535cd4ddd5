import random

import pytest

from pilegrain.operators.components import components


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


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(None, 1), (2, None), (3, 3)] + [(500 + i, 501 + i) for i in range(30)] + [(900, 900 + i) for i in range(1, 40)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert {x[0]: x[1] for x in got.collect()} == brute(edges)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stars_give_the_same_as_one_task(spark, monkeypatch):
    """A hub, chains, a clique and random edges, closed by star rounds on salted keys and by the last task."""
    from pilegrain.operators import components as module

    r = random.Random(11)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(60)] + [(7000 + i, 7000 + j) for i in range(25) for j in range(i)] + [(9000 + r.randrange(400), 9000 + r.randrange(400)) for _ in range(250)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(6)
    whole = {x[0]: x[1] for x in module.components(rows).collect()}
    monkeypatch.setattr(module, "ONE_TASK", 0)
    monkeypatch.setattr(module, "contract", lambda e: e.selectExpr("greatest(a, b) AS v", "least(a, b) AS u"))  # nothing is contracted before
    assert {x[0]: x[1] for x in module.components(rows).collect()} == whole
    assert whole[2999] == 0 and whole[5060] == 5000 and whole[7024] == 7000


def test_nested_cuts_equal_components_of_each_cut(spark):
    from pilegrain.operators.components import components, nested_components

    r = random.Random(12)
    graph = spark.createDataFrame([(r.randrange(80), r.randrange(80), r.random()) for _ in range(150)], "src long, dst long, sim double")
    for t, groups in nested_components(graph, [0.9, 0.5, 0.7]):
        want = {x[0]: x[1] for x in components(graph.where(f"sim >= {t}"), "src", "dst").collect()}
        assert {x[0]: x[1] for x in groups.select("vertex", "component").collect()} == want


def test_estimates_do_not_grow_in_a_loop(spark):
    from pilegrain.session import ESTIMATE_BITS, cut

    df = spark.range(5).selectExpr("id AS k", "id AS v")
    for _ in range(9):
        df = cut(df.join(df.selectExpr("k", "v AS w"), "k").join(df.selectExpr("k", "v AS x"), "k").selectExpr("k", "w AS v"))
    assert df.count() == 5 and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= ESTIMATE_BITS
