import itertools
import random

import pytest

from pilegrain.operators import metrics


def frames(spark, truth, predicted):
    t = spark.createDataFrame(sorted(truth.items()), "face_id long, person string")
    return t, spark.createDataFrame(sorted(predicted.items()), "face_id long, cluster long")


def brute(truth, predicted):
    ids = sorted(set(truth) & set(predicted))
    own = {i: ("lone", i) if predicted[i] == -1 else predicted[i] for i in ids}
    pairs = list(itertools.combinations(ids, 2))
    hits = sum(truth[a] == truth[b] and own[a] == own[b] for a, b in pairs)
    p = sum(own[a] == own[b] for a, b in pairs)
    t = sum(truth[a] == truth[b] for a, b in pairs)
    bp = sum(sum(truth[j] == truth[i] for j in ids if own[j] == own[i]) / sum(own[j] == own[i] for j in ids) for i in ids) / len(ids)
    br = sum(sum(own[j] == own[i] for j in ids if truth[j] == truth[i]) / sum(truth[j] == truth[i] for j in ids) for i in ids) / len(ids)
    return hits, p, t, bp, br


CASES = {
    "perfect": ({1: "a", 2: "a", 3: "b", 4: "b"}, {1: 7, 2: 7, 3: 9, 4: 9}),
    "merged": ({1: "a", 2: "a", 3: "b", 4: "b"}, {1: 7, 2: 7, 3: 7, 4: 7}),
    "noise": ({1: "a", 2: "a", 3: "b", 4: "b"}, {1: -1, 2: -1, 3: -1, 4: -1}),
    "uneven": ({i: "a" if i < 50 else "b" for i in range(54)}, {i: 1 if i < 48 else 2 for i in range(60)}),
    "random": ({i: random.Random(i).choice("abcd") for i in range(60)}, {i: random.Random(i + 99).choice([-1, 1, 2, 3]) for i in range(60)}),
}


@pytest.mark.parametrize("name", CASES)
def test_against_pairs(spark, name):
    truth, predicted = CASES[name]
    table = metrics.cells(*frames(spark, truth, predicted))
    hits, p, t, bp, br = brute(truth, predicted)
    one = metrics.pairwise(table).first()
    assert (one["hits"], one["predicted_pairs"], one["true_pairs"]) == (hits, p, t)
    b = metrics.bcubed(table).first()
    assert (b["precision"], b["recall"]) == pytest.approx((bp, br))


def test_information_bounds(spark):
    perfect = metrics.information(metrics.cells(*frames(spark, *CASES["perfect"]))).first()
    assert (perfect["nmi"], perfect["ari"]) == pytest.approx((1, 1))
    merged = metrics.information(metrics.cells(*frames(spark, *CASES["merged"]))).first()
    assert (merged["nmi"], merged["ari"]) == pytest.approx((0, 0))


def test_junk_inside(spark):
    t, p = frames(spark, {1: "a", 2: "a"}, {1: 5, 2: 5, 3: 5, 4: 6, 5: -1})
    got = metrics.contamination(t, p, spark.createDataFrame([(3,), (4,), (5,)], "face_id long")).first()
    assert (got["inside"], got["n_junk"]) == (1, 3)


def test_split_is_every_fifth(spark):
    people = spark.createDataFrame([(f"p{i:02d}", i % 4, 0) for i in range(12)], "person string, faces long, span int")
    got = metrics.split_identities(people).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 13))
    assert [r["place"] for r in got if r["side"] == "holdout"] == [5, 10]
