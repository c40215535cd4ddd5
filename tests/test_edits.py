from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pilegrain.operators import edits, metrics, review, sampling

DAY = lambda d: datetime(2024, 1, d)
LOG = "face_id long, kind string, person_id string, at timestamp, batch string"


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "person", "ann", DAY(1), "b1"), (2, "person", "ann", DAY(1), "b1"), (3, "person", "bob", DAY(2), "b2"), (4, "junk", None, DAY(3), "b3"), (5, "unassigned", None, DAY(3), "b3")]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 11), (5, 12), (6, -1)], "face_id long, pile_id long")


def at(d):
    return F.lit(DAY(d))


def test_a_refusal_outlives_the_pile_number(spark, members):
    rows = edits.refused(spark.createDataFrame([("ann", 11), ("ann", 11)], "person_id string, pile_id long"), members, at(5), "r1")
    assert sorted(r["face_id"] for r in rows.collect()) == [3, 4]
    moved = spark.createDataFrame([(3, 77), (4, -1)], "face_id long, pile_id long")
    assert [tuple(r) for r in edits.refused_pairs(rows, moved).collect()] == [("ann", 77)]


def test_repairs_touch_only_what_the_person_holds(spark, log):
    faces = spark.createDataFrame([(2,), (3,), (9,)], "face_id long")
    rows, never = edits.removed(faces, review.state(log), "ann", at(6), "b6")
    assert [(r["face_id"], r["kind"], r["person_id"]) for r in rows.collect()] == [(2, "unassigned", None)]
    assert [(r["face_id"], r["person_id"]) for r in never.collect()] == [(2, "ann")]
    assert [(r["face_id"], r["person_id"]) for r in edits.split_off(faces, review.state(log), "bob", "cat", at(6), "b6").collect()] == [(3, "cat")]
    assert [r["face_id"] for r in edits.restored(spark.createDataFrame([(1,), (4,)], "face_id long"), review.state(log), at(6), "b6").collect()] == [4]
    assert {r["kind"] for r in edits.set_aside(faces, at(6), "b6").collect()} == {"junk"}


def test_undo_takes_a_batch_out_of_log_and_refusals(spark, log, members):
    removal, never = edits.removed(spark.createDataFrame([(1,)], "face_id long"), review.state(log), "ann", at(9), "b9")
    skips = spark.createDataFrame([(12, DAY(4), "s4")], "pile_id long, at timestamp, batch string")
    whole = log.unionByName(removal)
    l1, r1, s1 = edits.undone(whole, never, skips)
    assert l1.count() == log.count() and r1.count() == 0 and s1.count() == 1
    l2, r2, s2 = edits.undone(l1, r1, s1)
    assert s2.count() == 0 and l2.count() == log.count() and r2.count() == 0
    l3, _, _ = edits.undone(l2, r2, s2)
    assert {r["batch"] for r in l3.collect()} == {"b1", "b2"}
    seeds = log.withColumn("batch", F.lit("seed"))
    assert edits.undone(seeds, r2, s2)[0].count() == log.count()


def test_a_skip_lapses_with_a_later_decision(spark, log, members):
    skips = spark.createDataFrame([(10, DAY(2), "s"), (10, DAY(3), "s"), (11, DAY(1), "s"), (12, DAY(2), "s")], "pile_id long, at timestamp, batch string")
    assert sorted(r["pile_id"] for r in edits.skipped(skips, log, members).collect()) == [10, 12]


def test_people_are_resolved_and_renamed(spark):
    known = spark.createDataFrame([("p1", "Ann "), ("p2", "bob"), ("p3", "Cy")], "person_id string, name string")
    got = {r["name"]: (r["person_id"], r["created"]) for r in edits.resolved(spark.createDataFrame([("ANN",), (" Dan",), ("",), (None,), ("Bob",)], "name string"), known).collect()}
    assert got == {"ANN": ("p1", False), "Dan": ("dan", True), "Bob": ("p2", False)}
    asked = spark.createDataFrame([("p1", "Bob"), ("p2", " "), ("p3", "Cyril"), ("p9", "Eve")], "person_id string, name string")
    assert {r["person_id"]: r["outcome"] for r in edits.renamed(asked, known).collect()} == {"p1": "clash", "p2": "blank", "p3": "renamed", "p9": "unknown"}
    assert {r["person_id"]: r["outcome"] for r in edits.renamed(spark.createDataFrame([("p1", "ANN")], "person_id string, name string"), known).collect()} == {"p1": "renamed"}


def test_labels_are_checked_saved_cleared_and_merged(spark):
    schema = "face_id long, label string, person_id string, at timestamp"
    held = spark.createDataFrame([(1, "person", "Ann", DAY(1)), (2, "unsure", None, DAY(2))], schema)
    entries = spark.createDataFrame([(1, " Person", "Bob", DAY(3)), (2, "person", " ", DAY(3)), (3, "face", None, DAY(3)), (4, "non_face", "x", DAY(3)), (None, "unsure", None, DAY(3)), (5, "non_face", None, DAY(4))], schema)
    assert sorted(r["fault"] for r in edits.checked(entries).where("fault IS NOT NULL").collect()) == ["id without person", "no face", "person without id", "unknown label"]
    now = edits.saved(held, entries)
    assert {r["face_id"]: (r["label"], r["person_id"]) for r in now.collect()} == {1: ("person", "Bob"), 2: ("unsure", None), 5: ("non_face", None)}
    assert sorted(r["face_id"] for r in edits.unlabelled(now, spark.createDataFrame([(5,), (9,)], "face_id long")).collect()) == [1, 2]
    assert [r["face_id"] for r in edits.cleared(now, person="BOB ").collect()] == [1]
    assert [r["face_id"] for r in edits.cleared(now, last=1).collect()] == [5]
    assert edits.cleared(now).count() == 3 and edits.cleared(now, label="unsure", clusters=spark.createDataFrame([(1,)], "face_id long")).count() == 0
    merged = edits.merged_people(now, spark.createDataFrame([("bob", "Ann"), ("ann", "Zed")], "old string, new string"))
    assert [r["person_id"] for r in merged.where("person_id IS NOT NULL").collect()] == ["Ann"]


def test_runs_settings_keys_and_crops(spark):
    rows = spark.createDataFrame([("a", DAY(1)), ("b", DAY(3)), ("b", DAY(2)), (None, DAY(9)), ("c", None)], "run string, at timestamp")
    assert {r["run"]: r["latest"] for r in edits.runs(rows, "run", "at").collect()} == {"a": False, "b": True, "c": False}
    assert {r["key"]: r["value"] for r in edits.settings(spark.createDataFrame([("k", "1", DAY(1)), ("k", "2", DAY(2)), (None, "3", DAY(3))], "key string, value string, at timestamp")).collect()} == {"k": "2"}
    assert {r["model"] for r in edits.keyed_by_model(spark.createDataFrame([(1, None), (2, "m")], "face_id long, model string"), "old").collect()} == {"old", "m"}
    assert edits.keyed_by_model(spark.createDataFrame([(1,)], "face_id long"), "old").first()["model"] == "old"
    shown = spark.createDataFrame([("c", "w"), (" ", "w"), (None, None), ("c", None)], "a string, b string").select(edits.crop_path(F.col("a"), F.col("b")).alias("x"), edits.crop_path(F.col("a"), F.col("b"), True).alias("y")).collect()
    assert [tuple(r) for r in shown] == [("c", "w"), ("w", "w"), (None, None), ("c", "c")]


def test_pinned_faces_survive_trimming(spark):
    chosen = spark.createDataFrame([(i,) for i in range(20)], "face_id long")
    pinned = spark.createDataFrame([(15,), (18,), (99,)], "face_id long")
    got = [r["face_id"] for r in sampling.trimmed(chosen, 5, pinned).orderBy("face_id").collect()]
    assert got == [0, 1, 2, 15, 18]
    assert sorted(r["face_id"] for r in sampling.trimmed(chosen, 1, pinned).collect()) == [15, 18]


def test_error_bar_draws_so_many_people(spark):
    truth = spark.createDataFrame([(i, f"p{i % 90}") for i in range(900)], "face_id long, person string")
    predicted = spark.createDataFrame([(i, i % 90 if i % 7 else -1) for i in range(900)], "face_id long, cluster long")
    got = metrics.error_bar(metrics.cells(truth, predicted), 40, 300).first()
    assert got["draws"] == 300 and 0.8 < got["p05"] <= got["p50"] <= got["p95"] < 1


def test_scans_statuses_and_versions(spark, tmp_path):
    from pilegrain.sources import scan

    old = spark.createDataFrame([(1, "a", "h1", 9), (2, "b", "h2", None)], "id long, path string, content_hash string, duplicate_of long")
    new = spark.createDataFrame([(1, "a", "h1", 9), (3, "c", None, None)], "id long, path string, content_hash string, duplicate_of long")
    got = {r["path"]: (r["content_hash"], r["duplicate_of"]) for r in scan.upsert_photos(old, new).collect()}
    assert got == {"a": (None, None), "b": ("h2", None), "c": (None, None)}
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    status = scan.mark_done(spark.createDataFrame([(1, "v1", None)], "id long, version string, fault string"), items.where("id = 2"), "id", "v2", "unreadable")
    assert sorted(r["id"] for r in scan.pending(items, status, "id", "v2").collect()) == [1, 3]
    assert sorted(r["id"] for r in scan.pending(items, status, "id", "v1").collect()) == [2, 3]
    root = str(tmp_path / "t")
    for v in (1, 2):
        scan.save_version(items.limit(v), root, v)
        scan.point_to(spark, root, v)
    assert scan.live(spark, root).count() == 2
    scan.point_to(spark, root, 1)
    assert scan.live(spark, root).count() == 1


def test_pages_and_people_without_faces(spark, log):
    rows = spark.createDataFrame([(i,) for i in range(1, 11)], "rank long")
    assert [r["rank"] for r in review.page(rows, "rank", 2, 4).orderBy("rank").collect()] == [5, 6, 7, 8]
    assert review.page(rows, "rank", 4, 4).count() == 0
    now = review.state(log.unionByName(edits.split_off(spark.createDataFrame([(3,)], "face_id long"), review.state(log), "bob", "ann", at(9), "b9")))
    faces = spark.createDataFrame([(1, 10.0), (2, 30.0), (3, None)], "face_id long, interocular_px double")
    got = {r["person_id"]: (r["faces"], r["sample"]) for r in review.people_counts(now, log.where("kind = 'person'"), faces).collect()}
    assert got == {"ann": (3, 2), "bob": (0, None)}


def test_a_cluster_needs_a_shared_folder():
    from pilegrain.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

        def getConf(self):
            return Conf()

    session = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)
