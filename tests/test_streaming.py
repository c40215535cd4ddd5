from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pilegrain.sources.pixels import per_row
from pilegrain.streaming import resume


def test_files_run_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long"
    spark.range(3).write.mode("append").parquet(source)
    resume.run_new_files(spark, source, schema, lambda d: d.withColumn("x", F.col("id") * 2), target, check)
    spark.range(10, 12).write.mode("append").parquet(source)
    resume.run_new_files(spark, source, schema, lambda d: d.withColumn("x", F.col("id") * 2), target, check)
    assert sorted(r["x"] for r in spark.read.parquet(target).collect()) == [0, 2, 4, 20, 22]


def test_log_folds_to_the_latest(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("log", "state", "check"))
    schema = "face_id long, kind string, person_id string, at int"
    spark.createDataFrame([(1, "person", "a", 1), (2, "junk", None, 1)], schema).write.mode("append").parquet(source)
    resume.fold_log(spark, source, schema, target, check)
    spark.createDataFrame([(1, "unassigned", None, 2)], schema).write.mode("append").parquet(source)
    resume.fold_log(spark, source, schema, target, check)
    want = {1: "unassigned", 2: "junk"}
    assert {r["face_id"]: r["kind"] for r in resume.folded(spark, target).collect()} == want
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("part=")]) == 2  # each run wrote its own rows only
    whole = resume.compacted(spark, target)
    assert {r["face_id"]: r["kind"] for r in spark.read.parquet(whole).collect()} == want


def test_windows_over_a_batch(spark, sf):
    got = resume.windowed_events(spark.read.parquet(f"{sf}/events.parquet"))
    assert got.agg(F.sum("events")).first()[0] == 1000


def test_errors_become_rows(spark):
    def work(session, row):
        if row["id"] == 1:
            raise ValueError("bad file")
        return [{"n": row["id"] * session}]

    got = {r["id"]: (r["n"], r["error"]) for r in per_row(spark.range(3), lambda: 10, work, StructType([StructField("n", LongType())]), "id").collect()}
    assert got == {0: (0, None), 1: (None, "ValueError: bad file"), 2: (20, None)}
