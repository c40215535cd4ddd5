import numpy as np
import pytest
from pyspark.sql import functions as F

from pilegrain.functions import dates, files, geometry


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("IMG-20210304-WA0007.jpg", "2021-03-04 00:00:00"),
        ("IMG_20210304_101530.jpg", "2021-03-04 10:15:30"),
        ("PXL_20220704_101530123.jpg", "2022-07-04 10:15:30"),
        ("2019-01-15 14.30.22.jpg", "2019-01-15 14:30:22"),
        ("2019.01.15.png", "2019-01-15 00:00:00"),
        ("20180229_101010.jpg", None),
        ("2019-01_15.jpg", None),
        ("IMG_18991231.jpg", None),
        ("120210304.jpg", None),
        ("DSC00012.jpg", None),
    ],
)
def test_name_dates(spark, name, want):
    row = spark.createDataFrame([(name,)], "n string").select(F.date_format(dates.date_from_name(F.col("n"), 2026), "yyyy-MM-dd HH:mm:ss")).first()
    assert row[0] == want


@pytest.mark.parametrize(("path", "want"), [("2016 trip/2018/a.jpg", 2018), ("2016 trip/x/a.jpg", 2016), ("1970/a.jpg", None), ("a2016.jpg", None), ("12016/a.jpg", None)])
def test_folder_years(spark, path, want):
    row = spark.createDataFrame([(path,)], "p string").select(F.year(dates.year_from_folder(F.col("p"), 2026))).first()
    assert row[0] == want


def test_priority_of_recovered_dates(spark):
    rows = spark.createDataFrame([("2015/IMG_20140102.jpg", "2013:01:01 01:01:01"), ("2015/a.jpg", "2013:01:01 01:01:01"), ("2015/a.jpg", None), ("x/a.jpg", None)], "p string, e string")
    got = rows.select(dates.recovered(F.col("p"), dates.exif_time(F.col("e")), F.lit(1.6e9), 2026)["source"]).collect()
    assert [r[0] for r in got] == ["filename", "exif_modified", "folder", None]


def test_kinds(spark):
    rows = spark.createDataFrame([("a/IMG-20200101-WA0001.jpg", 1000, 1000, "JPEG", None), ("a/Screen Shot 1.png", 1000, 1000, "PNG", None), ("a/b.jpg", 50, 50, "JPEG", None), ("a/b.png", 900, 900, "PNG", None), ("a/b.png", 900, 900, "PNG", "Make"), ("WhatsApp/b.jpg", None, None, None, None)], "p string, w int, h int, f string, m string")
    got = rows.select(files.classify(F.col("p"), F.col("w"), F.col("h"), F.col("f"), F.col("m"), F.lit(None).cast("string"))).collect()
    assert [r[0] for r in got] == ["forwarded", "screenshot", "tiny", "screenshot", "photo", "forwarded"]
    assert spark.createDataFrame([("x.MOV",), ("x.cr2",), ("x.heic",), ("x",)], "p string").select(files.by_extension(F.col("p"))).toPandas().iloc[:, 0].tolist() == ["video", "raw", None, "unsupported"]


def test_degrees(spark):
    got = spark.range(1).select(files.degrees(F.lit(12.0), F.lit(30.0), F.lit(36.0), F.lit("s"), 90.0), files.degrees(F.lit(120.0), F.lit(0.0), F.lit(0.0), F.lit("N"), 90.0)).first()
    assert got[0] == pytest.approx(-12.51) and got[1] is None


def test_alignment_recovers_a_transform(spark):
    target = [(38.0, 52.0), (74.0, 52.0), (56.0, 72.0), (42.0, 92.0), (71.0, 92.0)]
    turn, scale, shift = 0.4, 2.5, np.array([30.0, -12.0])
    m = scale * np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    source = ((np.array(target) - shift) @ np.linalg.inv(m).T).tolist()
    rows = spark.createDataFrame([(source,)], "p array<array<double>>")
    got = rows.select(geometry.aligning(F.col("p"), target).alias("m")).first()["m"]
    assert (got["a"], got["b"], got["tx"], got["ty"]) == pytest.approx((m[0, 0], m[1, 0], *shift))
    same = spark.createDataFrame([([[1.0, 1.0]] * 5,)], "p array<array<double>>").select(geometry.aligning(F.col("p"), target).alias("m")).first()["m"]
    assert (same["a"], same["b"]) == (1.0, 0.0)


def test_suppression(spark):
    boxes = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 9.0, 9.0), (1, 2, 0.8, 1.0, 1.0, 10.0, 10.0), (1, 3, 0.7, 50.0, 50.0, 60.0, 60.0), (2, 4, None, 0.0, 0.0, 9.0, 9.0)], "photo_id long, face_id long, s double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["face_id"] for r in geometry.suppressed(boxes, "photo_id", "face_id", "s").collect()) == [1, 3, 4]
