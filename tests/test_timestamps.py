import random
import zoneinfo
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pytest

from pilegrain.functions.timestamps import compile_mask, normalise, written_times


def one(text, zone=None):
    us = normalise(pa.array([text], pa.string()), pa.array([zone], pa.string())).to_pylist()[0]
    return None if us is None else datetime.fromtimestamp(us // 1_000_000, UTC).strftime("%Y-%m-%d %H:%M:%S") + f".{us % 1_000_000:06d}"


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2010:10:14 05:03:31", None, "2010-10-14 05:03:31.000000"),
        ("2010:10:14 05:03:31\x00", " Europe/Berlin", "2010-10-14 03:03:31.000000"),
        ("30.07.2018 17:23", "Europe/Berlin", "2018-07-30 15:23:00.000000"),
        ("3/20/2004 7:14:57 PM", None, "2004-03-20 19:14:57.000000"),
        ("Mar 28, 2010 12:41 AM", None, "2010-03-28 00:41:00.000000"),
        ("Wed, 13 Jun 2007 07:41:58 +0900", "Europe/Berlin", "2007-06-12 22:41:58.000000"),
        ("2025-03-23T07:55:57.480+11:00[Australia/Sydney]", None, "2025-03-22 20:55:57.480000"),
        ("2015-10-01T02:04:21.948413799Z", None, "2015-10-01 02:04:21.948413"),
        ("2014-10-26 02:50:08 CET", "Asia/Tokyo", "2014-10-26 01:50:08.000000"),
        ("2017-03-15 22:18:09 UTC", "Asia/Tokyo", "2017-03-15 22:18:09.000000"),
        ("2020-10-02T02:21:20-06", None, "2020-10-02 08:21:20.000000"),
        ("1491164703736", "Asia/Tokyo", "2017-04-02 20:25:03.736000"),
        ("1679335385", "Asia/Tokyo", "2023-03-20 18:03:05.000000"),
        ("20030413_202355", None, "2003-04-13 20:23:55.000000"),
        ("20250823143717", None, "2025-08-23 14:37:17.000000"),
        ("2005-08-18", "Europe/Berlin", "2005-08-17 22:00:00.000000"),
        ("2009-03-06 10.18.27", None, "2009-03-06 10:18:27.000000"),
        ("2024-03-31 02:30", "Europe/Berlin", "2024-03-31 01:30:00.000000"),  # skipped: moves forward by the gap
        ("2024-10-27 02:30:00", "Europe/Berlin", "2024-10-27 00:30:00.000000"),  # repeated: the first
        ("2024-02-29", "Not/AZone", "2024-02-29 00:00:00.000000"),
        *[(x, None, None) for x in ("", "  ", None, "n/a", "unknown", "0000:00:00 00:00:00", "    :  :     :  :  ", "2007:06:17 17:", "2014:02:30 23:23:23", "2008-05-04 27:04:04", "2015-17-09T09:09:00", "2017-01-01 10:00:00 XQZ", "é" * 40, "9" * 5000)],
    ],
)
def test_written_forms(text, zone, want):
    assert one(text, zone) == want


def test_masks_compile_once():
    assert compile_mask("9999-99-99") == {"Y": (0, 4), "M": (5, 7), "D": (8, 10)}
    assert compile_mask("aaaa") is None


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Lord_Howe", "Africa/Casablanca", "America/Sao_Paulo"])
def test_zone_tables_against_the_standard_library(zone):
    r = random.Random(zone)
    local = [datetime(1950, 1, 1) + timedelta(seconds=r.randrange(140 * 365 * 86_400)) for _ in range(800)]
    got = normalise(pa.array([d.strftime("%Y-%m-%d %H:%M:%S") for d in local]), pa.array([zone] * len(local))).to_pylist()
    assert got == [int(d.replace(tzinfo=zoneinfo.ZoneInfo(zone)).timestamp()) * 1_000_000 for d in local]


def test_table_form(spark):
    rows = spark.createDataFrame([(1, "2020-01-01", None, "UTC", "x"), (2, None, None, None, "y")], "photo_id long, taken_at string, exif_modified_at string, tz_name string, field string")
    got = written_times(rows, ["taken_at", "exif_modified_at"])
    assert got.columns == ["photo_id", "field", "utc_us"]
    assert [tuple(r) for r in got.collect()] == [(1, "taken_at", 1_577_836_800_000_000)]
    assert written_times(rows.limit(0), ["taken_at"]).collect() == []


def test_times_of_any_year_follow_the_zone_files():
    import zoneinfo
    from datetime import datetime, timezone

    import numpy as np

    from pilegrain.functions.timestamps import zone_offsets

    for name in ("Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "UTC"):
        zone = zoneinfo.ZoneInfo(name)
        for year in (1850, 1895, 1950, 2024, 2099, 2100, 2101, 2150, 2499, 2500, 2777, 9000):
            for month, day in ((1, 15), (7, 15), (12, 31)):
                at = datetime(year, month, day, 12)
                seconds = int(at.replace(tzinfo=timezone.utc).timestamp())
                want = at.replace(tzinfo=zone).utcoffset().total_seconds()
                assert zone_offsets(name, np.array([seconds]))[0] == int(want), (name, year, month)


def test_a_long_fraction_is_read():
    import pyarrow as pa

    from pilegrain.functions.timestamps import normalise

    got = normalise(pa.array(["2020-01-01T00:00:00." + "1" * 300, "x" * 500_000]), pa.array(["UTC", None])).to_pylist()
    assert got == [1_577_836_800_111_111, None]


def test_other_zone_files_are_an_error():
    import pyarrow as pa
    import pytest

    from pilegrain.functions import timestamps

    with pytest.raises(RuntimeError):
        timestamps._utc_us.func(pa.array(["2020"]), pa.array(["UTC"]), pa.array(["another"]))
