"""Mixed written times to one UTC instant.

Each value is reduced to its shape mask (digits become 9, letters a). A mask has fixed character
positions, so it is compiled to a parser once per process and all values of that mask are then cut
and converted together with NumPy. Local times go through zone transition tables read from the
machine's compiled zone files, all transitions they hold and the rules for any year to come. The release of these files
(zone_version) is taken on the driver and held against that of every worker: a machine with another release is an error.

Defined results: null, empty, cut-off, placeholder and impossible values give null. A zone or offset in
the text wins, then the zone column, then UTC; an unknown zone column counts as missing; an
unknown zone abbreviation in the text gives null. Bare epoch counts (seconds, milli-, micro- or nanoseconds by
length) are UTC. A skipped local time moves forward by the gap, a repeated one is its first
occurrence. A date alone is local midnight. Slashes put the month first, dots the day. Digits finer
than a microsecond are cut.
"""

from __future__ import annotations

import os
import re
import struct
import zoneinfo
from datetime import datetime, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

US = 1_000_000
#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
MONTHS |= {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())} | {"sept": 9}

_DATES = [
    r"(?P<Y>9999)(?P<s>[-:/.])(?P<M>99?)(?P=s)(?P<D>99?)",
    r"(?P<D>99?)\.(?P<M>99?)\.(?P<Y>9999|99)",
    r"(?P<M>99?)/(?P<D>99?)/(?P<Y>9999|99)",
    r"(?:a+\.?, ?)?(?P<D>99?)[ -](?P<B>a{3,9})\.?[ -](?P<Y>9999)",
    r"(?:a+\.?, ?)?(?P<B>a{3,9})\.? (?P<D>99?),? (?P<Y>9999)",
    r"(?P<Y>9999)(?P<M>99)(?P<D>99)",
]
_TIME = r"(?P<h>99?)(?P<t>[:.])(?P<m>99)(?:(?P=t)(?P<sec>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa)(?!a))?"
_PACKED = r"(?P<h>99)(?P<m>99)(?:(?P<sec>99)(?:[.,]?(?P<f>9+))?)?"
_ZONE = r"(?: ?(?P<sign>[+-])(?P<zh>99):?(?P<zm>99)?| ?(?P<abb>a{1,5})(?![a9]))?(?: ?\[(?P<region>[^\]]+)\])?"
_SHAPES = [re.compile(d + r"(?:(?:,? |a|[-_ ])" + t + _ZONE + ")?") for d in _DATES[:5] for t in (_TIME, r"(?P<h>99)(?P<m>99)(?P<sec>99)")]
_SHAPES += [re.compile(_DATES[5] + r"(?:[ _a-]?" + t + _ZONE + ")?") for t in (_PACKED, _TIME)]
_EPOCH = re.compile(r"(?P<sign>-)?(?P<n>9{9,10}|9{13}|9{16}|9{19})(?:\.(?P<f>9+))?")


@lru_cache(maxsize=4096)
def compile_mask(mask: str) -> dict[str, tuple[int, int]] | None:
    """Character positions of the parts of every value of a mask, or null where the mask is no date."""
    if m := _EPOCH.fullmatch(mask):
        return {"epoch": m.span("n")} | {k: m.span(k) for k in ("sign", "f") if m[k]}
    for shape in _SHAPES:
        if (m := shape.fullmatch(mask)) and not (m["region"] and not m["h"]):
            return {k: m.span(k) for k, v in m.groupdict().items() if v and k not in ("s", "t")}
    return None


@lru_cache(maxsize=1)
def zone_version() -> str:
    """Release of the zone tables in use."""
    for base in zoneinfo.TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            try:
                with open(os.path.join(base, name)) as f:
                    if m := re.match(pattern, f.readline()):
                        return m[1]
            except OSError:
                pass
    return "unknown"


#: 1 January 2100, up to which a table is made at first, and the seconds of 400 years, after which calendar and rules repeat.
FAR, CYCLE = 4_102_444_800, 146_097 * 86_400


@lru_cache(maxsize=1024)
def zone_table(name: str, last: int = FAR) -> tuple[np.ndarray, np.ndarray] | None:
    """(local seconds from which the next offset holds, offsets) up to last; null for an unknown zone.

    A transition holds from the later of its two local readings: skipped and repeated times are
    then both read with the offset before it, which gives the wanted instant in either case.
    """
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_+/-]*", name) or ".." in name:
        return None
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    at = _explicit(name)
    offset = lambda t: int(datetime.fromtimestamp(t, timezone.utc).astimezone(zone).utcoffset().total_seconds())
    first = -2_208_988_800  # 1900, where no transition is written; later rules are found by bisection between weekly probes
    since = max([first, *at])
    probe, week = since + 1, 7 * 86_400
    before = offset(probe)
    while probe < last:
        after = offset(probe + week)
        if after != before:
            low, high = probe, probe + week
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == before else (low, mid)
            at.append(high)
        probe, before = probe + week, after
    at = sorted(set(at))
    offsets = [offset(min(at, default=first) - 1), *(offset(t) for t in at)]
    local = [t + max(a, b) for t, a, b in zip(at, offsets, offsets[1:], strict=False)]
    return np.maximum.accumulate(np.array(local, dtype=np.int64)), np.array(offsets, dtype=np.int64)


def _explicit(name: str) -> list[int]:
    """UTC seconds of the transitions written in the compiled zone file."""
    for base in zoneinfo.TZPATH:
        try:
            with open(os.path.join(base, name), "rb") as f:
                raw = f.read()
        except OSError:
            continue
        head = struct.Struct(">4s1s15x6l")
        magic, version, *counts = head.unpack_from(raw)
        if magic != b"TZif":
            continue
        at, wide = head.size, 4
        if version >= b"2":
            isut, isstd, leap, times, types, chars = counts
            at += times * 5 + types * 6 + chars + leap * 8 + isstd + isut
            counts, wide = head.unpack_from(raw, at)[2:], 8
            at += head.size
        return [t for t in struct.unpack_from(f">{counts[3]}{'q' if wide == 8 else 'l'}", raw, at) if t > -62_000_000_000]  # the first are place holders before year 1
    return []


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    return {z.lower(): z for z in zoneinfo.available_timezones()}


def zone_offsets(name: str, local: np.ndarray) -> np.ndarray | None:
    """Offset of every local time; null for an unknown zone. Times from 2100 are read in the cycle of 400 years that begins there."""
    held = zone_table(name)
    if held is None:
        return None
    far = local >= FAR - 86_400
    if far.any():
        held = zone_table(name, FAR + CYCLE + 400 * 86_400)
        local = np.where(far, FAR + (local - FAR) % CYCLE, local)
    return held[1][np.searchsorted(held[0], local, side="right")] if len(held[0]) else np.full(len(local), held[1][0])


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def _parse(values: list[str], slots: dict[str, tuple[int, int]], zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds and validity of values that share a mask."""
    n = len(values)
    chars = np.frombuffer("".join(values).encode("ascii"), dtype=np.uint8).reshape(n, -1)

    def number(k: str, default: int = 0, most: int = 18) -> np.ndarray:
        if k not in slots:
            return np.full(n, default, dtype=np.int64)
        a, b = slots[k]
        out = np.zeros(n, dtype=np.int64)
        for i in range(a, min(b, a + most)):
            out = out * 10 + (chars[:, i].astype(np.int64) - 48)
        return out

    def micros() -> np.ndarray:
        wide = slots["f"][1] - slots["f"][0] if "f" in slots else 0
        return number("f", most=6) * 10 ** (6 - min(6, wide))

    if "epoch" in slots:
        wide = slots["epoch"][1] - slots["epoch"][0]
        count = number("epoch", most=18) if wide < 19 else number("epoch", most=16)
        us = count * US + micros() if wide <= 10 else count * 1000 if wide == 13 else count
        return (-us if "sign" in slots else us), np.ones(n, dtype=bool)

    year = number("Y")
    if slots["Y"][1] - slots["Y"][0] == 2:
        year = year + np.where(year < 70, 2000, 1900)
    if "B" in slots:
        a, b = slots["B"]
        month = np.array([MONTHS.get(v[a:b].lower(), 0) for v in values], dtype=np.int64)
    else:
        month = number("M")
    day, hour, minute, second = number("D"), number("h"), number("m"), number("sec")
    ok = (year >= 1) & (month >= 1) & (month <= 12)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where(ok, month, 0)] + (leap & (month == 2))
    ok &= (day >= 1) & (day <= length) & (hour <= 23) & (minute <= 59) & (second <= 59)
    if "ap" in slots:
        a, b = slots["ap"]
        half = np.array([v[a:b].upper() for v in values])
        ok &= ((half == "AM") | (half == "PM")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.where(half == "PM", 12, 0)
    local = _days(year, np.maximum(month, 1), day) * 86_400 + hour * 3600 + minute * 60 + second
    shift = np.zeros(n, dtype=np.int64)
    if "sign" in slots:
        zh, zm = number("zh"), number("zm")
        ok &= (zh <= 18) & (zm <= 59)
        shift = (zh * 3600 + zm * 60) * np.where(chars[:, slots["sign"][0]] == ord("-"), -1, 1)
    elif "abb" in slots:
        a, b = slots["abb"]
        east = [ABBREVIATIONS.get(v[a:b].upper()) for v in values]
        ok &= np.array([x is not None for x in east])
        shift = np.array([(x or 0) * 60 for x in east], dtype=np.int64)
    else:
        named = "region" in slots
        if named:
            a, b = slots["region"]
            zones = np.array([v[a:b] for v in values], dtype=object)
        for z in set(zones):
            at = zones == z
            east = zone_offsets(_zone_names().get(z.strip().lower(), z.strip()) if z and z.strip() else "UTC", local[at])
            if east is not None:
                shift[at] = east
            elif named:
                ok &= ~at
    return (local - shift) * US + micros(), ok


def normalise(values: pa.Array, zones: pa.Array) -> pa.Array:
    """UTC microseconds of a batch of written times with their zone names."""
    text = pc.utf8_trim(values, characters=" \t\r\n\x00\x0b\x0c﻿\xa0")
    mask = pc.replace_substring_regex(pc.replace_substring_regex(text, "[0-9]", "9"), "[A-Za-z]", "a")
    out, good = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=bool)
    coded = mask.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    codes = np.where(np.isnan(codes), -1, codes).astype(np.int64) if codes.dtype.kind == "f" else codes.astype(np.int64)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    texts, names = text.to_numpy(zero_copy_only=False), pc.fill_null(zones, "").to_numpy(zero_copy_only=False)
    for code, shape in enumerate(coded.dictionary.to_pylist()):
        compiled = compile_mask if len(shape) <= 80 else compile_mask.__wrapped__  # only usual lengths are worth keeping
        slots = compiled(shape) if shape.isascii() else None
        if slots:
            rows = order[bounds[code] : bounds[code + 1]]
            out[rows], good[rows] = _parse(list(texts[rows]), slots, names[rows])
    return pa.array(out, mask=~good)


@F.arrow_udf(LongType())
def _utc_us(value: pa.Array, zone: pa.Array, version: pa.Array) -> pa.Array:
    if len(version) and version[0].as_py() != zone_version():
        raise RuntimeError(f"zone tables of release {zone_version()} here, {version[0].as_py()} on the driver")
    return normalise(value, zone)


_utc_us = _utc_us.asNondeterministic()  # else a filter on the result is pushed below it and parses every value twice


def utc_us(value: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC of a written time, null where it holds none."""
    return _utc_us(value.cast("string"), zone.cast("string"), F.lit(zone_version()))


def written_times(photos: DataFrame, fields: list[str], key: str = "photo_id", zone: str = "tz_name") -> DataFrame:
    """(key, field, utc_us) of every written time that holds an instant. Other columns are left aside."""
    rows = photos.select(F.col(key), F.col(zone).alias("_zone"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("_w"))
    rows = rows.where(F.col("_w.text").isNotNull()).select(key, F.col("_w.field").alias("field"), utc_us(F.col("_w.text"), F.col("_zone")).alias("utc_us"))
    return rows.where("utc_us IS NOT NULL")
