"""Geometry of detections: eye distance, pose, box overlap, the transform that aligns a face."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points(landmarks: Column) -> Column:
    """Five points of a JSON text as an array of pairs; null where the text is no such array."""
    return F.from_json(landmarks, "array<array<double>>")


def _xy(p: Column, i: int) -> tuple[Column, Column]:
    return F.get(F.get(p, i), 0), F.get(F.get(p, i), 1)


def eye_distance(p: Column) -> Column:
    (x1, y1), (x2, y2) = _xy(p, 0), _xy(p, 1)
    return F.hypot(x2 - x1, y2 - y1)


def roll(p: Column) -> Column:
    (x1, y1), (x2, y2) = _xy(p, 0), _xy(p, 1)
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def yaw(p: Column) -> Column:
    """How far the nose lies along the eye axis from the middle of the eyes, in eye distances, as an angle within 90 degrees."""
    (x1, y1), (x2, y2), (nx, ny) = _xy(p, 0), _xy(p, 1), _xy(p, 2)
    dx, dy = x2 - x1, y2 - y1
    along = ((nx - (x1 + x2) / 2) * dx + (ny - (y1 + y2) / 2) * dy) / (dx * dx + dy * dy)
    return F.when(F.hypot(dx, dy) < 1e-6, 0.0).otherwise(F.least(F.greatest(along * 180, F.lit(-90.0)), F.lit(90.0)))


def aligning(p: Column, target: list[tuple[float, float]]) -> Column:
    """Struct (a, b, tx, ty) of the similarity x' = a x - b y + tx, y' = b x + a y + ty that brings the points nearest to target.

    With points as complex numbers this is a least-squares line with a closed form; no decomposition is needed. Equal points give scale one.
    """
    n = len(target)
    xs, ys = zip(*(_xy(p, i) for i in range(n)), strict=True)
    mean = lambda v: sum(v[1:], v[0]) / n
    mx, my = mean(xs), mean(ys)
    gx, gy = sum(x for x, _ in target) / n, sum(y for _, y in target) / n
    spread = sum(((x - mx) * (x - mx) + (y - my) * (y - my) for x, y in zip(xs[1:], ys[1:], strict=True)), (xs[0] - mx) * (xs[0] - mx) + (ys[0] - my) * (ys[0] - my))
    real, imaginary = F.lit(0.0), F.lit(0.0)
    for x, y, (u, v) in zip(xs, ys, target, strict=True):
        real = real + (x - mx) * (u - gx) + (y - my) * (v - gy)
        imaginary = imaginary + (x - mx) * (v - gy) - (y - my) * (u - gx)
    a = F.when(spread > 0, real / spread).otherwise(1.0)
    b = F.when(spread > 0, imaginary / spread).otherwise(0.0)
    return F.struct(a.alias("a"), b.alias("b"), (F.lit(gx) - a * mx + b * my).alias("tx"), (F.lit(gy) - b * mx - a * my).alias("ty"))


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of box a with boxes b, whose corners are pixels that belong to them."""
    side = lambda low, high: np.maximum(0.0, np.minimum(a[high], b[:, high]) - np.maximum(a[low], b[:, low]) + 1)
    both = side(0, 2) * side(1, 3)
    area = lambda r: (r[..., 2] - r[..., 0] + 1) * (r[..., 3] - r[..., 1] + 1)
    return both / (area(a) + area(b) - both)


def suppressed(boxes: DataFrame, photo: str, key: str, score: str, most: float = 0.4) -> DataFrame:
    """The boxes (x1, y1, x2, y2) that remain per photo: best score first, boxes that overlap a kept one by more than most go.

    Photos are many and small, so they are read as one sorted stream per task instead of one call per photo. Null photos are left out.
    """

    def kept(photos: np.ndarray, keys: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, photos[1:] != photos[:-1]])
        size = np.diff(np.r_[start, len(photos)])
        keep = list(start[size == 1])
        for i, n in zip(start[size > 1], size[size > 1], strict=True):
            left = np.arange(i, i + n)
            while len(left):
                keep.append(left[0])
                left = left[1:][~(overlap(b[left[0]], b[left[1:]]) > most)]
        return pa.RecordBatch.from_arrays([pa.array(photos[keep]), pa.array(keys[keep])], [photo, key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                box = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(2, 6)], axis=1)
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), box))
                photos, keys, b = (np.concatenate([h[i] for h in held]) for i in range(3))
                last = np.searchsorted(photos, photos[-1])  # the last photo may go on in the next batch
                if last:
                    yield kept(photos[:last], keys[:last], b[:last])
                held = [(photos[last:], keys[last:], b[last:])]
        if held:
            yield kept(*held[0])

    rows = boxes.where(F.col(photo).isNotNull()).repartition(photo).sortWithinPartitions(F.col(photo), F.col(score).desc_nulls_last(), F.col(key))
    return rows.select(photo, key, "x1", "y1", "x2", "y2").mapInArrow(run, f"{photo} long, {key} long")
