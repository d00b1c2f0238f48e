"""Planar geometry for maps, on arrays of structs (x, y)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def albers(lon: Column, lat: Column, origin: tuple[float, float] = (-3.0, 40.0), parallels: tuple[float, float] = (37.0, 43.0)) -> Column:
    """Struct (x, y) of the Albers equal-area conic projection on the unit sphere."""
    lon0, lat0, one, two = (math.radians(v) for v in (*origin, *parallels))
    n = (math.sin(one) + math.sin(two)) / 2
    c = math.cos(one) ** 2 + 2 * n * math.sin(one)
    rho0 = math.sqrt(c - 2 * n * math.sin(lat0)) / n
    rho = F.sqrt(F.lit(c) - 2 * n * F.sin(F.radians(lat))) / n
    theta = (F.radians(lon) - lon0) * n
    return F.struct((rho * F.sin(theta)).alias("x"), (F.lit(rho0) - rho * F.cos(theta)).alias("y"))


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace formula; the last point is joined to the first."""
    turned = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def decoded_deltas(deltas: Column, scale: tuple[float, float], shift: tuple[float, float]) -> Column:
    """Quantised deltas as points: running sums, scaled and shifted."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))

    def step(state: Column, delta: Column) -> Column:
        x, y = state["x"] + delta["x"], state["y"] + delta["y"]
        point = F.struct((x * scale[0] + shift[0]).alias("x"), (y * scale[1] + shift[1]).alias("y"))
        return F.struct(x.alias("x"), y.alias("y"), F.concat(state["out"], F.array(point)).alias("out"))

    return F.aggregate(deltas, start, step)["out"]


def stitched(arcs: Column, order: Column) -> Column:
    """One ring from shared arcs: an index of ~i takes arc i backwards; joints count once."""
    one = F.transform(order, lambda i: F.when(i >= 0, F.element_at(arcs, (i + 1).cast("int"))).otherwise(F.reverse(F.element_at(arcs, (-i).cast("int")))))
    return F.concat(F.element_at(one, 1), F.flatten(F.transform(F.slice(one, F.lit(2), F.size(one)), lambda a: F.slice(a, F.lit(2), F.size(a)))))


def _kept(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker over a stack: which points of a line stay."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        chord, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        far = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        i = int(np.argmax(far))
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            spans += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplified(line: Column, tolerance: float) -> Column:
    """A line without the points that lie within ``tolerance`` of the simpler line."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(lines: pd.Series) -> pd.Series:
        def one(points: list[dict]) -> list[dict]:
            if points is None or len(points) < 3:
                return points
            keep = _kept(np.array([(p["x"], p["y"]) for p in points]), tolerance)
            return [p for p, k in zip(points, keep, strict=True) if k]

        return lines.map(one)

    return run(line)
