"""Plane geometry and UTM as column expressions.

Points are struct<x, y>, lines array<point>, rings array<point> (closed or not).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM zone 44 north.
_A, _F = 6378137.0, 1 / 298.257223563
_K0, _MERIDIAN, _EASTING = 0.9996, 81.0, 500000.0
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
METRES_PER_DEGREE, DENSIFY_COSINE = 111000.0, 0.97


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def utm(lon: Column, lat: Column) -> Column:
    """Easting and northing in metres, as a point."""
    phi, lam = F.radians(lat), F.radians(lon - _MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(_EASTING + _K0 * _RADIUS * x, _K0 * _RADIUS * y)


def lon_lat(x: Column, y: Column) -> Column:
    """The inverse of utm, as a point."""
    xi, eta = y / (_K0 * _RADIUS), (x - _EASTING) / (_K0 * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return point(_MERIDIAN + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi))


def distance(p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    return F.sqrt(dx * dx + dy * dy)


def segments(line: Column) -> Column:
    """array<struct<p, q>> of consecutive points."""
    n = F.size(line)
    pairs = F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.when(n > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def edges(ring: Column) -> Column:
    """Segments of a ring, the closing one included."""
    return segments(F.concat(ring, F.slice(ring, 1, 1)))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, e: s + distance(e["p"], e["q"]))


def inside(p: Column, ring: Column, sides: Column | None = None) -> Column:
    """Even-odd rule; points on the boundary may be on either side.  ``sides`` are the ring's edges, if at hand."""

    def crosses(e: Column) -> Column:
        a, b = e["p"], e["q"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        return spans & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(edges(ring) if sides is None else sides, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def is_box(ring: Column, sides: Column) -> Column:
    """Whether the ring runs once around a rectangle with sides along the axes."""
    straight = F.forall(sides, lambda e: (e["p"]["x"] == e["q"]["x"]) | (e["p"]["y"] == e["q"]["y"]))
    corners = F.array_distinct(ring)
    xs, ys = F.array_distinct(F.transform(ring, lambda p: p["x"])), F.array_distinct(F.transform(ring, lambda p: p["y"]))
    return F.coalesce(straight & F.size(ring).isin(4, 5) & (F.size(corners) == 4) & (F.size(xs) == 2) & (F.size(ys) == 2), F.lit(False))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(square, F.lit(0.0))))).otherwise(0.0)
    return distance(p, point(a["x"] + t * dx, a["y"] + t * dy))


def ring_distance(p: Column, ring: Column) -> Column:
    """Distance to the boundary."""
    return F.array_min(F.transform(edges(ring), lambda e: segment_distance(p, e["p"], e["q"])))


def contains(p: Column, ring: Column) -> Column:
    """Strictly inside: the boundary is not."""
    return inside(p, ring) & (ring_distance(p, ring) > 0)


def clipped_length(a: Column, b: Column, ring: Column, sides: Column | None = None) -> Column:
    """Length of segment a-b inside a simple polygon, convex or not.

    The segment is cut where it crosses edges, and every part counts whose
    middle lies inside.
    """
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sides = edges(ring) if sides is None else sides

    def crossing(e: Column) -> Column:
        ex, ey = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        cross = dx * ey - dy * ex
        ox, oy = e["p"]["x"] - a["x"], e["p"]["y"] - a["y"]
        t, u = (ox * ey - oy * ex) / F.nullif(cross, F.lit(0.0)), (ox * dy - oy * dx) / F.nullif(cross, F.lit(0.0))
        return F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.transform(sides, crossing), lambda t: t.isNotNull())))
    n = F.size(cuts)
    parts = F.zip_with(F.slice(cuts, 1, n - 1), F.slice(cuts, 2, n - 1), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    middle = lambda x: point(a["x"] + dx * (x["s"] + x["t"]) / 2, a["y"] + dy * (x["s"] + x["t"]) / 2)
    share = F.aggregate(parts, F.lit(0.0), lambda total, x: total + F.when(inside(middle(x), ring, sides), x["t"] - x["s"]).otherwise(0.0))
    return share * F.sqrt(dx * dx + dy * dy)


def densified(line: Column, step: float = 10.0) -> Column:
    """Points at most ``step`` metres apart on a lon/lat line, by the local metric; shorter lines as they are."""

    def filled(e: Column) -> Column:
        dx = (e["q"]["x"] - e["p"]["x"]) * METRES_PER_DEGREE * DENSIFY_COSINE
        dy = (e["q"]["y"] - e["p"]["y"]) * METRES_PER_DEGREE
        d = F.sqrt(dx * dx + dy * dy)
        n = F.ceil(d / step).cast("int")
        inner = F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda k: point(e["p"]["x"] + (k / n) * (e["q"]["x"] - e["p"]["x"]), e["p"]["y"] + (k / n) * (e["q"]["y"] - e["p"]["y"])),
        )
        last = F.array(point(e["q"]["x"], e["q"]["y"]))
        return F.when((d > step) & (n > 1), F.concat(inner, last)).otherwise(last)

    return F.when(F.size(line) < 2, line).otherwise(F.concat(F.slice(line, 1, 1), F.flatten(F.transform(segments(line), filled))))
