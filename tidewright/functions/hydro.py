"""Hydrology as column expressions: capacity, runoff, overload, boost and class."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FEATURES = ["elevation", "slope", "tpi", "dist_to_drain", "q_cap", "q_demand", "r_overload"]
RUNOFF_COEFFICIENT = 0.75
MANNING_DEFAULT, MANNING_FLOOR = 0.015, 1e-4
MM_PER_HOUR_TO_M_PER_S = 3_600_000.0
MIN_CAPACITY = 1e-6
BASELINE_MM_HR = 80.0
PIXEL_M = 30.83
BOOST_LIMIT, BOOST_STEP = 0.15, 0.05
LOW_BELOW, MODERATE_BELOW = 0.33, 0.66
CHANNEL_DEFAULTS = {"width_m": 0.5, "depth_m": 0.5, "slope_m_m": 0.001, "mannings_n": 0.015}
CATCHMENT_M2 = 2500.0
FAR_FROM_DRAIN_M, NO_DRAIN_DISTANCE_M, FALLBACK_CAPACITY = 100.0, 500.0, 0.05


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def sanitise(x: Column, floor: float = 0.0) -> Column:
    """Doubles no smaller than ``floor``; null, NaN and infinite become it."""
    x = x.cast("double")
    return F.when(finite(x), F.greatest(x, F.lit(float(floor)))).otherwise(F.lit(float(floor)))


def manning_capacity(width: Column, depth: Column, slope: Column, n: Column | None = None) -> Column:
    w, d, s = sanitise(width), sanitise(depth), sanitise(slope)
    rough = F.greatest(F.lit(MANNING_FLOOR), sanitise(n if n is not None else F.lit(MANNING_DEFAULT)))
    area, edge = w * d, w + 2 * d
    radius = F.when(edge > 0, area / edge).otherwise(0.0)
    return (1 / rough) * area * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(s)


def drain_capacity(width: Column, depth: Column, slope: Column, n: Column) -> Column:
    """The drain table's capacity: nothing sanitised, the wetted edge at least 1e-4."""
    area = width * depth
    radius = area / F.greatest(F.lit(1e-4), width + 2 * depth)
    return (1 / n) * area * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(slope)


def rainfall_intensity(total_mm: Column, hours: float) -> Column:
    if not hours > 0:
        raise ValueError("hours must be above zero")
    return sanitise(total_mm) / float(hours)


def rational_runoff(intensity: Column, area: Column, coefficient: float | Column = RUNOFF_COEFFICIENT) -> Column:
    c = coefficient if isinstance(coefficient, Column) else F.lit(float(coefficient))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) * (sanitise(intensity) / MM_PER_HOUR_TO_M_PER_S) * sanitise(area)


def overload_ratio(demand: Column, capacity: Column) -> Column:
    return sanitise(demand) / F.greatest(F.lit(MIN_CAPACITY), sanitise(capacity))


def checked_rain(rain: float) -> float:
    """The scenario's rainfall; ValueError if it is negative or not finite."""
    if not math.isfinite(rain) or rain < 0:
        raise ValueError(f"rainfall must be finite and not negative, not {rain}")
    return float(rain)


def rescaled_demand(demand: Column, rain: Column, baseline: float = BASELINE_MM_HR) -> Column:
    if baseline <= 0:
        return F.lit(0.0).cast("float")
    return (demand.cast("double") * (rain / baseline)).cast("float")


def boosted(score: Column, overload: Column, limit: float = BOOST_LIMIT) -> Column:
    gain = F.least(F.lit(limit), F.greatest(F.lit(0.0), overload.cast("double") - 1.0) * BOOST_STEP).cast("float")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score.cast("float") + gain)).cast("float")


def rounded_score(score: Column) -> Column:
    """Four places by scaling and rounding half to even."""
    return (F.rint(score.cast("double") * 10_000) / 10_000).cast("float")


def risk_class(score: Column) -> Column:
    x = F.round(score.cast("double"), 4)
    return F.when(x < LOW_BELOW, "LOW").when(x < MODERATE_BELOW, "MODERATE").otherwise("HIGH")


def py_round(x: Column, digits: int) -> Column:
    """Rounds the exact binary value, half to even, as Python's round does."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.when(finite(x), F.call_function("format_number", x, F.lit(pattern)).cast("double")).otherwise(x)
