"""Outlines of zones: the union of circles around places, each drawn as a polygon of 64 corners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.priority import GROUP_REACH_M

# Fixed value: corners of a circle, sixteen a quarter.
CORNERS = 64
#: Ends of pieces that meet differ by rounding only, far less than this (metres).
MEETING = 1e-5

PIECE = "group long, px double, py double, qx double, qy double"
RING = "group long, ring int, area double, points array<struct<x:double,y:double>>"


def _uncovered(reach: float):
    turn = 2 * np.pi / CORNERS
    around = np.arange(CORNERS)
    corners = reach * np.stack([np.cos(turn * around), np.sin(turn * around)], axis=1)
    normals = np.stack([np.cos(turn * (around + 0.5)), np.sin(turn * (around + 0.5))], axis=1)
    inner = reach * np.cos(turn / 2)
    along = np.roll(corners, -1, axis=0) - corners
    slope = along @ normals.T
    gap = (around[:, None] - around[None, :]) % (CORNERS // 2)
    slope[gap == 0] = 0.0  # a side is parallel to its like and to the one across

    def pieces(rows: pd.DataFrame) -> pd.DataFrame:
        group, x, y = rows.iloc[0][["group", "x", "y"]]
        covered = [[] for _ in around]
        for ox, oy in rows[["ox", "oy"]].dropna().itertuples(index=False):
            over = (corners + [x - ox, y - oy]) @ normals.T - inner
            with np.errstate(divide="ignore", invalid="ignore"):
                at = -over / slope
            least = np.where(slope < 0, at, 0.0).max(axis=1)
            most = np.where(slope > 0, at, 1.0).min(axis=1)
            # Of two sides on one line, the later circle's counts as covered.
            out = (slope == 0) & ((over > MEETING) | ((np.abs(over) <= MEETING) & ((x, y) < (ox, oy))))
            for k in np.flatnonzero((least < most) & ~out.any(axis=1)):
                covered[k].append((max(least[k], 0.0), min(most[k], 1.0)))
        free = []
        for k, spans in enumerate(covered):
            now = 0.0
            for a, b in [*sorted(spans), (1.0, 1.0)]:
                if a > now:
                    free.append([*(corners[k] + now * along[k]), *(corners[k] + a * along[k])])
                now = max(now, b)
        found = pd.DataFrame(np.array(free, float).reshape(-1, 4) + [x, y, x, y], columns=["px", "py", "qx", "qy"])
        found.insert(0, "group", int(group))
        return found

    return pieces


def _rings(rows: pd.DataFrame) -> pd.DataFrame:
    ends = rows[["px", "py", "qx", "qy"]].to_numpy()
    ends = ends[np.lexsort(ends.T)]
    starts: dict[tuple[int, int], list[int]] = {}
    cells = np.rint(ends / MEETING).astype("int64")
    for i, (a, b, *_) in enumerate(cells):
        starts.setdefault((a, b), []).append(i)
    used, out = np.zeros(len(ends), bool), []
    for first in range(len(ends)):
        if used[first]:
            continue
        ring, i = [], first
        while i is not None:
            used[i] = True
            ring.append(ends[i, :2])
            a, b = cells[i, 2:]
            i = next((j for da in (0, -1, 1) for db in (0, -1, 1) for j in starts.get((a + da, b + db), ()) if not used[j]), None)
        p = np.array([*ring, ring[0]])
        q = p - p[0]
        out.append((float((q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum() / 2), p))
    out.sort(key=lambda r: -r[0])
    group = int(rows["group"].iloc[0])
    return pd.DataFrame([(group, n, area, [{"x": a, "y": b} for a, b in p]) for n, (area, p) in enumerate(out)], columns=["group", "ring", "area", "points"])


def outlines(members: DataFrame, reach: float = GROUP_REACH_M) -> DataFrame:
    """(group, ring, area, points): closed rings around all circles of a group; ``members`` is (group, x, y) in metres.

    Rings run anticlockwise with an area above zero, holes clockwise with one
    below it; ring 0 is the largest.  Each circle's sides are cut by the
    circles that it meets, found by cells, in a task of its own; only the
    pieces of the outline, which the zone's one polygon holds anyhow, come
    together by group.  Repeated places count once; rows with a null or
    non-finite coordinate take no part; without rows there are no rings.
    """
    real = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in "xy")
    spots = members.select("group", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(f"`group` IS NOT NULL AND {real}").distinct()
    cell = lambda c: F.floor(F.col(c) / (2 * reach)).cast("long")
    beside = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
    others = spots.select("group", F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy")).withColumn("dx", beside).withColumn("dy", beside)
    others = others.select("group", "ox", "oy", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    apart = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    met = spots.withColumns({"cx": cell("x"), "cy": cell("y")}).join(others, ["group", "cx", "cy"]).filter((apart > 0) & (apart < 2 * reach))
    wide = spots.join(met.select("group", "x", "y", "ox", "oy"), ["group", "x", "y"], "left")
    pieces = wide.groupBy("group", "x", "y").applyInPandas(_uncovered(reach), PIECE)
    return pieces.groupBy("group").applyInPandas(_rings, RING)
