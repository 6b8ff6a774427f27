"""Raster operators on tables with one row per cell: row r, column c."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.storage import cut

# Neighbours in the order that settles ties, with the step's length in pixels.
NEIGHBOURS = [("n", -1, 0, 1.0), ("s", 1, 0, 1.0), ("w", 0, -1, 1.0), ("e", 0, 1, 1.0), ("nw", -1, -1, 1.41421356), ("ne", -1, 1, 1.41421356), ("sw", 1, -1, 1.41421356), ("se", 1, 1, 1.41421356)]


def cell_id(r: Column, c: Column, width: int) -> Column:
    return (r * width + c + 1).cast("long")


def row_col(cell: Column, width: int) -> Column:
    """struct<r, c> of a cell's number; the inverse of cell_id."""
    at = cell.cast("long") - 1
    return F.struct(F.floor(at / width).alias("r"), F.pmod(at, F.lit(width)).cast("long").alias("c"))


def sample_point(r: Column, c: Column, width: int, height: int, left: float, bottom: float, right: float, top: float) -> Column:
    """The point that distances are measured from, as floats: evenly spaced from edge to edge, both edges included."""
    x = left + c * ((right - left) / max(1, width - 1))
    y = top - r * ((top - bottom) / max(1, height - 1))
    return F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"))


def cell_polygon(r: Column, c: Column, width: int, height: int, left: float, bottom: float, right: float, top: float) -> Column:
    """Closed ring, lower left first, anticlockwise."""
    dx, dy = (right - left) / width, (top - bottom) / height
    x0, y1 = left + c * dx, top - r * dy
    x1, y0 = x0 + dx, y1 - dy
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))


def flow_direction(cells: DataFrame, pixel_m: float = 30.83) -> DataFrame:
    """(r, c, elevation, down_r, down_c) of the steepest descent; null where nothing is lower.

    Two window passes, along rows and then along columns, bring all eight
    neighbours together: each cell is shuffled twice, whatever the grid's size.
    """
    z = F.col("elevation").cast("float")
    here = F.struct(F.col("r").alias("r"), F.col("c").alias("c"), z.alias("z"))
    row = Window.partitionBy("r").orderBy("c")
    near = lambda x, c: F.when(x["c"] == c, x["z"])
    wide = cells.select("r", "c", "elevation", here.alias("h"), F.lag(here).over(row).alias("a"), F.lead(here).over(row).alias("b"))
    strip = F.struct(F.col("r").alias("r"), near(F.col("a"), F.col("c") - 1).alias("w"), F.col("h.z").alias("m"), near(F.col("b"), F.col("c") + 1).alias("e"))
    # A cell's neighbours above and below may be absent while their own neighbours exist, so strips are kept by place.
    places = wide.select("r", "c", strip.alias("s"))
    column = Window.partitionBy("c").orderBy("r")
    tall = places.select("r", "c", "s", F.lag("s").over(column).alias("up"), F.lead("s").over(column).alias("dn"))
    up, dn = (F.when(F.col(k)["r"] == F.col("r") + d, F.col(k)) for k, d in (("up", -1), ("dn", 1)))
    value = {"n": up["m"], "s": dn["m"], "w": F.col("s.w"), "e": F.col("s.e"), "nw": up["w"], "ne": up["e"], "sw": dn["w"], "se": dn["e"]}
    drops = [F.struct(((F.col("s.m") - value[k]) / F.lit(m * pixel_m).cast("float")).alias("slope"), F.lit(-i).alias("o"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (k, dr, dc, m) in enumerate(NEIGHBOURS)]
    best = F.array_max(F.filter(F.array(*drops), lambda d: d["slope"] > 0))
    return tall.withColumn("best", best).select("r", "c", F.col("s.m").alias("elevation"), (F.col("r") + F.col("best.dr")).alias("down_r"), (F.col("c") + F.col("best.dc")).alias("down_c"))


def flow_accumulation(down: DataFrame) -> DataFrame:
    """(node, acc): how many nodes drain through each one, itself included; ``down`` is (node, next).

    Pointer doubling: each round adds the sums of the nodes that point here and
    doubles the pointers, so rounds grow with the logarithm of the longest path.
    """
    now = cut(down.select("node", F.col("next").alias("jump"), F.lit(1).cast("long").alias("acc")))
    while True:
        moving = now.filter("jump is not null")
        if moving.isEmpty():
            return now.select("node", "acc")
        gains = moving.groupBy(F.col("jump").alias("node")).agg(F.sum("acc").alias("gain"))
        ahead = now.select(F.col("node").alias("jump"), F.col("jump").alias("further"))
        now = cut(now.join(gains, "node", "left").join(ahead, "jump", "left").select("node", F.col("further").alias("jump"), (F.col("acc") + F.coalesce("gain", F.lit(0))).alias("acc")))


def holdout(cells: DataFrame, height: int, share: float = 0.75) -> DataFrame:
    return cells.withColumn("part", F.when(F.col("r") < int(height * share), "train").otherwise("validation"))
