"""GeoJSON in and out through Spark's text and JSON readers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators import contracts
from tidewright.sources.tables import require_path, with_position, write_lines

# Fixed values, as are the names of properties below.
CRS84 = "urn:ogc:def:crs:OGC:1.3:CRS84"


def read(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """One row per feature in file order: feature_ord, the properties, kind, coordinates (JSON text), crs."""
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])
    named = T.StructType([T.StructField("properties", T.StructType([T.StructField("name", T.StringType())]))])
    whole = T.StructType([T.StructField("crs", named), T.StructField("features", T.ArrayType(feature))])
    docs = spark.read.option("multiLine", True).schema(whole).json(require_path(spark, path))
    rows = docs.select(F.col("crs.properties.name").alias("crs"), F.posexplode("features").alias("feature_ord", "f"))
    return rows.select("feature_ord", "f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), "crs")


def read_lines(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """As ``read``, for files with a feature per line: lines are read in many tasks, whatever the file's size."""
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", properties), T.StructField("geometry", geometry)])
    block = F.col("_metadata.file_block_start")
    text = spark.read.text(require_path(spark, path)).select(F.regexp_replace("value", r"^[\s,]+|[\s,]+$", "").alias("v"), block.alias("_b"), F.monotonically_increasing_id().alias("_i"))
    is_feature = F.col("v").rlike(r'^\{\s*"type"\s*:\s*"Feature"')
    crs = text.filter(~is_feature).agg(F.max(F.nullif(F.regexp_extract("v", r'"crs".*?"name"\s*:\s*"([^"]*:[^"]*)"', 1), F.lit("")))).first()[0]
    rows = text.filter(is_feature).select("_b", "_i", F.from_json("v", feature).alias("f"))
    placed = with_position(rows, "_b", "_i").withColumnRenamed("pos", "feature_ord")
    return placed.select("feature_ord", "f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.lit(crs).alias("crs"))


def _point(c: Column) -> Column:
    return F.struct(c[0].alias("x"), c[1].alias("y"))


def as_point(coordinates: Column) -> Column:
    return _point(F.from_json(coordinates, "array<double>"))


def as_line(coordinates: Column) -> Column:
    return F.transform(F.from_json(coordinates, "array<array<double>>"), _point)


def as_ring(coordinates: Column) -> Column:
    """A polygon's outer ring."""
    return F.transform(F.from_json(coordinates, "array<array<array<double>>>")[0], _point)


def feature(properties: list[str], kind: str, coordinates: Column) -> Column:
    """A feature's JSON text; ``coordinates`` are nested arrays of numbers."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def pairs(line: Column) -> Column:
    return F.transform(line, lambda p: F.array(p["x"], p["y"]))


def write_sequence(features: DataFrame, column: str, path: str) -> None:
    """A feature per line, in as many files as there are partitions."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write(features: DataFrame, column: str, order: str, path: str) -> None:
    """One FeatureCollection as a single text file, a feature per line."""
    crs = json.dumps({"type": "name", "properties": {"name": CRS84}})
    write_lines(features, column, order, path, '{"type": "FeatureCollection", "crs": ' + crs + ', "features": [', "]}")


def cell_feature(rain: Column, width: int, ring: Column) -> Column:
    """A scored cell with its seventeen properties; coordinates to six places."""
    r4 = lambda c: F.round(F.col(c).cast("double"), 4)
    props = F.struct(
        "cell_id", "r", "c", "risk_class", r4("risk_score").alias("risk_score"), r4("raw_score").alias("risk_score_raw"), rain.cast("double").alias("rainfall_mm_hr"),
        r4("q_demand").alias("runoff_m3_s"), r4("q_cap").alias("drainage_capacity_m3_s"), r4("r_overload").alias("overload_ratio"), r4("r_overload").alias("r_overload"), r4("q_cap").alias("q_cap"), r4("q_demand").alias("q_demand"),
        F.round(F.col("elevation").cast("double"), 2).alias("elevation"), F.round(F.col("slope").cast("double"), 2).alias("slope"), F.round(F.col("tpi").cast("double"), 2).alias("tpi"), F.round(F.col("dist_to_drain").cast("double"), 1).alias("dist_to_drain"),
    )
    renamed = F.struct(*(props[n].alias({"r": "row", "c": "col"}.get(n, n)) for n in ("cell_id", "r", "c", "risk_class", "risk_score", "risk_score_raw", "rainfall_mm_hr", "runoff_m3_s", "drainage_capacity_m3_s", "overload_ratio", "r_overload", "q_cap", "q_demand", "elevation", "slope", "tpi", "dist_to_drain")))
    corner = lambda p: F.concat(F.lit("["), F.format_string("%.6f", p["x"]), F.lit(", "), F.format_string("%.6f", p["y"]), F.lit("]"))
    coords = F.concat(F.lit("[["), F.array_join(F.transform(ring, corner), ", "), F.lit("]]"))
    return F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json(renamed), F.lit(', "geometry": {"type": "Polygon", "coordinates": '), coords, F.lit("}}"))


def validate(spark: SparkSession, path: str, height: int | None = None, width: int | None = None, linewise: bool = False) -> bool:
    """The scored grid's contract; raises ValueError at the first rule broken.  ``linewise`` files have a feature per line."""
    props = T.StructType([T.StructField(n, t) for n, t in (("cell_id", T.LongType()), ("row", T.LongType()), ("col", T.LongType()), ("risk_class", T.StringType()), ("risk_score", T.DoubleType()), ("rainfall_mm_hr", T.DoubleType()))])
    rows = (read_lines if linewise else read)(spark, path, props).withColumn("cell_id", F.coalesce("cell_id", F.col("feature_ord") + 1))
    ring = as_ring(F.col("coordinates"))
    closed = (F.size(ring) == 5) & (ring[0] == ring[4])
    place = F.lit(False)
    if width:
        place = (F.col("row") * width + F.col("col") + 1 != F.col("cell_id")) & F.col("row").isNotNull() & F.col("col").isNotNull()
    found = rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("cell_id").alias("ids"),
        F.count_if(F.col("kind") != "Polygon").alias("not polygons"),
        F.count_if(~F.coalesce(closed, F.lit(False))).alias("open rings"),
        F.count_if(F.col("risk_class").isNull() | F.col("risk_score").isNull() | F.col("rainfall_mm_hr").isNull()).alias("missing fields"),
        F.count_if(contracts.violation(F.col("risk_score"), F.col("risk_class")).isNotNull()).alias("bad scores"),
        F.count_if(place).alias("misplaced cells"),
    ).first()
    for rule in ("not polygons", "open rings", "missing fields", "bad scores", "misplaced cells"):
        if found[rule]:
            raise ValueError(f"{rule}: {found[rule]}")
    if found["ids"] != found["n"]:
        raise ValueError("cell_id is not unique")
    if height and width and found["n"] != height * width:
        raise ValueError(f"{found['n']} features for {height * width} cells")
    return True
