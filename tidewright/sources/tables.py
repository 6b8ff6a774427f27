"""CSV tables, row positions and JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import hydro

DRAINS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("width_m", "depth_m", "slope_m_m", "mannings_n")])
RAINFALL = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("rainfall_mm_hr", T.DoubleType()), T.StructField("duration_min", T.IntegerType())])


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Adds pos, 0 upwards in ``order``: a range sort, then each range counts on from those before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    counts = {r["_p"]: r["n"] for r in marked.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(at)]
        at += counts[p]
    base = F.element_at(F.create_map(*starts), F.col("_p")) if starts else F.lit(0)
    within = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return marked.withColumn("pos", (base + within).cast("long")).drop("_p", "_m")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def require_path(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """A CSV file's columns by their header names; a column that the file lacks has its default, or fails.

    Values that are no such type are null, and further columns are not read.
    """
    raw = spark.read.option("header", True).csv(require_path(spark, path))
    absent = [f.name for f in schema if f.name not in raw.columns and f.name not in (defaults or {})]
    if absent:
        raise ValueError(f"{path} lacks columns {absent}")
    column = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(defaults[f.name]).cast(f.dataType)
    return raw.select(*(column(f).alias(f.name) for f in schema))


def read_drains(spark: SparkSession, path: str) -> DataFrame:
    """The drain table; only a column that is missing as a whole has its default."""
    return read_csv(spark, path, DRAINS, hydro.CHANNEL_DEFAULTS)


def read_rainfall(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RAINFALL)


def write_registry(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document (grid metadata, metrics), through Spark's readers."""
    return json.loads(spark.read.text(require_path(spark, path), wholetext=True).first()[0])


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


# Fixed values.
DEFAULT_PIXEL_M = 30.83
FALLBACK_SHAPE = (1568, 872)


def read_grid_metadata(spark: SparkSession, path: str) -> dict:
    """Grid metadata with the default pixel size; without a file there is the default shape alone."""
    meta = read_document(spark, path) if exists(spark, path) else dict(zip(("height", "width"), FALLBACK_SHAPE, strict=True))
    return {"pixel_size_m": DEFAULT_PIXEL_M, **meta}


def write_lines(rows: DataFrame, column: str, order: str, path: str, head: str, tail: str, between: str = ",") -> None:
    """One text file: ``head``, a line per row in ``order`` with ``between`` after all but the last, ``tail``."""
    placed = with_position(rows.select(F.col(order).alias("_o"), F.col(column).alias("_v")), "_o")
    body = placed.select((F.col("pos") + 1).alias("at"), F.concat(F.when(F.col("pos") > 0, F.lit(between)).otherwise(F.lit("")), F.col("_v")).alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, head), ((1 << 63) - 1, tail)], "at long, value string")
    body.unionByName(ends).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def write_routes(routes: DataFrame, order: str, path: str) -> None:
    """Calculated routes as one JSON array, a route per line."""
    write_lines(routes.select(order, F.to_json(F.struct(*routes.columns), {"ignoreNullFields": "false"}).alias("_json")), "_json", order, path, "[", "]")


def read_routes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(require_path(spark, path))
