"""Data contracts: each check is one aggregate or a driver-side look at a schema."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import geo, hydro

# Fixed values.
CLASSES = ("LOW", "MODERATE", "HIGH")
REGISTRY = (("road", "road_id", "R"), ("place", "place_id", "P"), ("base", "base_id", "B"), ("flood_zone", "zone_id", "F"))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def validate_feature_names(names) -> bool:
    if [str(n) for n in names] != hydro.FEATURES:
        raise ValueError(f"features must be {hydro.FEATURES}")
    return True


def validate_prediction_fields(df: DataFrame) -> bool:
    require_columns(df, ["risk_class", "risk_score", "rainfall_mm_hr"])
    return True


#: In the order in which they are looked at.
RULES = ("score is not finite", "score outside 0 to 1", "unknown class", "class does not fit score")


def violation(score: Column, label: Column) -> Column:
    """Name of the first rule that a score and its class break, or null."""
    x = score.cast("double")
    return (
        F.when(~hydro.finite(x), RULES[0])
        .when((x < 0) | (x > 1), RULES[1])
        .when(label.isNull() | ~label.isin(*CLASSES), RULES[2])
        .when(hydro.risk_class(score) != label, RULES[3])
    )


def validate_risk_classes(df: DataFrame, score: str = "risk_score", label: str = "risk_class") -> bool:
    rank = F.element_at(F.create_map(*(x for i, w in enumerate(RULES) for x in (F.lit(w), F.lit(i)))), F.col("_why"))
    broken = df.withColumn("_why", violation(F.col(score), F.col(label))).filter("_why is not null").agg(F.min_by("_why", rank).alias("why"), F.count("*").alias("n")).first()
    if broken["n"]:
        raise ValueError(f"{broken['n']} rows: {broken['why']}")
    return True


def validate_grid_metadata(meta: dict, cells: int | None = None) -> bool:
    for key in ("height", "width", "bounds"):
        if key not in meta:
            raise ValueError(f"metadata lacks {key}")
    for key in ("height", "width"):
        if not isinstance(meta[key], int) or meta[key] <= 0:
            raise ValueError(f"{key} must be a positive integer")
    b = meta["bounds"]
    for key in ("left", "bottom", "right", "top"):
        if key not in b or not isinstance(b[key], (int, float)) or not math.isfinite(b[key]):
            raise ValueError(f"bounds lack {key}")
    if not b["left"] < b["right"] or not b["bottom"] < b["top"]:
        raise ValueError("bounds are upside down")
    if cells is not None and meta["height"] * meta["width"] != cells:
        raise ValueError("cell count does not fit the grid")
    return True


def id_report(df: DataFrame, column: str, prefix: str | None) -> DataFrame:
    """One row: total, unique_ids, missing, duplicates (nulls are copies of each other), bad_format, status."""
    c = F.col(column).cast("string")
    bad = F.count_if(c.isNotNull() & ~c.rlike(rf"^{prefix}\d+$")) if prefix else F.lit(0)
    missing = F.count_if(c.isNull())
    found = df.agg(F.count("*").alias("total"), F.count_distinct(c).alias("unique_ids"), missing.alias("missing"), bad.cast("long").alias("bad_format"))
    duplicates = F.col("total") - F.col("unique_ids") - F.when(F.col("missing") > 0, 1).otherwise(0)
    passed = (F.col("missing") == 0) & (F.col("bad_format") == 0) & (F.col("duplicates") == 0)
    return found.withColumn("duplicates", duplicates.cast("long")).withColumn("status", F.when(passed, "PASSED").otherwise("FAILED"))


def id_registry(roads: DataFrame, places: DataFrame, bases: DataFrame, zones: DataFrame) -> DataFrame:
    parts = [df.select(F.lit(kind).alias("entity_type"), F.lit(column).alias("id_column"), F.col(column).cast("string").alias("entity_id"), F.lit("LOCKED").alias("status")) for (kind, column, _), df in zip(REGISTRY, (roads, places, bases, zones), strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def artifact_checks(df: DataFrame) -> DataFrame:
    """One row: rows, bad_labels, not_finite, and leaks (features equal to the label everywhere)."""
    bad = F.lit(False)
    for c in hydro.FEATURES:
        bad = bad | ~hydro.finite(F.col(c).cast("double"))
    leaks = [F.coalesce(F.bool_and(F.col(c).cast("double") == F.col("y").cast("double")), F.lit(False)).cast("long") for c in hydro.FEATURES]
    total = leaks[0]
    for x in leaks[1:]:
        total = total + x
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col("y").isNull() | ~F.col("y").isin(0, 1)).alias("bad_labels"), F.count_if(bad).alias("not_finite"), total.alias("leaks"))


def inspect(df: DataFrame, kind: Column, crs: str | None = None) -> DataFrame:
    """(columns, crs, geometry_type, n_rows): rows of each geometry type, null included, beside the names of all columns and of the CRS."""
    names = F.array(*(F.lit(c) for c in df.columns)) if df.columns else F.array().cast("array<string>")
    return df.groupBy(kind.alias("geometry_type")).agg(F.count("*").alias("n_rows")).select(names.alias("columns"), F.lit(crs).cast("string").alias("crs"), "geometry_type", "n_rows")


def require_finite(df: DataFrame, columns: list[str]) -> None:
    """RuntimeError if any value is null, NaN or infinite."""
    found = df.agg(*(F.count_if(~hydro.finite(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    if any(found[c] for c in columns):
        raise RuntimeError(f"values that are not finite: { {c: found[c] for c in columns if found[c]} }")


def validate_predictions(df: DataFrame, meta: dict, names: list[str] | None = None) -> bool:
    """A scored table (features, raw_score, risk_score, risk_class) against its grid: as many rows as cells, all columns there, scores that fit their classes.

    Classes are those of the adjusted scores; raw scores have none and are not held against any.
    """
    if names is not None:
        validate_feature_names(names)
    require_columns(df, [*hydro.FEATURES, "raw_score", "risk_score", "risk_class"])
    columns = ("raw_score", "risk_score", "risk_class")
    found = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns)).first()
    validate_grid_metadata(meta, found["n"])
    short = [c for c in columns if found[c] != found["n"]]
    if short:
        raise ValueError(f"fewer values than cells: {short}")
    return validate_risk_classes(df)


# Names that mean degrees, and the metric system of the zone.
DEGREES = ("CRS84", "4326")
METRIC = "32644"


def is_geographic(crs: str | None) -> bool:
    """Whether coordinates are degrees; ValueError without a CRS or with one that is neither that nor the metric zone."""
    if not crs:
        raise ValueError("the layer names no CRS")
    code = crs.rstrip("/").split(":")[-1]
    if code in DEGREES:
        return True
    if code == METRIC:
        return False
    raise ValueError(f"unknown CRS {crs}")


def metric_line(line: Column, crs: str | None) -> Column:
    """``line`` in metres, reprojected if its CRS is in degrees."""
    return F.transform(line, lambda p: geo.utm(p["x"], p["y"])) if is_geographic(crs) else line


def require_same_crs(*names: str | None) -> None:
    if len({is_geographic(n) for n in names}) > 1:
        raise ValueError(f"layers differ in CRS: {names}")


def geometry_faults(line: Column, closed: bool = False) -> Column:
    """What is wrong with an array of points: missing, empty, short, not_finite or open; null if nothing is."""
    n = F.size(line)
    odd = F.exists(line, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | ~hydro.finite(p["x"]) | ~hydro.finite(p["y"]))
    fault = F.when(line.isNull(), "missing").when(n == 0, "empty").when(n < (4 if closed else 2), "short").when(odd, "not_finite")
    return fault.when(F.element_at(line, 1) != F.element_at(line, -1), "open") if closed else fault


def require_geometry(df: DataFrame, name: str, closed: bool = False) -> None:
    """ValueError with the number of each fault, if there is any."""
    found = {r.fault: r.n for r in df.groupBy(geometry_faults(F.col(name), closed).alias("fault")).agg(F.count("*").alias("n")).filter("fault IS NOT NULL").collect()}
    if found:
        raise ValueError(f"bad geometries in {name}: {found}")
