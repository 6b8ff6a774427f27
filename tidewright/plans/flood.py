"""Flood risk from end to end: drains to features, training with its report, prediction with its checks, and a runner with gates."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import geo, hydro
from tidewright.operators import contracts, forest, grid, metrics, spatial
from tidewright.sources import geojson
from tidewright.sources.tables import exists, write_document

CELL_M = 250.0


def drain_vertices(drains: DataFrame, step: float = 10.0) -> DataFrame:
    """(target_id, ord, x, y, q) of all points, at most ``step`` metres apart, of drains (drain_id, line in degrees, q_cap), in local metres."""
    points = drains.select("drain_id", "q_cap", F.posexplode(geo.densified(F.col("line"), step)).alias("k", "p"))
    x, y = F.col("p.x") * geo.METRES_PER_DEGREE * geo.DENSIFY_COSINE, F.col("p.y") * geo.METRES_PER_DEGREE
    key = F.struct("drain_id", "k")
    return points.select(key.alias("target_id"), key.alias("ord"), x.alias("x"), y.alias("y"), F.col("q_cap").alias("q"))


def near_drains(cells: DataFrame, drains: DataFrame, step: float = 10.0) -> DataFrame:
    """(cell_id, dist_to_drain, q_cap): the nearest vertex of cells (cell_id, lon, lat) and its capacity.

    Beyond ``FAR_FROM_DRAIN_M`` a cell has the fallback capacity; without any
    drain every cell has the fallback distance and capacity.
    """
    vertices = drain_vertices(drains, step)
    spots = cells.select(F.col("cell_id").alias("id"), (F.col("lon") * geo.METRES_PER_DEGREE * geo.DENSIFY_COSINE).alias("x"), (F.col("lat") * geo.METRES_PER_DEGREE).alias("y"))
    found = spatial.nearest(spots, vertices.drop("q"), CELL_M)
    q = drains.select(F.col("drain_id").alias("_d"), F.col("q_cap").alias("q"))
    met = found.join(q, F.col("target_id.drain_id") == F.col("_d")).select(F.col("id").alias("cell_id"), "d", "q")
    near = F.when(F.col("d") <= hydro.FAR_FROM_DRAIN_M, F.col("q"))
    return cells.select("cell_id").join(met, "cell_id", "left").select("cell_id", F.coalesce("d", F.lit(hydro.NO_DRAIN_DISTANCE_M)).alias("dist_to_drain"), F.coalesce(near, F.lit(hydro.FALLBACK_CAPACITY)).alias("q_cap"))


def feature_table(cells: DataFrame, drains: DataFrame, rain: float = hydro.BASELINE_MM_HR, step: float = 10.0) -> DataFrame:
    """The seven features of cells (cell_id, lon, lat, elevation, slope, tpi, catchment_m2, any others), as floats."""
    intensity = F.lit(hydro.checked_rain(rain))
    wide = cells.join(near_drains(cells, drains, step), "cell_id").withColumn("q_demand", hydro.rational_runoff(intensity, F.col("catchment_m2")))
    wide = wide.withColumn("r_overload", hydro.overload_ratio(F.col("q_demand"), F.col("q_cap")))
    return wide.withColumns({c: F.col(c).cast("float") for c in hydro.FEATURES})


def monotonicity() -> dict[str, bool]:
    """What the boost must hold, on a few numbers."""
    b = lambda s, r: min(1.0, max(0.0, s + min(hydro.BOOST_LIMIT, max(0.0, r - 1) * hydro.BOOST_STEP)))
    return {
        "no_boost_below_capacity": b(0.4, 0.5) == 0.4 and b(0.4, 1.0) == 0.4,
        "more_overload_more_risk": b(0.4, 1.5) < b(0.4, 2.5),
        "boost_is_limited": abs(b(0.4, 100.0) - 0.4 - hydro.BOOST_LIMIT) < 1e-12,
        "never_above_one": b(0.95, 100.0) == 1.0,
        "never_below_zero": b(0.0, 0.0) == 0.0,
    }


def train(df: DataFrame, height: int, model_path: str, report_path: str | None = None, **sizes) -> tuple[PipelineModel, dict]:
    """Fit on the north, judge on the south, save and reload the model; the model and its report."""
    parts = grid.holdout(df, height)
    held = parts.filter("part = 'validation'")
    model = forest.fit(parts.filter("part = 'train'"), **sizes)
    forest.save(model, model_path)
    rows = {r["kind"]: r.asDict() for r in metrics.report(forest.score(model, held), {"raw": "raw_score", "adjusted": "risk_score"}).collect()}
    counts = {(r["part"], r["y"]): r["n"] for r in parts.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    total, flooded = sum(counts.values()), sum(n for (_, y), n in counts.items() if y == 1)
    last = model.stages[-1]
    report = {
        "n_estimators": last.getNumTrees,
        "max_depth": last.getOrDefault("maxDepth"),
        "random_state": forest.SEED,
        "dataset": {"total_spatial_cells": total, **{f"{p}_cells": sum(n for (q, _), n in counts.items() if q == p) for p in ("train", "validation")}, "feature_names": hydro.FEATURES, "flooded_percentage": round(100 * flooded / total, 2) if total else 0.0},
        "raw_model_metrics": rows["raw"],
        "physics_adjusted_metrics": rows["adjusted"],
        "feature_importances": forest.importances(model),
        "physics_monotonicity_tests": monotonicity(),
        "reload_test_passed": forest.reload_matches(model, model_path, held),
    }
    if report_path:
        write_document(df.sparkSession, report, report_path)
    return model, report


def predict(model: PipelineModel, df: DataFrame, rain: float) -> DataFrame:
    """Scores under another rainfall; RuntimeError if a raw score is not finite."""
    scored = forest.score(model, forest.rescaled(df, rain))
    contracts.require_finite(scored, ["raw_score", "r_overload"])
    return scored


def validations(scored: DataFrame, meta: dict, path: str, model: PipelineModel, model_path: str) -> dict[str, bool]:
    """Ten checks of a prediction and of its GeoJSON at ``path``; nothing is raised."""
    spark, cells, b = scored.sparkSession, meta["height"] * meta["width"], meta["bounds"]
    in_range = lambda c: F.coalesce(F.bool_and(F.coalesce(hydro.finite(F.col(c).cast("double")) & F.col(c).between(0, 1), F.lit(False))), F.lit(True))
    found = scored.agg(F.count("*").alias("n"), in_range("raw_score").alias("raw"), in_range("risk_score").alias("adjusted"), F.coalesce(F.bool_and(F.coalesce(F.col("risk_class").isin(*contracts.CLASSES), F.lit(False))), F.lit(True)).alias("classes")).first()
    there = exists(spark, path)
    head = "".join(r["value"] for r in spark.read.text(path).limit(5).collect())[:500] if there else ""

    def valid() -> bool:
        try:
            return there and geojson.validate(spark, path, meta["height"], meta["width"], linewise=True)
        except ValueError:
            return False

    return {
        "prediction_count": found["n"] == cells,
        "raw_scores_valid": found["raw"],
        "adjusted_scores_valid": found["adjusted"],
        "risk_classes_valid": found["classes"],
        "file_exists": there,
        "geojson_valid": valid(),
        "geojson_header": '"FeatureCollection"' in head and '"features"' in head,
        "grid_shape": found["n"] == cells,
        "bounds_valid": b["left"] < b["right"] and b["bottom"] < b["top"],
        "reload_repeatable": forest.reload_matches(model, model_path, scored, 500),
    }


@dataclass(frozen=True)
class Stage:
    """A step of a run and the paths that it must leave behind."""

    name: str
    work: Callable[[], None]
    outputs: list[str] = field(default_factory=list)


def run_stages(spark: SparkSession, stages: list[Stage]) -> list[dict]:
    """Run stages in turn and stop at the first that raises or leaves an output missing: (name, ok, seconds, why) of each that ran."""
    out: list[dict] = []
    for stage in stages:
        began, why = time.time(), ""
        try:
            stage.work()
        except Exception as e:
            why = f"{type(e).__name__}: {e}"
        missing = [p for p in stage.outputs if not exists(spark, p)]
        if not why and missing:
            why = f"missing outputs: {json.dumps(missing)}"
        out.append({"name": stage.name, "ok": not why, "seconds": round(time.time() - began, 3), "why": why})
        if why:
            break
    return out
