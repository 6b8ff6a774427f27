"""Registered queries over the derived tables, and the SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import geo, hydro
from tidewright.operators import contracts, forest, graph, grid, metrics, priority, spatial
from tidewright.plans import flood
from tidewright.plans.derived import WIDTH, derived, duck, lines, zones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql, *ctes, recursive=recursive)
        return f

    return add


def _r(x, digits: int = 6):
    return F.round(x, digits)


_SAN = "CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) THEN 0e0 ELSE greatest(0e0, {0}) END"


@query(f"SELECT event_id, {_SAN.format('v')} AS clean FROM readings", "readings")
def sanitise_clamp(spark, sf):
    return derived(spark, sf, "readings").select("event_id", hydro.sanitise(F.col("v")).alias("clean"))


_CAPACITY = "(1 / greatest(1e-4, coalesce(mannings_n, 0e0))) * width_m * depth_m * pow(CASE WHEN width_m + 2 * depth_m > 0 THEN width_m * depth_m / (width_m + 2 * depth_m) ELSE 0e0 END, 2e0 / 3e0) * sqrt(slope_m_m)"


@query(f"""SELECT drain_id, round({_CAPACITY}, 6) AS capacity, round((1 / coalesce(mannings_n, 0.015e0)) * width_m * depth_m * pow(width_m * depth_m / greatest(1e-4, width_m + 2 * depth_m), 2e0 / 3e0) * sqrt(slope_m_m), 6) AS table_capacity FROM drains""", "drains")
def manning_capacity(spark, sf):
    w, d, s, n = (F.col(c) for c in ("width_m", "depth_m", "slope_m_m", "mannings_n"))
    return derived(spark, sf, "drains").select("drain_id", _r(hydro.manning_capacity(w, d, s, n)).alias("capacity"), _r(hydro.drain_capacity(w, d, s, F.coalesce(n, F.lit(hydro.MANNING_DEFAULT)))).alias("table_capacity"))


@query(f"SELECT event_id, round({_SAN.format('v')} / 24e0, 6) AS mm_per_hour FROM readings", "readings")
def rainfall_intensity(spark, sf):
    return derived(spark, sf, "readings").select("event_id", _r(hydro.rainfall_intensity(F.col("v"), 24)).alias("mm_per_hour"))


@query(f"SELECT event_id, round(0.75e0 * (({_SAN.format('v')}) / 3600000e0) * 2500e0, 9) AS q FROM readings", "readings")
def rational_runoff(spark, sf):
    return derived(spark, sf, "readings").select("event_id", _r(hydro.rational_runoff(F.col("v"), F.lit(2500.0)), 9).alias("q"))


@query("SELECT k, round(q_demand / greatest(1e-6, q_cap), 6) AS overload FROM cells", "cells")
def overload_ratio(spark, sf):
    return derived(spark, sf, "cells").select("k", _r(hydro.overload_ratio(F.col("q_demand"), F.col("q_cap"))).alias("overload"))


def stressed(drains: DataFrame, rain: float, area: float = hydro.CATCHMENT_M2, coefficient: float = hydro.RUNOFF_COEFFICIENT) -> tuple[DataFrame, DataFrame]:
    """Drains with impaired columns imputed, and capacity, demand and overload; one row of imputation counts."""
    out, bad = drains, {}
    for c, default in hydro.CHANNEL_DEFAULTS.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
        wrong = ~hydro.finite(F.col(c)) | (F.col(c) <= 0)
        out = out.withColumns({f"_{c}": wrong, c: F.when(wrong, default).otherwise(F.col(c))})
        bad[c] = F.count_if(f"_{c}").alias(f"imputed_{c}")
    stats = out.agg(F.count("*").alias("n_drains"), *bad.values())
    rows = out.drop(*(f"_{c}" for c in bad))
    rows = rows.withColumns({"q_cap": hydro.manning_capacity(*(F.col(c) for c in hydro.CHANNEL_DEFAULTS)), "q_demand": hydro.rational_runoff(F.lit(float(rain)), F.lit(area), coefficient)})
    return rows.withColumn("r_overload", hydro.overload_ratio(F.col("q_demand"), F.col("q_cap"))), stats


_IMPUTED = """WITH fixed AS (
  SELECT drain_id, CASE WHEN width_m > 0 THEN width_m ELSE 0.5e0 END AS width_m, CASE WHEN depth_m > 0 THEN depth_m ELSE 0.5e0 END AS depth_m,
    CASE WHEN slope_m_m > 0 THEN slope_m_m ELSE 0.001e0 END AS slope_m_m, CASE WHEN mannings_n > 0 THEN mannings_n ELSE 0.015e0 END AS mannings_n FROM drains),
cap AS (SELECT *, (1 / mannings_n) * width_m * depth_m * pow(width_m * depth_m / (width_m + 2 * depth_m), 2e0 / 3e0) * sqrt(slope_m_m) AS q FROM fixed)
SELECT drain_id, width_m, depth_m, slope_m_m, mannings_n, round(q, 6) AS q_cap, round(0.75e0 * (80e0 / 3600000e0) * 2500e0 / greatest(1e-6, q), 6) AS r_overload FROM cap"""


@query(_IMPUTED, "drains")
def runoff_stress_impute(spark, sf):
    rows, _ = stressed(derived(spark, sf, "drains"), 80.0)
    return rows.select("drain_id", "width_m", "depth_m", "slope_m_m", "mannings_n", _r(F.col("q_cap")).alias("q_cap"), _r(F.col("r_overload")).alias("r_overload"))


@query("SELECT count(*) AS n_drains, count(*) FILTER (width_m IS NULL OR width_m <= 0) AS imputed_width_m, count(*) FILTER (depth_m IS NULL OR depth_m <= 0) AS imputed_depth_m, count(*) FILTER (slope_m_m IS NULL OR slope_m_m <= 0) AS imputed_slope_m_m, count(*) FILTER (mannings_n IS NULL OR mannings_n <= 0) AS imputed_mannings_n FROM drains", "drains")
def runoff_stress_stats(spark, sf):
    return stressed(derived(spark, sf, "drains"), 80.0)[1]


def scored(cells: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Cells under each scenario: demand, overload, boosted score and class; scenarios are a short list given with the request."""
    wide = cells.join(F.broadcast(scenarios))
    wide = wide.withColumn("q_new", hydro.rescaled_demand(F.col("q_demand").cast("float"), F.col("rain")))
    wide = wide.withColumn("r_new", hydro.overload_ratio(F.col("q_new"), F.col("q_cap").cast("float")).cast("float"))
    wide = wide.withColumn("risk_score", hydro.rounded_score(hydro.boosted(F.col("raw_score"), F.col("r_new"))))
    return wide.withColumn("risk_class", hydro.risk_class(F.col("risk_score")))


_SCORED = """WITH demand AS (SELECT *, CAST(CAST(CAST(q_demand AS FLOAT) AS DOUBLE) * (rain / 80e0) AS FLOAT) AS q_new FROM cells CROSS JOIN scenarios),
load AS (SELECT *, CAST(CAST(q_new AS DOUBLE) / greatest(1e-6, CAST(CAST(q_cap AS FLOAT) AS DOUBLE)) AS FLOAT) AS r_new FROM demand),
boost AS (SELECT *, CAST(least(1e0, greatest(0e0, CAST(CAST(raw_score AS FLOAT) + CAST(least(0.15e0, greatest(0e0, CAST(r_new AS DOUBLE) - 1e0) * 0.05e0) AS FLOAT) AS DOUBLE))) AS FLOAT) AS boosted FROM load),
scored AS (SELECT *, round_even(CAST(boosted AS DOUBLE) * 10000e0, 0) / 10000e0 AS risk_score FROM boost),
named AS (SELECT *, CASE WHEN risk_score < 0.33e0 THEN 'LOW' WHEN risk_score < 0.66e0 THEN 'MODERATE' ELSE 'HIGH' END AS risk_class FROM scored) """


@query(_SCORED + "SELECT k, rain, round(CAST(q_new AS DOUBLE), 6) AS q_new, round(CAST(r_new AS DOUBLE), 4) AS r_new FROM named", "cells", "scenarios")
def scenario_rescale(spark, sf):
    s = scored(derived(spark, sf, "cells"), derived(spark, sf, "scenarios"))
    return s.select("k", "rain", _r(F.col("q_new").cast("double")).alias("q_new"), _r(F.col("r_new").cast("double"), 4).alias("r_new"))


@query(_SCORED + "SELECT k, rain, risk_score FROM named", "cells", "scenarios")
def physics_boost(spark, sf):
    s = scored(derived(spark, sf, "cells"), derived(spark, sf, "scenarios"))
    return s.select("k", "rain", _r(F.col("risk_score").cast("double"), 4).alias("risk_score"))


@query(_SCORED + "SELECT k, rain, risk_class FROM named", "cells", "scenarios")
def risk_classify(spark, sf):
    return scored(derived(spark, sf, "cells"), derived(spark, sf, "scenarios")).select("k", "rain", "risk_class")


@query(_SCORED + ", classes AS (SELECT unnest(['LOW', 'MODERATE', 'HIGH']) AS risk_class), counts AS (SELECT rain, risk_class, count(*) AS n FROM named GROUP BY ALL) SELECT s.rain, c.risk_class, coalesce(n, 0) AS n, round(100e0 * coalesce(n, 0) / (SELECT count(*) FROM cells), 4) AS pct FROM scenarios s CROSS JOIN classes c LEFT JOIN counts x ON x.rain = s.rain AND x.risk_class = c.risk_class", "cells", "scenarios")
def scenario_distribution(spark, sf):
    cells, scenarios = derived(spark, sf, "cells"), derived(spark, sf, "scenarios")
    counts = scored(cells, scenarios).groupBy("rain", "risk_class").agg(F.count("*").alias("n"))
    every = scenarios.select("rain", F.explode(F.array(*map(F.lit, contracts.CLASSES))).alias("risk_class"))
    full = every.join(counts, ["rain", "risk_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = full.groupBy("rain").agg(F.sum("n").alias("t"))
    return full.join(totals, "rain").select("rain", "risk_class", "n", _r(100.0 * F.col("n") / F.col("t"), 4).alias("pct"))


@query(_SCORED + "SELECT rain, k, risk_score FROM named QUALIFY row_number() OVER (PARTITION BY rain ORDER BY risk_score DESC, k) <= 5", "cells", "scenarios")
def top_risk_cells(spark, sf):
    s = scored(derived(spark, sf, "cells"), derived(spark, sf, "scenarios")).withColumn("risk_score", _r(F.col("risk_score").cast("double"), 4))
    # Spark limits each group in every task before the rows are shuffled.
    rank = F.row_number().over(Window.partitionBy("rain").orderBy(F.desc("risk_score"), "k"))
    return s.select("rain", "k", "risk_score").withColumn("rank", rank).filter("rank <= 5").drop("rank")


@query(_SCORED + "SELECT rain, count(*) AS n, min(risk_score) AS least, round(avg(risk_score), 6) AS mean, max(risk_score) AS greatest FROM named GROUP BY rain", "cells", "scenarios")
def scenario_summary(spark, sf):
    s = scored(derived(spark, sf, "cells"), derived(spark, sf, "scenarios")).withColumn("risk_score", _r(F.col("risk_score").cast("double"), 4))
    return metrics.summary(s, ["rain"], "risk_score").withColumn("mean", _r(F.col("mean")))


@query("WITH h AS (SELECT max(r) + 1 AS n FROM cells) SELECT r * 50 + c + 1 AS cell_id, round(80e0 + c * (0.04e0 / 50), 6) AS x0, round(13.03e0 - r * (0.03e0 / n) - 0.03e0 / n, 6) AS y0, round(80e0 + (c + 1) * (0.04e0 / 50), 6) AS x1, round(13.03e0 - r * (0.03e0 / n), 6) AS y1, 5 AS n_points FROM cells CROSS JOIN h", "cells")
def cell_polygons(spark, sf):
    cells = derived(spark, sf, "cells")
    height = cells.agg(F.max("r") + 1).first()[0]
    ring = grid.cell_polygon(F.col("r"), F.col("c"), WIDTH, height, 80.0, 13.0, 80.04, 13.03)
    return cells.select(grid.cell_id(F.col("r"), F.col("c"), WIDTH).alias("cell_id"), ring.alias("g")).select("cell_id", _r(F.col("g")[0]["x"]).alias("x0"), _r(F.col("g")[0]["y"]).alias("y0"), _r(F.col("g")[2]["x"]).alias("x1"), _r(F.col("g")[2]["y"]).alias("y1"), F.size("g").alias("n_points"))


_DIRECTION = """WITH around(o, dr, dc, m) AS (VALUES (0, -1, 0, 1e0), (1, 1, 0, 1e0), (2, 0, -1, 1e0), (3, 0, 1, 1e0), (4, -1, -1, 1.41421356e0), (5, -1, 1, 1.41421356e0), (6, 1, -1, 1.41421356e0), (7, 1, 1, 1.41421356e0)),
drops AS (SELECT a.r, a.c, a.k, b.k AS next, o, CAST((CAST(a.elevation AS FLOAT) - CAST(b.elevation AS FLOAT)) / CAST(m * 30.83e0 AS FLOAT) AS DOUBLE) AS slope
  FROM cells a CROSS JOIN around JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc),
best AS (SELECT * FROM drops WHERE slope > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY slope DESC, o) = 1) """


def _down(spark, sf) -> DataFrame:
    d = grid.flow_direction(derived(spark, sf, "cells"))
    return d.select((F.col("r") * WIDTH + F.col("c")).alias("node"), (F.col("down_r") * WIDTH + F.col("down_c")).alias("next"))


@query(_DIRECTION + "SELECT a.k AS node, best.next FROM cells a LEFT JOIN best ON a.k = best.k", "cells")
def d8_direction(spark, sf):
    return _down(spark, sf)


@query(_DIRECTION + ", up(node, root) AS (SELECT k, k FROM cells UNION ALL SELECT best.next, up.root FROM up JOIN best ON best.k = up.node) SELECT node, count(*) AS acc, round(count(*) * 30.83e0 * 30.83e0, 2) AS catchment_m2 FROM up GROUP BY node", "cells", recursive=True)
def flow_accumulation(spark, sf):
    acc = grid.flow_accumulation(_down(spark, sf))
    return acc.select("node", "acc", _r(F.col("acc") * hydro.PIXEL_M * hydro.PIXEL_M, 2).alias("catchment_m2"))


@query("""WITH p AS (SELECT line_id, pos, 80e0 + x / 1000000e0 AS x, 13e0 + y / 1000000e0 AS y FROM vertices),
s AS (SELECT *, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM p WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
d AS (SELECT *, sqrt(pow(qx * 111000e0 * 0.97e0 - x * 111000e0 * 0.97e0, 2) + pow(qy * 111000e0 - y * 111000e0, 2)) AS d FROM s)
SELECT line_id, CAST(sum(CASE WHEN d > 10 THEN ceil(d / 10) WHEN d IS NOT NULL THEN 1 ELSE 1 END) AS BIGINT) AS n_points, round(sum(d), 5) AS length_m FROM d GROUP BY line_id""", "vertices")
def densify_lines(spark, sf):
    near = lines(spark, sf).withColumn("line", F.transform("line", lambda p: geo.point(80 + p["x"] / 1000000, 13 + p["y"] / 1000000)))
    dense = near.select("line_id", "line", geo.densified(F.col("line")).alias("dense"))
    metres = F.transform("line", lambda p: geo.point(p["x"] * geo.METRES_PER_DEGREE * geo.DENSIFY_COSINE, p["y"] * geo.METRES_PER_DEGREE))
    return dense.select("line_id", F.size("dense").cast("long").alias("n_points"), F.when(F.size("line") > 1, _r(geo.length(metres), 5)).alias("length_m"))


@query("""WITH spots AS (SELECT k, CAST(c * 200 AS DOUBLE) AS px, CAST(r * 30 AS DOUBLE) AS py FROM cells),
near AS (SELECT k, drain_id, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d, (1 / coalesce(mannings_n, 0.015e0)) * width_m * depth_m * pow(width_m * depth_m / greatest(1e-4, width_m + 2 * depth_m), 2e0 / 3e0) * sqrt(slope_m_m) AS q
  FROM spots CROSS JOIN drains QUALIFY row_number() OVER (PARTITION BY k ORDER BY sqrt((px - x) * (px - x) + (py - y) * (py - y)), drain_id) = 1)
SELECT k, drain_id, round(d, 6) AS dist_m, round(CASE WHEN d <= 100 THEN q ELSE 0.05e0 END, 6) AS q_cap FROM near""", "cells", "drains")
def nearest_drain(spark, sf):
    spots = derived(spark, sf, "cells").select(F.col("k").alias("id"), (F.col("c") * 200).cast("double").alias("x"), (F.col("r") * 30).cast("double").alias("y"))
    drains = derived(spark, sf, "drains")
    found = spatial.nearest(spots, drains.select(F.col("drain_id").alias("target_id"), F.col("drain_id").alias("ord"), "x", "y"), 250.0)
    q = hydro.drain_capacity(F.col("width_m"), F.col("depth_m"), F.col("slope_m_m"), F.coalesce("mannings_n", F.lit(hydro.MANNING_DEFAULT)))
    joined = found.join(drains.select(F.col("drain_id").alias("target_id"), q.alias("q")), "target_id")
    return joined.select(F.col("id").alias("k"), F.col("target_id").alias("drain_id"), _r(F.col("d")).alias("dist_m"), _r(F.when(F.col("d") <= hydro.FAR_FROM_DRAIN_M, F.col("q")).otherwise(hydro.FALLBACK_CAPACITY)).alias("q_cap"))


def features(cells: DataFrame) -> DataFrame:
    wide = cells.withColumn("r_overload", hydro.overload_ratio(F.col("q_demand"), F.col("q_cap")))
    return wide.select("k", "r", *(F.col(c).cast("float").alias(c) for c in hydro.FEATURES), "y")


@query("SELECT k, " + ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 5) AS {c}" for c in hydro.FEATURES[:6]) + ", round(CAST(CAST(q_demand / greatest(1e-6, q_cap) AS FLOAT) AS DOUBLE), 4) AS r_overload FROM cells", "cells")
def feature_matrix(spark, sf):
    f = features(derived(spark, sf, "cells"))
    return f.select("k", *(_r(F.col(c).cast("double"), 5).alias(c) for c in hydro.FEATURES[:6]), _r(F.col("r_overload").cast("double"), 4).alias("r_overload"))


@query("SELECT CASE WHEN r < CAST(floor((SELECT max(r) + 1 FROM cells) * 0.75e0) AS BIGINT) THEN 'train' ELSE 'validation' END AS part, y, count(*) AS n FROM cells GROUP BY ALL", "cells")
def holdout_split(spark, sf):
    cells = derived(spark, sf, "cells")
    return grid.holdout(cells, cells.agg(F.max("r") + 1).first()[0]).groupBy("part", "y").agg(F.count("*").alias("n"))


_CONFUSION = "WITH m AS (SELECT count(*) FILTER (y <> 1 AND score < 0.5) AS tn, count(*) FILTER (y <> 1 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 1 AND score >= 0.5) AS tp FROM labelled) SELECT tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM m"


@query(_CONFUSION, "labelled")
def confusion_metrics(spark, sf):
    c = metrics.confusion(derived(spark, sf, "labelled"))
    return c.select("tn", "fp", "fn", "tp", *(_r(F.col(x)).alias(x) for x in ("precision", "recall", "f1", "iou")))


@query("WITH r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM labelled), s AS (SELECT sum(rk) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM r) SELECT round((sr - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM s", "labelled")
def roc_auc(spark, sf):
    return metrics.roc_auc(derived(spark, sf, "labelled")).select(_r(F.col("roc_auc")).alias("roc_auc"))


@query("WITH g AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) AS n FROM labelled GROUP BY score), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM c", "labelled")
def average_precision(spark, sf):
    return metrics.average_precision(derived(spark, sf, "labelled")).select(_r(F.col("average_precision")).alias("average_precision"))


@query("SELECT y, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM cells), 4) AS pct FROM cells GROUP BY y", "cells")
def class_baseline(spark, sf):
    return metrics.share(derived(spark, sf, "cells"), ["y"], []).select("y", "n", _r(F.col("pct"), 4).alias("pct"))


@query("""WITH t AS (SELECT k, CASE WHEN k % 41 = 0 THEN 2 WHEN k % 43 = 0 THEN NULL ELSE y END AS y, CASE WHEN k % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE tpi END AS tpi, CASE WHEN k % 53 = 0 THEN NULL ELSE slope END AS slope, dist_to_drain, q_cap, q_demand FROM cells),
u AS (SELECT *, CAST(coalesce(y, 0) AS DOUBLE) AS elevation, q_demand / greatest(1e-6, q_cap) AS r_overload FROM t)
SELECT count(*) AS n_rows, count(*) FILTER (y IS NULL OR y NOT IN (0, 1)) AS bad_labels, count(*) FILTER (isnan(tpi) OR slope IS NULL) AS not_finite,
  """ + " + ".join(f"CAST(bool_and({c} = y) AS BIGINT)" for c in hydro.FEATURES) + " AS leaks FROM u", "cells")
def feature_artifact_checks(spark, sf):
    """The checks on features with faults put in: labels, values, and an elevation equal to the label."""
    k = F.col("k")
    cells = derived(spark, sf, "cells").withColumn("y", F.when(k % 41 == 0, 2).when(k % 43 == 0, None).otherwise(F.col("y")))
    cells = cells.withColumns({"tpi": F.when(k % 37 == 0, float("nan")).otherwise(F.col("tpi")), "slope": F.when(k % 53 == 0, None).otherwise(F.col("slope")), "elevation": F.coalesce(F.col("y"), F.lit(0)).cast("double")})
    return contracts.artifact_checks(features(cells))


_METRICS = """SELECT kind, count(*) FILTER (y <> 1 AND s < 0.5) AS tn, count(*) FILTER (y <> 1 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn, count(*) FILTER (y = 1 AND s >= 0.5) AS tp FROM kinds GROUP BY kind"""


@query(_SCORED + f""", kinds AS (SELECT 'raw' AS kind, y, CAST(CAST(raw_score AS FLOAT) AS DOUBLE) AS s FROM named WHERE rain = 120 UNION ALL SELECT 'adjusted', y, risk_score FROM named WHERE rain = 120),
m AS ({_METRICS}), r AS (SELECT kind, y, rank() OVER (PARTITION BY kind ORDER BY s) + (count(*) OVER (PARTITION BY kind, s) - 1) / 2 AS rk FROM kinds),
u AS (SELECT kind, sum(rk) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM r GROUP BY kind),
g AS (SELECT kind, s, count(*) FILTER (y = 1) AS p, count(*) AS n FROM kinds GROUP BY kind, s), c AS (SELECT kind, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY kind ORDER BY s DESC)),
ap AS (SELECT kind, round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM c GROUP BY kind)
SELECT kind, tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou, round((sr - p * (p + 1) / 2) / (p * n), 6) AS roc_auc, average_precision
FROM m JOIN u USING (kind) JOIN ap USING (kind)""", "cells", "scenarios")
def raw_vs_adjusted_report(spark, sf):
    s = scored(derived(spark, sf, "cells"), derived(spark, sf, "scenarios").filter("rain = 120"))
    s = s.select("y", F.col("raw_score").cast("float").alias("raw"), _r(F.col("risk_score").cast("double"), 4).alias("adjusted"))
    found = metrics.report(s, {"raw": "raw", "adjusted": "adjusted"})
    return found.select("kind", "tn", "fp", "fn", "tp", *(_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "iou", "roc_auc", "average_precision")))


_DEGREES = "80e0 + x / 100000e0 AS x0, 13e0 + y / 100000e0 AS y0, 80e0 + x / 100000e0 + 0.002e0 AS x1, 13e0 + y / 100000e0 + 0.001e0 AS y1"


@query(f"""WITH l AS (SELECT drain_id, round((1 / coalesce(mannings_n, 0.015e0)) * width_m * depth_m * pow(width_m * depth_m / greatest(1e-4, width_m + 2 * depth_m), 2e0 / 3e0) * sqrt(slope_m_m), 9) AS q, {_DEGREES} FROM drains),
n AS (SELECT *, CAST(ceil(sqrt(pow((x1 - x0) * 111000e0 * 0.97e0, 2) + pow((y1 - y0) * 111000e0, 2)) / 10) AS BIGINT) AS n FROM l),
v AS (SELECT drain_id, q, i, (x0 + (i / n) * (x1 - x0)) * 111000e0 * 0.97e0 AS x, (y0 + (i / n) * (y1 - y0)) * 111000e0 AS y FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM n)),
s AS (SELECT k, (80e0 + CAST(c AS DOUBLE) / 500e0) * 111000e0 * 0.97e0 AS px, (13e0 + CAST(r AS DOUBLE) / 3000e0) * 111000e0 AS py, q_demand FROM cells),
f AS (SELECT k, any_value(q_demand) AS qd, min(sqrt((px - x) * (px - x) + (py - y) * (py - y))) AS d, arg_min(q, struct_pack(d := sqrt((px - x) * (px - x) + (py - y) * (py - y)), a := drain_id, i := i)) AS q FROM s CROSS JOIN v GROUP BY k)
SELECT k, round(d, 4) AS dist_to_drain, round(CASE WHEN d <= 100 THEN q ELSE 0.05e0 END, 6) AS q_cap FROM f""", "cells", "drains")
def drain_features(spark, sf):
    """Drains densified, each cell's nearest vertex and its capacity."""
    q = hydro.drain_capacity(F.col("width_m"), F.col("depth_m"), F.col("slope_m_m"), F.coalesce("mannings_n", F.lit(hydro.MANNING_DEFAULT)))
    x, y = 80 + F.col("x") / 100000, 13 + F.col("y") / 100000
    drains = derived(spark, sf, "drains").select("drain_id", F.array(geo.point(x, y), geo.point(x + 0.002, y + 0.001)).alias("line"), F.round(q, 9).alias("q_cap"))
    cells = derived(spark, sf, "cells").select(F.col("k").alias("cell_id"), (80 + F.col("c").cast("double") / 500).alias("lon"), (13 + F.col("r").cast("double") / 3000).alias("lat"))
    found = flood.near_drains(cells, drains)
    return found.select(F.col("cell_id").alias("k"), F.round("dist_to_drain", 4).alias("dist_to_drain"), F.round("q_cap", 6).alias("q_cap"))


def positional_zip(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two ordered tables (pos, ...) side by side, up to the shorter one."""
    return left.join(right, "pos")


@query("WITH m AS (SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS pos FROM (SELECT DISTINCT line_id FROM vertices)), d AS (SELECT drain_id, row_number() OVER (ORDER BY drain_id) - 1 AS pos FROM drains) SELECT pos, line_id, drain_id FROM m JOIN d USING (pos)", "vertices", "drains")
def drain_positional_zip(spark, sf):
    from tidewright.sources.tables import with_position

    marks = with_position(derived(spark, sf, "vertices").select("line_id").distinct(), "line_id")
    return positional_zip(marks, with_position(derived(spark, sf, "drains").select("drain_id"), "drain_id")).select("pos", "line_id", "drain_id")


_CLIP = """WITH segs AS (SELECT line_id, x AS px, y AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
lens AS (SELECT line_id, coalesce(sum(sqrt(pow(qx - px, 2) + pow(qy - py, 2))), 0e0) AS len FROM segs GROUP BY line_id),
met AS (SELECT s.*, z.*, qx - px AS dx, qy - py AS dy FROM segs s JOIN zones z ON least(px, qx) <= x1 AND x0 <= greatest(px, qx) AND least(py, qy) <= y1 AND y0 <= greatest(py, qy)),
spans AS (SELECT *, CASE WHEN dx <> 0 THEN least((x0 - px) / dx, (x1 - px) / dx) WHEN px > x0 AND px < x1 THEN 0e0 WHEN px = x0 THEN 0e0 ELSE 2e0 END AS t0x, CASE WHEN dx <> 0 THEN greatest((x0 - px) / dx, (x1 - px) / dx) ELSE 1e0 END AS t1x,
  CASE WHEN dy <> 0 THEN least((y0 - py) / dy, (y1 - py) / dy) WHEN py >= y0 AND py < y1 THEN 0e0 ELSE 2e0 END AS t0y, CASE WHEN dy <> 0 THEN greatest((y0 - py) / dy, (y1 - py) / dy) ELSE 1e0 END AS t1y FROM met),
overlap AS (SELECT line_id, zone_id, zone_ord, risk, class, sum(greatest(0e0, least(1e0, t1x, t1y) - greatest(0e0, t0x, t0y)) * sqrt(dx * dx + dy * dy)) AS overlap FROM spans GROUP BY ALL HAVING sum(greatest(0e0, least(1e0, t1x, t1y) - greatest(0e0, t0x, t0y)) * sqrt(dx * dx + dy * dy)) > 1e-9) """


def _covered(spark, sf) -> DataFrame:
    return spatial.covered(lines(spark, sf), zones(spark, sf), least=1e-9)


@query(_CLIP + "SELECT o.line_id, zone_id, round(overlap, 6) AS overlap, round(100 * round(overlap, 6) / len, 7) AS overlap_pct, risk FROM overlap o JOIN lens USING (line_id) QUALIFY row_number() OVER (PARTITION BY o.line_id ORDER BY round(overlap, 6) DESC, zone_ord) = 1", "vertices", "zones")
def road_zone_overlap_argmax(spark, sf):
    best = _covered(spark, sf).filter("best IS NOT NULL")
    pct = 100 * F.col("best.overlap") / F.col("len")
    return best.select("line_id", "best.zone_id", "best.overlap", _r(pct, 7).alias("overlap_pct"), "best.risk")


@query(_CLIP + ", t AS (SELECT line_id, sum(overlap) AS total FROM overlap GROUP BY line_id), worst AS (SELECT line_id, risk, class, zone_id FROM overlap WHERE risk > 0 QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY risk DESC, zone_ord) = 1) SELECT l.line_id, round(CASE WHEN total > 0 THEN least(total, len) ELSE 0e0 END, 6) AS flooded_length_m, round(CASE WHEN total > 0 THEN least(total, len) / len ELSE 0e0 END, 8) AS flood_exposure_ratio, coalesce(risk, 0e0) AS flood_risk_score, coalesce(class, 'SAFE') AS risk_class, coalesce(CAST(zone_id AS VARCHAR), 'NONE') AS flood_zone_id, CASE WHEN total > 0 THEN 1 ELSE 0 END AS flooded FROM lens l LEFT JOIN t ON t.line_id = l.line_id LEFT JOIN worst w ON w.line_id = l.line_id", "vertices", "zones")
def road_zone_exposure(spark, sf):
    return spatial.cover_report(_covered(spark, sf).withColumn("worst", F.col("worst").withField("zone_id", F.col("worst.zone_id").cast("string")))).withColumns({"flooded_length_m": _r(F.col("flooded_length_m")), "flood_exposure_ratio": _r(F.col("flood_exposure_ratio"), 8)})


@query("""WITH d AS (SELECT p.id, z.zone_ord, z.risk, p.x > x0 AND p.x < x1 AND p.y > y0 AND p.y < y1 AS held, sqrt(pow(greatest(x0 - p.x, 0e0, p.x - x1), 2) + pow(greatest(y0 - p.y, 0e0, p.y - y1), 2)) AS d
  FROM places p JOIN zones z ON p.x >= x0 - 0.01e0 AND p.x <= x1 + 0.01e0 AND p.y >= y0 - 0.01e0 AND p.y <= y1 + 0.01e0),
h AS (SELECT id, max(risk) FILTER (held) AS top, arg_min(risk, d * 100000 + zone_ord / 100000e0) FILTER (NOT held) AS near_risk, min(d) FILTER (NOT held) AS near FROM d GROUP BY id)
SELECT id AS place_id, round(coalesce(top, near_risk * greatest(0e0, 1 - near / 0.01e0), 0e0), 6) AS exposure FROM places LEFT JOIN h USING (id)""", "places", "zones")
def place_flood_exposure(spark, sf):
    places = derived(spark, sf, "places").select(F.col("id").alias("place_id"), geo.point(F.col("x"), F.col("y")).alias("p"))
    return spatial.point_exposure(places, zones(spark, sf)).withColumn("exposure", _r(F.col("exposure")))


@query("SELECT id, CASE kind WHEN 'hospital' THEN 1e0 WHEN 'fire_station' THEN 0.9e0 WHEN 'shelter' THEN 0.85e0 ELSE 0.5e0 END AS criticality FROM places", "places")
def criticality_lookup(spark, sf):
    return derived(spark, sf, "places").select("id", priority.criticality(F.col("kind")).alias("criticality"))


@query("SELECT id, round((exposure - min(exposure) OVER ()) / (max(exposure) OVER () - min(exposure) OVER ()), 6) AS n_exposure FROM places", "places")
def minmax_normalise(spark, sf):
    return priority.min_max(derived(spark, sf, "places"), ["exposure"]).select("id", _r(F.col("n_exposure")).alias("n_exposure"))


_CRITERIA = """WITH base AS (SELECT *, CASE kind WHEN 'hospital' THEN 1e0 WHEN 'fire_station' THEN 0.9e0 WHEN 'shelter' THEN 0.85e0 ELSE 0.5e0 END AS criticality FROM places),
n AS (SELECT *, (exposure - min(exposure) OVER ()) / (max(exposure) OVER () - min(exposure) OVER ()) AS a, (criticality - min(criticality) OVER ()) / (max(criticality) OVER () - min(criticality) OVER ()) AS b FROM base),
s AS (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS m FROM n),
e AS (SELECT 1 + sum(CASE WHEN a > 0 THEN a / sa * ln(a / sa) ELSE 0e0 END) / ln(max(m)) AS da, 1 + sum(CASE WHEN b > 0 THEN b / sb * ln(b / sb) ELSE 0e0 END) / ln(max(m)) AS db FROM n CROSS JOIN s),
w AS (SELECT da / (da + db) AS wa, db / (da + db) AS wb FROM e),
p AS (SELECT n.*, 100 * (wa * a + wb * b) AS score FROM n CROSS JOIN w),
named AS (SELECT *, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS class FROM p) """


def _criteria(spark, sf) -> DataFrame:
    return derived(spark, sf, "places").withColumn("criticality", priority.criticality(F.col("kind")))


@query(_CRITERIA + "SELECT round(wa, 6) AS w_exposure, round(wb, 6) AS w_criticality FROM w", "places")
def entropy_weights(spark, sf):
    w = priority.entropy_weights(priority.min_max(_criteria(spark, sf), ["exposure", "criticality"]), ["n_exposure", "n_criticality"])
    return w.select(_r(F.col("w_n_exposure")).alias("w_exposure"), _r(F.col("w_n_criticality")).alias("w_criticality"))


@query(_CRITERIA + "SELECT id, round(score, 6) AS priority_score, class AS priority_class FROM named", "places")
def priority_score_class(spark, sf):
    return priority.prioritise(_criteria(spark, sf)).select("id", _r(F.col("priority_score")).alias("priority_score"), "priority_class")


@query(_CRITERIA + "SELECT id, class AS priority_class FROM named WHERE class IN ('CRITICAL', 'HIGH', 'MEDIUM')", "places")
def priority_places_filter(spark, sf):
    return priority.prioritise(_criteria(spark, sf)).filter(F.col("priority_class").isin("CRITICAL", "HIGH", "MEDIUM")).select("id", "priority_class")


_SPEED = "CASE highway WHEN 'primary' THEN 50e0 WHEN 'secondary' THEN 40e0 WHEN 'tertiary' THEN 35e0 WHEN 'residential' THEN 30e0 WHEN 'service' THEN 20e0 ELSE 30e0 END"


@query(f"SELECT road_id, round(length_m / 1000 / {_SPEED} * 60 * (1 + ratio * (CASE class WHEN 'LOW' THEN 1.5e0 WHEN 'MEDIUM' THEN 2.5e0 WHEN 'HIGH' THEN 5e0 WHEN 'VERY_HIGH' THEN 10e0 ELSE 1e0 END - 1)), 6) AS cost FROM roads", "roads")
def routing_cost(spark, sf):
    return derived(spark, sf, "roads").select("road_id", _r(graph.routing_cost(F.col("length_m"), F.col("highway"), F.col("ratio"), F.col("class"))).alias("cost"))


_SEGMENTS = """WITH s AS (SELECT line_id, pos - 1 AS seg, x, y, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
d AS (SELECT *, sqrt(pow(qx - x, 2) + pow(qy - y, 2)) AS seg_length_m FROM s WHERE qx IS NOT NULL),
segs AS (SELECT line_id, seg, printf('%.3f,%.3f', x, y) AS u, printf('%.3f,%.3f', qx, qy) AS v, seg_length_m, 10e0 * seg_length_m / sum(seg_length_m) OVER (PARTITION BY line_id) AS seg_cost FROM d WHERE seg_length_m > 0) """


def _segments(spark, sf) -> DataFrame:
    return graph.road_segments(lines(spark, sf).withColumn("cost", F.lit(10.0)))


@query(_SEGMENTS + "SELECT line_id, seg, u, v, round(seg_length_m, 6) AS seg_length_m, round(seg_cost, 6) AS seg_cost FROM segs", "vertices")
def road_segments(spark, sf):
    return _segments(spark, sf).select("line_id", F.col("seg").cast("long").alias("seg"), "u", "v", _r(F.col("seg_length_m")).alias("seg_length_m"), _r(F.col("seg_cost")).alias("seg_cost"))


@query(_SEGMENTS + "SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS parallel, max(line_id) AS line_id, round(arg_max(seg_length_m, line_id * 1000 + seg), 6) AS seg_length_m FROM segs WHERE u <> v GROUP BY ALL", "vertices")
def graph_edges_dedup(spark, sf):
    e = graph.simple_edges(_segments(spark, sf), ["line_id", "seg"], ["line_id", "seg_length_m"])
    return e.select("a", "b", "parallel", "line_id", _r(F.col("seg_length_m")).alias("seg_length_m"))


def _nodes(spark, sf) -> DataFrame:
    return derived(spark, sf, "places").select(F.col("id").alias("node"))


_COMPONENTS = """WITH both_ways AS (SELECT a, b FROM net UNION SELECT b, a FROM net),
reach(node, root) AS (SELECT id, id FROM places UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
found AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


@query(_COMPONENTS + " SELECT node, component FROM found", "net", "places", recursive=True)
def graph_components(spark, sf):
    return graph.components(_nodes(spark, sf), derived(spark, sf, "net"))


@query("SELECT base_id, team_count FROM bases ORDER BY team_count DESC, ord LIMIT 1", "bases")
def primary_base(spark, sf):
    return graph.primary_base(derived(spark, sf, "bases"))


@query("SELECT id AS place_id, drain_id AS node FROM places p CROSS JOIN drains d QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y)), drain_id) = 1", "places", "drains")
def nearest_graph_node(spark, sf):
    found = spatial.nearest(derived(spark, sf, "places").select("id", "x", "y"), derived(spark, sf, "drains").select(F.col("drain_id").alias("target_id"), F.col("drain_id").alias("ord"), "x", "y"), 500.0)
    return found.select(F.col("id").alias("place_id"), F.col("target_id").alias("node"))


# Each round keeps the best distance by one hop more; 64 rounds are more than any shortest path of ``net`` has hops at the scale of the check.
_PATHS = _COMPONENTS + """, links AS (SELECT a, b, w FROM net UNION ALL SELECT b, a, w FROM net),
walk(hops, source, node, dist) AS (SELECT 0, component, component, 0e0 FROM (SELECT DISTINCT component FROM found) AS c
UNION ALL SELECT hops + 1, source, node, min(dist) FROM (SELECT hops, source, node, dist FROM walk UNION ALL SELECT k.hops, k.source, e.b, k.dist + e.w FROM walk k JOIN links e ON e.a = k.node) AS steps WHERE hops < 64 GROUP BY hops, source, node)"""


@query(_PATHS + " SELECT source, node, dist FROM walk WHERE hops = 64", "net", "places", recursive=True)
def shortest_path(spark, sf):
    """From each component's least node to all of its nodes: as many rows as nodes."""
    edges = derived(spark, sf, "net")
    sources = graph.components(_nodes(spark, sf), edges).select(F.col("component").alias("source")).distinct()
    return graph.distances(sources, edges)


def _road_edges(spark, sf) -> DataFrame:
    """Simple edges (a, b, w) of the network of all roads, w being the routing cost of the road's share; no SQL, which has no walk that ends over it."""
    cost = graph.routing_cost(F.col("length_m"), F.col("highway"), F.col("ratio"), F.col("class"))
    roads = derived(spark, sf, "roads").select(F.col("road_id").alias("line_id"), cost.alias("cost"))
    segments = graph.road_segments(lines(spark, sf).join(roads, "line_id"))
    return graph.simple_edges(segments, ["line_id", "seg"], ["seg_cost"]).select("a", "b", F.col("seg_cost").alias("w"))


def _road_nodes(spark, sf) -> DataFrame:
    at = geo.point(F.col("x"), F.col("y"))
    return derived(spark, sf, "vertices").groupBy(graph.node_key(at).alias("node")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("line_id").alias("ord"))


@query()
def road_components(spark, sf):
    """Components of the network of all roads."""
    roads = derived(spark, sf, "roads").select(F.col("road_id").alias("line_id"))
    links = graph.joined_links(graph.road_links(lines(spark, sf).join(roads, "line_id", "left_semi")))
    edges = links.select(*(graph.node_key(geo.point(F.col(f"{e}x"), F.col(f"{e}y"))).alias(e) for e in "ab")).filter("a <> b")
    places = derived(spark, sf, "vertices").select("x", "y").distinct()  # before the text of their keys, which is far larger
    return graph.components(places.select(graph.node_key(geo.point(F.col("x"), F.col("y"))).alias("node")).distinct(), edges)


@query()
def road_shortest_path(spark, sf):
    """Costs from the road node nearest to the primary base to all nodes that roads reach."""
    bases = derived(spark, sf, "bases")
    base = bases.join(graph.primary_base(bases).select("base_id"), "base_id").select(F.col("base_id").alias("id"), "x", "y")
    near = spatial.nearest(base, _road_nodes(spark, sf).withColumnRenamed("node", "target_id"), 500.0)
    return graph.distances(near.select(F.col("target_id").alias("source")), _road_edges(spark, sf), graph.node_place)


@query(f"""WITH up AS (SELECT id AS route, (id - 1) // 25 AS q, (id - 1) % 25 AS r, unnest(range(0, 62)) AS h FROM places),
hops AS (SELECT route, 25 * (q >> (h + 1)) + r + 1 AS a, 25 * (q >> h) + r + 1 AS b FROM up WHERE (q >> h) > 0),
m AS (SELECT route, sum(length_m) AS l, sum(length_m / 1000 / (CASE coalesce(highway, 'tertiary') WHEN 'primary' THEN 50e0 WHEN 'tertiary' THEN 35e0 ELSE 20e0 END * CASE flooded WHEN 1 THEN 0.75e0 ELSE 1e0 END) * 60) AS t, sum(length_m * risk) AS lr, sum(flooded) AS f FROM hops JOIN net USING (a, b) GROUP BY route)
SELECT id AS route, round(coalesce(l, 0e0), 6) AS length_m, round(coalesce(lr / l, 0e0), 6) AS risk, round(coalesce(t, 0e0), 6) AS minutes, CAST(coalesce(f, 0) AS BIGINT) AS flooded_edges FROM places LEFT JOIN m ON m.route = id""", "net", "places")
def path_metrics(spark, sf):
    """Of the routes from the first place of a network to each of its places, by halving."""
    q = F.floor((F.col("node") - 1) / 25)
    halves = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda h: F.call_function("shiftright", q, h) * 25 + (F.col("node") - 1) % 25 + 1))
    routes = _nodes(spark, sf).select(F.col("node").alias("route"), F.reverse(halves).alias("path"))
    m = graph.path_metrics(routes, derived(spark, sf, "net"))
    return m.select("route", *(_r(F.col(c)).alias(c) for c in ("length_m", "risk", "minutes")), "flooded_edges")


_GROUPS = """WITH near AS (SELECT p.id AS a, q.id AS b FROM places p JOIN places q ON abs(p.gx - q.gx) <= 2500 AND p.id <> q.id AND sqrt((p.gx - q.gx) * (p.gx - q.gx) + (p.gy - q.gy) * (p.gy - q.gy)) <= 2500),
reach(node, root) AS (SELECT id, id FROM places UNION SELECT e.b, r.root FROM reach r JOIN near e ON e.a = r.node),
grouped AS (SELECT node AS id, min(root) AS grp FROM reach GROUP BY node) """


def _groups(spark, sf) -> DataFrame:
    return priority.groups(derived(spark, sf, "places").select("id", F.col("gx").alias("x"), F.col("gy").alias("y")))


@query(_GROUPS + "SELECT id, grp AS \"group\" FROM grouped", "places", recursive=True)
def zone_grouping(spark, sf):
    return _groups(spark, sf)


_SUMMARY = """, members AS (SELECT grp, p.*, CAST((id * 17) % 100 AS DOUBLE) AS score, CASE id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS class FROM grouped JOIN places p USING (id)),
base AS (SELECT grp, count(*) AS n_places, CASE min(CASE class WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END) WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority_class,
  CAST(sum(CASE WHEN class IN ('CRITICAL', 'HIGH') THEN 2 ELSE 1 END) AS BIGINT) AS teams, CASE WHEN sum(score) > 0 THEN sum(exposure * score) / sum(score) ELSE avg(exposure) END AS place_risk FROM members GROUP BY grp),
spots AS (SELECT grp, avg(gx) AS cx, avg(gy) AS cy FROM (SELECT DISTINCT grp, gx, gy FROM members) GROUP BY grp),
served AS (SELECT grp, avg(CAST(id % 10 AS DOUBLE) / 10e0) AS route_risk FROM members WHERE id % 5 = 0 GROUP BY grp) """


def _members(spark, sf) -> DataFrame:
    p = derived(spark, sf, "places").select("id", F.col("gx").alias("x"), F.col("gy").alias("y"), "exposure", ((F.col("id") * 17) % 100).cast("double").alias("priority_score"), F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), (F.col("id") % 4 + 1).cast("int")).alias("priority_class"))
    return p.join(_groups(spark, sf), "id")


def _routes(spark, sf) -> DataFrame:
    return _nodes(spark, sf).filter("node % 5 = 0").select(F.col("node").alias("to_id"), ((F.col("node") % 10).cast("double") / 10).alias("risk"))


@query(_GROUPS + _SUMMARY + "SELECT b.grp AS \"group\", n_places, priority_class, teams, round(cx, 4) AS cx, round(cy, 4) AS cy, round(place_risk, 6) AS place_risk, round(coalesce(route_risk, 0e0), 6) AS route_risk, round(0.6e0 * place_risk + 0.4e0 * coalesce(route_risk, 0e0), 6) AS zone_risk FROM base b JOIN spots USING (grp) LEFT JOIN served USING (grp)", "places", recursive=True)
def zone_summary(spark, sf):
    s = priority.group_summary(_members(spark, sf), _routes(spark, sf))
    return s.select("group", "n_places", "priority_class", "teams", _r(F.col("cx"), 4).alias("cx"), _r(F.col("cy"), 4).alias("cy"), *(_r(F.col(c)).alias(c) for c in ("place_risk", "route_risk", "zone_risk")))


@query(_GROUPS + _SUMMARY + ", serving AS (SELECT DISTINCT grp, base_id FROM members m JOIN bases ON base_id = id % 50 + 1 WHERE id % 5 = 0), cand AS (SELECT grp, base_id FROM serving UNION ALL SELECT s.grp, base_id FROM spots s CROSS JOIN bases WHERE NOT EXISTS (SELECT 1 FROM serving v WHERE v.grp = s.grp)) SELECT c.grp AS \"group\", c.base_id FROM cand c JOIN spots s ON s.grp = c.grp JOIN bases b ON b.base_id = c.base_id QUALIFY row_number() OVER (PARTITION BY c.grp ORDER BY sqrt((b.x - cx) * (b.x - cx) + (b.y - cy) * (b.y - cy)), ord) = 1", "places", "bases", recursive=True)
def zone_nearest_base(spark, sf):
    members = _members(spark, sf)
    summary = priority.group_summary(members, _routes(spark, sf))
    serving = members.filter("id % 5 = 0").select("group", (F.col("id") % 50 + 1).alias("base_id"))
    return priority.nearest_bases(summary, derived(spark, sf, "bases"), serving)


@query("SELECT id, id % 7 AS route FROM places WHERE id IN (SELECT id FROM places WHERE exposure >= 0.01)", "places")
def serving_routes_semi(spark, sf):
    p = derived(spark, sf, "places")
    return p.select("id", (F.col("id") % 7).alias("route")).join(p.filter(F.col("exposure") >= priority.EXPOSED_FROM).select("id"), "id", "left_semi")


@query("SELECT 'road' AS entity_type, 'road_id' AS id_column, 'R' || road_id AS entity_id, 'LOCKED' AS status FROM roads UNION ALL SELECT 'place', 'place_id', 'P' || id, 'LOCKED' FROM places UNION ALL SELECT 'base', 'base_id', 'B' || base_id, 'LOCKED' FROM bases UNION ALL SELECT 'flood_zone', 'zone_id', 'F' || zone_id, 'LOCKED' FROM zones", "roads", "places", "bases", "zones")
def id_registry(spark, sf):
    tag = lambda t, c, p, n: derived(spark, sf, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias(n))
    return contracts.id_registry(tag("roads", "road_id", "R", "road_id"), tag("places", "id", "P", "place_id"), tag("bases", "base_id", "B", "base_id"), tag("zones", "zone_id", "F", "zone_id"))


@query("WITH t AS (SELECT CASE WHEN k % 97 = 0 THEN NULL WHEN k % 89 = 0 THEN 'X' || k WHEN k % 83 = 0 THEN 'C1' ELSE 'C' || k END AS id FROM cells) SELECT count(*) AS total, count(DISTINCT id) AS unique_ids, count(*) FILTER (id IS NULL) AS missing, count(*) FILTER (id IS NOT NULL AND NOT regexp_matches(id, '^C[0-9]+$')) AS bad_format, CAST(count(*) - count(DISTINCT id) - 1 AS BIGINT) AS duplicates, 'FAILED' AS status FROM t", "cells")
def id_validation(spark, sf):
    k = F.col("k")
    odd = F.when(k % 97 == 0, None).when(k % 89 == 0, F.concat(F.lit("X"), k.cast("string"))).when(k % 83 == 0, "C1").otherwise(F.concat(F.lit("C"), k.cast("string")))
    return contracts.id_report(derived(spark, sf, "cells").select(odd.alias("id")), "id", "C")


@query("WITH t AS (SELECT k, raw_score * 1.2e0 AS s, CASE WHEN k % 7 = 0 THEN 'MEDIUM' WHEN raw_score < 0.33e0 THEN 'LOW' WHEN raw_score < 0.66e0 THEN 'MODERATE' ELSE 'HIGH' END AS class FROM cells), v AS (SELECT CASE WHEN s < 0 OR s > 1 THEN 'score outside 0 to 1' WHEN class = 'MEDIUM' THEN 'unknown class' WHEN class <> CASE WHEN round(s, 4) < 0.33e0 THEN 'LOW' WHEN round(s, 4) < 0.66e0 THEN 'MODERATE' ELSE 'HIGH' END THEN 'class does not fit score' END AS why FROM t) SELECT why, count(*) AS n FROM v WHERE why IS NOT NULL GROUP BY why", "cells")
def contract_violations(spark, sf):
    cells = derived(spark, sf, "cells")
    label = F.when(F.col("k") % 7 == 0, "MEDIUM").otherwise(F.when(F.col("raw_score") < 0.33, "LOW").when(F.col("raw_score") < 0.66, "MODERATE").otherwise("HIGH"))
    return cells.select(contracts.violation(F.col("raw_score") * 1.2, label).alias("why")).filter("why is not null").groupBy("why").agg(F.count("*").alias("n"))


@query()
def forest_scores(spark, sf):
    """Forest fitted on the northern rows, scores and classes of the southern ones."""
    cells = derived(spark, sf, "cells")
    split = grid.holdout(features(cells), cells.agg(F.max("r") + 1).first()[0])
    model = forest.fit(split.filter("part = 'train'").drop("part"))
    return forest.score(model, split.filter("part = 'validation'")).select("k", "raw_score", "risk_score", "risk_class")


@query("SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON a.id < b.id AND sqrt((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy)) <= 2500", "places")
def near_place_pairs(spark, sf):
    return spatial.within(derived(spark, sf, "places").select("id", F.col("gx").alias("x"), F.col("gy").alias("y")), priority.GROUP_REACH_M)


@query("SELECT k, CAST(floor(k / 50e0) AS BIGINT) AS r, CAST(k % 50 AS BIGINT) AS c, round(CAST(CAST(80e0 + (k % 50) * (0.3e0 / 49) AS FLOAT) AS DOUBLE), 5) AS x, round(CAST(CAST(13.2e0 - floor(k / 50e0) * (0.2e0 / 199) AS FLOAT) AS DOUBLE), 5) AS y FROM cells", "cells")
def cell_sample_points(spark, sf):
    cells = derived(spark, sf, "cells").select("k", grid.row_col(F.col("k") + 1, WIDTH).alias("at")).select("k", "at.r", "at.c")
    p = grid.sample_point(F.col("r"), F.col("c"), WIDTH, 200, 80.0, 13.0, 80.3, 13.2)
    return cells.select("k", "r", "c", _r(p["x"].cast("double"), 5).alias("x"), _r(p["y"].cast("double"), 5).alias("y"))


def _utm_sql() -> str:
    """Easting and northing of (lon, lat) in table spots, by the same series as geo.utm."""
    number = lambda v: f"{v:.17e}"
    terms = lambda f, g: " + ".join(f"{number(a)} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    e, scale = number(geo._E), number(geo._K0 * geo._RADIUS)
    return f"""WITH spots AS (SELECT id, 80e0 + x / 20000 AS lon, 13e0 + y / 20000 AS lat FROM places),
t AS (SELECT *, radians(lon - {number(geo._MERIDIAN)}) AS lam, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t FROM spots),
u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT id, round({number(geo._EASTING)} + {scale} * (eta + {terms("cos", "sinh")}), 3) AS easting, round({scale} * (xi + {terms("sin", "cosh")}), 3) AS northing, round(lon, 7) AS lon, round(lat, 7) AS lat FROM u"""


@query(_utm_sql(), "places")
def utm_round_trip(spark, sf):
    spots = derived(spark, sf, "places").select("id", geo.utm(80 + F.col("x") / 20000, 13 + F.col("y") / 20000).alias("q"))
    back = spots.select("id", "q", geo.lon_lat(F.col("q.x"), F.col("q.y")).alias("p"))
    return back.select("id", _r(F.col("q.x"), 3).alias("easting"), _r(F.col("q.y"), 3).alias("northing"), _r(F.col("p.x"), 7).alias("lon"), _r(F.col("p.y"), 7).alias("lat"))


@query("""WITH z AS (SELECT zone_id, zone_ord, risk FROM zones)
SELECT floor(zone_ord / 10e0) AS part, count(*) AS n, count(*) FILTER (risk IS NULL OR risk < 0 OR risk > 1) AS bad, CAST(4 AS BIGINT) AS corners FROM z GROUP BY 1""", "zones")
def zone_geometry_report(spark, sf):
    faults = contracts.geometry_faults(F.concat("ring", F.slice("ring", 1, 1)), closed=True)
    z = zones(spark, sf).select((F.col("zone_ord") / 10).alias("o"), "risk", faults.alias("fault"), F.size("ring").alias("n"))
    bad = F.count_if(F.col("fault").isNotNull() | F.col("risk").isNull() | ~F.col("risk").between(0, 1))
    return z.groupBy(F.floor("o").cast("double").alias("part")).agg(F.count("*").alias("n"), bad.alias("bad"), F.max("n").cast("long").alias("corners"))
