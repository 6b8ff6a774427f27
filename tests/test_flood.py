"""Hydrology, grid, contracts and metrics on small cases; the vector pipeline on the fixture layers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import geo, hydro
from tidewright.operators import contracts, forest, graph, grid, metrics, priority, spatial
from tidewright.plans import registry, vector
from tidewright.sources import geojson, tables, xml
from tidewright.streaming import rainfall


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_hydrology(spark):
    assert one(spark, hydro.rational_runoff(F.lit(80.0), F.lit(3600.0))) == pytest.approx(0.75 * (80 / 3.6e6) * 3600, rel=1e-9)
    assert one(spark, hydro.rational_runoff(F.lit(float("nan")), F.lit(2500.0))) == 0
    assert one(spark, hydro.overload_ratio(F.lit(0.5), F.lit(0.25))) == 2.0
    assert 1000 < one(spark, hydro.overload_ratio(F.lit(0.5), F.lit(0.0))) < math.inf
    assert one(spark, hydro.manning_capacity(F.lit(float("nan")), F.lit(1.0), F.lit(0.01))) == 0
    q = lambda *a: one(spark, hydro.manning_capacity(*map(F.lit, a)))
    assert q(1.0, 1.0, 0.01, 0.015) < q(2.0, 1.0, 0.01, 0.015) and q(1.0, 1.0, 0.01, 0.03) < q(1.0, 1.0, 0.01, 0.015) < q(1.0, 1.0, 0.02, 0.015)
    with pytest.raises(ValueError):
        hydro.rainfall_intensity(F.lit(1.0), 0)
    boost = [one(spark, hydro.boosted(F.lit(0.4), F.lit(r))) for r in (0.5, 1.5, 4.0, 100.0)]
    assert boost[0] == pytest.approx(0.4) and boost[0] < boost[1] <= boost[2] <= boost[3] <= 0.5501
    assert [one(spark, hydro.risk_class(F.lit(x).cast("float"))) for x in (0.10, 0.32, 0.33, 0.50, 0.65, 0.66, 0.90)] == ["LOW", "LOW", "MODERATE", "MODERATE", "MODERATE", "HIGH", "HIGH"]
    assert one(spark, hydro.py_round(F.lit(2.675), 2)) == 2.67
    assert [one(spark, hydro.rescaled_demand(F.lit(0.2).cast("float"), F.lit(r))) for r in (50.0, 120.0)] == pytest.approx([0.125, 0.3])


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.01, 0.02), (float("nan"), 1.0, 0.01, None)], "width_m double, depth_m double, slope_m_m double, mannings_n double")
    rows, stats = registry.stressed(df, 80.0)
    assert stats.first().asDict() == {"n_drains": 2, "imputed_width_m": 1, "imputed_depth_m": 0, "imputed_slope_m_m": 0, "imputed_mannings_n": 1}
    assert {"q_cap", "q_demand", "r_overload"} <= set(rows.columns)


def accumulation(spark, z):
    cells = spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], "r long, c long, elevation double")
    w = len(z[0])
    down = grid.flow_direction(cells, 10.0).select((F.col("r") * w + F.col("c")).alias("node"), (F.col("down_r") * w + F.col("down_c")).alias("next"))
    got = {r["node"]: r["acc"] for r in grid.flow_accumulation(down).collect()}
    return [[got[r * w + c] for c in range(w)] for r in range(len(z))]


def test_flow(spark):
    assert accumulation(spark, [[50, 40, 30, 20, 10]] * 5)[2] == [1, 2, 3, 4, 5]
    assert accumulation(spark, [[10, 10, 10], [10, 2, 10], [10, 10, 10]])[1][1] == 9
    assert accumulation(spark, [[5] * 5] * 5) == [[1] * 5] * 5


def test_geometry(spark):
    p = one(spark, geo.utm(F.lit(80.2), F.lit(13.05)))
    assert (p["x"], p["y"]) == pytest.approx((413261.7622225973, 1442801.7843460927), abs=1e-5)
    back = one(spark, geo.lon_lat(F.lit(p["x"]), F.lit(p["y"])))
    assert (back["x"], back["y"]) == pytest.approx((80.2, 13.05), abs=1e-9)
    at = lambda x, y: geo.point(F.lit(float(x)), F.lit(float(y)))
    notch = F.array(at(0, 0), at(10, 0), at(10, 10), at(5, 2), at(0, 10))
    assert one(spark, geo.clipped_length(at(-5, 6), at(15, 6), notch)) == pytest.approx(5.0)
    dense = one(spark, geo.densified(F.array(at(80, 13), at(80, 13.001))))
    assert len(dense) >= 10 and (dense[0]["y"], dense[-1]["y"]) == (13.0, 13.001)


def test_contracts(spark):
    df = lambda s, c: spark.createDataFrame([(s, c, 1.0)], "risk_score double, risk_class string, rainfall_mm_hr double")
    assert contracts.validate_risk_classes(df(0.5, "MODERATE"))
    for s, c in ((1.5, "HIGH"), (float("nan"), "LOW"), (0.5, "SEVERE"), (0.5, "LOW"), (None, "LOW")):
        with pytest.raises(ValueError):
            contracts.validate_risk_classes(df(s, c))
    assert contracts.validate_feature_names(hydro.FEATURES)
    with pytest.raises(ValueError):
        contracts.validate_feature_names(hydro.FEATURES[::-1])
    meta = {"height": 3, "width": 4, "bounds": {"left": 80.0, "bottom": 13.0, "right": 80.04, "top": 13.03}}
    assert contracts.validate_grid_metadata(meta, 12)
    for broken in ({**meta, "height": 0}, {"height": 3, "width": 4}, {**meta, "bounds": {**meta["bounds"], "left": 81.0}}):
        with pytest.raises(ValueError):
            contracts.validate_grid_metadata(broken)


def test_metrics(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 9
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    assert metrics.average_precision(df).first()[0] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert metrics.roc_auc(df.filter("y = 1")).first()[0] == 0.5 and metrics.average_precision(df.filter("y = 0")).first()[0] == 0
    assert metrics.confusion(df).first()["tp"] == 2


def layers(spark):
    line = lambda *p: [{"x": x, "y": y} for x, y in p]
    shape = "array<struct<x:double,y:double>>"
    roads = [("R000001", "primary", 520.0, 0, line((80.20, 13.05), (80.22, 13.06), (80.24, 13.07))), ("R000002", "secondary", 410.0, 1, line((80.22, 13.06), (80.23, 13.08), (80.25, 13.09))), ("R000003", "tertiary", 350.0, 2, line((80.25, 13.09), (80.26, 13.11), (80.28, 13.12)))]
    box = lambda a, b, c, d: line((a, c), (b, c), (b, d), (a, d))
    zones = [("F000001", 0, 0.87, "HIGH", box(80.215, 80.245, 13.055, 13.085)), ("F000002", 1, 0.58, "MEDIUM", box(80.255, 80.28, 13.075, 13.10))]
    places = [("P000001", "hospital", 0, (80.235, 13.075)), ("P000002", "shelter", 1, (80.245, 13.085)), ("P000003", "fire_station", 2, (80.265, 13.105))]
    bases = [("B000001", 4, 0, (80.205, 13.05)), ("B000002", 3, 1, (80.275, 13.115))]
    return (
        spark.createDataFrame(roads, f"road_id string, highway_type string, road_length_m double, ord int, line {shape}"),
        spark.createDataFrame(zones, f"zone_id string, zone_ord int, risk double, class string, ring {shape}"),
        spark.createDataFrame(places, "place_id string, type string, ord int, p struct<x:double,y:double>"),
        spark.createDataFrame(bases, "base_id string, team_count int, ord int, p struct<x:double,y:double>"),
    )


def test_vector_pipeline(spark):
    out = vector.run(*layers(spark))
    assert {r["line_id"]: r["overlap_pct"] for r in out["affected_roads"].collect()} == {"R000001": 62.5, "R000002": 75.15}
    exposed = {r["line_id"]: r for r in out["exposed_roads"].collect()}
    assert exposed["R000001"]["flooded_length_m"] == pytest.approx(3042.7503432984968, rel=1e-6)
    assert (exposed["R000003"]["risk_class"], exposed["R000003"]["flooded"]) == ("SAFE", 0)
    score = {r["place_id"]: (r["priority_score"], r["priority_class"]) for r in out["priority_places"].collect()}
    assert score["P000001"] == (pytest.approx(100.0), "CRITICAL")
    assert score["P000002"] == (pytest.approx(43.054785657038565), "MEDIUM")
    assert score["P000003"] == (pytest.approx(18.981738114320493), "LOW")
    assert (out["nodes"].count(), out["edges"].count()) == (7, 6)
    got = [tuple(r)[:7] for r in out["routes"].orderBy("route").collect()]
    assert got == [("RT000001", "B000001", "P000001", 4.9, 0.87, 8.8, 2), ("RT000002", "B000001", "P000002", 7.33, 0.87, 13.7, 3)]
    lines = {r["route"]: [(round(p["x"], 6), round(p["y"], 6)) for p in r["line"]] for r in graph.route_lines(out["routes"], out["nodes"]).collect()}
    assert lines["RT000001"] == [(80.2, 13.05), (80.22, 13.06), (80.23, 13.08)]
    zone = out["response_zones"].collect()
    assert [(z["zone_id"], z["priority_class"], z["n_places"], z["teams"], z["base_id"], z["zone_risk"]) for z in zone] == [("Z000001", "CRITICAL", 2, 3, "B000001", 0.87)]
    (drawn,) = out["zone_polygons"].collect()
    assert (drawn["zone_id"], drawn["ring"], len(drawn["line"])) == ("Z000001", 0, 81)  # points of the golden ring
    assert min((p["x"], p["y"]) for p in drawn["line"]) == pytest.approx((80.21194125568498, 13.074930689247033), abs=1e-8)  # its westernmost point


def test_priority_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5)], "place_id int, exposure double, criticality double")
    assert priority.prioritise(df).first()["priority_score"] == pytest.approx(100.0)
    assert priority.min_max(df, ["exposure"]).first()["n_exposure"] == 1.0


def test_graph_kernels(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (4, 5, 1.0)], "a long, b long, w double")
    assert dict(graph.components(nodes, edges).collect()) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    reached = graph.shortest_paths(spark.createDataFrame([(0,)], "source long"), edges)
    assert {r["node"]: (r["dist"], r["pred"]) for r in reached.collect()} == {0: (0.0, None), 1: (1.0, 0), 2: (2.0, 1)}
    assert graph.paths(reached, spark.createDataFrame([(0, 2)], "source long, target long")).first()["path"] == [0, 1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "d.kml").write_text("<kml><Placemark><LineString><coordinates>80.1,13.1,0 x,y 80.2,13.2</coordinates></LineString></Placemark><Placemark><coordinates>1,2 3</coordinates></Placemark></kml>")
    assert [[(p["x"], p["y"]) for p in r["line"]] for r in xml.read_placemarks(spark, str(tmp_path / "d.kml")).orderBy("pos").collect()] == [[(80.1, 13.1), (80.2, 13.2)], [(1.0, 2.0)]]
    with pytest.raises(FileNotFoundError):
        tables.read_drains(spark, str(tmp_path / "none.csv"))
    nodes = spark.createDataFrame([("a<1", 1.0, 2.0), ("b", 3.0, 4.0)], "id string, x double, y double")
    edges = spark.createDataFrame([("a<1", "b", 5.0, 6.0)], "a string, b string, length_m double, cost double")
    xml.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = xml.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect())) and list(map(tuple, e.collect())) == list(map(tuple, edges.collect()))
    cells = spark.createDataFrame([(r * 4 + c + 1, r, c, 0.4) for r in range(3) for c in range(4)], "cell_id long, r int, c int, raw_score double")
    for name in ("elevation", "slope", "tpi", "dist_to_drain", "q_cap", "q_demand", "r_overload"):
        cells = cells.withColumn(name, F.lit(0.5))
    scored = cells.withColumn("risk_score", F.lit(0.4)).withColumn("risk_class", F.lit("MODERATE"))
    ring = grid.cell_polygon(F.col("r"), F.col("c"), 4, 3, 80.0, 13.0, 80.04, 13.03)
    geojson.write(scored.select("cell_id", geojson.cell_feature(F.lit(120.0), 4, ring).alias("f")), "f", "cell_id", str(tmp_path / "out"))
    assert geojson.validate(spark, str(tmp_path / "out"), 3, 4)
    with pytest.raises(ValueError):
        geojson.validate(spark, str(tmp_path / "out"), 5, 4)
    tables.write_document(spark, {"height": 3}, str(tmp_path / "m"))
    assert tables.read_document(spark, str(tmp_path / "m")) == {"height": 3}


def test_forest(spark):
    rows = [tuple(float((i * k) % 97) for k in (1, 3, 5, 7, 11, 13, 17)) + (int((i % 97) > 48),) for i in range(600)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in hydro.FEATURES) + ", y int")
    model = forest.fit(df, trees=10, depth=4, bins=32)
    got = metrics.roc_auc(forest.score(model, df).select("y", F.col("raw_score").alias("score"))).first()[0]
    assert got > 0.9 and set(forest.importances(model)) == set(hydro.FEATURES)
    with pytest.raises(ValueError):
        forest.fit(df.drop("tpi"))


def test_hourly(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10' AS timestamp, 10e0 AS rainfall_mm_hr UNION ALL SELECT timestamp'2024-01-01 00:50', 30e0 UNION ALL SELECT timestamp'2024-01-01 01:05', 5e0")
    assert [(r["mm_per_hour"], r["n"]) for r in rainfall.hourly_intensity(df).orderBy("start").collect()] == [(20.0, 2), (5.0, 1)]


def test_nearest(spark):
    r = random.Random(3)
    near = [(i, r.uniform(0, 900), r.uniform(0, 900)) for i in range(60)]
    far = [(100, 4e5, -3e5), (101, -7e4, 20.0), (102, 450.0, 1e6)]
    ties = [(103, 5000.0, 5000.0)]
    goals = [(i, i, r.uniform(0, 900), r.uniform(0, 900)) for i in range(40)] + [(80, 2, 5000.0, 5003.0), (81, 1, 5003.0, 5000.0), (82, 1, None, 5000.0)]
    spots = near + far + ties
    odd = [(200, None, 1.0), (201, math.nan, 1.0), (202, math.inf, 1.0)]
    points = spark.createDataFrame(spots + odd, "id long, x double, y double")
    targets = spark.createDataFrame(goals, "target_id long, ord long, x double, y double")
    want = {}
    for i, x, y in spots:
        d, _, t = min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), o, t) for t, o, a, b in goals if a is not None)
        want[i] = (t, d)
    for size in (10.0, 250.0):
        got = {row.id: (row.target_id, row.d) for row in spatial.nearest(points, targets, size).collect()}
        assert got == want
    assert want[103][0] == 81
    assert spatial.nearest(points, targets.limit(0), 250.0).collect() == []
    assert spatial.nearest(points.limit(0), targets, 250.0).collect() == []


def test_overlaps(spark):
    """Boxes by the short way, the same areas with a point amid a side and other polygons edge by edge."""
    box, other = [(0, 0), (100, 0), (100, 50), (0, 50)], [(0, 0), (60, 0), (100, 0), (100, 50), (0, 50)]
    notch = [(0, 0), (100, 0), (100, 100), (50, 20), (0, 100)]
    roads = [(1, [(-50, 25), (150, 25)]), (2, [(10, 10), (20, 10), (20, 300)]), (3, [(500, 500), (600, 600)]), (4, [(0, 60), (100, 60)]), (5, [(7, 7)]), (6, [(-20, 70), (30, -30)])]
    at = lambda ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    lines = spark.createDataFrame([(i, at(ps)) for i, ps in roads], "line_id long, line array<struct<x:double,y:double>>")
    zones = spark.createDataFrame([(f"z{i}", i, at(z), 0.5, "LOW") for i, z in enumerate((box, other, notch, [*box, box[0]]))], "zone_id string, zone_ord int, ring array<struct<x:double,y:double>>, risk double, class string")
    got = {(r.line_id, r.zone_id): r.overlap for r in spatial.overlaps(lines, zones, 40.0).collect()}
    for i, _ in roads:
        for z in ("z1", "z3"):
            assert got.get((i, "z0"), 0.0) == pytest.approx(got.get((i, z), 0.0))
    assert got[1, "z0"] == pytest.approx(100) and got[2, "z0"] == pytest.approx(50)
    assert got[4, "z2"] == pytest.approx(50) and (4, "z0") not in got
    assert {i for i, _ in got} == {1, 2, 4, 6}


def test_geometry_contracts(spark):
    at = lambda ps: None if ps is None else [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [("a", at([(0, 0), (1, 1)])), ("b", None), ("c", []), ("d", at([(0, 0)])), ("e", at([(0, math.nan), (1, 1)])), ("f", at([(0, 0), (1, 0), (1, 1), (0, 0)])), ("g", at([(0, 0), (1, 0), (1, 1), (0, 1)]))]
    df = spark.createDataFrame(rows, "id string, line array<struct<x:double,y:double>>")
    fault = lambda closed: {r.id: r.f for r in df.select("id", contracts.geometry_faults(F.col("line"), closed).alias("f")).collect()}
    assert fault(False) == {"a": None, "b": "missing", "c": "empty", "d": "short", "e": "not_finite", "f": None, "g": None}
    assert fault(True) == {"a": "short", "b": "missing", "c": "empty", "d": "short", "e": "short", "f": None, "g": "open"}
    contracts.require_geometry(df.filter("id in ('a', 'f')"), "line")
    with pytest.raises(ValueError):
        contracts.require_geometry(df, "line")
    seen = contracts.inspect(df, F.when(F.size("line") > 1, "LineString")).collect()
    assert {(r.geometry_type, r.n_rows) for r in seen} == {("LineString", 4), (None, 3)} and seen[0]["columns"] == ["id", "line"]
