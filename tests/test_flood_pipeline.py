"""Drains to features, training, prediction, its checks, and the file formats around them."""

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import hydro
from tidewright.operators import contracts, forest, grid, metrics
from tidewright.plans import flood
from tidewright.sources import arrays, geojson, tables, xml

WIDTH, HEIGHT = 12, 20
META = {"height": HEIGHT, "width": WIDTH, "bounds": {"left": 80.0, "bottom": 13.0, "right": 80.04, "top": 13.03}}
# Fixed value: the CRS of layers in degrees.
CRS84 = "urn:ogc:def:crs:OGC:1.3:CRS84"


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(WIDTH * HEIGHT):
        r, c = divmod(k, WIDTH)
        low = float(rng.normal())
        rows.append((k, r, c, 80 + c / 3000, 13 + r / 3000, 10 + low, 1.0 + c / 10, low, 950.0, int(low < -0.2)))
    return spark.createDataFrame(rows, "cell_id long, r long, c long, lon double, lat double, elevation double, slope double, tpi double, catchment_m2 double, y int").cache()


DRAINS = [(1, [(80.0, 13.0), (80.001, 13.001)], 0.2), (2, [(80.003, 13.004)], 0.4), (3, [(80.0, 13.004), (80.0, 13.0045), (80.0001, 13.0046)], 0.1)]


def drains_of(spark, rows):
    return spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in line], q) for i, line, q in rows], "drain_id long, line array<struct<x:double,y:double>>, q_cap double")


def metric(x, y):
    return x * 111000 * 0.97, y * 111000


def dense(line):
    out = [line[0]]
    for p, q in zip(line, line[1:], strict=False):
        d = math.dist(metric(*p), metric(*q))
        n = math.ceil(d / 10) if d > 10 else 1
        out += [(p[0] + k / n * (q[0] - p[0]), p[1] + k / n * (q[1] - p[1])) for k in range(1, n + 1)]
    return out


def test_drains_to_features(spark, cells):
    got = {r["cell_id"]: (r["dist_to_drain"], r["q_cap"]) for r in flood.near_drains(cells, drains_of(spark, DRAINS)).collect()}
    points = [(metric(*p), q) for _, line, q in DRAINS for p in dense(line)]
    for r in cells.collect():
        d, q = min((math.dist(metric(r["lon"], r["lat"]), p), q) for p, q in points)
        assert got[r["cell_id"]][0] == pytest.approx(d, abs=1e-6)
        assert got[r["cell_id"]][1] == (q if d <= 100 else 0.05)
    none = flood.near_drains(cells, drains_of(spark, [])).select("dist_to_drain", "q_cap").distinct().collect()
    assert [tuple(r) for r in none] == [(500.0, 0.05)]
    table = flood.feature_table(cells, drains_of(spark, DRAINS))
    row = table.filter("cell_id = 0").first()
    assert row["q_demand"] == pytest.approx(0.75 * 80 / 3_600_000 * 950, rel=1e-6)
    assert row["r_overload"] == pytest.approx(row["q_demand"] / row["q_cap"], rel=1e-6)
    assert flood.near_drains(cells.limit(0), drains_of(spark, DRAINS)).collect() == []


def test_train_predict_and_checks(spark, cells, tmp_path):
    table = flood.feature_table(cells, drains_of(spark, DRAINS)).cache()
    model, report = flood.train(table, HEIGHT, f"{tmp_path}/model", f"{tmp_path}/report", trees=8, depth=4, bins=16)
    assert tables.read_document(spark, f"{tmp_path}/report") == json.loads(json.dumps(report))
    assert report["reload_test_passed"] and all(report["physics_monotonicity_tests"].values())
    assert report["dataset"]["train_cells"] == 15 * WIDTH and report["dataset"]["validation_cells"] == 5 * WIDTH
    assert report["raw_model_metrics"]["roc_auc"] > 0.8
    held = forest.score(model, grid.holdout(table, HEIGHT).filter("part = 'validation'")).select("y", "raw_score").collect()
    tp = sum(r["y"] == 1 and r["raw_score"] >= 0.5 for r in held)
    assert report["raw_model_metrics"]["tp"] == tp
    dry, wet = flood.predict(model, table, 0.0), flood.predict(model, table, 300.0)
    assert dry.agg(F.max("r_overload")).first()[0] == 0.0
    assert wet.agg(F.sum("q_demand")).first()[0] == pytest.approx(table.agg(F.sum("q_demand")).first()[0] * 300 / 80, rel=1e-5)
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            flood.predict(model, table, bad)
    with pytest.raises(RuntimeError):
        contracts.require_finite(table.withColumn("r_overload", F.lit(float("nan"))), ["r_overload"])
    assert contracts.validate_predictions(wet, META, hydro.FEATURES)
    with pytest.raises(ValueError):
        contracts.validate_predictions(wet.limit(5), META)
    with pytest.raises(ValueError):
        contracts.validate_predictions(wet.withColumn("risk_class", F.lit("LOW")), META)

    ring = grid.cell_polygon(F.col("r"), F.col("c"), WIDTH, HEIGHT, 80.0, 13.0, 80.04, 13.03)
    made = wet.withColumn("cell_id", F.col("cell_id") + 1).withColumn("feature", geojson.cell_feature(F.lit(300.0), WIDTH, ring))
    geojson.write(made, "feature", "cell_id", f"{tmp_path}/scored.geojson")
    assert geojson.validate(spark, f"{tmp_path}/scored.geojson", HEIGHT, WIDTH)
    assert geojson.validate(spark, f"{tmp_path}/scored.geojson", HEIGHT, WIDTH, linewise=True)
    found = flood.validations(wet, META, f"{tmp_path}/scored.geojson", model, f"{tmp_path}/model")
    assert len(found) == 10 and all(found.values())
    lost = flood.validations(wet.limit(7), META, f"{tmp_path}/none.geojson", model, f"{tmp_path}/model")
    assert {k for k, v in lost.items() if not v} == {"prediction_count", "file_exists", "geojson_valid", "geojson_header", "grid_shape"}
    props = T.StructType([T.StructField("cell_id", T.LongType())])
    one, two = (f(spark, f"{tmp_path}/scored.geojson", props).orderBy("feature_ord") for f in (geojson.read, geojson.read_lines))
    drop = lambda rows: [(r["feature_ord"], r["cell_id"], r["kind"], json.loads(r["coordinates"]), r["crs"]) for r in rows.collect()]
    assert drop(one) == drop(two) and drop(two)[0][4] == CRS84


def test_runner_gates(spark, tmp_path):
    def fail():
        raise OSError("no")

    ok = flood.Stage("write", lambda: tables.write_document(spark, {"a": 1}, f"{tmp_path}/doc"), [f"{tmp_path}/doc"])
    after = flood.Stage("never", lambda: None)
    runs = flood.run_stages(spark, [ok, flood.Stage("hollow", lambda: None, [f"{tmp_path}/absent"]), after])
    assert [(r["name"], r["ok"]) for r in runs] == [("write", True), ("hollow", False)] and "absent" in runs[1]["why"]
    assert [(r["ok"], r["why"]) for r in flood.run_stages(spark, [flood.Stage("x", fail), after])] == [(False, "OSError: no")]


def test_arrays(spark, tmp_path):
    rng = np.random.default_rng(1)
    terrain = {c: rng.normal(size=(3, 4)).astype(np.float32) for c in arrays.TERRAIN}
    np.savez_compressed(tmp_path / "terrain.npz", **terrain)
    got = arrays.read_terrain(spark, f"{tmp_path}/terrain.npz").orderBy("pos").collect()
    assert [r["slope"] for r in got] == terrain["slope"].ravel().tolist()
    np.save(tmp_path / "mask.npy", np.array([[0, 1], [255, 0]], np.uint8))
    assert [r["y"] for r in arrays.read_mask(spark, f"{tmp_path}/mask.npy").orderBy("pos").collect()] == [0, 1, 1, 0]
    x = rng.normal(size=(5, 7)).astype(np.float32)
    np.savez_compressed(tmp_path / "features.npz", X=x, y=np.array([0, 1, 1, 0, 1]), feature_names=np.array(hydro.FEATURES))
    table = arrays.read_features(spark, f"{tmp_path}/features.npz")
    assert [[r[c] for c in hydro.FEATURES] for r in table.orderBy("pos").collect()] == x.tolist()
    assert arrays.write_features(table, f"{tmp_path}/features", 5) == {"rows": 5, "classes": {0: 2, 1: 3}}
    with pytest.raises(ValueError):
        arrays.write_features(table, f"{tmp_path}/features", 6)
    held = io.BytesIO()
    np.savez(held, a=np.zeros(2), b=np.zeros(3))
    (tmp_path / "odd.npz").write_bytes(held.getvalue())
    with pytest.raises(Exception, match="differ in length"):
        arrays.read_arrays(spark, f"{tmp_path}/odd.npz", {"a": "double"}).collect()


# A graph file as written by the usual graph library.
GRAPH = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d3" for="edge" attr.name="road_id" attr.type="string" />
  <key id="d2" for="edge" attr.name="length_m" attr.type="double" />
  <key id="d1" for="node" attr.name="y" attr.type="double" />
  <key id="d0" for="node" attr.name="x" attr.type="double" />
  <graph edgedefault="undirected">
    <node id="413261.762,1442801.784">
      <data key="d0">413261.7622225973</data>
      <data key="d1">1442801.7843460927</data>
    </node>
    <node id="a &amp; b" />
    <edge source="413261.762,1442801.784" target="a &amp; b">
      <data key="d2">12.5</data>
      <data key="d3">R&lt;1</data>
    </edge>
  </graph>
</graphml>
"""


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH)
    nodes, edges = xml.read_graph(spark, f"{tmp_path}/g.graphml")
    assert sorted(map(tuple, nodes.select("id", "x", "y").collect())) == [("413261.762,1442801.784", 413261.7622225973, 1442801.7843460927), ("a & b", None, None)]
    assert [tuple(r) for r in edges.select("a", "b", "length_m", "road_id").collect()] == [("413261.762,1442801.784", "a & b", 12.5, "R<1")]
    xml.write_graph(nodes, edges, f"{tmp_path}/again")
    again = xml.read_graph(spark, f"{tmp_path}/again")
    for one, two in zip((nodes, edges), again, strict=True):
        assert sorted(map(str, one.select(*sorted(one.columns)).collect())) == sorted(map(str, two.select(*sorted(one.columns)).collect()))


def test_tables_and_routes(spark, tmp_path):
    (tmp_path / "drains.csv").write_text("name,depth_m,width_m,slope_m_m\nx,0.5,2.0,0.001\ny,,1.0,bad\n")
    got = tables.read_drains(spark, f"{tmp_path}/drains.csv").collect()
    assert [tuple(r) for r in got] == [(2.0, 0.5, 0.001, 0.015), (1.0, None, None, 0.015)]
    (tmp_path / "rain.csv").write_text("rainfall_mm_hr,timestamp\n5,2020-01-01\n")
    with pytest.raises(ValueError):
        tables.read_rainfall(spark, f"{tmp_path}/rain.csv")
    assert tables.read_grid_metadata(spark, f"{tmp_path}/none.json") == {"pixel_size_m": 30.83, "height": 1568, "width": 872}
    routes = spark.createDataFrame([(2, "b", [1, 2]), (1, "a", None)], "route long, name string, path array<int>")
    tables.write_routes(routes, "route", f"{tmp_path}/routes")
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/routes", wholetext=True).collect())
    assert json.loads(text) == [{"route": 1, "name": "a", "path": None}, {"route": 2, "name": "b", "path": [1, 2]}]
    assert sorted(map(str, tables.read_routes(spark, f"{tmp_path}/routes", routes.schema).collect())) == sorted(map(str, routes.collect()))


def test_reference_systems(spark):
    assert contracts.is_geographic(CRS84) and not contracts.is_geographic("urn:ogc:def:crs:EPSG::32644")
    for bad in (None, "", "EPSG:3857"):
        with pytest.raises(ValueError):
            contracts.is_geographic(bad)
    with pytest.raises(ValueError):
        contracts.require_same_crs(CRS84, "EPSG:32644")
    line = spark.createDataFrame([([{"x": 80.2, "y": 13.05}],)], "line array<struct<x:double,y:double>>")
    assert line.select(contracts.metric_line(F.col("line"), "EPSG:32644")[0]["x"]).first()[0] == 80.2
    assert 400_000 < line.select(contracts.metric_line(F.col("line"), "EPSG:4326")[0]["x"]).first()[0] < 430_000
    assert contracts.inspect(line, F.lit("LineString"), CRS84).first()["crs"] == CRS84


def test_first_violation_and_summary(spark):
    df = spark.createDataFrame([(0.9, "LOW"), (float("nan"), "LOW"), (2.0, "HIGH")], "risk_score double, risk_class string")
    with pytest.raises(ValueError, match="3 rows: score is not finite"):
        contracts.validate_risk_classes(df)
    assert metrics.summary(df.filter("risk_score = 2"), [], "risk_score").first()["mean"] == 2.0
