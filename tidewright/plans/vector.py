"""The vector pipeline: roads, zones, places and bases to routes and response zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import geo, hydro
from tidewright.functions.storage import cut
from tidewright.operators import graph, outline, priority, spatial

ROUTED = ("CRITICAL", "HIGH", "MEDIUM")


def projected(line):
    return F.transform(line, lambda p: geo.utm(p["x"], p["y"]))


def adapt_scored_cells(cells: DataFrame) -> DataFrame:
    """Optional bridge from scored cells to zones: F-ids and MODERATE as MEDIUM."""
    name = F.concat(F.lit("F"), F.lpad(F.col("cell_id").cast("string"), 6, "0"))
    return cells.withColumns({"zone_id": name, "risk_class": F.when(F.col("risk_class") == "MODERATE", "MEDIUM").otherwise(F.col("risk_class"))})


def affected_roads(roads: DataFrame, zones: DataFrame, size: float = 2000.0) -> tuple[DataFrame, DataFrame]:
    """Both overlays of lon/lat roads (road_id, highway_type, road_length_m, ord, line) and zones (zone_id, zone_ord, risk, class, ring): covered roads, and all roads with their exposure."""
    flat = roads.select(F.col("road_id").alias("line_id"), projected(F.col("line")).alias("line"))
    rings = zones.withColumn("ring", projected(F.col("ring")))
    over = cut(spatial.overlaps(flat, rings, size))
    best = spatial.largest_overlap(flat, over).withColumn("overlap_pct", hydro.py_round(F.col("overlap_pct"), 2))
    named = roads.withColumnRenamed("road_id", "line_id")
    return best.join(named.select("line_id", "highway_type", "road_length_m"), "line_id"), spatial.exposure(flat, over).join(named, "line_id")


def priorities(places: DataFrame, zones: DataFrame, size: float = 2000.0) -> DataFrame:
    """Places (place_id, type, ord, p) in lon/lat with exposure, criticality, score and class."""
    at = places.select("place_id", geo.utm(F.col("p.x"), F.col("p.y")).alias("p"))
    exposed = spatial.point_exposure(at, zones.withColumn("ring", projected(F.col("ring"))), size=size)
    wide = places.join(exposed, "place_id").join(at.withColumnRenamed("p", "q"), "place_id").withColumn("criticality", priority.criticality(F.col("type")))
    return priority.prioritise(wide)


def network(exposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y, ord) and edges (a, b, w, length_m, highway, risk, flooded) of exposed roads."""
    cost = graph.routing_cost(F.col("road_length_m"), F.col("highway_type"), F.col("flood_exposure_ratio"), F.col("risk_class"))
    flat = exposed.select("line_id", "ord", projected(F.col("line")).alias("line"), cost.alias("cost"), F.col("highway_type").alias("highway"), F.col("flood_risk_score").alias("risk"), "flooded")
    segs = cut(graph.road_segments(flat))
    edges = graph.simple_edges(segs, ["ord", "seg"], ["seg_cost", "seg_length_m", "highway", "risk", "flooded"]).withColumnsRenamed({"seg_cost": "w", "seg_length_m": "length_m"})
    points = flat.select("ord", F.posexplode("line").alias("pos", "p")).select(graph.node_key(F.col("p")).alias("node"), "p.x", "p.y", F.struct("ord", "pos").alias("o"))
    nodes = points.groupBy("node").agg(F.max_by(F.struct("x", "y"), F.col("o")).alias("xy"), F.min("o").alias("ord")).select("node", "xy.x", "xy.y", "ord")
    return nodes, edges


def routes(nodes: DataFrame, edges: DataFrame, bases: DataFrame, ranked: DataFrame, size: float = 2000.0) -> DataFrame:
    """One route from the primary base to each routed place that it reaches, in place order."""
    base = graph.primary_base(bases)
    base = bases.join(base.select("base_id"), "base_id").select(F.col("base_id").alias("id"), geo.utm(F.col("p.x"), F.col("p.y")).alias("q"))
    goals = ranked.filter(F.col("priority_class").isin(*ROUTED))
    spots = base.select("id", "q.x", "q.y").unionByName(goals.select(F.col("place_id").alias("id"), "q.x", "q.y"))
    near = cut(spatial.nearest(spots, nodes.select(F.col("node").alias("target_id"), "ord", "x", "y"), size))
    start = near.join(base.select("id"), "id").select(F.col("target_id").alias("source"))
    reached = cut(graph.shortest_paths(start, edges))
    ends = near.join(goals.select(F.col("place_id").alias("id"), F.col("ord").alias("place_ord")), "id")
    targets = ends.join(reached.select(F.col("node").alias("target_id"), "source"), "target_id").select("source", F.col("target_id").alias("target")).distinct()
    walked = graph.paths(reached, targets)
    named = walked.join(ends.select("id", "place_ord", F.col("target_id").alias("target")), "target").join(base.select(F.col("id").alias("from_id")))
    numbered = cut(graph.numbered(named, "RT", ["place_ord"], "route"))
    m = graph.path_metrics(numbered.select("route", "path"), edges)
    out = numbered.join(m, "route")
    return out.select("route", "from_id", F.col("id").alias("to_id"), hydro.py_round(F.col("length_m") / 1000, 2).alias("distance_km"), hydro.py_round(F.col("risk"), 2).alias("risk"), hydro.py_round(F.col("minutes"), 1).alias("minutes"), "flooded_edges", "path")


def zone_members(ranked: DataFrame) -> DataFrame:
    """Exposed places, each with its group."""
    exposed = ranked.filter(F.col("exposure") >= priority.EXPOSED_FROM)
    spots = exposed.select(F.col("ord").cast("long").alias("id"), "place_id", F.col("q.x").alias("x"), F.col("q.y").alias("y"), "exposure", "priority_score", "priority_class")
    return cut(spots.join(priority.groups(spots.select("id", "x", "y")), "id"))


def zone_polygons(zones: DataFrame, members: DataFrame) -> DataFrame:
    """(zone_id, ring, area, line): each zone's outline in lon/lat, ring 0 the outer one, with the area in square metres."""
    drawn = outline.outlines(members)
    return zones.select("zone_id", "group").join(drawn, "group").select("zone_id", "ring", "area", F.transform("points", lambda p: geo.lon_lat(p["x"], p["y"])).alias("line"))


def response_zones(members: DataFrame, found: DataFrame, bases: DataFrame) -> DataFrame:
    """Groups of exposed places with class, teams, nearest base, rounded risk and centroid."""
    served = found.join(members.select(F.col("place_id").alias("to_id"), "id"), "to_id")
    summary = cut(priority.group_summary(members, served.select(F.col("id").alias("to_id"), "risk")))
    flat = bases.select("base_id", "ord", geo.utm(F.col("p.x"), F.col("p.y")).alias("q")).select("base_id", "ord", "q.x", "q.y")
    serving = served.join(members.select("id", "group"), "id").select("group", F.col("from_id").alias("base_id"))
    placed = summary.join(priority.nearest_bases(summary, flat, serving), "group")
    return graph.numbered(placed, "Z", ["group"], "zone_id").select("zone_id", "priority_class", "n_places", "teams", "base_id", hydro.py_round(F.col("zone_risk"), 2).alias("zone_risk"), "cx", "cy", "group")


def run(roads: DataFrame, zones: DataFrame, places: DataFrame, bases: DataFrame) -> dict[str, DataFrame]:
    """All stages; an empty stage gives empty tables to the next."""
    affected, exposed = affected_roads(roads, zones)
    exposed = cut(exposed)
    ranked = cut(priorities(places, zones))
    nodes, edges = map(cut, network(exposed))
    found = cut(routes(nodes, edges, bases, ranked))
    members = zone_members(ranked)
    zones_found = cut(response_zones(members, found, bases))
    return {"affected_roads": affected, "exposed_roads": exposed, "priority_places": ranked, "nodes": nodes, "edges": edges, "routes": found, "response_zones": zones_found, "zone_polygons": zone_polygons(zones_found, members)}
