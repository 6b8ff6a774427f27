"""Road graphs: segments, simple edges, components and shortest paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from tidewright.functions import geo
from tidewright.functions.storage import cut, cut_round
from tidewright.operators import relax, stars

# Fixed values.
SPEED_KMH = {"primary": 50.0, "secondary": 40.0, "tertiary": 35.0, "residential": 30.0, "service": 20.0}
DEFAULT_SPEED = 30.0
HAZARD = {"SAFE": 1.0, "LOW": 1.5, "MEDIUM": 2.5, "HIGH": 5.0, "VERY_HIGH": 10.0}
FLOODED_SPEED = 0.75
BLOCK_ARCS = 1 << 21  # some 100 MB in a task
JOIN_SIDES = (800.0, 6400.0, 51200.0)  # of the squares in which links are joined, one after another


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def routing_cost(length_m: Column, highway: Column, ratio: Column, risk_class: Column) -> Column:
    """Minutes along a road, stretched by its class's hazard on the covered share."""
    minutes = length_m / 1000 / lookup(highway, SPEED_KMH, DEFAULT_SPEED) * 60
    return minutes * (1 + ratio * (lookup(risk_class, HAZARD, 1.0) - 1))


def node_key(p: Column) -> Column:
    return F.format_string("%.3f,%.3f", p["x"], p["y"])


def node_place(node: Column) -> Column:
    """A node_key's number along a Z-curve over cells of 100 m."""
    at = F.split(node, ",")
    cell = lambda v: F.least(F.greatest(F.floor(v.cast("double") / 100) + (1 << 20), F.lit(0)), F.lit((1 << 21) - 1))
    spread = lambda v: F.conv(F.bin(cell(v)), 4, 10).cast("long")  # noqa: E731  binary digits read to base 4 have a zero between each two
    return spread(at[0]) + 2 * spread(at[1])


def road_segments(roads: DataFrame) -> DataFrame:
    """Segments of roads (line_id, line, cost, ...): seg, u, v, seg_length_m and the road's cost by share of length; zero lengths skipped."""
    whole = roads.withColumn("total", geo.length(F.col("line")))
    cut_up = whole.select("*", F.posexplode(geo.segments(F.col("line"))).alias("seg", "e"))
    d = geo.distance(F.col("e.p"), F.col("e.q"))
    out = cut_up.withColumn("seg_length_m", d).filter("seg_length_m > 0")
    return out.withColumns({"u": node_key(F.col("e.p")), "v": node_key(F.col("e.q")), "seg_cost": F.col("cost") * F.col("seg_length_m") / F.col("total")}).drop("e", "line", "total", "cost")


def simple_edges(segments: DataFrame, order: list[str], attributes: list[str]) -> DataFrame:
    """One undirected edge a < b for all segments u-v between two nodes: the last in ``order`` gives the attributes, the first the place."""
    o = F.struct(*order)
    ends = segments.filter("u <> v").withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    return ends.groupBy("a", "b").agg(F.max_by(F.struct(*attributes), o).alias("last"), F.min(o).alias("place"), F.count("*").alias("parallel")).select("a", "b", "place", "parallel", "last.*")


def road_links(lines: DataFrame) -> DataFrame:
    """(ax, ay, bx, by): the two ends of each segment of lines (line); zero lengths skipped."""
    ends = lines.select(F.explode(geo.segments(F.col("line"))).alias("e")).filter(geo.distance(F.col("e.p"), F.col("e.q")) > 0)
    return ends.select(F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by"))


def joined_links(links: DataFrame) -> DataFrame:
    """Few links (ax, ay, bx, by) that join the same places: those of a square meet in one task, which leaves one for each place but a component's first.

    What goes on grows with the places, not with the roads between them.
    """
    for side in JOIN_SIDES:
        links = links.repartition(F.floor(F.col("ax") / side), F.floor(F.col("ay") / side)).mapInArrow(stars.joined, "ax double, ay double, bx double, by double")
    return links


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the component's least node; labels move along edges and then jump to their label's label."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        heard = both.join(now.withColumnRenamed("node", "a").hint("merge"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        moved = now.join(heard.hint("merge"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut_round(moved.join(jump.hint("merge"), "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        now = new.select("node", "label")


def distances(sources: DataFrame, edges: DataFrame, place: Callable[[Column], Column] | None = None, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """(source, node, dist) of all nodes that a source reaches, for edges (a, b, w) with w >= 0.

    Nodes lie in blocks of about ``block_arcs`` arcs (one node's arcs stay together), in the
    order of ``place``, which gives nodes that are near to each other near numbers; without it, of a hash.
    A round lets each block that was offered shorter ways relax until nothing in it gets
    shorter, and hands what leaves it to other blocks: rounds grow with the blocks on a path, not with its hops.
    """
    key = place or F.xxhash64
    edges = cut(edges.filter("a is not null and b is not null and w is not null").select("a", "b", "w", key(F.col("a")).alias("at"), key(F.col("b")).alias("to")))
    starts = cut(sources.filter("source is not null").select("source", key(F.col("source")).alias("at")).distinct())
    n = max(1, -(-2 * edges.count() // block_arcs))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", F.col("to").alias("at"), F.col("at").alias("to")))
    borders = sorted(set(both.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    block = lambda at: F.size(F.filter(F.array(*map(F.lit, borders)), lambda e: e < F.col(at))) if borders else F.lit(0)
    rows = both.select(block("at").alias("block"), "a", block("to").alias("to"), "b", "w")
    rows = rows.unionByName(starts.select(block("at").alias("block"), F.col("source").alias("a")), allowMissingColumns=True)
    arcs = cut(rows.groupBy("block").applyInArrow(relax.packed, "block int, arcs binary"))
    kind = sources.schema["source"].dataType
    schema = StructType([StructField("block", IntegerType()), StructField("source", kind), StructField("node", kind), StructField("dist", DoubleType()), StructField("state", BinaryType())])
    now = cut(starts.select(block("at").alias("block"), "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("binary").alias("state")))
    while active := [r["block"] for r in now.filter("state is null").select("block").distinct().collect()]:
        best = now.filter("state is null").groupBy("block", "source", "node").agg(F.min("dist").alias("dist"))
        offers = best.groupBy("block").agg(F.collect_list(F.struct("source", "node", "dist")).alias("offers"))
        states = now.filter("state is not null")
        turn = F.col("block").isin(active)
        held = arcs.filter(turn).hint("merge").join(offers, "block").join(states.filter(turn).select("block", "state").hint("merge"), "block", "left")
        moved = held.select("block", "arcs", "offers", "state").mapInArrow(relax.relaxer(to_arrow_schema(schema)), schema)
        now = cut_round(moved.unionByName(states.filter(~turn)))
    reached = StructType(schema.fields[1:4])
    return arcs.hint("merge").join(now.select("block", "state"), "block").select("arcs", "state").mapInArrow(relax.lister(to_arrow_schema(reached)), reached)


def shortest_paths(sources: DataFrame, edges: DataFrame, place: Callable[[Column], Column] | None = None) -> DataFrame:
    """(source, node, dist, pred) as in ``distances``; of equal ways the smaller predecessor counts."""
    edges = cut(edges.select("a", "b", "w"))
    reached = cut(distances(sources, edges, place))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    steps = reached.select("source", F.col("node").alias("a"), F.col("dist").alias("d")).hint("merge").join(both, "a").select("source", F.col("b").alias("node"), (F.col("d") + F.col("w")).alias("dist"), F.col("a").alias("pred"))
    preds = steps.filter("node <> source").groupBy("source", "node", "dist").agg(F.min("pred").alias("pred"))
    return reached.hint("merge").join(preds, ["source", "node", "dist"], "left").select("source", "node", "dist", "pred")


def paths(reached: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, path): nodes from source to target, by walking back along predecessors; ``targets`` is (source, target)."""
    now = targets.select("source", "target", F.col("target").alias("at"), F.array("target").alias("path"))
    done = None
    while True:
        walked = cut(now.join(reached.select("source", F.col("node").alias("at"), "pred"), ["source", "at"]))
        arrived = walked.filter("pred is null").select("source", "target", "path")
        done = arrived if done is None else done.unionByName(arrived)
        now = walked.filter("pred is not null").select("source", "target", F.col("pred").alias("at"), F.concat(F.array("pred"), "path").alias("path"))
        if now.isEmpty():
            return done


def path_metrics(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, length_m, risk, minutes, flooded_edges) for routes (route, path) over edges (a, b, length_m, highway, risk, flooded); missing edges are skipped."""
    steps = routes.select("route", F.explode(F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")))).alias("e")).select("route", "e.a", "e.b")
    speed = lookup(F.coalesce("highway", F.lit("tertiary")), SPEED_KMH, DEFAULT_SPEED) * F.when(F.col("flooded") == 1, FLOODED_SPEED).otherwise(1.0)
    sums = steps.join(edges.hint("merge"), ["a", "b"]).groupBy("route").agg(  # steps are many more than their table's size tells: never broadcast
        F.sum("length_m").alias("length_m"),
        F.sum(F.col("length_m") / 1000 / speed * 60).alias("minutes"),
        F.sum(F.col("length_m") * F.col("risk")).alias("lr"),
        F.sum(F.col("flooded")).cast("long").alias("flooded_edges"),
    )
    full = routes.select("route").join(sums, "route", "left").fillna(0)
    return full.select("route", "length_m", F.when(F.col("length_m") > 0, F.col("lr") / F.col("length_m")).otherwise(0.0).alias("risk"), "minutes", "flooded_edges")


def primary_base(bases: DataFrame) -> DataFrame:
    """The base with most teams, the first at ties."""
    return bases.agg(F.max_by(F.struct("base_id", "team_count"), F.struct("team_count", -F.col("ord"))).alias("b")).select("b.*")


def route_lines(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(route, line) in lon/lat for routes (route, path) of two nodes or more; nodes are (node, x, y) in UTM."""
    steps = routes.filter(F.size("path") >= 2).select("route", F.posexplode("path").alias("pos", "node"))
    placed = steps.join(nodes.hint("merge"), "node").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("pts"))
    return placed.select("route", F.transform("pts", lambda p: geo.lon_lat(p["x"], p["y"])).alias("line"))


def numbered(df: DataFrame, prefix: str, order: list[str], name: str) -> DataFrame:
    """``prefix`` with six digits by ``order``: a report's numbering, over results that are few."""
    return df.withColumn(name, F.format_string(f"{prefix}%06d", F.row_number().over(Window.orderBy(*order))))
