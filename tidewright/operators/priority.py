"""Multi-criteria priority of places and the zones that they are grouped into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import graph, spatial

# Fixed values.
CRITICALITY = {"hospital": 1.0, "fire_station": 0.9, "shelter": 0.85}
OTHER_CRITICALITY = 0.5
CLASS_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
EXPOSED_FROM, GROUP_REACH_M = 0.01, 2500.0
PLACE_WEIGHT, ROUTE_WEIGHT = 0.6, 0.4


def criticality(kind: Column) -> Column:
    return graph.lookup(kind, CRITICALITY, OTHER_CRITICALITY)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as n_<column> between 0 and 1; a constant column is all ones.  The bounds are one row."""
    bounds = df.agg(*(f(c).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))))
    wide = df.join(F.broadcast(bounds))
    scaled = {f"n_{c}": F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0))) for c in columns}
    return wide.withColumns(scaled).drop(*(f"{p}_{c}" for c in columns for p in ("lo", "hi")))


def entropy_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row w_<column>: weights by how unevenly a criterion is spread; equal where entropy cannot tell."""
    sums = df.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in columns))
    share = lambda c: F.when(F.col(f"s_{c}") == 0, 1.0 / F.col("n")).otherwise(F.col(c) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)))
    heat = lambda c: F.sum(F.when(share(c) > 0, share(c) * F.ln(F.when(share(c) > 0, share(c)))).otherwise(0.0))
    found = df.join(F.broadcast(sums)).agg(F.max("n").alias("n"), *(heat(c).alias(f"h_{c}") for c in columns))
    spread = {f"d_{c}": F.when(F.col("n") > 1, 1 + F.col(f"h_{c}") / F.ln(F.greatest("n", F.lit(2)))).otherwise(0.0) for c in columns}
    total = sum((F.col(f"d_{c}") for c in columns[1:]), F.col(f"d_{columns[0]}"))
    weigh = {f"w_{c}": F.when((F.col("n") <= 1) | (F.abs(F.col("total")) < 1e-15), 1.0 / len(columns)).otherwise(F.col(f"d_{c}") / F.nullif(F.col("total"), F.lit(0.0))) for c in columns}
    return found.withColumns(spread).withColumn("total", total).select(*(c.alias(k) for k, c in weigh.items()))


def priority_class(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def prioritise(places: DataFrame) -> DataFrame:
    """Places (place_id, exposure, criticality, ...) with priority_score and priority_class."""
    scaled = min_max(places, ["exposure", "criticality"])
    weights = entropy_weights(scaled, ["n_exposure", "n_criticality"])
    wide = scaled.join(F.broadcast(weights))
    score = 100 * (F.col("w_n_exposure") * F.col("n_exposure") + F.col("w_n_criticality") * F.col("n_criticality"))
    return wide.withColumn("priority_score", score).withColumn("priority_class", priority_class(F.col("priority_score"))).drop("n_exposure", "n_criticality", "w_n_exposure", "w_n_criticality")


def groups(places: DataFrame, reach: float = GROUP_REACH_M) -> DataFrame:
    """(id, group): chains of places (id, x, y) at most ``reach`` apart, named by their smallest id."""
    links = spatial.within(places, reach)
    found = graph.components(places.select(F.col("id").alias("node")), links)
    return found.select(F.col("node").alias("id"), F.col("component").alias("group"))


def group_summary(members: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per group of members (group, id, x, y, exposure, priority_score, priority_class): counts, risk, class, teams and centroid; ``routes`` is (to_id, risk)."""
    rank = graph.lookup(F.col("priority_class"), CLASS_RANK, 1)
    teams = F.when(F.upper("priority_class").isin("CRITICAL", "HIGH"), 2).otherwise(1)
    weight = F.sum("priority_score")
    mean_risk = F.when(weight > 0, F.sum(F.col("exposure") * F.col("priority_score")) / F.nullif(weight, F.lit(0.0))).otherwise(F.avg("exposure"))
    base = members.groupBy("group").agg(F.count("*").alias("n_places"), F.max(rank).alias("rank"), F.greatest(F.lit(1), F.sum(teams)).cast("long").alias("teams"), mean_risk.alias("place_risk"))
    spots = members.select("group", "x", "y").distinct().groupBy("group").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    served = members.select("group", "id").join(routes, F.col("id") == F.col("to_id")).groupBy("group").agg(F.avg("risk").alias("route_risk"))
    wide = base.join(spots, "group").join(served, "group", "left").withColumn("route_risk", F.coalesce("route_risk", F.lit(0.0)))
    names = F.create_map(*[F.lit(x) for k, v in CLASS_RANK.items() for x in (v, k)])
    return wide.select("group", "n_places", F.element_at(names, F.col("rank")).alias("priority_class"), "teams", "cx", "cy", "place_risk", "route_risk", (PLACE_WEIGHT * F.col("place_risk") + ROUTE_WEIGHT * F.col("route_risk")).alias("zone_risk"))


def nearest_bases(zones: DataFrame, bases: DataFrame, serving: DataFrame) -> DataFrame:
    """(group, base_id): nearest to the centroid among the bases that serve the group, among all where none does; ``serving`` is (group, base_id)."""
    named = serving.select("group", "base_id").distinct().join(bases, "base_id")
    d = lambda: F.struct(F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))).alias("d"), "ord", "base_id")
    own = zones.select("group", "cx", "cy").join(named, "group").groupBy("group").agg(F.min(d()).alias("b")).select("group", F.col("b.base_id").alias("base_id"))
    rest = zones.join(own, "group", "left_anti").select(F.col("group").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    anywhere = spatial.nearest(rest, bases.select(F.col("base_id").alias("target_id"), "ord", "x", "y"), GROUP_REACH_M)
    return own.unionByName(anywhere.select(F.col("id").alias("group"), F.col("target_id").alias("base_id")))
