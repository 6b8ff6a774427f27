"""Grids, drains, roads, zones and places derived from the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50
SCENARIOS = (0, 20, 50, 80, 100, 120, 150, 200, 300, 500, 1000)

SQL = {
    "cells": """
SELECT o_orderkey AS k, CAST(floor(o_orderkey / 50e0) AS BIGINT) AS r, CAST(o_orderkey % 50 AS BIGINT) AS c,
  5e0 * floor(o_orderkey / 50e0) + CAST((o_orderkey * 7919 + o_custkey * 104729) % 23 AS DOUBLE) AS elevation,
  CAST(o_custkey % 30 AS DOUBLE) / 10e0 AS slope, CAST(o_custkey % 17 AS DOUBLE) - 8e0 AS tpi, CAST(o_custkey % 900 AS DOUBLE) AS dist_to_drain,
  0.01e0 + CAST(o_custkey % 9 AS DOUBLE) * 0.004e0 AS q_cap,
  0.75e0 * (80e0 / 3600000e0) * CAST(1 + o_orderkey % 40 AS DOUBLE) * 950.4889e0 AS q_demand,
  CAST((o_orderkey * 31 + o_custkey * 17) % 1000 AS DOUBLE) / 1000e0 AS raw_score,
  CASE WHEN (o_orderkey * 31 + o_custkey * 17) % 1000 + (o_custkey * 7) % 800 > 900 THEN 1 ELSE 0 END AS y
FROM {orders}""",
    "scenarios": "SELECT CAST(rain AS DOUBLE) AS rain FROM (VALUES " + ", ".join(f"({s})" for s in SCENARIOS) + ") AS s(rain)",
    "drains": """
SELECT s_suppkey AS drain_id, CAST(s_suppkey % 7 AS DOUBLE) * 0.5e0 AS width_m, CAST(s_suppkey % 5 AS DOUBLE) * 0.4e0 AS depth_m, CAST(s_suppkey % 11 AS DOUBLE) / 1000e0 AS slope_m_m,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 0.01e0 + CAST(s_suppkey % 4 AS DOUBLE) * 0.01e0 END AS mannings_n,
  CAST((s_suppkey * 37) % 1000 AS DOUBLE) * 10e0 AS x, CAST((s_suppkey * 91) % 1000 AS DOUBLE) * 10e0 AS y
FROM {supplier}""",
    "readings": """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 17 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value - 100e0 END AS v FROM {events}""",
    "vertices": """
SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos,
  CAST((l_orderkey % 100) * 100 + (l_partkey % 50) * 10 AS DOUBLE) AS x, 100e0 * CAST(CAST(floor(l_orderkey / 100e0) AS BIGINT) % 100 AS DOUBLE) + CAST((l_suppkey % 50) * 10 AS DOUBLE) AS y
FROM {lineitem}""",
    "zones": """
SELECT p_partkey AS zone_id, p_partkey AS zone_ord, CAST((p_partkey * 37) % 1000 AS DOUBLE) * 10e0 AS x0, CAST((p_partkey * 91) % 1000 AS DOUBLE) * 10e0 AS y0,
  CAST((p_partkey * 37) % 1000 AS DOUBLE) * 10e0 + CAST(p_size * 4 AS DOUBLE) AS x1, CAST((p_partkey * 91) % 1000 AS DOUBLE) * 10e0 + CAST(p_size * 3 AS DOUBLE) AS y1,
  CAST(p_partkey % 101 AS DOUBLE) / 100e0 AS risk, CASE WHEN p_partkey % 101 < 33 THEN 'LOW' WHEN p_partkey % 101 < 66 THEN 'MEDIUM' ELSE 'HIGH' END AS class
FROM {part}""",
    "places": """
SELECT c_custkey AS id, CAST((c_custkey * 53) % 1000 AS DOUBLE) * 10e0 AS x, CAST((c_custkey * 29) % 1000 AS DOUBLE) * 10e0 AS y,
  floor(c_custkey / 6e0) * 10000e0 + CAST((c_custkey * 37) % 6 AS DOUBLE) * 1500e0 AS gx, CAST(c_custkey % 3 AS DOUBLE) * 900e0 AS gy,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'hospital' WHEN 'BUILDING' THEN 'fire_station' WHEN 'MACHINERY' THEN 'shelter' ELSE 'school' END AS kind,
  CAST((c_custkey * 61) % 100 AS DOUBLE) / 100e0 AS exposure
FROM {customer}""",
    "bases": """
SELECT s_suppkey AS base_id, s_suppkey AS ord, s_suppkey % 7 + 1 AS team_count, CAST((s_suppkey * 613) % 3000 AS DOUBLE) * 5000e0 AS x, CAST((s_suppkey * 7) % 4 AS DOUBLE) * 600e0 AS y FROM {supplier}""",
    "roads": """
SELECT o_orderkey AS road_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'tertiary' WHEN '4' THEN 'residential' ELSE 'track' END AS highway,
  o_totalprice / 7e0 AS length_m, CAST(o_custkey % 101 AS DOUBLE) / 100e0 AS ratio,
  CASE o_orderkey % 6 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'VERY_HIGH' ELSE 'MODERATE' END AS class
FROM {orders}""",
    # 25 networks that grow with the table: in each, place q (from 0) is linked to place q / 2 and place q / 5, so there are many paths and few hops.
    "net": """
SELECT CAST(25 * floor(q / d) AS BIGINT) + r + 1 AS a, 25 * q + r + 1 AS b, CAST((1 + (q * 7919 + r * 31 + d) % 9) * d AS DOUBLE) AS w, CAST(100 + (q * 13 + r) % 400 AS DOUBLE) AS length_m,
  CASE WHEN q % 4 = 0 THEN 'primary' WHEN q % 4 = 1 THEN NULL ELSE 'service' END AS highway, CAST((q * 17 + r) % 97 AS DOUBLE) / 97e0 AS risk, CAST(CASE WHEN q % 3 = 0 THEN 1 ELSE 0 END AS INT) AS flooded
FROM (SELECT CAST(floor((c_custkey - 1) / 25e0) AS BIGINT) AS q, CAST((c_custkey - 1) % 25 AS BIGINT) AS r FROM {customer}) AS n CROSS JOIN (VALUES (2e0), (5e0)) AS links(d)
WHERE floor(q / d) < q AND (d = 2 OR floor(q / 5e0) < floor(q / 2e0))""",
    "labelled": """
SELECT l.doc_id, l.quality AS y, CAST(d.n_chars % 200 AS DOUBLE) / 199e0 AS score FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
}


def sources(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", SQL[name])))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sources(name)}
    return spark.sql(SQL[name], **tables) if tables else spark.sql(SQL[name])


def duck(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the named derivations as common table expressions."""
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', SQL[n])})" for n in names)
    joiner = "," if re.match(r"\s*WITH\b", body) else ""
    rest = re.sub(r"^\s*WITH\b", "", body)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{joiner} {rest}" if names else body


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, line): vertices in order."""
    v = derived(spark, sf_dir, "vertices")
    return v.groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = derived(spark, sf_dir, "zones")
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return z.select("zone_id", "zone_ord", "risk", "class", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")).alias("ring"))
