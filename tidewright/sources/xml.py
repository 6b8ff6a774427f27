"""KML placemarks and GraphML through Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import hydro
from tidewright.sources.tables import require_path, with_position


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of each Placemark in order: its first coordinates element, unreadable tokens left out."""
    whole = spark.read.text(require_path(spark, path), wholetext=True)
    marks = whole.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark\b.*?</Placemark>"), 0)).alias("pos", "mark"))
    tokens = F.filter(F.split(F.trim(F.regexp_extract("mark", r"(?s)<coordinates[^>]*>(.*?)</coordinates>", 1)), r"\s+"), lambda t: t != "")
    parts = F.transform(tokens, lambda t: F.struct(F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("y")))
    good = F.filter(parts, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return marks.select("pos", good.alias("line"))


def drain_lines(spark: SparkSession, kml: str, drains: DataFrame) -> DataFrame:
    """Placemark i with drain row i, up to the shorter list: pos, line, table capacity."""
    q = hydro.drain_capacity(*(F.col(c) for c in hydro.CHANNEL_DEFAULTS))
    rows = drains.select("*", F.monotonically_increasing_id().alias("_o"))
    return read_placemarks(spark, kml).join(with_position(rows, "_o").select("pos", q.alias("q_cap")), "pos")


_GRAPHML = {"double": "double", "float": "float", "int": "int", "bigint": "long", "boolean": "boolean", "string": "string"}


def _escaped(c):
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML text of nodes (id, attributes...) and undirected edges (a, b, attributes...), an element per line; null attributes are left out."""
    keys, names = [], {}
    for kind, df, ends in (("node", nodes, ("id",)), ("edge", edges, ("a", "b"))):
        for c, t in df.dtypes:
            if c not in ends:
                names[kind, c] = f"d{len(names)}"
                keys.append(f'  <key id="{names[kind, c]}" for="{kind}" attr.name="{c}" attr.type="{_GRAPHML.get(t, "string")}" />')

    def rows(kind: str, df: DataFrame, ends: dict[str, str]) -> DataFrame:
        datum = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{names[kind, c]}">'), _escaped(F.col(c).cast("string")), F.lit("</data>")))
        marks = F.concat(*(x for c, a in ends.items() for x in (F.lit(f' {a}="'), _escaped(F.col(c).cast("string")), F.lit('"'))))
        inside = F.concat_ws("", *(datum(c) for c in df.columns if c not in ends)) if len(df.columns) > len(ends) else F.lit("")
        return df.select(F.concat(F.lit(f"    <{kind}"), marks, F.lit(">"), inside, F.lit(f"</{kind}>")).alias("value"))

    n = rows("node", nodes, {"id": "id"}).withColumn("part", F.lit(1))
    e = rows("edge", edges, {"a": "source", "b": "target"}).withColumn("part", F.lit(2))
    head = "<?xml version='1.0' encoding='utf-8'?>\n<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">\n" + "\n".join([*keys, '  <graph edgedefault="undirected">'])
    ends = nodes.sparkSession.createDataFrame([(0, head), (3, "  </graph>\n</graphml>")], "part int, value string")
    ends.unionByName(n).unionByName(e).coalesce(1).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes...) and edges (a, b, attributes...) of a GraphML file, attributes by their declared names and types."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(require_path(spark, path))
    keys = xml("key", "_id string, _for string, `_attr.name` string, `_attr.type` string").collect()  # one per attribute
    types = {v: k for k, v in _GRAPHML.items()}
    data = "data array<struct<_VALUE: string, _key: string>>"

    def attributes(kind: str):
        for k in keys:
            if k["_for"] in (kind, "all"):
                found = F.filter("data", lambda d: d["_key"] == k["_id"])  # noqa: B023
                yield F.get(found, F.lit(0))["_VALUE"].try_cast(types.get(k["_attr.type"], "string")).alias(k["_attr.name"])

    nodes = xml("node", f"_id string, {data}").select(F.col("_id").alias("id"), *attributes("node"))
    edges = xml("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("a"), F.col("_target").alias("b"), *attributes("edge"))
    return nodes, edges
