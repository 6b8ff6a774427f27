"""Random-forest flood scores with MLlib."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import hydro
from tidewright.functions.storage import cut, fresh_path, small_batches
from tidewright.operators import trees as grown

# Fixed values.
TREES, DEPTH, SEED = 100, 12, 42


def dealt(df: DataFrame) -> DataFrame:
    """Features and y in as many partitions as there are cores, in an order of their own, whatever the files' partitions are."""
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns).sortWithinPartitions(*df.columns)
    return spread.select(*hydro.FEATURES, "y")


def class_weights(df: DataFrame) -> list[float]:
    """Rows / (2 * rows of the class) of classes 0 and 1."""
    counts = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts or set(counts) - {0, 1}:
        raise ValueError(f"y must be 0 or 1, in one row or more: {sorted(map(str, counts))}")
    return [sum(counts.values()) / (len(counts) * counts[y]) if y in counts else 1.0 for y in (0, 1)]


def borders(df: DataFrame, bins: int) -> list[np.ndarray]:
    """Of each feature up to ``bins`` - 1 thresholds, midway between quantiles, which are all its values where these are few."""
    cols = [F.col(c).cast("double") for c in hydro.FEATURES]
    bad = F.count_if(reduce(or_, (c.isNull() | F.isnan(c) for c in cols)))
    *cut_at, missing = df.agg(*(F.percentile_approx(c, [i / (bins - 1) for i in range(bins)], 10_000) for c in cols), bad).first()
    if missing:
        raise ValueError(f"features are null or NaN in {missing} rows")
    out = []
    for v in cut_at:
        v = np.unique(np.array(v, float))
        with np.errstate(invalid="ignore"):
            mid = (v[:-1] + v[1:]) / 2
        out.append(np.where(np.isfinite(mid), mid, v[:-1]))
    return out


def fit(df: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = 128) -> PipelineModel:
    """An MLlib model whose trees are grown apart from each other, each over all rows in one task (``operators/trees``).

    Rows go to each core once, in 8 bytes; MLlib's own fit goes over them for every
    group of nodes, with an aggregate for each node of each tree from each partition.
    """
    missing = [c for c in [*hydro.FEATURES, "y"] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    spark = df.sparkSession
    weights, at = class_weights(df), borders(df, bins)
    rows = dealt(df).select(F.spark_partition_id().alias("part"), *hydro.FEATURES, "y")
    blocks = cut(rows.mapInArrow(grown.packer(at), "part int, no int, n int, rows binary"))
    starts, total = {}, 0
    for r in blocks.select("part", "no", "n").orderBy("part", "no").collect():
        starts[r["part"], r["no"]] = total
        total += r["n"]
    groups = min(trees, spark.sparkContext.defaultParallelism)
    sent = blocks.select("part", "no", "rows", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).repartitionById(groups, "g")
    tries = math.ceil(math.sqrt(len(hydro.FEATURES)))
    nodes = sent.mapInArrow(grown.grower(starts, total, trees, groups, weights, at, tries, depth, SEED), grown.NODE)
    leaf = F.col("feature") < 0
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", F.array("n0", "n1").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain", F.col("l").alias("leftChild"), F.col("r").alias("rightChild"), split.alias("split"))
    path = fresh_path(spark, "forest")
    _empty(spark, trees, depth, bins).save(path)
    with small_batches(spark):
        nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return PipelineModel([VectorAssembler(inputCols=hydro.FEATURES, outputCol="features"), RandomForestClassificationModel.load(path)])


def _empty(spark: SparkSession, trees: int, depth: int, bins: int) -> RandomForestClassificationModel:
    """A model of this size, whose saved form takes the trees."""
    two = spark.createDataFrame([(Vectors.dense([float(y)] * len(hydro.FEATURES)), float(y)) for y in (0, 1)], ["features", "y"]).coalesce(1)
    return RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt", maxBins=bins).fit(two)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds raw_score, risk_score (boosted, four places) and risk_class."""
    raw = model.transform(df).withColumn("raw_score", vector_to_array("probability")[1].cast("float")).drop("features", "rawPrediction", "probability", "prediction")
    return raw.withColumn("risk_score", hydro.rounded_score(hydro.boosted(F.col("raw_score"), F.col("r_overload")))).withColumn("risk_class", hydro.risk_class(F.col("risk_score")))


def importances(model: PipelineModel) -> dict[str, float]:
    return {k: round(float(v), 4) for k, v in zip(hydro.FEATURES, model.stages[-1].featureImportances.toArray(), strict=True)}


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def reload_matches(model: PipelineModel, path: str, df: DataFrame, rows: int = 100, rtol: float = 1e-5) -> bool:
    """Whether the saved model scores ``rows`` rows as ``model`` does, within ``rtol``."""
    sample = df.select(*hydro.FEATURES).limit(rows).toPandas()
    some = df.sparkSession.createDataFrame(sample, ", ".join(f"{c} float" for c in hydro.FEATURES)).coalesce(1) if len(sample) else df.limit(0)
    one, two = ([r["raw_score"] for r in score(m, some).select("raw_score").collect()] for m in (model, load(path)))
    return len(one) == len(two) and all(abs(a - b) <= 1e-8 + rtol * abs(b) for a, b in zip(one, two, strict=True))


def rescaled(df: DataFrame, rain: float, baseline: float = hydro.BASELINE_MM_HR) -> DataFrame:
    """Features under another rainfall: demand in proportion, overload anew, the other five as they are."""
    demand = hydro.rescaled_demand(F.col("q_demand"), F.lit(hydro.checked_rain(rain)), baseline)
    return df.withColumn("q_demand", demand).withColumn("r_overload", hydro.overload_ratio(F.col("q_demand"), F.col("q_cap")).cast("float"))
