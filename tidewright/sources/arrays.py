"""NumPy archives as tables: read by the executors from any store that Spark reads, kept as Parquet from there on."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import hydro
from tidewright.operators import contracts
from tidewright.sources.tables import require_path

ROWS_AT_ONCE = 100_000
TERRAIN = ["elevation", "slope", "tpi"]


def _columns(content: bytes, single: str | None) -> dict[str, np.ndarray]:
    """One-dimensional columns of an archive; a matrix X is split by ``feature_names``, a bare array is called ``single``."""
    held = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(held, np.ndarray):
        return {single or "value": held.ravel()}
    out = {}
    for name in held.files:
        if name == "feature_names":
            continue
        if name == "X":
            matrix = held["X"]
            names = [str(n) for n in held["feature_names"]] if "feature_names" in held.files else hydro.FEATURES
            if matrix.ndim != 2 or matrix.shape[1] != len(names):
                raise ValueError(f"X has shape {matrix.shape} for {len(names)} names")
            out |= {n: matrix[:, i] for i, n in enumerate(names)}
        else:
            out[name] = held[name].ravel()
    if len({len(v) for v in out.values()}) > 1:
        raise ValueError(f"arrays differ in length: { {k: len(v) for k, v in out.items()} }")
    return out


def read_arrays(spark: SparkSession, path: str, columns: dict[str, str], single: str | None = None) -> DataFrame:
    """(pos, columns...) of one .npz or .npy file, rows in C order from 0; ``columns`` maps names to SQL types."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                held = _columns(content, single)
                missing = [c for c in columns if c not in held]
                if missing:
                    raise ValueError(f"missing arrays: {missing}")
                n = len(next(iter(held.values())))
                for at in range(0, n, ROWS_AT_ONCE):
                    stop = min(n, at + ROWS_AT_ONCE)
                    yield pd.DataFrame({"pos": np.arange(at, stop), **{c: held[c][at:stop] for c in columns}})

    files = spark.read.format("binaryFile").load(require_path(spark, path)).select("content")
    return files.mapInPandas(rows, "pos long, " + ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def read_terrain(spark: SparkSession, path: str) -> DataFrame:
    return read_arrays(spark, path, dict.fromkeys(TERRAIN, "float"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(pos, y) of a ground-truth mask, any positive value being flooded."""
    return read_arrays(spark, path, {"y": "double"}, "y").select("pos", (F.col("y") > 0).cast("int").alias("y"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return read_arrays(spark, path, {**dict.fromkeys(hydro.FEATURES, "float"), "y": "int"})


def write_features(df: DataFrame, path: str, rows: int | None = None) -> dict:
    """Write the feature table as Parquet; its rows and rows by class. ValueError if it has not ``rows`` rows."""
    contracts.require_columns(df, [*hydro.FEATURES, "y"])
    df.write.mode("overwrite").parquet(path)
    counts = {r["y"]: r["n"] for r in df.sparkSession.read.parquet(path).groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if rows is not None and total != rows:
        raise ValueError(f"{total} rows written, {rows} expected")
    return {"rows": total, "classes": counts}
