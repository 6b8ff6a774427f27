"""Reliable cuts of lineage for the iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ready: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _prepare(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app not in _ready:
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-"))
        _ready.add(app)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder of spark.checkpoint.dir; a temporary one only where that is unset, in local mode."""
    _prepare(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing uses yet."""
    _prepare(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for what runs inside, whose rows are large."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, "8m")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def cut_round(df: DataFrame) -> DataFrame:
    """cut() for loops: the result also forgets its estimated size.

    Spark takes a join to be as large as the product of its sides and keeps that
    estimate over a checkpoint, so its digits would double in each round.
    """
    held, spark = cut(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)
