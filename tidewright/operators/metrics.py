"""Classification metrics as aggregates; curves by distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for scored (y, score): tn, fp, fn, tp, precision, recall, f1, iou; zero where undefined."""
    p, y = F.col("score") >= threshold, F.col("y") == 1
    counts = scored.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn)})


def _by_score(scored: DataFrame) -> DataFrame:
    """Counts by distinct score and the running counts from the highest score down.

    A running total over all scores needs an order: scores are few beside the
    rows, and are summed range by range first, so no task sees them all.
    """
    per = scored.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    cells = per.withColumn("cell", F.floor(F.col("score") * 1024).cast("long"))
    heads = cells.groupBy("cell").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("cell", F.coalesce(F.sum("cp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("cell").orderBy(F.desc("score"))
    return cells.join(heads, "cell").select("score", "pos", "neg", (F.sum("pos").over(inside) + F.col("bp")).alias("cum_pos"), (F.sum("neg").over(inside) + F.col("bn")).alias("cum_neg"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties by trapezoids; 0.5 with one class alone."""
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return _by_score(scored).agg(F.coalesce(area / F.nullif(pairs, F.lit(0)), F.lit(0.5)).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum of recall steps times precision over distinct scores; 0 with one class alone."""
    step = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return _by_score(scored).agg(F.when(both, step / F.nullif(F.sum("pos"), F.lit(0))).otherwise(0.0).alias("average_precision"))


def share(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Counts by ``by`` and their percentage of each ``within`` group's rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total: Column = F.sum("n").over(Window.partitionBy(*within)) if within else F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def report(scored: DataFrame, scores: dict[str, str]) -> DataFrame:
    """A row per kind of score (``scores`` maps its name to its column) with all metrics against y."""
    out = None
    for name, column in scores.items():
        one = scored.select("y", F.col(column).cast("double").alias("score"))
        row = confusion(one).crossJoin(roc_auc(one)).crossJoin(average_precision(one)).select(F.lit(name).alias("kind"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def summary(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """n, least, mean and greatest value of ``column`` in each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.avg(column).alias("mean"), F.max(column).alias("greatest"))
