"""Mixing sources to target weights by entropy balancing.

Each source's documents get rates min(limit, exp(lambda * size / mean size)):
the rates nearest to one in relative entropy whose words meet the source's
target.  lambda solves the convex dual; its Newton iterations are grouped
aggregations over (source, size) counts, kept in a bracket.  Rates
become whole copies: cells of equal source and size carry the words they
over- or undershoot to the next smaller size, and within a cell the copies go
to the documents first in a hash order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.cluster import ship, stash

LIMIT = 3
ITERATIONS = 60
BROADCAST_SOURCES = 100_000
TOLERANCE = 1e-9
SALTS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: pd.DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> pd.DataFrame:
    """Targets for (source, source_size): shares of all words by weight, capped.

    Sources by code point, null last, weigh ``weights`` in turn.  A target stops
    at ``limit`` times its source's size and the excess goes to the others by
    weight until none is above.
    """
    order = sorted(range(len(totals)), key=lambda i: (totals["source"].iloc[i] is None, (totals["source"].iloc[i] or "")))
    out = totals.iloc[order].reset_index(drop=True)
    size, whole = out["source_size"].astype(float), float(out["source_size"].sum())
    weight = pd.Series([float(weights[i % len(weights)]) for i in range(len(out))])
    capped = pd.Series(False, index=out.index)
    target = pd.Series(0.0, index=out.index)
    while True:
        rest = whole - (size[capped] * limit).sum()
        free = weight[~capped].sum()
        target = (weight * (max(rest, 0.0) / free if free else 0.0)).where(~capped, size * limit)
        above = ~capped & (target > size * limit)
        if not above.any():
            break
        capped |= above
    out["target"] = target
    return out


def _copies(limit: int):
    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole copies of each (source, size) cell, larger sizes first; at most one row per size."""
        pdf = pdf.sort_values("size", ascending=False)
        carry, out = 0.0, []
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            want = n * rate * size + carry
            k = min(max(round(want / size), 0), limit * n) if size else n
            carry = want - k * size
            out.append(k)
        return pdf[["source", "size"]].assign(copies=out)

    return cells


def _by_source(cells: DataFrame, planned: pd.DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cells with per-source values; broadcast only while sources are few, a shuffled join otherwise."""
    rows = list(planned[["source", *columns]].itertuples(index=False, name=None))
    values = cells.sparkSession.createDataFrame(rows, ", ".join(["_s string", *(f"{c} {k}" for c, k in columns.items())]))
    if len(rows) <= BROADCAST_SOURCES:
        values = F.broadcast(values)
    return cells.join(values, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def entropy_rates(cells: DataFrame, planned: pd.DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, size, n, rate) from cells (source, size, n) and one planned row per source: source, target, mean.

    Every iteration is one grouped aggregation over all cells; what comes back
    is a row for each source, its words under the present lambda and their slope.
    """
    state = planned.assign(lam=0.0, lo=-700.0, hi=700.0).set_index("source", drop=False)
    keys = {None if pd.isna(s) else s: i for i, s in enumerate(state["source"])}
    lam, lo, hi = (state[c].to_numpy(float).copy() for c in ("lam", "lo", "hi"))
    target = state["target"].to_numpy(float)
    rate = F.least(F.lit(float(limit)), F.exp(F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.col("mean"))))
    kinds = {"lam": "double", "mean": "double"}
    for _ in range(ITERATIONS):
        tilted = _by_source(cells, state.assign(lam=lam), kinds).withColumn("words", F.col("n") * F.col("size") * rate)
        slope = F.when(rate < limit, F.col("words") * F.col("size") / F.col("mean")).otherwise(0.0)
        moving = False
        for r in tilted.groupBy("source").agg(F.sum("words").alias("have"), F.sum(slope).alias("slope")).collect():
            i = keys[r["source"]]
            if abs(r["have"] - target[i]) <= TOLERANCE * target[i] or hi[i] - lo[i] < 1e-12:
                continue
            moving = True
            if r["have"] > target[i]:
                hi[i] = lam[i]
            else:
                lo[i] = lam[i]
            step = lam[i] + (target[i] - r["have"]) / r["slope"] if r["slope"] > 0 else lo[i]
            lam[i] = step if lo[i] < step < hi[i] else (lo[i] + hi[i]) / 2
        if not moving:
            break
    return _by_source(cells, state.assign(lam=lam), kinds).select("source", "size", "n", rate.alias("rate"))


def mix_to_targets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies, taken.

    Sizes are words; null and empty texts have none and are taken once, at no
    cost.  A null source is a source of its own.  Rows that repeat an id count
    each by itself.  Ties in the hash order cannot change a rerun's result, as
    tied rows carry the same id.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sized = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    cells = stash(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n"))
    # One row per source: the capped shares need all of them together.
    planned = source_targets(totals.toPandas(), weights, limit)
    planned["mean"] = (planned["source_size"] / planned["n"]).clip(lower=1e-9)
    rates = entropy_rates(cells.filter("size > 0"), planned, limit)
    copies = rates.groupBy("source").applyInPandas(_copies(limit), "source string, size long, copies long")
    counted = (
        cells.alias("c")
        .join(copies.alias("k"), F.col("c.source").eqNullSafe(F.col("k.source")) & (F.col("c.size") == F.col("k.size")), "left")
        .select("c.source", "c.size", "c.n", F.coalesce("k.copies", "c.n").alias("cell_copies"))
    )
    plan = stash(_by_source(counted, planned, {"source_size": "long", "target": "double"}), "mix-plan")
    # Ranks within a cell: first over salts, whose counts are few, then within a salt.
    salted = sized.withColumn("h", F.xxhash64("id")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("m")).select("source", "size", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("h", "id")))
    placed = ranked.alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.size") == F.col("o.size")) & (F.col("r.salt") == F.col("o.salt")))
    per_doc = placed.select("r.id", "r.source", "r.size", (F.col("r.rank") + F.col("o.before")).alias("rank")).alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    n_copies = F.floor(F.col("cell_copies") / F.col("n")) + F.when(F.col("rank") <= F.col("cell_copies") % F.col("n"), 1).otherwise(0)
    return per_doc.select(F.col("d.id").alias(id_col), F.col("d.size").alias("size"), F.col("d.source").alias(source_col), "source_size", "target", n_copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def expand_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; ids are taken as unique."""
    mixed = mix_to_targets(docs, id_col, text_col, source_col, **options).select(F.col(id_col).alias("__tw_id"), F.col("copies").cast("int").alias("__tw_copies"))
    repeated = docs.join(mixed.groupBy("__tw_id").agg(F.max("__tw_copies").alias("__tw_copies")), F.col(id_col).eqNullSafe(F.col("__tw_id")))
    return repeated.withColumn("__tw_copy", F.explode(F.sequence(F.lit(1), F.greatest("__tw_copies", F.lit(0))))).filter("__tw_copies > 0").drop("__tw_id", "__tw_copies", "__tw_copy")
