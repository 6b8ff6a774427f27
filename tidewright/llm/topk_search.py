"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Candidates are packed into blocks.  In a block every dimension has postings
segments, one for each quantised level of its integer component.  A query
takes segments by descending |query weight * level|, adding their impact to
accumulators, and stops only when the k-th best lower bound is above every
other candidate's upper bound; what might still belong to the answer is
rescored exactly.  Query blocks meet candidate blocks through an equi-join on
the block number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.cluster import ship, stash

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 4096
LEVELS = 16
LARGE = 1 << 20  # components from here on make a vector large
LONG = (1 << 63) - 1
CHECK_EVERY = 64


class ImpactIndex:
    """Impact-ordered postings of one block of integer vectors: an array of longs, or of Python's integers."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, levels: int = LEVELS):
        self.ids, self.matrix = ids, matrix
        reach = self.reach = int(np.abs(matrix).max(initial=0))
        self._wide: ImpactIndex | None = None
        self.step = max(1, -(-(reach + 1) // levels))
        level = np.where(matrix < 0, -1, 1) * ((np.abs(matrix) + self.step // 2) // self.step)
        #: Largest distance of a component from its level, by dimension.
        self.slack = np.abs(matrix - level * self.step).max(axis=0, initial=0)
        dims, values, self.postings = [], [], []
        for d in range(matrix.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            found, starts = np.unique(level[order, d], return_index=True)
            for v, rows in zip(found, np.split(order, starts[1:]), strict=True):
                if v:
                    dims.append(d)
                    values.append(int(v) * self.step)
                    self.postings.append(rows)
        self.dims, self.values = np.array(dims, np.int64), np.array(values, matrix.dtype)

    def fitting(self, query: np.ndarray) -> ImpactIndex:
        """This index in integers that hold all sums with ``query``."""
        most = self.reach * int(np.abs(query).max(initial=0)) * max(1, len(query))
        if self.matrix.dtype == object or most < 1 << 61:
            return self
        if self._wide is None:
            self._wide = ImpactIndex(self.ids, self.matrix.astype(object))
        return self._wide

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best, the row with id ``own`` left out."""
        n = len(self.ids)
        allowed = self.ids != own
        k = min(k, int(allowed.sum()))
        if not k:
            return np.array([], np.int64), np.array([], np.int64)
        query = query.astype(self.matrix.dtype)
        impact = query[self.dims] * self.values
        order = np.argsort(-np.abs(impact), kind="stable")
        acc = np.zeros(n, self.matrix.dtype)
        slack = int((np.abs(query) * self.slack).sum())
        left = _left_over(self.dims[order], np.abs(impact[order]), len(query))
        taken = 0
        while taken < len(order):
            for s in order[taken : taken + CHECK_EVERY]:
                if impact[s]:
                    acc[self.postings[s]] += impact[s]
            taken = min(taken + CHECK_EVERY, len(order))
            bound = slack + (int(left[taken]) if taken < len(order) else 0)
            lower = np.partition(acc[allowed], -k)[-k] - bound
            members = np.flatnonzero(allowed & (acc + bound >= lower))
            if len(members) <= max(4 * k, 64):
                break  # every other upper bound is below the k-th lower bound
        bound = slack + (int(left[taken]) if taken < len(order) else 0)
        lower = np.partition(acc[allowed], -k)[-k] - bound
        members = np.flatnonzero(allowed & (acc + bound >= lower))
        exact = self.matrix[members] @ query
        best = np.lexsort((self.ids[members], -exact))[:k]
        return members[best], exact[best]


def _left_over(dims: np.ndarray, impact: np.ndarray, n_dims: int) -> np.ndarray:
    """At i: a bound of what segments i, i+1, ... add to one candidate, which is in one segment of a dimension at most."""
    most = np.zeros(n_dims, impact.dtype)
    out = np.empty(len(dims), impact.dtype)
    total = 0
    for i in range(len(dims) - 1, -1, -1):
        d = dims[i]
        total += impact[i] - most[d]  # impacts rise towards the front
        most[d] = impact[i]
        out[i] = total
    return out


def whole_component(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    whole, part = divmod(float(x), 1.0)
    return int(whole) * scale + int(np.floor(part * scale))


def _unpack(blob: bytes, width: int, scale: int, large: bool) -> np.ndarray:
    if not large:
        return np.frombuffer(blob, np.int32).reshape(-1, width).astype(np.int64)
    x = np.frombuffer(blob, np.float64)
    return np.array([whole_component(v, scale) for v in x.tolist()], object).reshape(-1, width)


def order_key(score: int) -> bytes:
    """Bytes in the order of ``score``, whatever its size."""
    size = score.bit_length() // 8 + 1
    if score >= 0:
        return (0x8000 + size).to_bytes(2) + score.to_bytes(size)
    return (0x8000 - size).to_bytes(2) + (score + (1 << 8 * size)).to_bytes(size)


def _searcher(k: int, width: int, scale: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "beyond": []}
        if len(left) and len(right):
            (c,), (q,) = left.itertuples(), right.itertuples()
            index = ImpactIndex(np.frombuffer(c.ids, np.int64), _unpack(c.vectors, width, scale, c.large))
            for own, vector in zip(np.frombuffer(q.ids, np.int64).tolist(), _unpack(q.vectors, width, scale, q.large), strict=True):
                rows, scores = index.fitting(vector).search(vector, k, own)
                for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
                    out["query_id"].append(own)
                    out["vec_id"].append(int(index.ids[row]))
                    out["score"].append(max(-LONG - 1, min(LONG, score)))
                    out["beyond"].append(order_key(score) if abs(score) >= LONG else b"")
        return pd.DataFrame(out).astype({c: "int64" for c in ("query_id", "vec_id", "score")})

    return run


def _packer(width: int, scale: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        large = bool(pdf["large"].iloc[0])
        matrix = np.zeros((len(pdf), width), np.float64)
        for i, v in enumerate(pdf["v"]):
            matrix[i, : len(v)] = v
        if not large:
            matrix = np.floor(matrix * scale).astype(np.int32)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "large": [large], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [matrix.tobytes()]})

    return pack


def _packed(rows: DataFrame, block, width: int, scale: int) -> DataFrame:
    return rows.withColumn("block", block).groupBy("block", "large").applyInPandas(_packer(width, scale), "block long, large boolean, ids binary, vectors binary")


def top_k(vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with an id divisible by ``query_every``.

    Components become floor(scale * x); the score is their inner product, ties
    go to the smaller id, a query's own id is no candidate.  Vectors (or ids)
    that are null or hold a null or non-finite component take no part; any
    finite component counts exactly, ranks go by the exact scores, and ``score``
    is the nearest long where one is beyond that; a shorter vector counts as filled up with zeros.  A row that repeats an id is
    a candidate of its own, and as a query it repeats its answer only once.
    Empty tables give empty results; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("e")
    usable = x.isNotNull() & F.col("id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e")).filter(usable)
    large = F.exists("e", lambda c: F.abs(c) >= float(LARGE))
    whole = stash(rows.select("id", F.col("e").alias("v"), F.coalesce(large, F.lit(False)).alias("large")), "topk-vectors")
    n, width = whole.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width = max(width, 1)
    blocks = max(1, -(-n // ROWS_PER_BLOCK))
    # Rows that repeat an id are dealt out as well, so that no block gathers them.
    packed = _packed(whole, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)), width, scale)
    asked = whole.filter(F.col("id") % query_every == 0).dropDuplicates(["id"])
    query_blocks = max(1, -(-n // query_every // QUERIES_PER_BLOCK))
    queries = _packed(asked, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)), width, scale)
    numbers = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    kinds = F.explode(F.array(F.lit(False), F.lit(True)))
    candidates = packed.withColumnRenamed("block", "c").withColumn("cl", F.col("large")).withColumn("q", numbers(query_blocks)).withColumn("ql", kinds)
    asking = queries.withColumnRenamed("block", "q").withColumn("ql", F.col("large")).withColumn("c", numbers(blocks)).withColumn("cl", kinds)
    pair = ("c", "cl", "q", "ql")
    found = candidates.groupBy(*pair).cogroup(asking.groupBy(*pair)).applyInPandas(_searcher(k, width, scale), "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
