"""Exact dedup by a Golomb-coded exchange of fingerprints.

Every sender (some input partitions, so that it has up to about
``FINGERPRINTS_PER_TASK`` rows) sorts the 64-bit fingerprints of its texts and
sends each owner (a range of the fingerprint space, of as many rows) one
Golomb-coded block.  An owner
answers every block with a bitmap of the fingerprints that another sender,
or the same one twice, also holds.  Only texts under a set bit are shuffled;
they are compared byte for byte as grouping keys, after a map-side combine that
leaves at most one copy of a text per task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import golomb
from tidewright.llm.cluster import ship, stash

FINGERPRINTS_PER_TASK = 1 << 22  # 32 MiB
LEAST_TASKS = 8


def _span(owner: int, owners: int) -> tuple[int, int]:
    """First fingerprint of an owner's range and the range's length."""
    first = -(-(owner << 64) // owners)
    return first, -(-((owner + 1) << 64) // owners) - first


def _owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    edges = np.array([_span(k, owners)[0] for k in range(1, owners)], np.uint64)
    return np.searchsorted(edges, values, side="right")


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


def _encoder(owners: int):
    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        values = _unsigned(pdf["fp"])
        order = np.argsort(values)
        values, twice = values[order], pdf["n"].to_numpy()[order] > 1
        owner, rows = _owner_of(values, owners), []
        for k in np.unique(owner):
            at = owner == k
            base, span = _span(int(k), owners)
            m = golomb.parameter(int(at.sum()), span)
            rows.append((int(pdf["pid"].iloc[0]), int(k), int(at.sum()), str(m), golomb.encode(values[at], base, m), np.packbits(twice[at]).tobytes()))
        return pd.DataFrame(rows, columns=["pid", "owner", "n", "m", "code", "twice"])

    return encode


def _answerer(owners: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        base, _ = _span(int(pdf["owner"].iloc[0]), owners)
        blocks = [golomb.decode(r.code, r.n, base, int(r.m)) for r in pdf.itertuples()]
        twice = [np.unpackbits(np.frombuffer(r.twice, np.uint8))[: r.n].astype(bool) for r in pdf.itertuples()]
        values, counts = np.unique(np.concatenate(blocks), return_counts=True)
        shared = [t | (counts[np.searchsorted(values, b)] > 1) for b, t in zip(blocks, twice, strict=True)]
        return pd.DataFrame({"pid": pdf["pid"], "owner": pdf["owner"], "bitmap": [np.packbits(s).tobytes() for s in shared]})

    return answer


def _reader(owners: int):
    def suspects(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"fp": pd.Series([], dtype="int64")})
        values = np.sort(_unsigned(left["fp"]))
        owner, found = _owner_of(values, owners), []
        for r in right.itertuples():
            mine = values[owner == r.owner]
            found.append(mine[np.unpackbits(np.frombuffer(r.bitmap, np.uint8))[: len(mine)].astype(bool)])
        kept = np.concatenate(found) if found else np.array([], np.uint64)
        return pd.DataFrame({"fp": kept.view(np.int64)})

    return suspects


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint=None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group (null counts as the empty text); its row with the
    largest id stays.  Null ids sort below all others; of rows tied on the
    largest id exactly one has ``kept``.  An empty table gives an empty result.
    Further columns of ``docs`` are not read.  ``fingerprint`` maps the text
    column to a long and is a parameter so that tests can force collisions.
    """
    spark = docs.sparkSession
    ship(spark)
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    fp = (fingerprint or F.xxhash64)(text).cast("long")
    row = F.monotonically_increasing_id()
    seen = stash(docs.select(F.col(id_col).alias("id"), fp.alias("fp"), F.unhex(F.sha2(text, 256)).alias("sha"), F.spark_partition_id().alias("pid"), row.alias("row")), "exact-fp")
    n, parts = seen.agg(F.count("*"), F.coalesce(F.max("pid") + 1, F.lit(1))).first()
    owners = max(LEAST_TASKS, -(-n // FINGERPRINTS_PER_TASK))
    sender = F.floor(F.col("pid") * F.lit(min(parts, owners)) / parts).cast("int")

    local = seen.groupBy(sender.alias("pid"), "fp").agg(F.count("*").alias("n"))
    blocks = local.groupBy("pid").applyInPandas(_encoder(owners), "pid int, owner int, n long, m string, code binary, twice binary")
    bitmaps = blocks.groupBy("owner").applyInPandas(_answerer(owners), "pid int, owner int, bitmap binary")
    found = local.select("pid", "fp").groupBy("pid").cogroup(bitmaps.groupBy("pid")).applyInPandas(_reader(owners), "fp long")
    suspects = stash(found.distinct(), "exact-suspects")

    texts = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("fp", (fingerprint or F.xxhash64)(F.col("t")).cast("long"))
    classes = (
        texts.join(suspects, "fp", "left_semi")
        .groupBy("fp", "t")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("fp", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size")
    )
    # Of rows tied on the largest id one stays, told by its number.
    top = seen.groupBy("fp", "sha").agg(F.max(F.struct("id", "row")).alias("top")).select("fp", "sha", F.col("top.row").alias("top"))
    classes = stash(classes.join(top, ["fp", "sha"]), "exact-classes")
    joined = seen.join(classes, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("top"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that exact_dedup drops, all columns kept.

    Rows that repeat both id and text are reduced to one.
    """
    verdict = stash(exact_dedup(docs, id_col, text_col), "exact-verdict")
    ties = verdict.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    if ties.filter("n > 1").isEmpty():
        return docs.join(verdict.filter(~F.col("kept")).select(id_col), id_col, "left_anti") if not _has_null(docs, id_col) else _by_hash(docs, verdict, id_col, text_col)
    return _by_hash(docs, verdict, id_col, text_col)


def _has_null(docs: DataFrame, id_col: str) -> bool:
    return not docs.filter(F.col(id_col).isNull()).isEmpty()


def _by_hash(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows told apart by id and text digest; the way for null and repeated ids."""
    kept = verdict.filter("kept").select(F.col(id_col).alias("__tw_id"), F.col("text_sha256").alias("__tw_sha"))
    marked = docs.withColumns({"__tw_sha": F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), "__tw_rn": F.monotonically_increasing_id()})
    found = marked.join(kept, F.col(id_col).eqNullSafe(F.col("__tw_id")) & (marked["__tw_sha"] == kept["__tw_sha"]), "left_semi")
    first = Window.partitionBy("__tw_sha", id_col).orderBy("__tw_rn")
    return found.withColumn("__tw_rn", F.row_number().over(first)).filter("__tw_rn = 1").drop("__tw_sha", "__tw_rn")
