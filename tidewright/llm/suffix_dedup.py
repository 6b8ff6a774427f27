"""Removal of repeated byte strings by suffix arrays.

Candidate runs (segments) bring every copy of a window of ``length`` bytes to
the task that owns its anchor.  There the distinct runs are joined into a text
whose suffixes are sorted in two stages; windows whose suffix shares
``length`` bytes with a neighbour are repeated.  Of runs with equal contents two
enter the array, so that it judges their windows by their bytes as well; further
ones are held equal to these by a 128-bit BLAKE2b digest of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import segments
from tidewright.llm.cluster import drop_path, ship, stash
from tidewright.llm.suffix_array import adjacent_prefixes, sort_suffixes

LENGTH = 200
GRAM = 64
ARRAY_BYTES = 128 << 10  # what fits a core's cache sorts faster
TASK_BYTES = 3 << 20
SEGMENT_BYTES = 64 << 10
SEPARATOR = 0xFF  # no byte of UTF-8


def repeated_starts(texts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each text a flag per start 0 to count-1: its ``length`` bytes start at another such place too."""
    joined = np.frombuffer(b"".join(t + bytes([SEPARATOR]) for t in texts), np.uint8)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    n = np.array(counts, np.int64)
    needed = np.zeros(len(joined) + 1, np.int64)
    np.add.at(needed, begin, 1)
    np.add.at(needed, begin + n, -1)
    needed = np.cumsum(needed[:-1]) > 0
    order = sort_suffixes(joined, needed, length)
    order = order[needed[order]]
    same = adjacent_prefixes(joined, order, length) >= length
    repeated = np.zeros(len(joined), bool)
    repeated[order[same]] = True
    repeated[order[np.flatnonzero(same) - 1]] = True
    return [repeated[b : b + c] for b, c in zip(begin.tolist(), counts, strict=True)]


def _spans(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _array_builder(length: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            flags = repeated_starts([h[3] for h in held], [h[2] for h in held], length)
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary()), pa.array([_spans(f) for f in flags], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                names=["anchor", "kind", "spans"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "kind", "n", "text")), strict=True):
                if size >= ARRAY_BYTES and row[0] != last:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield flush()

    return build


def _copies(first: str, last: str):
    """One row for a kind met once, two for others; ``mark`` is the weight of each."""
    row = lambda c, mark: F.struct(F.col(c).alias("copy"), mark.alias("mark"))
    once = F.array(row(first, F.col("weight")))
    return F.explode(F.when(F.col("weight") > 1, F.array(row(first, F.col("weight") - 1), row(last, F.lit(1).cast("long")))).otherwise(once))


def _segments(alone: DataFrame) -> DataFrame:
    """Kinds alone under their anchors, with the segment (seg_anchor, seg_kind) each is part of, from window ``off`` on.

    Runs that follow one another both in the first and in the last document
    that has them are one segment, of up to about ``SEGMENT_BYTES``.
    """
    by_doc = Window.partitionBy("first.key").orderBy("first.start")
    before = F.lag(F.struct("first", "last")).over(by_doc)
    follows = (
        (before["first"]["start"] + before["first"]["n"] == F.col("first.start"))
        & (before["last"]["key"] == F.col("last.key"))
        & (before["last"]["start"] + before["last"]["n"] == F.col("last.start"))
        & (F.floor(before["first"]["start"] / SEGMENT_BYTES) == F.floor(F.col("first.start") / SEGMENT_BYTES))
    )
    numbered = alone.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("seg", F.sum("new").over(by_doc))
    whole = Window.partitionBy("first.key", "seg").orderBy("first.start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.struct("anchor", "kind", "first", "last")).over(whole)
    numbered = numbered.withColumn("head", head).withColumn("whole", F.sum("first.n").over(whole).cast("int"))
    off = F.col("first.start") - F.col("head.first.start")
    return numbered.select("anchor", "kind", F.col("first.n").alias("n"), off.alias("off"), "head", "whole", F.col("head.anchor").alias("seg_anchor"), F.col("head.kind").alias("seg_kind"))


def _wanted(kinds: DataFrame, n: str) -> DataFrame:
    chosen = kinds.select("anchor", "kind", "hot", F.col(n).alias("windows"), _copies("first", "last").alias("c"))
    return chosen.select("c.copy.key", "c.copy.start", F.col("windows").alias("n"), "anchor", "kind", "c.mark", "hot")


def _parted(flagged: DataFrame, parts: DataFrame) -> DataFrame:
    """Spans of segments as spans of the kinds that they consist of."""
    mine = flagged.select(F.col("anchor").alias("seg_anchor"), F.col("kind").alias("seg_kind"), "spans")
    own = F.transform("spans", lambda s: F.struct(F.greatest(s["a"] - F.col("off"), F.lit(0)).alias("a"), F.least(s["b"] - F.col("off"), F.col("n")).alias("b")))
    return parts.join(mine, ["seg_anchor", "seg_kind"]).select("anchor", "kind", F.filter(own, lambda s: s["a"] < s["b"]).alias("spans")).filter("size(spans) > 0")


def _fold(parts: DataFrame) -> DataFrame:
    kinds = parts.groupBy("anchor", "kind").agg(F.min("n").alias("n"), F.sum("mark").alias("weight"), F.min("text").alias("lo"), F.max("text").alias("hi"))
    return kinds.select("anchor", "kind", "n", _copies("lo", "hi").alias("c")).select("anchor", "kind", "n", "c.mark", F.col("c.copy").alias("text"))


def _judge(length: int):
    def judge(texts: DataFrame, size: int) -> DataFrame:
        found = segments.by_anchor(texts, [], TASK_BYTES, size).mapInArrow(_array_builder(length), "anchor long, kind binary, spans array<struct<a:int,b:int>>")
        return found.filter("size(spans) > 0").groupBy("anchor", "kind").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    return judge


def _cut(batches: Iterator[pa.RecordBatch], with_kept: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
        for text, cuts in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            a, b = segments.merged(cuts)
            parts, at = [], 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                parts.append(raw[at:x])
                at = y
            kept = b"".join([*parts, raw[at:]])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(a))
            if with_kept:
                out["kept"].append(kept)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if not with_kept:
            del out["kept"]
        kinds = {"kept": pa.binary(), "kept_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["id", *out])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True, hot_kinds: int = segments.HOT_KINDS) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (binary, if asked for), kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts
    somewhere else in the table, in the same text or another.  Strings end with
    their text and are judged on the input.  Null and empty texts have no
    bytes; rows that repeat an id or a text are rows of their own (and repeats
    of each other); ids are integers or null; an empty table gives an
    empty result; other columns are not read.  Cut characters can leave bytes
    that are no UTF-8, so ``kept`` is binary.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch: list[str] = []
    unit = segments.Unit(words=False, window=length, gram=min(GRAM, max(1, length // 3)))
    rows = segments.keyed(docs, id_col, text_col)
    live = stash(segments.anchors(rows, unit).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "suffix-live", scratch)
    runs = stash(segments.runs(rows, unit, segments.anchor_filter(live)), "suffix-runs")

    place = F.struct("key", "start", "n")
    kinds = stash(runs.groupBy("anchor", "kind").agg(F.count("*").alias("weight"), F.min(place).alias("first"), F.max(place).alias("last")), "suffix-kinds", scratch)
    met = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("weight").alias("n")).filter("n > 1").select("anchor", "kinds")
    split = stash(kinds.join(stash(met, "suffix-met", scratch), "anchor"), "suffix-split", scratch)
    parts = stash(_segments(split.filter("kinds = 1")), "suffix-parts", scratch)
    whole = parts.filter("off = 0").select("seg_anchor", "seg_kind", "whole", F.col("head.first").alias("first"), F.col("head.last").alias("last")).withColumnsRenamed({"seg_anchor": "anchor", "seg_kind": "kind"})
    wanted = _wanted(whole.withColumns({"hot": F.lit(False), "weight": F.lit(2).cast("long")}), "whole")
    wanted = stash(wanted.unionByName(_wanted(split.filter("kinds > 1").withColumn("hot", F.col("kinds") > hot_kinds), "first.n")), "suffix-wanted", scratch)
    size, hot = wanted.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.col("n") + (length - 1))), F.lit(0)), F.count_if("hot")).first()
    flagged = stash(segments.judged(segments.texts_of(rows, wanted, unit), unit, size, hot > 0, _judge(length), _fold, hot_kinds, scratch), "suffix-judged", scratch)
    alone = parts.filter("whole > n").select("anchor", "kind")
    single = flagged.join(alone, ["anchor", "kind"], "left_anti")
    flagged = stash(single.unionByName(_parted(flagged, parts.filter("whole > n"))), "suffix-flagged")
    for path in scratch:
        drop_path(spark, path)

    cuts = segments.ranges_by_document(runs.join(flagged, ["anchor", "kind"]), length)
    both = rows.withColumnRenamed("key", "k").join(cuts.hint("merge"), F.col("k") == F.col("key"), "left").select("id", "text", "cuts")
    columns = "id long, n_bytes long, n_removed long, n_spans long, " + "kept binary, " * with_kept + "kept_sha256 string"
    return both.mapInArrow(lambda batches: _cut(batches, with_kept), columns).withColumnRenamed("id", id_col)
