"""Where windows of a fixed length may repeat: runs of windows under content-chosen anchors.

Windows are runs of bytes or of words.  A run (textkit.chosen_runs) has an
anchor hash that all copies of its windows share, so only anchors met twice
need a closer look, and the runs of one anchor can be judged away from all
others.  Anchors only bring together what may be equal.  Runs with equal bytes
are one kind, told by a 128-bit BLAKE2b digest of them.

An anchor with very many kinds would be one task's work alone.  Its windows are
dealt out again by what lies around the anchor: windows that begin about as far
before it share all that is within reach on both sides, so a digest of that
core keeps equal windows together and parts the rest.  Two such steps, of about
the square root of the places each, end at single windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textkit
from tidewright.llm.cluster import stash

FILTER_BLOCKS = 32
MIN_FILTER_BITS, MAX_FILTER_BITS = 16, 27  # of slots, one bit each: 16 MiB at most

#: Kinds of an anchor that one task judges; those of anchors with more are dealt out again.
HOT_KINDS = 256

TEXTS = "anchor long, kind binary, n int, mark long, hot boolean, text binary"

_U = np.uint64


@dataclass(frozen=True)
class Unit:
    """What windows consist of, how many make one, and how many make an anchor gram."""

    words: bool
    window: int
    gram: int


class Symbols:
    """The symbols (bytes or words) of a slice of texts: their hashes, and the texts' offsets in them."""

    def __init__(self, unit: Unit, data: np.ndarray, offsets: np.ndarray):
        if unit.words:
            starts, ends, self.at = textkit.words(data, offsets)
            self.values = textkit.spans(textkit.byte_values()[data], starts, ends)
            self.raw, self.begin = textkit.joined(data, starts, ends)
        else:
            self.at, self.begin = offsets, None
            self.values = textkit.byte_values()[data]
            self.raw = data.tobytes()

    def cut(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The bytes of symbols a to b-1 for each pair; words are joined by one space."""
        if self.begin is not None:
            a, b = self.begin[a], self.begin[b] - 1
        raw = self.raw
        return [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def keyed(docs: DataFrame, id_col: str, text_col: str, scratch: list[str] | None = None, as_long: bool = True) -> DataFrame:
    """(key, id, text): key tells rows apart; it is the id, or a row number in a written table if ids repeat, are null or no longs."""
    ids = F.col(id_col).cast("long") if as_long else F.col(id_col)
    rows = docs.select(ids.alias("id"), F.col(text_col).cast("string").alias("text"))
    if rows.schema["id"].dataType.simpleString() == "bigint" and rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").isEmpty():
        return rows.select(F.col("id").alias("key"), "id", "text")
    return stash(rows.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "keyed-rows", scratch)


def _anchor_lister(unit: Unit):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in textkit.text_slices(batch.column(0)):
                if unit.words:
                    starts, ends, at = textkit.words(data, offsets)
                    values = textkit.spans(textkit.byte_values()[data], starts, ends)
                else:
                    at, values = offsets, textkit.byte_values()[data]
                found = textkit.chosen_runs(values, at, unit.window, unit.gram)[3]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["anchor"])

    return anchors


def anchors(rows: DataFrame, unit: Unit) -> DataFrame:
    """(anchor) of every run."""
    return rows.select("text").mapInArrow(_anchor_lister(unit), "anchor long")


def _slot(anchor: np.ndarray, bits: int) -> np.ndarray:
    """Anchors are least of many hashes and so crowd at zero; they are mixed anew."""
    return (textkit.mix(anchor * _U(0x9FB21C651E98DF25)) >> _U(64 - bits)).astype(np.int64)


def _bit_setter(bits: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits, bool)
        for batch in batches:
            marks[_slot(batch.column(0).to_numpy().view(_U), bits)] = True
        blocks = np.packbits(marks).reshape(FILTER_BLOCKS, -1)
        used = [i for i in range(FILTER_BLOCKS) if blocks[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "bits"])

    return mark


def _joined_bits(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.frombuffer(pdf["bits"].iloc[0], np.uint8).copy()
    for b in pdf["bits"].iloc[1:]:
        out |= np.frombuffer(b, np.uint8)
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bits": [out.tobytes()]})


def anchor_filter(live: DataFrame):
    """A broadcast bit table that holds all ``live`` anchors: at most 16 MiB.

    With more anchors than that suits it lets more strangers through, which a
    later join drops.
    """
    spark = live.sparkSession
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, (16 * live.count()).bit_length()))
    parts = live.select("anchor").coalesce(max(1, min(32, live.rdd.getNumPartitions()))).mapInArrow(_bit_setter(bits), "block int, bits binary")
    table = np.zeros((FILTER_BLOCKS, (1 << bits) // 8 // FILTER_BLOCKS), np.uint8)
    for r in parts.groupBy("block").applyInPandas(_joined_bits, "block int, bits binary").collect():
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast((bits, table.tobytes()))


def _run_lister(unit: Unit, table):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = table.value if table else (0, b"")
        marks = np.frombuffer(packed, np.uint8)
        for batch in batches:
            for first, data, offsets in textkit.text_slices(batch.column(2)):
                symbols = Symbols(unit, data, offsets)
                text, start, many, anchor, _ = textkit.chosen_runs(symbols.values, symbols.at, unit.window, unit.gram)
                if table and len(anchor):
                    slot = _slot(anchor, bits)
                    kept = np.flatnonzero((marks[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
                    text, start, many, anchor = text[kept], start[kept], many[kept], anchor[kept]
                begin = symbols.at[text] + start
                kinds = [textkit.digest(held) for held in symbols.cut(begin, begin + many + unit.window - 1)]
                rows = pa.array(first + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(kinds, pa.binary())],
                    names=["key", "id", "start", "n", "anchor", "kind"],
                )

    return runs


def runs(rows: DataFrame, unit: Unit, table=None) -> DataFrame:
    """(key, id, start, n, anchor, kind) of the runs of ``rows`` (key, id, text) whose anchor passes ``table``."""
    return rows.select("key", "id", "text").mapInArrow(_run_lister(unit, table), "key long, id long, start int, n int, anchor long, kind binary")


def _slicer(unit: Unit):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, flat = batch.column(1), batch.column(1).flatten()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), np.diff(ends))
            for first, data, offsets in textkit.text_slices(batch.column(0)):
                lo, hi = int(ends[first]), int(ends[first + len(offsets) - 1])
                symbols, part = Symbols(unit, data, offsets), flat.slice(lo, hi - lo)
                of = dict(zip((f.name for f in part.type), part.flatten(), strict=True))
                begin = symbols.at[owner[lo:hi] - first] + of["start"].to_numpy()
                texts = symbols.cut(begin, begin + of["n"].to_numpy() + unit.window - 1)
                yield pa.RecordBatch.from_arrays([*(of[c] for c in ("anchor", "kind", "n", "mark", "hot")), pa.array(texts, pa.binary())], names=["anchor", "kind", "n", "mark", "hot", "text"])

    return cut


def texts_of(rows: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """TEXTS for ``wanted`` (key, start, n, anchor, kind, mark, hot): a run's bytes, or its words joined by one space."""
    by_doc = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "n", "anchor", "kind", "mark", "hot")).alias("wanted"))
    return rows.select("key", "text").join(by_doc.hint("merge"), "key").select("text", "wanted").mapInArrow(_slicer(unit), TEXTS)


def _refiner(unit: Unit, single: bool):
    """Cuts hot runs into parts: ranges of windows by their distance before the anchor, or single windows."""
    places = unit.window - unit.gram + 1  # of the anchor in a window
    step = 1 if single else math.isqrt(places - 1) + 1

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in textkit.text_slices(batch.column(3)):
                symbols = Symbols(unit, data, offsets)
                at = symbols.at[:-1]
                windows = np.diff(symbols.at) - unit.window + 1
                if single:
                    parts = windows
                    row = np.repeat(np.arange(len(parts)), parts)
                    low = high = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                    texts = symbols.cut(at[row] + low, at[row] + low + unit.window)
                    keys = [textkit.digest(t) for t in texts]
                else:
                    before = textkit.chosen_runs(symbols.values, symbols.at, unit.window, unit.gram)[4]
                    lowest = (before - windows + 1) // step
                    parts = before // step - lowest + 1
                    row = np.repeat(np.arange(len(parts)), parts)
                    part = lowest[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                    low, high = np.maximum(before[row] - (part + 1) * step + 1, 0), np.minimum(before[row] - part * step, windows[row] - 1)
                    least, most = part * step, np.minimum((part + 1) * step, places) - 1
                    middle = at[row] + before[row]
                    cores = symbols.cut(middle - least, middle + unit.gram + places - 1 - most)
                    texts = symbols.cut(at[row] + low, at[row] + high + unit.window)
                    keys = [textkit.digest(c + b"\xff%d" % p) for c, p in zip(cores, part.tolist(), strict=True)]
                take = pa.array(first + row)
                anchors = np.frombuffer(b"".join(k[:8] for k in keys), np.int64)
                kinds = [textkit.digest(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(low.astype(np.int32)), pa.array(anchors), pa.array(kinds, pa.binary()), pa.array((high - low + 1).astype(np.int32)), batch.column(2).take(take), pa.array(texts, pa.binary())],
                    names=["over_anchor", "over_kind", "off", "anchor", "kind", "n", "mark", "text"],
                )

    return refine


def judged(texts: DataFrame, unit: Unit, size: int, any_hot: bool, judge: Callable[[DataFrame, int], DataFrame], fold: Callable[[DataFrame], DataFrame], hot_kinds: int, scratch: list[str], depth: int = 0) -> DataFrame:
    """(anchor, kind, spans) for ``texts`` (TEXTS), whatever the number of kinds under an anchor.

    ``judge(texts, symbols)`` does so for anchors with few kinds; ``fold(parts)``
    makes texts again of the parts that hot runs were cut into.
    """
    if not any_hot:
        return judge(texts, size)
    texts = stash(texts, "hot-texts", scratch)
    single = depth == 1
    columns = "over_anchor long, over_kind binary, off int, anchor long, kind binary, n int, mark long, text binary"
    parts = stash(texts.filter("hot").select("anchor", "kind", "mark", "text").mapInArrow(_refiner(unit, single), columns), "hot-parts", scratch)
    kinds = stash(fold(parts).withColumn("hot", F.lit(False)), "hot-kinds", scratch)
    many = kinds.groupBy("anchor").agg(F.countDistinct("kind").alias("kinds")).filter(F.col("kinds") > hot_kinds)
    hot = False
    if not single:
        many = stash(many, "hot-many", scratch)
        hot = not many.isEmpty()
        if hot:
            kinds = kinds.drop("hot").join(many.select("anchor", F.lit(True).alias("hot")), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    inner_size = kinds.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.col("n") + (unit.window - 1))), F.lit(0))).first()[0]
    inner = judged(kinds.select("anchor", "kind", "n", "mark", "hot", "text"), unit, inner_size, hot, judge, fold, hot_kinds, scratch, depth + 1)
    links = parts.select("over_anchor", "over_kind", "off", "anchor", "kind").distinct()
    moved = F.transform("spans", lambda s: s.withField("a", s["a"] + F.col("off")).withField("b", s["b"] + F.col("off")))
    found = links.join(inner, ["anchor", "kind"]).select("over_anchor", "over_kind", moved.alias("spans"))
    lifted = found.groupBy("over_anchor", "over_kind").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    calm = judge(texts.filter("not hot"), size)
    return calm.unionByName(lifted.select(F.col("over_anchor").alias("anchor"), F.col("over_kind").alias("kind"), "spans"))


def by_anchor(texts: DataFrame, order: list[str], symbols_per_task: int, symbols: int) -> DataFrame:
    """``texts`` with all runs of an anchor together in a task, in ``order``."""
    return texts.repartition(max(8, -(-symbols // symbols_per_task)), "anchor").sortWithinPartitions("anchor", *order)


def ranges_by_document(members: DataFrame, window: int) -> DataFrame:
    """(key, cuts) from (key, start, spans array<struct<a, b>>): cuts are [from, to) in the document, for window numbers a to b-1 of a run."""
    span = F.transform("spans", lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"] + (window - 1)).alias("b")))
    return members.select("key", span.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("cuts"))


def merged(cuts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Ascending disjoint, not adjacent [from, to) that cover the same as ``cuts``, a list of structs a, b or null."""
    held = cuts.values
    if held is None or not len(held):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (held.field(c).to_numpy().astype(np.int64) for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return a[begin], np.concatenate([reach[begin[1:] - 1], reach[-1:]])
