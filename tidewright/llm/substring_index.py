"""Incremental removal of repeated word windows by a log-structured fingerprint index.

The index is a set of immutable runs, sorted tables of window fingerprints (the
anchor hashes of runs of windows), beside tables that say where the windows
under each occur, and the texts themselves.  A batch of new documents is
merge-joined with the runs to find the fingerprints that were seen before.
Windows under those are verified: runs of them with one 128-bit BLAKE2b digest
have the same words, and of runs that differ every window is compared word by
word.  The batch becomes a run of its own, and every ``FAN_IN`` runs of a level are
compacted into one of the next.  Batches that are at hand together are looked up and
made runs one after another, and verified once for all.  An index stays in its folder
and can be opened again for the next batch.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import segments, textkit
from tidewright.llm.cluster import drop_path, fresh_path, ship, small_batches, stash

WINDOW = 50
GRAM = 16
FAN_IN = 3
BATCHES = 4
TASK_SYMBOLS = 1 << 20
BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 500_000
LEAST, MOST = -(1 << 63), (1 << 63) - 1

_TEXTS, _ANCHORS, _PLACES = "key long, id long, text string", "anchor long", "anchor long, kind binary, key long, start int, n int"


class FingerprintIndex:
    """An index in ``path``: texts by batch, levels of runs, and places by batch.

    ``add`` judges a batch against all that was added before it, and within the
    batch a document against those with smaller ids.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, hot_kinds: int = segments.HOT_KINDS):
        self.spark, self.path, self.hot_kinds = spark, path, hot_kinds
        self.unit = segments.Unit(words=True, window=window, gram=min(gram, max(1, window // 3)))
        self.texts: list[dict] = []
        self.places: list[str] = []
        self.levels: list[list[dict]] = []
        self._names: dict[str, str] = {}
        ship(spark)

    @classmethod
    def open(cls, spark: SparkSession, path: str, hot_kinds: int = segments.HOT_KINDS) -> FingerprintIndex:
        """The index as its last finished ``add`` left it."""
        states = spark.read.schema("version int, state string").json(f"{path}/state")
        state = json.loads(states.orderBy(F.desc("version")).first()["state"])
        out = cls(spark, path, state["window"], state["gram"], hot_kinds)
        out.texts, out.places, out.levels = state["texts"], state["places"], state["levels"]
        return out

    def _save(self) -> None:
        state = {"window": self.unit.window, "gram": self.unit.gram, "texts": self.texts, "places": self.places, "levels": self.levels}
        self.spark.createDataFrame([(len(self.texts), json.dumps(state))], "version int, state string").coalesce(1).write.mode("append").json(f"{self.path}/state")

    def _write(self, rows: DataFrame, name: str, by: str, buckets: int) -> dict:
        """A table dealt and sorted by ``by``; one that is read again needs no new shuffle for a join on it."""
        table, path = f"tidewright_{uuid.uuid4().hex}", f"{self.path}/{name}-{uuid.uuid4().hex}"
        rows.repartition(buckets, by).sortWithinPartitions(by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
        self._names[path] = table
        return {"path": path, "buckets": buckets}

    def _table(self, held: dict, schema: str, by: str) -> DataFrame:
        if held["path"] not in self._names:
            table = f"tidewright_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {held['buckets']} BUCKETS LOCATION '{held['path']}'")
            self._names[held["path"]] = table
        return self.spark.table(self._names[held["path"]])

    def _forget(self, held: dict) -> None:
        name = self._names.pop(held["path"], None)
        if name:
            self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, held["path"])

    def close(self) -> None:
        """Take this session's names of the index's tables away; the files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names = {}

    def drop(self) -> None:
        """Delete the index."""
        for held in [*self.texts, *(run for level in self.levels for run in level)]:
            self._forget(held)
        drop_path(self.spark, self.path)

    def _compact(self) -> list[dict]:
        """Merge full levels; the runs that are then superseded."""
        level, old = 0, []
        while level < len(self.levels) and len(self.levels[level]) >= FAN_IN:
            whole = None
            for run in self.levels[level]:
                one = self._table(run, _ANCHORS, "anchor")
                whole = one if whole is None else whole.unionByName(one)
            merged = self._write(whole.distinct(), "run", "anchor", max(r["buckets"] for r in self.levels[level]) * FAN_IN)
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            old += self.levels[level]
            self.levels[level] = []
            level += 1
        return old

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
        """Judge and append a batch; one row per row of it: id, n_words, n_removed, kept (if asked for), kept_sha256."""
        return self.add_each(docs, [], id_col, text_col, with_kept)

    def add_each(self, docs: DataFrame, edges: list[int], id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
        """The rows of ``add`` for each of the batches that ``edges`` (ascending ids, the last of a batch each) cut ``docs`` into.

        Each batch is met with the runs before it and becomes a run of its own.
        The windows so found are verified together, so texts, old ones too, are read once for all batches.
        """
        spark, unit, scratch, part = self.spark, self.unit, [], len(self.texts)
        keyed = segments.keyed(docs, id_col, text_col, scratch)
        held = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        stored = self._write(keyed, "texts", "key", max(8, -(-held // BUCKET_BYTES)))
        rows = self._table(stored, _TEXTS, "key")
        ranked = rows.select("key", F.coalesce("id", F.lit(MOST)).alias("id"), "text")
        places = f"{self.path}/places-{uuid.uuid4().hex}"
        with small_batches(spark):
            segments.runs(ranked, unit).write.parquet(places)
        runs = spark.read.schema(f"{_PLACES}, id long").parquet(places)
        batch = F.lit(0)
        for edge in edges:
            batch = batch + (F.col("id") > edge).cast("int")
        met = runs.groupBy(batch.alias("batch"), "anchor").agg((F.min("id") != F.max("id")).alias("twice"))
        met = stash(met, "window-met", scratch)
        found, superseded = met.filter("twice").select("anchor"), []
        counts = dict(map(tuple, met.groupBy("batch").count().collect()))
        if not self.levels:
            self.levels.append([])
        for i in range(len(edges) + 1):
            mine = met.filter(F.col("batch") == i).select("anchor")
            for level in self.levels:
                for run in level:
                    found = found.unionByName(mine.join(self._table(run, _ANCHORS, "anchor"), "anchor", "left_semi"))
            self.levels[0].append(self._write(mine, "run", "anchor", max(8, -(-counts.get(i, 0) // BUCKET_ROWS))))
            superseded += self._compact()
        found = stash(found.distinct(), "window-found", scratch)

        place = lambda i: F.struct(F.lit(i).alias("part"), "key", "start", "n").alias("place")
        live = stash(runs.join(found, "anchor", "left_semi"), "window-live", scratch)
        now = live.select("anchor", "kind", F.struct(F.col("id").alias("mark"), place(part)).alias("first"))
        for i, path in enumerate(self.places):
            old = spark.read.schema(_PLACES).parquet(path).join(found, "anchor", "left_semi")
            now = now.unionByName(old.select("anchor", "kind", F.struct(F.lit(LEAST).alias("mark"), place(i)).alias("first")))
        kinds = stash(now.groupBy("anchor", "kind").agg(F.min("first").alias("first")), "window-kinds", scratch)
        many = stash(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")), "window-many", scratch)
        split = kinds.join(many, "anchor").select("anchor", "kind", "first.mark", "first.place.*", "kinds")
        whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.col("mark").alias("source")))
        alone = split.filter("kinds = 1").select("anchor", "kind", whole.alias("spans"))
        wanted = split.filter("kinds > 1").select("part", "key", "start", "n", "anchor", "kind", "mark", (F.col("kinds") > self.hot_kinds).alias("hot"))
        wanted = stash(wanted, "window-wanted", scratch)
        size, hot = wanted.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.col("n") + (unit.window - 1))), F.lit(0)), F.count_if("hot")).first()
        texts = segments.texts_of(rows, wanted.filter(F.col("part") == part), unit)
        for i, older in enumerate(self.texts):
            texts = texts.unionByName(segments.texts_of(self._table(older, _TEXTS, "key"), wanted.filter(F.col("part") == i), unit))
        verified = segments.judged(texts, unit, size, hot > 0, _judge(unit.window), _fold, self.hot_kinds, scratch)
        sources = stash(verified.unionByName(alone), "window-sources", scratch)

        hit = live.join(sources, ["anchor", "kind"]).withColumn("spans", F.filter("spans", lambda s: s["source"] < F.col("id"))).filter("size(spans) > 0")
        cuts = segments.ranges_by_document(hit, unit.window).withColumnRenamed("key", "k")
        columns = "id long, n_words long, n_removed long, " + "kept string, " * with_kept + "kept_sha256 string"
        both = rows.join(cuts.hint("merge"), F.col("key") == F.col("k"), "left").select("id", "text", "cuts")
        out = stash(both.mapInArrow(lambda b: _cut(b, with_kept), columns), "window-kept")

        self.texts.append(stored)
        self.places.append(places)
        self._save()
        for run in superseded:
            self._forget(run)
        for path in scratch:
            drop_path(spark, path)
        return out.withColumnRenamed("id", id_col)


def _verifier(window: int):
    """For each run of an anchor, in the order of first ids, the smallest id with each window, as spans."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, {}
        for batch in batches:
            anchors, kinds, spans = [], [], []
            for anchor, kind, n, first, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "kind", "n", "mark", "text")), strict=True):
                if anchor != last:
                    last, seen = anchor, {}
                at = [-1, *np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist(), len(text)]
                own: list[dict] = []
                for i in range(n):
                    source = seen.setdefault(text[at[i] + 1 : at[i + window]], first)
                    if own and own[-1]["source"] == source:
                        own[-1]["b"] = i + 1
                    else:
                        own.append({"a": i, "b": i + 1, "source": source})
                anchors.append(anchor)
                kinds.append(kind)
                spans.append(own)
            kind_of = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("source", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(kinds, pa.binary()), pa.array(spans, kind_of)], names=["anchor", "kind", "spans"])

    return verify


def _fold(parts: DataFrame) -> DataFrame:
    return parts.groupBy("anchor", "kind").agg(F.min("n").alias("n"), F.min("mark").alias("mark"), F.min("text").alias("text"))


def _judge(window: int):
    def judge(texts: DataFrame, size: int) -> DataFrame:
        spans = "anchor long, kind binary, spans array<struct<a:int,b:int,source:long>>"
        return segments.by_anchor(texts, ["mark", "kind"], TASK_SYMBOLS, size).mapInArrow(_verifier(window), spans)

    return judge


def _cut(batches: Iterator[pa.RecordBatch], with_kept: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(2)
        for first, data, offsets in textkit.text_slices(batch.column(1)):
            starts, ends, at = textkit.words(data, offsets)
            raw, begin = textkit.joined(data, starts, ends)
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
            for i in range(len(offsets) - 1):
                lo, hi = int(at[i]), int(at[i + 1])
                parts, to, gone = [], lo, 0
                for x, y in zip(*(v.tolist() for v in segments.merged(rows[first + i])), strict=True):
                    parts.append(raw[begin[to] : begin[lo + x]])
                    to, gone = lo + y, gone + y - x
                parts.append(raw[begin[to] : begin[hi]])
                out["n_words"].append(hi - lo)
                out["n_removed"].append(gone)
                out["kept"].append(b"".join(parts)[:-1])
            made = {"n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64())}
            if with_kept:
                made["kept"] = pa.array(out["kept"], pa.binary()).cast(pa.string())
            made["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), *made.values()], names=["id", *made])


def remove_seen_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, with_kept: bool = True, hot_kinds: int = segments.HOT_KINDS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (if asked for), kept_sha256.

    Words are runs of anything but ASCII white space, unchanged.  A word goes if
    a window of ``window`` consecutive words that covers it also starts in a
    document with a smaller id.  Windows are judged on the input.  Documents
    come in ``batches`` batches of ascending ids, each met with and added to an
    index of those before it, which is deleted at the end; what was met is
    verified for all batches together.  Null and empty texts have no
    words; ids are integers, a null one counts as 2^63-1; rows that share an id
    are no history of each other; an empty table gives an empty result; other
    columns are not read.  A text is worked on in one task, in some hundred
    bytes of memory for each of its own.
    """
    spark = docs.sparkSession
    index = FingerprintIndex(spark, fresh_path(spark, "fingerprints"), window, hot_kinds=hot_kinds)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    rank = F.coalesce(F.col(id_col), F.lit(MOST))
    shares = [i / batches for i in range(1, batches)]
    found_at = rows.agg(F.percentile_approx(rank, shares, 1000)).first()[0] if shares else None
    out = index.add_each(rows, sorted(set(found_at or [])), id_col, text_col, with_kept)
    index.drop()
    return out
