"""Similarity join of documents on word n-gram sets (Jaccard), down to components.

Every text becomes a set of n-grams.  Texts with the same words in the same
order are one class, told by a BLAKE2b digest of them.  A class's n-grams are hashed and ordered rare first, by document counts in a table of fixed size,
then by hash.  Two sets that link share one of their first
``n - ceil(t * n) + 1`` n-grams, so classes meet on those alone:

1. in each n-gram's posting list every class meets the list's hub, the class
   with the fewest rarer n-grams;
2. after the links found so far are joined into components, the classes of a
   list that still lie in different components meet each other.

Pairs in one component need no verdict, so a list of near copies costs one pair
for each copy.  Length, positional and suffix filters come before, and a pair
is verified once, on the words of the whole texts: hashes that clash can make
a candidate, but neither a link nor a smaller set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textkit
from tidewright.llm.cluster import ship, small_batches, stash
from tidewright.llm.components import connected_components
from tidewright.llm.segments import keyed

COUNT_BITS = 22  # buckets of the document counts: 4 Mi, whatever the input
COUNT_BLOCKS = 64
COUNTS_AT_ONCE = 64  # tables of counts that one task adds up
RANGES = 16  # of the hash space, for the suffix filter

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Grams:
    """The n-grams of a slice of texts: numbers of their words, a row of ``words`` each, and the text of each.

    A text with 1 to n-1 words has one gram, all its words; one without words none.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        lowered = _LOWER[data]
        starts, ends, at = textkit.words(lowered, offsets)
        numbers, self.known = textkit.word_numbers(lowered, starts, ends)
        have = np.diff(at)
        many = np.where(have >= n, have - n + 1, np.minimum(have, 1))
        self.texts = len(have)
        self.text = np.repeat(np.arange(len(many)), many)
        begin = at[self.text] + np.arange(len(self.text)) - np.repeat(np.cumsum(many) - many, many)
        stop = at[self.text + 1]
        self.words = np.full((len(begin), n), len(self.known), np.int64)  # the last number stands for no word
        for j in range(n):
            inside = begin + j < stop
            self.words[inside, j] = numbers[begin[inside] + j]


class GramSets:
    """Hashes of the distinct n-grams of each text, by text and ascending; ``sizes`` has their number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        lowered = _LOWER[data]
        starts, ends, at = textkit.words(lowered, offsets)
        have = np.diff(at)
        many = np.where(have >= n, have - n + 1, np.minimum(have, 1))
        text = np.repeat(np.arange(len(many)), many)
        begin = at[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        stop = np.minimum(begin + n, at[text + 1])
        self.raw, self.place = textkit.joined(lowered, starts, ends)
        self.at = at
        values = np.append(textkit.spans(textkit.byte_values()[lowered], starts, ends), np.zeros(n, _U))
        hashed = np.zeros(len(text), _U)
        for j in range(n):
            hashed = textkit.mix(hashed * _U(0x9E3779B97F4A7C15) + np.where(begin + j < stop, values[begin + j], _U(0)))
        order = _by_text(text, hashed)
        same = (hashed[order][1:] == hashed[order][:-1]) & (text[order][1:] == text[order][:-1])
        # Equal hashes are one n-gram only if the words are equal.
        for i in np.flatnonzero(same).tolist():
            x, y = order[i], order[i + 1]
            same[i] = self._words(begin[x], stop[x]) == self._words(begin[y], stop[y])
        if len(order) and (~same & (hashed[order][1:] == hashed[order][:-1]) & (text[order][1:] == text[order][:-1])).any():
            keep = sorted({(int(text[i]), int(hashed[i]), self._words(begin[i], stop[i])): i for i in order.tolist()}.items())
            first = np.array([i for _, i in keep], np.int64)
        else:
            first = order[np.concatenate([[True], ~same])] if len(order) else order
        self.hashed, self.text = hashed[first], text[first]
        self.sizes = np.bincount(self.text, minlength=len(have))

    def _words(self, a: int, b: int) -> bytes:
        return self.raw[self.place[a] : self.place[b] - 1]

    def signatures(self) -> list[bytes]:
        """A digest of each text's words in their order."""
        ends = self.place[self.at].tolist()
        return [textkit.digest(self.raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _by_text(text: np.ndarray, hashed: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The order by text, then rank, then hash."""
    key = text.astype(_U) << _U(44)
    if rank is None:
        key |= hashed >> _U(20)
    else:
        key |= (rank.astype(_U) << _U(36)) | (hashed >> _U(28))
    order = np.argsort(key)
    key, sorted_hash = key[order], hashed[order]
    if len(text) and (text[-1] >= 1 << 20 or ((key[1:] == key[:-1]) & (sorted_hash[1:] != sorted_hash[:-1])).any()):
        return np.lexsort((hashed, text) if rank is None else (hashed, rank, text))
    return order


def _counter(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int32)
        for batch in batches:
            for _, data, offsets in textkit.text_slices(batch.column(0)):
                np.add.at(counts, (GramSets(data, offsets, n).hashed >> _U(64 - COUNT_BITS)).astype(np.int64), np.int32(1))
        parts, me = counts.reshape(COUNT_BLOCKS, -1), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([me] * COUNT_BLOCKS, pa.int32()), pa.array(range(COUNT_BLOCKS), pa.int32()), pa.array([zlib.compress(p.astype(np.int64).tobytes(), 1) for p in parts], pa.binary())], names=["part", "block", "counts"])

    return count


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << COUNT_BITS) // COUNT_BLOCKS, np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(c), np.int64)
    return pd.DataFrame({"part": pdf["part"].iloc[:1] // COUNTS_AT_ONCE, "block": pdf["block"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def rarity(docs: DataFrame, text_col: str, n: int) -> bytes:
    """Rarity rank (log scale, one byte) of each bucket of n-gram hashes, over all documents: 4 MiB at any size."""
    texts = docs.select(F.col(text_col).cast("string"))
    counted = texts.mapInArrow(_counter(n), "part int, block int, counts binary")
    tasks = texts.rdd.getNumPartitions()
    while True:  # a tree of sums
        counted = counted.groupBy("block", F.floor(F.col("part") / COUNTS_AT_ONCE)).applyInPandas(_summed, "part int, block int, counts binary")
        tasks = -(-tasks // COUNTS_AT_ONCE)
        if tasks <= 1:
            break
    table = np.zeros((COUNT_BLOCKS, (1 << COUNT_BITS) // COUNT_BLOCKS), np.uint8)
    ranks = counted.select("block", "counts").mapInArrow(_ranks, "block int, rank binary")
    with small_batches(docs.sparkSession):
        for r in ranks.collect():
            table[r["block"]] = np.frombuffer(r["rank"], np.uint8)
    return table.tobytes()


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for c in batch.column(1):
            total = np.frombuffer(zlib.decompress(c.as_buffer()), np.int64)
            out.append(np.minimum(255, np.floor(8 * np.log2(1.0 + total))).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "rank"])


def _ceil_div(a, b):
    return -(-a // b)


def _sketcher(n: int, percent: int, table):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for first, data, offsets in textkit.text_slices(batch.column(2)):
                sets = GramSets(data, offsets, n)
                m, texts = sets.sizes, len(sets.sizes)
                keep = np.where(m > 0, m - _ceil_div(percent * m, 100) + 1, 0)
                order = _by_text(sets.text, sets.hashed, rank[(sets.hashed >> _U(64 - COUNT_BITS)).astype(np.int64)])
                place = np.arange(len(order)) - np.repeat(np.cumsum(m) - m, m)
                prefix = sets.hashed[order][place < np.repeat(keep, m)]
                spread = np.bincount(sets.text * RANGES + (sets.hashed & _U(RANGES - 1)).astype(np.int64), minlength=texts * RANGES)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, texts),
                        batch.column(1).slice(first, texts),
                        pa.array(m, pa.int64()),
                        pa.array(sets.signatures(), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(prefix.view(np.int64), pa.int64())),
                        pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * RANGES), pa.array(spread.astype(np.int32), pa.int32())),
                    ],
                    names=["key", "id", "n", "sig", "prefix", "ranges"],
                )

    return sketch


def linked(a: pa.Array, b: pa.Array, n: int, percent: int) -> np.ndarray:
    """Whether the sets of the texts ``a[i]`` and ``b[i]`` link, by their words."""
    ((_, data, offsets),) = textkit.text_slices(pa.concat_arrays([a.cast(pa.large_binary()), b.cast(pa.large_binary())]), 1 << 62)
    grams, pairs = Grams(data, offsets, n), len(a)
    code = np.zeros(len(grams.text), np.int64)  # equal grams, and only they, have one in common
    for j in range(n):
        code = np.unique(code * (len(grams.known) + 1) + grams.words[:, j], return_inverse=True)[1]
    most = len(code) + 1
    held = np.unique(grams.text * most + code)
    text, code = held // most, held % most
    mine = np.searchsorted(text, pairs)
    shared = np.intersect1d(held[:mine], (text[mine:] - pairs) * most + code[mine:], assume_unique=True) // most
    size, both = np.bincount(text, minlength=2 * pairs), np.bincount(shared, minlength=pairs)
    return (both > 0) & (100 * both >= percent * (size[:pairs] + size[pairs:] - both))


def _verifier(n: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column(2), batch.column(3)
            held = np.concatenate([[0], np.cumsum([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(ta, tb, strict=True)])])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(held, held[at] + textkit.SLICE_BYTES, side="right")) - 1)
                yes = np.flatnonzero(linked(ta.slice(at, to - at), tb.slice(at, to - at), n, percent)) + at
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(yes)) for c in (0, 1)], names=["a", "b"])
                at = to

    return verify


def _may_link(percent: int) -> Column:
    """Length and positional filters on a pair of postings (na, pa) and (nb, pb) of one n-gram."""
    na, nb = F.col("na"), F.col("nb")
    long_enough = (F.lit(percent) * na <= 100 * nb) & (F.lit(percent) * nb <= 100 * na)
    return long_enough & _enough(F.least(na - F.col("pa"), nb - F.col("pb")), na + nb, percent)


def _enough(shared: Column, both: Column, percent: int) -> Column:
    """Whether sets of sizes that add up to ``both`` may link if they share at most ``shared``."""
    return shared * (100 + percent) >= both * percent


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Linked pairs (a, b) of distinct candidate pairs, after the suffix filter."""
    side = lambda s: classes.select(F.col("sig").alias(s), F.col("n").alias(f"n{s}"), F.col("ranges").alias(f"r{s}"))
    wide = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    # The sets cannot share more in a range of the hash space than the smaller has there.
    most = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    wide = wide.filter(_enough(most.cast("long"), F.col("na") + F.col("nb"), percent)).select("a", "b")
    held = lambda s: texts.select(F.col("sig").alias(s), F.col("text").alias(f"t{s}"))
    both = wide.hint("merge").join(held("a"), "a").hint("merge").join(held("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verifier(words, percent), "a binary, b binary")


def _components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, label, component_id) of linked classes: a component is named by the smallest id of its classes, null last."""
    node = F.struct(F.col("rep.none").alias("none"), F.col("rep.id").alias("id"), "sig")
    side = lambda s: classes.select(F.col("sig").alias(f"_{s}"), node.alias(s))
    edges = links.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(side("a"), "_a").join(side("b"), "_b").select("a", "b")
    return stash(connected_components(edges).select("node.sig", F.col("label.sig").alias("label"), F.col("label.id").alias("component_id")), "ngram-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Sets
    link when 100 * intersection >= percent * union; a component is all that
    links reach and is named by its smallest id.  Texts without words (null,
    empty) have an empty set and stand alone.  Rows that repeat an id or a text
    are rows of their own; null ids count for no name unless a component has
    no other.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(rarity(docs, text_col, words))  # 4 MiB
    texts = keyed(docs, id_col, text_col, as_long=False)
    kind = texts.schema["id"].dataType.simpleString()
    rows = stash(texts.mapInArrow(_sketcher(words, percent, table), f"key long, id {kind}, n long, sig binary, prefix array<long>, ranges array<int>"), "ngram-rows")
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min(rep).alias("rep"), *(F.first(c).alias(c) for c in ("n", "ranges", "prefix")))
    classes = stash(classes, "ngram-classes")
    posts = classes.select("sig", "n", F.posexplode("prefix").alias("pos", "gram"))
    hubs = posts.groupBy("gram").agg(F.min(F.struct("pos", "n", "sig")).alias("hub"), F.count("*").alias("many")).filter("many > 1")
    lists = stash(posts.join(hubs.select("gram", "hub"), "gram"), "ngram-lists")

    star = lists.filter("sig <> hub.sig").select(F.col("sig").alias("x"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("hub.sig").alias("y"), F.col("hub.n").alias("nb"), F.col("hub.pos").alias("pb"))
    first = stash(_pairs(star.filter(_may_link(percent))), "ngram-star")
    links = stash(_verified(first, classes, _texts_of(texts, classes, _members(first)), words, percent), "ngram-links")
    labels = _components(links, classes)

    rest = stash(_across(lists, labels, percent).join(first, ["a", "b"], "left_anti"), "ngram-rest")
    if not rest.isEmpty():
        more = _verified(rest, classes, _texts_of(texts, classes, _members(rest)), words, percent)
        labels = _components(stash(links.union(more), "ngram-links"), classes)
    found = F.when(F.col("label").isNotNull(), F.col("component_id")).otherwise(F.col("rep.id"))
    named = stash(classes.select("sig", "rep").join(labels, "sig", "left").select("sig", found.alias("component_id")), "ngram-named")
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rows.select("id", "n", "sig").join(named, "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()


def _texts_of(texts: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(sig, text) of the classes in ``members``: their representatives' texts."""
    needed = stash(classes.select("sig", F.col("rep.key").alias("rep")).join(members, "sig"), "ngram-needed")
    return stash(texts.join(needed.hint("merge"), F.col("key") == F.col("rep")).select("sig", "text"), "ngram-texts")


def _across(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one posting list whose classes lie in different components."""
    marked = lists.drop("hub").join(labels.select("sig", "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    marked = stash(marked, "ngram-marked")
    kept = marked.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least")).filter("lo <> hi").select("gram", "least")
    # The longest partner that this posting's place allows; none in the list is as short: nothing to meet.
    reaches = _enough(F.col("n") - F.col("pos"), F.col("n") + F.col("least"), percent)
    live = stash(marked.join(kept, "gram").filter(reaches).drop("least"), "ngram-live")
    one = live.select("gram", F.col("sig").alias("x"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
    two = live.select("gram", F.col("sig").alias("y"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
    met = one.join(two, "gram").filter((F.col("x") < F.col("y")) & (F.col("la") != F.col("lb")) & _may_link(percent))
    return _pairs(met)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the smallest id of each component; documents without words all stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    stays = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__tw_id")).distinct()
    return docs.join(stays, F.col(id_col).eqNullSafe(F.col("__tw_id")), "left_semi")
