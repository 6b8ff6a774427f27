"""Best-fit packing into sequences by bin completion.

Texts become token ids once, and pieces of at most ``capacity`` tokens.  How
many pieces there are of each length is a table of at most ``capacity`` rows
whatever the input's size; bin completion plans all sequences on it.  The
best-fit plan is the first incumbent, and proven if it meets the lower bound.
Otherwise plans are searched by branch and bound: each bin starts from the
largest length left, undominated fillings of the rest are enumerated, the
plan goes on with the least wasteful and keeps the others as branches, and a
branch ends where its waste leaves no plan with fewer bins than the incumbent.
A filling is used as often as its lengths last, so a plan has at most
``capacity`` patterns or so.  Pieces then find their places by their rank
within their length.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.cluster import ship, stash

CAPACITY = 2048
SALTS = 1024
SEARCH_NODES = 400
BRANCHES = 3  # fillings of a bin that a plan may go on with
PLAN_STEPS = 1_000  # bins or runs of equal bins completed in the search of one plan, 16 KB each at most
WORD_CACHE = 600_000  # known words of a worker, 30 bytes or so each
TEXT_BYTES = 4 << 20
PARTS_AT_ONCE = 200_000

# The parts that word_bpe_49k splits normalised texts into.
_WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_tokenizers: dict = {}


def splits_at_words(path: str) -> bool:
    """Whether the tokenizer in ``path`` declares the normalisation and splitting that let ids be found a word at a time."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal, before = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [])
    known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
    parts = before.get("pretokenizers", [])
    cut = [x["type"] for x in parts] == ["Split", "ByteLevel"] and (parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": _WORD_PARTS}, "Removed", True)
    plain = cut and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    special = all(t["content"].startswith("<|") and " " not in t["content"] for t in made.get("added_tokens", []))
    return known and plain and special and not made.get("post_processor") and not made.get("truncation") and not made.get("padding")


class WordIds:
    """Token ids of texts, a word at a time, with a bounded table of known words.

    For tokenizers that lower the case, drop white space before they merge and
    split runs of letters from punctuation, as word_bpe_49k does: no token and no
    normalisation step crosses an ASCII space or the place between an ASCII
    letter and ASCII punctuation, so the ids of a text are those of its parts in
    order.  Texts that may hold a special token are only split at spaces.  With
    any other tokenizer a text is one part, and none is remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold more memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = splits_at_words(path)
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _learn(self, words: pa.Array) -> None:
        flat, lengths = [self.flat], [self.lengths]
        for at in range(0, len(words), 5_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words.slice(at, 5_000).to_pylist(), add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths[-1].sum())))
        self.words = pa.concat_arrays([self.words, words])
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all parts in the table of known words, and the texts' offsets in them."""
        if not self.by_word:
            self._forget()
            self._learn(texts.cast(pa.large_string()))
            return np.arange(len(texts)), np.arange(len(texts) + 1)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=r"([a-z])([!-/:-@\[-`{-~])", replacement=r"\1 \2")
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        del parts
        known = coded.dictionary.cast(pa.large_string())
        place = pc.fill_null(pc.index_in(known, value_set=self.words), -1).to_numpy().copy()
        missing = np.flatnonzero(place < 0)
        if len(missing) and len(self.words) + len(missing) > WORD_CACHE:
            self._forget()
            missing = np.arange(len(known))
        if len(missing):
            place[missing] = len(self.words) + np.arange(len(missing))
            self._learn(known.take(pa.array(missing)))
        return place[coded.indices.to_numpy()], offsets - offsets[0]

    def ids(self, parts: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as parts, each text's followed by ``end_id``, and their offsets."""
        starts = np.cumsum(self.lengths) - self.lengths
        ends = offsets[1:] + np.arange(len(offsets) - 1)
        full = np.full(len(parts) + len(offsets) - 1, -1, np.int64)
        inner = np.ones(len(full), bool)
        inner[ends] = False
        full[inner] = parts
        n = np.where(inner, self.lengths[full] if len(self.lengths) else 1, 1)
        to = np.cumsum(n)
        total = int(to[-1]) if len(to) else 0
        first = np.where(inner, starts[full] if len(starts) else 0, len(self.flat))
        source = np.repeat(first - (to - n), n) + np.arange(total)
        return np.append(self.flat, np.uint32(end_id))[source], np.concatenate([[0], to[ends]])


def _cutter(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordIds(path)
        known = _tokenizers[path]
        for batch in batches:
            key = batch.column(0)
            for first, texts in _slices(pc.fill_null(batch.column(1), ""), TEXT_BYTES):
                parts, at = known.split(texts)
                lo = 0
                while lo < len(texts):
                    hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PARTS_AT_ONCE, side="right")) - 1)
                    ids, offsets = known.ids(parts[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], end_id)
                    yield _pieces(key, first + lo, ids, offsets, capacity)
                    lo = hi
                pa.default_memory_pool().release_unused()

    return cut


def _pieces(key: pa.Array, first: int, ids: np.ndarray, offsets: np.ndarray, capacity: int) -> pa.RecordBatch:
    sizes = np.diff(offsets)
    many = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * capacity
    length = np.minimum(sizes[row] - start, capacity)
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
    begin = (offsets[row] + start).tolist()
    crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin, length.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([key.take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def best_fit(counts: np.ndarray, room: int, most: int) -> list[tuple[int, int]]:
    """(length, count) pairs: the longest that fits, again and again."""
    out = []
    length = min(most, room)
    while room > 0 and length > 0:
        if counts[length]:
            n = min(int(counts[length]), room // length)
            if n:
                out.append((length, n))
                room -= n * length
        length = min(length - 1, room)
    return out


def _dominated(groups: tuple, spare: int) -> bool:
    """Whether a length left out could take the place of chosen smaller pieces and up to ``spare`` of waste."""
    for out, sums in groups:
        near, done = sums, 0
        while done < spare:
            step = min(done + 1, spare - done)
            near |= near << step
            done += step
        if out & near:
            return True
    return False


def fillings(counts: np.ndarray, room: int, most: int, keep: int = 1, nodes: int = SEARCH_NODES, spent: list[int] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """The ``keep`` fillings of ``room`` with least waste, as (waste, filling), by depth-first branch and bound.

    Starts from the best-fit filling.  Lengths go downwards and each is tried
    from as many as fit to none.  A filling is dominated, and its branch ends,
    if a piece that it leaves out could replace smaller ones of it and waste
    that it is sure to have: the exchange wastes no more.  A branch also ends
    where what is left of all lengths cannot make up less waste than the worst
    kept, and the search where no kept filling has waste or after ``nodes``
    nodes, with what it has.  ``spent`` gets the number of nodes.
    """
    first = best_fit(counts, room, most)
    kept = [(room - sum(a * n for a, n in first), first)]
    lengths = np.flatnonzero(counts[: min(most, room) + 1])[::-1]
    lengths = lengths[lengths > 0].tolist()
    if not lengths or (keep == 1 and not kept[0][0]):
        if spent is not None:
            spent.append(0)
        return kept
    mass = np.concatenate([np.cumsum([a * int(counts[a]) for a in reversed(lengths)])[::-1], [0]]).tolist()
    smallest, left = lengths[-1], nodes
    # Groups (out, sums), as sets of bits: lengths left out since a choice, and what pieces chosen since then can add up to.
    stack = [(0, room, (), ((0, 1),), True)]
    while stack and left > 0:
        i, rest, chosen, groups, grew = stack.pop()
        left -= 1
        worst = kept[-1][0] if len(kept) == keep else room + 1
        if grew and rest < worst and list(chosen) != first:
            kept = sorted([*kept, (rest, list(chosen))], key=lambda x: x[0])[:keep]
            worst = kept[-1][0] if len(kept) == keep else room + 1
            if not worst:
                break
        out, sums = groups[-1]
        while i < len(lengths) and lengths[i] > rest:
            out |= 1 << lengths[i]
            i += 1
        if i == len(lengths) or rest < smallest or rest - min(mass[i], rest) >= worst:
            continue
        a = lengths[i]
        groups = (*groups[:-1], (out, sums))
        for n in range(0, min(int(counts[a]), rest // a) + 1):  # pushed last, popped first: as many as fit
            after = groups
            if n:
                more = []
                for o, m in groups:
                    for _ in range(n):
                        m |= m << a
                    more.append((o, m))
                after = (*more, (0, 1))
            if n < counts[a]:
                after = (*after[:-1], (after[-1][0] | 1 << a, after[-1][1]))
            if not _dominated(after, max(0, rest - n * a - mass[i + 1])):
                stack.append((i + 1, rest - n * a, (*chosen, (a, n)) if n else chosen, after, n > 0))
    if spent is not None:
        spent.append(nodes - left)
    return kept


def complete_bin(counts: np.ndarray, room: int, most: int, nodes: int = SEARCH_NODES, spent: list[int] | None = None) -> list[tuple[int, int]]:
    """The filling of ``room`` with least waste."""
    return fillings(counts, room, most, 1, nodes, spent)[0][1]


def fewest_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins: for each k, pieces over capacity - k share a bin with none of length k or more, and those over half with no other such."""
    many = np.cumsum(counts).tolist()  # pieces of a length or less, and what they add up to
    held = np.cumsum(counts * np.arange(len(counts))).tolist()
    half, best = capacity // 2, 0
    for k in range(half + 1):
        cut = capacity - k
        over, taken = many[cut] - many[half], held[cut] - held[half]
        small = held[half] - (held[k - 1] if k else 0)
        best = max(best, many[capacity] - many[cut] + over + max(0, -(-(small - (over * capacity - taken)) // capacity)))
    return best


def _best_fit_plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    left, out, most = counts.copy(), [], capacity
    while most := _longest(left, most):
        left[most] -= 1
        inside = best_fit(left, capacity - most, most)
        left[most] += 1
        out.append(_apply(left, most, inside))
    return out


def _longest(left: np.ndarray, most: int) -> int:
    while most and not left[most]:
        most -= 1
    return most


def _apply(left: np.ndarray, most: int, inside: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Fill as many bins with ``most`` and ``inside`` as ``left`` allows, and take their pieces from it."""
    need: dict[int, int] = {most: 1}
    for a, n in inside:
        need[a] = need.get(a, 0) + n
    times = min(int(left[a]) // n for a, n in need.items())
    for a, n in need.items():
        left[a] -= times * n
    return times, sorted(need.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, steps: int = PLAN_STEPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, count), ...]) patterns that use up all ``counts``, in as few bins as found.

    Branch and bound over bins.  The best-fit plan is the first incumbent and
    the search ends, proven, once the incumbent meets ``fewest_bins``.  Plans
    with fewer departures from the least wasteful filling come first; among
    these, those that depart at an earlier bin.  A plan ends where its waste
    leaves no room for fewer bins than the incumbent's, and the search, without
    proof, after ``steps`` steps.  The first plan is always finished.
    """
    whole = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        whole[length] = n
    best = _best_fit_plan(whole, capacity)
    bins = sum(times for times, _ in best)
    area = sum(length * n for length, n in counts.items())
    least = fewest_bins(whole, capacity)
    # (departures, bins so far, a number against ties, table, plan as nested pairs, waste, filling to go on with)
    heap: list = [(0, 0, 0, whole, None, 0, None)]
    made = 1
    while heap and bins > least and steps > 0:
        departed, used, _, table, plan, waste, inside = heapq.heappop(heap)
        left, most = table.copy(), capacity
        while most := _longest(left, most):
            if waste > (bins - 1) * capacity - area:
                break
            if inside is None:
                left[most] -= 1
                found = fillings(left, capacity - most, most, BRANCHES)
                left[most] += 1
                steps -= 1
                for more, (_, other) in enumerate(found[1:], 1):
                    if steps > 0:
                        heapq.heappush(heap, (departed + more, used, made, left.copy(), plan, waste, other))
                        made += 1
                inside = found[0][1]
            spare = capacity - most - sum(a * n for a, n in inside)
            pattern = _apply(left, most, inside)
            inside, plan, used, waste = None, (pattern, plan), used + pattern[0], waste + pattern[0] * spare
        else:
            if used < bins:
                bins, best = used, []
                while plan:
                    best.append(plan[0])
                    plan = plan[1]
                best.reverse()
    return best


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text; null texts are empty and have ``end_id`` alone."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(_cutter(tokenizer_path, end_id, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids end with ``end_id``; only longer ones are cut, into pieces of
    ``capacity`` tokens of which the last may be shorter.  Pieces lie gapless
    from offset 0 in their sequence.  Null ids, repeated rows and ties are
    placed row by row; an empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    pieces = stash(token_pieces(docs, tokenizer_path, id_col, text_col, end_id, capacity), "pack-pieces")
    # At most ``capacity`` rows, whatever the input's size.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, first, used = [], 0, dict.fromkeys(counts, 0)
    for times, pattern in plan_bins(counts, capacity):
        offset = 0
        for length, n in pattern:
            slots.append((length, used[length], times * n, n, first, offset))
            used[length] += times * n
            offset += length * n
        first += times
    plan = spark.createDataFrame(slots or [(0, 0, 0, 1, 0, 0)], "length long, lo long, many long, each long, first long, offset0 long")
    by_length = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "many", "each", "first", "offset0"))).alias("slots"))

    salted = pieces.withColumn("h", F.xxhash64("id", "piece")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("m")).select("length", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("h", "id", "piece")) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    # One row per (length, slot) met by a piece: the slot whose range holds the rank.
    slot = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["lo"] + s["many"])), 1)
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("s", slot)
    turn = F.col("rank") - F.col("s.lo")
    return placed.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("s.first") + F.floor(turn / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.offset0") + (turn % F.col("s.each")) * F.col("length")).cast("long").alias("offset"),
    )
