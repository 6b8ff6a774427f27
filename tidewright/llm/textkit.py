"""Vectorised hashes of bytes, words and windows, and content-chosen anchors.

Window and span hashes are polynomials over the ring of 64-bit integers, read
off prefix sums, and mixed by a fixed bijection afterwards.  Unequal contents
can share one (long words of a certain pattern do whatever the root), so these
hashes only say what may be equal.  What counts as equal is decided on the bytes
themselves, or on BLAKE2b digests of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_U = np.uint64
_MASK = (1 << 64) - 1
_ROOTS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SLICE_BYTES = 64 << 10  # arrays over a slice stay in a core's cache
_PLACE = (1 << 32) - 1
DIGEST_BYTES = 16


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root and of its inverse, n of them at least."""
    up, down = _powers.get(which, (np.empty(0, _U), np.empty(0, _U)))
    if len(up) < n:
        size = max(n + (n >> 3), 1 << 17)
        root = _ROOTS[which]
        inverse = pow(root, -1, 1 << 64)
        up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, r, _U)])) for r in (root, inverse))
        _powers[which] = up, down
    return up[:n], down[:n]


def byte_values(lower: bool = False) -> np.ndarray:
    """A random-looking 64-bit value for each byte; with ``lower`` A-Z have those of a-z."""
    table = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))
    if lower:
        table[65:91] = table[97:123]
    return table


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def windows(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive values."""
    n = len(values)
    if n < k:
        return np.empty(0, _U)
    up, down = powers(n + 1, which)
    sums = np.zeros(n + 1, _U)
    np.cumsum(values * up[:n], out=sums[1:])
    out = sums[k:] - sums[: n - k + 1]
    out *= down[: n - k + 1]
    return mix(out)


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of values[start:end] for each pair."""
    n = len(values)
    up, down = powers(n + 1, which)
    sums = np.zeros(n + 1, _U)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x2545F4914F6CDD1D))


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w keys."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.empty(0, keys.dtype)
    if w == 1:
        return keys.copy()
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about ``most`` bytes; null texts are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the offsets of its texts in them."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words of a slice with one space after each, and where they start in that, the end included."""
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(begin[-1], 32, np.uint8)
    word = np.repeat(np.arange(len(lengths)), lengths)
    source = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[word]
    out[np.arange(len(word)) + word] = data[source]
    return out.tobytes(), begin


def digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=DIGEST_BYTES).digest()


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Words numbered by their bytes: equal words, and only they, have a number in common; and the words by number."""
    if not len(starts):
        return np.empty(0, np.int64), []
    edges = np.empty(2 * len(starts), np.int64)  # words and what lies between them in turn
    edges[0::2], edges[1::2] = starts, ends
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = whole.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def chosen_runs(values: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``window`` values that share their anchor.

    A window's anchor is the first of its k-grams with the least upper half of
    the hash, whatever slice it is found in.  Equal windows have the same
    anchor at the same place, whatever surrounds them, so all copies of a
    window lie in runs with one anchor hash.  Returns for each run the text's
    number, the first window (from the text's start), how many windows there
    are, the anchor's hash and its distance from the first window.
    """
    grams = windows(values, k)
    none = np.empty(0, np.int64)
    w = window - k + 1
    if len(grams) < w:
        return none, none, none, np.empty(0, _U), none
    keys = (grams & _U(_MASK ^ _PLACE)) | np.arange(len(grams), dtype=_U)
    place = (sliding_min(keys, w) & _U(_PLACE)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1
    fits = np.arange(len(place)) + window <= offsets[text + 1]
    new = fits.copy()
    new[1:] &= ~fits[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return none, none, none, np.empty(0, _U), none
    sums = np.concatenate([[0], np.cumsum(fits)])
    many = np.diff(np.concatenate([sums[begin], sums[-1:]]))
    return text[begin], begin - offsets[text[begin]], many, grams[place[begin]], place[begin] - begin
