"""Two-stage suffix sorting of a bounded text, to a bounded depth."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts right after it; the last is not."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    rises = text[:-1] < text[1:]
    turns = np.flatnonzero(text[:-1] != text[1:])
    nxt = np.searchsorted(turns, np.arange(n - 1))
    known = nxt < len(turns)
    out[:-1][known] = rises[turns[nxt[known]]]
    return out


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(_U)


def _order_pairs(words: np.ndarray, order: np.ndarray, at: np.ndarray, after: np.ndarray, done: int, depth: int) -> None:
    """Put the suffixes at places ``at`` and ``after`` of ``order``, equal in ``done`` symbols, in order."""
    for step in range(done, depth, 8):
        one, two = words[order[at] + step], words[order[after] + step]
        turned = np.flatnonzero(one > two)
        order[at[turned]], order[after[turned]] = order[after[turned]], order[at[turned]]
        tied = one == two
        at, after = at[tied], after[tied]
        if not len(at):
            break


def _direct_sort(text: np.ndarray, codes: np.ndarray, at: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of their suffixes' first ``depth`` symbols, ties in any order.

    Groups of equal prefixes are refined by as many symbols as fit beside the
    group's number in 64 bits; suffixes alone in their group are done, and two
    of a group are compared.
    """
    if len(at) < 2:
        return at
    per = max(1, (62 - int(len(at)).bit_length()) // bits)
    padded = np.concatenate([codes, np.zeros(depth + per, codes.dtype)]).astype(_U)
    packed = np.zeros(len(padded) - per + 1, _U)
    for j in range(per):
        packed |= padded[j : len(packed) + j] << _U(bits * (per - 1 - j))
    words = _words(text, depth)
    order = at.copy()
    open_at = np.arange(len(at))  # places in ``order`` whose group has more than two
    group = np.zeros(len(at), np.int64)
    for done in range(0, depth, per):
        key = packed[order[open_at] + done]
        if depth - done < per:
            key = key >> _U(bits * (per - (depth - done)))
        key = (group.astype(_U) << _U(bits * per)) | key
        by = np.argsort(key)
        key = key[by]
        order[open_at] = order[open_at[by]]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        _order_pairs(words, order, open_at[two], open_at[two + 1], done + per, depth)
        larger = sizes > 2
        open_at = open_at[np.repeat(larger, sizes)]
        if not len(open_at):
            break
        group = np.repeat(np.arange(int(larger.sum())), sizes[larger])
    return order


def sort_suffixes(text: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first ``depth`` bytes.

    The suffixes marked in ``needed`` are sorted, and those that their order
    follows from.  Only suffixes smaller than their successors are compared
    directly; the rest are induced: reading the order from its start, bucket by
    bucket of the first byte, the suffix one place before each one read goes to
    the next free place of its own bucket.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    small = smaller_than_next(text)
    # A larger suffix follows from its successor, down to the next smaller one or the end.
    wanted = needed.copy()
    stops = np.flatnonzero(small | (np.arange(n) == n - 1))
    until = stops[np.searchsorted(stops, np.flatnonzero(needed))]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(needed), 1)
    np.add.at(cover, until + 1, -1)
    wanted |= np.cumsum(cover[:-1]) > 0
    alphabet = np.unique(text)
    codes = np.zeros(256, np.uint16)
    codes[alphabet] = np.arange(1, len(alphabet) + 1)
    direct = _direct_sort(text, codes[text], np.flatnonzero(wanted & small), max(1, int(len(alphabet)).bit_length()), depth)
    edges = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))
    follows = wanted & ~small
    out = []

    def read(batch: np.ndarray) -> None:
        out.append(batch)
        before = batch[batch > 0] - 1
        before = before[follows[before]]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            first = text[before]
            edge = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                induced[first[x]].append(before[x:y])

    for c in alphabet.tolist():
        at = 0
        while at < len(induced[c]):  # reading may add to this very bucket
            batch, at = induced[c][at:], len(induced[c])
            read(np.concatenate(batch))
        read(direct[edges[c] : edges[c + 1]])
    return np.concatenate(out)


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``order``, at most ``depth``."""
    out = np.zeros(len(order), np.int64)
    words = _words(text, depth)
    left = np.arange(1, len(order))
    for done in range(0, depth, 8):
        if not len(left):
            break
        differ = words[order[left] + done] ^ words[order[left - 1] + done]
        apart = differ != 0
        lead = np.zeros(int(apart.sum()), np.int64)
        rest = differ[apart]
        for j in range(1, 8):
            lead += (rest >> _U(64 - 8 * j)) == 0
        out[left[apart]] = np.minimum(done + lead, depth)
        left = left[~apart]
    out[left] = depth
    ends = len(text) - np.maximum(order[1:], order[:-1])
    out[1:] = np.minimum(out[1:], ends)
    return out
