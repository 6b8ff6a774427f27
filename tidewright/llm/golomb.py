"""Golomb codes of sorted unsigned 64-bit fingerprints."""

from __future__ import annotations

import math

import numpy as np


def parameter(n: int, span: int) -> int:
    """The divisor that suits ``n`` values spread evenly over ``span``."""
    return max(1, math.ceil(math.log(2) * span / max(n, 1)))


def encode(values: np.ndarray, base: int, m: int) -> bytes:
    """Code ascending distinct ``values`` (uint64) as gaps from ``base``.

    A gap is its quotient by ``m`` in unary (ones, then a zero) and its
    remainder in truncated binary.  The quotients of all gaps come first, then
    the bits that all remainders have, then the last bit of those with one more,
    so that each part is read at once.
    """
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(base))
    q, r = gaps // np.uint64(m), gaps % np.uint64(m)
    width, short = _remainders(m)
    is_long = r >= np.uint64(short)
    coded = np.where(is_long, r + np.uint64(short), r << np.uint64(1))  # ``width`` bits, the last one without meaning if short
    stops = np.cumsum(q.astype(np.int64) + 1)
    unary = np.ones(int(stops[-1]), np.uint8)
    unary[stops - 1] = 0
    common = np.zeros((len(values), max(width - 1, 0)), np.uint8)
    for j in range(width - 1):
        common[:, j] = (coded >> np.uint64(width - 1 - j)) & np.uint64(1)
    last = (coded[is_long] & np.uint64(1)).astype(np.uint8) if width else np.empty(0, np.uint8)
    return np.packbits(np.concatenate([unary, common.ravel(), last])).tobytes()


def _remainders(m: int) -> tuple[int, int]:
    """Bits of the longer remainders, and how many remainders have one bit less."""
    width = (m - 1).bit_length()
    return width, (1 << width) - m


def decode(code: bytes, n: int, base: int, m: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    width, short = _remainders(m)
    stops = np.flatnonzero(bits == 0)[:n]
    q = np.diff(stops, prepend=-1) - 1
    at = int(stops[-1]) + 1
    r = np.zeros(n, np.uint64)
    for j in range(width - 1):
        r = (r << np.uint64(1)) | bits[at + j : at + n * (width - 1) : width - 1].astype(np.uint64)
    if width:
        is_long = r >= np.uint64(short)
        at += n * (width - 1)
        r[is_long] = (r[is_long] << np.uint64(1)) + bits[at : at + int(is_long.sum())].astype(np.uint64) - np.uint64(short)
    gaps = q.astype(np.uint64) * np.uint64(m) + r
    gaps[0] += np.uint64(base)
    return np.cumsum(gaps, dtype=np.uint64)
