"""Counting quotient filters over packed word-id n-grams (numpy): lossless and compact.

An n-gram of ids of ``bits`` bits is packed into two halves, ``hi`` with the first ids and
``lo`` with the rest, and permuted within its ``n * bits`` bits by a Feistel network, so any
set of n-grams spreads evenly and the n-gram can be had back.  The high bits of the permuted
value are the quotient.  A filter has a slot per quotient with the length of its run, the full
remainders in order, and a counter each (a byte, larger ones listed apart).  Nothing is
approximate: quotient and remainder are the whole value.

Filters of one quotient prefix (a block) are merged by adding the counters of equal values.
"""

from __future__ import annotations

import struct

import numpy as np

from .shingles import mix64

_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03,
                                0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_HEAD = struct.Struct("<BBBBIQ")
ESCAPE = 255                     # counters from here on stand in the list of large ones


def halves(n: int, bits: int) -> tuple[int, int]:
    """The widths of ``hi`` and ``lo`` for n-grams of ids of ``bits`` bits."""
    return (n + 1) // 2 * bits, n // 2 * bits


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(hi: np.ndarray, lo: np.ndarray, wide: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    for a, b in zip(_KEYS[::2], _KEYS[1::2]):
        lo = lo ^ (mix64(hi + a) & _mask(low))
        hi = hi ^ (mix64(lo + b) & _mask(wide))
    return hi, lo


def restore(hi: np.ndarray, lo: np.ndarray, wide: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permute``."""
    for a, b in list(zip(_KEYS[::2], _KEYS[1::2]))[::-1]:
        hi = hi ^ (mix64(lo + b) & _mask(wide))
        lo = lo ^ (mix64(hi + a) & _mask(low))
    return hi, lo


def counted(hi: np.ndarray, lo: np.ndarray, wide: int, low: int, counts: np.ndarray | None = None) -> tuple:
    """Sorted distinct values with their summed counts (1 each where none are given)."""
    if wide + low <= 64:
        key = (hi << np.uint64(low)) | lo
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=bool)
        hi, lo = key >> np.uint64(low), key & _mask(low)
    else:
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        counts = None if counts is None else counts[order]
        new = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))) if len(hi) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.append(at, len(new)))
    else:
        sums = np.add.reduceat(counts, at) if len(at) else counts
    return hi[at], lo[at], sums.astype(np.int64)


def _narrow(values: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    width = -(-bits // 8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = raw.reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64)


def encode(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, wide: int, low: int, prefix: int, prefix_bits: int) -> bytes:
    """The filter of sorted distinct values that share the first ``prefix_bits`` bits."""
    n = len(hi)
    q = min(wide, prefix_bits + max(0, n.bit_length() - 1))       # about one slot a value
    rest = wide - q
    runs = np.bincount(((hi >> np.uint64(rest)) - np.uint64(prefix << (q - prefix_bits))).astype(np.int64),
                       minlength=1 << (q - prefix_bits))
    size = 1 if runs.max(initial=0) < 256 else 4
    large = counts >= ESCAPE
    return b"".join([
        _HEAD.pack(wide, low, q, size | prefix_bits << 3, n, prefix), runs.astype(f"<u{size}").tobytes(),
        _narrow(hi & _mask(rest), rest), _narrow(lo, low), np.where(large, ESCAPE, counts).astype(np.uint8).tobytes(),
        counts[large].astype("<i8").tobytes()])


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hi, lo, counts`` of a filter, sorted."""
    wide, low, q, packed, n, prefix = _HEAD.unpack_from(data)
    size, prefix_bits = packed & 7, packed >> 3
    raw, at = np.frombuffer(data, dtype=np.uint8), _HEAD.size
    slots, rest = 1 << (q - prefix_bits), wide - q

    def take(count):
        nonlocal at
        at += count
        return raw[at - count:at]

    runs = take(slots * size).view(f"<u{size}")
    quotients = np.repeat(np.arange(slots, dtype=np.uint64), runs) + np.uint64(prefix << (q - prefix_bits))
    hi = (quotients << np.uint64(rest)) | _wide(take(n * -(-rest // 8)), n, rest)
    lo = _wide(take(n * -(-low // 8)), n, low)
    counts = take(n).astype(np.int64)
    counts[counts == ESCAPE] = np.frombuffer(raw[at:].tobytes(), dtype="<i8")
    return hi, lo, counts


def filters(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, wide: int, low: int, prefix_bits: int):
    """``(block, filter)`` of sorted distinct values, one for each prefix in use."""
    prefix_bits = min(prefix_bits, wide)
    blocks = (hi >> np.uint64(wide - prefix_bits)).astype(np.int64) if prefix_bits else np.zeros(len(hi), dtype=np.int64)
    at = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))) if len(blocks) else []
    for a, b in zip(at, [*at[1:], len(blocks)]):
        yield int(blocks[a]), encode(hi[a:b], lo[a:b], counts[a:b], wide, low, int(blocks[a]), prefix_bits)


def merged(parts: list[bytes], wide: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of filters, as sorted distinct values with their counts."""
    read = [decode(p) for p in parts]
    return counted(*(np.concatenate([r[i] for r in read]) for i in (0, 1)), wide, low,
                   np.concatenate([r[2] for r in read]))
