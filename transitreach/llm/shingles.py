"""Word shingles of whole texts as 64-bit hashes, and b-bit MinHash signatures (numpy)."""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK_BYTES = 1_500_000

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]      # A-Z lower-cased
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and the bounds of each text's words.

    A word is a maximal run of bytes other than white space, A-Z lower-cased; its
    hash is a polynomial over random byte values, mixed with its length.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    space = _SPACE[data]
    after = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(after & ~space)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    lens = np.flatnonzero(space & ~after) - starts
    solid = np.flatnonzero(~space)
    terms = _BYTE[data[solid]] * powers(int(lens.max()))[solid - np.repeat(starts, lens)]
    sums = np.add.reduceat(terms, np.cumsum(lens) - lens)
    return mix64(sums + lens.astype(np.uint64) * _BASE), bounds


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    words, bounds = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        rolled += words[i:i + n] * _WORD[i]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            short = (words[a:b] * _WORD[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short ^ _BASE], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    raw = hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def minima(sets: list[np.ndarray], hashes: int, seed: int = 7) -> np.ndarray:
    """(non-empty sets, hashes) minima of the sets under random linear maps."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size=hashes, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, size=hashes, dtype=np.uint64)
    out = np.empty((len(sets), hashes), dtype=np.uint64)
    block = 1 << 15                  # values mapped at a time: they stay in the processor's cache
    at = 0
    while at < len(sets):
        to, held = at, 0
        while to < len(sets) and (to == at or held + len(sets[to]) <= block):
            held += len(sets[to])
            to += 1
        if to == at + 1:
            whole = sets[at]
            low = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
            for s in range(0, len(whole), block):
                x = whole[s:s + block]
                for i in range(hashes):
                    low[i] = min(low[i], (x * a[i] + b[i]).min())
            out[at] = low
        else:
            x = np.concatenate(sets[at:to])
            starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at:to - 1]]))).astype(np.int64)
            for i in range(hashes):
                out[at:to, i] = np.minimum.reduceat(x * a[i] + b[i], starts)
        at = to
    return out


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) signed longs: a hash of each band's minima and its number."""
    sets, hashes = low.shape
    bands = hashes // rows
    grouped = low[:, :bands * rows].reshape(sets, bands, rows)
    keys = (mix64(grouped) * _WORD[:rows]).sum(axis=2, dtype=np.uint64)
    return mix64(keys + np.arange(1, bands + 1, dtype=np.uint64) * _BASE).view(np.int64)


def bit_planes(low: np.ndarray, bits: int) -> np.ndarray:
    """(sets, bits * hashes / 64) signed longs.

    The lowest ``bits`` bits of each mixed minimum, packed plane after plane: bit
    0 of all minima, then bit 1, and so on.  Two signatures agree in a minimum
    where no plane differs.
    """
    sets, hashes = low.shape
    kept = mix64(low)
    planes = []
    for bit in range(bits):
        flags = ((kept >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        planes.append(np.packbits(flags, axis=1, bitorder="little").view("<i8"))
    return np.concatenate(planes, axis=1) if sets else np.zeros((0, bits * hashes // 64), dtype=np.int64)
