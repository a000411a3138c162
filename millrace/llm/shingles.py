"""Words and word shingles of many texts at once, as 64-bit hashes (numpy, for use inside Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8, so powers keep their period
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(range(256)).lower()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, 2 * len(_powers), 256), _BASE, np.uint64)
            grown[0] = 1
            _powers = np.multiply.accumulate(grown)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` (A-Z lowered, split at ASCII white space) and the number of words of each."""
    data = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    inside = ~_IS_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        values = _BYTE_VALUES[data[at]] * powers(int(lengths.max()))[place]
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        return mix(sums + lengths.astype(np.uint64) * _M1), counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words of one text; a shorter text is one window, an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            h = mix(h * _BASE + words[k : n - width + 1 + k])
    return h


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    at = 0
    for n in counts.tolist():
        yield np.unique(shingle_hashes(words[at : at + n], size))
        at += n
