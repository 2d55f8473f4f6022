"""Content-chosen anchors and fingerprints of byte strings, for finding long repeated strings.

Every window of ``length`` bytes has one anchor: the leftmost of the smallest k-mer hashes inside it. Two equal windows
therefore have their anchor at the same offset, so equal windows meet at equal k-mers, and one anchor stands for all
the windows that chose it. All hashes are polynomials modulo 2^64, finished by a mixing step.
"""

from __future__ import annotations

import numpy as np

KMER = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE = np.uint64((1 << 31) - 1)
#: Bytes handled at once; longer texts are cut into overlapping pieces, so memory stays bounded.
PIECE = 1 << 20
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), BASE if kind == "up" else INVERSE)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes; element i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * _power("up", len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) for each pair; the same bytes hash alike wherever they stand."""
    return mix((sums[end] - sums[start]) * _power("down", len(sums))[start] + (end - start).astype(np.uint64))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima of blocks from both ends."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _piece_anchors(data: np.ndarray, length: int):
    sums = prefix_sums(data)
    n = len(data)
    places = np.arange(n - KMER + 1)
    # span_hash over all places, without gathers
    kmers = mix((sums[KMER:] - sums[:-KMER]) * _power("down", len(sums))[: n - KMER + 1] + np.uint64(KMER))
    ranked = (kmers & ~PLACE) | places.astype(np.uint64)
    least = (smallest(ranked, length - KMER + 1) & PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(least, prepend=-1))
    last = np.append(first[1:], len(least)) - 1
    at = least[first]
    return kmers[at], at, first, last, sums


def anchors(data: np.ndarray, length: int):
    """For each run of windows with one anchor: hashes of its k-mer and of all bytes, first and last window, anchor.

    Texts shorter than ``length`` have none. The run's hash also covers the anchor's place in it. A text of more than
    one piece may split a run at a piece border; both parts then count as runs of their own.
    """
    found = []
    for begin in range(0, max(len(data) - length + 1, 0), PIECE):
        part = data[begin : begin + PIECE + length - 1]
        kmer, at, first, last, sums = _piece_anchors(part, length)
        whole = span_hash(sums, first, last + length) ^ mix((at - first).astype(np.uint64))
        found.append((kmer, whole, first + begin, last + begin, at + begin))
    if not found:
        return (*(np.empty(0, np.uint64) for _ in range(2)), *(np.empty(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each start; starts ascend. Works through the text piece by piece."""
    out = np.empty(len(starts), np.uint64)
    for begin in range(0, max(len(data) - length + 1, 0), PIECE):
        lo, hi = np.searchsorted(starts, (begin, begin + PIECE))
        if lo < hi:
            sums = prefix_sums(data[begin : begin + PIECE + length - 1])
            at = starts[lo:hi] - begin
            out[lo:hi] = span_hash(sums, at, at + length)
    return out
