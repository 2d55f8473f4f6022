"""Hashed character n-grams of a text, by array operations on its code points."""

from __future__ import annotations

import numpy as np

ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
#: Code points handled at once, so that memory does not follow the length of a text.
PIECE = 1 << 18


def _hashes(points: np.ndarray, sizes: tuple[int, ...], bits: int):
    """Bucket of every n-gram, one array for each size."""
    shift = np.uint32(32 - bits)
    for n in sizes:
        count = len(points) - n + 1
        if count <= 0:
            continue
        h = np.full(count, np.uint32(n * 0x1003F), np.uint32)
        for k in range(n):
            h ^= points[k : k + count] * ODD[k]
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x297A2D39)
        yield h >> shift


def buckets(text: str, sizes: tuple[int, ...], bits: int):
    """Arrays of bucket numbers of all n-grams of the whole text; pieces overlap by the longest n-gram less one."""
    overlap = max(sizes) - 1
    for begin in range(0, max(len(text), 1), PIECE):
        part = text[begin : begin + PIECE + overlap]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        for n, found in zip([n for n in sizes if len(points) >= n], _hashes(points, sizes, bits), strict=True):
            # an n-gram that starts in the overlap belongs to the next piece
            yield found[: min(len(found), PIECE)] if begin + PIECE < len(text) else found


def presence(text: str, sizes: tuple[int, ...], bits: int, wanted: np.ndarray) -> np.ndarray:
    """Sorted numbers (wanted[bucket] >= 0) of the features that occur in the text."""
    hits = [x[x >= 0] for x in (wanted[b] for b in buckets(text, sizes, bits))]
    return np.unique(np.concatenate(hits)) if hits else np.empty(0, wanted.dtype)


def frequencies(text: str, sizes: tuple[int, ...], bits: int, doubt: float = 0.0) -> np.ndarray:
    """Square roots of the n-grams' shares: a vector of length 1, and zero for a text without n-grams.

    ``doubt`` is a number of n-grams that are taken to be unseen; it draws the vector of a short text towards zero.
    """
    counts = np.zeros(1 << bits, np.float64)
    for found in buckets(text, sizes, bits):
        counts += np.bincount(found, minlength=1 << bits)
    total = counts.sum()
    return np.sqrt(counts / (total + doubt)).astype(np.float32) if total else counts.astype(np.float32)
