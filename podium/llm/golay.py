"""The binary Golay code of 23 bits: every word lies within three bits of exactly one of its 4,096 codewords."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH = 23
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


#: Remainders of the upper twelve bits; the lower eleven bits are a remainder already.
UPPER = np.array([_remainder(m << 11) for m in range(1 << 12)], np.uint32)

#: The one error pattern of at most three bits for each remainder.
ERROR = np.zeros(1 << 11, np.uint32)
for _size in range(4):
    for _bits in combinations(range(LENGTH), _size):
        _error = sum(1 << b for b in _bits)
        ERROR[_remainder(_error)] = _error


def index(words: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the codeword nearest to each word of 23 bits."""
    words = words.astype(np.uint32)
    return (words ^ ERROR[UPPER[words >> 11] ^ (words & 0x7FF)]) >> 11
