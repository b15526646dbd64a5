"""The binary Golay code of length 23 as a fuzzy hash.

The code is perfect: every 23-bit word is within 3 bits of one codeword, and a codeword is named by its 12
message bits.  The keys of a word are all codewords within 4 bits of it: 1, or 6 if the nearest is 3 bits away.  If
two words differ in one bit, the codeword nearest to either is within 4 bits of the other: they share a key.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

LENGTH, MESSAGE = 23, 12
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101
_CHECK = LENGTH - MESSAGE


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, _CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - _CHECK)
    return word


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits; for each remainder its errors of at most 4 bits, -1 padded."""
    low = np.array([_remainder(x) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], dtype=np.int64)
    errors: list[list[int]] = [[] for _ in range(1 << _CHECK)]
    for weight in range(5):
        for bits in itertools.combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            errors[low[e & 0xFFF] ^ high[e >> 12]].append(e)
    table = np.full((1 << _CHECK, 6), -1, dtype=np.int64)
    for k, found in enumerate(errors):
        # the nearest codeword comes first; those at 4 bits count beside one at 3 bits only
        table[k, : len(found)] = found
    return low, high, table


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the row of each key, and the key, a codeword's 12 message bits."""
    low, high, table = _tables()
    words = words.astype(np.int64)
    errors = table[low[words & 0xFFF] ^ high[words >> 12]]
    row, column = np.nonzero(errors >= 0)
    return row, (words[row] ^ errors[row, column]) >> _CHECK
