"""The binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit words.

Every 23-bit word lies within three bits of exactly one codeword. The *near keys* of a word are the indices of the
codewords that it and its 23 one-bit neighbours decode to: one index if the word is within two bits of its
codeword, six otherwise. So words one bit apart share the plain index of the one with a near key of the other, and
words two bits apart share a near key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE = 23, 12
#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of the words as polynomials modulo the generator."""
    left = np.asarray(words, dtype=np.int64).copy()
    for power in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        left ^= ((left >> power) & 1) * (GENERATOR << (power - (LENGTH - MESSAGE)))
    return left


@cache
def leaders() -> np.ndarray:
    """The error pattern of up to three bits for each of the 2,048 syndromes."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(LENGTH), n)], dtype=np.int64)
    table = np.zeros(1 << (LENGTH - MESSAGE), dtype=np.int64)
    table[syndrome(errors)] = errors
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4,095) of the codeword within three bits."""
    words = np.asarray(words, dtype=np.int64)
    return (words ^ leaders()[syndrome(words)]) >> (LENGTH - MESSAGE)


def near_keys(words: np.ndarray) -> np.ndarray:
    """Near keys of each word: six columns, ascending, the same index again where there are fewer."""
    words = np.asarray(words, dtype=np.int64)
    if not len(words):
        return np.zeros((0, 6), dtype=np.int64)
    around = np.concatenate([[0], 1 << np.arange(LENGTH, dtype=np.int64)])
    found = np.sort(decode((words[:, None] ^ around[None, :]).ravel()).reshape(len(words), -1), axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    rank = np.cumsum(first, axis=1) - 1
    out = np.repeat(found[:, :1], 6, axis=1)
    rows, cols = np.nonzero(first)
    out[rows, rank[rows, cols]] = found[rows, cols]
    return out
