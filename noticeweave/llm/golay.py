"""The binary Golay code of length 23, in numpy.

Every word of 23 bits is at most three bits from exactly one of 4096 codewords. Two words that differ in at most two bits have
a common neighbour (a word at most one bit from each), so the codewords nearest to all neighbours of one word
and to those of the other have one in common.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
#: Fixed value: the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 bits and of the high 11, and for each remainder the error of up to three bits."""
    single = [_remainder(1 << b) for b in range(LENGTH)]

    def spread(bits: list[int]) -> np.ndarray:
        table = np.zeros(1 << len(bits), np.int32)
        for i, r in enumerate(bits):
            table[1 << i : 2 << i] = table[: 1 << i] ^ r
        return table

    errors = np.zeros(1 << CHECKS, np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            errors[np.bitwise_xor.reduce([single[b] for b in bits])] = sum(1 << b for b in bits)
    return spread(single[:12]), spread(single[12:]), errors


def decode(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of each word's nearest codeword."""
    low, high, errors = _tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECKS


def near(words: np.ndarray, bits: int) -> np.ndarray:
    """Codeword numbers of each word (first column) and of its neighbours in the low bits; -1 for repeated ones."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(words.dtype)
    found = decode(words[:, None] ^ flips)
    own = found[:, :1]
    rest = np.sort(found[:, 1:], axis=1)
    same = np.concatenate([np.zeros((len(words), 1), bool), rest[:, 1:] == rest[:, :-1]], 1) | (rest == own)
    return np.concatenate([own, np.where(same, -1, rest)], 1)


def flipped(words: np.ndarray, bits: int) -> np.ndarray:
    """Codeword numbers of the words one bit from each word, in the low bits; -1 for repeated ones."""
    flips = (1 << np.arange(bits)).astype(words.dtype)
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    same = np.concatenate([np.zeros((len(words), 1), bool), found[:, 1:] == found[:, :-1]], 1)
    return np.where(same, -1, found)
