"""The perfect binary Golay code of length 23: decoding tables for fuzzy keys.

Each of the ``2**23`` words lies within three bits of exactly one of the 4096 codewords. Two words that differ in one bit share a
key if one gives the codeword nearest to itself and the other the codewords nearest to any word within one bit of itself.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LENGTH, MESSAGE = 23, 12
_GENERATOR = 0b110001110101


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each low and high half of a word, as two tables to be xored."""
    check = LENGTH - MESSAGE

    def remainder(word: int) -> int:
        for bit in range(LENGTH - 1, check - 1, -1):
            if word >> bit & 1:
                word ^= _GENERATOR << (bit - check)
        return word

    unit = [remainder(1 << bit) for bit in range(LENGTH)]
    low, high = np.zeros(1 << 12, dtype=np.uint16), np.zeros(1 << 11, dtype=np.uint16)
    for table, shift in ((low, 0), (high, 12)):
        for value in range(1, len(table)):
            bit = value.bit_length() - 1
            table[value] = table[value ^ (1 << bit)] ^ unit[bit + shift]
    return low, high


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[words & 0xFFF] ^ high[words >> 12]


@cache
def _leaders() -> np.ndarray:
    """The error of at most three bits that has each syndrome."""
    unit = [1 << bit for bit in range(LENGTH)]
    errors = [0, *unit]
    errors += [a | b for i, a in enumerate(unit) for b in unit[:i]]
    errors += [a | b | c for i, a in enumerate(unit) for j, b in enumerate(unit[:i]) for c in unit[:j]]
    errors = np.array(errors, dtype=np.uint32)
    leaders = np.zeros(1 << (LENGTH - MESSAGE), dtype=np.uint32)
    leaders[syndrome(errors)] = errors
    return leaders


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each word."""
    words = words.astype(np.uint32)
    return (words ^ _leaders()[syndrome(words)]) >> np.uint32(LENGTH - MESSAGE)


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct codeword indices nearest to a word within one bit of each word: row numbers, and indices."""
    words = words.astype(np.uint32)
    around = words[:, None] ^ np.concatenate(([0], 1 << np.arange(LENGTH))).astype(np.uint32)
    found = np.sort(decode(around), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(fresh)[0], found[fresh]
