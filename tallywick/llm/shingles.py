"""Distinct word shingles of whole Arrow batches, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .hashing import LOWER, mix, segment_hashes, word_bounds

WORDS = 5
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): the distinct shingles of each row, ascending. A-Z count as lower case.

    A row of fewer words has its whole sequence as one shingle; one without words has none.
    """
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    h = segment_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.cumsum(count) - count
    row = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][row] + np.arange(len(row)) - at[row]
    padded = np.append(h, np.zeros(words, np.uint64))
    value = np.zeros(len(row), np.uint64)
    left = np.minimum(first[1:][row] - begin, words)
    for i in range(words):
        here = np.where(left > i, padded[begin + i], np.uint64(i))
        value = mix(value * np.uint64(3) + here * _STEPS[i % len(_STEPS)])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(n) + 1))
