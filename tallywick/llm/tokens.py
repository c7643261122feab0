"""Token ids by the tokenizers library for whole Arrow batches, with a bounded memo of text pieces.

A byte-level BPE splits a text by character class before it merges, so some places are token
borders in any text: after a letter before an ASCII character that is none; before ASCII white space
that follows something else; after a single white-space character other than a space, before a letter.
Texts are cut there (bytes whose class is not certain are not cut at). Pieces repeat a lot; each
distinct one goes to the library once per worker, found again by its 64-bit hash.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import slices, text_buffer
from .hashing import SPACE, segment_hashes

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Pieces remembered in one Python worker (some 40 bytes each); bytes of text encoded at a time.
MEMO, BLOCK = 1_000_000, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ASCII = np.arange(256) < 128
_ENCODERS: dict[str | None, "Encoder"] = {}


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the rows begin."""
    n = len(data)
    space, ascii_ = SPACE[data], _ASCII[data]
    plain = _LETTER[data]
    letter = plain.copy()
    if not ascii_.all():  # U+00C0 to U+00FF without the signs of multiplication and division are letters of two bytes
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        letter[lead] = letter[lead + 1] = True
    cut = np.zeros(n + 1, bool)
    solid = letter | (ascii_ & ~space)
    into_space = solid[:-1] & space[1:]
    cut[1:n] = into_space | (letter[:-1] & ascii_[1:] & ~plain[1:])
    cut[2:n] |= into_space[:-1] & (data[1:-1] != 32) & letter[2:]
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.encode_special_tokens = True  # such strings inside texts are ordinary text
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self.library(texts)
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(n.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(total, self.used), np.uint32)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        at = self.used + np.cumsum(n, dtype=np.int64) - n
        self.used += total
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.n, where, n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint32, row offsets into them) of rows of UTF-8 bytes."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, first, back = np.unique(segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMO:
            self.forget()
        i = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(i, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            self.learn(keys[new], [raw[a:b].decode("utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            i = np.searchsorted(self.keys, keys)
        at, n = self.at[i][back], self.n[i][back].astype(np.int64)
        upto = np.cumsum(n)
        total = int(upto[-1])
        ids = self.pool[np.repeat(at - (upto - n), n) + np.arange(total)]
        return ids, np.append(0, upto)[np.searchsorted(starts, offsets)]

    def rows(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each row of a string column; null is empty."""
        data, offsets = text_buffer(column)
        out: list[np.ndarray] = []
        for i, j in slices(offsets, BLOCK):
            ids, at = self.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out += [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out


def encoder(path: str | None = None) -> Encoder:
    """One per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
