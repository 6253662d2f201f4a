"""Words of Arrow text columns as 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes of a class. The classes used here are sets of ASCII
characters and all bytes of other characters, so that runs of bytes are runs of code
points. The hash is a polynomial of random byte values, mixed; words above ``LONG``
bytes are hashed by BLAKE2.
"""
from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LONG = 256
#: Bytes worked on at a time; a longer word is worked on whole.
BLOCK = 1 << 17

_random = np.random.default_rng(20240607)
_VALUES = _random.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _class(separators) -> np.ndarray:
    """Byte to byte: 0 for separators, A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: ``[^\x20\x09-\x0D]+``; NUL is a character of words here, mapped to a byte UTF-8 never has.
BLANK = _class([0x20, *range(0x09, 0x0E)])
BLANK[0] = 0xFF
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LINE = np.arange(256, dtype=np.uint8)
LINE[10], LINE[0] = 0, 0xFF


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of all but its last item and its last item."""
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right)


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64."""
    if len(_powers[0]) < n:
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Per word: hash, and first and last byte (exclusive) in ``data``; ``rows`` has where each row's words begin."""
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where its rows begin; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, table: np.ndarray) -> Words:
    data, offsets = buffers(texts)
    starts, ends, hashes = [], [], []
    at, size = 0, len(data)
    first = np.zeros(size + 1, bool)
    first[offsets] = True
    while at < size:
        to = min(size, at + BLOCK)
        while to < size and not first[to] and table[data[to]]:  # not within a word
            ahead = to + 1
            stop = np.flatnonzero((table[data[ahead: ahead + 4096]] == 0) | first[ahead: ahead + 4096][:size - ahead])
            to = ahead + int(stop[0]) if len(stop) else min(size, ahead + 4096)
        got = table[data[at:to]]
        inside = got != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[at + 1: to]
        s = np.flatnonzero(begins)
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:] | first[at + 1: to]
        e = np.flatnonzero(finishes) + 1
        power, inverse = _up_to(max(BLOCK, to - at) + 1)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(_VALUES[got] * power[: to - at], out=sums[1:])
        h = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        for i in np.flatnonzero(e - s > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(got[s[i]: e[i]].tobytes(), digest_size=8).digest(), "little")
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = to
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    end = np.concatenate(ends) if ends else np.empty(0, np.int64)
    hashed = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return Words(hashed, start, end, np.searchsorted(start, offsets), data, offsets)


def hash_words(strings: list[str], table: np.ndarray) -> list[np.ndarray]:
    """The word hashes of each text of a list."""
    found = words(pa.array(strings, pa.large_string()), table)
    return [found.hashes[a:b] for a, b in zip(found.rows[:-1], found.rows[1:])]


def slices(batches, limit: int = 1 << 23, text: str = "text"):
    """Record batches cut so that each has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
