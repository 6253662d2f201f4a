"""Benchmark decontamination: an FM-index of each training shard, searched for every window of the benchmark.

The benchmark's words are its alphabet. A shard (a slice of a task's documents, some
megabytes) keeps the runs of at least as many words of that alphabet as the shortest
window has; no window occurs elsewhere. Over these runs stands an FM-index: the
Burrows-Wheeler transform in a wavelet matrix, with every ``SAMPLE``-th suffix position.
All windows are searched backwards at once, their occurrences located by walking to a
sampled position, and the occurrences merged into spans of hit words.

The benchmark goes to the workers in blocks of at most ``BLOCK_BYTES`` (an item above it
alone in one), one pass over the documents for each block; documents are never shuffled.

Defined results: null and empty texts have no words and no hits. Items without text,
words or id are left out; items with one id count once. A benchmark without windows hits
nothing. Repeated documents and documents without an id are judged row by row.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import must_be_free
from .words import ALNUM, hash_words, slices, words

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 1 << 22
BLOCK_BYTES = 16 << 20
#: Symbols of the index before the words: the end of all, and the end of a run.
END, GAP, FIRST = 0, 1, 2


class Windows(NamedTuple):
    """``alphabet``: sorted word hashes; ``symbols``: a row per window, filled with -1; windows' items as ``first``, ``item``."""
    alphabet: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    item: np.ndarray
    names: list


def windows_of(items: list[tuple[str, str]], width: int = WINDOW) -> Windows:
    names = sorted({name for name, _ in items})
    place = {name: i for i, name in enumerate(names)}
    hashed = hash_words([text for _, text in items], ALNUM)
    alphabet = np.unique(np.concatenate([*hashed, np.empty(0, np.uint64)]))
    held: dict[bytes, set] = {}
    for (name, _), h in zip(items, hashed):
        symbols = np.searchsorted(alphabet, h).astype(np.int32) + FIRST
        for at in range(max(1, len(symbols) - width + 1) if len(symbols) else 0):
            held.setdefault(symbols[at: at + width].tobytes(), set()).add(place[name])
    table = np.full((len(held), width), -1, np.int32)
    lengths = np.zeros(len(held), np.int64)
    for row, key in enumerate(held):
        got = np.frombuffer(key, np.int32)
        table[row, : len(got)], lengths[row] = got, len(got)
    first = np.cumsum([0, *(len(x) for x in held.values())])
    item = np.array([i for x in held.values() for i in sorted(x)], np.int64)
    return Windows(alphabet, table, lengths, first, item, names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling the compared length; the last symbol is the least and occurs once."""
    size = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        after = np.zeros(size, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (size + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(size, np.int64)
        new[0] = 0
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        step *= 2
        if rank[order[-1]] == size - 1 or step >= size:
            return order


class Index:
    """FM-index of a sequence of symbols."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        last = text[order - 1]
        size = int(text.max()) + 1
        self.size, self.n = size, len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):  # the wavelet matrix
            bit = (last >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        kept = order % sample == 0
        self.sampled = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        self.kept, self.positions = kept, order[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row of the transform."""
        low, high = np.zeros_like(row), row.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one symbol earlier."""
        symbol, at, low = np.zeros_like(row), row.copy(), np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] - ones[at] == 1
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
            low = np.where(one, zeros + ones[low], low - ones[low])
        return self.before[symbol] + at - low

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows (from, to) whose suffixes begin with each pattern."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        live = np.arange(len(lengths))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            symbol = symbols[live, lengths[live] - 1 - step]
            known = symbol < self.size
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known].astype(np.int64)
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The positions of suffixes."""
        out, walked, live = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(live):
            here = self.kept[row]
            out[live[here]] = self.positions[self.sampled[row[here]]] + walked
            live, row = live[~here], self.back(row[~here])
            walked += 1
        return out


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def occurrences(found, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in a shard's words."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(windows.lengths) or not len(found.hashes):
        return nothing
    likely = np.zeros(1 << 16, bool)
    likely[windows.alphabet & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(likely[found.hashes & np.uint64(0xFFFF)])
    place = np.searchsorted(windows.alphabet, found.hashes[at])
    place[place == len(windows.alphabet)] = 0
    same = windows.alphabet[place] == found.hashes[at]
    at, place = at[same], place[same]
    if not len(at):
        return nothing
    row = np.searchsorted(found.rows, at, side="right")
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    run = np.cumsum(begins) - 1
    keep = np.bincount(run)[run] >= windows.lengths.min()
    at, place, run = at[keep], place[keep], run[keep]
    if not len(at):
        return nothing
    slot = np.arange(len(at)) + np.unique(run, return_inverse=True)[1]  # a gap after each run
    text = np.full(slot[-1] + 3, GAP, np.int64)
    text[slot] = place + FIRST
    text[-1] = END
    word = np.zeros(len(text), np.int64)
    word[slot] = at
    index = Index(text)
    low, high = index.search(windows.symbols, windows.lengths)
    count = np.maximum(high - low, 0)
    return word[index.locate(_spread(low, count))], np.repeat(np.arange(len(count)), count)


def shard_hits(found, windows: Windows, n_rows: int) -> tuple[np.ndarray, list[set]]:
    """Whether each word is hit, and each row's items."""
    start, window = occurrences(found, windows)
    edge = np.zeros(len(found.hashes) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows.lengths[window], -1)
    items: list[set] = [set() for _ in range(n_rows)]
    row = np.searchsorted(found.rows, start, side="right") - 1
    pairs = np.unique(np.stack([row, window]), axis=1) if len(row) else np.empty((2, 0), np.int64)
    for r, w in pairs.T:
        items[r].update(windows.item[windows.first[w]: windows.first[w + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, [{windows.names[i] for i in x} for x in items]


def _merged(hit: np.ndarray) -> list[list[int]]:
    """[first, last + 1] of each run of hit words."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return change.reshape(-1, 2).tolist()


def _without(texts: pa.Array, found, spans: list) -> pa.Array:
    """The texts without their spans of words."""
    out = texts.to_pylist()
    for row in (r for r, x in enumerate(spans) if x):
        parts, at = [], found.offsets[row]
        for a, b in spans[row]:
            first = found.rows[row]
            parts.append(found.data[at: found.start[first + a]].tobytes())
            at = found.end[first + b - 1]
        out[row] = (b"".join(parts) + found.data[at: found.offsets[row + 1]].tobytes()).decode()
    return pa.array(out, texts.type)


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> list[list[tuple]]:
    """The benchmark in parts that are small enough to be sent."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).dropna()
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
        most = (rows.groupBy(block.alias("block")).agg(F.sum(F.octet_length("text")).alias("size"), F.count_distinct("text").alias("n"))
                .where("n > 1").agg(F.max("size")).first()[0] or 0)
        if most <= limit:
            break
        blocks *= 2
    return [[tuple(row) for row in rows.where(block == number).collect()] for number in range(blocks)]


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         width: int = WINDOW, limit: int = BLOCK_BYTES, names=("n_words", "n_hit", "items", "spans"), cut: bool = False) -> DataFrame:
    """``docs`` with the number of words, of hit words, the items with occurring windows, and the merged spans.

    A span is [first, end) in words. ``names`` are the new columns' names and must be free. With ``cut``
    the spans are taken out of the texts, with what stands between their words.
    """
    must_be_free(docs, names)
    place, old = docs.columns.index(text), len(docs.columns)
    added = [StructField(names[0], LongType()), StructField(names[1], LongType()),
             StructField(names[2], ArrayType(StringType())), StructField(names[3], ArrayType(ArrayType(LongType())))]
    schema = StructType([*docs.schema.fields, *added])
    out = docs
    blocks = _blocks(benchmark, item, item_text, limit)
    for number, items in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(windows_of(items, width))
        last = cut and number == len(blocks) - 1

        def run(batches, sent=sent, last=last):
            windows = sent.value
            for batch in slices(batches, SHARD_BYTES, text):
                found = words(batch.column(place), ALNUM)
                hit, rows = shard_hits(found, windows, batch.num_rows)
                if batch.num_columns > old:  # what earlier blocks of the benchmark have hit
                    for r, (names_, spans) in enumerate(zip(batch.column(old + 2).to_pylist(), batch.column(old + 3).to_pylist())):
                        rows[r] |= set(names_)
                        for a, b in spans:
                            hit[found.rows[r] + a: found.rows[r] + b] = True
                sums = np.concatenate([[0], np.cumsum(hit)])
                count = sums[found.rows[1:]] - sums[found.rows[:-1]]
                spans = [_merged(hit[a:b]) if n else [] for a, b, n in zip(found.rows[:-1], found.rows[1:], count)]
                columns = batch.columns[:old]
                if last and count.any():
                    columns[place] = _without(columns[place], found, spans)
                yield pa.record_batch([*columns, pa.array(np.diff(found.rows)), pa.array(count),
                                       pa.array([sorted(x) for x in rows], pa.list_(pa.string())),
                                       pa.array(spans, pa.list_(pa.list_(pa.int64())))], schema.names)

        out = out.mapInArrow(run, schema)
    return out


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)
