"""Phrase collocations: weighted acyclic automata of each shard's n-grams, united and summed by prefix range.

A shard is some megabytes of a task's texts. Its n-grams (three words, filled up with END behind the last word of a piece)
are sorted, counted, and become a count transducer: an acyclic automaton whose states with equal continuations are
one state. Sorted n-grams are cut at the bounds of prefix ranges, so that a frequent word or pair fills as many ranges as its
n-grams need. A range's task expands its transducers, unites them and sums their weights; the count of
a phrase is the sum of all weights below it. Only a prefix at the edge of a range can go on in another one; such
partial sums are added up by Spark.

Frequent phrases are then sorted twice, by their words forwards and backwards. Each time a task composes them with the
count transducer of the same rows: the first part of a phrase is a prefix in the one order, its rest a prefix in the other. So
no part is a join key, however many phrases share it. A prefix that begins in an earlier task's range is looked up apart:
at most two for each task.

The bounds come from a sample of some ``SAMPLE_BYTES`` of text; they decide how even the ranges are, not what is counted.

Defined results: null text has no words, null lang is ``und``. Repeated and long texts count whole. Ids and further columns are
not used. A lang without phrases that are frequent enough has no rows, an empty table none at all.
"""
from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, ship, stored
from .words import _class, slices, words

LONGEST = 3
LEAST = 10
#: Text read at a time, united before it is cut, and of one range; and how many ranges one step deals out.
SLICE_BYTES = 1 << 21
SHARD_BYTES = 8 << 20
RANGE_BYTES = 6 << 20
FAN = 512
SAMPLE_BYTES = 8 << 20
#: A code has this many bits, so that three make one key; code 0 is END.
BITS = 21
MASK = np.uint64((1 << BITS) - 1)
#: N-grams numbered at a time: their words have fewer codes than there are.
CHUNK = 1 << 18

WORDS = _class([0x20, 0x09, *range(0x0A, 0x0E), *b".,;:!?"])
WORDS[0] = 0xFF
ENDS = np.zeros(256, bool)
ENDS[[*range(0x0A, 0x0E), *b".,;:!?"]] = True


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(2 * BITS)) | (b.astype(np.uint64) << np.uint64(BITS)) | c.astype(np.uint64)


def unpacked(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> np.uint64(2 * BITS)).astype(np.int32), (keys >> np.uint64(BITS) & MASK).astype(np.int32), (keys & MASK).astype(np.int32)]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = starts(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts


class Transducer(NamedTuple):
    """Transitions by level, sorted by state: ``symbols`` and where they lead (at the last level: weights), and where each
    state's transitions begin. ``names``: the sorted words, whose places plus 1 are the symbols."""
    names: pa.Array
    symbols: list
    targets: list
    first: list

    @classmethod
    def of(cls, names: pa.Array, keys: np.ndarray, counts: np.ndarray) -> Transducer:
        """From sorted n-grams. Equal states are found from the last level up, so the automaton is minimal."""
        a, b, c = unpacked(keys)
        symbols, targets, first = [c], [counts.astype(np.int64)], []
        for depth in (2, 1, 0):
            own = (a, b)[:depth]
            begins = starts(*own) if own else np.zeros(min(1, len(symbols[0])), np.int64)
            length = np.diff(np.append(begins, len(symbols[0])))
            kind, state = cls._register(symbols[0], targets[0], begins, length)
            keep = spread(begins[kind], length[kind])
            symbols[0], targets[0] = symbols[0][keep], targets[0][keep]
            first.insert(0, np.concatenate([[0], np.cumsum(length[kind])]))
            if own:
                symbols.insert(0, own[-1][begins])
                targets.insert(0, state.astype(np.int32))
                a, b = a[begins], b[begins]
        return cls(names, symbols, targets, first)

    @staticmethod
    def _register(symbols, targets, begins, length) -> tuple[np.ndarray, np.ndarray]:
        """(one of each kind of equal states, the kind of every state)."""
        if not len(begins):
            return begins, begins
        with np.errstate(over="ignore"):
            x = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ targets.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            mark = np.add.reduceat(x ^ (x >> np.uint64(29)), begins) + length.astype(np.uint64)
        _, kind, state = np.unique(mark, return_index=True, return_inverse=True)
        like = kind[state]
        if (length == length[like]).all():
            here, there = spread(begins, length), spread(begins[like], length)
            if (symbols[here] == symbols[there]).all() and (targets[here] == targets[there]).all():
                return kind, state
        return np.arange(len(begins)), np.arange(len(begins))  # two kinds with one mark: none is shared

    def expand(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, weights) of all n-grams, sorted."""
        a, state = self.symbols[0], self.targets[0]
        count = np.diff(self.first[1])[state]
        at = spread(self.first[1][state], count)
        a, b, state = np.repeat(a, count), self.symbols[1][at], self.targets[1][at]
        count = np.diff(self.first[2])[state]
        at = spread(self.first[2][state], count)
        head = packed(a, b, np.zeros(1, np.uint64))
        return np.repeat(head, count) | self.symbols[2][at].astype(np.uint64), self.targets[2][at]

    def weights(self, *path: np.ndarray) -> np.ndarray:
        """Composition with phrases given by their three symbols each: their weights, or -1."""
        state, ok = np.zeros(len(path[0]), np.int64), np.ones(len(path[0]), bool)
        for level, symbol in enumerate(path):
            owner = np.repeat(np.arange(len(self.first[level]) - 1), np.diff(self.first[level])).astype(np.uint64)
            held = (owner << np.uint64(BITS)) | self.symbols[level].astype(np.uint64)
            want = (state.astype(np.uint64) << np.uint64(BITS)) | symbol.astype(np.uint64)
            at = np.minimum(np.searchsorted(held, want), max(0, len(held) - 1))
            ok &= (held[at] == want) if len(held) else False
            state = np.where(ok, self.targets[level][at], 0) if len(held) else state
        return np.where(ok, state, -1)

    def pack(self) -> tuple[int, bytes]:
        parts = []
        for array in (*self.symbols, *self.targets, *(np.diff(f) for f in self.first)):
            width = next(w for w in (1, 2, 4, 8) if not len(array) or int(array.max()) < 1 << (8 * w))
            planes = np.ascontiguousarray(array.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
            parts.append(np.array([len(array), width], np.int64).tobytes() + planes.tobytes())
        text = self.names.cast(pa.large_binary())
        body, offsets = text.buffers()[2], np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
        data = (body.to_pybytes() if body is not None else b"")[offsets[0]: offsets[-1]]
        parts.append(np.array([len(text)], np.int64).tobytes() + np.diff(offsets).astype(np.uint32).tobytes() + data)
        raw = b"".join(parts)
        return len(raw), pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def unpack(cls, size: int, content: bytes) -> Transducer:
        raw, at, arrays = pa.decompress(content, size, "zstd", asbytes=True), 0, []
        for _ in range(3 * LONGEST):
            count, width = np.frombuffer(raw, np.int64, 2, at).tolist()
            planes = np.zeros((count, 8), np.uint8)
            planes[:, :width] = np.frombuffer(raw, np.uint8, count * width, at + 16).reshape(width, count).T
            arrays.append(planes.view(np.int64).ravel())
            at += 16 + count * width
        count = int(np.frombuffer(raw, np.int64, 1, at)[0])
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, count, at + 8), dtype=np.int64)])
        names = pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at + 8 + 4 * count:])])
        return cls(names, [x.astype(np.int32) for x in arrays[:3]], arrays[3:6], [np.concatenate([[0], np.cumsum(x)]) for x in arrays[6:]])


def united(parts: list[Transducer]) -> Transducer:
    """One transducer of all n-grams, with their weights summed."""
    if len(parts) == 1:
        return parts[0]
    names = pa.concat_arrays([p.names for p in parts])
    different = pc.unique(names)
    order = pc.sort_indices(different)
    if len(different) >= int(MASK):
        raise ValueError("too many different words in one range; lower RANGE_BYTES or SHARD_BYTES")
    rank = np.empty(len(different), np.uint64)
    rank[order.to_numpy()] = np.arange(1, len(different) + 1)
    code = rank[pc.index_in(names, different).to_numpy(zero_copy_only=False)]
    keys, counts, at = [], [], 0
    for p in parts:
        to = np.concatenate([np.zeros(1, np.uint64), code[at: at + len(p.names)]])
        own, weight = p.expand()
        keys.append(packed(*(to[x] for x in unpacked(own))))
        counts.append(weight)
        at += len(p.names)
    return Transducer.of(different.take(order), *summed(np.concatenate(keys), np.concatenate(counts)))


def narrowed(names: pa.Array, keys: np.ndarray, counts: np.ndarray) -> Transducer:
    """A transducer of some n-grams, with only the words they have."""
    columns = unpacked(keys)
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    place = np.zeros(len(names) + 1, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    return Transducer.of(names.take(pa.array(used - 1)), packed(*(place[c] for c in columns)), counts)


def ngrams(texts: pa.Array):
    """Transducers of the n-grams of texts, one for each ``CHUNK`` of words."""
    found = words(texts, WORDS)
    size = len(found.hashes)
    if not size:
        return
    ends = np.concatenate([[0], np.cumsum(ENDS[found.data])])
    last = np.ones(size, bool)  # of a piece
    last[:-1] = ends[found.start[1:]] != ends[found.end[:-1]]
    rows = found.rows[1:-1]
    last[rows[(rows > 0) & (rows < size)] - 1] = True
    for at in range(0, size, CHUNK):
        to = min(size, at + CHUNK)
        far = min(size, to + LONGEST - 1)
        hashes, where, code = np.unique(found.hashes[at:far], return_index=True, return_inverse=True)
        place = where + at
        length = found.end[place] - found.start[place]
        data = found.data[spread(found.start[place], length)]
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data + 32, data).astype(np.uint8)
        names = pa.Array.from_buffers(pa.large_binary(), len(hashes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        order = pc.sort_indices(names)
        rank = np.empty(len(hashes), np.uint64)
        rank[order.to_numpy()] = np.arange(1, len(hashes) + 1)
        code = np.concatenate([rank[code], np.zeros(LONGEST, np.uint64)])
        stop = np.concatenate([last[at:far], np.ones(LONGEST, bool)])
        n = to - at
        second = np.where(stop[:n], np.uint64(0), code[1: n + 1])
        third = np.where(stop[:n] | stop[1: n + 1], np.uint64(0), code[2: n + 2])
        keys, counts = np.unique(packed(code[:n], second, third), return_counts=True)
        yield narrowed(names.take(order), keys, counts)


def _lower_bound(names: list, keys: np.ndarray, bound: tuple) -> int:
    """How many n-grams stand before a bound of three words (END is empty)."""
    key = []
    for word in bound:
        at = bisect_left(names, word) if word else -1
        key.append(at + 1)
        if word and (at == len(names) or names[at] != word):
            break
    key += [0] * (LONGEST - len(key))
    return int(np.searchsorted(keys, packed(*(np.array([k]) for k in key))[0]))


CUT = "range int, step int, lang string, size long, content binary"


def _cut(lang: str, whole: Transducer, bounds: list[tuple], step: int):
    """(range, step, lang, size, content) of a transducer cut at every ``step``-th bound; ranges have the number of their first."""
    chosen = bounds[step - 1:: step]
    low = bisect_left(chosen, (lang.encode(),))
    high = bisect_left(chosen, (lang.encode() + b"\0",))
    keys, counts = whole.expand()
    names = whole.names.to_pylist()
    at = [0, *(_lower_bound(names, keys, b[1:]) for b in chosen[low:high]), len(keys)]
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if a < b:
            yield (low + i) * step, step, lang, *narrowed(whole.names, keys[a:b], counts[a:b]).pack()


def _rows(rows):
    rows = list(rows)
    if rows:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["range", "step", "lang", "size", "content"])


def _counted(docs: DataFrame, bounds: list[tuple], step: int, limit: int) -> DataFrame:
    """Transducers of the shards, cut at every ``step``-th bound."""
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def emit():
            for lang, parts in held.items():
                yield from _rows(_cut(lang, united(parts), sent.value, step))

        for batch in slices(batches, SLICE_BYTES, "text"):
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                held.setdefault(lang, []).extend(ngrams(batch.column(1).take(pa.array(np.flatnonzero(codes == number)))))
            size += batch.column(1).nbytes
            if size >= limit or max(sum(len(p.names) for p in parts) for parts in held.values()) > int(MASK) // 2:
                yield from emit()
                held, size = {}, 0
        yield from emit()

    return docs.mapInArrow(run, CUT)


def _recut(rows: DataFrame, bounds: list[tuple], step: int, limit: int) -> DataFrame:
    """Rows of wide ranges, some united and all cut at every ``step``-th bound."""
    sent = rows.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        held, size, at = [], 0, None

        def emit():
            yield from _rows(_cut(at[1], united(held), sent.value, step))

        for batch in batches:
            for number, lang, length, content in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "size", "content"))):
                if held and (at != (number, lang) or size + length > limit):
                    yield from emit()
                    held, size = [], 0
                held.append(Transducer.unpack(length, content))
                size, at = size + length, (number, lang)
        if held:
            yield from emit()

    return (rows.repartition("range", F.pmod(F.xxhash64("content"), F.lit(64))).sortWithinPartitions("range", "lang").mapInArrow(run, CUT))


SUMS = "lang string, w1 string, w2 string, w3 string, f long, edge boolean"


def _sums(least: int):
    """A range's frequent phrases with their counts; the first and last prefixes may go on in other ranges and always stay."""
    def run(rows):
        import pandas as pd

        out = []
        for lang, own in rows.groupby("lang", sort=False):
            whole = united([Transducer.unpack(s, c) for s, c in zip(own["size"], own["content"])])
            keys, counts = whole.expand()
            names = np.array([None, *(x.decode() for x in whole.names.to_pylist())], object)
            a, b, c = unpacked(keys)
            for level, columns in enumerate(((a, b, c), (a, b), (a,)), 0):
                at = starts(*columns)
                f = np.add.reduceat(counts, at)
                edge = np.zeros(len(at), bool)
                if level:
                    edge[[0, -1]] = True
                keep = (f >= least) | edge
                if level < 2:
                    keep &= columns[-1][at] > 0  # an n-gram that ends earlier is counted as a shorter one
                at, f, edge = at[keep], f[keep], edge[keep]
                blank = np.full(len(at), None, object)
                out.append(pd.DataFrame({"lang": lang, "w1": names[a[at]], "w2": names[b[at]] if level < 2 else blank,
                                         "w3": names[c[at]] if level < 1 else blank, "f": f, "edge": edge}))
            out.append(pd.DataFrame({"lang": [lang], "w1": [None], "w2": [None], "w3": [None], "f": [counts.sum()], "edge": [True]}))
        return pd.concat(out)

    return run


def bounds_of(docs: DataFrame, total: int, ranges: int) -> list[tuple]:
    """(lang, three words) at which about equal ranges begin, from a sample of the texts."""
    def thin(batches):
        for batch in slices(batches, SLICE_BYTES, "text"):
            for lang in pc.unique(batch.column(0)).to_pylist():
                for part in ngrams(batch.column(1).filter(pc.equal(batch.column(0), lang))):
                    keys, _ = part.expand()
                    names = np.array([b"", *part.names.to_pylist()], object)
                    keys = keys[len(keys) // 2 % 32:: 32] if len(keys) > 32 else keys[len(keys) // 2:][:1]
                    a, b, c = unpacked(keys)
                    yield pa.record_batch([pa.array([lang.encode()] * len(keys), pa.binary()), *(pa.array(names[x], pa.binary()) for x in (a, b, c))], ["lang", "a", "b", "c"])

    some = docs.sample(min(1.0, SAMPLE_BYTES / max(1, total)), seed=11)
    found = sorted(tuple(bytes(x) for x in r) for r in some.mapInArrow(thin, "lang binary, a binary, b binary, c binary").collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, range_bytes: int = None, shard_bytes: int = None) -> DataFrame:
    """(lang, w1, w2, w3, f) of all phrases of one to three words with f of at least ``least``; and the count of all words, without words."""
    range_bytes, shard_bytes = range_bytes or RANGE_BYTES, shard_bytes or SHARD_BYTES
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    bounds = bounds_of(docs, total, ranges) if ranges > 1 else []
    step = 1
    while step * FAN < len(bounds) + 1:
        step *= FAN
    rows = _counted(docs, bounds, step, shard_bytes)
    while step > 1:
        step //= FAN
        rows = _recut(stored(rows, "ranges"), bounds, step, shard_bytes)
    sums = stored(rows.groupBy("range").applyInPandas(_sums(least), SUMS), "sums")
    names = ["lang", "w1", "w2", "w3"]
    edges = sums.where("edge").groupBy(*names).agg(F.sum("f").alias("f"))
    return stored(sums.where("not edge").select(*names, "f").unionByName(edges).where((F.col("f") >= least) | F.col("w1").isNull()), "counts")


def _composed(batches):
    """Sorted (lang, x, y, z, f) with the counts of the prefixes x and x y (``one``, ``two``); null where a prefix began in another task."""
    carried = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        whole = table if carried is None else pa.concat_tables([carried, table])
        langs = pc.dictionary_encode(whole.column("lang").combine_chunks()).indices.to_numpy()
        columns = [whole.column(c).combine_chunks() for c in ("x", "y", "z")]
        names = pc.unique(pa.concat_arrays(columns)).drop_null()
        names = names.take(pc.sort_indices(names))
        symbols = [pc.fill_null(pc.add(pc.index_in(c, names), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
        f = whole.column("f").to_numpy()
        one, two = np.full(len(f), -1, np.int64), np.full(len(f), -1, np.int64)
        nothing = np.zeros(len(f), np.int64)
        for own in np.split(np.arange(len(f)), np.flatnonzero(np.diff(langs)) + 1):
            x, y, z = (s[own] for s in symbols)
            transducer = Transducer.of(names, packed(x, y, z), f[own])
            one[own] = transducer.weights(x, nothing[own], nothing[own])
            two[own] = np.where(y > 0, transducer.weights(x, y, nothing[own]), -1)
        keep = np.arange(len(f)) >= len(f) - batch.num_rows
        out = whole.append_column("one", pa.array(one, mask=one < 0)).append_column("two", pa.array(two, mask=two < 0)).filter(pa.array(keep))
        yield from out.combine_chunks().to_batches()
        heads = [i for i in (np.flatnonzero(symbols[1] == 0)[-1:], np.flatnonzero((symbols[1] > 0) & (symbols[2] == 0))[-1:]) if len(i)]
        carried = whole.take(pa.array(np.sort(np.concatenate(heads)))) if heads else None


def _prefixes(phrases: DataFrame, columns: list[str]) -> DataFrame:
    """``phrases`` with the counts of their first one and two words in the order of ``columns``."""
    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["lang", "x", "y", "z"]
    keyed = phrases.select("lang", *(F.col(c).alias(n) for c, n in zip(columns, "xyz")), "f")
    found = (keyed.repartitionByRange(parts, *key).sortWithinPartitions(*key)
             .mapInArrow(_composed, "lang string, x string, y string, z string, f long, one long, two long"))
    found = stored(found, "composed")
    short = keyed.where("z is null").select("lang", "x", "y", F.col("f").alias("lost"))
    ones = (found.where("one is null").select("lang", "x").distinct().join(short.where("y is null").drop("y"), ["lang", "x"])
            .select("lang", "x", F.col("lost").alias("lost_one")))
    twos = (found.where("two is null and z is not null").select("lang", "x", "y").distinct().join(short, ["lang", "x", "y"])
            .select("lang", "x", "y", F.col("lost").alias("lost_two")))
    # a task lacks one prefix of each kind at most, that of its first row
    return (found.join(F.broadcast(ones), ["lang", "x"], "left").join(F.broadcast(twos), ["lang", "x", "y"], "left")
            .select("lang", *(F.col(n).alias(c) for c, n in zip(columns, "xyz")), "f",
                    F.coalesce("one", "lost_one").alias("one"), F.coalesce("two", "lost_two").alias("two")))


def _backwards(phrases: DataFrame) -> DataFrame:
    """``phrases`` with their words in reverse as r1, r2, r3."""
    return phrases.select("lang", "f", "w1", "w2", "w3",
                          F.coalesce("w3", "w2", "w1").alias("r1"), F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1")).alias("r2"),
                          F.when(F.col("w3").isNotNull(), F.col("w1")).alias("r3"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = 2000, cover: int = 50, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases of two or three words.

    ``cover``: a phrase goes if a longer one that contains it has that many per cent of its count.
    """
    ship(docs.sparkSession)
    known = counts(docs, text, lang, least, **sizes)
    phrases, words_of = known.where("w1 is not null"), known.where("w1 is null").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    forth = _prefixes(phrases, ["w1", "w2", "w3"]).where("w2 is not null")
    back = _prefixes(_backwards(phrases).drop("w1", "w2", "w3"), ["r1", "r2", "r3"]).where("r2 is not null").select(
        F.col("lang").alias("lang_"), F.coalesce("r3", "r2").alias("v1"), F.when(F.col("r3").isNotNull(), F.col("r2")).otherwise(F.col("r1")).alias("v2"),
        F.when(F.col("r3").isNotNull(), F.col("r1")).alias("v3"), F.col("one").alias("end_one"), F.col("two").alias("end_two"))
    both = forth.join(back, (F.col("lang") == F.col("lang_")) & (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")) & F.col("w3").eqNullSafe(F.col("v3")))

    def cut(l: str, r: str):  # noqa: E741
        wide = "decimal(38,0)"
        a = F.col("f").cast("decimal(18,0)")
        score = F.expr(f"cast(1000000 * cast(f as decimal(18,0)) * cast(f as decimal(18,0)) as {wide}) div cast(cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)) as {wide})")
        return F.struct(score.alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))

    one, two = cut("one", "end_two"), cut("two", "end_one")
    pair = cut("one", "end_one")
    best = F.when(F.col("w3").isNull(), pair).when(two["score"] < one["score"], two).otherwise(one)
    scored = stored(both.select("lang", "w1", "w2", "w3", "f", best.alias("best")), "scored")
    longer = scored.where("w3 is not null")
    inside = (longer.select("lang", "w1", "w2", "f").unionByName(longer.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
              .groupBy("lang", "w1", "w2").agg(F.max("f").alias("most"), F.lit(True).alias("has")))
    pairs = scored.where("w3 is null").join(inside, ["lang", "w1", "w2"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < cover * F.col("f"))).select(scored.columns)
    shown = pairs.unionByName(longer).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), "best.*")
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return (ranked.join(words_of, F.col("lang") == F.col("of"))
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
