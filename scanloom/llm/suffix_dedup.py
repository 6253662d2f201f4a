"""Suffix-array dedup: every byte of a string of ``length`` bytes that also starts elsewhere goes.

The suffixes are dealt by content. The least hash of the ``gram``-byte strings within a window of ``length`` bytes depends on
the window alone, so equal windows have equal anchors wherever they stand. Neighbouring windows with one anchor form a
context; only contexts whose anchor occurs again go on, each different one once. A bucket of anchors gets its contexts as
shards: each shard has its own Burrows-Wheeler transform (over an alphabet of ``step``-byte blocks, so that a prefix of
``length`` bytes is a few symbols). The transforms of all shards are merged by refining their interleave: every round sorts
the interleave stably by the transforms' symbols, which orders it by one symbol more, and marks where common prefixes end. No
suffix is sorted again. Intervals of suffixes that share ``length`` bytes are the repeats.

An anchor whose contexts exceed a bucket's share is dealt anew by longer grams, up to whole windows, where only equal contexts
are left together; so a passage in a third of all documents fills no single task.

Texts are stored once, with an address for each byte, and never shuffled: what tasks must know about a part of the
stored texts is written beside it, into a file of the shared folder with that part's number.

Hashes have 64 bits; contexts are told apart by two of them, and blocks of suffixes by one of the whole window besides.

Defined results: null counts as empty. Texts below ``length`` bytes keep all. Documents without an id, repeated ids and
repeated rows are judged row by row, so rows with equal texts repeat each other. An empty table gives none.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .shared import dropped, mapped, put, shared_folder, ship, stored
from .words import buffers, mix, slices

LENGTH = 200
GRAM = 32
#: Text read at a time, and bytes whose windows are hashed at a time.
SLICE_BYTES = 1 << 21
BLOCK = 1 << 17
#: Windows of one context at most (a run of one byte, say, would be a context of any length).
CONTEXT = 1 << 12
#: Bytes of a bucket, of a shard in it, and of one anchor's contexts before it is dealt anew. A merge costs its bytes; dealing anew sends
#: every piece with ``length`` bytes around it, many times the bytes of contexts that are long and alike, so it is for what fills a bucket.
BUCKET_BYTES = 1 << 19
SHARD_BYTES = 1 << 17
ANCHOR_BYTES = 1 << 19
#: The address of a byte: the number of its part of the stored texts, and its place in it.
PLACE_BITS = 38

_random = np.random.default_rng(20250211)
_VALUES = [_random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def _powers(which: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2 to the 64."""
    held = _powers.__dict__.setdefault("held", {})
    if which not in held or len(held[which][0]) < count:
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(count, np.uint64(base), np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        held[which] = out
    return held[which][0][:count], held[which][1][:count]


def sums_of(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums from which :func:`hashed` has the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[which][data] * _powers(which, len(data))[0], out=out[1:])
    return out


def hashed(sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(which, len(sums))[1][start])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, second hash, first window, windows, whether a window may occur again in it) of the contexts of texts in ``data``.

    Equal windows of one context have their anchor's first occurrence at one distance, so there are none unless the first
    occurrence in the first window is no longer in the last one.
    """
    out, width = [], length - gram + 1
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        windows = b - a - length + 1
        for at in range(0, max(0, windows), BLOCK):
            to = min(windows, at + BLOCK)
            part = data[a + at: a + to + length - 1]
            sums = [sums_of(part, 0), sums_of(part, 1)]
            grams = mix((sums[0][gram:] - sums[0][:-gram]) * _powers(0, len(part) + 1)[1][: len(part) - gram + 1])
            least = _least(grams, width)
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(least)))
            leftmost = first + np.lib.stride_tricks.sliding_window_view(grams, width)[first].argmin(axis=1)
            again = first + count - 1 > leftmost
            if count.max() > CONTEXT:
                pieces = -(-count // CONTEXT)
                owner = np.repeat(np.arange(len(first)), pieces)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first, count, again = first[owner] + nth * CONTEXT, np.minimum(count[owner] - nth * CONTEXT, CONTEXT), again[owner]
            out.append((least[first], hashed(sums[1], 1, first, first + count + length - 1), first + a + at, count, again))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def transform(symbols: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The order of a shard's suffixes: ``symbols`` by position, ``after`` the position of the next symbol (cyclic).

    Compared lengths double; every string's last symbol occurs once, so the order is total.
    """
    rank, most = symbols.astype(np.int64), int(symbols.max(initial=0)) + 1
    while True:
        key = rank * most + rank[after]
        order = np.argsort(key)
        new = np.ones(len(key), np.int64)
        new[0] = 0
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        if not len(order) or rank[order[-1]] == len(rank) - 1:
            return order
        after, most = after[after], len(rank)


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """Stable order by 32-bit symbols, by their halves."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    high = (symbols >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def merged(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row of it, block) of every row of the merged transform; rows of one block share ``rounds`` symbols.

    The interleave starts as one shard behind the other. A round takes each row's symbol, which stands before its suffix, and
    sorts stably by it: then rows are in the order of the suffixes one symbol longer.
    """
    column = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    block = np.zeros(len(column), np.int64)
    for _ in range(rounds):
        symbol = np.empty_like(column)
        symbol[np.argsort(shard, kind="stable")] = column
        order = _by_symbol(symbol)
        symbol, shard, before = symbol[order], shard[order], block[order]
        new = np.zeros(len(order), np.int64)
        new[1:] = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        block = np.cumsum(new)
    row = np.empty(len(column), np.int64)
    row[np.argsort(shard, kind="stable")] = np.concatenate([np.arange(len(t)) for t in transforms])
    return shard, row, block


def repeated(texts: list[bytes], windows: np.ndarray, copies: np.ndarray, length: int, step: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each context, whether each of its windows occurs again in any of them (``copies``: how often a context occurs)."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    slots = np.cumsum(size + 1) - (size + 1)  # a slot for every position and for the end
    total = int((size + 1).sum())
    owner = np.repeat(np.arange(len(texts)), size + 1)
    place = np.arange(total) - slots[owner]
    where = begin[owner] + place
    sums = sums_of(data, 0)
    whole = place + step <= size[owner]
    value = np.zeros(total, np.uint64)
    value[whole] = hashed(sums, 0, where[whole], where[whole] + step)
    symbol = np.zeros(total, np.uint32)
    different, code = np.unique(value[whole], return_inverse=True)
    symbol[whole] = code
    symbol[~whole] = len(different) + np.arange((~whole).sum())  # every string ends with a symbol of its own
    after = np.arange(total) + step
    # the next after a string's last symbol is its first: strings of a text are its positions of one remainder
    after[~whole] = (slots[owner] + place % step)[~whole]
    shard_of = (np.cumsum(size + 1) - 1) // shard_bytes
    transforms, orders = [], []
    for s in np.unique(shard_of):
        mine = np.flatnonzero(shard_of == s)
        a, b = slots[mine[0]], slots[mine[-1]] + size[mine[-1]] + 1
        order = transform(symbol[a:b], after[a:b] - a)
        before = np.empty(b - a, np.int64)
        before[after[a:b] - a] = np.arange(b - a)
        transforms.append(symbol[a:b][before[order]])
        orders.append(order + a)
    shard, row, block = merged(transforms, length // step)
    first = np.cumsum([0, *(len(o) for o in orders)])
    slot = np.concatenate(orders)[first[shard] + row]
    real = place[slot] < windows[owner[slot]]
    slot, block = slot[real], block[real]
    other = sums_of(data, 1)
    mark = hashed(other, 1, where[slot], where[slot] + length)
    if ((block[1:] == block[:-1]) & (mark[1:] != mark[:-1])).any():  # unequal windows with equal symbols: parted by the second hash
        order = np.lexsort((mark, block))
        slot, block, mark = slot[order], block[order], mark[order]
    new = np.ones(len(slot), bool)
    new[1:] = (block[1:] != block[:-1]) | (mark[1:] != mark[:-1])
    interval = np.cumsum(new) - 1
    weight = np.bincount(interval, copies[owner[slot]])
    flags = np.zeros(total, bool)
    flags[slot] = weight[interval] >= 2
    return [flags[a: a + n] for a, n in zip(slots, windows)]


def _ranges(flags: np.ndarray) -> np.ndarray:
    """[first, end) of each run of set flags."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).reshape(-1, 2)


def _addressed(docs: DataFrame, text: str, text_at: int) -> DataFrame:
    """``docs`` with the address of each text's first byte, stored."""
    name = docs.columns[text_at]
    schema = StructType([*docs.schema.fields, StructField("address", LongType())])

    def run(batches):
        at = TaskContext.get().partitionId() << PLACE_BITS
        for batch in slices(batches, SLICE_BYTES, name):
            _, offsets = buffers(batch.column(text_at))
            yield pa.record_batch([*batch.columns, pa.array(offsets[:-1] + at)], schema.names)
            at += int(offsets[-1])

    return stored(docs.mapInArrow(run, schema), "texts")


FOUND = "anchor long, second long, address long, windows int, again int"


def _occurrences(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, SLICE_BYTES, "text"):
            data, offsets = buffers(batch.column("text"))
            anchor, second, first, count, again = contexts(data, offsets, length, gram)
            address = batch.column("address").to_numpy()
            row = np.searchsorted(offsets, first, side="right") - 1
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(second.view(np.int64)), pa.array(address[row] + first - offsets[row]),
                                   pa.array(count, pa.int32()), pa.array(again.astype(np.int32))], ["anchor", "second", "address", "windows", "again"])

    return texts.select("text", "address").mapInArrow(run, FOUND)


def _beside(rows: DataFrame, columns: list[str], folder: str) -> None:
    """Write (address, columns) rows, in the order of their addresses, into a file for each part of the stored texts."""
    def write(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("address", kind="stable")
        part = int(own["address"].iat[0]) >> PLACE_BITS
        put(f"{folder}/{part}", np.ascontiguousarray(np.stack([own[c].to_numpy(np.int64) for c in ["address", *columns]])).tobytes())
        return pd.DataFrame({"part": [part]})

    part = F.shiftright("address", PLACE_BITS).alias("part")
    rows.select("address", *columns).groupBy(part).applyInPandas(write, "part long").agg(F.count("*")).first()


def _of_parts(batches):
    """Slices of batches whose rows are of one part of the stored texts each."""
    for batch in slices(batches, SLICE_BYTES, "text"):
        part = batch.column("address").to_numpy() >> PLACE_BITS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


def _wanted(folder: str, address: np.ndarray, columns: int):
    """The rows written beside the part that ``address`` (of texts, ascending) belongs to."""
    part = int(address[0]) >> PLACE_BITS
    return mapped(f"{folder}/{part}", np.int64).reshape(columns, -1)


def _cut(texts: DataFrame, folder: str, length: int) -> DataFrame:
    """(anchor, second, copies, windows, bytes) of the contexts that are listed beside the texts."""
    def run(batches):
        for batch in _of_parts(batches):
            address = batch.column("address").to_numpy()
            wanted = _wanted(folder, address, 5)
            data, offsets = buffers(batch.column("text"))
            low, high = np.searchsorted(wanted[0], [address[0], address[-1] + offsets[-1] - offsets[-2]])
            at, anchor, second, copies, windows = (np.array(x[low:high]) for x in wanted)
            if len(at):
                row = np.searchsorted(address, at, side="right") - 1
                start = offsets[row] + at - address[row]
                cut = [data[a: a + n].tobytes() for a, n in zip(start.tolist(), (windows + length - 1).tolist())]
                yield pa.record_batch([pa.array(anchor), pa.array(second), pa.array(copies), pa.array(windows, pa.int32()), pa.array(cut, pa.binary())],
                                      ["anchor", "second", "copies", "windows", "content"])

    return texts.select("text", "address").mapInArrow(run, "anchor long, second long, copies long, windows int, content binary")


HITS = "anchor long, second long, first int, end int"


def _merge_buckets(cuts: DataFrame, buckets: int, length: int, step: int, shard_bytes: int) -> DataFrame:
    """(anchor, second, first, end): the runs of repeated windows of contexts."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated(rows["content"].tolist(), rows["windows"].to_numpy(np.int64), rows["copies"].to_numpy(), length, step, shard_bytes)
        runs = [_ranges(f) for f in found]
        count = [len(r) for r in runs]
        both = np.concatenate([*runs, np.empty((0, 2), np.int64)])
        return pd.DataFrame({"anchor": np.repeat(rows["anchor"].to_numpy(), count), "second": np.repeat(rows["second"].to_numpy(), count),
                             "first": both[:, 0].astype(np.int32), "end": both[:, 1].astype(np.int32)})

    return cuts.groupBy(F.pmod("anchor", F.lit(buckets)).alias("bucket")).applyInPandas(run, HITS)


def _dealt_anew(cuts: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts cut by the anchors of a longer gram: (anchor, second, first, anchor_, second_, copies, windows, content)."""
    def run(batches):
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = batch.column("content").to_pylist()
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *(len(t) for t in texts)])
            anchor, second, first, count, _ = contexts(data, offsets, length, gram)
            row = np.searchsorted(offsets, first, side="right") - 1
            cut = [data[a: a + n].tobytes() for a, n in zip(first.tolist(), (count + length - 1).tolist())]
            yield pa.record_batch([batch.column("anchor").take(pa.array(row)), batch.column("second").take(pa.array(row)), pa.array(first - offsets[row], pa.int32()),
                                   pa.array(anchor.view(np.int64)), pa.array(second.view(np.int64)), batch.column("copies").take(pa.array(row)),
                                   pa.array(count, pa.int32()), pa.array(cut, pa.binary())],
                                  ["anchor", "second", "first", "anchor_", "second_", "copies", "windows", "content"])

    return cuts.mapInArrow(run, "anchor long, second long, first int, anchor_ long, second_ long, copies long, windows int, content binary")


def _joined(hits: DataFrame) -> DataFrame:
    """Runs of one context that touch as one run; a context has ``CONTEXT`` windows at most."""
    def add(held, run):
        last = F.get(held, F.size(held) - 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when(run["first"] <= last["end"], F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(longer))).otherwise(F.concat(held, F.array(run)))

    runs = F.aggregate(F.sort_array(F.collect_list(F.struct("first", "end"))), F.array().cast("array<struct<first:int,end:int>>"), add)
    return hits.groupBy("anchor", "second").agg(runs.alias("runs")).select("anchor", "second", F.explode("runs").alias("run")).select("anchor", "second", "run.*")


def _hits(cuts: DataFrame, length: int, gram: int, step: int, anchor_bytes: int, bucket_bytes: int, shard_bytes: int) -> DataFrame:
    """The repeated windows of contexts, each of which is one row, as runs."""
    cuts = stored(cuts, "contexts")
    sizes = cuts.groupBy("anchor").agg(F.sum(F.octet_length("content")).alias("size"), F.count("*").alias("kinds"))
    large = stored(sizes.where((F.col("size") > anchor_bytes) & (F.col("kinds") > 1)).select("anchor"), "large")
    some = not large.isEmpty() and gram < length
    small = cuts.join(large, "anchor", "left_anti") if some else cuts
    total = cuts.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    found = _merge_buckets(small, max(1, -(-total // bucket_bytes)), length, step, shard_bytes)
    if some:
        longer = (gram + length + 1) // 2
        pieces = stored(_dealt_anew(cuts.join(large, "anchor", "left_semi"), length, longer), "pieces")
        again = (pieces.groupBy(F.col("anchor_").alias("anchor"), F.col("second_").alias("second"))
                 .agg(F.sum("copies").alias("copies"), F.first("windows").alias("windows"), F.first("content").alias("content")))
        inner = _hits(again, length, longer, step, anchor_bytes, bucket_bytes, shard_bytes).select(
            F.col("anchor").alias("anchor_"), F.col("second").alias("second_"), F.col("first").alias("low"), F.col("end").alias("high"))
        back = pieces.select("anchor", "second", "first", "anchor_", "second_").join(inner, ["anchor_", "second_"])
        back = back.select("anchor", "second", (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high")).alias("end"))
        found = found.unionByName(_joined(back))
    found = stored(found, "hits")
    dropped(cuts)
    return found


def _kept(texts: DataFrame, folder: str, length: int, schema: StructType, rest: bool) -> DataFrame:
    """Per row: bytes, removed bytes, removed runs, digest of the rest, and the rest."""
    def run(batches):
        for batch in _of_parts(batches):
            address = batch.column("address").to_numpy()
            data, offsets = buffers(batch.column("text"))
            wanted = _wanted(folder, address, 2)
            low, high = np.searchsorted(wanted[0], [address[0], address[-1] + offsets[-1] - offsets[-2]])
            at = np.array(wanted[0][low:high])
            end = at + wanted[1][low:high] + length - 1
            first = np.searchsorted(at, address)
            last = np.searchsorted(at, address + np.diff(offsets))
            out = {"removed": [], "spans": [], "digest": [], "kept": []}
            for row in range(batch.num_rows):
                own = data[offsets[row]: offsets[row + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                mine = slice(first[row], last[row])
                np.add.at(edge, at[mine] - address[row], 1)
                np.add.at(edge, end[mine] - address[row], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = own[~gone].tobytes()
                out["removed"].append(int(gone.sum()))
                out["spans"].append(len(_ranges(gone)))
                out["digest"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if rest else None)
            yield pa.record_batch([*batch.columns[:-2], pa.array(np.diff(offsets)), pa.array(out["removed"], pa.int64()), pa.array(out["spans"], pa.int64()),
                                   pa.array(out["digest"], pa.string()), pa.array(out["kept"], pa.binary())], schema.names)

    return texts.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, anchor_bytes: int = ANCHOR_BYTES,
                    bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, rest: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): the bytes left of every text (they may cut a character).

    Without ``rest``, ``kept`` is null and only its digest is made.
    """
    ship(docs.sparkSession)
    step = max(d for d in range(1, min(40, length) + 1) if length % d == 0)
    gram = min(gram, length)
    texts = _addressed(docs.select(F.col(id).alias(id), F.coalesce(F.col(text), F.lit("")).alias("text")), text, 1)
    found = stored(_occurrences(texts, length, gram), "occurrences")
    again = found.groupBy("anchor").agg((F.count("*") + F.sum("again")).alias("n")).where("n > 1").select("anchor")
    shared = stored(found.join(again, "anchor", "left_semi"), "shared")
    dropped(found)
    kinds = stored(shared.groupBy("anchor", "second").agg(F.count("*").alias("copies"), F.min("address").alias("address"), F.first("windows").alias("windows"),
                                                          F.max("again").alias("again")), "kinds")
    # an anchor's only context repeats itself outright, if it has copies; transforms are for contexts with others to be compared with
    unlike = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("inside")).where("n > 1 OR inside > 0").select("anchor")
    alone = kinds.join(unlike, "anchor", "left_anti").where("copies > 1").select("anchor", "second", F.lit(0).alias("first"), F.col("windows").alias("end"))
    beside = shared_folder(docs.sparkSession, "beside")
    _beside(kinds.join(unlike, "anchor", "left_semi"), ["anchor", "second", "copies", "windows"], beside)
    merged_hits = _hits(_cut(texts, beside, length), length, gram, step, anchor_bytes, bucket_bytes, shard_bytes)
    hits = merged_hits.unionByName(alone)
    runs = shared.join(hits, ["anchor", "second"]).select((F.col("address") + F.col("first")).alias("address"), (F.col("end") - F.col("first")).alias("windows"))
    gone = shared_folder(docs.sparkSession, "gone")
    _beside(runs, ["windows"], gone)
    for table in (shared, kinds, merged_hits):
        dropped(table)
    schema = StructType([texts.schema[0], StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()),
                         StructField("kept_sha256", StringType()), StructField("kept", BinaryType())])
    return _kept(texts, gone, length, schema, rest)
