"""Conversation prefix trie: double-array tries over sorted shards of paths, shared upper nodes merged globally.

A conversation becomes a path: one 16-byte digest of (role, text) for each turn. Equal paths are one row with
their number and least id. Paths are sorted in Spark by range, so a shard holds neighbours in the order of the trie and
a hot first turn is spread over as many shards as its paths need. A shard numbers its turns densely, packs BASE and
CHECK, and walks its paths through them, a level at a time. A node that a neighbouring shard may have, too, stands on the
first or the last path of its shard; these edge nodes are few, are added up by Spark, and get the sums of
their subtrees by doubled pointers. All other nodes are whole within their shard.

The ids that end at a node are hashed as one sequence, which is given by the result asked for: they are sorted by range and
written in runs of ``RUN`` ids by many tasks, and one stream per node takes the runs in.

Defined results: rows without conv_id form no conversation. Null role or text is empty. Turns of one number (or without any:
those come first) are ordered by the digest of role and text; repeated rows are repeated turns. A conversation's path is
one row of some 20 bytes a turn. An empty table has no nodes. Further columns are not used.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, ship, stored

#: Turns packed in one double array, and ids hashed in one run.
SHARD_TURNS = 1 << 17
RUN = 512
WORD = r"[^\x20\x09-\x0D]+"
ROOT = b"\x00" * 16


def digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn: the role's length keeps the two apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _path_key(path: Column) -> Column:
    """The key of the node a path leads to: digests of key and turn, from the root's down."""
    return F.aggregate(path, F.lit(ROOT), lambda key, turn: F.unhex(F.md5(F.concat(key, turn))))


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): every conversation with its ordered turns as (turn, key, words)."""
    one = F.struct(F.col(turn).alias("turn"), digest(F.col(role), F.col(text)).alias("key"),
                   F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).alias("words"))
    return (turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), one.alias("one"))
            .groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns")))


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv, path, words): the first h turns of the conversation that leads the group, then the own turns after the first h."""
    own = conversations.select("conv", "turns", (F.crc32(F.col("conv").cast("string")) % heads).cast("int").alias("h"),
                               (F.col("conv") - F.col("conv") % group).alias("leader"))
    lead = conversations.where(F.col("conv") % group == 0).select(F.col("conv").alias("leader"), F.slice("turns", 1, max(1, heads - 1)).alias("lead"))
    both = F.concat(F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), F.col("h")),
                    F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return (own.join(lead, "leader", "left").select("conv", both.alias("all"))
            .select("conv", F.col("all")["key"].alias("path"), F.col("all")["words"].alias("words")))


class DoubleArray:
    """A trie of sorted paths of dense codes: child ``c`` of state ``s`` is ``base[s] + c``, if ``check`` of that is ``s``."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        """``codes``: all paths' codes, one path after the other; path i begins at ``first[i]``."""
        size = np.diff(first)
        depth = int(size.max(initial=0))
        top = int(codes.max(initial=0)) + 1
        room = top + 2 * len(codes) + 2
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0] = 0
        self.levels, self.state_of = [np.zeros(1, np.int64)], np.zeros(len(codes), np.int64)
        free, state = 1, np.zeros(len(size), np.int64)
        for level in range(depth):
            live = np.flatnonzero(size > level)
            at = first[live] + level
            pairs = np.stack([state[live], codes[at]])
            new = np.ones(len(live), bool)
            new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)  # paths are sorted: equal children are neighbours
            parents, children = pairs[:, new]
            begins = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            for a, b in zip(begins, np.append(begins[1:], len(parents))):
                free = self._place(int(parents[a]), children[a:b], free)
            states = self.base[parents] + children
            state[live] = states[np.cumsum(new) - 1]
            self.state_of[at] = state[live]
            self.levels.append(states)

    def _place(self, parent: int, children: np.ndarray, free: int) -> int:
        """The first base at which all of a node's children fall on free places; the new first free place."""
        while self.check[free] >= 0:
            free += 1
            if free + 1 >= len(self.check):
                self._grow()
        at, least, most = free, int(children.min()), int(children.max())
        while True:
            base = at - least
            while base + most + 2 >= len(self.check):
                self._grow()
            if len(children) == 1 or (self.check[base + children] < 0).all():
                break
            at += 1
            while self.check[at] >= 0:
                at += 1
                if at + 1 >= len(self.check):
                    self._grow()
        self.base[parent] = base
        self.check[base + children] = parent
        return free

    def _grow(self) -> None:
        more = len(self.check)
        self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def walk(self, path: np.ndarray) -> np.ndarray:
        """The states along a path of codes, as far as there are any."""
        out, state = [], 0
        for code in path.tolist():
            to = int(self.base[state]) + code
            if not 0 <= to < len(self.check) or self.check[to] != state or to == 0:
                break
            out.append(to)
            state = to
        return np.array(out, np.int64)


NODE = "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, edge boolean"


def shard_nodes(keys: np.ndarray, first: np.ndarray, words: np.ndarray, copies: np.ndarray, least: np.ndarray) -> dict:
    """The columns of NODE for a shard of sorted, different paths.

    ``keys`` (n, 2) are the turns of all paths. Edge nodes have what the shard knows: members, their least id, children and
    subtrees below them that are not edge nodes themselves.
    """
    unique, codes = np.unique(keys, axis=0, return_inverse=True) if len(keys) else (keys, np.empty(0, np.int64))
    rank = np.empty(len(unique), np.int64)  # dense ids in the order of their first path, so that sorted paths have neighbouring children
    places = np.full(len(unique), len(codes), np.int64)
    np.minimum.at(places, codes.ravel(), np.arange(len(codes)))
    rank[np.argsort(places)] = np.arange(len(unique))
    codes = rank[codes.ravel()]
    trie = DoubleArray(codes, first)
    size = np.diff(first)
    count, low = np.zeros(len(trie.check), np.int64), np.full(len(trie.check), np.iinfo(np.int64).max)
    weight = np.zeros(len(trie.check), np.int64)
    path = np.repeat(np.arange(len(size)), size)
    np.add.at(count, trie.state_of, copies[path])
    np.minimum.at(low, trie.state_of, least[path])
    weight[trie.state_of] = words
    count[0], low[0] = copies.sum(), least.min()
    edge = np.zeros(len(trie.check), bool)
    edge[0] = True
    for p in {0, len(size) - 1}:
        edge[trie.walk(codes[first[p]: first[p + 1]])] = True
    states = np.concatenate(trie.levels)
    parent = trie.check[states]
    parent[0] = -1
    below = ~edge[states]
    children = np.bincount(parent[below], minlength=len(trie.check))
    own = np.where(edge, 0, (count - 1) * weight)
    saved, leaves = own.copy(), np.where(edge, 0, (children == 0).astype(np.int64))
    for level in trie.levels[:0:-1]:
        level = level[~edge[level]]
        np.add.at(saved, trie.check[level], saved[level])
        np.add.at(leaves, trie.check[level], leaves[level])
    names, depths = {0: ROOT}, np.repeat(np.arange(len(trie.levels)), [len(x) for x in trie.levels])
    turn = np.zeros(len(trie.check), np.int64)
    turn[trie.state_of] = np.arange(len(codes))
    raw = np.ascontiguousarray(keys)
    for state, up in zip(states[1:].tolist(), parent[1:].tolist()):
        names[state] = hashlib.md5(names[up] + raw[turn[state]].tobytes()).digest()
    known = (parent >= 0) & ~edge[np.maximum(parent, 0)]
    return {"key": pa.array([names[s] for s in states.tolist()], pa.binary()),
            "parent": pa.array([None if p < 0 else names[p] for p in parent.tolist()], pa.binary()),
            "conv_id": pa.array(low[states]), "depth": pa.array(depths),
            "parent_conv_id": pa.array(low[np.maximum(parent, 0)], mask=~known),
            "n_convs": pa.array(count[states]), "n_children": pa.array(children[states]), "n_leaves": pa.array(leaves[states]),
            "saved_tokens": pa.array(saved[states]), "words": pa.array(weight[states]), "edge": pa.array(edge[states])}


def _shards(limit: int):
    """Sorted (path, words, copies, least) rows of a task to NODE rows, a shard of some ``limit`` turns at a time."""
    def lists(column: pa.Array):
        flat, offsets = column.flatten(), column.offsets.to_numpy()
        return flat, offsets - offsets[0]

    def emit(parts):
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        flat, first = lists(table.column("path"))
        words = lists(table.column("words"))[0].to_numpy(zero_copy_only=False).astype(np.int64)
        keys = np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(-1, 2)
        return pa.record_batch(shard_nodes(keys, first.astype(np.int64), words, table.column("copies").to_numpy(), table.column("least").to_numpy()))

    def run(batches):
        held, turns = [], 0
        for batch in batches:
            at, offsets = 0, batch.column("path").offsets.to_numpy()
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - turns, side="right")) - 1)
                held.append(batch.slice(at, to - at))
                turns += int(offsets[to] - offsets[at])
                at = to
                if turns >= limit or sum(x.num_rows for x in held) >= limit:
                    yield emit(held)
                    held, turns = [], 0
        if held:
            yield emit(held)

    return run


def _edges(rows: DataFrame) -> DataFrame:
    """The edge nodes of all shards, each once, with sums over their whole subtrees."""
    merged = rows.groupBy("key").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
                                     F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("inner_leaves"),
                                     F.sum("saved_tokens").alias("inner_saved"), F.first("words").alias("words"))
    merged = stored(merged, "edges")
    outer = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("outer"))
    ups = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(merged.join(outer, "key", "left").join(ups, "parent", "left").select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("inner") + F.coalesce("outer", F.lit(0))).alias("n_children"),
        (F.col("inner_leaves") + (F.col("inner") + F.coalesce("outer", F.lit(0)) == 0).cast("long")).alias("n_leaves"),
        (F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "edges")
    dropped(merged)
    sums = nodes.select("key", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    while not sums.where("up is not null").isEmpty():  # after k rounds a node has the sums of what is less than 2^k below it
        given = (sums.where("up is not null").groupBy(F.col("up").alias("key"))
                 .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")))
        higher = sums.select(F.col("key").alias("up"), F.col("up").alias("higher"))
        sums = stored(sums.join(given, "key", "left").join(higher, "up", "left").select(
            "key", F.col("higher").alias("up"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")), "sums")
    return nodes.drop("n_leaves", "saved_tokens").join(sums.drop("up"), "key")


def _runs(batches):
    """(node, first, ids) of sorted (node, conv) rows: at most RUN decimal ids of one node, comma-joined."""
    for batch in batches:
        table = pa.table({"node": batch.column(0), "conv": batch.column(1)})
        nodes, convs = table.column(0).to_pylist(), table.column(1).to_pylist()
        out, at = [], 0
        while at < len(nodes):
            to = at + 1
            while to < len(nodes) and to - at < RUN and nodes[to] == nodes[at]:
                to += 1
            out.append((nodes[at], convs[at], ",".join(map(str, convs[at:to]))))
            at = to
        node, first, ids = zip(*out) if out else ((), (), ())
        yield pa.record_batch([pa.array(node, pa.binary()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], ["node", "first", "ids"])


def _hashed(batches):
    """(node, ends_sha256) of runs sorted by node and first id; one node's state is held at a time."""
    node, state = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if key != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        done, digests = zip(*out) if out else ((), ())
        yield pa.record_batch([pa.array(done, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv): the digest of each node's ids in numeric order."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = members.repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_runs, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def nodes(sequences: DataFrame, limit: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of (conv, path, words) rows: least member, depth, parent's least member, members, children, leaves
    and saved words of the subtree, and the digest of the members that end there."""
    ship(sequences.sparkSession)
    sequences = stored(sequences, "paths")
    paths = sequences.groupBy("path").agg(F.first("words").alias("words"), F.count("*").alias("copies"), F.min("conv").alias("least"))
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(paths.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(_shards(limit), NODE), "nodes")
    upper = stored(_edges(rows.where("edge")), "upper")
    inner = rows.where("not edge").join(upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("_upper")), "parent", "left")
    shown = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_upper")).select(shown)
    found = ends(sequences.select(_path_key(F.col("path")).alias("node"), "conv"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (inner.unionByName(upper.select(shown)).join(found, F.col("key") == F.col("node"), "left")
            .select(*shown[1:], F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def trie(turns: DataFrame, limit: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the rebuilt conversations of a table of turns."""
    return nodes(rebuilt(stored(numbered(turns), "turns")), limit)
