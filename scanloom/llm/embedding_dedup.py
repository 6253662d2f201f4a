"""Near-duplicate embeddings: int8 tile products with error bounds, exact products for what may pass.

Equal vectors of a label are one class. The classes of a label are dealt to blocks by a hash,
and every pair of blocks of the label is a tile. In a tile, each unit vector x is s q + e with
int8 q; a product x.y differs from s s' q.q' by at most |e| + |s q| |e'|. The q.q' come from one
matrix product (whole numbers below 2 to the 24, exact in single precision in parts of
``PART`` dimensions); only pairs whose bound reaches the threshold are recomputed in double
precision. A tile gives link counts and a spanning forest, never its pairs.

The work is quadratic in the different vectors of a label, as all pairs of a label are asked
for; a vector is sent once per block of its label.

Defined results: a vector that is null, empty, zero or has null or non-finite components, or whose
label is null, links with nothing, nor does a row without an id, whose component is null.
Vectors of other lengths are compared only among their own length. Rows with one id are vectors of
their own that share a component.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

THRESHOLD = 0.93
BLOCK = 4096
PART = 1024
#: More than all rounding in the bounds.
SLACK = 1e-5


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per vector: int8 values, scale, length of the quantised vector and length of the error."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    out = a[:, :PART].astype(np.float32) @ b[:, :PART].T.astype(np.float32)
    for at in range(PART, a.shape[1], PART):
        out = out.astype(np.float64) + a[:, at: at + PART].astype(np.float32) @ b[:, at: at + PART].T.astype(np.float32)
    return out


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float = THRESHOLD, rows: int = 512):
    """(i, j) of all pairs whose cosine reaches the threshold, part by part; without ``right``, pairs i < j of ``left``."""
    def units(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    a = units(left)
    b = a if right is None else units(right)
    qa, sa, na, ea = quantise(a)
    qb, sb, _, eb = quantise(b)
    for at in range(0, len(a), rows):
        begin = at if right is None else 0
        to = slice(at, at + rows)
        bound = _products(qa[to], qb[begin:]) * sa[to, None] * sb[begin:]
        bound += ea[to, None] + na[to, None] * eb[begin:]
        i, j = np.nonzero(bound >= threshold - SLACK)
        i, j = i + at, j + begin
        if right is None:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 18):
            x, y = i[part: part + (1 << 18)], j[part: part + (1 << 18)]
            l, r = left[x], (left if right is None else right)[y]
            cosine = np.einsum("ij,ij->i", l, r) / (np.linalg.norm(l, axis=1) * np.linalg.norm(r, axis=1))
            yield x[cosine >= threshold], y[cosine >= threshold]


class Forest:
    """Union and find, with the least member as root."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)

    def join_all(self, x: np.ndarray, y: np.ndarray) -> None:
        """Join pairs: follow all roots, keep pairs that are still apart, join one pair of each root."""
        while len(x):
            while (up := self.root[self.root]).tolist() != self.root.tolist():
                self.root = up
            a, b = self.root[x], self.root[y]
            x, y, a, b = x[a != b], y[a != b], np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            np.minimum.at(self.root, b, a)

    def roots(self) -> np.ndarray:
        while (up := self.root[self.root]).tolist() != self.root.tolist():
            self.root = up
        return self.root


def _tile(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    first = rows["side"].to_numpy() == 0
    ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
    order = np.lexsort((ids, ~first))
    first, ids, copies = first[order], ids[order], copies[order]
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)[order]
    most = np.abs(vectors).max(axis=1)
    far = (most > 1e100) | (most < 1e-100)  # their squares would leave the range of doubles
    vectors[far] /= most[far, None]
    split = int(first.sum())
    left, right = vectors[:split], vectors[split:]
    both = rows["i"].iat[0] != rows["j"].iat[0]
    if both and not (len(left) and len(right)):
        return pd.DataFrame({"id": [], "links": [], "root": []})
    counts, x_all, y_all = np.zeros(len(ids), np.int64), [], []
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # least member as root
    forest = Forest(len(ids))
    for x, y in tile_links(left, right if both else None, threshold):
        y = y + split * both
        np.add.at(counts, x, copies[y])
        np.add.at(counts, y, copies[x])
        forest.join_all(rank[x], rank[y])
    roots = np.sort(ids, kind="stable")[forest.roots()[rank]]
    some = counts > 0
    return pd.DataFrame({"id": ids[some], "links": counts[some], "root": roots[some]})


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    kind = rows.schema[key].dataType.simpleString()
    label_kind = rows.schema[label].dataType.simpleString()
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    usable: Column = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))
    plain = F.transform(doubles, lambda x: x + 0.0)  # one zero
    base = stored(rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.when(usable, plain).alias("vector")), "vectors")
    group = F.struct("label", F.md5(F.array_join(F.col("vector").cast("array<string>"), ",")).alias("digest"))
    known = base.where("vector is not null").select("key", "vector", group.alias("group"))
    classes = stored(known.groupBy("group").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    part = F.struct(F.col("group.label").alias("label"), F.size("vector").alias("size"))
    blocks = classes.groupBy(part.alias("part")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = (classes.select("id", "copies", "vector", part.alias("part")).join(blocks, "part")
              .withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")))
    tiles = placed.select("id", "copies", "vector", "part", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("id", "copies", "vector", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         (F.col("own") > F.col("other")).cast("int").alias("side"))

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        return _tile(rows, threshold)

    found = stored(tiles.groupBy("part", "i", "j").applyInPandas(tile, f"id {kind}, links long, root {kind}"), "tiles")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_class = (classes.select("group", "id", "copies").join(counts, "id", "left")
                .join(linked.withColumnRenamed("node", "id"), "id", "left")
                .select("group", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "id").alias("component_id")))
    joined = base.select("key", F.when(F.col("vector").isNotNull(), group).alias("group")).join(by_class, "group", "left")
    return joined.select("key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "key").alias("component_id"),
                         F.coalesce(F.col("key") == F.coalesce("component_id", "key"), F.lit(False)).alias("kept"))
