"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is the first ``BITS`` bits of its key's MD5. A bucket is a prefix of hash
bits; one above the byte limit splits on the next bit, the others stay. The sizes
of all prefixes of a stretch of bits come from one aggregate over the cells at its end, so
a stretch takes one pass over (key, size), whatever the number of splits; only rows in cells
that are still too large go on to the next stretch. The directory has, for every cell, the
shard that its prefix leads to.

Defined results: rows above the limit get shards of their own. Rows that share the whole hash
(repeated keys, null keys) and do not fit together are dealt to numbered pages of their bucket,
by running sizes taken in each input partition and added up, so no task sees them all. Null
sizes count as 0. An empty table has no shards. Every row is kept, extra columns stay out.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BITS = 60
LIMIT = 64 << 20
#: Bits that a stretch has beyond those of an even split.
SPARE = 3


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key as a number; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    bits = F.lpad(F.conv(prefix.cast("string"), 10, 2), BITS, "0")
    return F.concat(F.lit("b"), F.when(depth > 0, F.substring(bits, BITS + 1 - depth, depth)).otherwise(""))


def _nodes(rows: DataFrame, begin: int, end: int) -> DataFrame:
    """The size of every prefix of ``begin`` to ``end`` bits."""
    cells = rows.groupBy(F.shiftright("hash", BITS - end).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    return (cells.select(F.explode(F.sequence(F.lit(begin), F.lit(end))).alias("depth"), "cell", "size", "rows")
            .groupBy("depth", F.expr(f"shiftright(cell, {end} - depth)").alias("prefix"))
            .agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash in pages: large ones alone, others by half limits of their running size."""
    large = F.col("size") * 2 > limit
    weight = F.when(large, F.lit(1)).otherwise(F.col("size"))
    rows = rows.withColumn("large", large).withColumn("weight", weight)
    part = Window.partitionBy("hash", "large", "part").orderBy("size", "key").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("hash", "large", "part").agg(F.sum("weight").alias("weight"))
    before = Window.partitionBy("hash", "large").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("hash", "large", "part", F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("before"))
    place = F.coalesce(F.sum("weight").over(part), F.lit(0))
    placed = rows.withColumn("place", place).join(sums, ["hash", "large", "part"])
    page = F.when(F.col("large"), F.concat(F.lit(".l"), F.col("place") + F.col("before"))).otherwise(
        F.concat(F.lit(".s"), F.floor((F.col("place") + F.col("before")) * 2 / F.lit(limit))))
    return placed.select("key", "hash", "size", "part", F.concat(_bits(F.col("hash"), F.lit(BITS)), page).alias("shard"),
                         F.lit(BITS).alias("depth"))


def assign(rows: DataFrame, key: str, size: Column, limit: int = LIMIT) -> DataFrame:
    """(key, size, shard, depth, shard_bytes, shard_rows) of every row."""
    kind = rows.schema[key].dataType.simpleString()
    keyed = stored(rows.select(F.col(key).cast(kind).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
                               hash_bits(F.col(key)).alias("hash"), F.spark_partition_id().alias("part")), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    stretch = min(BITS, SPARE + max(0, math.ceil(math.log2(max(1, total) / limit))))
    paged, done, begin = keyed.where(F.col("size") > limit), [], 0
    rest = keyed.where(F.col("size") <= limit)
    while begin < BITS:
        end = min(BITS, begin + stretch)
        nodes = stored(_nodes(rest, begin, end), "nodes")
        over = nodes.where(F.col("size") > limit)
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fitting = nodes.where(F.col("size") <= limit)
        split = fitting.join(parents, (F.shiftright("prefix", 1) == F.col("parent")) & (fitting["depth"] == parents["depth"]),
                             "left_semi")
        whole = fitting.where(F.col("depth") == 0)
        leaves = split.unionByName(whole) if begin == 0 else split
        directory = leaves.select(
            F.expr(f"explode(sequence(shiftleft(prefix, {end} - depth), shiftleft(prefix + 1, {end} - depth) - 1))").alias("cell"),
            _bits(F.col("prefix"), F.col("depth")).alias("shard"), "depth")
        cell = F.shiftright("hash", BITS - end).alias("cell")
        done.append(rest.select("*", cell).join(directory, "cell").select("key", "hash", "size", "part", "shard", "depth"))
        full = over.where(F.col("depth") == end).select(F.col("prefix").alias("cell"))
        if full.isEmpty():
            rest = None
            break
        rest = stored(rest.select("*", cell).join(full, "cell", "left_semi").drop("cell"), "rest")
        begin = end
    if rest is not None:
        paged = paged.unionByName(rest)
    placed = _pages(paged, limit)
    for part in done:
        placed = placed.unionByName(part)
    placed = stored(placed.select("key", "size", "shard", "depth"), "placed")
    sums = placed.groupBy("shard").agg(F.sum("size").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return placed.join(sums, "shard").select("key", "size", "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, placed: DataFrame, key: str, path: str) -> None:
    """One folder per shard with its documents; ``key`` must name each document once."""
    name = "_shard_key"
    joined = docs.join(placed.select(F.col("key").alias(name), "shard"), F.col(key).eqNullSafe(F.col(name))).drop(name)
    joined.repartition("shard").write.partitionBy("shard").parquet(path)
