"""Shards against splitting buckets one by one."""
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import cases
from scanloom.llm import sharding as s


def brute(rows, limit):
    """Shards of rows whose hashes differ and that all fit."""
    buckets, done = {"": [(bin(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60), k, n) for k, n in rows]}, {}
    while buckets:
        prefix, held = buckets.popitem()
        if sum(n for _, _, n in held) <= limit:
            done |= {k: "b" + prefix for _, k, _ in held}
        else:
            for bit in "01":
                buckets[prefix + bit] = [x for x in held if x[0][len(prefix)] == bit]
    return done


@pytest.mark.parametrize("limit", [40, 1000, 10**9])
def test_splits(spark, limit):
    rows = [(i, (i * 7919) % 37) for i in range(700)]
    got = s.assign(spark.createDataFrame(rows, "doc_id long, n int"), "doc_id", F.col("n"), limit).collect()
    want = brute(rows, limit)
    assert {r.key: r.shard for r in got} == want and len(got) == len(rows)
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.size
    assert all(r.shard_bytes == sums[r.shard] <= limit and r.depth == len(r.shard) - 1 for r in got)


def test_rows_that_no_bit_separates(spark):
    rows = [(1, 10)] * 30 + [(None, 7)] * 20 + [(2, 500), (2, 500), (3, None), (4, 60), (4, 60), (4, 1)]
    got = s.assign(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, n int, shard string, key string").repartition(4),
                   "doc_id", F.col("n"), 100).collect()
    assert sorted((r.key is None, r.key or 0, r.size) for r in got) == sorted((k is None, k or 0, n or 0) for k, n in rows)
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.size
    assert all(sums[r.shard] <= 100 or (r.size == 500 and r.shard_rows == 1) for r in got)


def test_awkward_documents_and_files(spark, tmp_path):
    table = cases.docs(spark, cases.awkward())
    got = s.assign(table, "doc_id", F.octet_length("text"), 1000)
    assert got.count() == table.count()
    assert s.assign(table.limit(0), "doc_id", F.octet_length("text"), 1000).count() == 0
    some = table.where("doc_id in (1, 4, 5, 6)")
    path = f"file://{tmp_path}/shards"
    s.write_shards(some, s.assign(some, "doc_id", F.octet_length("text"), 20), "doc_id", path)
    assert spark.read.parquet(path).select("doc_id", "text").exceptAll(some.select("doc_id", "text")).count() == 0
    assert spark.read.parquet(path).count() == 4
