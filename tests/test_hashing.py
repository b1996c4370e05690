"""Probing of hash indexes: the same results as comparing all, by far fewer comparisons."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkverity.functions import hashing as H
from sparkverity.operators import hashing as HJ
from sparkverity.session import new_dir


def rows(spark, hashes, name):
    return spark.createDataFrame([(k, f"{h:016x}") for k, h in hashes], f"{name} long, hex string")


def mixed(n, seed):
    """Random hashes, groups of near copies and equal ones."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    out += [h ^ sum(1 << b for b in rng.sample(range(64), k % 17)) for k, h in enumerate(out[: n // 2])]
    return list(enumerate(out + out[:20] + [0, 0, (1 << 64) - 1]))


@pytest.mark.parametrize("sent", [HJ.SENT, 0])
def test_rounds_find_the_nearest(spark, monkeypatch, sent):
    """With thousands of references several rings are visited, and what is left is compared by cells."""
    monkeypatch.setattr(HJ, "SENT", sent)
    refs, queries = mixed(3000, 1), mixed(150, 1)[100:] + mixed(40, 2)
    queries = [(k, h) for k, (_, h) in enumerate(queries)]
    want = {k: min((bin(h ^ x).count("1"), i) for i, x in refs) for k, h in queries}
    got = HJ.nearest(rows(spark, queries, "query_id"), rows(spark, refs, "ref_id"), query_block=16, block_rows=1000).collect()
    assert len(got) == len(queries) and {r.query_id: (r.distance, r.ref_id) for r in got} == want
    assert min(want.values())[0] == 0 and max(want.values())[0] > 11


@pytest.mark.parametrize("d", [0, 1, 2, 3, 4, 7, 10, 13])
def test_pairs_within(spark, d):
    refs, queries = mixed(200, 1), mixed(60, 1)
    want = sorted((a, b, n) for a, x in queries for b, y in refs if (n := bin(x ^ y).count("1")) <= d)
    assert sorted(map(tuple, HJ.within(rows(spark, queries, "query_id"), rows(spark, refs, "ref_id"), d).collect())) == want


def test_radii_are_enough():
    """However d differing bits fall on the four words, one lies within its radius."""
    for d in range(15):
        for a in range(d + 1):
            for b in range(d + 1 - a):
                for c in range(d + 1 - a - b):
                    assert any(n <= r for n, r in zip((a, b, c, d - a - b - c), HJ.radii(d), strict=True))


def test_few_candidates_of_a_million(spark):
    """At 10 bits under one pair in a hundred of random hashes is met, and no join compares all."""
    refs = spark.range(1_000_000).select(F.col("id").alias("ref_id"), F.lower(F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("hex"))
    index = HJ.build_index(refs)
    queries = spark.range(300).select(F.lower(F.lpad(F.hex(F.xxhash64(F.col("id") * 3333)), 16, "0")).alias("hex"))
    asked = queries.select(H.half(F.col("hex"), 0).alias("_qhi"), H.half(F.col("hex"), 1).alias("_qlo"))
    candidates = HJ.met(asked, 300, index, [(0, r) for r in HJ.radii(10)])
    assert 0 < candidates.count() < 0.01 * 300 * 1_000_000
    plan = candidates._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    found = HJ.within(queries.select(F.monotonically_increasing_id().alias("query_id"), "hex"), index, 10)
    assert found.where("distance = 0").count() == 300


def test_an_index_is_read_again(spark):
    refs, queries = mixed(100, 4), mixed(30, 4)
    path = new_dir(spark, "index")
    first = HJ.build_index(rows(spark, refs, "ref_id"), path)
    again = HJ.open_index(spark, path)
    q = rows(spark, queries, "query_id")
    assert again.n == first.n and sorted(HJ.nearest(q, again).collect()) == sorted(HJ.nearest(q, first).collect())


def test_nearest_without_rows(spark):
    q, r = rows(spark, [(1, 5)], "query_id"), rows(spark, [(2, 7)], "ref_id")
    assert HJ.nearest(q.where("false"), r).count() == 0
    assert [tuple(x) for x in HJ.nearest(q, r.where("false")).collect()] == [(1, None, None)]
    odd = spark.createDataFrame([(1, None), (2, "zz"), (3, ""), (4, "7")], "query_id long, hex string")
    assert {x.query_id: x.distance for x in HJ.nearest(odd, r).collect()} == {1: None, 2: None, 3: None, 4: 0}
    assert HJ.within(odd, r, 3).count() == 1
