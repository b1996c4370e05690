"""SimHash fingerprints and near-duplicate components by vantage-point trees.

Fingerprints: XXH64 (seed 42) of every 3-word shingle, repeats included; a bit is 1 if over half
the hashes have it. Equal fingerprints are folded first, so exact copies cost one row each and
what follows works on distinct values.

A vantage tree over a sample of ``SAMPLE_A_SHARD`` values for each wanted shard (8 bytes each, in the
driver) cuts the space into shards of about ``shard_rows`` values by Hamming distance. Every value has
a home shard and also visits the shards whose boundary lies within the search radius (triangle bound),
so that each pair within the radius meets in the home shard of either value. Homes and visits are
counted by shard, and shards that have more are dealt into parts: a task gets at most about
``shard_rows`` home values and ``visitor_rows`` values that look for them, each 17 bytes; every home part
meets every visitor part. There a vantage-point tree over the home values is searched with
all visitors at once; linked values are merged on the spot and only a spanning star comes back, never
all pairs of a group.

The stars are joined by alternating large-star and small-star steps. Values that stand in one star only
follow its centre and take no part in that. A centre, component or fingerprint that holds one part in
256 of the rows of a join or more is broadcast to it (256 rows at most), so that none makes a hot task.

Random 64-bit values prune badly in any metric tree: the number of visits of a value grows with the
depth of the tree (7 at a million distinct values, about 41 at a hundred million).

Defined results: a null or wordless text has fingerprint zero and is linked like any other;
fewer than three words are one shingle; component_id is the smallest doc_id reachable; rows with
a null doc_id belong to components but never name them; repeated rows come out as often as they
come in; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sparkverity.llm.common import as_bytes, bounded_batches, checkpointed, remove, spread_join, stored

SHINGLE = 3
RADIUS = 3
SEED = 42
SAMPLE_A_SHARD = 64
LEAST_SAMPLE = 4096
SHARD_ROWS = 65_536
VISITOR_ROWS = 262_144
LEAF = 48
#: Home values by values that ask of one block of distances (16 MB), and texts of one Arrow batch.
TILE = 256, 8_192
TEXT_BYTES = 4 << 20
_BITS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    own = text.lower().split() if text else []
    if not own:
        return 0
    parts = zip(*(own[i:] for i in range(shingle)), strict=False) if len(own) >= shingle else [own]
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document."""
    bounded_batches(docs.sparkSession, TEXT_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _distance(values: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ to)


def _vantage(values: np.ndarray) -> np.uint64:
    """Of a few values spread over the array, the one whose distances vary most."""
    tries = values[np.linspace(0, len(values) - 1, min(8, len(values))).astype(np.int64)]
    probe = values[:: max(1, len(values) // 512)]
    return tries[int(np.argmax([_distance(probe, x).astype(np.float32).var() for x in tries]))]


def shard_tree(sample: np.ndarray, total: int, shard_rows: int = SHARD_ROWS):
    """Nested (vantage point, median, near, far); a leaf is a shard number."""
    counter = iter(range(1 << 30))

    def build(values: np.ndarray):
        if len(values) < 8 or total * len(values) <= shard_rows * len(sample):
            return next(counter)
        vp = _vantage(values)
        d = _distance(values, vp)
        mu = int(np.median(d))
        near = d <= mu
        if near.all():
            return next(counter)
        return vp, mu, build(values[near]), build(values[~near])

    return build(sample)


def route(tree, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, index into fps, whether the shard is its home)."""
    out = []

    def walk(node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            out.append((np.full(len(at), node, np.int32), at, home))
            return
        vp, mu, near, far = node
        d = _distance(fps[at], vp).astype(np.int16)
        inside = d <= mu
        left, right = d - radius <= mu, d + radius > mu
        walk(near, at[left], home[left] & inside[left])
        walk(far, at[right], home[right] & ~inside[right])

    walk(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def link(fps: np.ndarray, home: np.ndarray, asks: np.ndarray | None = None, radius: int = RADIUS) -> np.ndarray:
    """For each value the index of the smallest one linked to it, directly or through others, by
    pairs of a home value and one that asks (all do, unless told). fps: sorted and distinct."""
    root = np.arange(len(fps))

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up

    def search(at: np.ndarray, queries: np.ndarray) -> None:
        if not len(at) or not len(queries):
            return
        if len(at) > LEAF:
            vp = _vantage(fps[at])
            d = _distance(fps[at], vp).astype(np.int16)
            mu = int(np.median(d))
            near = d <= mu
            if not near.all():
                dq = _distance(fps[queries], vp).astype(np.int16)
                search(at[near], queries[dq - radius <= mu])
                search(at[~near], queries[dq + radius > mu])
                return
        for lo in range(0, len(at), TILE[0]):
            for lq in range(0, len(queries), TILE[1]):
                own, others = at[lo : lo + TILE[0]], queries[lq : lq + TILE[1]]
                i, j = np.nonzero(np.bitwise_count(fps[own][:, None] ^ fps[others][None, :]) <= radius)
                a, b = own[i], others[j]
                keep = a != b
                if keep.any():
                    merge(a[keep], b[keep])

    search(np.nonzero(home)[0], np.arange(len(fps)) if asks is None else np.nonzero(asks)[0])
    return root


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("fp", kind="stable")
    signed, role = pdf["fp"].to_numpy(), pdf["role"].to_numpy()
    root = link(signed.view(np.uint64), (role & 1) > 0, (role & 2) > 0)
    moved = root != np.arange(len(root))
    return pd.DataFrame({"a": signed[moved], "b": signed[root[moved]]})


_MIX = np.uint64(0x9E3779B97F4A7C15)


def dealt(fps: np.ndarray, shard: np.ndarray, home: np.ndarray, home_parts: np.ndarray, ask_parts: np.ndarray):
    """(index, group, role) of the copies that go to the groups of a shard; a group is one of
    home_parts x ask_parts, role 1 a home value, 2 one that asks, 3 both."""
    mixed = (fps * _MIX) >> np.uint64(33)
    i, j = (mixed % home_parts[shard].astype(np.uint64)).astype(np.int64), (mixed // np.uint64(7) % ask_parts[shard].astype(np.uint64)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(home_parts * ask_parts)])[shard]
    at, group, role = [], [], []
    for k in range(int(home_parts.max(initial=1))):  # every value asks once in each home part
        own = np.nonzero(k < home_parts[shard])[0]
        at.append(own)
        group.append((first + k * ask_parts[shard] + j)[own])
        role.append(np.where(home[own] & (i[own] == k), 3, 2))
    for k in range(int(ask_parts.max(initial=1))):  # a home value is met in each part of those that ask
        own = np.nonzero(home & (k < ask_parts[shard]) & (j != k))[0]
        at.append(own)
        group.append((first + i * ask_parts[shard] + k)[own])
        role.append(np.ones(len(own), np.int64))
    return tuple(np.concatenate(x) for x in (at, group, role))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b to stars (a, root)."""
    spark = edges.sparkSession
    edges = checkpointed(edges.distinct())
    total = edges.count()
    centres = edges.select(F.col("b").alias("a")).distinct().withColumn("centre", F.lit(True))
    of = edges.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("stars")).join(centres.hint("merge"), "a", "left")
    of = checkpointed(of)
    inner = (F.col("stars") > 1) | F.col("centre").isNotNull()
    joining = edges.join(of.where(inner).select("a").hint("merge"), "a", "left_semi")
    roots, path = _alternate(joining)
    leaves = of.where(~inner).select(F.col("a").alias("leaf"), F.col("b").alias("a"))
    followed = spread_join(leaves, roots, "a", total, "left").select(F.col("leaf").alias("a"), F.coalesce("root", "a").alias("root"))
    out = checkpointed(roots.unionByName(followed))
    remove(spark, path)
    return out


def _alternate(edges: DataFrame) -> tuple[DataFrame, str]:
    """Stars (a, root) by alternating large-star and small-star steps; a table and its path."""
    spark = edges.sparkSession
    (edges, path), before = stored(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or state == before:
            return edges.withColumnRenamed("b", "root"), path
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.where("b > a"), least, "a", state.n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        (large, large_path) = stored(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, "a", state.n)
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        (edges, after) = stored(small, "edges")
        remove(spark, path)
        remove(spark, large_path)
        path = after


def near_duplicates(
    docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, visitor_rows: int = VISITOR_ROWS,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    if radius != RADIUS:
        raise ValueError(f"the shards are built for a radius of {RADIUS}")
    spark = docs.sparkSession
    marked = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    sums = distinct.agg(F.count("*").alias("total"), F.sum("n").alias("rows")).first()
    total, rows = sums.total, sums.rows or 0
    wanted = max(LEAST_SAMPLE, SAMPLE_A_SHARD * (total // shard_rows))
    sample = [r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()]
    tree = spark.sparkContext.broadcast(shard_tree(np.array(sample, np.int64).view(np.uint64), total, shard_rows))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, _, home = route(tree.value, batch.column("fp").to_numpy().view(np.uint64))
            own, n = np.unique(shard, return_counts=True)
            homes = np.bincount(np.searchsorted(own, shard[home]), minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array(homes)], names=["shard", "n", "homes"])

    counts = distinct.select("fp").mapInArrow(visits, "shard int, n long, homes long").groupBy("shard").agg(F.sum("n").alias("n"), F.sum("homes").alias("homes")).collect()
    home_parts, ask_parts = np.ones((2, 1 + max((r.shard for r in counts), default=0)), np.int64)
    for r in counts:
        home_parts[r.shard], ask_parts[r.shard] = max(1, -(-r.homes // (2 * shard_rows))), max(1, -(-r.n // visitor_rows))
    parts = spark.sparkContext.broadcast((home_parts, ask_parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            shard, at, home = route(tree.value, fps.view(np.uint64))
            own, group, role = dealt(fps[at].view(np.uint64), shard, home, *parts.value)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(fps[at][own]), pa.array(role.astype(np.int8))], names=["group", "fp", "role"])

    n_groups = int((home_parts * ask_parts).sum())
    sent = distinct.select("fp").mapInArrow(deal, "group long, fp long, role byte").repartition(max(n_groups, spark.sparkContext.defaultParallelism), "group")
    roots = components(sent.groupBy("group").applyInPandas(_stars, "a long, b long"))
    linked = distinct.join(roots.hint("merge"), distinct.fp == roots.a, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    linked = checkpointed(linked)
    named = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = checkpointed(spread_join(linked, named, "root", total).select("fp", "component_id"))
    return spread_join(marked, by_fp, "fp", rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The documents, whole, that come first in their component: by doc_id, null ids last, then by a hash
    of all columns. Rows of one doc_id but other texts are documents apart; rows alike in all columns are one."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64(*columns).alias("row"))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), **parameters).where(F.col("doc_id") == F.col("component_id"))
    kept = found.select(F.col("doc_id.row").alias("_row"), F.coalesce(F.col("doc_id.doc_id").cast("string"), F.lit("")).alias("_id")).distinct()
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.xxhash64(*columns).alias("_row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
    )
    return rows.join(kept.hint("merge"), ["_row", "_id"], "left_semi").dropDuplicates(["_row", "_id"]).select("_doc.*")
