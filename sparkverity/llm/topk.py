"""Exact top-k by inner product: dual-tree search over cover trees.

Components become floor(1024 x), so scores are whole numbers. Pivots, picked farthest-first from a
bounded sample, are the top level of the data: every vector belongs to its nearest pivot, and a pivot's
group is split by hash into shards of at most about ``shard_rows`` rows, so a crowded pivot is no large
group. The first pivots are the top level of the queries too: a query belongs to the block of its
nearest one, split by hash into blocks of about ``block_queries``. Placed rows are written once.

The search has two rounds. In the first, a query goes to one shard only, of the pivot with which its
product is largest, with a bound on its kth score from the sample. What it finds there is its bound in
the second, where it goes to those pivots whose ball can hold as good a score: <q, p> + |q| R with the
radius R around p. A task holds one block of queries and one shard, which is sent to the blocks that ask
for it: queries once and shards once for each block that asks them are shuffled in the first round; in the
second blocks times rows and shards times queries, as far as nothing can be cut.

There a cover tree over the block's queries and one over the shard are walked together. A pair of
nodes with centres q and p and covering radii r and R is cut if <q, p> + |q| R + |p| r + r R is below
the worst kth score of the queries under q, which tightens as leaves are compared. The k best of each
group meet in one window per query.

Cover trees: the children of a node are picked farthest-first until they cover it within its radius
divided by ``BASE`` (or are ``CHILDREN``), so they stand further apart than they cover; every row goes
to its nearest child, and down to nodes of ``LEAF`` rows or fewer.

Defined results: vectors that are null, empty or hold null or non-finite components take no part,
as queries or as candidates; vectors of different lengths are compared over the shorter length;
ties go to the smaller vec_id; a query never finds a row with its own vec_id; different vectors of one
vec_id are queries of their own, equal ones are one; rows with a null vec_id take no part; repeated rows
of a candidate count as often as they occur; fewer candidates than k give them all; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkverity.llm.common import stored

K = 10
SCALE = 1024
SAMPLE = 4096
MAX_PIVOTS = 256
#: Shards are a 512th of the rows, within these limits.
SHARDS, LEAST_SHARD_ROWS, SHARD_ROWS = 512, 2_048, 65_536
BLOCK_QUERIES = 8_192
#: Queries whose bounds are worked out at once.
ASK_ROWS = 512
#: Bounds are lowered by this share, for what doubles round.
ROUNDING = 1e-12
LEAF = 64
ASKED = ["shard", "block", "query_id", "variant", "v", "bound"]
CHILDREN = 32
BASE = 1.5


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    at: np.ndarray  # rows below the node
    children: list = field(default_factory=list)
    separation: float = 0.0  # least distance of the children's centres
    norm: float = 0.0


def farthest_first(x: np.ndarray, first: int, most: int, radius: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray, float]:
    """Rows picked, each the farthest from those before, until all lie within the radius; to which of them
    every row is nearest, how far from it, and how far the last one picked was."""
    picked, apart = [first], np.inf
    distance, nearest = ((x - x[first]) ** 2).sum(1), np.zeros(len(x), np.int64)
    while len(picked) < most and distance.max(initial=0.0) > radius**2:
        apart = float(np.sqrt(distance.max()))
        picked.append(int(np.argmax(distance)))
        own = ((x - x[picked[-1]]) ** 2).sum(1)
        nearer = own < distance
        distance[nearer], nearest[nearer] = own[nearer], len(picked) - 1
    return picked, nearest, np.sqrt(distance), apart


def cover_tree(x: np.ndarray, at: np.ndarray | None = None, centre: int | None = None, leaf: int = LEAF) -> Node:
    at = np.arange(len(x)) if at is None else at
    own = x[at]
    centre = int(np.argmin(((own - own.mean(0)) ** 2).sum(1))) if centre is None else centre
    radius = float(np.sqrt(((own - own[centre]) ** 2).sum(1).max(initial=0.0)))
    node = Node(own[centre], radius * (1 + 1e-12), at, norm=float(np.linalg.norm(own[centre])))
    if len(at) <= leaf or radius == 0.0:
        return node
    picked, nearest, _, node.separation = farthest_first(own, centre, CHILDREN, radius / BASE)
    for k, row in enumerate(picked):
        below = np.nonzero(nearest == k)[0]
        node.children.append(cover_tree(x, at[below], int(np.searchsorted(below, row)), leaf))
    return node


def dual_search(queries: np.ndarray, ids: np.ndarray, bound: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = K, whole=None, seen: dict | None = None):
    """(query row, data row, score) of every query's k best in this data, among scores not under its
    bound. whole: both as Python integers, for scores that doubles don't hold exactly. seen: gets the
    number of pairs compared."""
    q, d = whole or (queries, data)
    best: list[list[tuple[float, int, int]]] = [[] for _ in range(len(q))]
    worst = bound.astype(float).copy()
    compared = 0

    def compare(qa: np.ndarray, da: np.ndarray) -> None:
        nonlocal compared
        compared += len(qa) * len(da)
        scores = q[qa] @ d[da].T
        useful = (scores >= worst[qa][:, None]) & (ids[qa][:, None] != data_ids[da][None, :])
        for i in np.nonzero(useful.any(1))[0]:
            row, own = qa[i], np.nonzero(useful[i])[0]
            merged = best[row] + [(-scores[i, j], data_ids[da[j]], da[j]) for j in own]
            merged.sort(key=lambda t: (t[0], t[1]))
            best[row] = merged[:k]
            if len(best[row]) == k:
                worst[row] = max(worst[row], np.nextafter(float(-best[row][-1][0]), -np.inf))  # not above a score that doubles round up

    def reach(a: Node, b: Node) -> float:
        upper = a.centre @ b.centre + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return float(upper) * (1 + 1e-9 * np.sign(upper)) + 1e-3

    def walk(a: Node, b: Node, upper: float) -> None:
        if upper < worst[a.at].min():
            return
        if not a.children and not b.children:
            compare(a.at, b.at)
        elif b.children and (not a.children or b.radius >= a.radius):
            for far, _, child in sorted(((reach(a, c), n, c) for n, c in enumerate(b.children)), key=lambda t: (-t[0], t[1])):
                walk(a, child, far)
        else:
            for child in a.children:
                walk(child, b, reach(child, b))

    if len(q) and len(d):
        a, b = cover_tree(queries), cover_tree(data)
        walk(a, b, reach(a, b))
    if seen is not None:
        seen["compared"] = seen.get("compared", 0) + compared
    return [(row, at, -score) for row, own in enumerate(best) for score, _, at in own]


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, v in enumerate(rows):
        out[k, : min(width, len(v))] = v[:width]
    return out


def _whole(rows: pd.Series, width: int) -> np.ndarray:
    return np.array([[int(x) for x in v[:width]] + [0] * (width - len(v)) for v in rows], object).reshape(len(rows), width)


def top_k(
    vectors: DataFrame, *, every: int = 100, k: int = K, shard_rows: int | None = None, block_queries: int = BLOCK_QUERIES,
    sample_rows: int = SAMPLE, n_pivots: int | None = None, seen: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for each row whose vec_id is divisible by ``every``.
    seen: gets the rows (query, shard) sent in the second round, and those the sample's bounds would have sent."""
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    fit = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    data = vectors.where(F.col("vec_id").isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    result = "query_id long, rank int, vec_id long, score long"
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    if not len(sample):
        return spark.createDataFrame([], result)
    sums = data.agg(F.count("*").alias("total"), F.max(F.size("v")).alias("width")).first()
    total, width = sums.total, sums.width
    shard_rows = shard_rows or min(SHARD_ROWS, max(LEAST_SHARD_ROWS, total // SHARDS))
    n_pivots = n_pivots or min(MAX_PIVOTS, max(8, total // shard_rows))
    known, known_ids = _matrix(sample["v"], width), sample["vec_id"].to_numpy()
    pivots = known[farthest_first(known, 0, min(n_pivots, len(known)))[0]]
    sent = spark.sparkContext.broadcast((known, known_ids, pivots))

    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)

    def near(batches):
        centres = sent.value[2]
        for pdf in batches:
            x = _matrix(pdf["v"], width)
            pivot = nearest(x, centres)
            radius = np.sqrt(((x - centres[pivot]) ** 2).sum(1)) * (1 + 1e-9) + 1e-6
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "pivot": pivot.astype(np.int32), "radius": radius})

    placed, _ = stored(data.mapInPandas(near, "vec_id long, v array<long>, pivot int, radius double"), "topk-placed")
    balls = {r.pivot: (r.n, r.far) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("radius").alias("far")).collect()}
    parts = np.array([-(-balls[p][0] // shard_rows) if p in balls else 0 for p in range(len(pivots))])
    far = np.array([balls[p][1] if p in balls else -np.inf for p in range(len(pivots))])
    first = np.concatenate([[0], np.cumsum(parts)])
    part = F.element_at(F.array(*(F.lit(max(1, int(x))) for x in parts)), F.col("pivot") + 1)
    start = F.element_at(F.array(*(F.lit(int(x)) for x in first[:-1])), F.col("pivot") + 1)
    shards = placed.select((start + F.pmod(F.xxhash64("vec_id"), part)).cast("int").alias("shard"), "vec_id", "v")
    queries = data.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    n_queries = queries.count()
    corners = min(len(pivots), max(1, n_queries // block_queries))
    block_parts = max(1, -(-n_queries // (block_queries * corners)))

    def ready(batches):
        """Queries with their bound from the sample, their block and the shard they see first. Scores of some
        queries against the whole sample are one matrix of 16 MB."""
        known, known_ids, centres = sent.value
        for pdf in some(batches):
            x, own = _matrix(pdf["v"], width), pdf["query_id"].to_numpy()
            scores = np.where(own[:, None] == known_ids[None, :], -np.inf, x @ known.T)
            bound = np.partition(scores, -k, axis=1)[:, -k] if len(known) > k else np.full(len(x), -np.inf)
            bound = bound - ROUNDING * np.abs(bound)
            block = nearest(x, centres[:corners]) * block_parts + own % (every * block_parts) // every
            home = np.where(parts > 0, x @ centres.T, -np.inf).argmax(1)
            yield pdf.assign(bound=bound, block=block.astype(np.int32), home=(first[home] + block % parts[home]).astype(np.int32))

    def some(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), ASK_ROWS):
                yield pdf.iloc[lo : lo + ASK_ROWS]

    def wanted(pdf: pd.DataFrame, bound: np.ndarray) -> np.ndarray:
        """For each query and pivot whether its ball can hold a score not under the bound."""
        x = _matrix(pdf["v"], width)
        upper = x @ sent.value[2].T + np.linalg.norm(x, axis=1)[:, None] * np.maximum(far, 0.0)[None, :]
        slack = np.where(np.isfinite(bound), 1e-9 * np.abs(bound) + 1e-3, 0.0)
        return (upper + slack[:, None] >= bound[:, None]) & np.isfinite(far)[None, :]

    def shards_of(row: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for each (row, pivot)."""
        n = parts[pivot]
        row, begin = np.repeat(row, n), np.repeat(first[:-1][pivot], n)
        return row, begin + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

    def pairs(batches):
        for pdf in some(batches):
            block, sees = pdf["block"].to_numpy(), wanted(pdf, pdf["bound"].to_numpy())
            row, shard = shards_of(*np.nonzero(sees))
            far_off = shard != pdf["home"].to_numpy()[row]
            yield pd.DataFrame({"shard": shard[far_off], "block": block[row[far_off]]}).drop_duplicates().astype("int32")

    def send(batches):
        for pdf in some(batches):
            row, shard = shards_of(*np.nonzero(wanted(pdf, pdf["bound"].to_numpy())))
            far_off = shard != pdf["home"].to_numpy()[row]
            row, shard = row[far_off], shard[far_off]
            for lo in range(0, len(row), 10_000):
                yield pdf.iloc[row[lo : lo + 10_000]][ASKED[1:]].assign(shard=shard[lo : lo + 10_000].astype(np.int32))[ASKED]

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        d, d_ids = _matrix(right["v"], width), right["vec_id"].to_numpy()
        q, q_ids = _matrix(left["v"], width), left["query_id"].to_numpy()
        large = np.abs(q).max(initial=0.0) * np.abs(d).max(initial=0.0) * width >= 2**52
        whole = (_whole(left["v"], width), _whole(right["v"], width)) if large else None
        found = dual_search(q, q_ids, left["bound"].to_numpy(), d, d_ids, k, whole)
        out = [(q_ids[i], left["variant"].iloc[i], d_ids[j], int(score)) for i, j, score in found]
        return pd.DataFrame(out, columns=["query_id", "variant", "vec_id", "score"]).astype("int64")

    def searched(asked: DataFrame, met: DataFrame) -> DataFrame:
        """What the asked shards hold. met: the (shard, block) that meet, repeated or not."""
        reach = met.distinct().groupBy("shard").agg(F.collect_list("block").alias("blocks"))  # at most all blocks
        dealt = shards.join(reach.hint("merge"), "shard").select("shard", F.explode("blocks").alias("block"), "vec_id", "v")
        kind = "query_id long, variant long, vec_id long, score long"
        return asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(search, kind)

    asks = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("variant"), "v")
    asks, _ = stored(asks.mapInPandas(ready, "query_id long, variant long, v array<long>, bound double, block int, home int"), "topk-queries")
    at_home = asks.withColumnRenamed("home", "shard")
    near_by, _ = stored(searched(at_home.select(*ASKED), at_home.select("shard", "block")), "topk-first")
    kth = near_by.groupBy("query_id", "variant").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") >= k)
    kth = kth.withColumn("kth", F.col("kth") - F.abs("kth") * ROUNDING)
    better = asks.join(kth.hint("merge"), ["query_id", "variant"], "left").withColumn("bound", F.greatest("bound", "kth")).select(*asks.columns)
    sends = "shard int, block int, query_id long, variant long, v array<long>, bound double"
    asked = better.mapInPandas(send, sends)
    if seen is not None:
        seen |= {"sent": asked.count(), "by_sample": asks.mapInPandas(send, sends).count()}
    found = near_by.unionByName(searched(asked, better.mapInPandas(pairs, "shard int, block int")))
    rank = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
