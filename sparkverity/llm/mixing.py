"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt, in hashed order, into blocks. With weight w, block j of a source
(from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w); the released block with
the earliest deadline takes each slot. Each block then lies in its window, so after any number of
slots a source is less than one block from its weight. When a source runs out, the others share its
slots by their weights from that moment on (the windows follow the fluid schedule, in which every
source is served at its weight among those left), so no document is dropped and the bound of one
block holds to the end.

Windows come from the exact weights, in whole numbers, so nothing is rounded and no error grows with
the data. Earliest deadline first is one pass over the blocks, over any number of sources: the driver
makes it. A block has ``block_docs`` rows, or so many that there are ``most_blocks`` blocks (and one
a source), so the pass and what it sends out have a bound at any size of the data. The documents are numbered within their source by counting per (source, bucket), where a
source has a bucket per ``bucket_rows`` rows; no source is sorted in one task however large it is.
All of it but the pass is SQL functions, one window over buckets and joins.

Defined results: a null source is a source of its own; without given weights each source weighs as
the ``temperature`` power of its rows; a source without a given weight is an error, a zero weight
too; rows with a null or repeated doc_id are rows like others, dealt and ordered by a hash of all their
columns; rows alike in all columns share a bucket; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 32
MOST_BLOCKS = 1_000_000
BUCKET_ROWS = 4096
TEMPERATURE = 0.5
#: Slots travel to the rows in arrays of so many blocks of a source.
PIECE = 128
#: Slots of up to so many blocks (8 bytes each), and rows of up to so many sources, are sent to all tasks; more are joined by shuffle.
BROADCAST_BLOCKS = 4_000_000
BROADCAST_SOURCES = 100_000


def shares(weights: list[float], period: int) -> list[int]:
    """Whole shares of the period, at least one each, by largest remainder."""
    free, total = period - len(weights), sum(weights)
    exact = [w / total * free for w in weights]
    out = [int(x) for x in exact]
    for k in sorted(range(len(out)), key=lambda k: (out[k] - exact[k], k))[: free - sum(out)]:
        out[k] += 1
    return [x + 1 for x in out]


def schedule(blocks: list[int], weights: list[float]) -> list[np.ndarray]:
    """Per source the slot of each of its blocks, by earliest deadline first among released blocks."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(x.denominator for x in exact))
    weight = [int(x * scale) for x in exact]
    out = [array("q") for _ in blocks]
    # Sources by the moment (blocks / weight) at which they run out: blocks of those gone, weight of those left.
    order = sorted((k for k in range(len(blocks)) if blocks[k]), key=lambda k: Fraction(blocks[k], weight[k]))
    gone, left = [0], [sum(weight[k] for k in order)]
    for k in order:
        gone.append(gone[-1] + blocks[k])
        left.append(left[-1] - weight[k])
    stage = [0] * len(blocks)

    def served(k: int, j: int) -> tuple[int, int]:
        """Floor and ceiling of the slot at which source k has had j blocks in the fluid schedule."""
        at, own = stage[k], weight[k]
        if j * weight[order[at]] > blocks[order[at]] * own:
            low, high = at + 1, len(order) - 1
            while low < high:
                half = (low + high) // 2
                if j * weight[order[half]] > blocks[order[half]] * own:
                    low = half + 1
                else:
                    high = half
            at = stage[k] = low
        whole, rest = divmod(j * left[at], own)
        return gone[at] + whole, gone[at] + whole + (rest > 0)

    def window(k: int, j: int, release: int) -> tuple[int, int, int, int, int]:
        after, deadline = served(k, j + 1)
        return release, deadline, k, j, after

    waiting = [window(k, 0, 0) for k in order]  # release, deadline, source, block, release of the next
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, block, release of the next
    heapq.heapify(waiting)
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, k, j, after = heapq.heappop(ready)
        out[k].append(t)
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, window(k, j + 1, after))
    return [np.array(x, np.int64) for x in out]


def one_period(share: list[int]) -> list[list[int]]:
    """Per source the slots it gets in a period of whole shares."""
    return [x.tolist() for x in schedule(share, share)]


def block_size(rows: int, least: int = BLOCK_DOCS, most_blocks: int = MOST_BLOCKS) -> int:
    """Rows of a block."""
    return max(least, -(-rows // most_blocks))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def targets(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> dict[str, tuple[int, float]]:
    """Rows and weight of every source, by its key."""
    rows = {r.k: r.n for r in docs.groupBy(source_key(F.col("source")).alias("k")).agg(F.count("*").alias("n")).collect()}
    if weights is None:
        return {k: (rows[k], float(rows[k]) ** temperature) for k in sorted(rows)}
    given = {"null" if k is None else f"={k}": float(w) for k, w in weights.items()}
    if missing := [k for k in sorted(rows) if given.get(k, 0.0) <= 0.0]:
        raise ValueError(f"no weight above zero for {missing[:5]}")
    return {k: (rows[k], given[k]) for k in sorted(rows)}


def _sent(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n <= most else df.hint("merge")


def _placed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, *, block_docs: int = BLOCK_DOCS,
    bucket_rows: int = BUCKET_ROWS, temperature: float = TEMPERATURE, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """_row (the document), _slot, _block and _position."""
    spark = docs.sparkSession
    target = targets(docs, weights, temperature)
    block_docs = block_size(sum(n for n, _ in target.values()), block_docs, most_blocks)
    blocks = [-(-n // block_docs) for n, _ in target.values()]
    plan = schedule(blocks, [w for _, w in target.values()])
    buckets = pa.table({
        "_k": pa.array(list(target), pa.string()), "_buckets": pa.array([-(-n // bucket_rows) for n, _ in target.values()], pa.int64()),
    })
    pieces = [(k, at // PIECE, own[at : at + PIECE]) for k, own in zip(target, plan, strict=True) for at in range(0, len(own), PIECE)]
    slots = pa.table({
        "_k": pa.array([p[0] for p in pieces], pa.string()), "_piece": pa.array([p[1] for p in pieces], pa.int64()),
        "_slots": pa.array([p[2] for p in pieces], pa.list_(pa.int64())),
    })
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*own).alias("_row")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.select(row, source_key(F.col("source")).alias("_k"), F.col("doc_id").alias("_id"), F.xxhash64(*hashed).alias("_hash"))
    small = _sent(spark.createDataFrame(buckets), len(target), BROADCAST_SOURCES)
    keyed = keyed.join(small, "_k").withColumn("_bucket", F.pmod("_hash", F.col("_buckets")).cast("int")).drop("_buckets")
    sizes = keyed.groupBy("_k", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_k", "_bucket", (F.sum("_n").over(Window.partitionBy("_k").orderBy("_bucket")) - F.col("_n")).alias("_before")
    )
    order = Window.partitionBy("_k", "_bucket").orderBy(F.xxhash64(F.col("_id"), F.lit("order")), "_id", "_hash")
    ranked = keyed.withColumn("_rn", F.row_number().over(order) - 1).join(before.hint("merge"), ["_k", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_rn")).withColumn("_block", F.floor(F.col("_rank") / block_docs))
    ranked = ranked.withColumn("_piece", F.expr(f"_block div {PIECE}"))
    placed = ranked.join(_sent(spark.createDataFrame(slots), sum(blocks), BROADCAST_BLOCKS), ["_k", "_piece"])
    slot = F.expr(f"_slots[cast(_block % {PIECE} AS int)]")
    return placed.select("_row", slot.alias("_slot"), "_block", (F.col("_rank") % block_docs).cast("int").alias("_position"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, **parameters) -> DataFrame:
    """docs with mix_slot (the block's slot), mix_block (number in its source) and mix_position (within
    the block); columns of these names that docs already has are replaced."""
    ours = ("mix_slot", "mix_block", "mix_position")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ours))
    return _placed(kept, weights, **parameters).select("_row.*", *(F.col(a).alias(b) for a, b in zip(("_slot", "_block", "_position"), ours, strict=True)))


def ordered(docs: DataFrame, weights: dict[str | None, float] | None = None, **parameters) -> DataFrame:
    """The documents, whole, range-partitioned and sorted by slot: the interleaving as it is read."""
    return _placed(docs, weights, **parameters).orderBy("_slot", "_position").select("_row.*")
