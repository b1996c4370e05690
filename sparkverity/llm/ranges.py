"""Near-duplicate vectors of one label by an exact metric range join.

The angle between vectors is a metric, and cosine >= c is an angle of at most r = arccos c. Equal vectors
of a label are folded first, so exact copies cost one row and count by their number.

Pivots are picked farthest-first from a bounded sample; a label with n different vectors uses the first
n / ``CELL_ROWS`` of them (one at least, ``MAX_PIVOTS`` at most). A vector's home is the cell of its
nearest pivot h. It is replicated to the cell of another pivot p if a vector within r may live there. By
the triangle inequality that needs angle(x, p) - angle(x, h) <= 2 r; a sharper bound of the same kind, the
distance to the great circle between p and h, (cos(x, h) - cos(x, p)) / |h - p| <= sin r, is asked too.
So a home vector meets all its neighbours in its own cell, and cells join independently: the count of its
links is complete there, and only counts and a spanning star of the linked vectors come back, never pairs.

Cells are counted (homes and those that ask) and larger ones are dealt into parts, home parts times asking
parts, of at most about ``HOME_ROWS`` and ``ASK_ROWS`` vectors. In a part vectors lie in the order of
their angle to the pivot, and a block of homes is compared only with those whose angle to the pivot
differs by at most r, the triangle inequality again. Pairs closer to c than ``NEAR`` are worked out again
with exactly rounded sums.

Stars become components by alternating large-star and small-star steps; the smallest vec_id of a
component names it. Joins back to the rows broadcast keys that hold one part in 256 of them.

The work is what the metric leaves: in random directions the boundaries of 256 pivots are near to a third
of the vectors, and a dense ball of n different vectors within r has n^2 / 2 links to count.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose label
is null, have no links and are their own component; vectors of different lengths never link; a null
vec_id counts as a link and never names a component others can name (a component of null ids alone is
named null, and all of it is kept); rows of one vec_id are vectors of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkverity.llm.common import bounded_batches, checkpointed, spread_join, stored
from sparkverity.llm.simhash import components

LEAST = 0.98
SAMPLE = 4_096
MAX_PIVOTS = 256
CELL_ROWS = 2_048
HOME_ROWS = 8_192
ASK_ROWS = 16_384
#: Tables of up to so many rows are broadcast, after they are counted.
SMALL = 100_000
NEAR = 1e-9
#: Beyond rounding errors of angles.
SLACK = 1e-6


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and key: a hash of 128 bits of label, length and components; null if the vector links with nothing."""
    bounded_batches(vectors.sparkSession)
    double = F.transform("embedding", lambda x: x.cast("double"))
    fit = (
        F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
        & F.exists("embedding", lambda x: x != 0)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values, ends = lists.flatten().to_numpy(zero_copy_only=False) + 0.0, np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            labels = batch.column("label").to_pylist()
            keys = [None if label is None else blake2b(f"{label}|".encode() + values[a:b].tobytes(), digest_size=16).digest() for label, a, b in zip(labels, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(keys, pa.binary())], names=["vec_id", "label", "v", "key"])

    rows = vectors.select("vec_id", F.when(F.coalesce(fit, F.lit(False)), F.col("label").cast("string")).alias("label"), F.when(F.coalesce(fit, F.lit(False)), double).alias("v"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, label string, v array<double>, key binary")


def units(rows, width: int) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows or vanishes."""
    x = np.array([v[:width] if len(v) >= width else [*v, *[0.0] * (width - len(v))] for v in rows], float).reshape(len(rows), width)
    x = x / np.maximum(np.abs(x).max(1, initial=0.0), np.finfo(float).tiny)[:, None]
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1.0)[:, None]


def pick(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first by angle: each pivot the sampled vector whose nearest pivot is furthest away."""
    picked = [0]
    nearest = sample @ sample[0]
    while len(picked) < min(most, len(sample)) and nearest.min() < 1 - 1e-9:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[picked[-1]])
    return sample[picked]


def distances(pivots: np.ndarray) -> np.ndarray:
    """Chords between pivots."""
    return np.array([np.sqrt(((pivots - p) ** 2).sum(1)) for p in pivots])


def visits(x: np.ndarray, pivots: np.ndarray, apart: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each unit vector, and for each pivot whether a vector within angle r may live in its cell."""
    cosine = x @ pivots.T
    home = cosine.argmax(1)
    own = cosine.max(1, keepdims=True)
    angle = np.arccos(np.clip(cosine, -1.0, 1.0))
    wanted = (angle - angle.min(1, keepdims=True) <= 2 * r + SLACK) & (own - cosine <= (math.sin(r) + SLACK) * apart[home])
    wanted[np.arange(len(x)), home] = True
    return home, wanted


def cosine(a, b) -> float:
    """In doubles, with exactly rounded sums."""
    dot = math.fsum(x * y for x, y in zip(a, b, strict=True))
    return dot / (math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(y * y for y in b)))


def linked(raw: list, x: np.ndarray, home: np.ndarray, asks: np.ndarray, weight: np.ndarray, pivot: np.ndarray, least: float = LEAST, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of a part (all of one cell): the weight of what each home vector is linked to among
    those that ask, without itself; and the smallest index each one is linked to, directly or through others.
    seen: gets the number of pairs compared."""
    r = math.acos(min(1.0, least)) + SLACK
    angle = np.arccos(np.clip(x @ pivot, -1.0, 1.0))
    order = np.argsort(angle, kind="stable")
    homes, others = order[home[order]], order[asks[order]]
    at = angle[others]
    count, root = np.zeros(len(x), np.int64), np.arange(len(x))

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

    for lo in range(0, len(homes), 256):
        own = homes[lo : lo + 256]
        first, last = np.searchsorted(at, angle[own[0]] - r), np.searchsorted(at, angle[own[-1]] + r, side="right")
        for begin in range(first, last, 8_192):
            near = others[begin : min(last, begin + 8_192)]
            c = x[own] @ x[near].T
            if seen is not None:
                seen["compared"] = seen.get("compared", 0) + c.size
            is_linked = c >= least
            for i, j in zip(*np.nonzero(np.abs(c - least) < NEAR), strict=True):
                is_linked[i, j] = cosine(raw[own[i]], raw[near[j]]) >= least
            i, j = np.nonzero(is_linked)
            a, b = own[i], near[j]
            differ = a != b
            a, b = a[differ], b[differ]
            np.add.at(count, a, weight[b])
            merge(a, b)
    return count, root


def _join(sent, least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", kind="stable").reset_index(drop=True)
        size = int(pdf["size"].iloc[0])
        x = units(pdf["v"], size)
        pivot = units(sent.value[int(pdf["pivot"].iloc[0])][None, :], size)[0]
        role, cid = pdf["role"].to_numpy(), pdf["cid"].to_numpy()
        count, root = linked(list(pdf["v"]), x, (role & 1) > 0, (role & 2) > 0, pdf["n"].to_numpy(), pivot, least)
        counted, moved = np.nonzero(count)[0], np.nonzero(root != np.arange(len(root)))[0]
        return pd.DataFrame({
            "a": np.concatenate([cid[counted], cid[moved]]), "b": np.concatenate([np.full(len(counted), -1), cid[root[moved]]]), "links": np.concatenate([count[counted], np.zeros(len(moved), np.int64)]),
        })

    return run


def _small(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(F.broadcast(right) if right.count() <= SMALL else right.hint("merge"), on)


def near_duplicates(
    vectors: DataFrame, *, least: float = LEAST, cell_rows: int = CELL_ROWS, home_rows: int = HOME_ROWS, ask_rows: int = ASK_ROWS, sample_rows: int = SAMPLE, max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark, r = vectors.sparkSession, math.acos(least)
    rows = keyed(vectors)
    marked = checkpointed(rows.select("vec_id", "key"))
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    classes, _ = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "*", F.size("v").alias("size")), "classes")
    sample = [row.v for row in classes.orderBy(F.xxhash64("key"), "cid").select("v").limit(sample_rows).collect()]
    if not sample:
        return _result(marked.where("key IS NULL"))
    width = classes.agg(F.max("size")).first()[0]
    sent = spark.sparkContext.broadcast(pick(units(sample, width), max_pivots))
    n_pivots = len(sent.value)
    per_label = classes.groupBy("label", "size").agg(F.greatest(F.lit(1), F.least(F.lit(n_pivots), F.ceil(F.count("*") / cell_rows))).cast("int").alias("m"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (size, m), own in pdf.groupby(["size", "m"]):
                pivots, vectors = units(sent.value[:m], int(size)), own["v"].to_numpy()
                apart = distances(pivots)
                for lo in range(0, len(own), 512):
                    part = own.iloc[lo : lo + 512]
                    home, wanted = visits(units(vectors[lo : lo + 512], int(size)), pivots, apart, r)
                    i, p = np.nonzero(wanted)
                    yield part[["cid", "label", "size", "n", "v"]].iloc[i].assign(pivot=p.astype(np.int32), is_home=home[i] == p)

    fields = "cid long, label string, size int, n long, v array<double>, pivot int, is_home boolean"
    placed = _small(classes.select("cid", "label", "size", "n", "v"), per_label, ["label", "size"]).mapInPandas(place, fields)
    placed, _ = stored(placed, "placed", level=1)
    cell = ["label", "size", "pivot"]
    parts = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    cells = placed.groupBy(*cell).agg(parts(F.count_if("is_home"), home_rows).alias("hp"), parts(F.count("*"), ask_rows).alias("ap"))
    cells, _ = stored(cells, "cells")
    dealt = _small(placed, cells, cell)
    i, j = F.pmod(F.xxhash64("cid"), F.col("hp")).cast("int"), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("ap")).cast("int")
    asking = F.transform(F.sequence(F.lit(0), F.col("hp") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.when(F.col("is_home") & (k == i), 3).otherwise(2).alias("role")))
    at_home = F.transform(F.filter(F.sequence(F.lit(0), F.col("ap") - 1), lambda k: F.col("is_home") & (k != j)), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(1).alias("role")))
    dealt = dealt.select("cid", *cell, "n", "v", F.inline(F.concat(asking, at_home)))
    found, _ = stored(dealt.groupBy(*cell, "i", "j").applyInPandas(_join(sent, least), "a long, b long, links long"), "links")
    links = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b >= 0").select("a", "b")).select(F.col("a").alias("cid"), "root")
    known = classes.select("cid", "key", "n", "least_id").join(links.hint("merge"), "cid", "left").join(roots.hint("merge"), "cid", "left")
    known = checkpointed(known.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"), "least_id"))
    total = known.count()
    named = spread_join(known, known.groupBy("root").agg(F.min("least_id").alias("component_id")), "root", total).select("key", "n_links", "component_id")
    out = spread_join(marked.where("key IS NOT NULL"), checkpointed(named), "key", marked.count())
    return _result(marked.where("key IS NULL")).unionByName(_result(out))


def _result(rows: DataFrame) -> DataFrame:
    if "component_id" not in rows.columns:
        rows = rows.withColumn("n_links", F.lit(0)).withColumn("component_id", F.col("vec_id"))
    return rows.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
