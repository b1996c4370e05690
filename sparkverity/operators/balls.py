"""The nearest vector by cosine, found through balls around pivots.

The dictionary is dealt to the balls of its nearest pivots (picked farthest-first from a bounded sample);
a ball knows the largest angle to its pivot and its largest norm. No vector of a ball is closer to a query
than the angle to the pivot less that radius (the triangle inequality), and as similarity is
<a, b> / (|a| |b| + 1e-8), short vectors lower the bound further. A query first asks the ball of the
highest bound, and then only those balls that may hold something better than what it found there, and
above the least similarity wanted. Crowded balls are split into parts by hash, and queries go to all parts.

Angles to pivots are worked out against a constant of at most ``MAX_BALLS`` vectors; what asks and what
answers meet in groups by ball, part and block of queries. A group finds each query's best by a matrix
product, a few queries at a time, and works out anew, in order of components, what lies within ``ROUNDING``
of it, so that equal vectors tie.

Vectors that are null, empty or hold null or non-finite components take no part; a vector of length
zero is similar to nothing (0).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkverity.functions.image import norm
from sparkverity.session import new_dir

CODES_A_BALL = 64
MAX_BALLS = 128
SAMPLE = 2_048
PART_ROWS = 16_384
#: Queries of a group, and those multiplied at once.
QUERY_ROWS, AT_ONCE = 65_536, 512
ROUNDING = 1e-9
#: Beyond rounding errors of angles.
SLACK = 1e-6
_PIVOTS = "array<struct<p:int,v:array<double>>>"
_BALLS = "array<struct<p:int,parts:int,radius:double,longest:double>>"


def _fit(emb: Column) -> Column:
    return F.coalesce((F.size(emb) > 0) & F.forall(emb, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _constant(rows: list[dict], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _pick(vectors: list[list[float]], most: int) -> list[list[float]]:
    """Farthest-first unit vectors of a bounded sample."""
    lengths = [math.sqrt(math.fsum(x * x for x in v)) for v in vectors]
    unit = [[x / n for x in v] for v, n in zip(vectors, lengths, strict=True) if n > 0]
    if not unit:
        return []
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    picked, nearest = [unit[0]], [cosine(unit[0], v) for v in unit]
    while len(picked) < most and min(nearest) < 1 - 1e-9:
        new = unit[min(range(len(unit)), key=nearest.__getitem__)]
        picked.append(new)
        nearest = [max(c, cosine(new, v)) for c, v in zip(nearest, unit, strict=True)]
    return picked


def _angles(emb: Column, length: Column, pivots: Column) -> Column:
    """The angle to each pivot; a right one for a vector of length zero."""
    cosine = lambda p: F.when(length > 0, dot(emb, p["v"]) / length).otherwise(0.0)
    return F.transform(pivots, lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(p)))))


def _matrix(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return pc.list_flatten(vectors).to_numpy().astype(float).reshape(-1, size)


def _at_home(known: DataFrame, picked: list[list[float]]) -> DataFrame:
    """known (_b, _nb) with the place of its nearest pivot and the angle to it, as ``_angles`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lengths = batch.column("_b").value_lengths().to_numpy(), batch.column("_nb").to_numpy()
            angles = np.zeros((len(sizes), len(picked)))  # pivots of another length count as near
            for size in np.unique(sizes):
                at, same = np.flatnonzero(sizes == size), [k for k, v in enumerate(picked) if len(v) == size]
                if same:
                    dots = _matrix(batch.column("_b").take(pa.array(at)), size) @ np.array([picked[k] for k in same]).T
                    cosines = np.where(lengths[at, None] > 0, dots / np.where(lengths[at, None] > 0, lengths[at, None], 1.0), 0.0)
                    angles[np.ix_(at, same)] = np.arccos(np.clip(cosines, -1.0, 1.0))
            home = angles.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(angles[np.arange(len(home)), home])], names=[*batch.schema.names, "_p", "_angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema)
    return known.mapInArrow(run, f"{kinds}, _p int, _angle double")


def _best_in_group(asked: pa.Table, known: pa.Table, least: float) -> pa.Table:
    """The best code of a group for each of its queries that finds one above least."""
    known = known.sort_by("best_match")
    rows, codes, sims = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    if len(asked) and len(known):
        size = len(asked["_a"][0])
        a, b, na, nb = _matrix(asked["_a"], size), _matrix(known["_b"], size), asked["_na"].to_numpy(), known["_nb"].to_numpy()
        for lo in range(0, len(a), AT_ONCE):
            near = a[lo : lo + AT_ONCE] @ b.T / (na[lo : lo + AT_ONCE, None] * nb + 1e-8)
            most = near.max(1)
            near[most <= least - ROUNDING] = -np.inf
            r, k = np.nonzero(near >= np.maximum(most, least - ROUNDING)[:, None] - ROUNDING)
            r += lo
            sim = np.zeros(len(r))
            for i in range(size):
                sim += a[r, i] * b[k, i]
            sim /= na[r] * nb[k] + 1e-8
            r, k, sim = r[sim > least], k[sim > least], sim[sim > least]
            order = np.lexsort((k, -sim, r))
            order = order[np.unique(r[order], return_index=True)[1]]
            rows.append(r[order]), codes.append(k[order]), sims.append(sim[order])
    return pa.table({"declared": asked["declared"].take(pa.array(np.concatenate(rows))), "best_match": known["best_match"].take(pa.array(np.concatenate(codes))), "sim": np.concatenate(sims)})


def most_similar(queries: DataFrame, dictionary: DataFrame, least: float, *, codes_a_ball: int = CODES_A_BALL, part_rows: int = PART_ROWS, seen: dict | None = None) -> DataFrame:
    """Per query (declared, emb) the code (code, emb) of largest similarity above ``least``, the first in code
    order on a tie: declared, best_match, sim. seen: gets the number of pairs compared (runs the search twice)."""
    spark = queries.sparkSession
    known = dictionary.where(_fit(F.col("emb"))).select(F.col("code").alias("best_match"), F.col("emb").alias("_b"), norm(F.col("emb")).alias("_nb"))
    asked = queries.where(_fit(F.col("emb"))).select("declared", F.col("emb").alias("_a"), norm(F.col("emb")).alias("_na"))
    n = known.count()
    sample = known.where("_nb > 0").orderBy(F.xxhash64("best_match"), "best_match").limit(SAMPLE).select(F.col("_b").cast("array<double>").alias("v")).collect()
    picked = _pick([r.v for r in sample], min(MAX_BALLS, max(1, n // codes_a_ball))) or [[0.0]]
    pivots = _constant([{"p": k, "v": v} for k, v in enumerate(picked)], _PIVOTS)
    known = _at_home(known, picked)
    path = new_dir(spark, "balls")
    known.write.parquet(path)
    known = spark.read.schema(known.schema).parquet(path)
    found = known.groupBy("_p").agg(F.count("*").alias("n"), F.max("_angle").alias("r"), F.max("_nb").alias("l")).collect()  # a row per ball
    balls = _constant([{"p": r._p, "parts": -(-r.n // part_rows), "radius": r.r, "longest": r.l} for r in found], _BALLS)
    parts = F.element_at(F.map_from_entries(F.transform(balls, lambda b: F.struct(b["p"], b["parts"]))), F.col("_p"))
    known = known.withColumn("_part", F.pmod(F.xxhash64("best_match"), parts).cast("int"))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    answers = known.withColumn("_size", F.size("_b")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    found_schema = f"declared {kind(asked, 'declared')}, best_match {kind(known, 'best_match')}, sim double"

    def bound(b: Column) -> Column:
        """What similarity a vector of the ball may have to the query."""
        angle = F.greatest(F.lit(0.0), F.get(F.col("_angles"), b["p"]) - b["radius"] - SLACK)
        both = F.col("_na") * b["longest"]
        return F.greatest(F.cos(F.least(angle, F.lit(math.pi))), F.lit(0.0)) * (both / (both + 1e-8)) + 1e-12

    bounds = F.transform(balls, lambda b: F.struct(bound(b).alias("bound"), b["p"].alias("p"), b["parts"].alias("parts")))
    asked = asked.withColumn("_angles", _angles(F.col("_a"), F.col("_na"), pivots))
    asked.write.parquet(path := new_dir(spark, "angles"))  # else the angles would be worked out anew for every ball
    asked = spark.read.schema(asked.schema).parquet(path).withColumn("_balls", F.filter(bounds, lambda b: b["bound"] > least))
    asked = asked.where(F.size("_balls") > 0).withColumn("_first", F.array_max("_balls")).select("declared", "_a", "_na", "_balls", "_first")

    def compared(rows: DataFrame, wanted: Column) -> DataFrame:
        """For the rows the best code of each part of the balls they want."""
        sent = rows.select("declared", "_a", "_na", F.explode(wanted).alias("_w")).select("declared", "_a", "_na", F.col("_w.p").alias("_p"), F.explode(F.sequence(F.lit(0), F.col("_w.parts") - 1)).alias("_part"))
        if seen is not None:
            seen["compared"] = seen.get("compared", 0) + sent.join(known.hint("shuffle_hash"), ["_p", "_part"]).count()
        asks = sent.withColumn("_size", F.size("_a")).withColumn("_block", F.pmod(F.xxhash64("declared"), F.lit(blocks)).cast("int"))
        by = ["_p", "_part", "_size", "_block"]
        return asks.groupBy(*by).cogroup(answers.groupBy(*by)).applyInArrow(lambda q, k: _best_in_group(q, k, least), found_schema)

    def best(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("declared").agg(F.min(F.struct((-F.col("sim")).alias("neg"), "best_match")).alias("_m"))
        return one.select("declared", F.col("_m.best_match").alias("best_match"), (-F.col("_m.neg")).alias("sim"))

    path = new_dir(spark, "first")
    first = best(compared(asked, F.array("_first")))
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    further = asked.join(first.select("declared", F.col("sim").alias("_got")).hint("merge"), "declared", "left")
    wanted = F.filter("_balls", lambda b: (b["p"] != F.col("_first.p")) & (b["bound"] >= F.coalesce("_got", F.lit(float(least)))))
    return best(first.unionByName(compared(further, wanted)))
