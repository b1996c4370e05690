"""Models: fraud trees, a text baseline with one classifier per label, and a linear head on embeddings."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkverity.functions.hashing import let
from sparkverity.operators import heads
from sparkverity.session import new_dir

#: Features of the fraud model, in order (by name, never by place), and what they stand for.
FRAUD_FEATURES = ["icd_match_score", "cnn_forgery_score", "ela_score", "phash_score", "final_image_forgery_score", "claim_amount_log", "previous_claim_count"]
DRIVERS = {"icd": "Low ICD match score", "image": "High image forgery confidence", "claim": "Large claim amount", "previous": "High previous claim count"}


ImageScorer = Callable[[pd.DataFrame], pd.DataFrame]


def image_scores(pictures: DataFrame, load: Callable[[], ImageScorer], scores: tuple[str, ...] = ("cnn_score",)) -> DataFrame:
    """path and scores of pictures (path, content) by a model of the caller's: load() is called once a task and
    returns a function that turns a batch of pictures into a frame of scores, a row per picture (null: no score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            found = score(batch[["path", "content"]]).reset_index(drop=True)
            yield pd.concat([batch["path"].reset_index(drop=True), found[list(scores)].astype(float)], axis=1)

    return pictures.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{s} double" for s in scores))


def fit_fraud(rows: DataFrame, label: str = "fraud", *, rounds: int = 20, bins: int = 128, seed: int = 42) -> PipelineModel:
    stages = [VectorAssembler(inputCols=FRAUD_FEATURES, outputCol="vec"), GBTClassifier(featuresCol="vec", labelCol=label, maxIter=rounds, maxDepth=4, maxBins=bins, seed=seed)]
    used = rows.select(*(F.col(f).cast("double").alias(f) for f in FRAUD_FEATURES), label)
    used.write.parquet(path := new_dir(rows.sparkSession, "training"))  # fitting reads its rows several times: they are worked out once
    return Pipeline(stages=stages).fit(rows.sparkSession.read.schema(used.schema).parquet(path))


def fraud_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("vec", "rawPrediction", "prediction")


TREES = "tree int, weight double, node int, feature string, threshold double, left int, right int, value double, gain double, n bigint"


def tree_rows(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """A fitted fraud model as rows, one per node: inner nodes have a feature by name, a threshold (up to it goes left)
    and two children; leaves have a value. Read from the model's own saved form."""
    path = new_dir(spark, "trees")
    model.stages[-1].write().save(path)
    name = F.element_at(F.array(*(F.lit(f) for f in FRAUD_FEATURES)), F.col("nodeData.split.featureIndex") + 1)
    inner = F.col("nodeData.leftChild") >= 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.when(inner, name).alias("feature"), F.when(inner, F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("nodeData.leftChild")).alias("left"), F.when(inner, F.col("nodeData.rightChild")).alias("right"), F.col("nodeData.prediction").alias("value"), F.col("nodeData.gain").alias("gain"), F.col("nodeData.rawCount").alias("n"),
    )
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in model.stages[-1].treeWeights)), F.col("tree") + 1)
    return nodes.withColumn("weight", weight).select(*(f.split()[0] for f in TREES.split(", ")))


def tree_scores(trees: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the probability of a model given as rows, by a fold down each tree. The nodes (rounds times 2^depth
    at most, part of the plan) are a constant; a missing feature goes right."""
    listed = sorted(trees.collect(), key=lambda r: (r.tree, r.node))
    features, by_tree = sorted({r.feature for r in listed if r.feature}), {}
    for r in listed:
        by_tree.setdefault(r.tree, {"weight": r.weight, "nodes": []})["nodes"].append(
            {"f": features.index(r.feature) if r.feature else -1, "t": r.threshold, "l": r.left, "r": r.right, "v": r.value}
        )  # nodes are numbered from 0 without gaps
    forest = F.from_json(F.lit(json.dumps(list(by_tree.values()))), "array<struct<weight:double,nodes:array<struct<f:int,t:double,l:int,r:int,v:double>>>>")
    values = F.array(*(F.col(f).cast("double") for f in features)) if features else F.array().cast("array<double>")
    depth = F.sequence(F.lit(1), F.lit(max((len(t["nodes"]) for t in by_tree.values()), default=1).bit_length() + 3))

    def step(nodes: Column, at: Column, own: Column) -> Column:
        node = F.get(nodes, at)
        return F.when(node["f"] < 0, at).when(F.get(own, node["f"]) <= node["t"], node["l"]).otherwise(node["r"])

    def margin(both: Column) -> Column:
        leaf = lambda t: F.aggregate(depth, F.lit(0), lambda at, _: step(t["nodes"], at, both["values"]))
        return F.aggregate(both["forest"], F.lit(0.0), lambda total, t: total + t["weight"] * F.get(t["nodes"], leaf(t))["v"])

    return rows.withColumn("probability", 1 / (1 + F.exp(-2 * let(F.struct(values.alias("values"), forest.alias("forest")), margin))))


def importances(trees: DataFrame) -> DataFrame:
    """feature and importance: its share of the gain, each tree counting alike."""
    gained = trees.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    per_tree = gained.groupBy("tree").agg(F.sum("g").alias("all"))
    shares = gained.join(per_tree.hint("merge"), "tree").where("`all` > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("share"))
    whole = shares.agg(F.sum("share").alias("whole"))
    return shares.join(F.broadcast(whole)).select("feature", (F.col("share") / F.col("whole")).alias("importance"))


def meaning(feature: Column) -> Column:
    """What a feature stands for."""
    image = F.lit(False)
    for part in ("final_image", "cnn", "ela", "phash"):
        image = image | F.contains(feature, F.lit(part))
    return F.when(F.contains(feature, F.lit("icd")), DRIVERS["icd"]).when(image, DRIVERS["image"]).when(F.contains(feature, F.lit("claim_amount")), DRIVERS["claim"]).otherwise(DRIVERS["previous"])


def drivers(trees: DataFrame, k: int = 3) -> DataFrame:
    """The k most important features of a model, with what they stand for: feature, importance, driver."""
    return importances(trees).orderBy(F.desc("importance"), "feature").limit(k).withColumn("driver", meaning(F.col("feature")))


def _sparse(ready: DataFrame, *keep: str) -> DataFrame:
    """A vector column as at and x, the places and values of what isn't zero; read as stored, never laid out in full."""
    v = F.unwrap_udt("vec")
    at = F.when(v["type"] == 0, v["indices"]).when(F.size(v["values"]) > 0, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    both = F.filter(F.arrays_zip(at.alias("at"), v["values"].alias("x")), lambda p: p["x"] != 0)
    return ready.select(*keep, both.alias("_v")).select(*keep, "_v.at", "_v.x")


@dataclass(frozen=True)
class Weighting:
    """Uni- and bigrams of texts, and what each of their occurrences weighs."""

    grams: list[str]
    idf: list[float]


#: Bytes of text that are split at once.
BYTES = 1 << 23


def _lowered(rows: DataFrame, *keep: Column) -> DataFrame:
    """text in lower case, a null one empty, and what is kept."""
    return rows.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"), *keep)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, some at a time."""
    ends, lo = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _grams(piece: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The row and the text of every word (a run of ASCII letters, digits and underscores) and every two neighbours."""
    own = pc.split_pattern_regex(piece.column("text"), r"\W+")
    row, word = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy()), own.flatten()
    full = pc.not_equal(word, "")
    row, word = row[full.to_numpy(zero_copy_only=False)], word.filter(full)
    if len(word) < 2:
        return row, word
    near = row[:-1] == row[1:]
    both = pc.binary_join_element_wise(word[:-1], word[1:], " ").filter(pa.array(near))
    return np.concatenate([row, row[:-1][near]]), pa.concat_arrays([word, both])


def _counted(piece: pa.RecordBatch, grams: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, place and number of each gram of the list, by row and place."""
    row, own = _grams(piece)
    place = pc.index_in(own, value_set=grams)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    key, n = np.unique(row[known] * len(grams) + place.filter(place.is_valid()).to_numpy(), return_counts=True)
    return key // max(1, len(grams)), key % max(1, len(grams)), n


def _weighed(row: np.ndarray, place: np.ndarray, n: np.ndarray, idf: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, place and value of what isn't zero, rows of length one."""
    x = n * idf[place]
    row, place, x = row[x != 0], place[x != 0], x[x != 0]
    return row, place, x / np.sqrt(np.bincount(row, x * x, n_rows))[row]


def _lists(row: np.ndarray, n_rows: int, *values: np.ndarray) -> list[pa.Array]:
    """Values in order of rows as a list a row."""
    ends = pa.array(np.searchsorted(row, np.arange(n_rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def common_grams(rows: DataFrame, most: int) -> list[str]:
    """The most frequent uni- and bigrams of texts in lower case, of equally frequent ones those first in the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                found = _grams(piece)[1].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["gram", "n"])

    counts = rows.select("text").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return [r.gram for r in counts.orderBy(F.desc("n"), "gram").limit(most).collect()]


def _equal_counts(rows: DataFrame, grams: list[str]) -> DataFrame:
    """at, n, y and times: rows (text, y) whose grams of the list are equally many, and their labels the same, are one."""
    sent = rows.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                row, place, n = _counted(piece, known)
                yield pa.RecordBatch.from_arrays([*_lists(row, len(piece), place.astype(np.int32), n.astype(np.int32)), piece.column("y")], names=["at", "n", "y"])

    return rows.select("text", "y").mapInArrow(run, "at array<int>, n array<int>, y array<int>").groupBy("at", "n", "y").agg(F.count("*").alias("times"))


def fit_text_labels(rows: DataFrame, labels: list[str], *, features: int = 5000, penalty: float = heads.PENALTY, steps: int = 100, tolerance: float = 2e-4) -> tuple[Weighting, DataFrame]:
    """Uni- and bigrams weighted by inverse document frequency, texts of length one, a logistic head per label, all fitted in the same passes. rows: text, labels.

    One pass counts the grams, a second brings rows of equal counts together; what follows goes over those."""
    spark, own = rows.sparkSession, _lowered(rows, heads.label_places(labels).alias("y"))
    grams = common_grams(own, features)
    counted = _equal_counts(own, grams).persist(StorageLevel.MEMORY_AND_DISK)
    texts = counted.agg(F.sum("times")).first()[0] or 0
    holding = {r.at: r.n for r in counted.select(F.explode("at").alias("at"), "times").groupBy("at").agg(F.sum("times").alias("n")).collect()}
    idf = [math.log((texts + 1) / (holding.get(k, 0) + 1)) for k in range(len(grams))]
    sent = spark.sparkContext.broadcast(np.array(idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n_rows = batch.column("at"), batch.num_rows
            row, place, x = _weighed(np.repeat(np.arange(n_rows), at.value_lengths().to_numpy()), at.flatten().to_numpy(), batch.column("n").flatten().to_numpy(), sent.value, n_rows)
            yield pa.RecordBatch.from_arrays([*_lists(row, n_rows, place, x), batch.column("y"), batch.column("times")], names=["at", "x", "y", "times"])

    ready = counted.mapInArrow(run, "at array<int>, x array<double>, y array<int>, times bigint").where("size(x) > 0")
    weights = heads.fit_ready(ready, len(labels), len(grams), penalty=penalty, steps=steps, tolerance=tolerance)
    counted.unpersist()
    return Weighting(grams, idf), heads.as_rows(spark, weights, labels)


def text_label_scores(prepare: Weighting, head: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, code and prob: a row per text and label."""
    fitted = head.collect()
    names = [h.label for h in fitted]
    weights = np.array([[*h.weights, h.bias] for h in fitted]).T if fitted else np.zeros((len(prepare.grams) + 1, 0))
    sent = rows.sparkSession.sparkContext.broadcast((prepare, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weighting, w), known = sent.value, pa.array(sent.value[0].grams, pa.string())
        idf = np.array(weighting.idf)
        for batch in batches:
            for piece in _pieces(batch):
                p = 1 / (1 + np.exp(-heads.logits(*_weighed(*_counted(piece, known), idf, len(piece)), w, len(piece))))
                ends = pa.array(np.arange(len(piece) + 1) * len(names), pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(key), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=[key, "p"])

    kind = rows.schema[key].dataType.simpleString()
    scored = _lowered(rows, F.col(key)).mapInArrow(run, f"{key} {kind}, p array<double>")
    return scored.select(key, F.posexplode("p").alias("_k", "prob")).select(key, F.get(F.array(*map(F.lit, names)).cast("array<string>"), F.col("_k")).alias("code"), "prob")


def fit_head(rows: DataFrame, labels: list[str], *, steps: int = 500, penalty: float = heads.PENALTY) -> DataFrame:
    """A logistic head per label on an embedding column: label, weights, bias. rows: embedding, labels."""
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    ready = rows.select(F.lit(None).cast("array<int>").alias("at"), F.col("embedding").alias("x"), "labels")
    return heads.as_rows(rows.sparkSession, heads.fit(ready, labels, max(0, width), penalty=penalty, steps=steps), labels)


#: Heads that are broadcast; blocks of more.
HEADS, HEAD_PARTS = 10_000, 64


def head_scores(vectors: DataFrame, head: DataFrame) -> DataFrame:
    """Probability of each label of the head for each vector. Up to HEADS labels are sent to all tasks (counted)."""
    dot = F.aggregate(F.zip_with("embedding", "weights", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    pairs = vectors.crossJoin(F.broadcast(head)) if head.count() <= HEADS else vectors.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(HEAD_PARTS - 1)))).join(
        head.withColumn("_k", F.pmod(F.xxhash64("label"), F.lit(HEAD_PARTS)).cast("int")).hint("shuffle_hash"), "_k"
    ).drop("_k")
    return pairs.select(*(c for c in vectors.columns if c != "embedding"), "label", (1 / (1 + F.exp(-(dot + F.col("bias"))))).alias("prob"))
