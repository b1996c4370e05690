"""Evaluation of scores and labels: curves, F1, summaries per technique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkverity.operators.ranking import running_sums


def _by_score(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    rows = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.sum(1 - F.col(label).cast("long")).alias("fp"))
    return running_sums(rows, "score", ["tp", "fp"], by)


def curve(df: DataFrame, score: str, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """A row per distinct score, from the highest: own and cumulative true and false positives."""
    return _by_score(df, score, label, by or [])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def auc(df: DataFrame, score: str, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids, and average precision; null with one class only."""
    by = by or []
    rows = _by_score(df, score, label, by)
    area = F.sum(F.col("fp") * (2 * F.col("cum_tp") - F.col("tp"))) / 2
    precision = F.sum(F.col("tp") * (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))))
    p, n = F.sum("tp"), F.sum("fp")
    return rows.groupBy(*by).agg(_ratio(area, p * n).alias("auc"), _ratio(precision, p).alias("average_precision"))


def rank_auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """The same area by mid-ranks."""
    rows = _by_score(df, score, label, [])
    after = F.col("cum_tp") + F.col("cum_fp") - (F.col("tp") + F.col("fp") + 1) / 2
    p, n = F.sum("tp"), F.sum("fp")
    return rows.agg(_ratio(p * (p + n) - F.sum(after * F.col("tp")) - p * (p + 1) / 2, p * n).alias("auc"))


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(_ratio(a, b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [_safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1")]


def binary_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("n"), F.count_if(t == p).alias("ok"))
    return n.select(*prf(F.col("tp"), F.col("fp"), F.col("fn")), _safe(F.col("ok"), F.col("n")).alias("accuracy"), "n")


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support of each class that occurs in the truth."""
    own = F.struct(F.col(truth).alias("class"), F.lit(1).alias("support"), (F.col(truth) == F.col(predicted)).cast("int").alias("tp"), F.lit(0).alias("claimed"))
    other = F.struct(F.col(predicted).alias("class"), F.lit(0).alias("support"), F.lit(0).alias("tp"), F.lit(1).alias("claimed"))
    n = df.select(F.inline(F.array(own, other))).groupBy("class").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("claimed").alias("claimed"))
    return n.where("support > 0").select("class", *prf(F.col("tp"), F.col("claimed") - F.col("tp"), F.col("support") - F.col("tp")), "support")


def weighted_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    total = F.sum("support")
    return class_report(df, truth, predicted).agg(*(_safe(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")))


def multilabel_f1(truth: DataFrame, predicted: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """Micro and macro F1 over (doc_id, label) pairs; further keys, such as a model, group the rows."""
    keys = keys or []
    on = [*keys, "doc_id", "label"]
    t, p = truth.select(*on).distinct().withColumn("_t", F.lit(1)), predicted.select(*on).distinct().withColumn("_p", F.lit(1))
    both = t.join(p.hint("merge"), on, "full").groupBy(*keys, "label").agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn")
    )
    f1 = lambda tp, fp, fn: _safe(2 * tp, 2 * tp + fp + fn)
    return both.groupBy(*keys).agg(
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1")
    )


def macro_auc(df: DataFrame, cls: str, score: str, label: str) -> DataFrame:
    return auc(df, score, label, [cls]).agg(F.avg("auc").alias("macro_auc"))


def valid(scores: DataFrame) -> DataFrame:
    return scores.where("score >= 0")


def by_technique(scores: DataFrame) -> DataFrame:
    return valid(scores).groupBy("technique").agg(F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count("*").alias("n"))


def accuracy_at(scores: DataFrame, authentic: list[str], threshold: float = 0.5) -> DataFrame:
    """Share judged right per technique and overall (technique null)."""
    right = F.when(F.col("technique").isin(authentic), F.col("score") < threshold).otherwise(F.col("score") >= threshold)
    return valid(scores).rollup("technique").agg(F.avg(right.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def weak_techniques(scores: DataFrame, least: float = 0.5) -> DataFrame:
    return by_technique(scores).where(F.col("avg_score") < least)


def grade(accuracy_pct: Column) -> Column:
    return F.when(accuracy_pct >= 90, "excellent").when(accuracy_pct >= 75, "good").otherwise("needs improvement")


def category_summary(df: DataFrame, category: str, verdict: str) -> DataFrame:
    """Per category how many verdicts are as expected, and whether all are."""
    right = F.when(F.col(category) == "authentic", F.col(verdict).isin("authentic", "suspicious")).otherwise(F.col(verdict) == "tampered")
    out = df.groupBy(category).agg(F.count_if(right).alias("right"), F.count("*").alias("n"))
    return out.withColumn("passed", F.col("right") == F.col("n"))


def score_distribution(df: DataFrame, cnn: str, fused: str, threshold: float = 0.5) -> DataFrame:
    return df.agg(
        F.avg(cnn).alias("cnn_mean"), F.stddev_pop(cnn).alias("cnn_std"), F.avg(fused).alias("fused_mean"), F.stddev_pop(fused).alias("fused_std"),
        (100 * F.count_if(F.col(fused) >= threshold) / F.count("*")).alias("over_pct"), F.count("*").alias("n"),
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal steps from minimum to maximum; the last one is closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends.lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    width = (ends.hi - ends.lo) / bins or 1.0
    return df.where(F.col(value).isNotNull()).groupBy(F.least(F.floor((F.col(value) - ends.lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def best_run(runs: DataFrame) -> DataFrame:
    """The run and epoch of the largest AUC that is a number; ties by run and epoch."""
    return runs.where(~F.isnan("auc") & F.col("auc").isNotNull()).orderBy(F.desc("auc"), "run_id", "epoch").limit(1)


def run_status(runs: DataFrame, last_epoch: int = 100) -> DataFrame:
    out = runs.groupBy("run_id").agg(F.max("epoch").alias("latest"), F.count("*").alias("checkpoints"))
    return out.withColumn("completed", F.col("latest") == last_epoch)


def clip_level(pixels: DataFrame, by: str, value: str, percent: float = 0.99) -> DataFrame:
    """The percentile that pixel values are cut at; 1 where it isn't above 0."""
    p = F.percentile(value, percent)
    return pixels.groupBy(by).agg(F.when(p > 0, p).otherwise(1.0).alias("level"))


def suspicious_area(regions: DataFrame, by: str, total: float, *, min_ratio: float = 0.0008, most: int = 5) -> DataFrame:
    """Percent of the picture in its largest regions, small ones left out. regions: by, region_id, area."""
    from sparkverity.operators.datasets import first_rows

    kept = regions.where(F.col("area") >= max(20.0, min_ratio * total)).withColumn("_neg", -F.col("area"))
    return first_rows(kept, most, "_neg", "region_id", by=[by]).groupBy(by).agg((100.0 * F.sum("area") / total).alias("area_pct"), F.count("*").alias("regions"))


def pooled(tokens: DataFrame, by: str, vector: str, mask: str) -> DataFrame:
    """Mean of the vectors whose mask is 1, per position."""
    long = tokens.select(by, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("pos", "_x"))
    return long.groupBy(by, "pos").agg((F.sum(F.col("_x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("value"))
