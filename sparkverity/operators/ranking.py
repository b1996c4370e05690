"""Exact ranks and running sums without sorting a whole group in one task.

Rows are put into many buckets that follow the order (by the leading digits of a hash, or by ranges
of a value); counts per bucket give what lies before a bucket, a window inside each bucket
gives the rest. Equal results to one window over the group, spread over the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkverity.session import shared_dir


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order that every engine can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary"))


def hash_rank(df: DataFrame, key: str, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """df with _rank (from 1) in seeded order and _total, per group of ``by`` or over all rows; keys are unique."""
    by = by or []
    marked = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = marked.groupBy(*by, "_b").agg(F.count("*").alias("_n"))  # at most 4096 rows a group
    running = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    keys = [*by, "_b"]
    before = counts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), (F.sum("_n").over(running) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = marked.join(before.hint("merge"), on).drop(*(f"_k_{k}" for k in keys))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key))
    return joined.withColumn("_rank", F.col("_before") + inside).drop("_h", "_b", "_before")


def running_sums(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """df (one row per group and value) with sums over all rows of larger or equal value, as cum_<name>.
    Rows are dealt by ranges of the value that hold about equally many, so values may lie as unevenly as they like."""
    by = by or []
    shared_dir(df.sparkSession)
    marked = df.repartitionByRange(F.col(value)).withColumn("_b", F.spark_partition_id()).checkpoint()
    per = marked.groupBy(*by, "_b").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))  # a row per group and range
    after = Window.partitionBy(*by).orderBy(F.desc("_b")) if by else Window.orderBy(F.desc("_b"))
    before = per.select(*by, "_b", *((F.sum(f"_t_{s}").over(after) - F.col(f"_t_{s}")).alias(f"_o_{s}") for s in sums))
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(before.hint("merge"), [*by, "_b"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_o_{s}") + F.sum(s).over(inside))
    return out.select(*df.columns, *(f"cum_{s}" for s in sums))
