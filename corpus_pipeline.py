"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkverity.llm import decontam, langid, mixing, simhash, tokenout
from sparkverity.llm.common import remove, stored, table
from sparkverity.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a known language; the model is learned from these documents."""
    ship(spark)
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of every near-duplicate component."""
    ship(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark window occurs."""
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents into the interleaved order of their sources."""
    ship(spark)
    return mixing.ordered(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards in training order, sources dealt by their mixing weights; a row per sequence says where it lies."""
    ship(spark)
    return tokenout.materialise(docs, weights={k: w for k, (_, w) in mixing.targets(docs).items()})


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", tokens),
]

#: Hash votes, vantage trees and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    docs, paths = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        paths.append(path)
        if len(paths) > 1:
            remove(spark, paths.pop(0))
    out = STAGES[-1][1](spark, docs, sf_dir)  # token output is written when this returns
    remove(spark, paths.pop())
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
