"""Claims as they arrive: verified one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkverity.functions import hashing as H
from sparkverity.operators import claims
from sparkverity.operators import hashing as HJ
from sparkverity.sources.io import CLAIMS


def read_claim_stream(spark: SparkSession, folder: str, *, files: int = 100, more: str = "") -> DataFrame:
    """more: further columns, as ", name type"."""
    return spark.readStream.schema(CLAIMS + more).option("maxFilesPerTrigger", files).parquet(folder)


def verified_stream(stream: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Each claim once within the watermark; verification itself keeps no state."""
    return claims.verify(stream.withWatermark("claim_ts", late).dropDuplicatesWithinWatermark(["claim_id"]))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, late: str = "1 day") -> StreamingQuery:
    """sink(batch, number) must be repeatable: a batch comes again after a failure."""
    once = stream.withWatermark("claim_ts", late).dropDuplicatesWithinWatermark(["claim_id"])
    return once.writeStream.foreachBatch(lambda batch, k: sink(claims.verify(batch), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_with_hashes(
    stream: DataFrame, index: HJ.HashIndex, sink: Callable[[DataFrame, int], None], checkpoint: str, *, exact: int = 5, near: int = 10, late: str = "1 day",
) -> StreamingQuery:
    """The same for claims that carry img_hash (16 hex digits, or null) in place of a hash score: each batch looks
    its hashes up in an index of known pictures that was written once, and only read here."""
    once = stream.withWatermark("claim_ts", late).dropDuplicatesWithinWatermark(["claim_id"])

    def verified(batch: DataFrame, k: int) -> None:
        batch = batch.persist()
        asked = batch.select(F.col("claim_id").alias("query_id"), F.col("img_hash").alias("hex")).where("hex IS NOT NULL")
        found = HJ.similar(asked, index, exact=exact, near=near).select(F.col("query_id").alias("claim_id"), H.match_score(F.col("match_type")).alias("phash_score"))
        sink(claims.verify(batch.drop("phash_score", "img_hash").join(found.hint("merge"), "claim_id", "left")), k)
        batch.unpersist()

    return once.writeStream.foreachBatch(verified).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
