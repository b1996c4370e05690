"""The streaming form of claim verification, run over a table of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkverity.operators import hashing as HJ
from sparkverity.plans.claim_queries import BRUTE, FLOW, hash_queries, refs
from sparkverity.session import new_dir
from sparkverity.sources.io import CLAIMS, columns
from sparkverity.sources.views import Inputs, query
from sparkverity.streaming.verify import read_claim_stream, start, start_with_hashes


@query("st1_verify_stream", "claims", sql="SELECT count(*) AS n, count(DISTINCT claim_id) AS claims, sum(CASE WHEN cnn_score IS NULL THEN 1 ELSE 0 END)::bigint AS manual FROM claims")
def st1(x: Inputs) -> DataFrame:
    source, out = new_dir(x.spark, "stream-in"), new_dir(x.spark, "stream-out")
    rows = x.claims.withColumn("img_study_desc", F.lit(None).cast("string")).withColumn("claim_ts", F.col("claim_ts").cast("timestamp"))
    rows.select(*columns(CLAIMS)).write.parquet(source)
    run = start(read_claim_stream(x.spark, source), lambda batch, k: batch.select("claim_id", "verdict").write.mode("overwrite").parquet(f"{out}/batch={k}"), new_dir(x.spark, "stream-state"), late="10000 days")
    run.awaitTermination()
    return x.spark.read.parquet(out).agg(F.count("*").alias("n"), F.count_distinct("claim_id").alias("claims"), F.count_if(F.col("verdict.recommendation") == "manual_review").alias("manual"))


HASHED = """hashed AS (SELECT claims.* REPLACE (CASE WHEN distance <= 5 THEN 1::double WHEN distance <= 10 THEN 0.7::double WHEN distance IS NOT NULL THEN 0::double END AS phash_score) FROM claims LEFT JOIN nn ON nn.query_id = claim_id)"""


@query("st2_verify_stream_hashes", "claims", "hash_queries", "hash_refs", sql=f"WITH {BRUTE}, {HASHED}, {FLOW.replace('FROM claims', 'FROM hashed')} SELECT claim_id, phash_score, image_verdict, recommendation FROM g")
def st2(x: Inputs) -> DataFrame:
    """Claims arrive with the hash of their picture, where there is one of their number; known pictures are in an index."""
    source, out = new_dir(x.spark, "stream-in"), new_dir(x.spark, "stream-out")
    hashes = hash_queries(x).select(F.col("query_id").alias("claim_id"), F.col("hex").alias("img_hash"))
    rows = x.claims.withColumn("img_study_desc", F.lit(None).cast("string")).withColumn("claim_ts", F.col("claim_ts").cast("timestamp")).join(hashes.hint("merge"), "claim_id", "left")
    rows.select(*columns(CLAIMS), "img_hash").repartition(3).write.parquet(source)
    stream = read_claim_stream(x.spark, source, files=2, more=", img_hash string")
    sink = lambda batch, k: batch.select("claim_id", "phash_score", "image", "verdict").write.mode("overwrite").parquet(f"{out}/batch={k}")
    start_with_hashes(stream, HJ.build_index(refs(x)), sink, new_dir(x.spark, "stream-state"), late="10000 days").awaitTermination()
    return x.spark.read.parquet(out).select("claim_id", "phash_score", F.col("image.verdict").alias("image_verdict"), F.col("verdict.recommendation").alias("recommendation"))
