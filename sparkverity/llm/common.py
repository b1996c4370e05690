"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkverity.session import new_dir, shared_dir

#: A-Z to a-z, every other ASCII byte that is neither digit nor a-z to a blank. UTF-8 bytes
#: from 0x80 stay, so splitting at blanks gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Upper bound of one Arrow batch, so that long texts don't pile up in a Python worker.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; later steps survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def keep_rows(docs: DataFrame, mask: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of docs, whole, for which the mask says so. mask() is called once a task."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = mask()
        for batch in batches:
            yield batch.filter(pa.array(of(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def stored(df: DataFrame, what: str, level: int = 3) -> tuple[DataFrame, str]:
    """df as a compressed table in the shared folder, read back, and its path."""
    path = new_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of our own from the shared folder."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: A key counts as hot from one part in so many of all rows on, so there are no more hot keys than that.
HOT_PARTS = 256


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once; the hot keys' rows of right are broadcast, the rest is merged."""
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(1, total // HOT_PARTS)).select(key)
    few = right.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(few.select(key)), key, "left_anti")
    return left.join(F.broadcast(few), key).unionByName(rest.join(right.hint("merge"), key, how))
