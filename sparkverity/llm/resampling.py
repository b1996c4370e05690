"""Target-distribution importance resampling over hashed word windows.

A pre-tokenizer (an untrained split by a pattern, over text whose A-Z are lowered) gives the words of a
whole text with their offsets. A feature is a window of offset pairs: the words from one pair to a later
one, joined by one space. Its bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. One pass
over the texts writes each document's histogram of buckets (sorted buckets and counts, about a third of
the compressed text); everything after it reads histograms only.

Histograms of all documents and of all target texts are summed in tasks, at most ``buckets`` rows a task,
and give each bucket's gain: the log ratio of smoothed shares, in thousandths, floored. A document's
weight is the floored mean of its features' gains; weight plus Gumbel noise, drawn from a hash of the
doc_id, is its score, and the highest scores are a sample without replacement in proportion to
exp(weight / 1000).

Ranks need no sort of all rows: scores are whole numbers within the noise's and the gains' limits (fewer
than 200,000 values whatever the input), so counts per score say what lies before each score, and only
the rows of one score are ordered in one window. Noise deals documents over the scores; at most one in a
thousand of many documents has one score.

Long texts are cut into pieces at separators, so that no list of words outgrows ``PIECE`` characters;
windows run on across pieces. Driver and broadcasts hold ``buckets`` numbers and a row per score.

Defined results: a null, empty or wordless text has no features, weight 0 and a score of noise alone, and
isn't drawn (``least_words``); a null doc_id is the empty string to the hash and comes last in a tie;
repeated rows are documents of their own with equal scores and consecutive ranks; an empty table gives no
rows, an empty target leaves T = 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkverity.llm.common import as_bytes, bounded_batches, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LENGTHS = (1, 1)
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Characters of a text that are split at once.
PIECE = 1 << 18
#: Bucket of a word, kept for so many different words a task.
CACHE = 200_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD_BYTE = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


def splitter():
    """offsets(text): the words of a lowered text with their places, by an untrained pre-tokenizer."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str


def pieces(text: bytes, size: int = PIECE) -> Iterator[str]:
    """The lowered text in pieces of about size bytes that end at separators; a longer word stays whole."""
    text, at = text.translate(_LOWER), 0
    while len(text) - at > size:
        end = at + size
        while end < len(text):
            stops = np.nonzero(~_WORD_BYTE[np.frombuffer(text, np.uint8, min(4096, len(text) - end), end)])[0]
            if len(stops):
                end += int(stops[0])
                break
            end = min(end + 4096, len(text))
        yield text[at:end].decode()
        at = end
    yield text[at:].decode()


class Buckets(dict):
    """Feature to bucket, worked out once for each of the CACHE first different features."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: str) -> int:
        bucket = crc32(feature.encode()) % self.n
        if len(self) < CACHE and len(feature) < 64:
            self[feature] = bucket
        return bucket


def buckets_of(text: bytes | None, split, bucket: Buckets, lengths: tuple[int, int] = LENGTHS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature, of a whole text."""
    n_words, found, tail = 0, [], []
    for piece in pieces(text) if text else ():
        pairs = split(piece)
        n_words += len(pairs)
        words = tail + [word for word, _ in pairs]
        for n in range(lengths[0], lengths[1] + 1):
            own = words if n == 1 else words[max(0, len(tail) - n + 1) :]  # windows that end in this piece
            found.append(np.fromiter(map(bucket.__getitem__, own[len(tail) :] if n == 1 else map(" ".join, zip(*(own[i:] for i in range(n)), strict=False))), np.int64))
        tail = words[max(0, len(words) - lengths[1] + 1) :] if lengths[1] > 1 else []
    return n_words, np.concatenate(found) if found else np.zeros(0, np.int64)


def _folded(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    if len(values) * 8 < buckets:
        return np.unique(values, return_counts=True)
    counts = np.bincount(values, minlength=buckets)
    own = np.nonzero(counts)[0]
    return own, counts[own]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int32()))


def histograms(docs: DataFrame, *keep: str, buckets: int = BUCKETS, lengths: tuple[int, int] = LENGTHS) -> DataFrame:
    """keep, n_words, n_features and the histogram (bucket, times: arrays by rising bucket) of each text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bucket = splitter(), Buckets(buckets)
        for batch in batches:
            n_words, n_features, own, times = [], [], [], []
            for text in as_bytes(batch.column("text")):
                n, found = buckets_of(text, split, bucket, lengths)
                n_words.append(n)
                n_features.append(len(found))
                values, counts = _folded(found, buckets)
                own.append(values)
                times.append(counts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), _lists(own), _lists(times)],
                names=[*keep, "n_words", "n_features", "bucket", "times"],
            )

    kept = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}n_words long, n_features long, bucket array<int>, times array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All buckets and counts of a batch, and where each document's begin and end."""
    lists, times = batch.column("bucket"), batch.column("times")
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), ends


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of all histograms: one array of ``buckets`` numbers, in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            own, times, _ = _flat(batch)
            np.add.at(total, own, times)
        own = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("bucket", "times").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, for each bucket."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(
    docs: DataFrame, target: DataFrame, *, lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    spark = docs.sparkSession
    rows, _ = stored(histograms(docs, "doc_id", buckets=buckets, lengths=lengths), "histograms")
    gain = spark.sparkContext.broadcast(gains(totals(rows, buckets), totals(histograms(target, buckets=buckets, lengths=lengths), buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, times, ends = _flat(batch)
            sums = np.concatenate([[0], np.cumsum(gain.value[own] * times)])
            n = batch.column("n_features").to_numpy()
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)  # floors go down
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "n_words", "n_features")), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored, _ = stored(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    return drawn(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(scored: DataFrame, fit, percent: int = PERCENT) -> DataFrame:
    """scored (a stored table) with the rank of the rows drawn: of the n fit rows the floor(percent * n / 100) of highest score."""
    counts = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))  # a row per score: a bounded number
    before = counts.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before"))
    n = percent * (counts.agg(F.sum("n")).first()[0] or 0) // 100
    last = before.where(F.col("before") < n).agg(F.min("score")).first()[0]
    no_rank = scored.withColumn("rank", F.lit(None).cast("long"))
    if last is None:
        return no_rank
    is_high = fit & (F.col("score") >= last)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    high = scored.where(is_high).join(F.broadcast(before.where(F.col("before") < n)), "score").withColumn("rank", (F.col("before") + place).cast("long"))
    high = high.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return high.select(*no_rank.columns).unionByName(no_rank.where(~is_high))
