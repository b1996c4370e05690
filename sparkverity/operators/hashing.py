"""Similarity joins over image hashes, by probing an index of 16-bit words.

References and queries carry ``hex`` (16 digits); rows with invalid hex are left out, as unreadable.
A ``HashIndex`` holds every reference under its four 16-bit words, written once and read by any number
of queries or batches. Two hashes that differ by d = 4 a + b bits have one of the words 0..b at most a
bits apart, or one of the others at most a - 1 (pigeonhole): so a query visits, in each word's table, the
keys within that radius of its own. At 10 bits these are 428 keys; of random hashes under 1 % are met.

``within`` gives the pairs of rows up to a distance, each once: from the first word that finds it.
``nearest`` has no distance bound. Each round visits the keys of the next ring, s bits from the query's
words, after which all references up to 4 s + 3 bits away have been met; queries whose best is that near
are done, the others go on. A round is run only while it meets fewer rows than the index has; what is
left then (hashes with nothing near in a small or sparse index) is compared with the references by cells
of a block of queries and a block of references.

Probes of few queries are broadcast to the index, which isn't shuffled then (their number is counted);
a small index is broadcast to the probes; else both are merged by key. Equal hashes are probed and
met once in ``nearest``, so groups of copies don't multiply.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkverity.functions import hashing as H
from sparkverity.session import new_dir

WORDS, WORD_BITS = 4, 16
#: Up to so many rows of probes, or of the index, are broadcast.
SENT = 500_000
QUERY_BLOCK, BLOCK_ROWS = 4_096, 65_536
#: Ids from -2^55 to 2^55 fit one whole number with a distance; beyond, a decimal holds both.
ID_BITS = 56


@dataclass(frozen=True)
class HashIndex:
    """words: _key, _rhi, _rlo, ref_id, first (the smallest id of its hash), four rows a reference; n different hashes."""

    words: DataFrame
    refs: DataFrame
    n: int
    wide: bool


def _halves(df: DataFrame, *keep: str, prefix: str) -> DataFrame:
    out = df.select(*keep, H.half(F.col("hex"), 0).alias(f"{prefix}hi"), H.half(F.col("hex"), 1).alias(f"{prefix}lo"))
    return out.where(F.col(f"{prefix}hi").isNotNull())


def _word(high: Column, low: Column, k: int) -> Column:
    half = high if k < 2 else low
    return (F.shiftright(half, WORD_BITS) if k % 2 == 0 else half.bitwiseAND(F.lit(0xFFFF))).cast("int")


def _keys(prefix: str) -> list[Column]:
    """The four words, each under a key of its own table."""
    return [_word(F.col(f"{prefix}hi"), F.col(f"{prefix}lo"), k) + F.lit(k << WORD_BITS) for k in range(WORDS)]


def build_index(refs: DataFrame, path: str | None = None, *, ref_id: str = "ref_id") -> HashIndex:
    """Write the index of references (ref_id, hex) below path, or below a folder of its own."""
    path = path or new_dir(refs.sparkSession, "hash-index")
    own = _halves(refs, F.col(ref_id).cast("bigint").alias("ref_id"), prefix="_r")
    own.write.parquet(f"{path}/refs")
    own = refs.sparkSession.read.schema(own.schema).parquet(f"{path}/refs")
    least = own.groupBy("_rhi", "_rlo").agg(F.min("ref_id").alias("_least"))
    marked = own.join(least.hint("merge"), ["_rhi", "_rlo"]).select("_rhi", "_rlo", "ref_id", (F.col("ref_id").eqNullSafe(F.col("_least"))).alias("first"))
    marked.select(F.explode(F.array(*_keys("_r"))).alias("_key"), "_rhi", "_rlo", "ref_id", "first").write.parquet(f"{path}/words")
    return open_index(refs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> HashIndex:
    """An index written before: nothing of it is worked out again but its size."""
    words = spark.read.schema("_key int, _rhi bigint, _rlo bigint, ref_id bigint, first boolean").parquet(f"{path}/words")
    refs = words.where(F.col("_key") < F.lit(1 << WORD_BITS)).select("_rhi", "_rlo", "ref_id", "first")
    r = refs.where("first").agg(F.count("*").alias("n"), F.min("ref_id").alias("lo"), F.max("ref_id").alias("hi")).first()
    limit = 1 << (ID_BITS - 1)
    return HashIndex(words, refs, r.n, bool(r.n and r.lo is not None and (r.lo < -limit or r.hi >= limit)))


def _packed(distance: Column, wide: bool) -> Column:
    """Distance and reference as one number, so that min() stays a hash aggregate."""
    if wide:
        return (distance.cast("decimal(38,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col("ref_id").cast("decimal(20,0)")
    return F.shiftleft(distance.cast("bigint"), ID_BITS) + (F.col("ref_id") + F.lit(1 << (ID_BITS - 1)))


def _distance(packed: Column, wide: bool) -> Column:
    if wide:
        return F.floor((packed + F.lit(str(1 << 63)).cast("decimal(20,0)")) / F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("int")
    return F.shiftright(packed, ID_BITS).cast("int")


def _reference(packed: Column, wide: bool) -> Column:
    if wide:
        return (packed - _distance(packed, wide).cast("decimal(38,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("bigint")
    return packed.bitwiseAND(F.lit((1 << ID_BITS) - 1)) - F.lit(1 << (ID_BITS - 1))


def _ring(least: int, most: int) -> Column:
    """The masks of ``least`` to ``most`` of 16 bits; written so that it folds into one constant."""
    return F.split(F.lit(",".join(str(m) for m in range(1 << WORD_BITS) if least <= m.bit_count() <= most)), ",").cast("array<int>")


def _apart() -> Column:
    return H.distance(F.col("_qhi"), F.col("_qlo"), F.col("_rhi"), F.col("_rlo"))


def met(queries: DataFrame, n_queries: int, index: HashIndex, rings: list[tuple[int, int]], *, first: bool = False) -> DataFrame:
    """Queries (_qhi, _qlo and more) with the references whose word k differs from theirs by a number of bits within rings[k]."""
    per_query = sum(comb(WORD_BITS, s) for low, high in rings for s in range(low, high + 1))
    by_ring = {ring: [k for k, r in enumerate(rings) if r == ring] for ring in dict.fromkeys(rings) if ring[1] >= ring[0]}
    probes = None
    for ring, tables in by_ring.items():  # one generator of masks for the words that share a radius
        words = F.explode(F.array(*(_keys("_q")[k] for k in tables))).alias("_word")
        part = queries.select("*", words).withColumn("_mask", F.explode(_ring(*ring))).withColumn("_key", F.col("_word").bitwiseXOR(F.col("_mask"))).drop("_word", "_mask")
        probes = part if probes is None else probes.unionByName(part)
    words = index.words.where("first") if first else index.words
    if n_queries * per_query <= SENT:
        return words.join(F.broadcast(probes), "_key")
    return probes.join(F.broadcast(words) if index.n * WORDS <= SENT else words.hint("merge"), "_key")


def _counted(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back, back.count()


def _index(refs: DataFrame | HashIndex, ref_id: str) -> HashIndex:
    return refs if isinstance(refs, HashIndex) else build_index(refs, ref_id=ref_id)


def nearest(queries: DataFrame, refs: DataFrame | HashIndex, *, query_id: str = "query_id", ref_id: str = "ref_id", query_block: int = QUERY_BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per query the nearest reference (ties: smallest id) and its distance; nulls without references. refs: rows or an index."""
    index = _index(refs, ref_id)
    asked = _halves(queries, query_id, prefix="_q")
    left, n_left = _counted(asked.select("_qhi", "_qlo").distinct(), "hash-queries")
    best_type = "decimal(38,0)" if index.wide else "bigint"
    left, done = left.withColumn("_p", F.lit(None).cast(best_type)), []
    for low, s in [(0, 1), *((k, k) for k in range(2, WORD_BITS + 1))]:
        meets = WORDS * sum(comb(WORD_BITS, k) for k in range(low, s + 1)) * (1 + index.n / (1 << WORD_BITS))
        if not n_left or meets >= index.n:
            break
        found = met(left.select("_qhi", "_qlo"), n_left, index, [(low, s)] * WORDS, first=True).groupBy("_qhi", "_qlo").agg(F.min(_packed(_apart(), index.wide)).alias("_new"))
        state, _ = _counted(left.join(found.hint("shuffle_hash"), ["_qhi", "_qlo"], "left").select("_qhi", "_qlo", F.least("_p", "_new").alias("_p")), "hash-round")
        is_done = F.coalesce(_distance(F.col("_p"), index.wide) <= WORDS * s + WORDS - 1, F.lit(False))
        done.append(state.where(is_done))
        left = state.where(~is_done)
        n_left = left.count()
    if n_left and index.n:
        done.append(_by_cells(left.select("_qhi", "_qlo"), n_left, index, query_block, block_rows))
    best = None
    for part in done:
        best = part if best is None else best.unionByName(part)
    if best is None:
        return queries.select(query_id, F.lit(None).cast("int").alias("distance"), F.lit(None).cast("bigint").alias(ref_id))
    own = queries.select(query_id, H.half(F.col("hex"), 0).alias("_qhi"), H.half(F.col("hex"), 1).alias("_qlo"))
    return own.join(best.hint("merge"), ["_qhi", "_qlo"], "left").select(query_id, _distance(F.col("_p"), index.wide).alias("distance"), _reference(F.col("_p"), index.wide).alias(ref_id))


def _by_cells(left: DataFrame, n_left: int, index: HashIndex, query_block: int, block_rows: int) -> DataFrame:
    """The nearest reference of each query by comparing all, in cells of a block of queries and a block of references."""
    across, down = -(-n_left // query_block), -(-index.n // block_rows)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    q = left.select("*", part(across, "_qhi", "_qlo").alias("_a")).withColumn("_b", spread(down))
    r = index.refs.where("first").select("_rhi", "_rlo", "ref_id", part(down, "_rhi", "_rlo").alias("_b")).withColumn("_a", spread(across))
    pairs = q.join(r.hint("shuffle_hash"), ["_a", "_b"])
    return pairs.groupBy("_qhi", "_qlo").agg(F.min(_packed(_apart(), index.wide)).alias("_p"))


def radii(d: int) -> list[int]:
    """The radius of each word's table within which a pair of d differing bits is met; -1: not visited."""
    return [d // WORDS if k <= d % WORDS else d // WORDS - 1 for k in range(WORDS)]


def within(queries: DataFrame, refs: DataFrame | HashIndex, d: int, *, query_id: str = "query_id", ref_id: str = "ref_id") -> DataFrame:
    """All pairs at most d bits apart, with their distance, each from the first word that meets it."""
    index, radius = _index(refs, ref_id), radii(d)
    own, n = _counted(_halves(queries, F.col(query_id).alias("_id"), prefix="_q"), "hash-queries")
    pairs = met(own, n, index, [(0, r) for r in radius])
    earlier = lambda k: F.bit_count(_word(F.col("_qhi"), F.col("_qlo"), k).bitwiseXOR(_word(F.col("_rhi"), F.col("_rlo"), k))) <= radius[k]
    by = F.shiftright("_key", WORD_BITS)
    is_first = F.lit(True)
    for k in range(WORDS - 1):
        is_first = is_first & ~((by > k) & earlier(k))
    return pairs.where((_apart() <= d) & is_first).select(F.col("_id").alias(query_id), F.col("ref_id").alias(ref_id), _apart().alias("distance"))


def similar(
    queries: DataFrame, refs: DataFrame | HashIndex, *, exact: int = 5, near: int = 10, query_id: str = "query_id", ref_id: str = "ref_id", report_unmatched: bool = True,
) -> DataFrame:
    """Match type of each query: exact, near or none. Without report_unmatched only matches within ``near`` are sought."""
    if report_unmatched:
        found = nearest(queries, refs, query_id=query_id, ref_id=ref_id)
    else:
        index = _index(refs, ref_id)
        best = within(queries, index, near, query_id=query_id).groupBy(query_id).agg(F.min(_packed(F.col("distance"), index.wide)).alias("_p"))
        found = queries.select(query_id).join(best.hint("merge"), query_id, "left").select(query_id, _distance(F.col("_p"), index.wide).alias("distance"), _reference(F.col("_p"), index.wide).alias(ref_id))
    return found.withColumn("match_type", H.match_type(F.col("distance"), exact, near))


def dissimilarity(found: DataFrame) -> DataFrame:
    """Distance to authentic references as a score: share of differing bits, 1 without a reference."""
    return found.withColumn("score", F.coalesce(F.col("distance") / 64.0, F.lit(1.0)))


def insert_hashes(table: DataFrame, new: DataFrame, created_at: Column) -> DataFrame:
    """Rows of new whose hash the table lacks, one per hash (the smallest image_id), ready to append."""
    one = new.groupBy("phash_hex").agg(F.min(F.struct("image_id", "source")).alias("r"))
    one = one.select("phash_hex", "r.image_id", "r.source", F.lit("fraud").alias("label"), created_at.alias("created_at"))
    return one.join(table.select("phash_hex"), "phash_hex", "left_anti")


def hash_exists(queries: DataFrame, table: DataFrame) -> DataFrame:
    known = table.select("phash_hex").distinct().withColumn("_known", F.lit(True))
    return queries.join(known, "phash_hex", "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")
