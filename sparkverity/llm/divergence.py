"""How far the sources of a language are from each other, and which terms mark each source.

Tasks count terms (runs of letters and non-ASCII characters, A-Z lowered) of whole texts per (lang,
source) in hash tables that are handed on when they are full, so that a row per group and term is
shuffled, not one per place. Each language keeps the terms of at least ``LEAST_DOCS`` of its documents.
Shares are whole numbers, 1 + floor(10^9 (count + 2) / (N + 2 V)); 10^9 times a count is never formed, so
that counts of up to 2.8 * 10^14 stay exact in 64 bits.

Pairs of sources are compared on a cube: the sources of a language fall into blocks of about
``BLOCK_GROUPS``, its terms into blocks of about ``BLOCK_TERMS``, both by hash. A task owns a cell (group
block, group block, term block). Each count goes to the cells of its own block with every other block of
groups, once per unordered pair of blocks; a marker row per group and term block carries the share of
absent terms and the block's number of terms, so that terms which neither source has cost one product,
and groups without terms are in every cell they belong to. A cell sums its terms for all its pairs of
sources; partial sums meet along the term axis in one sum per pair. Rows shuffled are counts times blocks
of groups; a cell holds at most about 2 * BLOCK_GROUPS * BLOCK_TERMS counts, whatever the size of a group.

The terms that mark a source come from its counts and its language's, at most ``RANKS`` a task and
group before the shuffle.

Defined results: null text, lang and source are ''; a group of texts without terms has every kept term
with count 0; a language without kept terms has value 0 for all its pairs and no terms; a lone source has
no pairs; ties go by the item's UTF-8 bytes; repeated rows count as often as they occur; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkverity.llm.common import as_bytes, bounded_batches, stored

LEAST_DOCS = 10
RANKS = 10
BLOCK_GROUPS = 64
BLOCK_TERMS = 4_096
#: Tables of up to so many rows are broadcast, after they are counted.
SMALL = 100_000
#: A task hands its counts on when it holds so many, or has read so many bytes of text.
HELD, HELD_BYTES = 200_000, 256 << 20
#: A-Z to a-z, every other ASCII byte that isn't a letter to a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) rows to be added up; a row with a null term for each group seen."""
    bounded_batches(docs.sparkSession)

    def handed(n: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            terms = [None, *own]
            seen = docs[lang, source]
            for lo in range(0, len(terms), 50_000):
                part = terms[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array([t and t.decode() for t in part], pa.string()),
                    pa.array([own[t] if t else 0 for t in part], pa.int64()), pa.array([seen[t] if t else 0 for t in part], pa.int64()),
                ], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen, read = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), as_bytes(batch.column("text")), strict=True):
                own = Counter(text.translate(LETTERS).split())
                n[lang, source].update(own)
                seen[lang, source].update(own.keys())
                read += len(text)
            if read > HELD_BYTES or sum(map(len, n.values())) > HELD:
                yield from handed(n, seen)
                n, seen, read = defaultdict(Counter), defaultdict(Counter), 0
        yield from handed(n, seen)

    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*known).mapInArrow(run, _COUNTS)


def share(n: str = "n", total: str = "big_n", terms: str = "v") -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)) without leaving 64 bits: 10^9 = 31,250 * 32,000."""
    a, d = f"({n} + 2)", f"({total} + 2 * {terms})"
    first = f"({a} * 31250L)"
    return F.when(F.col(terms) > 0, F.expr(f"1L + (({first} div {d}) * 32000L) + (({first} % {d}) * 32000L) div {d}"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares of at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _with(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which is broadcast if it has few rows, merged otherwise (its keys may be hot: adaptive execution splits them)."""
    return left.join(F.broadcast(right) if right.count() <= SMALL else right.hint("merge"), on, how)


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial values of all ordered pairs of sources of a cell: those of block a with those of block b."""
    marks = pdf[pdf["term"].isna()].drop_duplicates("source")
    names, block, zero, n_terms = marks["source"].to_numpy(object), marks["own"].to_numpy(), marks["p"].to_numpy(), int(marks["n_terms"].iloc[0])
    order = np.argsort(names, kind="stable")
    names, block, zero = names[order], block[order], zero[order]
    counts = pdf[pdf["term"].notna()]
    terms, column = np.unique(counts["term"].to_numpy(np.int64), return_inverse=True)
    shares = np.repeat(zero.astype(np.int64)[:, None], len(terms), axis=1)
    place = pd.Series(np.arange(len(names)), index=names)
    shares[place[counts["source"]].to_numpy(), column] = counts["p"].to_numpy(np.int64)
    a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
    left, right = np.nonzero(block == a)[0], np.nonzero(block == b)[0]
    absent, first, second, values = n_terms - len(terms), [], [], []
    for i in left:
        others = right[right > i] if a == b else right
        if len(others):
            value = _apart(shares[i][None, :], shares[others]).sum(1) + absent * _apart(zero[i], zero[others])
            first.append(np.full(len(others), i))
            second.append(others)
            values.append(value)
    x, y, value = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (first, second, values))
    both = np.concatenate([x, y]), np.concatenate([y, x])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * (2 * len(x)), "source": names[both[0]].tolist(), "item": names[both[1]].tolist(), "value": np.concatenate([value, value])}, dtype=object).astype({"value": "int64"})


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def pairs(groups: DataFrame, kept: DataFrame, counts: DataFrame, *, block_groups: int = BLOCK_GROUPS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, item, value for the ordered pairs of sources. groups: lang, source, big_n, v, n_sources;
    kept: lang, tid, v; counts: lang, source, tid, p, v, n_sources. All are stored tables."""
    n_blocks = lambda column, size: F.greatest(F.lit(1), F.ceil(F.col(column) / size)).cast("int")
    group_block = F.pmod(F.xxhash64("source"), n_blocks("n_sources", block_groups)).cast("int")
    term_block = F.pmod(F.xxhash64("tid"), n_blocks("v", block_terms)).cast("int")
    per_block = kept.groupBy("lang", term_block.alias("t")).agg(F.count("*").alias("n_terms"))
    marks = groups.where("n_sources > 1").select(
        "lang", "source", group_block.alias("own"), F.lit(None).cast("long").alias("term"), F.coalesce(share("0"), F.lit(0)).alias("p"), n_blocks("n_sources", block_groups).alias("_gb"),
        F.explode(F.sequence(F.lit(0), n_blocks("v", block_terms) - 1)).alias("t"),
    )
    marks = _with(marks, per_block, ["lang", "t"], "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    rows = counts.where("n_sources > 1").select("lang", "source", group_block.alias("own"), F.col("tid").alias("term"), "p", n_blocks("n_sources", block_groups).alias("_gb"), term_block.alias("t"), F.lit(0).cast("long").alias("n_terms"))
    sent = marks.unionByName(rows).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_gb") - 1)))
    sent = sent.select("lang", F.least("own", "_o").alias("a"), F.greatest("own", "_o").alias("b"), "t", "own", "source", "term", "p", "n_terms")
    partial = sent.groupBy("lang", "a", "b", "t").applyInPandas(_cell, "lang string, source string, item string, value long")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, ranks: int = RANKS, block_groups: int = BLOCK_GROUPS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    seen, _ = stored(partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    terms = seen.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_count"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs)
    kept, _ = stored(kept.select("lang", "term", "lang_count", F.monotonically_increasing_id().alias("tid")), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    found = terms.select("lang", "source", "term", "n").join(kept.hint("merge"), ["lang", "term"])
    found, _ = stored(found, "found")
    names = seen.where("term IS NULL").select("lang", "source")
    sizes = names.groupBy("lang").agg(F.count("*").alias("n_sources"))
    groups = names.join(found.groupBy("lang", "source").agg(F.sum("n").alias("big_n")).hint("merge"), ["lang", "source"], "left")
    groups = _with(_with(groups, langs, ["lang"], "left"), sizes, ["lang"])
    groups, _ = stored(groups.select("lang", "source", F.coalesce("big_n", F.lit(0)).alias("big_n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"), "n_sources"), "groups")
    counts, _ = stored(_with(found, groups, ["lang", "source"]).withColumn("p", share()), "shares")
    both = pairs(groups, _with(kept, langs.select("lang", "v"), ["lang"]), counts, block_groups=block_groups, block_terms=block_terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    marking = counts.withColumn("q", share("lang_count", "lang_n")).where("p > q")
    marking = marking.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", place).unionByName(marking.withColumn("rank", place).where(F.col("rank") <= ranks))
