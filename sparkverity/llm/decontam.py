"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is ten consecutive words of a benchmark item (an item of fewer words, but not none,
is one window). The windows of one length form a matcher: a shift table over blocks of two
words tells how far the search may jump, a bucket per final block holds the windows that can
end there, and comparing words confirms an occurrence. With windows of ten words and no known
block in sight the search moves nine words at a time.

The benchmark travels to the tasks in passes of at most ``windows_per_pass`` windows, so what is
broadcast has a bound whatever the size of the benchmark; the usual benchmark is one pass and
then the job is a single map over the documents, without a shuffle. With more passes each reads the
texts and stores the spans and items of documents with a hit only, by a hash of id and text; texts
aren't written again.

Defined results: a null or wordless text has no words and no hit; a null item text or item_id
takes no part; repeated documents are judged one by one; repeated items count once by item_id;
an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkverity.llm.common import as_bytes, bounded_batches, keep_rows, stored, words

WINDOW = 10
BLOCK = 2
WINDOWS_PER_PASS = 500_000
WORDS_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

Hits = tuple[list[tuple[int, int]], set[str]]


class Matcher:
    """Wu-Manber tables for windows of m words each."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.m, self.b = m, min(BLOCK, m)
        self.step = m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]] = {}
        for window, items in windows.items():
            for end in range(self.b, m + 1):
                block = window[end - self.b : end]
                self.shift[block] = min(m - end, self.shift.get(block, self.step))
            self.buckets.setdefault(window[m - self.b :], []).append((list(window), items))

    def search(self, text: list[bytes], spans: list[tuple[int, int]], found: set[str]) -> None:
        """Add the word spans and the items of all occurrences."""
        m, b, step, shift, buckets, n = self.m, self.b, self.step, self.shift.get, self.buckets, len(text)
        end = m
        while end <= n:
            block = (text[end - 2], text[end - 1]) if b == 2 else (text[end - 1],)
            jump = shift(block, step)
            if jump:
                end += jump
                continue
            here = text[end - m : end]
            for window, items in buckets[block]:
                if window == here:
                    spans.append((end - m, end))
                    found |= items
            end += 1


def matchers(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> list[Matcher]:
    """One matcher for each length of window that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        own = words(text)
        m = min(window, len(own))
        for start in range(len(own) - m + 1) if m else ():
            by_length.setdefault(m, {}).setdefault(tuple(own[start : start + m]), set()).add(item)
    return [Matcher(m, windows) for m, windows in sorted(by_length.items())]


def covered(spans: list[tuple[int, int]]) -> int:
    """Positions inside any span."""
    total = reach = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def _passes(benchmark: DataFrame, window: int, windows_per_pass: int) -> list[list[tuple[str, bytes | None]]]:
    """The items, in groups of about as many windows as one pass takes; fetched group by group."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where(
        "item IS NOT NULL AND text IS NOT NULL"
    )
    n_words = F.size(F.regexp_extract_all("text", F.lit(WORDS_RE), F.lit(0)))
    total = items.agg(F.sum(F.greatest(n_words - window + 1, F.lit(1)))).first()[0] or 0
    n = max(1, -(-total // windows_per_pass))
    share = lambda k: items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return [(lambda k=k: [(r.item, r.text.encode()) for r in share(k).collect()]) for k in range(n)]


def find(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, windows_per_pass: int = WINDOWS_PER_PASS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (array) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    groups = _passes(benchmark, window, windows_per_pass)
    out = docs.select("doc_id", "text")
    if len(groups) == 1:
        sent = spark.sparkContext.broadcast(groups[0]())
        return out.mapInArrow(_judge(lambda: matchers(sent.value, window)), _schema(docs))
    hits = _hits(docs, groups, window)
    light = out.select("doc_id", _key(docs).alias("_key"), F.size(F.regexp_extract_all(F.coalesce(_lowered("text"), F.lit("")), F.lit(WORDS_RE), F.lit(0))).cast("long").alias("n_words"))
    return light.join(hits.hint("merge"), "_key", "left").select("doc_id", "n_words", "_spans", "_items").mapInArrow(_judge_spans, _schema(docs))


def _lowered(column: str):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(docs: DataFrame):
    """Rows of one key have the same id and text."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\u0000"), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)


def _hits(docs: DataFrame, groups: list, window: int) -> DataFrame:
    """_key, _spans and _items of the documents with a hit in any pass."""
    spark, out = docs.sparkSession, []
    keyed = docs.where("text IS NOT NULL").select(_key(docs).alias("_key"), "text")
    for group in groups:
        sent = spark.sparkContext.broadcast(group())
        out.append(stored(keyed.mapInArrow(_gather(sent, window), "_key string, _spans array<int>, _items array<string>").dropDuplicates(["_key"]), "hits")[0])
        sent.unpersist()
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both.groupBy("_key").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))  # a row a pass


def _schema(docs: DataFrame) -> str:
    return (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, "
        "items_sha256 string, contaminated boolean, items array<string>"
    )


def _gather(sent, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = matchers(sent.value, window)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("_key").to_pylist(), as_bytes(batch.column("text")), strict=True):
                spans, found, text_words = [], set(), words(text)
                for m in search:
                    m.search(text_words, spans, found)
                if spans:
                    rows.append((key, [x for s in spans for x in s], sorted(found)))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["_key", "_spans", "_items"])

    return run


def _verdicts(ids: pa.Array, judged: list[tuple[int, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    rows = []
    for n_words, spans, found in judged:
        names = sorted(found)
        rows.append((n_words, covered(spans), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(spans), names))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def _judge(make: Callable[[], list[Matcher]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = make()
        for batch in batches:
            judged = []
            for text in as_bytes(batch.column("text")):
                spans, found, text_words = [], set(), words(text)
                for m in search:
                    m.search(text_words, spans, found)
                judged.append((len(text_words), spans, found))
            yield _verdicts(batch.column("doc_id"), judged)

    return run


def _judge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("n_words", "_spans", "_items")), strict=True)
        yield _verdicts(batch.column("doc_id"), [(n, list(zip(s[::2], s[1::2], strict=True)) if s else [], set(i or ())) for n, s, i in rows])


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, windows_per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """The documents, whole and with all their columns, in which no window occurs."""
    groups = _passes(benchmark, window, windows_per_pass)
    if len(groups) > 1:
        hits = _hits(docs, groups, window).select("_key")
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), _key(docs).alias("_key"))
        return rows.join(hits.hint("merge"), "_key", "left_anti").select("_doc.*")
    sent = docs.sparkSession.sparkContext.broadcast(groups[0]())

    def mask() -> Callable[[pa.RecordBatch], list[bool]]:
        search = matchers(sent.value, window)

        def of(batch: pa.RecordBatch) -> list[bool]:
            keep = []
            for text in as_bytes(batch.column("text")):
                spans, text_words = [], words(text)
                for m in search:
                    m.search(text_words, spans, set())
                keep.append(not spans)
            return keep

        return of

    return keep_rows(docs, mask)
