"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary training texts, give every word a likelihood byte by byte, from
its whole history within the word (up to ``ORDER`` bytes, the end of the word counts as one). That
learns whole words and stems alike: of a family of words that share a stem, most are rare, but the
stem isn't. Counts are of the kind of Kneser-Ney's lower orders: a word counts in a class once for each
different passage that holds it, and not more often than there are texts that hold it, so neither
repetition within a text nor copies of a text add up. Passages are of 2 to ``LONGEST`` words, about five;
where one ends depends on the words there, so near copies are cut alike.

    P_c(b | h) = max(n_c(hb) - D_c(hb), 0) / n_c(h) + l_c(h) n(hb) / n(h)

n_c are counts of class c, n those pooled over both; l_c(h) is what discounting takes from the
continuations of h, and goes to the pooled counts that both classes share. The discount of a count is
``DISCOUNT`` and ``ERRORS`` standard errors of the count expected in the smaller class, by the ratio of
their sizes larger in the larger class, so that both classes discount the same relative frequency.
Rare expressions are thereby left to the shared counts, and their likelihoods don't differ. A share
``POOL`` of the pooled model in both bounds what one word can say.

A text is scored by the log-likelihood ratio of its different words: each counts as far as it exceeds
``EXCESS``, and their sum is normalised by the root of their number. Logistic regression, fitted on a
bounded sample of about ``calibration_rows`` training rows, whose own counts are taken out of the
models first, makes a probability of it. All other counts come from all training rows.

A history whose counts (or those of a part of it) don't exceed their discounts says nothing, and is
left out; no result changes by it. The others are counted: up to ``broadcast_nodes`` go to all tasks,
more stay a table that the words of all texts are joined with (short ones, which many words share, are sent). Words are single; an expression
of several common words isn't learned.

Defined results: a null or wordless text has ratio zero and gets the score of that; labels with a
null toxic or doc_id are ignored; repeated documents and labels count as often as they occur (a word
not oftener than different passages); without training rows of both classes every score is 0 (or 1, if
all are toxic); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkverity.llm.common import as_bytes, bounded_batches, remainder, remove, stored
from sparkverity.llm.common import words as runs

ORDER = 32
#: Code points of the words made of unspaced runs.
GRAM = 4
LONGEST = 16
CALIBRATION_ROWS = 4_000
DISCOUNT = 2.0
ERRORS = 3.5
POOL = 0.02
EXCESS = 1.0
THRESHOLD = 0.7
#: About 150 bytes each in a Python worker.
BROADCAST_NODES = 1_000_000
#: Histories of up to so many bytes (65,793 at most) go to all tasks where the others are joined.
SHORT = 2
#: Ratios of so many words are remembered in a task.
CACHE = 200_000


#: UTF-8 of U+0800-1FFF, U+3000-DFFF and U+20000-3FFFF: scripts that may write no spaces (not punctuation, signs or emoji).
_WIDE = re.compile(rb"[\xe0\xe1\xe3-\xed]|\xf0[\xa0-\xbf]")


def words(text: bytes | None) -> list[bytes]:
    """The words of a text, so that no byte goes unread: a run with characters of scripts that may write
    no spaces gives a word of ``GRAM`` characters from each of its characters on, another run
    of over ``ORDER`` bytes one of ORDER bytes from every half of that on, cut between characters."""
    own = runs(text)
    wide = bool(text) and _WIDE.search(text)
    if not wide and (not own or max(map(len, own)) <= ORDER):
        return own
    out = []
    for w in own:
        if wide and _WIDE.search(w):
            letters = w.decode()
            out += [letters[k : k + GRAM].encode() for k in range(max(1, len(letters) - GRAM + 1))]
            out += [letters[k:].encode() for k in range(max(1, len(letters) - GRAM + 1), len(letters))]
        elif len(w) > ORDER:
            for k in range(0, len(w) - ORDER // 2, ORDER // 2):
                piece = w[k : k + ORDER + 3]
                first = next(i for i, b in enumerate(piece) if b & 0xC0 != 0x80)
                last = next(i for i in range(min(ORDER, len(piece)), 0, -1) if i == len(piece) or piece[i] & 0xC0 != 0x80)
                out.append(piece[first:last])
        else:
            out.append(w)
    return out


def histories(word: bytes) -> list[bytes]:
    """All beginnings of a word, the empty one first, the word with its end last."""
    marked = word[:ORDER] + b" " if len(word) < ORDER else word[:ORDER]
    return [marked[:k] for k in range(len(marked) + 1)]


@dataclass
class Model:
    """Counts (class 0: ordinary, 1: toxic) of the histories that say something, and what is fitted to them."""

    total: tuple[float, float] = (0.0, 0.0)
    place: dict[bytes, int] = field(default_factory=dict)  # history: row of counts
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))  # n_0, n_1, discounted mass of the continuations in 0 and 1
    slope: tuple[float, float] | None = None
    prior: float = 0.0

    def __post_init__(self):
        self.table: dict[bytes, tuple[float, float]] | None = None
        self.cache: dict[bytes, float] = {}

    @property
    def toxic_share(self) -> float:
        return self.total[1] / max(sum(self.total), 1.0)

    def discounts(self, n: np.ndarray) -> np.ndarray:
        """Discounts in both classes of histories with the pooled counts n."""
        least = max(min(self.total), 1.0)
        base = DISCOUNT + ERRORS * np.sqrt(n * least / max(sum(self.total), 1.0))
        return base[..., None] * np.array(self.total) / least

    def step(self, n: np.ndarray, before: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log P_1 / P_0 of continuations with counts n, after histories of counts before and discounted mass left."""
        pooled, all_before = n.sum(-1), before.sum(-1)
        shared = (pooled + 0.02) / (all_before + 5.12)
        seen = before > 0
        own = np.maximum(n - self.discounts(pooled), 0.0) / np.where(seen, before, 1.0)
        p = np.where(seen, own + np.minimum(1.0, left / np.where(seen, before, 1.0)) * shared[..., None], shared[..., None])
        p = np.maximum(p, 1e-12)
        return np.log(p[..., 1] / p[..., 0])

    def bounded(self, ratio):
        """The ratio of a word with a share of the pooled model in both."""
        e = np.exp(np.clip(ratio, -30.0, 30.0))
        pooled = self.toxic_share * e + 1.0 - self.toxic_share
        return np.log(((1.0 - POOL) * e + POOL * pooled) / ((1.0 - POOL) + POOL * pooled))

    def prepared(self) -> Model:
        """Sums along each history: (ratio up to here, ratio of whatever else follows)."""
        if self.table is None:
            by_length = sorted(self.place, key=len)
            self.table = {}
            if by_length:
                n, left = self.counts[:, :2], self.counts[:, 2:]
                rest = self.step(np.zeros((len(n), 2)), n, left)
                at = np.array([self.place[g] for g in by_length])
                parent = np.array([self.place.get(g[:-1], -1) if g else -1 for g in by_length])
                steps = np.where(parent < 0, 0.0, self.step(n[at], n[np.maximum(parent, 0)], left[np.maximum(parent, 0)]))
                for g, k, own, p in zip(by_length, at.tolist(), steps.tolist(), parent.tolist(), strict=True):
                    if not g:
                        self.table[g] = (0.0, float(rest[k]))
                    elif p >= 0 and (before := self.table.get(g[:-1])):
                        self.table[g] = (before[0] + own, float(rest[k]))
        return self

    def ratio(self, word: bytes) -> float:
        """Log-likelihood ratio of a word."""
        get, out = self.table.get, 0.0
        found = get(b"")
        if found:
            end = min(len(word) + 1, ORDER)
            marked = word[:ORDER] + b" "
            for k in range(1, end + 1):
                after = get(marked[:k])
                if after is None:
                    out = found[0] + found[1]
                    break
                found = after
            else:
                out = found[0]
        return float(self.bounded(out))

    def excess(self, text: bytes | None) -> float:
        """What a text is judged by."""
        own, cache, total = set(words(text)), self.cache, 0.0
        for w in own:
            r = cache.get(w)
            if r is None:
                if len(cache) >= CACHE:
                    cache.clear()
                r = cache[w] = max(self.ratio(w) - EXCESS, 0.0)
            total += r
        return total / max(len(own), 1) ** 0.5

    def excess_without(self, text: bytes | None, own_class: int) -> float:
        """The same, as if the text hadn't been counted in its class."""
        own = {w: histories(w) for w in set(words(text))}
        mine, get = Counter(g for gs in own.values() for g in gs), self.place.get
        now, before, left, of = [], [], [], []
        least, both = max(min(self.total), 1.0), max(sum(self.total), 1.0)
        for k, gs in enumerate(own.values()):
            row = self.counts[get(b"")].tolist() if b"" in self.place else None
            for a, b in zip(gs, gs[1:], strict=False):
                then = row[:2] if row else [0.0, 0.0]
                then[own_class] -= mine[a]
                base = DISCOUNT + ERRORS * (max(sum(then), 0.0) * least / both) ** 0.5
                if all(n * least <= base * t for n, t in zip(then, self.total, strict=True)):
                    break
                at = get(b)
                after = self.counts[at].tolist() if at is not None else None
                n = after[:2] if after else [0.0, 0.0]
                n[own_class] = max(0.0, n[own_class] - mine[b])
                now.append(n)
                before.append(then)
                left.append(row[2:])
                of.append(k)
                if after is None:
                    break
                row = after
        if not of:
            return 0.0
        ratio = np.bincount(of, self.step(np.array(now), np.array(before), np.array(left)), minlength=len(own))
        return float(np.maximum(self.bounded(ratio) - EXCESS, 0.0).sum()) / len(own) ** 0.5

    def probability(self, excess):
        if self.slope is None:
            return np.full(np.shape(excess), self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope[0] * np.asarray(excess) + self.slope[1], -30.0, 30.0)))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and a hash of the id, for labelled rows with crc32(doc_id) modulo 3 other than 1."""
    a = docs.where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", "text")
    b = labels.where((remainder(F.col("doc_id"), 3) != 1) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return a.join(b.hint("merge"), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("hash"))


def passages(own: list[bytes]) -> Iterator[bytes]:
    """The words of a text in pieces that end after a word of certain bytes."""
    start = 0
    for at, w in enumerate(own, 1):
        if at - start >= 2 and ((w[0] + w[-1] + len(w)) & 3 == 0 or at - start == LONGEST):
            yield b" ".join(own[start:at])
            start = at
    if start < len(own):
        yield b" ".join(own[start:])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the different passages of each class (n null), and the words with the number of texts."""
    for batch in batches:
        pieces: tuple[set, set] = (set(), set())
        texts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, c in zip(as_bytes(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            own = words(text)
            pieces[c].update(passages(own))
            texts[c].update(set(own))
        for c in (0, 1):
            item = pa.array([*pieces[c], *texts[c]], pa.binary())
            n = pa.array([None] * len(pieces[c]) + list(texts[c].values()), pa.int32())
            yield pa.RecordBatch.from_arrays([item, pa.array(np.full(len(item), c, np.int8)), pa.array([k < len(pieces[c]) for k in range(len(item))]), n], names=["item", "c", "passage", "n"])


def _passage_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the words of each class with the number of passages and of texts."""
    for batch in batches:
        held, texts = Counter(), Counter()
        for item, c, passage, n in zip(*(batch.column(k).to_pylist() for k in ("item", "c", "passage", "n")), strict=True):
            if passage:
                held.update((w, c) for w in set(item.split()))
            else:
                texts[item, c] += n
        keys = list(held.keys() | texts.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in keys], pa.binary()), pa.array([c for _, c in keys], pa.int8()), pa.array([held[k] for k in keys], pa.int64()), pa.array([texts[k] for k in keys], pa.int64())],
            names=["word", "c", "held", "texts"],
        )


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n0, n1: in each class the different passages that hold it, but no more than texts that do."""
    items = rows.mapInArrow(_passages, "item binary, c byte, passage boolean, n int").groupBy("item", "c", "passage").agg(F.sum("n").alias("n"))
    counted = items.mapInArrow(_passage_words, "word binary, c byte, held long, texts long").groupBy("word")
    of = lambda column, c: F.sum(F.when(F.col("c") == c, F.col(column)).otherwise(0))
    sums = counted.agg(*(of(k, c).alias(f"{k}{c}") for k in ("held", "texts") for c in (0, 1)))
    return sums.select("word", *(F.least(f"held{c}", f"texts{c}").cast("double").alias(f"n{c}") for c in (0, 1)))


def _histories(word: Column) -> Column:
    marked = F.concat(word, F.lit(b" "))
    return F.transform(F.sequence(F.lit(0), F.least(F.length(marked), F.lit(ORDER))), lambda k: F.substring(marked, F.lit(1), k))


def history_counts(counted: DataFrame, total: tuple[float, float]) -> DataFrame:
    """g, n0, n1, left0, left1 of the histories that exceed a discount."""
    nodes = counted.select(F.explode(_histories(F.col("word"))).alias("g"), "n0", "n1").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    least = max(min(total), 1.0)
    base = F.lit(DISCOUNT) + F.lit(ERRORS) * F.sqrt((F.col("n0") + F.col("n1")) * F.lit(least / max(sum(total), 1.0)))
    discount = {f"n{c}": base * F.lit(t / least) for c, t in enumerate(total)}
    nodes = nodes.select("*", *(F.least(F.col(n), d).alias(f"cut_{n}") for n, d in discount.items()))
    says = (F.col("n0") > F.col("cut_n0")) | (F.col("n1") > F.col("cut_n1"))
    left = nodes.where(F.length("g") > 0).groupBy(F.substring("g", F.lit(1), F.length("g") - 1).alias("g"))
    left = left.agg(F.sum("cut_n0").alias("left0"), F.sum("cut_n1").alias("left1"))
    found = nodes.where(says).select("g", "n0", "n1").join(left.hint("merge"), "g", "left")
    return found.select("g", "n0", "n1", F.coalesce("left0", F.lit(0.0)).alias("left0"), F.coalesce("left1", F.lit(0.0)).alias("left1"))


def _loaded(nodes: DataFrame, model: Model) -> Model:
    got = nodes.toArrow()
    model.place = {g: k for k, g in enumerate(got.column("g").to_pylist())}
    model.counts = np.column_stack([got.column(c).to_numpy() for c in ("n0", "n1", "left0", "left1")]) if len(got) else np.zeros((0, 4))
    return model


def _calibrated(model: Model, sample: DataFrame) -> Model:
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            y = batch.column("toxic").to_pylist()
            x = [own.excess_without(text, c) for text, c in zip(as_bytes(batch.column("text")), y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.int32())], names=["x", "y"])

    got = sample.mapInArrow(run, "x double, y int").toArrow()
    model.slope = logistic(got.column("x").to_numpy(), got.column("y").to_numpy().astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below zero) and intercept by Newton steps, lightly held back."""
    scale = max(float(x.std()), 1e-9)
    z, b, ridge = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2), np.array([0.1, 1e-6])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ b, -30.0, 30.0)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * b)
        b += np.clip(move, -4.0, 4.0)
        if np.abs(move).max() < 1e-7:
            break
    return max(0.0, float(b[0] / scale)), float(b[1])


def _word_ratios(asked: DataFrame, nodes: DataFrame, model: Model) -> DataFrame:
    """word, excess of each asked word, by joins with a table of histories of any size."""
    before = nodes.select(F.col("g").alias("p"), F.col("n0").alias("b0"), F.col("n1").alias("b1"), F.col("left0").alias("m0"), F.col("left1").alias("m1"))
    steps = nodes.withColumn("p", F.when(F.length("g") > 0, F.substring("g", F.lit(1), F.length("g") - 1))).join(before.hint("merge"), "p", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("n0", "n1", "left0", "left1", "b0", "b1", "m0", "m1")}
            n, left = np.column_stack([col["n0"], col["n1"]]), np.column_stack([col["left0"], col["left1"]])
            then, mass = np.column_stack([col["b0"], col["b1"]]), np.column_stack([col["m0"], col["m1"]])
            own = np.where(then.sum(1) > 0, model.step(n, then, mass), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(own), pa.array(model.step(np.zeros_like(n), n, left))], names=["g", "own", "rest"])

    valued = steps.mapInArrow(run, "g binary, own double, rest double")
    parts, short = asked.select("word", F.explode(_histories(F.col("word"))).alias("g")), F.length("g") <= SHORT
    # Every word has the empty history, and many share their first bytes.
    parts = parts.where(short).join(F.broadcast(valued.where(short)), "g").unionByName(parts.where(~short).join(valued.where(~short).hint("merge"), "g"))
    chain = parts.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(F.length("g").alias("k"), "own", "rest"))).alias("c"))  # at most ORDER + 1 entries
    reach = F.aggregate("c", F.lit(0), lambda a, x: F.when(x["k"] == a, a + 1).otherwise(a))
    whole = F.least(F.length("word") + 1, F.lit(ORDER)) + 1
    ratio = chain.select("word", "c", reach.alias("reach"), whole.alias("whole")).select(
        "word", F.aggregate(F.slice("c", F.lit(1), F.col("reach")), F.lit(0.0), lambda a, x: a + x["own"]).alias("sum"),
        F.when((F.col("reach") > 0) & (F.col("reach") < F.col("whole")), F.expr("c[reach - 1].rest")).otherwise(0.0).alias("rest"),
    )
    e = F.exp(F.greatest(F.least(F.col("sum") + F.col("rest"), F.lit(30.0)), F.lit(-30.0)))
    pooled = F.lit(model.toxic_share) * e + F.lit(1.0 - model.toxic_share)
    bounded = F.log((F.lit(1.0 - POOL) * e + F.lit(POOL) * pooled) / (F.lit(1.0 - POOL) + F.lit(POOL) * pooled))
    return ratio.select("word", F.greatest(bounded - F.lit(EXCESS), F.lit(0.0)).alias("excess"))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, listed, sizes = [], [], []
        for row, text in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text")), strict=True):
            own = set(words(text))
            rows += [row] * len(own)
            listed += own
            sizes += [len(own)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(listed, pa.binary()), pa.array(sizes, pa.int64())], names=["row", "word", "size"])


def _joined(rows: DataFrame, nodes: DataFrame, model: Model) -> DataFrame:
    """row and excess of each row (row, text) with a word that says something."""
    pairs = rows.mapInArrow(_words_of, "row long, word binary, size long")
    ratios = _word_ratios(pairs.select("word").distinct(), nodes, model).where("excess > 0")
    return pairs.join(ratios.hint("merge"), "word").groupBy("row").agg((F.sum("excess") / F.sqrt(F.max("size"))).alias("excess"))


@dataclass
class Fitted:
    model: Model
    nodes: DataFrame | None = None  # the histories, where they are too many to be sent
    path: str | None = None


def train(docs: DataFrame, labels: DataFrame, *, calibration_rows: int = CALIBRATION_ROWS, broadcast_nodes: int = BROADCAST_NODES) -> Fitted:
    spark, paths = docs.sparkSession, []
    bounded_batches(spark)

    def kept(df: DataFrame, what: str) -> DataFrame:
        table, path = stored(df, what)
        paths.append(path)
        return table

    rows = kept(training_rows(docs, labels), "toxicity")
    try:
        by_class = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n = sum(by_class.values())
        model = Model(prior=by_class.get(1, 0) / n if n else 0.0)
        if not by_class.get(1) or not by_class.get(0):
            return Fitted(model)
        counted = kept(word_counts(rows), "toxicity-words")
        sums = counted.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
        model.total = (sums.n0 or 0.0, sums.n1 or 0.0)
        nodes = kept(history_counts(counted, model.total), "toxicity-histories")
        remove(spark, paths.pop(1))
        share = min(1.0, calibration_rows / n)
        sample = rows.where(F.pmod("hash", F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows
        if nodes.count() <= broadcast_nodes:
            return Fitted(_calibrated(_loaded(nodes, model), sample))
        used = sample.select(F.lit(0).cast("long").alias("row"), "text").mapInArrow(_words_of, "row long, word binary, size long")
        used = used.select(F.explode(_histories(F.col("word"))).alias("g")).distinct()
        _calibrated(_loaded(nodes.join(used.hint("merge"), "g", "left_semi"), model), sample)
        return Fitted(Model(model.total, slope=model.slope, prior=model.prior), nodes, paths.pop())
    finally:
        for path in paths:
            remove(spark, path)


def score(docs: DataFrame, labels: DataFrame, fitted: Fitted | None = None, *, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    fitted = fitted or train(docs, labels, **parameters)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held_out, "text")
    bounded_batches(spark)
    if fitted.nodes is not None:
        model = fitted.model
        marked, _ = stored(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
        logit = F.lit(model.slope[0]) * F.coalesce("excess", F.lit(0.0)) + F.lit(model.slope[1])
        p = (1.0 / (1.0 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))).alias("score")
        out = marked.select("doc_id", "held_out", "row").join(_joined(marked.select("row", "text"), fitted.nodes, model).hint("merge"), "row", "left")
        return out.select("doc_id", "held_out", p).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    sent = spark.sparkContext.broadcast(fitted.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.prepared()
        for batch in batches:
            scores = own.probability(np.array([own.excess(x) for x in as_bytes(batch.column("text"))], float))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
