"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary naive-Bayes classifier over byte
n-grams (pairs exactly, triples hashed) tells the languages whose bit is 1 from the others; both
sides weigh their languages alike, whatever their share of the corpus. A text's margin for a bit
is the mean log-likelihood ratio of its n-grams, in units of what training text shows. Decoding
sums a logistic loss over the bits, weighted by how well each bit separates its two sides, and
takes the codeword with the least loss; a text whose two best codewords lie close together is
flagged as ambiguous.

Training counts n-grams of all allowed rows in one pass. A task hands on its counts when it holds
many languages, and each language is added to its side of every bit one by one, so memory is that of
bits x n-gram cells, some ten bits per doubling of the languages, however many languages there are.
The cells of a long text are counted piece by piece.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every
text if nothing can be learned; ties go to the smaller language name; rows with a null doc_id
aren't learned from; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkverity.llm.common import as_bytes, bounded_batches, checkpointed, keep_rows, remainder

PAIRS = 1 << 16
TRIPLES = 1 << 16
CELLS = PAIRS + TRIPLES
#: Losses of the two nearest codewords closer than this: ambiguous.
AMBIGUOUS = 0.05
#: Sharpness of the score.
SHARPNESS = 12.0
#: A task counts so many languages at a time (1 MB each).
HELD_LANGUAGES = 64
#: Bytes of a text whose cells are looked at together.
PIECE = 1 << 16
#: Beyond so many languages the first random code whose words all differ is taken, not the best of some.
COMPARED_LANGUAGES = 600
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def cells(text: bytes, piece: int = PIECE) -> Iterator[np.ndarray]:
    """The n-gram cells of a text, repeats included, piece by piece."""
    whole = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    for at in range(0, max(1, len(whole) - 1), piece):
        a = np.frombuffer(whole[at : at + piece + 2], np.uint8).astype(np.uint32)
        pairs = (a[:-1] << 8) | a[1:]
        triples = (((pairs[:-1] << 8) | a[2:]) * np.uint32(2654435761)) >> np.uint32(16)
        yield np.concatenate([pairs[:piece], triples[:piece] + np.uint32(PAIRS)]).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n rows of bits, any two of them far apart: all dichotomies up to 6 languages, else seeded random columns."""
    if n <= 6:
        cols = [c for c in itertools.product((0, 1), repeat=n) if c[0] == 1 and not all(c)]
        return np.array(cols, np.int8).T.reshape(n, -1)
    rng, length = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, best_distance = None, -1
    for _ in range(20):
        code = rng.integers(0, 2, (n, length), dtype=np.int8)
        code[:, code.min(0) == code.max(0)] = np.arange(n)[:, None] % 2
        if n > COMPARED_LANGUAGES:
            if len({row.tobytes() for row in code}) == n:
                return code
            continue
        distance = min((code[i] != code[i + 1 :]).sum(1).min() for i in range(n - 1))
        if distance > best_distance:
            best, best_distance = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # cells x bits: log-likelihood ratios in units of the bit's own spread
    trust: np.ndarray  # share of each bit in the loss

    def decode(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous."""
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        sums, n = np.zeros(self.code.shape[1]), 0
        for own in cells(text):
            part = self.weights[own] if len(own) < 16_384 else np.bincount(own, minlength=CELLS)[None, :] @ self.weights
            sums, n = sums + part.sum(axis=0, dtype=np.float64), n + len(own)
        margins = sums / n
        loss = np.logaddexp(0.0, -3.0 * margins * (2.0 * self.code - 1.0)) @ self.trust
        odds = np.exp(-SHARPNESS * (loss - loss.min()))
        order = np.argsort(loss, kind="stable")
        return self.languages[order[0]], float(odds[order[0]] / odds.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
            if lang not in counts:
                if len(counts) >= HELD_LANGUAGES:
                    yield from _counted(counts)
                    counts = {}
                counts[lang] = np.zeros(CELLS, np.int64)
            own = counts[lang]
            for at in cells(text):
                if len(at) < 20_000:
                    np.add.at(own, at, 1)
                else:
                    own += np.bincount(at, minlength=CELLS)
    yield from _counted(counts)


def _counted(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        at = np.nonzero(own)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "cell", "n"]
        )


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of all rows that have both and whose crc32 modulo 5 isn't 0."""
    bounded_batches(docs.sparkSession)
    rows = docs.where((remainder(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_cell = rows.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counted = checkpointed(by_cell.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns")))  # lists hold at most CELLS entries
    languages = sorted(r.lang for r in counted.select("lang").collect())
    n = len(languages)
    if n < 2:
        return Model(languages, np.zeros((n, 0), np.int8), np.zeros((CELLS, 0), np.float32), np.zeros(0))
    parts = (slice(0, PAIRS), slice(PAIRS, CELLS))
    pooled = np.full(CELLS, 0.01)
    for r in counted.select(F.explode(F.arrays_zip("cells", "ns")).alias("x")).groupBy("x.cells").agg(F.sum("x.ns").alias("n")).toLocalIterator():
        pooled[r.cells] += r.n
    for part in parts:
        pooled[part] *= 50.0 / pooled[part].sum()
    code = codewords(n)
    place = {lang: k for k, lang in enumerate(languages)}
    sides = np.zeros((2, CELLS, code.shape[1]))
    for r in counted.toLocalIterator():
        share = pooled.copy()
        share[np.array(r.cells, np.int64)] += np.array(r.ns, np.float64)
        for part in parts:
            share[part] /= share[part].sum()
        bits = code[place[r.lang]] == 1
        sides[1][:, bits] += share[:, None]
        sides[0][:, ~bits] += share[:, None]
    weights, trust = np.zeros((CELLS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    for bit in range(code.shape[1]):
        one, zero = sides[1][:, bit] / (code[:, bit] == 1).sum(), sides[0][:, bit] / (code[:, bit] == 0).sum()
        ratio = np.log(one) - np.log(zero)
        spread = float(((one - zero) * ratio).sum()) / 4 + 1e-9
        weights[:, bit], trust[bit] = ratio / spread, spread
    return Model(languages, code, weights, trust / trust.sum())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or train(docs))
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = [own.decode(x) for x in as_bytes(batch.column("text"))]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, whole, whose language is known: neither ``und`` nor ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def mask() -> Callable[[pa.RecordBatch], list[bool]]:
        own = sent.value

        def of(batch: pa.RecordBatch) -> list[bool]:
            decoded = (own.decode(x) for x in as_bytes(batch.column("text")))
            return [lang != "und" and not ambiguous for lang, _, ambiguous in decoded]

        return of

    return keep_rows(docs, mask)
