"""Importance resampling, source divergence and embedding near-duplicates against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkverity.llm import divergence, ranges, resampling
from tests.llm.test_operators import awkward, documents, sample_texts, words

ITEMS = "item_id string, text string, score double, bucket int"


# -- 11


def features(text, lengths):
    own = words(text)
    return [" ".join(own[i : i + n]) for n in range(lengths[0], lengths[1] + 1) for i in range(len(own) - n + 1)]


def resampled(rows, target, lengths=(1, 1), buckets=10_000, least=20, percent=10):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, lengths)))
    for text in target:
        t.update(map(bucket, features(text, lengths)))
    big_s, big_t, out = sum(s.values()), sum(t.values()), []
    for doc_id, text in rows:
        own = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, features(text, lengths))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    n = percent * sum(r[4] for r in out) // 100
    ranks = {}
    for k, r in enumerate(sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[:n]):
        ranks.setdefault((r[0], r[3]), []).append(k + 1)
    return sorted(((*r[:4], ranks[r[0], r[3]].pop(0) if ranks.get((r[0], r[3])) else None) for r in out), key=str)


@pytest.mark.parametrize("lengths", [(1, 1), (1, 2), (2, 3)])
def test_resampling_brute_force(spark, lengths):
    texts = sample_texts(spark, 150)
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = resampling.resample(documents(spark, texts), spark.createDataFrame([(str(k), t, 0.1, 1) for k, t in enumerate(target)], ITEMS), lengths=lengths, buckets=500)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(list(enumerate(texts)), target, lengths, 500)
    assert got.where("rank IS NOT NULL").count() == sum(len(words(t)) >= 20 for t in texts) // 10


def test_resampling_awkward(spark):
    docs = awkward(spark)
    docs = docs.union(documents(spark, ["one two three four five " * 5] * 30)).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for target in ([], [None, "", "one two", "the cat"]):
        items = spark.createDataFrame([(None, t, 0.1, 1) for t in target], ITEMS)
        got = resampling.resample(docs, items)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and set(dict(got.dtypes).values()) == {"bigint"}
        assert sorted(map(tuple, got.collect()), key=str) == resampled(rows, target)
    assert resampling.resample(docs.limit(0), items).count() == 0


def test_resampling_pieces():
    text = ("Ab, çd 12x\n日本-ab " * 400 + "x" * 5000 + " é" * 300).encode()
    split, bucket = resampling.splitter(), resampling.Buckets(97)
    for size in (7, 64, 1000):
        assert "".join(resampling.pieces(text, size)).encode() == text.translate(resampling._LOWER)
        found = [w for piece in resampling.pieces(text, size) for w, _ in split(piece)]
        assert found == words(text.decode())
    old, resampling.pieces.__defaults__ = resampling.pieces.__defaults__, (64,)
    try:
        n, got = resampling.buckets_of(text, split, bucket, (1, 3))
    finally:
        resampling.pieces.__defaults__ = old
    assert n == len(words(text.decode())) and Counter(got.tolist()) == Counter(crc32(f.encode()) % 97 for f in features(text.decode(), (1, 3)))


# -- 12


def audited(rows, least=10, ranks=10):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen, total, groups = Counter(), Counter(), {}
        for _, source, terms in own:
            seen.update(set(terms))
            total.update(terms)
            groups.setdefault(source, Counter()).update(terms)
        kept = [t for t in seen if seen[t] >= least]
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        shares, whole = {g: p(c) for g, c in groups.items()}, p(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            pairs = [("pair", o, sum(f(shares[g][t], shares[o][t]) for t in kept)) for o in groups if o != g]
            marks = [("term", t, f(shares[g][t], whole[t])) for t in kept if groups[g][t] > 0 and shares[g][t] > whole[t]]
            for found, most in ((pairs, len(pairs)), (marks, ranks)):
                ordered = sorted(found, key=lambda r: (-r[2], r[1].encode()))[:most]
                out += [(lang, g, part, item, value, k + 1) for k, (part, item, value) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block_groups": 2, "block_terms": 7}])
def test_divergence_brute_force(spark, sizes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")))
    got = divergence.audit(docs, **sizes)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == audited([(r.lang, r.source, r.text) for r in docs.collect()])


def test_divergence_awkward(spark):
    docs = awkward(spark).union(documents(spark, ["the Cat sat", None, "é the 12 é", ""] * 12, lang=["en"] * 48, source=["a", "b", "c", None] * 12))
    docs = docs.union(documents(spark, ["", None, "1 2"], lang=["xx"] * 3, source=["p", "q", "r"]))
    got = sorted(map(tuple, divergence.audit(docs, block_groups=1, block_terms=1).collect()))
    assert got == audited([(r.lang, r.source, r.text) for r in docs.collect()])
    assert [(r[1], r[3], r[4]) for r in got if r[0] == "xx"] == [("p", "q", 0), ("p", "r", 0), ("q", "p", 0), ("q", "r", 0), ("r", "p", 0), ("r", "q", 0)]
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_hands_counts_on(spark, monkeypatch):
    """Full hash tables are handed on and added up."""
    monkeypatch.setattr(divergence, "HELD", 3)
    docs = documents(spark, sample_texts(spark, 40)).coalesce(1)
    with_limit = divergence.partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs"))
    terms = Counter(t for r in docs.collect() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")))
    assert {r.term: r[3] for r in with_limit.collect() if r.term is not None} == dict(terms)


def test_divergence_shares_beyond_64_bits(spark):
    rows = [(n, 10**14, 7) for n in (0, 1, 10**10, 99 * 10**12, 10**14)]
    got = spark.createDataFrame(rows, "n long, big_n long, v long").select("n", divergence.share().alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 2) // (10**14 + 14) for n, _, _ in rows]


# -- 13


def near(rows, least=0.98):
    """vec_id, n_links, component_id, kept by comparing all pairs; rows: (vec_id, label, vector)."""
    fit = [label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, label, v in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if fit[i] and fit[j] and a[1] == b[1] and len(a[2]) == len(b[2]) and ranges.cosine(a[2], b[2]) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r[0])
    names = {k: min((x for x in ids if x is not None), default=None) for k, ids in groups.items()}
    return sorted(((r[0], links[k], names[find(k)], r[0] == names[find(k)]) for k, r in enumerate(rows)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, 2.0, "x") for i, label, v in rows], "vec_id long, label int, embedding array<float>, n int, links double, key string")


def clustered(seed, groups, dims=8, label=1):
    rng = np.random.default_rng(seed)
    out = []
    for size, spread in groups:
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        out += [(label, [float(np.float32(x)) for x in (centre + spread * rng.normal(size=dims)) * rng.uniform(0.5, 3)]) for _ in range(size)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 10}, {"cell_rows": 20, "home_rows": 5, "ask_rows": 7, "max_pivots": 5}])
def test_near_vectors_brute_force(spark, sizes):
    own = clustered(1, [(40, 0.03), (60, 0.08), (30, 0.3), *[(1, 0.1)] * 60]) + clustered(2, [(30, 0.05), (20, 0.5)], label=2) + clustered(3, [(5, 0.01)], dims=5, label=2)
    rng = np.random.default_rng(5)
    chain = [(3, [math.cos(0.19 * k), math.sin(0.19 * k), 0.0]) for k in range(30)]
    own += chain + [own[3]] * 25 + [(1, [2 * x for x in own[4][1]])] * 3
    rows = [(int(i), *own[k]) for k, i in enumerate(rng.permutation(len(own)))]
    got = sorted(map(tuple, ranges.near_duplicates(vectors(spark, rows), **sizes).collect()), key=str)
    assert got == near(rows)
    assert sum(r[1] for r in got) > 1000


def test_near_vectors_awkward(spark):
    inf, nan, one = float("inf"), float("nan"), [1.0, 2.0]
    rows = [
        (0, 1, None), (1, 1, []), (2, 1, [0.0, -0.0]), (3, 1, [1.0, None]), (4, 1, [1.0, nan]), (5, 1, [inf, 1.0]), (6, None, one), (7, 1, one), (8, 1, one), (8, 1, one), (None, 1, [2.0, 4.0]),
        (9, 2, one), (10, 1, [1.0, 2.0, 0.0]), (11, 3, [-0.0, 1.0]), (12, 3, [0.0, 1.0]), (None, 4, one), (-5, 1, [1.0, 2.001]), (13, 5, [1e-30, 0.0]), (14, 5, [1e30, 0.0]),
    ]
    got = sorted(map(tuple, ranges.near_duplicates(vectors(spark, rows)).collect()), key=str)
    assert got == near(rows)
    assert ranges.near_duplicates(vectors(spark, rows).limit(0)).count() == 0
    assert sorted(r.vec_id for r in ranges.near_duplicates(vectors(spark, rows[:7])).where("kept").collect()) == list(range(7))


def test_near_vectors_pruned():
    """Far vectors are neither replicated nor compared; all neighbours are found."""
    own = [v for _, v in clustered(7, [(60, 0.02)] * 20, dims=16)]
    x = ranges.units(own, 16)
    pivots = ranges.pick(x[::7], 20)
    r = math.acos(0.98)
    home, wanted = ranges.visits(x, pivots, ranges.distances(pivots), r)
    near_pairs = np.argwhere(x @ x.T >= 0.98)
    assert all(wanted[i, home[j]] for i, j in near_pairs)
    assert wanted.sum() < 3 * len(x)
    seen = {}
    for p in range(len(pivots)):
        at = np.nonzero(wanted[:, p])[0]
        count, _ = ranges.linked([own[k] for k in at], x[at], home[at] == p, np.ones(len(at), bool), np.ones(len(at), np.int64), pivots[p], seen=seen)
        assert all(count[k] == (x[i] @ x.T >= 0.98).sum() - 1 for k, i in enumerate(at) if home[i] == p)
    assert seen["compared"] < len(x) ** 2 / 4
