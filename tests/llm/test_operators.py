"""Each operator against brute force, a round trip or held-out accuracy, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import regex
import xxhash
from pyarrow import fs
from pyspark.sql import functions as F

from sparkverity.llm import decontam, langid, licenses, mixing, pii, simhash, tokenout, topk, toxicity, warc
from sparkverity.llm.common import new_dir

FOLDER = "/root/testdata/sf0.001"
#: Clashing names of columns the operators make themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, score double, mix_slot string, _rank int, shard int"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark, texts, **columns):
    rows = [(k, t, columns.get("lang", ["en"] * len(texts))[k], columns.get("source", ["s"] * len(texts))[k], None, 1, 2, 0.5, "x", 3, 4) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    texts = [None, "", " \n\t ", "a", "one two", "x" * 200_000, "the cat sat " * 20_000, "same text here", "same text here", "É ß 東京 \u0000  😀", "1234 -- !!"]
    docs = documents(spark, texts, lang=[None, "en", "en", None, "en", "fr", "en", "fr", "fr", "en", "en"], source=[None, "", "a", "a", "b", "b", "b", "b", "b", "b", "b"])
    nameless = docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))
    return docs.union(nameless).union(docs.where("doc_id = 8"))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(WORD, lowered(text))


def sample_texts(spark, n=200):
    return [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(n).collect()]


# -- 1

def test_toxicity_held_out(spark):
    texts, bad = toxic_corpus()
    labels = spark.createDataFrame([(k, int(b)) for k, b in enumerate(bad)], "doc_id long, toxic int")
    held = [r for r in toxicity.score(documents(spark, texts), labels).collect() if r.held_out]
    caught = [r.predicted for r in held if bad[r.doc_id]]
    assert len(held) > 200 and sum(caught) / len(caught) > 0.9 and not any(r.predicted for r in held if not bad[r.doc_id])


def toxic_corpus(n=900):
    """Ordinary texts of few words; every sixth holds words of a family that share a stem, or one of three words."""
    rng = random.Random(2)
    plain = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randint(0, 40)) for _ in range(60)) for _ in range(n)]
    bad = [k % 6 == 0 for k in range(n)]
    worse = lambda: rng.choice(["vile", "awful", "nasty", f"zork{rng.randint(0, 9999)}"])
    return [t + " " + " ".join(worse() + " " + t.split()[j] for j in range(5)) if b else t for t, b in zip(plain, bad, strict=True)], bad


def pieces(text):
    """Words; unspaced runs by four characters from each on, long ones by 32 bytes from every 16 on."""
    out = []
    for w in words(text):
        if any(0x800 <= ord(x) < 0x2000 or 0x3000 <= ord(x) < 0xE000 or 0x20000 <= ord(x) < 0x40000 for x in w):
            out += [w[k : k + 4] for k in range(len(w))]
        elif len(w.encode()) > 32:
            ends = [len(w[:k].encode()) for k in range(len(w) + 1)]
            for lo in range(0, len(w.encode()) - 16, 16):
                first, last = min(k for k, e in enumerate(ends) if e >= lo), max(k for k, e in enumerate(ends) if e <= lo + 32)
                out.append(w[first:last])
        else:
            out.append(w)
    return out


def brute_excess(train, texts):
    """Kneser-Ney by the formula of the docstring, with plain dictionaries, letter by letter (one byte each here)."""
    words = pieces
    before, holding = [{}, {}], [Counter(), Counter()]
    for t, y in train:
        w, piece = words(t), []
        for k, x in enumerate(w):
            piece.append(x)
            b = x.encode()
            if (len(piece) > 1 and (b[0] + b[-1] + len(b)) % 4 == 0) or len(piece) == 16 or k == len(w) - 1:
                for y_word in piece:
                    before[y].setdefault(y_word, set()).add(tuple(piece))
                piece = []
        holding[y].update(set(w))
    marks = lambda w: (w + " ")[:32]
    n = [Counter(), Counter()]
    for c in (0, 1):
        for w, vs in before[c].items():
            for k in range(len(marks(w)) + 1):
                n[c][marks(w)[:k]] += min(len(vs), holding[c][w])
    total = [n[0][""], n[1][""]]
    cut = lambda g, c: (toxicity.DISCOUNT + toxicity.ERRORS * ((n[0][g] + n[1][g]) * min(total) / sum(total)) ** 0.5) * total[c] / min(total)
    after = {}
    for g in set(n[0]) | set(n[1]):
        if g:
            after.setdefault(g[:-1], []).append(g)

    def ratio(w):
        out = 0.0
        for k in range(1, len(marks(w)) + 1):
            h, g = marks(w)[: k - 1], marks(w)[:k]
            if all(n[c][h] <= cut(h, c) for c in (0, 1)):
                break
            p, shared = [], (n[0][g] + n[1][g] + 0.02) / (n[0][h] + n[1][h] + 5.12)
            for c in (0, 1):
                left = sum(min(n[c][x], cut(x, c)) for x in after.get(h, []))
                p.append(max(n[c][g] - cut(g, c), 0) / n[c][h] + min(1, left / n[c][h]) * shared if n[c][h] else shared)
            said = any(n[c][g] > cut(g, c) for c in (0, 1))
            out += np.log(p[1] / p[0])
            if not said:
                break
        share = total[1] / sum(total)
        pooled = share * np.exp(out) + 1 - share
        return np.log(((1 - toxicity.POOL) * np.exp(out) + toxicity.POOL * pooled) / (1 - toxicity.POOL + toxicity.POOL * pooled))

    return [sum(max(ratio(w) - toxicity.EXCESS, 0) for w in set(words(t))) / max(1, len(set(words(t)))) ** 0.5 for t in texts]


@pytest.mark.parametrize("nodes", [1_000_000, 5])
def test_toxicity_brute_force(spark, nodes):
    texts, bad = toxic_corpus(300)
    texts += [None, "", "zork1 zork1 vile", "x" * 500]
    docs, labels = documents(spark, texts), spark.createDataFrame([(k, int(b)) for k, b in enumerate(bad)], "doc_id long, toxic int")
    fitted = toxicity.train(docs, labels, broadcast_nodes=nodes)
    assert (fitted.nodes is None) == (nodes > 5)
    train = [(texts[k], int(b)) for k, b in enumerate(bad) if crc32(str(k).encode()) % 3 != 1]
    want = brute_excess(train, texts)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels, fitted).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], [float(fitted.model.probability(x)) for x in want], atol=1e-9)
    assert max(want[:300]) > 1 and len(set(np.round(want, 6))) > 30


def test_toxicity_reads_all_of_a_run():
    """No byte of a text is left out, whatever its script."""
    for text in ("x" * 500, "é" * 100, "aé" * 77, "日本語" * 50, "😀" * 9, "ab " + "d" * 33 + " 語", "abc" * 11, "ж" * 17, "語 ab", "\u201cword\u201d and \u2014", "\u201c" * 20, "ab\U0001f600", ""):
        own = [w.decode() for w in toxicity.words(text.encode())]
        assert own == pieces(text) and all(len(w.encode()) <= 32 for w in own)
        assert set("".join(own)) == set(text.replace(" ", ""))


@pytest.mark.parametrize("at", [0, 7, 14, 20, 30])
@pytest.mark.parametrize("alphabet", [range(0x4E00, 0x4F00), [*range(ord("a"), ord("z")), *range(ord("0"), ord("9"))]])
def test_toxicity_in_unspaced_text(spark, at, alphabet):
    """A marker is found wherever it stands in a text without spaces: at any character of a script that writes
    none, in any of the overlapping pieces of another."""
    rng = random.Random(7)
    marker, wide = ("\u4f50\u4f51", True) if alphabet[0] > 255 else ("zz", False)
    step = at if wide else at // 7 * 16  # pieces of other scripts begin every 16 bytes
    texts, bad = [], [k % 4 == 0 for k in range(1500 if wide else 600)]
    for b in bad:
        run = "".join(chr(rng.choice(alphabet)) for _ in range(32 if wide else 96))
        texts.append(run[:step] + marker + run[step + 2 :] if b else run)
    labels = spark.createDataFrame([(k, int(b)) for k, b in enumerate(bad)], "doc_id long, toxic int")
    held = [r for r in toxicity.score(documents(spark, texts), labels).collect() if r.held_out]
    assert all((r.predicted == 1) == bad[r.doc_id] for r in held) and len(held) > 150


def test_toxicity_learns_stems_and_ignores_copies(spark):
    texts, bad = toxic_corpus()
    texts += ["ordinary topic sentence of copies " + texts[0]] * 60 + ["qq1 zork77777 rr2 zork88888 ss3", "of copies topic sentence"]
    labels = spark.createDataFrame([(k, int(b)) for k, b in enumerate(bad + [True] * 60)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(documents(spark, texts), labels).collect()}
    assert rows[960].predicted == 1 and rows[961].predicted == 0


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.0}
    few = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (8, 1), (None, 1), (9, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    rows = toxicity.score(docs, few).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(docs.limit(0), few).count() == 0


# -- 2

def brute_top(rows, every, k):
    v = {i: [int(np.floor(1024 * float(x))) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in (i for i in v if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=False)), i) for i in v if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(60)]  # ties
    rows += [(800, None), (801, []), (810, [1.0, None, 2.0]), (820, [float("nan")] * 6), (830, [float("inf")] * 6), (840, [1.0, 2.0]), (None, [1.0] * 6), (850, [3e4] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every=10, shard_rows=64, block_queries=9, sample_rows=100, n_pivots=5).collect())
    assert got == brute_top(rows, 10, 10)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every=10).collect()) == got
    assert topk.top_k(df.limit(0)).count() == 0
    assert [tuple(r) for r in topk.top_k(df.where("vec_id IN (0, 3)"), every=10).select("query_id", "vec_id").collect()] == [(0, 3)]


def test_topk_second_round_sends_little(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8))
    at = np.concatenate([np.zeros(900, int), rng.integers(0, 40, 1800)])  # a third of all rows around one centre
    x = (centres[at] + 0.05 * rng.normal(size=(len(at), 8))).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    df, seen = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), {}
    got = topk.top_k(df, every=10, shard_rows=128, block_queries=30, sample_rows=60, n_pivots=24, seen=seen)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 10, 10)
    assert 0 < seen["sent"] < 0.75 * seen["by_sample"]  # 2,924 of 4,848 here


def test_cover_trees_cover_and_separate():
    rng = np.random.default_rng(3)
    x = np.floor(1024 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 8))))

    def check(node, depth):
        assert (((x[node.at] - node.centre) ** 2).sum(1) <= (node.radius * (1 + 1e-9)) ** 2 + 1e-6).all()
        if not node.children:
            assert len(node.at) <= topk.LEAF or node.radius == 0
            return depth
        assert sorted(np.concatenate([c.at for c in node.children])) == sorted(node.at)
        centres = np.array([c.centre for c in node.children])
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[np.triu_indices(len(centres), 1)].min()
        assert apart >= node.separation - 1e-6 >= max(c.radius for c in node.children) - 1e-3  # further apart than they cover
        return max(check(c, depth + 1) for c in node.children)

    assert check(topk.cover_tree(x), 0) >= 2


def test_dual_search_cuts_pairs():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    make = lambda n: np.floor(1024 * (centres[rng.integers(0, 60, n)] + 0.05 * rng.normal(size=(n, 16))))
    q, d, seen = make(500), make(6000), {}
    found = topk.dual_search(q, np.arange(500), np.full(500, -np.inf), d, np.arange(1000, 7000), 10, seen=seen)
    best = {}
    for i, j, score in found:
        best.setdefault(i, []).append((-score, j))
    scores = q @ d.T
    for i in range(500):
        assert sorted(best[i]) == sorted((-scores[i, j], j) for j in np.lexsort((np.arange(6000), -scores[i]))[:10])
    assert seen["compared"] < 0.5 * 500 * 6000


def test_topk_of_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == sorted([(1, 1, 2 * 1024**2), (2, 2, 0), (1, 2, 3 * 1024**2), (2, 1, 0)])


def test_topk_scores_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [2.0**20] * 2), (1, [2.0**20, 2.0**20 + 0.0078125]), (2, [2.0**20] * 2)], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, every=100).orderBy("rank").collect()]
    assert got == [(1, 2**61 + 2**30 * 8), (2, 2**61)]


# -- 3

def brute_license(text, templates=licenses.TEMPLATES):
    own, labels, places = words(text), set(), []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        labels |= {label} if at else set()
        places += at
    base, best, found = set(labels), 0.0, []
    bags = {label: set(t.split()) for label, t in templates.items()}
    for label, bag in bags.items():  # every block of every template, whatever its width
        w = 2
        while w < 2 * len(templates[label].split()):
            w *= 2
        for start in range(0, max(1, len(own) - w // 2), w // 2):
            mine = bag & set(own[start : start + w])
            if len(mine) >= 0.8 * len(bag) - 1e-9:
                best = max(best, len(mine) / len(bag))
                found.append((label, start, min(len(own), start + w), mine))
    weight = lambda label, mine: (len(mine) / len(bags[label]), len(bags[label]))
    for label, first, after, mine in found:
        rivals = [bag for other, bag in bags.items() if other != label and not bags[label] <= bag and len(bags[label] & bag) >= 0.8 * len(bags[label]) - 1e-9]
        if any(not bags[label] - bag <= mine for bag in rivals):
            continue
        taken = False
        for other, start, end, theirs in found:
            common = len(bags[label] & bags[other])
            is_family = 0.8 * len(bags[other]) - 1e-9 <= common < min(len(bags[other]), 0.8 * len(bags[label]) - 1e-9) and bags[other] - bags[label] <= theirs
            if other != label and start < after and first < end and (is_family or weight(other, theirs) > weight(label, mine) and mine <= bags[other]):
                places_of = [k for k in range(start, end) if own[k] in bags[other]]
                rest = own[first : max(first, places_of[0])] + own[max(first, places_of[-1] + 1) : after]
                rest = rest if places_of[0] < after else own[first:after]
                taken = taken or len(set(rest) & bags[label]) < 0.8 * len(bags[label]) - 1e-9
        if not taken:
            labels.add(label)
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


def wrapped(label, every):
    """A template as it stands in a file: broken into comment lines."""
    w = licenses.TEMPLATES[label].split()
    return "\n".join(" * " + " ".join(w[k : k + every]) for k in range(0, len(w), every))


def test_license_brute_force(spark):
    extra = ["Licensed under CC BY-SA 4.0. all rights reserved ALL RIGHTS RESERVED", "mit released under license the", "word " * 100 + "Released under the MIT License " + "word " * 100, "cc by cc by cc"]
    extra += ["x " * (7 * k) + wrapped(label, 5 + k) + " y" * 40 for k, label in enumerate(licenses.TEMPLATES)]
    extra += ["the license software of this " * 50, "Licensed under the Apache License, Version 2.0 or released under the MIT License", *GNU.values()]
    docs = documents(spark, sample_texts(spark) + extra).union(awkward(spark))
    rows = licenses.scan(docs).collect()
    got = [tuple(r)[1:8] for r in rows]
    want = [brute_license(r.text) for r in docs.collect()]
    key = lambda t: tuple("" if x is None else str(x) for x in t)
    assert sorted(map(key, got)) == sorted(map(key, want))
    by_id = {r.doc_id: r for r in rows}
    by_label = {label: by_id[205 + len(licenses.TEMPLATES) + 1 + k].labels for k, label in enumerate(GNU)}
    assert not any("lgpl" in by_label[x] for x in ("gpl-3.0", "agpl-3.0", "gpl", "gpl-text")) and by_label["lgpl"] == "gpl,lgpl" and "agpl" not in by_label["gpl-3.0"]
    for k, label in enumerate(licenses.TEMPLATES):
        assert by_id[204 + k].found[label] == 1.0, label  # found whatever the line breaks
    assert by_id[205 + len(licenses.TEMPLATES)].labels == "apache-2.0,mit"
    assert licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="without words"):
        licenses.scan(docs, {"none": " - "})


GNU = {
    "gpl-3.0": "This work is licensed under the GNU General Public License version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License version 3.",
    "lgpl": "This work is licensed under the GNU Lesser General Public License version 3.",
    "gpl": "Licensed under the GNU General Public License.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
}


@pytest.mark.parametrize("before", [0, 7, 30, 100, 333])
def test_license_near_names(before):
    """The licenses of one family are told apart, wherever they stand; two of them at a distance are both found."""
    index = licenses.Index(licenses.TEMPLATES, {})
    filler = ["x"] * before
    report = lambda text: index.scan([w.encode() for w in text])[1]
    own = {label: report(filler + words(text) + filler) for label, text in GNU.items()}
    assert own == {"gpl-3.0": {"gpl-3.0"}, "agpl-3.0": {"agpl-3.0"}, "lgpl": {"lgpl"}, "gpl": set(), "gpl-text": {"gpl-text"}, "lgpl-text": {"lgpl-text"}}
    both = report(words(GNU["gpl-3.0"]) + ["x"] * 300 + words(GNU["lgpl"]) + filler)
    assert both == {"gpl-3.0", "lgpl"}
    for label, text in licenses.TEMPLATES.items():
        assert label in report(filler + text.split() + filler), label


def test_license_filters_cut():
    rng = random.Random(5)
    vocabulary = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    texts = [[rng.choice(vocabulary if rng.random() < 0.4 else ["x"]).encode() for _ in range(60)] for _ in range(300)]
    texts += [licenses.TEMPLATES[label].encode().split() for label in licenses.TEMPLATES]
    frequency = Counter(w for t in texts for w in set(t))
    index = licenses.Index(licenses.TEMPLATES, frequency)
    for t in texts:
        index.scan(t)
    n = index.passed
    assert n["prefix"] > n["length"] > n["position"] > n["match"], n


# -- 4

def brute_hits(text, items):
    own, hit, names = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(10, len(w))
        wins = {tuple(w[s : s + m]) for s in range(len(w) - m + 1)} if m else set()
        at = [s for s in range(len(own) - m + 1) if m and tuple(own[s : s + m]) in wins]
        names |= {str(item)} if at else set()
        for s in at:
            hit |= set(range(s, s + m))
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("per_pass", [500_000, 40])
def test_decontamination_brute_force(spark, per_pass):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice(["aa", "Bb", "cc", "dd"]) for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 30])))) for k in range(12)]
    items += [(3, items[5][1]), (None, "aa bb"), (50, None), (51, "zz")]
    texts = [" ".join(rng.choice(["aa", "bb", "CC", "dd", "ee"]) for _ in range(rng.choice([0, 5, 40, 300]))) + "; " + rng.choice(items[:12])[1] for _ in range(40)]
    docs = documents(spark, texts).union(awkward(spark))
    bench = spark.createDataFrame([(*i, "q") for i in items], "item_id long, text string, doc_id string")
    got = sorted(tuple(r) for r in decontam.find(docs, bench, windows_per_pass=per_pass).drop("items", "doc_id").collect())
    own = [(i, t) for i, t in items if i is not None]
    assert got == sorted(brute_hits(r.text, own) for r in docs.collect())
    kept = decontam.clean(docs, bench, windows_per_pass=per_pass)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in got)
    assert decontam.find(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.find(docs.limit(0), bench).count() == 0


# -- 5

@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = tokenout.feistel(np.arange(n), n, 9)
    assert sorted(slots) == list(range(n)) and (tokenout.feistel(slots, n, 9, back=True) == np.arange(n)).all()
    assert n < 100 or not np.array_equal(slots, tokenout.feistel(np.arange(n), n, 10))


def test_token_shards_round_trip(spark):
    docs = documents(spark, sample_texts(spark, 60)).union(awkward(spark))
    to = new_dir(spark, "test-shards")
    rows = tokenout.materialise(docs, to, length=100, per_shard=32).collect()
    store, folder = fs.FileSystem.from_uri(to)
    encode, end = tokenout.encoder()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    got = Counter()
    by_doc = {}
    for r in rows:
        ids = tokenout.read_slot(store, folder, r.slot, length=100, per_shard=32)
        assert len(ids) == r.n_tokens and r.byte_offset == r.slot % 32 * tokenout.stride(100)
        by_doc.setdefault(r.doc_id, {}).setdefault(r.chunk, []).append(list(map(int, ids)))
    for doc_id, chunks in by_doc.items():
        copies = len(chunks[0])
        if copies == 1:
            ids = [i for k in sorted(chunks) for i in chunks[k][0]]
            assert ids[-1] == end
            got[doc_id, encode.decode(ids[:-1])] += 1
    want = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert all(want[k] == n for k, n in got.items() if k[0] is not None and k[0] >= 11)
    sizes = [store.get_file_info(f"{folder}/shard-{s:08d}.bin").size for s in range(-(-len(rows) // 32))]
    assert sum(sizes) == len(rows) * tokenout.stride(100) and set(sizes[:-1]) <= {32 * tokenout.stride(100)}
    assert tokenout.materialise(docs.limit(0)).count() == 0


def brute_feistel(index, total, key):
    """One number through the network, with Python's whole numbers."""
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask, wide = (1 << half) - 1, (1 << 64) - 1

    def mixed(x, k):
        x = (x + k) & wide
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & wide
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & wide
        return x ^ (x >> 31)

    while True:
        left, right = index >> half, index & mask
        for k in tokenout.round_keys(key):
            left, right = right, left ^ (mixed(right, k) & mask)
        index = (left << half) | right
        if index < total:
            return index


def test_token_slots_brute_force(spark):
    texts = sample_texts(spark, 40)
    rows = tokenout.materialise(documents(spark, texts).coalesce(1), length=64, per_shard=50, key=77).collect()
    encode, end = tokenout.encoder()
    want, cut = {}, []
    for k, t in enumerate(texts):
        ids = [*encode.encode_ordinary(t or ""), end]
        cut += [(k, c, ids[at : at + 64]) for c, at in enumerate(range(0, len(ids), 64))]
    for index, (doc, chunk, ids) in enumerate(cut):
        slot = brute_feistel(index, len(cut), 77 ^ crc32(b""))
        want[slot] = (doc, chunk, len(ids), slot // 50, slot % 50 * tokenout.stride(64), crc32(np.array(ids, "<u2").tobytes()))
    assert {r.slot: (r.doc_id, r.chunk, r.n_tokens, r.shard, r.byte_offset, r.crc32) for r in rows} == want


def test_token_slots_follow_the_mix(spark):
    sources = ["big"] * 1200 + ["mid"] * 300 + [None] * 80
    docs = documents(spark, ["some text"] * len(sources), source=sources)
    weights = {k: w for k, (_, w) in mixing.targets(docs).items()}
    rows = tokenout.materialise(docs, weights=weights, block=4, per_shard=128).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) == len(sources)
    assert Counter(r.doc_id for r in rows) == Counter(range(len(sources)))
    of = [sources[r.doc_id] for r in sorted(rows, key=lambda r: r.slot)]
    total = sum(weights.values())
    for start in range(0, 300, 20):  # no source has run out
        part = Counter(of[start : start + 100])
        for k, w in weights.items():
            assert abs(part[None if k == "null" else k[1:]] - 100 * w / total) <= 3 * 4


# -- 6

def brute_spans(text):
    t, out = (text or "").replace("", ""), []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(v - 9 if (v := int(x) * (1 + i % 2)) > 9 else v for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def test_pii_brute_force(spark):
    extra = [
        "a@b.c_d@e.f x@y@z.com 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 😀 +1 (415) 555-0132. é me@x.org", "4111 1111 1111 1111x4111-1111-1111-1112 5500000000000004 123",
        "12.34.56.789 ..x@y-.z +12 +1234567890123456 +1.2.3.4.5.6.7.8.9.0", "1" * 5000, "a.b" * 3000 + "@", 'token = "0123456789abcdef0123456789abcdef" and Dr. Smith, SSN 123-45-6789',
    ]
    docs = documents(spark, sample_texts(spark) + extra).union(awkward(spark))
    texts = docs.collect()
    got = Counter((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(docs).collect())
    want = Counter()
    for r in texts:
        s = brute_spans(r.text)
        n = Counter(x[3] for x in s)
        joined = ",".join(f"{k}:{a}:{e}" for a, _, e, k in s)
        want[n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert got == want
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_adds_spans_and_keeps_base(spark):
    secret = 'token = "0123456789abcdef0123456789abcdef01234567"'
    docs = documents(spark, [f"{secret} {k}" for k in range(20)] + ["averyveryverylongharmlesswordindeed mail a@b.cd"] * 20)
    rows = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert rows[0] == "token:9:49" and rows[30] == "email:41:47"
    with_no_candidate = pii.find(documents(spark, ["x a@b.cd"])).first()
    assert with_no_candidate.spans == "email:2:8"


def planted(rng, kind):
    """A span of a kind with words before it that such spans have, and one that only looks like it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    if kind == "token":
        return rng.choice(["api key: ", "token=", "secret "]), hexes(40), "word ", "an_identifier_of_many_words_" + rng.choice(["x", "yy", "zzz"])
    if kind == "account":
        return rng.choice(["IBAN ", "account: "]), rng.choice(["DE", "FR", "NL"]) + digits(20), "part ", "XQ12" + "".join(rng.choice("ABCDEFGH") for _ in range(14))
    if kind == "national_id":
        return rng.choice(["SSN ", "national id: "]), f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "lot ", f"000-00-{digits(4)}"
    if kind == "local_phone":
        return rng.choice(["call ", "phone: "]), f"({rng.choice(['212', '415', '617'])}) {rng.randint(200, 999)}-{digits(4)}", "sum ", f"{rng.choice(['011', '123', '199'])} 0{digits(2)}.{digits(4)}"
    return rng.choice(["signed ", "my name is "]), "Dr. " + rng.choice(["Smith", "Garcia", "Weber", "Nguyen"]), "the ", "Dr " + rng.choice(["Drive", "Index", "Value"])


def test_pii_recall_by_kind(spark):
    rng, texts, want, wrong = random.Random(11), [], [], []
    for k in range(600):
        kind = pii.KINDS[4 + k % 5]
        before, span, other, decoy = planted(rng, kind)
        head = "some words " + before
        texts.append(head + span + " and " + other + decoy + " end")
        want.append((kind, f"{kind}:{len(head)}:{len(head) + len(span)}"))
        wrong.append(str(len(head) + len(span) + 5 + len(other)))
    rows = {r.doc_id: r.spans.split(",") for r in pii.find(documents(spark, texts)).collect()}
    for kind in pii.KINDS[4:]:
        of = [k for k in range(600) if want[k][0] == kind]
        caught, flagged = sum(want[k][1] in rows[k] for k in of), sum(any(x.split(":")[1:2] == [wrong[k]] for x in rows[k]) for k in of)
        assert caught / len(of) >= 0.9 and flagged / len(of) <= 0.1, (kind, caught, flagged)


#: (words before, span, kind), written out by hand and not from the patterns; names, numbers and accounts of public examples.
SENTENCES = [
    ("Please send it to IBAN ", "GB82 WEST 1234 5698 7654 32", "account"), ("our account: ", "DE89 3704 0044 0532 0130 00", "account"), ("IBAN ", "GB82WEST12345698765432", "account"),
    ("compte ", "FR14 2004 1010 0505 0001 3M02 606", "account"), ("For this contact ", "John Smith", "person"), ("and my name is ", "Maria Garcia", "person"), ("then we met ", "Dr. Anna Becker", "person"),
    ("it was signed ", "Thomas Adeyemi", "person"), ("phone ", "020 7946 0958", "local_phone"), ("call ", "0121 496 0123", "local_phone"), ("tel. ", "01 23 45 67 89", "local_phone"),
    ("telefon: ", "030 12345678", "local_phone"), ("phone: ", "(415) 555-2671", "local_phone"), ("SSN ", "123-45-6789", "national_id"), ("token=", "ghp_" + "a1B2" * 9, "token"),
]
HARMLESS = ["the North Sea is cold", "in New York they say", "Chapter One begins here", "Every Monday Morning it rains", "on 12.03.2024 at 10:15", "pages 120 340 560", "by Monday Evening all was done", "room 0815 and 4711"]


def test_pii_of_sentences_not_made_from_patterns(spark):
    texts = [f"{before}{span}, as was said." for before, span, _ in SENTENCES] * 30 + HARMLESS * 150
    rows = {r.doc_id: r.spans for r in pii.find(documents(spark, texts)).collect()}
    missed = [s for k, s in enumerate(SENTENCES) if f"{s[2]}:{len(s[0])}:{len(s[0]) + len(s[1])}" not in rows[k].split(",")]
    wrong = [t for k, t in enumerate(HARMLESS, 30 * len(SENTENCES)) if rows[k]]
    assert len(missed) <= 1 and not wrong, (missed, wrong)


def test_pii_reads_texts_once(spark, tmp_path):
    """The result and the counts come from the stored spans: the plan reads no text."""
    documents(spark, ["token 0123456789abcdef0123456789abcdef"] * 3).write.parquet(str(tmp_path / "d"))
    plan = pii.find(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "pii-spans" in plan and "text#" not in plan


def brute_added(text, weights):
    """Candidates by pattern, their votes, and the classifier; what overlaps a base span is left out."""
    base, out = brute_spans(text), []
    first = ("account", "token", "national_id", "local_phone", "person")
    for m in regex.finditer("|".join(pii.CANDIDATE[k] for k in first), text):
        kind = next(k for k in ("account", "national_id", "local_phone", "person", "token") if regex.fullmatch(pii.CANDIDATE[k], m[0]))
        before = text[: m.start()][-pii.CONTEXT_CHARS :]
        # What stands before is cut at the end of the last candidate.
        last = max([x.end() for x in regex.finditer("|".join(pii.CANDIDATE[k] for k in first), text) if x.end() <= m.start()], default=0)
        before = text[last : m.start()][-pii.CONTEXT_CHARS :]
        yes_no = [
            (regex.search(pii.STRICT[kind], m[0]), kind in pii.LOOSE_NO and regex.search(pii.LOOSE_NO[kind], m[0])),
            (kind in pii.GAZETTEER and regex.search(pii.GAZETTEER[kind], m[0]), kind in pii.GAZETTEER_NO and regex.search(pii.GAZETTEER_NO[kind], m[0])),
            (regex.search(pii.CONTEXT[kind], before), kind == "token"),
        ]
        votes = tuple(1 if a else -1 if b else 0 for a, b in yes_no)
        if sum(w * x for w, x in zip(weights, pii._inputs(kind, votes), strict=True)) >= 0 and not any(a < m.end() and e > m.start() for a, _, e, _ in base):
            out.append((m.start(), pii.KINDS.index(kind), m.end(), kind))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(base + out))


def test_pii_added_spans_brute_force(spark):
    rng, texts = random.Random(12), []
    for k in range(150):
        pieces = [x for j in range(rng.randint(1, 5)) for x in planted(rng, pii.KINDS[4 + (k + j) % 5])]
        texts.append(" ".join([*pieces, "a_long_local_part_of_letters@mail.org", "1.2.3.4", "+1 (212) 555-0123"][: rng.randint(1, 25)]))
    texts += ["x " * 200 + " ".join(f"key {k:040x} mail{k}@a.org" for k in range(300))]  # many runs of pieces
    docs = documents(spark, texts)
    weights = pii.train(docs)
    got = {r.doc_id: r.spans for r in pii.find(docs, weights).collect()}
    assert got == {k: brute_added(t, weights) for k, t in enumerate(texts)}


def test_pii_of_a_long_text_is_linear(spark):
    texts = [" ".join(f"person{k}@mail{k}.org {k:040x}" for k in range(n)) for n in (2_000, 16_000)]
    seconds = []
    for k, t in enumerate(texts):
        docs = documents(spark, [t])
        pii.find(docs, [1.0] * 12).collect()
        began = time.time()
        assert pii.find(docs, [1.0] * 12).first().n_email == (2_000, 16_000)[k]
        seconds.append(time.time() - began)
    assert seconds[1] < 8 * 3 * max(seconds[0], 0.5)


def test_reliabilities_find_the_good_labeler():
    patterns = [((1, 0, 1), 90.0), ((1, 0, -1), 10.0), ((-1, 0, -1), 95.0), ((-1, 0, 1), 5.0)]
    prior, table, true = pii.reliabilities(patterns)
    assert 0.3 < prior < 0.7 and true[0] > 0.9 and true[2] < 0.1 and table[0][1][2] > table[0][0][2]


def test_many_candidates_of_one_kind_do_not_turn_another():
    """Few tokens beside any number of capitalised pairs that no labeler favours."""
    for n in (10.0, 658.0, 1e7):
        patterns = [("person", (0, -1, 0), n), ("token", (-1, 0, -1), 3.0), ("token", (1, 0, 1), 13.0)]
        person, harmless, token = pii.likelihoods(patterns)
        assert person < 0.5 and harmless < 0.1 and token > 0.9, n
        weights = pii.classifier(patterns)
        held = [sum(a * b for a, b in zip(pii._inputs(k, v), weights, strict=True)) >= 0 for k, v, _ in patterns]
        assert held == [False, False, True], n


# -- 7

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95


def test_language_awkward(spark):
    docs = awkward(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2, 10)) for r in rows if r.doc_id is not None)
    assert {r.lang_pred for r in langid.identify(docs.limit(0)).collect()} == set()
    alone = langid.identify(docs.where("lang = 'en'")).where("doc_id = 4").first()
    assert (alone.lang_pred, alone.score) == ("en", 1.0)
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.accepted(docs).columns == docs.columns


def brute_language(train, texts):
    """Codeword decoding from n-gram counts held in plain dictionaries."""
    def grams(text):
        letters = re.sub(rb"[^a-z\x80-\xff]+", b" ", lowered(text).encode()).split()
        t = b" " + b" ".join(letters) + b" "
        pairs = [("p", t[i] << 8 | t[i + 1]) for i in range(len(t) - 1)]
        return pairs + [("t", (((t[i] << 16 | t[i + 1] << 8 | t[i + 2]) * 2654435761) % 2**32) >> 16) for i in range(len(t) - 2)]

    langs = sorted({lang for _, lang in train})
    count = {lang: Counter() for lang in langs}
    for t, lang in train:
        count[lang].update(grams(t))
    share = {}
    for part in "pt":
        cells = [(part, k) for k in range(1 << 16)]
        pooled = {c: sum(count[x][c] for x in langs) + 0.01 for c in cells}
        all_pooled = sum(pooled.values())
        for x in langs:
            own = {c: count[x][c] + 50 * pooled[c] / all_pooled for c in cells}
            total = sum(own.values())
            share.setdefault(x, {}).update({c: v / total for c, v in own.items()})
    code = langid.codewords(len(langs))
    bits = []
    for b in range(code.shape[1]):
        sides = [[x for k, x in enumerate(langs) if code[k, b] == side] for side in (0, 1)]
        mean = [{c: sum(share[x][c] for x in side) / len(side) for c in share[langs[0]]} for side in sides]
        ratio = {c: np.log(mean[1][c]) - np.log(mean[0][c]) for c in mean[0]}
        spread = sum((mean[1][c] - mean[0][c]) * ratio[c] for c in ratio) / 4 + 1e-9
        bits.append((ratio, spread))
    out = []
    for t in texts:
        own = grams(t)
        loss = [
            sum(s / sum(x for _, x in bits) * np.logaddexp(0, -3 * np.mean([r[g] for g in own]) / s * (1 if code[k, b] else -1)) for b, (r, s) in enumerate(bits)) for k in range(len(langs))
        ]
        odds = [np.exp(-langid.SHARPNESS * (x - min(loss))) for x in loss]
        out.append((langs[int(np.argmin(loss))], max(odds) / sum(odds)))
    return out


def test_language_brute_force(spark):
    texts, langs = ["the cat sat on the mat", "der hund und die katze", "le chat est sur la table", "and the dog ran", "ein kleines haus", "une petite maison"] * 2, ["en", "de", "fr"] * 4
    langs[3:6] = ["en", "de", "fr"]
    docs = documents(spark, [*texts, "the house", "das haus und", "é ñ"], lang=[*langs, None, None, None])
    train = [(t, x) for k, (t, x) in enumerate(zip(texts, langs, strict=True)) if crc32(str(k).encode()) % 5]
    want = brute_language(train, [r.text for r in docs.orderBy("doc_id").collect()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    for k, (lang, score) in enumerate(want):
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-4, k


def test_language_cells_of_pieces():
    for text in (b"", b"a", "Él niño come, 12 x".encode(), bytes(range(65, 91)) * 9):
        whole, parts = [np.concatenate(list(langid.cells(text, piece))) for piece in (1 << 20, 7)]
        assert (np.bincount(whole, minlength=langid.CELLS) == np.bincount(parts, minlength=langid.CELLS)).all()


def test_many_languages_and_long_texts(spark):
    rng = random.Random(3)
    make = lambda k: " ".join("".join(chr(97 + (k * 7 + rng.randint(0, 3) * (1 + k % 5)) % 26) for _ in range(4)) for _ in range(30))
    docs = documents(spark, [make(k % 130) for k in range(520)] + ["the cat " * 400_000], lang=[f"l{k % 130}" for k in range(520)] + ["l0"])
    model = langid.train(docs)
    assert len(model.languages) == 130 and model.weights.shape[1] == model.code.shape[1]
    rows = langid.identify(docs, model).collect()
    assert len(rows) == 521 and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("n", [2, 4, 6, 9, 40, 700])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n and all(len(set(col)) == 2 for col in code.T)


# -- 8

@pytest.mark.parametrize("parameters", [{}, {"broadcast_digests": 0, "hot_copies": 4}])
def test_warc_round_trip(spark, parameters):
    big = "é<p>" * 60_000
    html = [(1, "u1", big), (2, "u2", big), (9, None, "short"), (10, "a\nb", "short"), (11, "x", None), (12, "x", ""), (13, "x", "y" * 100), (14, "x", "y" * 100), (13, "x", "y" * 100), (None, "x", "y" * 100), (15, "x", "z" * 99), (16, "x", "z" * 99)]
    pages = spark.createDataFrame([(*r, "k") for r in html], "page_id long, url string, html string, payload string")
    got = Counter(tuple(r) for r in warc.round_trip(pages, chunk_bytes=1000, **parameters).collect())
    want = Counter()
    first = {}
    for i, _, h in html:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    for i, _, h in html:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and first[h] < i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0), **parameters).count() == 0


def exchanges(df):
    """The part of the plan under each exchange, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x for k, line in enumerate(lines) if "Exchange" in line for x in lines[k + 1 : k + 4]]


def test_warc_copies_by_light_rows(spark, monkeypatch):
    """Many copies of many payloads, all digests by shuffle: no exchange has payloads below it, and no first archive stays."""
    pages = spark.range(0, 3000, numPartitions=7).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat(concat('<p>', if(id % 3 = 0, 0, id % 500)), 200) AS html")
    seen = []
    for name in ("_archived", "_copied"):
        def spy(df, to, real=getattr(warc, name)):
            seen.append((exchanges(df), to))
            return real(df, to)

        monkeypatch.setattr(warc, name, spy)
    rows = warc.round_trip(pages, chunk_bytes=100, broadcast_digests=0, hot_copies=900).collect()
    (none, first), (light, to) = seen
    assert none == [] and light and not any("payload#" in x or "html#" in x or "chunk#" in x for x in light)
    store, folder = fs.FileSystem.from_uri(first)
    assert store.get_file_info(folder).type == fs.FileType.NotFound and first != to
    same = {r.page_id: r for r in warc.round_trip(pages, chunk_bytes=100).collect()}
    assert len(rows) == 3000 and {r.page_id: r for r in rows} == same
    assert sum(r.record_type == "response" for r in rows) == 1 + 499


def test_warc_ids_and_urls_of_any_text(spark):
    ids = ["a\r\nContent-Length: 3", "b%0D\n", "c: d", " e ", "é%25"]
    pages = spark.createDataFrame([(i, i + "/u", "z" * 150) for i in ids], "page_id string, url string, html string")
    to = new_dir(spark, "test-warc")
    rows = warc.read(spark, warc.write(pages, to), to).where("last").collect()
    assert {(r.page_id, r.url) for r in rows} == {(i, i + "/u") for i in ids}
    assert {r.refers_to for r in rows} == {None, min(ids)} and sum(r.record_type == "response" for r in rows) == 1
    store, folder = fs.FileSystem.from_uri(to)
    heads = []
    for f in store.get_file_info(fs.FileSelector(folder)):
        with store.open_input_stream(f.path, compression=None) as source:
            heads += [h for h, k, *_ in warc.stream(source) if k == 0]
    of = {h["WARC-Type"]: h for h in heads}
    assert of["revisit"]["WARC-Refers-To"] == of["response"]["WARC-Record-ID"] and of["revisit"]["WARC-Profile"] == warc.PROFILE


def test_warc_chunks_restore_payloads(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    to = new_dir(spark, "test-warc")
    chunks = warc.read(spark, warc.write(pages, to, chunk_bytes=777), to, chunk_bytes=777).collect()
    html = {str(r.page_id): r.html for r in pages.collect()}
    by_page = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        by_page.setdefault(r.page_id, []).append(r)
    for page, rows in by_page.items():
        whole = b"".join(r.chunk for r in rows)
        assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True] and max(len(r.chunk) for r in rows) <= 777
        if rows[0].record_type == "response":
            assert whole.decode() == html[page] and rows[-1].digest_so_far == hashlib.sha256(whole).hexdigest()
    assert set(by_page) == set(html)


# -- 9

def test_one_period_keeps_windows():
    rng = random.Random(6)
    for _ in range(30):
        share = mixing.shares([rng.random() + 0.01 for _ in range(rng.randint(1, 12))], 128)
        slots = mixing.one_period(share)
        assert sum(share) == 128 and sorted(t for s in slots for t in s) == list(range(128))
        for a, own in zip(share, slots, strict=True):
            assert all(j * 128 // a <= t < -(-(j + 1) * 128 // a) for j, t in enumerate(own))


@pytest.mark.parametrize("n", [20, 200, 400])
def test_schedule_is_within_one_block_at_any_length(n):
    rng = random.Random(n)
    weights = [0.5] + [0.5 / (n - 1)] * (n - 1) if n != 400 else [rng.random() + 0.001 for _ in range(n)]
    blocks = [8_000] + [rng.randint(0, 200) for _ in range(n - 1)]
    slots = mixing.schedule(blocks, weights)
    assert [len(s) for s in slots] == blocks and sorted(t for s in slots for t in s.tolist()) == list(range(sum(blocks)))
    owner = np.empty(sum(blocks), np.int64)
    for k, own in enumerate(slots):
        owner[own] = k
    got, fluid = np.zeros(n), np.zeros(n)
    for k in owner:  # the fluid schedule, slot by slot: every source at its weight among those left
        left = 1.0
        while left > 1e-12:
            rate = np.where(np.array(blocks) - fluid > 1e-9, weights, 0.0)
            rate /= rate.sum()
            step = min([left, *((np.array(blocks) - fluid)[rate > 0] / rate[rate > 0])])
            fluid, left = fluid + step * rate, left - step
            if fluid.sum() > sum(blocks) - 1e-6:
                break
        got[k] += 1
        assert abs(got - fluid).max() < 1 + 1e-6


def test_blocks_of_any_table_have_a_bound(spark):
    assert mixing.block_size(10**11) * mixing.MOST_BLOCKS >= 10**11 and mixing.block_size(1000) == mixing.BLOCK_DOCS
    docs = documents(spark, ["t"] * 300, source=["a"] * 200 + ["b"] * 100)
    rows = mixing.mix(docs, {"a": 2.0, "b": 1.0}, block_docs=2, most_blocks=12).collect()
    assert {r.mix_slot for r in rows} == set(range(12)) and max(r.mix_position for r in rows) == 24
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted((r.mix_slot, r.mix_position) for r in mixing.mix(nameless, block_docs=4, bucket_rows=10).collect()) == sorted((s, p) for s in range(75) for p in range(4))


def test_mixing_of_many_sources(spark):
    docs = documents(spark, ["t"] * 1500, source=["big"] * 900 + [f"s{k % 300}" for k in range(600)])
    rows = mixing.mix(docs, block_docs=2).collect()
    assert len(rows) == 1500 and {r.mix_slot for r in rows} == set(range(450 + 300))


def test_mixing_against_the_definition(spark):
    sources = ["big"] * 400 + ["mid"] * 120 + ["low"] * 45 + [None] * 20
    docs = documents(spark, ["t"] * len(sources), source=sources)
    weights = {"big": 0.5, "mid": 0.3, "low": 0.15, None: 0.05}
    rows = mixing.mix(docs, weights, block_docs=4, bucket_rows=50).collect()
    assert len(rows) == len(sources) and {r.doc_id for r in rows} == set(range(len(sources)))
    blocks = {}
    for r in rows:
        blocks.setdefault(r.mix_slot, []).append(r)
    assert sorted(blocks) == list(range(len(blocks))) and all(len({(r.source, r.mix_block) for r in b}) == 1 for b in blocks.values())
    assert all(sorted(r.mix_position for r in b) == list(range(len(b))) for b in blocks.values())
    left, got = {s: -(-sources.count(s) // 4) for s in weights}, Counter()
    for t in sorted(blocks):
        got[blocks[t][0].source] += 1
        if any(got[s] >= left[s] for s in weights):
            break
        assert all(abs(got[s] - weights[s] * (t + 1)) < 1 + 1e-9 for s in weights)
    assert sum(len(b) for b in blocks.values()) == len(sources)


def test_mixing_awkward(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs)
    assert rows.count() == docs.count() and rows.columns.count("mix_slot") == 1
    out = mixing.ordered(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(docs, {"a": 1.0})


# -- 10

def brute_fingerprint(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [" ".join(own)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_brute_force(spark):
    texts = sample_texts(spark, 120)
    texts += [texts[3] + " end", texts[3], texts[4].replace("the", "thee", 1), None, "", "A b", "a B"]
    docs = documents(spark, texts)
    fps = [brute_fingerprint(t) for t in texts]
    comp = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{fps[k]:016x}", comp[k]) for k in range(len(texts))}
    kept = simhash.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == set(comp) and kept.columns == docs.columns


@pytest.mark.parametrize(("rows", "split"), [(1 << 20, 1 << 20), (60, 1 << 20), (60, 12), (1 << 20, 40)])
def test_links_across_shards(rows, split):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    chain = [base[0]]
    for k in range(40):  # a chain of small steps, and a dense ball
        chain.append(chain[-1] ^ np.uint64(0b111 << (k % 60)))
    ball = [base[1] ^ np.uint64(1 << b) for b in range(60)]
    fps = np.unique(np.concatenate([base, np.array(chain, np.uint64), np.array(ball, np.uint64)]))
    tree = simhash.shard_tree(fps, len(fps), rows)
    shard, at, home = simhash.route(tree, fps)
    assert sorted(at[home]) == list(range(len(fps)))
    root, n_shards = np.arange(len(fps)), shard.max() + 1
    homes, asks = np.bincount(shard[home], minlength=n_shards), np.bincount(shard, minlength=n_shards)
    parts = [np.maximum(1, -(-x // most)) for x, most in ((homes, split), (asks, 3 * split))]
    index, group, role = simhash.dealt(fps[at], shard, home, *parts)
    for g in set(group):
        here = group == g
        own, order = np.unique(at[index[here]], return_index=True)
        assert len(own) == here.sum() and len(own) <= 3 * (split + 3 * split)
        roles = role[here][order]
        for i, r in enumerate(own[simhash.link(fps[own], (roles & 1) > 0, (roles & 2) > 0)]):
            a, b = own[i], r
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
    assert list(root) == brute_components([int(x) for x in fps])


def test_components_of_chains(spark):
    edges = [(k + 1, k) for k in range(0, 30)] + [(101, 100), (105, 101), (105, 100)]
    got = {r.a: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 101: 100, 105: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_awkward(spark):
    docs = awkward(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].fingerprint == by_id[1].fingerprint == "0" * 16 and by_id[2].component_id == 0 and by_id[8].component_id == 7
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = Counter(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept[None] == 0 and kept[7] == 1 and kept[8] == 0  # the row without an id is a copy of document 7
    assert simhash.keep_one(docs.limit(0)).count() == 0
    alone = docs.where("doc_id IN (3, 4)").withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(alone.union(alone)).count() == 2


def test_shards_grow_with_the_data():
    rng = np.random.default_rng(1)
    total, rows = 1_000_000_000, simhash.SHARD_ROWS
    sample = rng.integers(0, 1 << 63, simhash.SAMPLE_A_SHARD * (total // rows), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, simhash.SAMPLE_A_SHARD * (total // rows)).astype(np.uint64)
    tree = simhash.shard_tree(sample, total, rows)
    probe = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    shard, at, home = simhash.route(tree, probe)
    n_shards = max(len(set(shard)), int(shard.max()) + 1)
    assert n_shards > total // rows / 2
    assert np.bincount(shard[home]).max() / len(probe) * total < 12 * rows  # homes; beyond two shards' worth they are dealt into parts


def test_one_component_of_most_rows(spark):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    texts = [" ".join(base)] * 150 + [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 400, 4)] + [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(60)]
    docs = documents(spark, texts)
    want = brute_components([brute_fingerprint(t) for t in texts])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shard_rows=16, visitor_rows=20).collect()}
    assert [got[k] for k in range(len(texts))] == want and Counter(want).most_common(1)[0][1] > 200


def test_keep_one_tells_rows_of_one_id_apart(spark):
    texts = [" ".join(f"w{random.Random(k).randint(0, 10**6) + i}" for i in range(50)) for k in range(4)]
    docs = documents(spark, [*texts, texts[1]]).withColumn("doc_id", F.expr("CASE WHEN doc_id < 3 THEN 5L ELSE doc_id END"))
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(docs.union(docs)).collect()) == Counter([(5, texts[0]), (5, texts[2]), (3, texts[3]), (4, texts[1])])
