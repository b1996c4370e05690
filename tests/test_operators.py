"""Values worked out by hand, and properties, of the claim operators."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkverity.functions import hashing as H
from sparkverity.functions import image as I
from sparkverity.functions import text as T
from sparkverity.operators import claims as C
from sparkverity.operators import datasets as D
from sparkverity.operators import evaluate as E
from sparkverity.operators import hashing as HJ
from sparkverity.operators import heads
from sparkverity.operators import icd
from sparkverity.operators import models as M
from sparkverity.operators.ranking import hash_rank, running_sums
from sparkverity.session import new_dir
from sparkverity.sources import io

c = F.col


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_declared_codes_and_mask(spark):
    text = "Patient was coded with C18.9 and e11.65; also mentions A00, C18.9"
    got = values(spark, [(text,), (None,), ("",)], "t string", T.declared_codes(c("t")), T.mask_codes(c("t")), T.explicit_codes(c("t")))
    assert got[0] == (["A00", "C18.9", "E11.65"], "Patient was coded with [ICD_CODE] and [ICD_CODE]; also mentions [ICD_CODE], [ICD_CODE]", ["C18.9", "E11.65", "A00"])
    assert got[1] == ([], None, []) and got[2] == ([], "", [])


@pytest.mark.parametrize(("declared", "predicted", "score", "reason"), [
    ("C18.9", [("C18.9", 0.9), ("E11.9", 0.2)], 1.0, "exact_match"),
    ("C20.1", [("C20.5", 0.3)], 0.6, "same_category"),
    ("Z99.9", [("A00", 0.1)], 0.0, "mismatch"),
    ("C18.9", [("C18.9", 0.4)], 0.6, "same_category"),
])
def test_score_ladder(spark, declared, predicted, score, reason):
    d = spark.createDataFrame([(1, declared)], "doc_id long, declared string")
    p = spark.createDataFrame([(1, k, v) for k, v in predicted], "doc_id long, code string, prob double")
    r = icd.score_declared(d, p).first()
    assert (r.score, r.match_type) == (score, reason)


def test_related_code(spark):
    d = spark.createDataFrame([(1, "X99")], "doc_id long, declared string")
    p = spark.createDataFrame([(1, "A00", 0.1)], "doc_id long, code string, prob double")
    emb = spark.createDataFrame([("X99", [0.9, 0.1])], "declared string, emb array<double>")
    known = spark.createDataFrame([("A123", [1.0, 0.0]), ("B456", [0.0, 1.0])], "code string, emb array<double>")
    r = icd.score_declared(d, p, icd.related_codes(emb, known)).first()
    assert (r.score, r.match_type, r.best_match) == (0.3, "related", "A123")


def test_documents_without_codes_or_predictions(spark):
    docs = spark.createDataFrame([(1, "no code"), (2, "code I10"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, code string, prob double")
    rows = {r.doc_id: r for r in icd.explain(docs, none).collect()}
    assert rows[1].match_type == rows[3].match_type == "no_declared" and rows[1].score is None
    assert (rows[2].match_type, rows[2].score, rows[2].predicted_top) == ("mismatch", 0.0, None)
    assert icd.explain(docs, none, icd.no_scorer).where("doc_id = 2").first().match_type == "no_scorer"


def test_hamming(spark):
    got = values(spark, [("deadbeef", "deadbeef"), ("a", "0a"), ("ffffffffffffffff", "0"), ("xyz", "0")], "a string, b string", H.hamming_hex(c("a"), c("b")))
    assert got == [(0,), (0,), (64,), (None,)]


def test_hash_joins_equal_brute_force(spark):
    rng = random.Random(3)
    refs = [(k, rng.getrandbits(64)) for k in range(60)]
    queries = [(k, refs[k % 60][1] ^ sum(1 << b for b in rng.sample(range(64), k % 14))) for k in range(80)]
    as_df = lambda rows, name: spark.createDataFrame([(k, f"{h:016x}") for k, h in rows], f"{name} long, hex string")
    q, r = as_df(queries, "query_id"), as_df(refs, "ref_id")
    pairs = {(a, b): bin(x ^ y).count("1") for a, x in queries for b, y in refs}
    for d in (0, 5, 10):
        got = {(x.query_id, x.ref_id): x.distance for x in HJ.within(q, r, d).collect()}
        assert got == {k: v for k, v in pairs.items() if v <= d}
    want = {a: min((pairs[a, b], b) for b, _ in refs) for a, _ in queries}
    for sizes in ({}, {"query_block": 7, "block_rows": 9}):
        assert {x.query_id: (x.distance, x.ref_id) for x in HJ.nearest(q, r, **sizes).collect()} == want
    none = HJ.dissimilarity(HJ.nearest(q, r.where("false"))).first()
    assert (none.distance, none.ref_id, none.score) == (None, None, 1.0)
    assert HJ.similar(q, r, report_unmatched=False).where("match_type = 'none'").count() == sum(v[0] > 10 for v in want.values())


def test_image_verdicts(spark):
    rows = [(0.182, 0.201, 0.921), (0.1, 0.1, None), (None, 0.2, 0.1), (0.4, 0.4, 0.0), (0.2, 0.2, 0.65)]
    got = values(spark, rows, "a double, b double, h double", C.image_verdict(c("a"), c("b"), c("h")))
    assert [x[0] for x in got] == ["tampered", "authentic", "error", "tampered", "suspicious"]


def test_recompression_wraps(spark):
    got = values(spark, [([10], [12])], "a array<int>, b array<int>", I.recompression_difference(c("a"), c("b")), I.recompression_difference(c("a"), c("b"), wrap=False))
    assert got == [([236], [20])]


def test_log_amount(spark):
    assert math.isclose(values(spark, [(25000.0,)], "x double", F.log1p("x"))[0][0], 10.1267, abs_tol=1e-4)


def test_identity_edges(spark):
    rows = [("P1", "p1"), ("P1", None), (None, None), ("P1", "P2")]
    h = C.identity_hundredths(c("a"), c("b"), F.array().cast("array<string>"), F.lit(None).cast("string"))
    got = values(spark, rows, "a string, b string", h, C.identity_status(h))
    assert got == [(100, "matched"), (85, "matched"), (70, "uncertain"), (60, "uncertain")]


def test_verify_handles_nulls_and_empty(spark):
    schema = "claim_id long, patient_id string, clinical_text string, claim_amount double, previous_claim_count int, img_patient_id string, img_modality string, cnn_score double, ela_score double, phash_score double, extra string"
    rows = [(1, None, None, None, None, None, None, None, None, None, "x"), (2, "P", "hypertension", 100.0, 0, None, "CT", 0.1, 0.1, None, None)]
    got = {r.claim_id: r for r in C.verify(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].verdict.recommendation == "manual_review" and got[2].verdict.recommendation == "approve"
    assert C.verify(spark.createDataFrame([], schema)).count() == 0


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(1000).select(c("id").alias("k"), (c("id") % 3).alias("g"))
    parts = D.split(df, "k", 0.15, by=["g"]).groupBy("g").agg(F.count_if(c("split") == "val").alias("v")).collect()
    assert sorted((r.g, r.v) for r in parts) == [(0, 50), (1, 49), (2, 49)]
    ranks = [r._rank for r in hash_rank(df, "k").collect()]
    assert sorted(ranks) == list(range(1, 1001))
    notes = df.select(c("g").cast("string").alias("subject_id"))
    assert D.subject_split(notes, val_frac=0.1).where("split = 'val'").count() == 1
    assert D.sample(df, "k", 10_000).count() == 1000


def test_null_group_ranks(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k long, g string")
    assert {(r.k, r._total) for r in hash_rank(df, "k", by=["g"]).collect()} == {(1, 2), (2, 2), (3, 1)}


def test_auc_two_ways_and_one_class(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice([0.1, 0.2, 0.3, 0.4]) + rng.randint(0, 1) * 0.05, rng.randint(0, 1)) for _ in range(300)], "s double, label int")
    assert math.isclose(E.auc(df, "s").first().auc, E.rank_auc(df, "s").first().auc, abs_tol=1e-12)
    assert E.auc(df.where("label = 1"), "s").first().auc is None
    assert E.curve(df.limit(0), "s").count() == 0


def test_running_sums_flat(spark):
    df = spark.createDataFrame([(1.0, 2), (1.0, 3)], "v double, n long").groupBy("v").agg(F.sum("n").alias("n"))
    assert running_sums(df, "v", ["n"]).first().cum_n == 5


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(k),) for k in range(101)] + [(None,)], "v double")
    got = {r.bin: r.n for r in E.histogram(df, "v", 50).collect()}
    assert sum(got.values()) == 101 and got[49] == 3
    assert E.histogram(df.limit(0), "v").count() == 0


def test_class_reports_with_zero_division(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "t int, p int")
    rows = {r["class"]: r for r in E.class_report(df, "t", "p").collect()}
    assert rows[0].precision == rows[0].recall == 0.0 and rows[1].recall == 1.0
    assert E.binary_report(df.limit(0), "t", "p").first().f1 == 0.0


def test_patient_identifier(spark):
    got = values(spark, [("Report\nMRN:  12 3 \nName: X",), ("nothing",), (None,)], "t string", T.patient_identifier(c("t")))
    assert got == [("12 3",), (None,), (None,)]


def test_insert_and_exists(spark):
    table = spark.createDataFrame([("00",)], "phash_hex string")
    new = spark.createDataFrame([("00", "a", "s"), ("01", "b", "s"), ("01", "a", "s")], "phash_hex string, image_id string, source string")
    got = HJ.insert_hashes(table, new, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r.phash_hex, r.image_id) for r in got] == [("01", "a")]
    assert {r.phash_hex: r.known for r in HJ.hash_exists(new.select("phash_hex").distinct(), table).collect()} == {"00": True, "01": False}


def test_related_codes_of_any_dictionary(spark):
    """Equal to comparing all; on clustered vectors less than half of all pairs are compared."""
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    vector = lambda k: [x * (0.1 + k % 7) + rng.gauss(0, 0.2) for x in centres[k % 12]]
    codes = [(f"C{k:03d}", vector(k)) for k in range(400)] + [("AAA", [0.0] * 6), ("BBB", None), ("CCC", [1.0] * 5 + [float("nan")]), ("DDD", [1e-6] * 6)]
    codes += [("Z" + name, v) for name, v in codes[:5]]
    asked = [(f"Q{k:03d}", vector(k)) for k in range(60)] + [codes[3], ("zero", [0.0] * 6), ("none", None), ("small", [1e-5] * 6), ("away", [-x for x in centres[0]])]
    known, declared = spark.createDataFrame(codes, "code string, emb array<double>"), spark.createDataFrame(asked, "declared string, emb array<double>")

    def sim(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)) + 1e-8)

    fit = [(name, v) for name, v in codes if v and all(map(math.isfinite, v))]
    for least in (0.65, 0.1, -2.0):
        want = {q: best for q, v in asked if v and (best := min(((-sim(v, b), code) for code, b in fit)))[0] < -least}
        for sizes in ({}, {"codes_a_ball": 20, "part_rows": 16}):
            seen = {}
            got = {r.declared: (r.sim, r.best_match) for r in icd.related_codes(declared, known, least, seen=seen, **sizes).collect()}
            assert got.keys() == want.keys() and all(abs(got[q][0] + want[q][0]) < 1e-9 and got[q][1] == want[q][1] for q in want)
            if least == 0.65 and sizes:
                assert 0 < seen["compared"] < len(asked) * len(codes) / 2
    assert icd.related_codes(declared, known.where("false"), 0.5).count() == 0 == icd.related_codes(declared.where("false"), known, 0.5).count()


def test_scorer_plug_in(spark):
    docs = spark.createDataFrame([(1, "code I10 and J45.9"), (2, "none")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "I10", 0.9)], "doc_id long, code string, prob double")
    fixed = lambda declared, predictions: declared.withColumn("score", F.lit(0.5)).withColumn("match_type", F.lit("mine"))
    rows = icd.explain(docs, p, fixed).collect()
    assert {(r.doc_id, r.declared, r.match_type) for r in rows} == {(1, "I10", "mine"), (1, "J45.9", "mine"), (2, None, "no_declared")}
    usual = {(r.doc_id, r.declared): (r.match_type, r.score) for r in icd.explain(docs, p).collect()}
    assert usual == {(1, "I10"): ("exact_match", 1.0), (1, "J45.9"): ("mismatch", 0.0), (2, None): ("no_declared", None)}
    none = icd.explain(docs, p, icd.no_scorer).where("declared = 'I10'").first()
    assert (none.match_type, none.score) == ("no_scorer", 0.0)


@pytest.mark.parametrize("offset", [0, -5, 1 << 45, 1 << 60, -(1 << 60)])
def test_nearest_hash_of_any_ids(spark, offset):
    rng = random.Random(3)
    refs = [(offset + k, f"{rng.getrandbits(64):016x}") for k in range(40)]
    refs += [(offset + 40, refs[3][1]), (offset + 41, "ffffffffffffffff")]
    queries = [(k, f"{int(refs[k][1], 16) ^ (1 << k) ^ (3 << 50 if k % 2 else 0):016x}") for k in range(20)] + [(99, "not hex")]
    got = {r.query_id: (r.ref_id, r.distance) for r in HJ.nearest(spark.createDataFrame(queries, "query_id long, hex string"), spark.createDataFrame(refs, "ref_id long, hex string"), block_rows=16).collect()}
    for q, h in queries[:-1]:
        assert got[q] == min(((bin(int(h, 16) ^ int(x, 16)).count("1"), i) for i, x in refs))[::-1]
    assert got[99] == (None, None)


def test_running_sums_of_uneven_values(spark):
    rows = [(10.0**-k, k + 1) for k in range(60)] + [(1e9, 5)]
    df = spark.createDataFrame(rows, "v double, n long")
    got = {r.v: r.cum_n for r in running_sums(df, "v", ["n"]).collect()}
    assert got == {v: sum(n for w, n in rows if w >= v) for v, _ in rows}


def test_full_explanation(spark):
    row = [(1, "Patient ID: P7. Diagnosis: hypertension. ICD-10: I10", 0.1, 0.1, 0.1, "p7", "CT", 100.0, 0)]
    v = C.verify(spark.createDataFrame(row, "claim_id long, clinical_text string, cnn_score double, ela_score double, phash_score double, img_patient_id string, img_modality string, claim_amount double, previous_claim_count int"))
    text = v.select(C.explanation()).first()[0]
    assert text.startswith("🏥 ICD CODE VALIDATION: VALID\n   High confidence ICD code match (score: 0.89). Primary diagnosis appears legitimate.\n\n🖼️  IMAGE ANALYSIS: AUTHENTIC\n   LOW RISK")
    assert "\nDocument Patient ID: P7\nImage Patient ID: p7\n" in text
    found = C.reference_findings(v, spark.createDataFrame([("P7",)], "patientid string")).first().findings
    assert found == ["Patient P7 found in TCGA-COAD database", "Patient p7 NOT in TCGA-COAD (could indicate missing data or external patient)", "Warning: ICD codes ['I10'] may be outside TCGA-COAD typical scope"]
    assert "TCGA-COAD Reference Alignment:\n  • Patient P7 found" in v.select(C.explanation(F.array(*map(F.lit, found)))).first()[0]


def test_fraud_model_learns_a_rule_and_survives_saving(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, *(rng.random() for _ in M.FRAUD_FEATURES)) for k in range(300)]
    df = spark.createDataFrame(rows, "claim_id long, " + ", ".join(f"{f} double" for f in M.FRAUD_FEATURES)).withColumn("fraud", (c("final_image_forgery_score") > 0.5).cast("int"))
    model = M.fit_fraud(df, rounds=3)
    before = {r.claim_id: r.probability for r in M.fraud_scores(model, df).collect()}
    assert all((before[r.claim_id] > 0.5) == (r.fraud == 1) for r in df.collect())
    trees = M.tree_rows(model, spark)
    name, weight, said = M.drivers(trees).first()
    importance = {r.feature: r.importance for r in M.importances(trees).collect()}
    assert all(abs(importance.get(f, 0.0) - w) < 1e-9 for f, w in zip(M.FRAUD_FEATURES, model.stages[-1].featureImportances.toArray(), strict=True))
    assert name == "final_image_forgery_score" and weight > 0.9 and said == M.DRIVERS["image"]
    io.save_model(model, f"file://{tmp_path}/model")
    again = {r.claim_id: r.probability for r in M.fraud_scores(io.load_model(f"file://{tmp_path}/model"), df).collect()}
    assert again == before
    io.save_trees(trees, f"file://{tmp_path}/trees")
    folded = {r.claim_id: r.probability for r in M.tree_scores(io.load_trees(spark, f"file://{tmp_path}/trees"), df).collect()}
    assert folded.keys() == before.keys() and all(abs(folded[k] - before[k]) < 1e-12 for k in before)
    assert M.tree_scores(trees, df.withColumn("final_image_forgery_score", F.lit(None).cast("double"))).where("probability IS NULL").count() == 0
    assert M.tree_scores(trees.where("false"), df).first().probability == 0.5


def test_text_and_embedding_heads_learn(spark):
    rows = spark.createDataFrame([(k, "alpha beta" if k % 2 else "gamma delta", ["I10"] if k % 2 else ["J45.9"]) for k in range(60)], "claim_id long, text string, labels array<string>")
    prepare, heads = M.fit_text_labels(rows, ["I10", "J45.9"])
    scores = {(r.claim_id, r.code): r.prob for r in M.text_label_scores(prepare, heads, rows, "claim_id").collect()}
    assert all((scores[k, "I10"] > 0.5) == (k % 2 == 1) and (scores[k, "J45.9"] > 0.5) == (k % 2 == 0) for k in range(60))
    vectors = spark.createDataFrame([(k, [1.0 if k % 2 else -1.0, 0.3]) for k in range(60)], "vec_id long, embedding array<double>")
    labelled = vectors.withColumn("labels", F.when(c("vec_id") % 2 == 1, F.array(F.lit("up"))).otherwise(F.array(F.lit("down"))))
    head = M.fit_head(labelled, ["up", "down"])
    assert [r.label for r in head.collect()] == ["up", "down"]
    probs = {(r.vec_id, r.label): r.prob for r in M.head_scores(vectors, head).collect()}
    assert all((probs[k, "up"] > 0.5) == (k % 2 == 1) for k in range(60))


def test_heads_equal_separate_fits(spark):
    """The same probabilities as one fit after another, dense and sparse; as many jobs for many labels as for few."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = random.Random(8)
    points = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(200)]
    points = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in points]
    labels = [[name for name, k in (("a", 0), ("b", 1), ("c", 2)) if v[k] + rng.gauss(0, 0.3) > 0.2] + ["always", "unknown"] for v in points]
    rows = spark.createDataFrame(list(zip(range(200), points, labels, strict=True)), "id long, embedding array<double>, labels array<string>")
    head = M.fit_head(rows, ["a", "b", "c", "always", "never"])
    got = {(r.id, r.label): r.prob for r in M.head_scores(rows.select("id", "embedding"), head).collect()}
    sparse = rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: k).alias("at"), F.slice("embedding", 1, 4).alias("x"), "labels")
    for outer in (heads.OUTER, 1):
        old, heads.OUTER = heads.OUTER, outer
        few = heads.fit(sparse, ["a", "b"], 4)
        heads.OUTER = old
        by_row = {(r.id, r.code): r.prob for r in heads.probabilities(sparse, heads.as_rows(spark, few, ["a", "b"]).collect(), "id").collect()}
        for name, features, mine in (("a", 5, got), ("b", 5, got), ("c", 5, got), ("a", 4, by_row), ("b", 4, by_row)):
            ready = rows.select("id", array_to_vector(F.slice("embedding", 1, features)).alias("v"), F.array_contains("labels", name).cast("double").alias("y"))
            model = LogisticRegression(featuresCol="v", labelCol="y", regParam=heads.PENALTY, standardization=False, maxIter=300, tol=1e-12).fit(ready)
            assert all(abs(r.p - mine[r.id, name]) < 1e-5 for r in model.transform(ready).select("id", vector_to_array("probability")[1].alias("p")).collect())
    assert all(p > 0.99 for (_, name), p in got.items() if name == "always") and all(p < 0.01 for (_, name), p in got.items() if name == "never")

    def jobs(names):
        spark.sparkContext.setJobGroup("count", "")
        spark.sparkContext._jsc.setLocalProperty("spark.jobGroup.id", f"heads-{len(names)}")
        heads.fit(rows.select(F.lit(None).cast("array<int>").alias("at"), F.col("embedding").alias("x"), "labels"), names, 5, steps=3, tolerance=0.0)
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"heads-{len(names)}")
        spark.sparkContext._jsc.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    assert jobs(["a", "b"]) == jobs([f"L{k}" for k in range(400)]) > 0
    assert heads.fit(rows.select(F.lit(None).cast("array<int>").alias("at"), F.col("embedding").alias("x"), "labels").where("false"), ["a"], 5).tolist() == [[0.0]] * 6


def test_image_score_plug_in(spark):
    pictures = spark.createDataFrame([(f"p{k}.png", bytes([k] * k)) for k in range(25)] + [("none.png", None)], "path string, content binary")

    def load():
        import pandas as pd

        size = lambda b: None if b is None else len(b) / 100.0
        return lambda batch: pd.DataFrame({"cnn_score": [size(b) for b in batch["content"]], "ela_score": 0.5})

    got = {r.path: (r.cnn_score, r.ela_score) for r in M.image_scores(pictures, load, ("cnn_score", "ela_score")).collect()}
    assert got["p7.png"] == (0.07, 0.5) and len(got) == 26 and (got["none.png"][0] is None or math.isnan(got["none.png"][0]))
    assert M.image_scores(pictures.limit(0), load, ("cnn_score",)).count() == 0


def test_class_index_of_many_names(spark, monkeypatch):
    paths = [(f"root/c{k % 37:02d}/{k}.png",) for k in range(200)] + [(None,)]
    df = spark.createDataFrame(paths, "file_path string")
    few = sorted(map(tuple, D.class_index(df).collect()))
    monkeypatch.setattr(D, "BROADCAST_CLASSES", 5)
    many = D.class_index(df)
    assert sorted(map(tuple, many.collect())) == few and {r.class_index for r in many.collect()} == set(range(37))
    assert all(r["class"] == f"c{r.class_index:02d}" for r in many.collect())


@pytest.mark.parametrize("turned", [False, True])
def test_dictionary_ties(spark, turned):
    """Of rows of one place the greater description wins, in whatever order they come."""
    rows = [("a", "x", 1), (" A", "z", 2), ("a ", "y", 2), ("a", None, 2), ("b", None, 1), ("c", "late", None), ("c", "early", 0)]
    got = D.diagnosis_dictionary(spark.createDataFrame(rows[::-1] if turned else rows, "code string, description string, row_ord long").coalesce(1)).collect()
    assert {r.code: r.description for r in got} == {"A": "z", "B": "", "C": "early"}


def test_verification_is_compiled(spark):
    """No generated method is longer than the 8000 bytes up to which the JVM compiles one to machine code."""
    schema = io.CLAIMS.replace(", claim_ts timestamp", "")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path := new_dir(spark, "no-claims"))
    plan = C.verify(spark.read.schema(schema).parquet(path))._jdf.queryExecution().executedPlan()
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan))]
    assert sizes and max(sizes) < 8000


def test_sparse_vectors_are_not_laid_out(spark):
    """A vector of 2^30 places costs what it holds."""
    from pyspark.ml.linalg import Vectors

    rows = [(1, Vectors.sparse(1 << 30, [5, 1 << 29], [2.0, 0.0])), (2, Vectors.dense([0.0, 3.0])), (3, Vectors.sparse(4, [], []))]
    got = {r.k: (r["at"], r.x) for r in M._sparse(spark.createDataFrame(rows, ["k", "vec"]), "k").collect()}
    assert got == {1: ([5], [2.0]), 2: ([1], [3.0]), 3: ([], [])}


def test_equal_rows_are_fitted_once(spark):
    one = [([0, 2], [0.6, 0.8], ["a"]), ([1], [1.0], ["b"]), ([0], [1.0], ["b", "a"])]
    schema = "at array<int>, x array<double>, labels array<string>"
    many = spark.createDataFrame(one * 40 + one[:1] * 15, schema)
    assert sorted(r.times for r in heads.distinct_rows(heads.label_rows(many, ["a", "b"])).collect()) == [40, 40, 55]
    spread = many.withColumn("x", F.concat("x", F.array(F.lit(0.0)))).withColumn("at", F.concat("at", F.array(3 + F.monotonically_increasing_id() % 7)).cast("array<int>"))
    for outer in (heads.OUTER, 1):  # features that are 0 everywhere keep equal rows apart and change nothing
        old, heads.OUTER = heads.OUTER, outer
        a, b = heads.fit(many, ["a", "b"], 10, steps=5), heads.fit(spread, ["a", "b"], 10, steps=5)
        heads.OUTER = old
        assert abs(a - b).max() < 1e-9 < abs(a).max()


def _library_scores(rows, names, features):
    """Probabilities of the text baseline with the library's own steps before the heads."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer

    ready = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\W+"), NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="SELECT *, concat(_w, _b) AS _t FROM __THIS__"), CountVectorizer(inputCol="_t", outputCol="_n", vocabSize=features),
        IDF(inputCol="_n", outputCol="_i"), Normalizer(inputCol="_i", outputCol="vec"),
    ]).fit(rows)
    sparse = M._sparse(ready.transform(rows), "id", "labels").persist()
    weights = heads.fit(sparse, names, len(ready.stages[3].vocabulary), steps=100, tolerance=2e-4)
    return {(r.id, r.code): r.prob for r in heads.probabilities(sparse, heads.as_rows(rows.sparkSession, weights, names).collect(), "id").collect()}


def test_text_baseline_equals_the_library(spark):
    """Few and many features, repeated words, texts without words, letters whose lower case differs, equal texts of other labels."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Sigmoid", "colon", "a-b_c", "LUNG", "10", "été"]) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += ["", "  --", "İX Σας Kelvin", "one", "one"] + [" ".join(f"w{k % 700}x{k % 3}" for k in range(4000))]
    names = ["a", "b", "c"]
    rows = spark.createDataFrame([(k, t, [x for x in [*names, "other"] if x in t.lower() or k % 7 == 0]) for k, t in enumerate(texts)], "id long, text string, labels array<string>")
    for some in (rows, rows.where("id < 150")):  # more than heads.OUTER features, and fewer
        prepare, head = M.fit_text_labels(some, names, features=10_000)
        assert (len(prepare.grams) > heads.OUTER) == (some is rows)
        got = {(r.id, r.code): r.prob for r in M.text_label_scores(prepare, head, some, "id").collect()}
        want = _library_scores(some, names, 10_000)
        assert got.keys() == want.keys() and len(got) == 3 * some.count() and max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_texts_are_read_once_for_words_once_for_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = spark.range(400).selectExpr("id", "concat('text ', id % 9, ' of ', id) AS text", "array(cast(id % 2 AS string)) AS labels")
    rows = made.mapInArrow(run, made.schema)
    prepare, head = M.fit_text_labels(rows, ["0", "1"])
    assert seen.value == 800
    assert M.text_label_scores(prepare, head, rows, "id").count() == 800 and seen.value == 1200


def test_grams_of_a_tie_do_not_rest_on_partitions(spark):
    words = [f"w{k:03d}" for k in range(300)]
    for parts in (2, 5):
        random.Random(parts).shuffle(words)
        rows = spark.createDataFrame([(w, [w]) for w in [*words, "z z", None]], "text string, labels array<string>").repartition(parts)
        prepare, _ = M.fit_text_labels(rows, ["w001"], features=12, steps=1)
        assert prepare.grams == ["z", *(f"w{k:03d}" for k in range(10)), "w010"] and abs(prepare.idf[0] - math.log(303 / 2)) < 1e-12


def test_many_tasks_sums_are_added_in_a_tree(spark):
    rows = spark.createDataFrame([([k % 5], [1.0], ["a"] if k % 3 else ["b"]) for k in range(90)], "at array<int>, x array<double>, labels array<string>")
    whole = heads.fit(rows, ["a", "b"], 5, steps=5)
    heads.DIRECT, old = 0, heads.DIRECT
    tree = heads.fit(rows.repartition(9), ["a", "b"], 5, steps=5)
    heads.DIRECT = old
    assert abs(whole - tree).max() < 1e-12 < abs(whole).max()


def test_text_baseline_without_words_or_labels(spark):
    schema = "id long, text string, labels array<string>"
    for rows, names in ([(1, " ", ["a"]), (2, None, None)], ["a"]), ([(1, "one two", ["a"])], []), ([], ["a"]):
        some = spark.createDataFrame(rows, schema)
        prepare, head = M.fit_text_labels(some, names)
        assert {(r.id, r.code, r.prob) for r in M.text_label_scores(prepare, head, some, "id").collect()} == {(r[0], x, 0.5) for r in rows for x in names}
