from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkverity.sources import io


def test_image_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for p in ("x.png", "a/y.JPG", "a/b/z.jpeg", "a/no.txt"):
        (tmp_path / p).write_bytes(b"12345")
    got = {r.path: r.bytes for r in io.image_files(spark, str(tmp_path)).select("path", "bytes").collect()}
    assert got == {"x.png": 5, "a/y.JPG": 5, "a/b/z.jpeg": 5}


def test_dictionary_prefers_short(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Code,ShortDescription,LongDescription\na00,Cholera,x\nC18.9,,y\n")
    assert [(r.code, r.description) for r in io.diagnosis_rows(spark, str(tmp_path / "d.csv")).collect()] == [("a00", "Cholera"), ("C18.9", None)]


def test_text_codes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,icd_codes\nDiagnosis: Asthma.,j45; \n " ",x\nnone,\n')
    got = {r.text: r.codes for r in io.text_codes(spark, str(tmp_path / "t.csv")).collect()}
    assert got["Diagnosis: Asthma."] == ["J45"] and got["none"] == []


def test_label_map_as_list(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps(["b", "a"]))
    assert [(r.label, r.idx) for r in io.read_label_map(spark, str(tmp_path / "l.json")).collect()] == [("b", 0), ("a", 1)]


def test_hash_header_variant(spark, tmp_path):
    (tmp_path / "h.csv").write_text("filename,phash\nx.png,00ff\n")
    assert io.read_hashes(spark, str(tmp_path / "h.csv")).first().phash_hex == "00ff"


def test_claims_list(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"claim_id": 1, "claim_amount": 2.5}, {"claim_id": 2}]))
    assert io.read_claims(spark, str(tmp_path / "c.json")).count() == 2


def test_hash_table_properties(spark):
    # noise has no zero coefficients, whose signs would be chance; a brighter copy differs in the mean only
    flat, noise = bytes([7] * 64), random.Random(1).randbytes(64)
    noise = bytes(v % 250 for v in noise)
    rows = [("flat", 8, 8, flat), ("noise", 8, 8, noise), ("bright", 8, 8, bytes(v + 1 for v in noise)), ("bad", 8, 8, b"1"), ("none", 8, 8, None)]
    got = {r.filename: r.phash_hex for r in io.hash_table(spark.createDataFrame(rows, "path string, width int, height int, grey binary")).collect()}
    assert set(got) == {"flat", "noise", "bright"} and all(len(v) == 16 for v in got.values())
    assert bin(int(got["noise"], 16) ^ int(got["bright"], 16)).count("1") <= 2


@pytest.mark.parametrize("sides", [(8, 8), (1, 1), (40, 33), (32, 32), (3, 70)])
def test_coefficients_equal_the_transform(spark, sides):
    """The matrix product in SQL against reduction and cosine transform done one after the other."""
    import numpy as np

    w, h = sides
    grey = random.Random(w * h).randbytes(w * h)

    def along(m):
        at = np.clip((np.arange(32) + 0.5) * len(m) / 32 - 0.5, 0, len(m) - 1)
        low = np.floor(at).astype(int)
        return m[low] * (1 - (at - low))[:, None] + m[np.minimum(low + 1, len(m) - 1)] * (at - low)[:, None]

    k = np.arange(32)
    cosine = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64) * np.sqrt(np.where(k == 0, 1.0, 2.0) / 32)[:, None]
    small = along(along(np.frombuffer(grey, np.uint8).reshape(h, w).astype(float)).T).T
    want = (cosine @ small @ cosine.T)[:8, :8].ravel()
    rows = [("p", w, h, grey), ("q", 8, 8, bytes(64)), ("bad", w, h + 1, grey), ("null", None, h, grey), ("zero", 0, 0, b"")]
    frame = spark.createDataFrame(rows, "path string, width int, height int, grey binary")
    got = {r.path: r.coefficients for r in io.coefficients(frame).collect()}
    assert set(got) == {"p", "q"} and np.allclose(got["p"], want, atol=1e-9)
    assert io.coefficients(frame.where("false")).count() == 0


def test_hash_table_ties(spark):
    """Coefficients that equal the median aren't above it; the hashes of both noisy pictures were worked out with 60 digits."""
    tied = {
        "83d0b5a698ea429f": "66c88d8d94a4968479746a589b7b934b5293b8719a6f5e7078a73f8f8b8052835c5d7990a991796a3195b4703e8171918a4c9f8476a79c88673b696a8582a770",
        "b09aac73213f2547": "7083445f7668abb085946199a3a83d86694f7ca383936d59778d484174a58c946b91954e799d7a718a8d5e6e595b908c956b797a8e905658508354aa6244c990",
    }
    rows = [(want, 8, 8, bytes.fromhex(px)) for want, px in tied.items()] + [("8000000000000000", w, h, bytes([v] * (w * h))) for v, w, h in [(7, 8, 8), (255, 1, 1), (91, 40, 33), (3, 3, 70)]]
    found = io.hash_table(spark.createDataFrame([*rows, ("0000000000000000", 5, 9, bytes(45))], "path string, width int, height int, grey binary")).collect()
    assert len(found) == 7 and [r for r in found if r.filename != r.phash_hex] == []


def test_directory_scan_opens_no_file(spark, tmp_path):
    from sparkverity.session import new_dir

    folder = new_dir(spark, "pictures")
    files = [(f"a/{k}/p{k}.{end}", bytes(k + 1)) for k, end in enumerate(["png", "JPG", "txt", "jpeg"])] + [("none.png", None)]
    frame = spark.createDataFrame(files, "path string, content binary")
    assert io.write_files(frame, folder) == 5 == io.write_files(frame, folder)
    listed = io.image_listing(spark, folder)
    assert {r.path: r.bytes for r in listed.collect()} == {"a/0/p0.png": 1, "a/1/p1.JPG": 2, "a/3/p3.jpeg": 4}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert all(r.modified is not None for r in listed.collect()) and io.write_files(frame.where("false"), folder) == 0


def test_stream_reads_one_index(spark, monkeypatch):
    """Several batches, one index: it is written once and every batch's nearest pictures are right."""
    from sparkverity.operators import hashing as HJ
    from sparkverity.session import new_dir
    from sparkverity.streaming import verify as V

    rng = random.Random(2)
    known = [(k, rng.getrandbits(64)) for k in range(50)]
    index = HJ.build_index(spark.createDataFrame([(k, f"{h:016x}") for k, h in known], "ref_id long, hex string"))
    monkeypatch.setattr(HJ, "build_index", None)  # a batch that built one would fail
    hashes = {k: known[k][1] ^ ((1 << (k % 13)) - 1) for k in range(30)}
    claims = spark.createDataFrame([(k, f"{hashes[k]:016x}" if k < 30 else None) for k in range(36)], "claim_id long, img_hash string")
    for column in io.CLAIMS.split(", ")[1:]:
        name, kind = column.split()
        if name != "claim_id":
            claims = claims.withColumn(name, F.lit("2024-01-01" if kind == "timestamp" else 0.4 if kind == "double" else None).cast(kind))
    source, out = new_dir(spark, "in"), []
    claims.select(*io.columns(io.CLAIMS), "img_hash").repartition(4).write.parquet(source)
    sink = lambda batch, k: out.append([(r.claim_id, r.phash_score) for r in batch.collect()])
    V.start_with_hashes(V.read_claim_stream(spark, source, files=1, more=", img_hash string"), index, sink, new_dir(spark, "state"), late="10000 days").awaitTermination()
    assert len([batch for batch in out if batch]) >= 3
    score = lambda d: 1.0 if d <= 5 else 0.7 if d <= 10 else 0.0
    want = {k: score(min(bin(h ^ x).count("1") for _, x in known)) for k, h in hashes.items()} | {k: None for k in range(30, 36)}
    assert dict(r for batch in out for r in batch) == want


def test_text_predictor_hook(spark):
    from sparkverity.operators import icd

    def load():
        calls = []

        def predict(texts):
            calls.append(len(texts))
            return [{"I10": 0.5, "E11": None} if "a" in t else [("J45", 0.25)] if t else [] for t in texts]

        return predict

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None), (None, "a"), (1, "a")], "doc_id long, text string")
    got = sorted(map(tuple, icd.predicted_by(docs, load).collect()), key=str)
    assert got == sorted([(d, *r) for d in (1, 1, None) for r in ((1, "I10", 0.5), (2, "E11", 0.0))] + [(2, 1, "J45", 0.25)], key=str)
    assert icd.predicted_by(docs.limit(0), load).count() == 0


def test_reports(spark, tmp_path):
    from sparkverity.operators import claims as C

    claim = spark.createDataFrame([(1, "P", "asthma", 10.0, 0, None, None, 0.1, 0.1, None)], "claim_id long, patient_id string, clinical_text string, claim_amount double, previous_claim_count int, img_patient_id string, img_modality string, cnn_score double, ela_score double, phash_score double")
    io.write_reports(C.verify(claim), str(tmp_path / "r"))
    back = spark.read.text(str(tmp_path / "r"))
    assert json.loads(back.first().value)["claim_id"] == 1 and back.select(F.col("recommendation")).first()[0] == "approve"
