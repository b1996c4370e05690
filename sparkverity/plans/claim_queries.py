"""Queries over claims, predictions and image hashes: one per operator, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkverity.functions import hashing as H
from sparkverity.functions import image as I
from sparkverity.functions import text as T
from sparkverity.operators import claims as C
from sparkverity.operators import hashing as HJ
from sparkverity.operators import icd
from sparkverity.sources.views import Inputs, query

c = F.col
RE = r"\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Za-z]{1,4})?)\b"
DECLARED = rf"list_sort(list_distinct(list_transform(regexp_extract_all(clinical_text, '{RE}', 1, 'i'), lambda x: upper(x))))"
FUSED = "(coalesce(cnn_score, 0.5::double) * 0.55::double + coalesce(ela_score, 0.5::double) * 0.25::double + coalesce(phash_score, 0.5::double) * 0.2::double)"
HH, HS = "coalesce(phash_score > 0.8::double, false)", "coalesce(phash_score > 0.6::double, false)"
CS, ES = "coalesce(cnn_score > 0.35::double, false)", "coalesce(ela_score > 0.35::double, false)"
VERDICT = f"""CASE WHEN cnn_score IS NULL OR ela_score IS NULL THEN 'error' WHEN {HH} OR {FUSED} >= 0.5::double OR ({CS} AND {ES}) THEN 'tampered'
 WHEN {CS}::int + {ES}::int + {HS}::int >= 2 OR {FUSED} >= 0.3::double OR {HS} THEN 'suspicious' ELSE 'authentic' END"""
KW = "(VALUES " + ",".join(f"({n},'{k}','{code}',{p}::double)" for n, (k, code, p) in enumerate(icd.KEYWORDS)) + ") AS kw(ord, word, code, prob)"
FB = "(VALUES " + ",".join(f"({n},'{code}',{p}::double)" for n, (code, p) in enumerate(icd.FALLBACK)) + ") AS fb(ord, code, prob)"
DOC_ID = r"""coalesce(nullif(regexp_extract(clinical_text, 'TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-\d{3}'), ''), nullif(regexp_extract(clinical_text, 'Patient\s+ID[:\s]+([A-Z0-9\-]+)', 1, 'i'), ''),
 nullif(regexp_extract(clinical_text, 'MRN[:\s]+([0-9]+)', 1, 'i'), ''), nullif(regexp_extract(clinical_text, 'Subject\s+ID[:\s]+([A-Z0-9\-]+)', 1, 'i'), ''))"""
GROUPS = "list_filter([" + ",".join(f"CASE WHEN regexp_matches(clinical_text, '{p}', 'i') THEN '{k}' END" for k, p in T.DIAGNOSIS_GROUPS.items()) + "], lambda x: x IS NOT NULL)"

# The whole flow in SQL, step by step.
FLOW = f"""k AS (SELECT claim_id, kw.ord, kw.code, kw.prob FROM claims, {KW} WHERE contains(lower(clinical_text), word)),
p AS (SELECT * FROM k UNION ALL SELECT claim_id, fb.ord, fb.code, fb.prob FROM claims, {FB} WHERE claim_id NOT IN (SELECT claim_id FROM k)),
p5 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ord) AS rn FROM p),
s AS (SELECT claim_id, round(max(prob), 4) AS match_score, count(*)::int AS num_icds FROM p5 WHERE rn <= 5 GROUP BY claim_id),
a AS (SELECT *, CASE WHEN match_score >= 0.8::double THEN 'valid' WHEN match_score >= 0.6::double THEN 'uncertain' ELSE 'flagged' END AS icd_status,
 {VERDICT} AS image_verdict, {DOC_ID} AS doc_pid, {GROUPS} AS groups FROM claims JOIN s USING (claim_id)),
b AS (SELECT *, CASE WHEN image_verdict = 'error' THEN 0::double ELSE round({FUSED}, 4) END AS fused,
 greatest(0, 100 - CASE WHEN doc_pid IS NOT NULL AND img_patient_id IS NOT NULL THEN CASE WHEN lower(doc_pid) <> lower(img_patient_id) THEN 40 ELSE 0 END
  WHEN doc_pid IS NULL AND img_patient_id IS NULL THEN 30 ELSE 15 END
  - CASE WHEN len(groups) > 0 AND NOT list_contains(groups, 'colon_cancer') THEN 25 ELSE 0 END
  - CASE WHEN img_modality IS NOT NULL AND NOT regexp_matches(img_modality, '(ct)|(mr)|(pt)|(ot)', 'i') THEN 10 ELSE 0 END) AS hundredths FROM a),
d AS (SELECT *, CASE WHEN hundredths >= 85 THEN 'matched' WHEN hundredths >= 60 THEN 'uncertain' ELSE 'unmatched' END AS identity_status,
 round(least(1::double, greatest(0::double, CASE WHEN match_score < 0.6::double THEN 0.25::double ELSE 0::double END + CASE WHEN fused > 0.5::double THEN 0.3::double ELSE 0::double END
  + CASE WHEN claim_amount > 10000 THEN 0.15::double WHEN claim_amount > 5000 THEN 0.1::double ELSE 0::double END
  + CASE WHEN previous_claim_count > 3 THEN 0.2::double WHEN previous_claim_count > 1 THEN 0.1::double ELSE 0::double END)) * 100::double, 2) AS pct FROM b),
e AS (SELECT *, CASE WHEN pct >= 75 THEN 'critical' WHEN pct >= 50 THEN 'high' WHEN pct >= 25 THEN 'medium' ELSE 'low' END AS level FROM d),
f AS (SELECT *, (icd_status = 'valid')::int + (image_verdict = 'authentic')::int + (identity_status = 'matched')::int + (level = 'low')::int AS signals FROM e),
g AS (SELECT *, CASE WHEN image_verdict = 'error' THEN 'manual_review' WHEN identity_status = 'unmatched' THEN 'review' WHEN signals >= 3 THEN 'approve' WHEN signals >= 1 THEN 'review' ELSE 'reject' END AS recommendation,
 CASE WHEN image_verdict = 'error' THEN 0::double WHEN identity_status = 'unmatched' THEN 0.85::double WHEN signals = 4 THEN 0.98::double WHEN signals = 3 THEN 0.9::double
  WHEN signals = 2 THEN 0.65::double WHEN signals = 1 THEN 0.5::double ELSE 0.92::double END AS confidence FROM f)"""


def flow(select: str) -> str:
    return f"WITH {FLOW} {select}"


def verified(x: Inputs) -> DataFrame:
    return C.verify(x.claims)


@query("v23_verify_claims", "claims", sql=flow("SELECT claim_id, icd_status, match_score, image_verdict, fused, identity_status, pct, level, recommendation, confidence FROM g"))
def v23(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", c("icd.status").alias("icd_status"), c("icd.match_score").alias("match_score"), c("image.verdict").alias("image_verdict"), c("image.fused").alias("fused"), c("identity.status").alias("identity_status"), c("fraud.pct").alias("pct"), c("fraud.level").alias("level"), c("verdict.recommendation").alias("recommendation"), c("verdict.confidence").alias("confidence"))


@query("v20_verdict_counts", "claims", sql=flow("SELECT recommendation, level, count(*) AS n FROM g GROUP BY ALL"))
def v20(x: Inputs) -> DataFrame:
    return verified(x).groupBy(c("verdict.recommendation").alias("recommendation"), c("fraud.level").alias("level")).agg(F.count("*").alias("n"))


@query("j16_section_assembly", "claims", sql=flow("SELECT claim_id, num_icds, image_verdict = 'error' AS image_failed, hundredths / 100::double AS identity_score, pct, recommendation FROM g"))
def j16(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", c("icd.num_icds").alias("num_icds"), (~c("image.success")).alias("image_failed"), c("identity.score").alias("identity_score"), c("fraud.pct").alias("pct"), c("verdict.recommendation").alias("recommendation"))


@query("a29_positive_signals", "claims", sql=flow("SELECT signals, count(*) AS n FROM g GROUP BY signals"))
def a29(x: Inputs) -> DataFrame:
    return verified(x).groupBy(C.positive_signals().alias("signals")).agg(F.count("*").alias("n"))


@query("v5_keyword_predictor", "claims", sql=flow("SELECT claim_id, rn::int AS rank, code, prob FROM p5"))
def v5(x: Inputs) -> DataFrame:
    pairs = x.claims.select("claim_id", F.posexplode(icd.keyword_predictions(c("clinical_text"))).alias("pos", "p"))
    return pairs.select("claim_id", (c("pos") + 1).alias("rank"), c("p.code").alias("code"), c("p.prob").alias("prob"))


@query("x1_text_predictor", "claims", sql=flow("SELECT claim_id, rn::int AS rank, code, prob FROM p5"))
def x1(x: Inputs) -> DataFrame:
    """The keyword predictor behind the hook for models of the caller's."""
    return icd.predicted_by(x.claims.select("claim_id", c("clinical_text").alias("text")), icd.keyword_predictor, "claim_id")


@query("v6_icd_status", "claims", sql=flow("SELECT icd_status, num_icds, count(*) AS n, round(sum(match_score), 6) AS total FROM g GROUP BY ALL"))
def v6(x: Inputs) -> DataFrame:
    return verified(x).groupBy(c("icd.status").alias("icd_status"), c("icd.num_icds").alias("num_icds")).agg(F.count("*").alias("n"), F.round(F.sum("icd.match_score"), 6).alias("total"))


@query("a28_document_code_score", "claims", sql=flow("SELECT claim_id, match_score FROM s"))
def a28(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", icd.code_check(c("clinical_text"))["match_score"].alias("match_score"))


@query("v7_image_verdict", "claims", sql=f"SELECT claim_id, {VERDICT} AS verdict, CASE {VERDICT} WHEN 'error' THEN 'low' WHEN 'suspicious' THEN 'medium' ELSE 'high' END AS confidence FROM claims")
def v7(x: Inputs) -> DataFrame:
    verdict = C.image_verdict(c("cnn_score"), c("ela_score"), c("phash_score"))
    return x.claims.select("claim_id", verdict.alias("verdict"), C.image_confidence(verdict).alias("confidence"))


CONTENT = """q AS (SELECT claim_id, clinical_text, coalesce(cnn_score, 0::double) AS cnn, coalesce(ela_score, 0::double) AS ela, phash_score AS phash FROM claims)"""


def content(x: Inputs) -> DataFrame:
    """Claims with the image scores that came with them."""
    return x.claims.select("claim_id", "clinical_text", F.coalesce("cnn_score", F.lit(0.0)).alias("cnn"), F.coalesce("ela_score", F.lit(0.0)).alias("ela"), c("phash_score").alias("phash"))


@query("f14_content_hash_scores", "claims", sql=f"WITH {CONTENT} SELECT md5(clinical_text) AS content, count(*) AS n, max(cnn) AS cnn, max(ela) AS ela, max(phash) AS phash FROM q GROUP BY ALL")
def f14(x: Inputs) -> DataFrame:
    """Equal contents share their scores: the largest given for any of them."""
    return content(x).groupBy(F.md5(c("clinical_text").cast("binary")).alias("content")).agg(F.count("*").alias("n"), *(F.max(k).alias(k) for k in ("cnn", "ela", "phash")))


RENORM = "CASE WHEN phash IS NULL THEN (0.55::double * cnn + 0.25::double * ela) / 0.8::double ELSE 0.55::double * cnn + 0.25::double * ela + 0.2::double * phash END"


@query("f13_renormalised_fusion", "claims", sql=f"WITH {CONTENT} SELECT claim_id, round({RENORM}, 9) AS fused FROM q")
def f13(x: Inputs) -> DataFrame:
    return content(x).select("claim_id", F.round(I.fuse_renormalised(c("cnn"), c("ela"), c("phash")), 9).alias("fused"))


@query("v8_content_verdict", "claims", sql=f"""WITH {CONTENT}, r AS (SELECT *, {RENORM} AS fused FROM q)
SELECT claim_id, CASE WHEN coalesce(phash > 0.8::double, false) OR fused >= 0.5::double OR (cnn > 0.35::double AND ela > 0.35::double) THEN 'tampered'
 WHEN fused >= 0.3::double OR coalesce(phash > 0.6::double, false) OR cnn > 0.35::double OR ela > 0.35::double THEN 'suspicious' ELSE 'authentic' END AS verdict FROM r""")
def v8(x: Inputs) -> DataFrame:
    return content(x).select("claim_id", C.image_verdict_by_content(c("cnn"), c("ela"), c("phash")).alias("verdict"))


@query("v10_image_error_state", "claims", sql=f"SELECT claim_id, {VERDICT} <> 'error' AS success, CASE WHEN {VERDICT} = 'error' THEN 0::double ELSE round({FUSED}, 4) END AS fused FROM claims")
def v10(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", c("image.success").alias("success"), c("image.fused").alias("fused"))


@query("f12_fuse_scores", "claims", sql=f"SELECT claim_id, round({FUSED}, 9) AS fused FROM claims")
def f12(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", F.round(I.fuse(c("cnn_score"), c("ela_score"), c("phash_score")), 9).alias("fused"))


@query("v11_identity_score", "claims", sql=flow("SELECT claim_id, hundredths / 100::double AS score FROM g"))
def v11(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", c("identity.score").alias("score"))


NO_EVIDENCE = "(doc_pid IS NOT NULL AND img_patient_id IS NOT NULL AND lower(doc_pid) = lower(img_patient_id) AND (len(groups) = 0 OR list_contains(groups, 'colon_cancer')) AND (img_modality IS NULL OR regexp_matches(img_modality, '(ct)|(mr)|(pt)|(ot)', 'i')))"


@query("v12_identity_status", "claims", sql=flow(f"SELECT claim_id, identity_status AS status, CASE WHEN hundredths >= 90 AND {NO_EVIDENCE} THEN 'high' WHEN hundredths >= 70 THEN 'medium' ELSE 'low' END AS confidence FROM g"))
def v12(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", c("identity.status").alias("status"), c("identity.confidence").alias("confidence"))


@query("v13_identity_evidence", "claims", sql=flow("""SELECT claim_id, concat_ws(' / ', CASE WHEN lower(doc_pid) <> lower(img_patient_id) THEN 'Patient ID mismatch: Document=' || doc_pid || ', Image=' || img_patient_id
 WHEN doc_pid IS NULL AND img_patient_id IS NULL THEN 'No patient IDs found in document or image' WHEN doc_pid IS NULL OR img_patient_id IS NULL THEN 'One side has Patient ID, other doesn''t' END,
 CASE WHEN len(groups) > 0 AND NOT list_contains(groups, 'colon_cancer') THEN 'Diagnosis mismatch with TCGA-COAD: Document mentions [''' || array_to_string(groups, ''', ''') || '''] (expected colon cancer)' END,
 CASE WHEN NOT regexp_matches(img_modality, '(ct)|(mr)|(pt)|(ot)', 'i') THEN 'Unexpected modality: ' || img_modality || ' (TCGA-COAD usually has CT/MR)' END) AS evidence FROM g"""))
def v13(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", F.array_join("identity.evidence", " / ").alias("evidence"))


@query("f21_document_patient_id", "claims", sql=f"SELECT claim_id, {DOC_ID} AS doc_pid FROM claims")
def f21(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", T.document_patient_id(c("clinical_text")).alias("doc_pid"))


@query("f22_diagnosis_groups", "claims", sql=f"SELECT claim_id, array_to_string({GROUPS}, ',') AS groups FROM claims")
def f22(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", F.array_join(T.diagnosis_groups(c("clinical_text")), ",").alias("groups"))


@query("f23_code_scope", "claims", sql=f"SELECT claim_id, array_to_string(list_filter({DECLARED}, lambda x: substr(x, 1, 3) IN ('C18', 'C19', 'C20', 'C25')), ',') AS codes FROM claims")
def f23(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", F.array_join(T.in_scope(T.declared_codes(c("clinical_text"))), ",").alias("codes"))


@query("f24_modality_allowed", "claims", sql="SELECT img_modality, regexp_matches(img_modality, '(ct)|(mr)|(pt)|(ot)', 'i') AS allowed, count(*) AS n FROM claims GROUP BY ALL")
def f24(x: Inputs) -> DataFrame:
    return x.claims.groupBy("img_modality", C.modality_allowed(c("img_modality")).alias("allowed")).agg(F.count("*").alias("n"))


FOUND, NOT_FOUND = "' found in TCGA-COAD database'", "' NOT in TCGA-COAD (could indicate missing data or external patient)'"
REFERENCE = f"""ref AS (SELECT DISTINCT patientid FROM headers), ids AS (SELECT claim_id, 'document' AS side, {DOC_ID} AS pid FROM claims UNION ALL SELECT claim_id, 'image', img_patient_id FROM claims),
fd AS (SELECT claim_id, side, 'Patient ' || pid || CASE WHEN r.patientid IS NOT NULL THEN {FOUND} ELSE {NOT_FOUND} END AS finding FROM ids LEFT JOIN ref r ON r.patientid = pid WHERE pid IS NOT NULL)"""


@query("j13_reference_population", "claims", "headers", sql=f"WITH {REFERENCE} SELECT claim_id, side, finding FROM fd")
def j13(x: Inputs) -> DataFrame:
    return C.patient_findings(C.claim_ids(x.claims), x.headers)


@query("v13_reference_findings", "claims", "headers", sql=f"""WITH {REFERENCE}, cd AS (SELECT claim_id, {DECLARED} AS codes FROM claims), sc AS (SELECT *, list_filter(codes, lambda x: substr(x, 1, 3) IN ('C18', 'C19', 'C20', 'C25')) AS scope FROM cd),
pf AS (SELECT claim_id, string_agg(finding, ' / ' ORDER BY side) AS found FROM fd GROUP BY claim_id)
SELECT claim_id, concat_ws(' / ', found, CASE WHEN len(scope) > 0 THEN 'ICD codes consistent with TCGA-COAD scope: [''' || array_to_string(scope, ''', ''') || ''']'
 WHEN len(codes) > 0 THEN 'Warning: ICD codes [''' || array_to_string(codes, ''', ''') || '''] may be outside TCGA-COAD typical scope' END) AS findings FROM sc LEFT JOIN pf USING (claim_id)""")
def v13b(x: Inputs) -> DataFrame:
    return C.reference_findings(x.claims, x.headers).select("claim_id", F.array_join("findings", " / ").alias("findings"))


@query("p7_feature_row", "claims", sql=flow("""SELECT claim_id, match_score AS icd_match_score, coalesce(cnn_score, 0::double) AS cnn_forgery_score, ela_score, coalesce(phash_score, 0::double) AS phash_score, fused AS final_image_forgery_score,
 hundredths / 100::double AS patient_match_score, round(ln(1 + claim_amount), 9) AS claim_amount_log, previous_claim_count::double AS previous_claim_count FROM g"""))
def p7(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", "features.*").withColumn("claim_amount_log", F.round("claim_amount_log", 9))


@query("p18_feature_rounding", "claims", sql=flow("SELECT claim_id, round(coalesce(cnn_score, 0::double), 4) AS cnn_forgery_score, round(ela_score, 4) AS ela_score, round(ln(1 + claim_amount), 4) AS claim_amount_log FROM g"))
def p18(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", *(F.round(F.coalesce(c(f"features.{f}"), F.lit(0.0)), 4).alias(f) for f in ("cnn_forgery_score", "ela_score", "claim_amount_log")))


def training(x: Inputs) -> DataFrame:
    fused = I.fuse(c("cnn_score"), c("ela_score"), c("phash_score"))
    rows = verified(x).select("claim_id", "features.*", "claim_amount", fused.alias("_fused"))
    return rows.withColumn("fraud", C.training_label(c("icd_match_score"), c("_fused")).cast("int"))


@query("p8_training_features", "claims", sql=flow("SELECT claim_id, match_score AS icd_match_score, round(ln(1 + claim_amount), 9) AS claim_amount_log, previous_claim_count::double AS previous_claim_count FROM g"))
def p8(x: Inputs) -> DataFrame:
    return training(x).drop("claim_amount").select("claim_id", "icd_match_score", F.round("claim_amount_log", 9).alias("claim_amount_log"), "previous_claim_count")


@query("v19_training_label", "claims", sql="SELECT claim_id, CASE WHEN ela_score < 0.4::double AND phash_score > 0.7::double THEN 1 ELSE 0 END AS fraud FROM claims")
def v19(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", C.training_label(c("ela_score"), c("phash_score")).cast("int").alias("fraud"))


GAPS = "SELECT claim_id, CASE WHEN claim_id % 7 = 0 THEN NULL ELSE 0.5::double END AS icd_match_score, cnn_score AS cnn_forgery_score, ela_score, coalesce(phash_score, 0::double) AS phash_score, 0.4::double AS final_image_forgery_score, CASE WHEN claim_id % 3 = 0 THEN 0.9::double END AS patient_match_score, 8::double AS claim_amount_log, 1::double AS previous_claim_count FROM claims"


def gaps(x: Inputs) -> DataFrame:
    return x.claims.select(
        "claim_id", F.when(c("claim_id") % 7 != 0, 0.5).alias("icd_match_score"), c("cnn_score").alias("cnn_forgery_score"), "ela_score", F.coalesce("phash_score", F.lit(0.0)).alias("phash_score"),
        F.lit(0.4).alias("final_image_forgery_score"), F.when(c("claim_id") % 3 == 0, 0.9).alias("patient_match_score"), F.lit(8.0).alias("claim_amount_log"), F.lit(1.0).alias("previous_claim_count"),
    )


MISSING = "concat_ws(',', CASE WHEN icd_match_score IS NULL THEN 'icd_match_score' END, CASE WHEN cnn_forgery_score IS NULL THEN 'cnn_forgery_score' END)"


@query("p9_required_features", "claims", sql=f"WITH g AS ({GAPS}) SELECT claim_id, coalesce(patient_match_score, 0.5::double) AS patient_match_score, icd_match_score FROM g WHERE {MISSING} = ''")
def p9(x: Inputs) -> DataFrame:
    return C.complete_features(gaps(x)).select("claim_id", "patient_match_score", "icd_match_score")


@query("u4_missing_feature_names", "claims", sql=f"WITH g AS ({GAPS}) SELECT {MISSING} AS missing, count(*) AS n FROM g GROUP BY ALL")
def u4(x: Inputs) -> DataFrame:
    return gaps(x).groupBy(F.array_join(C.missing_features(gaps(x)), ",").alias("missing")).agg(F.count("*").alias("n"))


@query("f18_log_amount", "claims", sql="SELECT claim_id, round(ln(1 + claim_amount), 6) AS amount_log, round(exp(ln(1 + claim_amount)) - 1, 4) AS amount FROM claims")
def f18(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", F.round(F.log1p("claim_amount"), 6).alias("amount_log"), F.round(F.exp(F.log1p("claim_amount")) - 1, 4).alias("amount"))


@query("f19_clamp", "claims", sql="SELECT claim_id, greatest(0::double, least(1::double, claim_amount / 5000::double - 0.5::double)) AS v FROM claims")
def f19(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", I.clamp(c("claim_amount") / 5000.0 - 0.5).alias("v"))


@query("v14_fraud_probability", "claims", sql=flow("SELECT claim_id, pct FROM g"))
def v14(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", c("fraud.pct").alias("pct"))


@query("v15_fraud_level", "claims", sql=flow("SELECT level, CASE level WHEN 'critical' THEN 'reject' WHEN 'low' THEN 'approve' ELSE 'review' END AS action, count(*) AS n FROM g GROUP BY ALL"))
def v15(x: Inputs) -> DataFrame:
    return verified(x).groupBy(c("fraud.level").alias("level"), c("fraud.recommendation").alias("action")).agg(F.count("*").alias("n"))


FACTORS = """coalesce(nullif(concat_ws('; ', CASE WHEN match_score < 0.6::double THEN 'ICD code mismatch: Low confidence diagnosis validation (score: ' || printf('%.2f', match_score) || ')' END,
 CASE WHEN fused > 0.6::double THEN 'Image manipulation detected: High forgery likelihood (score: ' || printf('%.2f', fused) || ')' END,
 CASE WHEN cnn_score > 0.7::double THEN 'CNN detects image tampering: CNN forgery score ' || printf('%.2f', cnn_score) END,
 CASE WHEN ela_score > 0.6::double THEN 'Error Level Analysis alert: Significant compression inconsistencies (ELA: ' || printf('%.2f', ela_score) || ')' END,
 CASE WHEN ln(1 + claim_amount) > 7 THEN 'High claim amount: Large financial exposure (log amount: ' || printf('%.2f', ln(1 + claim_amount)) || ')' END,
 CASE WHEN previous_claim_count > 5 THEN 'Frequent claimant: Multiple previous claims on record (' || previous_claim_count || ')' END), ''), 'No major risk factors identified')"""


@query("v16_risk_factors", "claims", sql=flow(f"SELECT claim_id, {FACTORS} AS factors FROM g"))
def v16(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", F.array_join("fraud.factors", "; ").alias("factors"))


@query("v17_fraud_explanation", "claims", sql=flow(f"""SELECT claim_id, CASE level WHEN 'critical' THEN 'CRITICAL FRAUD RISK' WHEN 'high' THEN 'HIGH FRAUD RISK' WHEN 'medium' THEN 'MODERATE FRAUD RISK' ELSE 'LOW FRAUD RISK' END
 || ': Fraud risk score is ' || printf('%.1f', pct) || '%. ' || CASE WHEN {FACTORS} = 'No major risk factors identified' THEN 'Claim appears legitimate based on all validation checks.'
 ELSE 'Key indicators: ' || array_to_string(list_slice(string_split({FACTORS}, '; '), 1, 2), '; ') || '.' END AS explanation FROM g"""))
def v17(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", C.fraud_explanation(c("fraud.level"), c("fraud.pct"), c("fraud.factors")).alias("explanation"))


@query("t2_list_caps", "claims", sql=flow(f"SELECT claim_id, array_to_string(list_slice(string_split({FACTORS}, '; '), 1, 2), '; ') AS first_two FROM g"))
def t2(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", F.array_join(F.slice("fraud.factors", 1, 2), "; ").alias("first_two"))


@query("v18_three_level_risk", "claims", sql=flow("SELECT claim_id, CASE WHEN pct <= 30 THEN 'LOW' WHEN pct <= 70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk, concat_ws(', ', CASE WHEN match_score < 0.4::double THEN 'Low ICD match score' END, CASE WHEN fused > 0.7::double THEN 'High image forgery confidence' END) AS drivers FROM g"))
def v18(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", C.three_level_risk(c("fraud.pct")).alias("risk"), F.array_join(C.rule_drivers(c("icd.match_score"), c("image.fused")), ", ").alias("drivers"))


EXPLAINED = """printf('%.3f', {0})"""
IMAGE_TEXT = f"""CASE WHEN image_verdict = 'error' THEN 'Image score missing' WHEN image_verdict = 'tampered' THEN 'HIGH RISK: Image shows strong signs of tampering (fused score: ' || printf('%.3f', {FUSED}) || '). Risk factors: ' || concat_ws('; ',
  CASE WHEN {HH} THEN 'pHash dissimilarity very high (score: ' || printf('%.3f', phash_score) || ')' END, CASE WHEN {CS} THEN 'CNN tampering probability high (' || printf('%.3f', cnn_score) || ')' END, CASE WHEN {ES} THEN 'ELA anomalies detected (' || printf('%.3f', ela_score) || ')' END) || '. Image significantly differs from authentic samples.'
 WHEN image_verdict = 'suspicious' THEN 'MODERATE RISK: Image may contain alterations (fused score: ' || printf('%.3f', {FUSED}) || '). Concerns: ' || concat_ws('; ',
  CASE WHEN {HS} THEN 'pHash dissimilarity (score: ' || printf('%.3f', phash_score) || ')' END, CASE WHEN {CS} THEN 'CNN score (' || printf('%.3f', cnn_score) || ')' END, CASE WHEN {ES} THEN 'ELA score (' || printf('%.3f', ela_score) || ')' END) || '. Recommend manual review for potential manipulation.'
 ELSE 'LOW RISK: Image appears authentic (fused score: ' || printf('%.3f', {FUSED}) || '). All metrics within acceptable ranges (CNN: ' || printf('%.3f', cnn_score) || ', ELA: ' || printf('%.3f', ela_score) || ', pHash: ' || coalesce(printf('%.3f', phash_score), 'N/A') || ').' END"""


ICD_TEXT = "CASE icd_status " + " ".join(f"WHEN '{k}' THEN '{a}' || printf('%.2f', match_score) || '{b}'" for k, (a, b) in icd.STATUS_TEXT.items()) + " END"
FRAUD_TEXT = f"""CASE level WHEN 'critical' THEN 'CRITICAL FRAUD RISK' WHEN 'high' THEN 'HIGH FRAUD RISK' WHEN 'medium' THEN 'MODERATE FRAUD RISK' ELSE 'LOW FRAUD RISK' END
 || ': Fraud risk score is ' || printf('%.1f', pct) || '%. ' || CASE WHEN {FACTORS} = 'No major risk factors identified' THEN 'Claim appears legitimate based on all validation checks.'
 ELSE 'Key indicators: ' || array_to_string(list_slice(string_split({FACTORS}, '; '), 1, 2), '; ') || '.' END"""
EVIDENCE = """concat_ws(chr(10) || '  • ', CASE WHEN lower(doc_pid) <> lower(img_patient_id) THEN 'Patient ID mismatch: Document=' || doc_pid || ', Image=' || img_patient_id
 WHEN doc_pid IS NULL AND img_patient_id IS NULL THEN 'No patient IDs found in document or image' WHEN doc_pid IS NULL OR img_patient_id IS NULL THEN 'One side has Patient ID, other doesn''t' END,
 CASE WHEN len(groups) > 0 AND NOT list_contains(groups, 'colon_cancer') THEN 'Diagnosis mismatch with TCGA-COAD: Document mentions [''' || array_to_string(groups, ''', ''') || '''] (expected colon cancer)' END,
 CASE WHEN NOT regexp_matches(img_modality, '(ct)|(mr)|(pt)|(ot)', 'i') THEN 'Unexpected modality: ' || img_modality || ' (TCGA-COAD usually has CT/MR)' END)"""
IDENTITY_SQL = f"""'🔗 PATIENT IDENTITY CONSISTENCY CHECK' || chr(10) || repeat('=', 50) || chr(10) || CASE identity_status {' '.join(f"WHEN '{k}' THEN '{t}'" for k, t in C.IDENTITY_TEXT.items())} END || chr(10) || chr(10)
 || 'Document Patient ID: ' || coalesce(doc_pid, 'Not found') || chr(10) || 'Image Patient ID: ' || coalesce(img_patient_id, 'Not found') || chr(10) || chr(10)
 || CASE WHEN {EVIDENCE} = '' THEN '✓ No explicit inconsistencies detected' ELSE 'Identified Inconsistencies:' || chr(10) || '  • ' || {EVIDENCE} END || chr(10) || chr(10) || repeat('=', 50)"""
SUMMARY = """CASE WHEN image_verdict = 'error' THEN 'One or more modules encountered errors; manual review required.'
 WHEN identity_status = 'unmatched' THEN 'Document and image appear to belong to different patients; manual review required.'
 WHEN signals = 4 THEN 'All validation checks passed. Claim appears legitimate and all documents link to same patient.' WHEN signals = 3 THEN 'Most validation checks passed. Patient identity and primary claims verified.'
 WHEN signals = 2 THEN 'Some validation checks flagged. Manual review recommended.' WHEN signals = 1 THEN 'Multiple validation checks flagged. Manual review required.' ELSE 'Critical issues detected across validation modules.' END"""


@query("v6_icd_explanation", "claims", sql=flow(f"SELECT claim_id, {ICD_TEXT} AS explanation FROM g"))
def v6b(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", icd.status_text(c("icd.status"), c("icd.match_score")).alias("explanation"))


@query("v21_explanation", "claims", sql=flow(f"""SELECT claim_id, '🏥 ICD CODE VALIDATION: ' || upper(icd_status) || chr(10) || '   ' || {ICD_TEXT} || chr(10) || chr(10) || '🖼️  IMAGE ANALYSIS: ' || upper(image_verdict) || chr(10) || '   ' || {IMAGE_TEXT}
 || chr(10) || chr(10) || '🔗 PATIENT IDENTITY CHECK: ' || upper(identity_status) || ' (Score: ' || printf('%.2f', hundredths / 100::double) || ')' || chr(10) || '   ' || {IDENTITY_SQL}
 || chr(10) || chr(10) || '⚠️  FRAUD RISK ASSESSMENT: ' || upper(level) || chr(10) || '   ' || {FRAUD_TEXT} || chr(10) || chr(10) || '✅ FINAL VERDICT: ' || upper(recommendation) || chr(10) || '   ' || {SUMMARY} AS explanation FROM g"""))
def v21(x: Inputs) -> DataFrame:
    return verified(x).select("claim_id", C.explanation().alias("explanation"))


@query("p20_final_rationale", "claims", sql=flow("""SELECT claim_id, 'Recommendation=' || recommendation || ' with confidence=' || printf('%.0f', confidence * 100) || '%.' AS last_line,
 '3) Fraud module: risk=' || printf('%.1f', pct) || '% (' || level || ').' AS fraud_line FROM g"""))
def p20(x: Inputs) -> DataFrame:
    lines = F.split(C.rationale(), "\n")
    return verified(x).select("claim_id", lines[4].alias("last_line"), lines[3].alias("fraud_line"))


@query("p19_report_rows", "claims", sql=flow("""SELECT claim_id, section, label, value FROM (
 SELECT claim_id, 'Claim Overview' AS section, 'Claim ID' AS label, claim_id::varchar AS value FROM g UNION ALL SELECT claim_id, 'ICD Code Verification', 'Status', upper(icd_status) FROM g
 UNION ALL SELECT claim_id, 'Medical Image Analysis', 'pHash Score', coalesce(printf('%.3f', phash_score), 'N/A') FROM g UNION ALL SELECT claim_id, 'Fraud Risk Assessment', 'Fraud Risk Percentage', printf('%.1f', pct) || '%' FROM g
 UNION ALL SELECT claim_id, 'Integrated Verdict', 'Overall Recommendation', upper(recommendation) FROM g)"""))
def p19(x: Inputs) -> DataFrame:
    return C.report_rows(verified(x)).where(c("label").isin("Claim ID", "pHash Score", "Fraud Risk Percentage", "Overall Recommendation") | ((c("label") == "Status") & (c("section") == "ICD Code Verification"))).select("claim_id", "section", "label", "value")


FORM = "SELECT claim_id, CASE claim_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE cast(claim_id AS string) END AS amount, CASE claim_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '1.5x' ELSE '2' END AS prior, CASE WHEN claim_id % 17 = 0 THEN NULL ELSE 'a.png' END AS image, CASE WHEN claim_id % 5 = 0 THEN ' ' ELSE clinical_text END AS text, CASE WHEN claim_id % 2 = 0 THEN 'from file' END AS document FROM claims"


@query("p1_validate_claims", "claims", sql=f"""WITH f AS ({FORM}) SELECT claim_id, CASE WHEN amount IS NULL THEN 'Missing required field: claim_amount' WHEN try_cast(amount AS double) IS NULL THEN 'Invalid claim_amount: must be numeric'
 WHEN prior = '1.5x' THEN 'Invalid previous_claim_count: must be integer' WHEN image IS NULL THEN 'Missing required file field: image' WHEN coalesce(nullif(trim(text), ''), nullif(trim(document), '')) IS NULL THEN 'Missing clinical text or document' END AS error FROM f""")
def p1(x: Inputs) -> DataFrame:
    return x.sql(FORM, "claims").select("claim_id", C.input_error(c("amount"), c("prior"), c("image"), c("text"), c("document")).alias("error"))


@query("v22_quarantine", "claims", sql=f"""WITH f AS ({FORM}) SELECT 'manual_review' AS recommendation, count(*) AS n FROM f WHERE amount IS NULL OR try_cast(amount AS double) IS NULL OR prior = '1.5x' OR image IS NULL OR coalesce(nullif(trim(text), ''), nullif(trim(document), '')) IS NULL""")
def v22(x: Inputs) -> DataFrame:
    bad = x.sql(FORM, "claims").withColumn("error", C.input_error(c("amount"), c("prior"), c("image"), c("text"), c("document"))).where("error IS NOT NULL")
    report = bad.select("claim_id", F.lit(False).alias("success"), "error", F.struct(F.lit("manual_review").alias("recommendation"), F.lit(0.0).alias("confidence"), F.concat(F.lit("Pipeline error: "), c("error")).alias("summary")).alias("verdict"))
    return report.groupBy(c("verdict.recommendation").alias("recommendation")).agg(F.count("*").alias("n"))


@query("p2_allowed_extension", "headers", sql="SELECT file_path, lower(split_part(file_path, '.', -1)) IN ('png','jpg','jpeg','bmp','tiff','dcm') AS image_ok, lower(split_part(file_path, '.', -1)) IN ('pdf','txt','docx') AS document_ok FROM headers")
def p2(x: Inputs) -> DataFrame:
    return x.headers.select("file_path", T.extension_allowed(c("file_path"), C.IMAGE_EXTENSIONS).alias("image_ok"), T.extension_allowed(c("file_path"), C.DOCUMENT_EXTENSIONS).alias("document_ok"))


@query("p3_allowed_mime", "headers", sql="SELECT modality, CASE modality WHEN 'CT' THEN true WHEN 'MR' THEN false WHEN 'PT' THEN true ELSE true END AS allowed, count(*) AS n FROM headers GROUP BY ALL")
def p3(x: Inputs) -> DataFrame:
    mime = F.when(c("modality") == "CT", "image/png").when(c("modality") == "MR", "video/mp4").when(c("modality") == "PT", "application/dicom")
    return x.headers.groupBy("modality", T.mime_allowed(mime, C.IMAGE_MIMES).alias("allowed")).agg(F.count("*").alias("n"))


@query("p4_text_source", "claims", sql=f"WITH f AS ({FORM}) SELECT claim_id, coalesce(nullif(trim(text), ''), nullif(trim(document), '')) AS chosen FROM f")
def p4(x: Inputs) -> DataFrame:
    return x.sql(FORM, "claims").select("claim_id", T.chosen_text(c("text"), c("document")).alias("chosen"))


@query("p5_patient_identifier", "claims", sql=r"""SELECT claim_id, nullif(left(regexp_replace(trim(regexp_extract(chr(10) || 'x' || chr(10) || clinical_text, '(?im)^\s*patient\s*id\s*[:\-]\s*([^\n\r]+)', 1)), '\s+', ' ', 'g'), 120), '') AS pid FROM claims""")
def p5(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", T.patient_identifier(F.concat(F.lit("x\n"), c("clinical_text"))).alias("pid"))


@query("p6_text_excerpt", sql=r"SELECT doc_id, left(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1200) AS excerpt FROM documents")
def p6(x: Inputs) -> DataFrame:
    return x.documents.select("doc_id", T.excerpt(c("text")).alias("excerpt"))


@query("f1_declared_codes", "claims", sql=f"SELECT claim_id, array_to_string({DECLARED}, ',') AS codes FROM claims")
def f1(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", F.array_join(T.declared_codes(c("clinical_text")), ",").alias("codes"))


@query("f1_declared_codes_documents", sql=f"SELECT doc_id, array_to_string({DECLARED.replace('clinical_text', 'text')}, ',') AS codes FROM documents")
def f1d(x: Inputs) -> DataFrame:
    return x.documents.select("doc_id", F.array_join(T.declared_codes(c("text")), ",").alias("codes"))


@query("t5_sorted_distinct_codes", "claims", sql=f"SELECT array_to_string({DECLARED}, ',') AS codes, count(*) AS n FROM claims GROUP BY ALL")
def t5(x: Inputs) -> DataFrame:
    return x.claims.groupBy(F.array_join(T.declared_codes(c("clinical_text")), ",").alias("codes")).agg(F.count("*").alias("n"))


@query("f2_mask_codes", "claims", sql=f"SELECT claim_id, regexp_replace(clinical_text, '{RE}', '[ICD_CODE]', 'gi') AS masked FROM claims")
def f2(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", T.mask_codes(c("clinical_text")).alias("masked"))


@query("f3_normalize_code", "diagnoses", sql="SELECT replace(upper(trim(icd_code)), ' ', '') AS code, count(*) AS n FROM diagnoses GROUP BY ALL")
def f3(x: Inputs) -> DataFrame:
    return x.diagnoses.groupBy(T.normalize_code(c("icd_code")).alias("code")).agg(F.count("*").alias("n"))


EXPLICIT = r"regexp_extract_all(upper(clinical_text), '\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?)\b', 1)"
ORDERED = f"list_filter({EXPLICIT}, lambda v, i: list_position({EXPLICIT}, v) = i)"


@query("f4_explicit_codes", "claims", sql=f"SELECT claim_id, array_to_string({ORDERED}, ',') AS codes FROM claims")
def f4(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", F.array_join(T.explicit_codes(c("clinical_text")), ",").alias("codes"))


@query("u3_ordered_distinct", "claims", sql=f"SELECT claim_id, len({ORDERED})::int AS n FROM claims")
def u3(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", F.size(T.explicit_codes(c("clinical_text"))).alias("n"))


@query("f5_same_category", "predictions", sql="SELECT doc_id, code, substr(code, 1, 3) = 'J45' AS same FROM predictions")
def f5(x: Inputs) -> DataFrame:
    return x.predictions.select("doc_id", "code", T.same_category(c("code"), F.lit("J45.0")).alias("same"))


@query("f25_description_text", "claims", sql="SELECT claim_id, CASE WHEN claim_id % 3 = 0 THEN 'Diagnosis: Diagnosis code I10.' ELSE 'Diagnosis: ' || patient_id || '.' END AS text FROM claims")
def f25(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", T.description_text(F.when(c("claim_id") % 3 != 0, c("patient_id")).otherwise(""), F.lit("I10")).alias("text"))


@query("f26_epoch_of", "runs", sql="SELECT epoch::int AS parsed, count(*) AS n FROM runs GROUP BY ALL")
def f26(x: Inputs) -> DataFrame:
    return x.runs.groupBy(T.epoch_of(F.concat(F.lit("ckpt_epoch_"), c("epoch"), F.lit(".pth"))).alias("parsed")).agg(F.count("*").alias("n"))


@query("f27_number_formats", "claims", sql="SELECT claim_id, printf('%.2f', ela_score) AS two, printf('%.1f', ela_score * 100) || '%' AS pct, format('{:,.2f}', claim_amount) AS money FROM claims")
def f27(x: Inputs) -> DataFrame:
    return x.claims.select("claim_id", F.format_string("%.2f", "ela_score").alias("two"), F.concat(F.format_string("%.1f", c("ela_score") * 100.0), F.lit("%")).alias("pct"), T.money(c("claim_amount")).alias("money"))


@query("f28_missing_safe_float", "claims", sql=f"WITH f AS ({FORM}) SELECT claim_id, coalesce(try_cast(amount AS double), 0::double) AS amount FROM f")
def f28(x: Inputs) -> DataFrame:
    return x.sql(FORM, "claims").select("claim_id", T.missing_safe(c("amount")).alias("amount"))


# -- predictions and declared codes

TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, code) AS rank FROM predictions)"
DECL = f"d AS (SELECT claim_id AS doc_id, unnest({DECLARED}) AS declared FROM claims)"
SCORED = f"""{TOP}, {DECL}, ex AS (SELECT doc_id, code AS declared, max(prob) AS p FROM predictions GROUP BY ALL),
cat AS (SELECT doc_id, substr(code, 1, 3) AS cat, min_by(code, rank) AS code, min_by(prob, rank) AS p FROM r WHERE rank <= 10 GROUP BY ALL),
sc AS (SELECT d.doc_id, d.declared, CASE WHEN ex.p >= 0.5::double THEN 1::double WHEN cat.code IS NOT NULL THEN 0.6::double ELSE 0::double END AS score,
 CASE WHEN ex.p >= 0.5::double THEN 'exact_match' WHEN cat.code IS NOT NULL THEN 'same_category' ELSE 'mismatch' END AS match_type,
 CASE WHEN ex.p >= 0.5::double THEN ex.p ELSE cat.p END AS pred_prob, CASE WHEN coalesce(ex.p, 0) < 0.5::double THEN cat.code END AS pred_top
 FROM d LEFT JOIN ex USING (doc_id, declared) LEFT JOIN cat ON cat.doc_id = d.doc_id AND cat.cat = substr(d.declared, 1, 3))"""


def docs(x: Inputs) -> DataFrame:
    return x.claims.select(c("claim_id").alias("doc_id"), c("clinical_text").alias("text"))


def declared(x: Inputs) -> DataFrame:
    return docs(x).select("doc_id", F.explode(T.declared_codes(c("text"))).alias("declared"))


@query("w1_top_k", "predictions", sql=f"WITH {TOP} SELECT doc_id, rank::int AS rank, code, prob FROM r WHERE rank <= 5")
def w1(x: Inputs) -> DataFrame:
    return icd.top_k(x.predictions, 5).select("doc_id", "rank", "code", "prob")


@query("j7_exact_match", "predictions", "claims", sql=f"WITH {SCORED} SELECT doc_id, declared, pred_prob FROM sc WHERE match_type = 'exact_match'")
def j7(x: Inputs) -> DataFrame:
    return icd.score_declared(declared(x), x.predictions).where("match_type = 'exact_match'").select("doc_id", "declared", "pred_prob")


@query("j8_same_category", "predictions", "claims", sql=f"WITH {SCORED} SELECT doc_id, declared, pred_top, pred_prob FROM sc WHERE match_type = 'same_category'")
def j8(x: Inputs) -> DataFrame:
    return icd.score_declared(declared(x), x.predictions).where("match_type = 'same_category'").select("doc_id", "declared", "pred_top", "pred_prob")


@query("v1_score_declared", "predictions", "claims", sql=f"WITH {SCORED} SELECT doc_id, declared, score, match_type FROM sc")
def v1(x: Inputs) -> DataFrame:
    return icd.score_declared(declared(x), x.predictions).select("doc_id", "declared", "score", "match_type")


EXPLAIN = f"""{SCORED}, xp AS (SELECT c.claim_id AS doc_id, sc.declared, r.code AS predicted_top, coalesce(r.prob, 0::double) AS predicted_prob, coalesce(sc.match_type, 'no_declared') AS match_type, sc.score
 FROM claims c LEFT JOIN sc ON sc.doc_id = c.claim_id LEFT JOIN r ON r.doc_id = c.claim_id AND r.rank = 1)"""


@query("v2_explain_records", "predictions", "claims", sql=f"WITH {EXPLAIN} SELECT * FROM xp WHERE match_type <> 'no_declared'")
def v2(x: Inputs) -> DataFrame:
    return icd.explain(docs(x), x.predictions).where("match_type <> 'no_declared'")


@query("v3_evaluation_rows", "predictions", "claims", sql=f"WITH {EXPLAIN} SELECT doc_id, declared, match_type, score FROM xp")
def v3(x: Inputs) -> DataFrame:
    return icd.explain(docs(x), x.predictions).select("doc_id", "declared", "match_type", "score")


@query("v4_decision_lines", "predictions", "claims", sql=f"""WITH {EXPLAIN} SELECT doc_id, CASE WHEN declared IS NULL THEN 'No declared ICDs found.' ELSE 'Declared: ' || declared || ' | Predicted: ' || coalesce(predicted_top, 'None') || ' (p=' || printf('%.3f', predicted_prob) || ') | Match: ' || match_type
 || ' | Score: ' || printf('%.2f', score) || ' | Decision: ' || CASE WHEN score >= 0.6::double THEN 'ACCEPT' WHEN score >= 0.3::double THEN 'REVIEW' ELSE 'REJECT' END END AS line FROM xp""")
def v4(x: Inputs) -> DataFrame:
    e = icd.explain(docs(x), x.predictions)
    return e.select("doc_id", icd.decision_line(e).alias("line"))


@query("a7_match_type_counts", "predictions", "claims", sql=f"WITH {EXPLAIN} SELECT match_type, count(*) AS n FROM xp GROUP BY ALL")
def a7(x: Inputs) -> DataFrame:
    return icd.explain(docs(x), x.predictions).groupBy("match_type").agg(F.count("*").alias("n"))


@query("p13_low_score_cases", "predictions", "claims", sql=f"WITH {EXPLAIN} SELECT doc_id, declared, score FROM xp WHERE score <= 0.3::double")
def p13(x: Inputs) -> DataFrame:
    return icd.explain(docs(x), x.predictions).where("score <= 0.3D").select("doc_id", "declared", "score")


@query("a27_document_summary", "predictions", "claims", sql=f"SELECT claim_id AS doc_id, len({DECLARED})::int AS n_declared, coalesce(m, 0::double) AS max_prob FROM claims LEFT JOIN (SELECT doc_id, max(prob) AS m FROM predictions GROUP BY doc_id) ON doc_id = claim_id")
def a27(x: Inputs) -> DataFrame:
    best = x.predictions.groupBy("doc_id").agg(F.max("prob").alias("m"))
    return docs(x).join(best, "doc_id", "left").select("doc_id", F.size(T.declared_codes(c("text"))).alias("n_declared"), F.coalesce("m", F.lit(0.0)).alias("max_prob"))


COS = """list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda v: v::double * v::double))) * sqrt(list_sum(list_transform(b.embedding, lambda v: v::double * v::double))) + 1e-8)"""


@query("j9_related_codes", sql=f"""WITH p AS (SELECT a.vec_id AS declared, b.vec_id AS best_match, {COS} AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY declared ORDER BY sim DESC, best_match) AS rn FROM p) SELECT declared, best_match, round(sim, 6) AS sim FROM q WHERE rn = 1 AND sim > 0.1::double""")
def j9(x: Inputs) -> DataFrame:
    """Every fiftieth vector asks, every vector answers."""
    e = x.embeddings
    mine, other = e.where("vec_id % 50 = 0").select(c("vec_id").alias("declared"), c("embedding").alias("emb")), e.select(c("vec_id").alias("code"), c("embedding").alias("emb"))
    return icd.related_codes(mine, other, 0.1).withColumn("sim", F.round("sim", 6))


@query("f20_cosine", sql=f"SELECT a.vec_id, round({COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f20(x: Inputs) -> DataFrame:
    a, b = x.embeddings.select("vec_id", c("embedding").alias("a")), x.embeddings.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(I.cosine(c("a"), c("b")), 6).alias("sim"))


# -- image hashes

HEX = "lower(printf('%016x', ({0})::bit::bigint))"


def refs(x: Inputs) -> DataFrame:
    return x.hash_refs.select(c("vec_id").alias("ref_id"), "image_id", H.bits_to_hex(c("bits")).alias("hex"))


def hash_queries(x: Inputs) -> DataFrame:
    return x.hash_queries.select(c("vec_id").alias("query_id"), H.bits_to_hex(c("bits")).alias("hex"))


BRUTE = """pr AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, bit_count(xor(q.bits::bit, r.bits::bit))::int AS distance FROM hash_queries q, hash_refs r),
nn AS (SELECT query_id, min(distance) AS distance, min_by(ref_id, distance * 1000000 + ref_id) AS ref_id FROM pr GROUP BY query_id)"""


@query("f10_hash_bits", "hash_bits", sql="SELECT vec_id, bits FROM hash_bits")
def f10(x: Inputs) -> DataFrame:
    return x.embeddings.select("vec_id", H.hash_bits(c("embedding")).alias("bits"))


@query("f9_hamming", "hash_bits", sql="SELECT a.vec_id, bit_count(xor(a.bits::bit, b.bits::bit))::int AS d FROM hash_bits a JOIN hash_bits b ON b.vec_id = a.vec_id + 1")
def f9(x: Inputs) -> DataFrame:
    h = x.hash_bits.select("vec_id", H.bits_to_hex(c("bits")).alias("a"))
    return h.join(h.select((c("vec_id") - 1).alias("vec_id"), c("a").alias("b")), "vec_id").select("vec_id", H.hamming_hex(c("a"), c("b")).alias("d"))


@query("f8_normalize_hex", "hash_bits", sql=f"SELECT vec_id, {HEX.format('bits')} AS h FROM hash_bits")
def f8(x: Inputs) -> DataFrame:
    """Hashes written untidily: spaces, 0x, upper case, and without a leading zero."""
    raw = F.concat(F.lit(" 0x"), F.upper(F.regexp_replace(H.bits_to_hex(c("bits")), "^0", "")), F.lit(" "))
    return x.hash_bits.select("vec_id", H.normalize_hex(raw).alias("h"))


@query("j10_nearest_hash", "hash_queries", "hash_refs", sql=f"WITH {BRUTE} SELECT query_id, ref_id, distance, distance / 64::double AS score FROM nn")
def j10(x: Inputs) -> DataFrame:
    return HJ.dissimilarity(HJ.nearest(hash_queries(x), refs(x)))


@query("j11_similar_hash", "hash_queries", "hash_refs", sql=f"WITH {BRUTE} SELECT query_id, ref_id, distance, CASE WHEN distance <= 5 THEN 'exact' WHEN distance <= 10 THEN 'near' ELSE 'none' END AS match_type FROM nn")
def j11(x: Inputs) -> DataFrame:
    return HJ.similar(hash_queries(x), refs(x))


@query("j11_banded_pairs", "hash_queries", "hash_refs", sql=f"WITH {BRUTE} SELECT query_id, ref_id, distance FROM pr WHERE distance <= 10")
def j11b(x: Inputs) -> DataFrame:
    return HJ.within(hash_queries(x), refs(x), 10)


@query("j12_match_type", "hash_queries", "hash_refs", sql=f"WITH {BRUTE} SELECT query_id, CASE WHEN distance = 0 THEN 'exact' WHEN distance <= 10 THEN 'near' ELSE 'none' END AS match_type, true AS match FROM nn")
def j12(x: Inputs) -> DataFrame:
    return HJ.similar(hash_queries(x), refs(x), exact=0).select("query_id", "match_type", c("ref_id").isNotNull().alias("match"))


@query("f11_match_score", "hash_queries", "hash_refs", sql=f"WITH {BRUTE} SELECT query_id, CASE WHEN distance <= 5 THEN 1::double WHEN distance <= 10 THEN 0.7::double ELSE 0::double END AS score FROM nn")
def f11(x: Inputs) -> DataFrame:
    return HJ.similar(hash_queries(x), refs(x)).select("query_id", H.match_score(c("match_type")).alias("score"))


@query("v9_two_way_verdict", "hash_queries", "hash_refs", sql=f"""WITH {BRUTE}, s AS (SELECT query_id, (query_id % 100) / 100::double * 0.55::double + 0.5::double * 0.25::double + CASE WHEN distance <= 5 THEN 1::double WHEN distance <= 10 THEN 0.7::double ELSE 0::double END * 0.2::double AS fused FROM nn)
SELECT query_id, round(fused, 9) AS fused, CASE WHEN fused >= 0.5::double THEN 'Suspected Manipulation' ELSE 'Authentic' END AS verdict FROM s""")
def v9(x: Inputs) -> DataFrame:
    s = HJ.similar(hash_queries(x), refs(x))
    fused = I.fuse((c("query_id") % 100) / 100.0, F.lit(0.5), H.match_score(c("match_type")))
    return s.select("query_id", F.round(fused, 9).alias("fused"), C.image_verdict_two_way(fused).alias("verdict"))


@query("s7a_insert_hashes", "hash_queries", "hash_refs", sql="""WITH n AS (SELECT bits, min('Q' || vec_id) AS image_id FROM hash_queries GROUP BY bits) SELECT image_id, 'fraud' AS label FROM n WHERE bits NOT IN (SELECT bits FROM hash_refs)""")
def s7a(x: Inputs) -> DataFrame:
    new = x.hash_queries.select(H.bits_to_hex(c("bits")).alias("phash_hex"), F.concat(F.lit("Q"), c("vec_id")).alias("image_id"), F.lit("upload").alias("source"))
    return HJ.insert_hashes(refs(x).select(c("hex").alias("phash_hex")), new, F.lit("2024-01-01").cast("timestamp")).select("image_id", "label")


@query("s7b_all_hashes", "hash_refs", sql="SELECT vec_id, image_id, bits FROM hash_refs")
def s7b(x: Inputs) -> DataFrame:
    return x.hash_refs.select("vec_id", "image_id", "bits")


@query("s7c_hash_exists", "hash_queries", "hash_refs", sql="SELECT vec_id AS query_id, bits IN (SELECT bits FROM hash_refs) AS known FROM hash_queries")
def s7c(x: Inputs) -> DataFrame:
    q = hash_queries(x).select("query_id", c("hex").alias("phash_hex"))
    return HJ.hash_exists(q, refs(x).select(c("hex").alias("phash_hex"))).select("query_id", "known")


@query("p12_high_hash_filter", "image_scores", sql="SELECT count_if(phash > 0.8::double) AS over_80, count_if(phash > 0.85::double) AS over_85 FROM image_scores WHERE phash > 0.8::double")
def p12(x: Inputs) -> DataFrame:
    return x.image_scores.where("phash > 0.8D").agg(F.count_if(c("phash") > 0.8).alias("over_80"), F.count_if(c("phash") > 0.85).alias("over_85"))
