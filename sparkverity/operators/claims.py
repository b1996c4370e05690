"""The claim's modules: input checks, image verdicts, identity, fraud risk and the verdict.

The sentences in this module (errors, evidence, risk factors, verdict summaries, titles) are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkverity.functions import image as I
from sparkverity.functions import text as T
from sparkverity.operators import icd

IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "bmp", "tiff", "dcm"]
DOCUMENT_EXTENSIONS = ["pdf", "txt", "docx"]
IMAGE_MIMES = ["image/png", "image/jpeg", "image/jpg", "image/bmp", "image/tiff", "application/dicom", "application/dicom+json", "application/octet-stream"]
FEATURES = [
    "icd_match_score", "cnn_forgery_score", "ela_score", "phash_score", "final_image_forgery_score",
    "patient_match_score", "claim_amount_log", "previous_claim_count",
]
OPTIONAL_FEATURES = {"patient_match_score": 0.5}
NO_FACTORS = "No major risk factors identified"


def input_error(amount: Column, count: Column, image: Column, text: Column, document: Column, *, require_positive: bool = False) -> Column:
    """The first thing wrong with a submitted claim; null if nothing is."""
    number = amount.try_cast("double")
    out = (
        F.when(amount.isNull(), "Missing required field: claim_amount")
        .when(number.isNull(), "Invalid claim_amount: must be numeric")
        .when(F.coalesce(count, F.lit("0")).try_cast("int").isNull(), "Invalid previous_claim_count: must be integer")
        .when(image.isNull(), "Missing required file field: image")
        .when(T.chosen_text(text, document).isNull(), "Missing clinical text or document")
    )
    return out.when(number <= 0, "Invalid claim_amount: must be positive") if require_positive else out


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def image_flags(cnn: Column, ela: Column, phash: Column) -> dict[str, Column]:
    return {"hash_high": _flag(phash > 0.8), "hash": _flag(phash > 0.6), "cnn": _flag(cnn > 0.35), "ela": _flag(ela > 0.35)}


def image_verdict(cnn: Column, ela: Column, phash: Column, *, weights: tuple[float, float, float] = I.WEIGHTS) -> Column:
    """tampered, suspicious, authentic, or error without a model score."""
    f, fused = image_flags(cnn, ela, phash), I.fuse(cnn, ela, phash, weights)
    n = f["cnn"].cast("int") + f["ela"].cast("int") + f["hash"].cast("int")
    return (
        F.when(cnn.isNull() | ela.isNull(), "error")
        .when(f["hash_high"] | (fused >= 0.5) | (f["cnn"] & f["ela"]), "tampered")
        .when((n >= 2) | (fused >= 0.3) | f["hash"], "suspicious")
        .otherwise("authentic")
    )


def image_verdict_by_content(cnn: Column, ela: Column, phash: Column) -> Column:
    """As image_verdict, but one suspicious score is enough and a missing hash renormalises."""
    f, fused = image_flags(cnn, ela, phash), I.fuse_renormalised(cnn, ela, phash)
    return (
        F.when(f["hash_high"] | (fused >= 0.5) | (f["cnn"] & f["ela"]), "tampered")
        .when((fused >= 0.3) | f["hash"] | f["cnn"] | f["ela"], "suspicious")
        .otherwise("authentic")
    )


def image_verdict_two_way(fused: Column, threshold: float = 0.5) -> Column:
    return F.when(fused >= threshold, "Suspected Manipulation").otherwise("Authentic")


def image_confidence(verdict: Column) -> Column:
    return F.when(verdict == "error", "low").when(verdict == "suspicious", "medium").otherwise("high")


def _three(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.3f", x))


def image_explanation(cnn: Column, ela: Column, phash: Column) -> Column:
    f, fused, verdict = image_flags(cnn, ela, phash), _three(I.fuse(cnn, ela, phash)), image_verdict(cnn, ela, phash)
    strong = F.concat_ws(
        "; ", F.when(f["hash_high"], F.concat(F.lit("pHash dissimilarity very high (score: "), _three(phash), F.lit(")"))),
        F.when(f["cnn"], F.concat(F.lit("CNN tampering probability high ("), _three(cnn), F.lit(")"))),
        F.when(f["ela"], F.concat(F.lit("ELA anomalies detected ("), _three(ela), F.lit(")"))),
    )
    weak = F.concat_ws(
        "; ", F.when(f["hash"], F.concat(F.lit("pHash dissimilarity (score: "), _three(phash), F.lit(")"))),
        F.when(f["cnn"], F.concat(F.lit("CNN score ("), _three(cnn), F.lit(")"))),
        F.when(f["ela"], F.concat(F.lit("ELA score ("), _three(ela), F.lit(")"))),
    )
    shown = F.coalesce(_three(phash), F.lit("N/A"))
    return (
        F.when(verdict == "error", "Image score missing")
        .when(verdict == "tampered", F.concat(F.lit("HIGH RISK: Image shows strong signs of tampering (fused score: "), fused, F.lit("). Risk factors: "), strong, F.lit(". Image significantly differs from authentic samples.")))
        .when(verdict == "suspicious", F.concat(F.lit("MODERATE RISK: Image may contain alterations (fused score: "), fused, F.lit("). Concerns: "), weak, F.lit(". Recommend manual review for potential manipulation.")))
        .otherwise(F.concat(F.lit("LOW RISK: Image appears authentic (fused score: "), fused, F.lit("). All metrics within acceptable ranges (CNN: "), _three(cnn), F.lit(", ELA: "), _three(ela), F.lit(", pHash: "), shown, F.lit(").")))
    )


def modality_allowed(modality: Column) -> Column:
    return modality.rlike("(?i)(ct)|(mr)|(pt)|(ot)")


def identity_hundredths(doc_id: Column, img_id: Column, groups: Column, modality: Column) -> Column:
    """Match score in whole hundredths, so that thresholds are exact."""
    a, b, m = (F.nullif(x, F.lit("")) for x in (doc_id, img_id, modality))
    both, none = a.isNotNull() & b.isNotNull(), a.isNull() & b.isNull()
    ids = F.when(both & (F.lower(a) != F.lower(b)), 40).when(both, 0).when(none, 30).otherwise(15)
    diagnosis = F.when((F.size(groups) > 0) & ~F.array_contains(groups, "colon_cancer"), 25).otherwise(0)
    kind = F.when(m.isNotNull() & ~modality_allowed(m), 10).otherwise(0)
    return F.greatest(F.lit(0), F.lit(100) - ids - diagnosis - kind)


def identity_evidence(doc_id: Column, img_id: Column, groups: Column, modality: Column) -> Column:
    a, b, m = (F.nullif(x, F.lit("")) for x in (doc_id, img_id, modality))
    listed = F.concat(F.lit("['"), F.array_join(groups, "', '"), F.lit("']"))
    return T.listed(
        (F.lower(a) != F.lower(b), F.concat(F.lit("Patient ID mismatch: Document="), a, F.lit(", Image="), b)),
        (a.isNull() & b.isNull(), F.lit("No patient IDs found in document or image")),
        (a.isNull() != b.isNull(), F.lit("One side has Patient ID, other doesn't")),
        ((F.size(groups) > 0) & ~F.array_contains(groups, "colon_cancer"), F.concat(F.lit("Diagnosis mismatch with TCGA-COAD: Document mentions "), listed, F.lit(" (expected colon cancer)"))),
        (~modality_allowed(m), F.concat(F.lit("Unexpected modality: "), m, F.lit(" (TCGA-COAD usually has CT/MR)"))),
    )


def identity_status(hundredths: Column) -> Column:
    return F.when(hundredths >= 85, "matched").when(hundredths >= 60, "uncertain").otherwise("unmatched")


def identity_confidence(hundredths: Column, n_evidence: Column) -> Column:
    return F.when((hundredths >= 90) & (n_evidence == 0), "high").when(hundredths >= 70, "medium").otherwise("low")


def fraud_probability(icd_score: Column, image_score: Column, amount: Column, previous: Column) -> Column:
    return I.clamp(
        F.when(icd_score < 0.6, 0.25).otherwise(0.0) + F.when(image_score > 0.5, 0.30).otherwise(0.0)
        + F.when(amount > 10000, 0.15).when(amount > 5000, 0.10).otherwise(0.0) + F.when(previous > 3, 0.20).when(previous > 1, 0.10).otherwise(0.0)
    )


def fraud_level(pct: Column) -> Column:
    return F.when(pct >= 75, "critical").when(pct >= 50, "high").when(pct >= 25, "medium").otherwise("low")


def fraud_recommendation(level: Column) -> Column:
    return F.when(level == "critical", "reject").when(level.isin("high", "medium"), "review").otherwise("approve")


def _two(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.2f", x))


def risk_factors(icd_score: Column, image_score: Column, cnn: Column, ela: Column, amount_log: Column, previous: Column) -> Column:
    found = T.listed(
        (icd_score < 0.6, F.concat(F.lit("ICD code mismatch: Low confidence diagnosis validation (score: "), _two(icd_score), F.lit(")"))),
        (image_score > 0.6, F.concat(F.lit("Image manipulation detected: High forgery likelihood (score: "), _two(image_score), F.lit(")"))),
        (cnn > 0.7, F.concat(F.lit("CNN detects image tampering: CNN forgery score "), _two(cnn))),
        (ela > 0.6, F.concat(F.lit("Error Level Analysis alert: Significant compression inconsistencies (ELA: "), _two(ela), F.lit(")"))),
        (amount_log > 7.0, F.concat(F.lit("High claim amount: Large financial exposure (log amount: "), _two(amount_log), F.lit(")"))),
        (previous > 5, F.concat(F.lit("Frequent claimant: Multiple previous claims on record ("), previous.cast("int").cast("string"), F.lit(")"))),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_FACTORS)))


def fraud_explanation(level: Column, pct: Column, factors: Column) -> Column:
    title = F.when(level == "critical", "CRITICAL FRAUD RISK").when(level == "high", "HIGH FRAUD RISK").when(level == "medium", "MODERATE FRAUD RISK").otherwise("LOW FRAUD RISK")
    rest = F.when(factors[0] != NO_FACTORS, F.concat(F.lit("Key indicators: "), F.array_join(F.slice(factors, 1, 2), "; "), F.lit("."))).otherwise("Claim appears legitimate based on all validation checks.")
    return F.concat(title, F.lit(": Fraud risk score is "), F.format_string("%.1f", pct), F.lit("%. "), rest)


def three_level_risk(pct: Column) -> Column:
    return F.when(pct <= 30, "LOW").when(pct <= 70, "MEDIUM").otherwise("HIGH")


def rule_drivers(icd_score: Column, image_score: Column) -> Column:
    return F.array_compact(F.array(F.when(icd_score < 0.4, "Low ICD match score"), F.when(image_score > 0.7, "High image forgery confidence")))


def training_label(icd_score: Column, fused: Column) -> Column:
    return F.coalesce((icd_score < 0.4) & (fused > 0.7), F.lit(False))


def missing_features(df: DataFrame) -> Column:
    """Names of the required features a row lacks, in order."""
    need = [f for f in FEATURES if f not in OPTIONAL_FEATURES]
    return F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) if f in df.columns else F.lit(f) for f in need)))


def complete_features(df: DataFrame) -> DataFrame:
    """The rows that have all required features, by name, with defaults for optional ones."""
    rows = df.where(F.size(missing_features(df)) == 0)
    for f, default in OPTIONAL_FEATURES.items():
        rows = rows.withColumn(f, F.coalesce(F.col(f), F.lit(default)) if f in df.columns else F.lit(default))
    return rows


RECOMMENDATION = {"reject": 0.92, "approve": 0.9}


def verify(claims: DataFrame) -> DataFrame:
    """Every claim with its module results and verdict, in one pass without a shuffle."""
    c = F.col
    # What is used more than once is a column of its own, so that it is worked out once.
    out = claims.withColumn("_low", F.lower("clinical_text")).withColumn("_words", icd.words_found(c("_low")))
    out = out.withColumn("icd", icd.checked(c("_words"), c("clinical_text"))).withColumn("_image_verdict", image_verdict(c("cnn_score"), c("ela_score"), c("phash_score")))
    cnn, ela, phash = c("cnn_score"), c("ela_score"), c("phash_score")
    verdict = c("_image_verdict")
    ok = verdict != "error"
    out = out.withColumn("image", F.struct(
        ok.alias("success"), F.when(ok, F.round(I.fuse(cnn, ela, phash), 4)).otherwise(0.0).alias("fused"),
        verdict.alias("verdict"), image_confidence(verdict).alias("confidence"),
    ))
    doc_id = F.coalesce(T.document_patient_id(c("clinical_text")), F.lit(None).cast("string"))
    out = out.withColumn("_doc_id", doc_id).withColumn("_groups", T.diagnosis_groups(c("clinical_text")))
    args = (c("_doc_id"), c("img_patient_id"), c("_groups"), c("img_modality"))
    out = out.withColumn("_hundredths", identity_hundredths(*args)).withColumn("_evidence", identity_evidence(*args))
    out = out.withColumn("identity", F.struct(
        (c("_hundredths") / 100.0).alias("score"), identity_status(c("_hundredths")).alias("status"),
        identity_confidence(c("_hundredths"), F.size("_evidence")).alias("confidence"), c("_evidence").alias("evidence"),
        c("_doc_id").alias("id_doc"), c("img_patient_id").alias("id_image"),
    ))
    out = out.withColumn("features", feature_row())
    pct = F.round(fraud_probability(c("features.icd_match_score"), c("features.final_image_forgery_score"), c("claim_amount"), c("previous_claim_count")) * 100.0, 2)
    out = out.withColumn("_pct", pct)
    level = fraud_level(c("_pct"))
    factors = risk_factors(*(c(f"features.{f}") for f in ("icd_match_score", "final_image_forgery_score", "cnn_forgery_score", "ela_score", "claim_amount_log", "previous_claim_count")))
    out = out.withColumn("fraud", F.struct(
        c("claim_amount").isNotNull().alias("success"), c("_pct").alias("pct"), level.alias("level"), fraud_recommendation(level).alias("recommendation"), factors.alias("factors"),
    ))
    return out.drop("_low", "_words", "_image_verdict", "_doc_id", "_groups", "_hundredths", "_evidence", "_pct").withColumn("verdict", verdict_struct())


def feature_row() -> Column:
    """The eight features of a claim that has its icd, image and identity results."""
    c = F.col
    values = [
        c("icd.match_score"), F.coalesce("cnn_score", F.lit(0.0)), F.coalesce("ela_score", F.lit(0.0)), F.coalesce("phash_score", F.lit(0.0)),
        c("image.fused"), F.coalesce("identity.score", F.lit(0.5)), F.log1p("claim_amount"), c("previous_claim_count").cast("double"),
    ]
    return F.struct(*(v.alias(n) for v, n in zip(values, FEATURES, strict=True)))


def positive_signals() -> Column:
    c = F.col
    signals = [c("icd.status") == "valid", c("image.verdict") == "authentic", c("identity.status") == "matched", c("fraud.level") == "low"]
    return sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))


def verdict_struct() -> Column:
    c, n = F.col, positive_signals()
    failed = ~(c("icd.success") & c("image.success") & c("fraud.success"))
    mismatch = c("identity.status") == "unmatched"

    def ladder(*values) -> Column:
        return F.when(failed, values[0]).when(mismatch, values[1]).when(n == 4, values[2]).when(n == 3, values[3]).when(n == 2, values[4]).when(n == 1, values[5]).otherwise(values[6])

    return F.struct(
        ladder("manual_review", "review", "approve", "approve", "review", "review", "reject").alias("recommendation"),
        ladder(0.0, 0.85, 0.98, 0.90, 0.65, 0.50, 0.92).alias("confidence"),
        ladder(
            "One or more modules encountered errors; manual review required.",
            "Document and image appear to belong to different patients; manual review required.",
            "All validation checks passed. Claim appears legitimate and all documents link to same patient.",
            "Most validation checks passed. Patient identity and primary claims verified.",
            "Some validation checks flagged. Manual review recommended.",
            "Multiple validation checks flagged. Manual review required.",
            "Critical issues detected across validation modules.",
        ).alias("summary"),
    )


#: What is said of each identity status.
IDENTITY_TEXT = {
    "matched": "✅ MATCHED: Document and image appear to belong to same patient",
    "uncertain": "⚠️  UNCERTAIN: Insufficient evidence to confirm or deny match",
    "unmatched": "❌ UNMATCHED: Document and image likely belong to different patients",
}
RULE = "=" * 50


def _bullets(title: str, items: Column) -> Column:
    return F.concat(F.lit(f"\n{title}\n  • "), F.array_join(items, "\n  • "))


def identity_explanation(findings: Column | None = None) -> Column:
    """Text about the identity check of a verified claim; findings: what the reference population says."""
    c = F.col
    status = F.lit("Unknown status")
    for name, text in IDENTITY_TEXT.items():
        status = F.when(c("identity.status") == name, text).otherwise(status)
    evidence = c("identity.evidence")
    lines = [
        F.lit("🔗 PATIENT IDENTITY CONSISTENCY CHECK"), F.lit(RULE), status,
        F.concat(F.lit("\nDocument Patient ID: "), F.coalesce(F.nullif("identity.id_doc", F.lit("")), F.lit("Not found"))),
        F.concat(F.lit("Image Patient ID: "), F.coalesce(F.nullif("identity.id_image", F.lit("")), F.lit("Not found"))),
        F.when(F.size(evidence) > 0, _bullets("Identified Inconsistencies:", evidence)).otherwise("\n✓ No explicit inconsistencies detected"),
    ]
    if findings is not None:
        lines.append(F.when(F.size(findings) > 0, _bullets("TCGA-COAD Reference Alignment:", findings)).otherwise("\nTCGA-COAD Reference Alignment:"))
    return F.concat_ws("\n", *lines, F.lit("\n" + RULE))


def explanation(findings: Column | None = None) -> Column:
    """Five blocks of text about a verified claim."""
    c = F.col
    block = lambda *head_and_text: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head_and_text))
    return F.concat_ws(
        "\n",
        block("🏥 ICD CODE VALIDATION: ", F.upper("icd.status"), "\n   ", icd.status_text(c("icd.status"), c("icd.match_score"))),
        block("\n🖼️  IMAGE ANALYSIS: ", F.upper("image.verdict"), "\n   ", image_explanation(c("cnn_score"), c("ela_score"), c("phash_score"))),
        block("\n🔗 PATIENT IDENTITY CHECK: ", F.upper("identity.status"), " (Score: ", _two(c("identity.score")), ")\n   ", identity_explanation(findings)),
        block("\n⚠️  FRAUD RISK ASSESSMENT: ", F.upper("fraud.level"), "\n   ", fraud_explanation(c("fraud.level"), c("fraud.pct"), c("fraud.factors"))),
        block("\n✅ FINAL VERDICT: ", F.upper("verdict.recommendation"), "\n   ", c("verdict.summary")),
    )


def patient_findings(ids: DataFrame, population: DataFrame) -> DataFrame:
    """claim_id, side and finding for each id (claim_id, side, pid), by whether the population (patientid) has it."""
    known = population.select(F.col("patientid").alias("pid")).where("pid IS NOT NULL").distinct().withColumn("_in", F.lit(True))
    said = F.when(F.col("_in"), " found in TCGA-COAD database").otherwise(" NOT in TCGA-COAD (could indicate missing data or external patient)")
    return ids.where("pid <> ''").join(known.hint("merge"), "pid", "left").select("claim_id", "side", F.concat(F.lit("Patient "), F.col("pid"), said).alias("finding"))


def claim_ids(claims: DataFrame) -> DataFrame:
    """claim_id, side (document, image) and pid of the patients a claim names."""
    sides = F.array(
        F.struct(F.lit("document").alias("side"), T.document_patient_id(F.col("clinical_text")).alias("pid")), F.struct(F.lit("image").alias("side"), F.col("img_patient_id").alias("pid")),
    )
    return claims.select("claim_id", F.inline(sides)).where("pid IS NOT NULL")


def reference_findings(claims: DataFrame, population: DataFrame) -> DataFrame:
    """claim_id and findings: patients in the reference population or not, and declared codes in its scope or not."""
    patients = patient_findings(claim_ids(claims), population).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("side", "finding"))).alias("_p"))
    listed = lambda codes: F.concat(F.lit("['"), F.array_join(codes, "', '"), F.lit("']"))
    codes = T.declared_codes(F.col("clinical_text"))
    own = claims.select("claim_id", codes.alias("_codes")).withColumn("_scope", T.in_scope(F.col("_codes")))
    scope = (
        F.when(F.size("_scope") > 0, F.concat(F.lit("ICD codes consistent with TCGA-COAD scope: "), listed(F.col("_scope"))))
        .when(F.size("_codes") > 0, F.concat(F.lit("Warning: ICD codes "), listed(F.col("_codes")), F.lit(" may be outside TCGA-COAD typical scope")))
    )
    joined = own.join(patients.hint("merge"), "claim_id", "left")
    return joined.select("claim_id", F.array_compact(F.concat(F.coalesce(F.col("_p.finding"), F.array().cast("array<string>")), F.array(scope))).alias("findings"))


def rationale() -> Column:
    c = F.col
    return F.concat_ws(
        "\n",
        F.lit("Final outcome rationale is based on weighted evidence from all modules:"),
        F.format_string("1) ICD module: status=%s, match_score=%.2f%%.", c("icd.status"), c("icd.match_score") * 100.0),
        F.concat(F.format_string("2) Image module: verdict=%s, CNN=%.3f, ELA=%.3f, pHash=", c("image.verdict"), F.coalesce("cnn_score", F.lit(0.0)), F.coalesce("ela_score", F.lit(0.0))), F.coalesce(_three(c("phash_score")), F.lit("N/A")), F.format_string(", fused=%.3f.", c("image.fused"))),
        F.format_string("3) Fraud module: risk=%.1f%% (%s).", c("fraud.pct"), c("fraud.level")),
        F.format_string("Recommendation=%s with confidence=%.0f%%.", c("verdict.recommendation"), c("verdict.confidence") * 100.0),
    )


def report_rows(verified: DataFrame) -> DataFrame:
    """A verified claim as (claim_id, section, place, label, value) rows."""
    c = F.col
    row = lambda place, section, label, value: F.struct(F.lit(section).alias("section"), F.lit(place).alias("place"), F.lit(label).alias("label"), F.coalesce(value, F.lit("N/A")).alias("value"))
    codes = T.explicit_codes(c("clinical_text"))
    predicted = F.transform(F.slice("icd.predicted", 1, 5), lambda p: F.concat(p["code"], F.lit(" ("), F.format_string("%.1f", p["prob"] * 100.0), F.lit("%)")))
    rows = [
        ("Claim Overview", "Claim ID", c("claim_id").cast("string")), ("Claim Overview", "Patient ID", c("patient_id")),
        ("Claim Overview", "Claim Amount", F.format_number("claim_amount", 2)), ("Claim Overview", "Previous Claims", c("previous_claim_count").cast("string")),
        ("ICD Code Verification", "Status", F.upper("icd.status")), ("ICD Code Verification", "Match Score", F.concat(F.format_string("%.2f", c("icd.match_score") * 100.0), F.lit("%"))),
        ("ICD Code Verification", "Explicit ICDs in Notes", F.when(F.size(codes) > 0, F.array_join(F.slice(codes, 1, 10), ", ")).otherwise("None explicitly found")),
        ("ICD Code Verification", "Predicted ICDs", F.coalesce(F.array_join(predicted, "; "), F.lit("None detected"))),
        ("Medical Image Analysis", "Forgery Verdict", F.upper("image.verdict")), ("Medical Image Analysis", "CNN Score", _three(F.coalesce("cnn_score", F.lit(0.0)))),
        ("Medical Image Analysis", "ELA Score", _three(F.coalesce("ela_score", F.lit(0.0)))), ("Medical Image Analysis", "pHash Score", _three(c("phash_score"))),
        ("Medical Image Analysis", "Fused Score", _three(c("image.fused"))),
        ("Fraud Risk Assessment", "Risk Level", F.upper("fraud.level")), ("Fraud Risk Assessment", "Fraud Risk Percentage", F.concat(F.format_string("%.1f", c("fraud.pct")), F.lit("%"))),
        ("Fraud Risk Assessment", "Recommendation", F.upper("fraud.recommendation")), ("Fraud Risk Assessment", "Risk Factors", F.array_join(F.slice("fraud.factors", 1, 8), "; ")),
        ("Integrated Verdict", "Overall Recommendation", F.upper("verdict.recommendation")), ("Integrated Verdict", "Confidence", F.concat(F.format_string("%.0f", c("verdict.confidence") * 100.0), F.lit("%"))),
        ("Integrated Verdict", "Risk Summary", c("verdict.summary")),
    ]
    return verified.select("claim_id", F.inline(F.array(*(row(k, *r) for k, r in enumerate(rows)))))
