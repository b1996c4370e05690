"""Queries over notes, image metadata and evaluation tables: one per operator, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkverity.functions import image as I
from sparkverity.functions import text as T
from sparkverity.operators import datasets as D
from sparkverity.operators import evaluate as E
from sparkverity.sources.views import Inputs, query

c = F.col
NORM = "replace(upper(trim(icd_code)), ' ', '')"
CODES = f"dc AS (SELECT hadm_id, {NORM} AS code FROM diagnoses WHERE hadm_id IS NOT NULL), cc AS (SELECT code, count(*) AS n FROM dc GROUP BY code)"
RE = r"\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Za-z]{1,4})?)\b"


def order(key: str, seed: int = 42) -> str:
    return f"md5(concat(cast({key} AS VARCHAR), '-{seed}'))"


# -- sources

DICT = "SELECT concat(' ', lower(CASE cast(l_partkey % 5 AS int) WHEN 0 THEN 'c' WHEN 1 THEN 'e' ELSE 'k' END), lpad(cast(l_suppkey % 20 AS string), 2, '0'), ' ') AS code, CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('desc ', cast(l_partkey AS string)) END AS description, l_orderkey * 10 + l_linenumber AS row_ord FROM lineitem"


@query("s1_diagnosis_dictionary", sql=f"WITH d AS ({DICT}) SELECT upper(trim(code)) AS code, arg_max(coalesce(description, ''), row(row_ord, coalesce(description, ''))) AS description FROM d GROUP BY 1")
def s1(x: Inputs) -> DataFrame:
    return D.diagnosis_dictionary(x.sql(DICT))


CELL = "SELECT claim_id, concat(' ', clinical_text, ' ') AS text, CASE WHEN claim_id % 9 = 0 THEN NULL ELSE concat(' c18.9; ;', cast(claim_id % 7 AS string), 'a ; e11') END AS cell FROM claims"


@query("s2_text_codes", "claims", sql=f"WITH d AS ({CELL}) SELECT claim_id, trim(text) AS text, array_to_string(list_filter(list_transform(string_split(coalesce(cell, ''), ';'), lambda v: upper(trim(v))), lambda v: v <> ''), ',') AS codes FROM d WHERE trim(text) <> ''")
def s2(x: Inputs) -> DataFrame:
    return x.sql(CELL, "claims").where("trim(text) <> ''").select("claim_id", F.trim("text").alias("text"), F.array_join(T.split_codes(c("cell")), ",").alias("codes"))


@query("s9_labelled_directory", "headers", sql="WITH h AS (SELECT file_path, split_part(file_path, '/', -2) AS class FROM headers) SELECT file_path, class, (dense_rank() OVER (ORDER BY class) - 1)::int AS class_index FROM h")
def s9(x: Inputs) -> DataFrame:
    return D.class_index(x.headers.select("file_path"))


@query("s10_image_headers", "headers", sql="SELECT file_path, patientid, imagetype, coalesce(nullif(trim(modality), ''), 'Unknown') AS modality, split_part(file_path, '/', 1) AS patient_folder, split_part(file_path, '/', 2) AS study_folder FROM headers")
def s10(x: Inputs) -> DataFrame:
    return D.image_headers(x.headers)


@query("s18_preview", sql="SELECT doc_id, left(text, 60) AS text FROM documents ORDER BY doc_id LIMIT 10")
def s18(x: Inputs) -> DataFrame:
    return D.first_rows(x.documents, 10, "doc_id").select("doc_id", F.left("text", F.lit(60)).alias("text"))


# -- notes and codes

@query("a1_codes_by_admission", "diagnoses", sql=f"WITH {CODES} SELECT hadm_id, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM dc GROUP BY hadm_id")
def a1(x: Inputs) -> DataFrame:
    return D.codes_by_admission(x.diagnoses).select("hadm_id", F.array_join("codes", ",").alias("codes"))


@query("a2_code_frequency", "diagnoses", sql=f"WITH {CODES} SELECT code, n FROM cc WHERE n >= 25")
def a2(x: Inputs) -> DataFrame:
    return D.code_counts(x.diagnoses, 25)


@query("t1_top_codes", "diagnoses", sql=f"WITH {CODES} SELECT code, n FROM cc WHERE n >= 5 ORDER BY n DESC, code LIMIT 50")
def t1(x: Inputs) -> DataFrame:
    return D.most_frequent(D.code_counts(x.diagnoses), 50, 5)


LABELLED = f"""{CODES}, top AS (SELECT code FROM cc WHERE n >= 25 ORDER BY n DESC, code LIMIT 100), lab AS (SELECT hadm_id, list_sort(list(DISTINCT code)) AS labels FROM dc WHERE code IN (SELECT code FROM top) GROUP BY hadm_id),
ln AS (SELECT n.note_id, n.subject_id, n.hadm_id, labels, regexp_replace(text, '{RE}', '[ICD_CODE]', 'gi') AS text FROM notes n JOIN lab USING (hadm_id) WHERE note_type = 'DS'),
lc AS (SELECT code, count(*) AS n FROM (SELECT unnest(labels) AS code FROM ln) GROUP BY code)"""


def labelled(x: Inputs) -> DataFrame:
    return D.labelled_notes(x.notes, x.diagnoses, top_k=100)


@query("j4_notes_with_labels", "notes", "diagnoses", sql=f"WITH {LABELLED} SELECT note_id, hadm_id, array_to_string(labels, ',') AS labels FROM ln")
def j4(x: Inputs) -> DataFrame:
    return labelled(x).select("note_id", "hadm_id", F.array_join("labels", ",").alias("labels"))


@query("a3_frequent_labels", "notes", "diagnoses", sql=f"WITH {LABELLED} SELECT code, n FROM lc ORDER BY n DESC, code LIMIT 20")
def a3(x: Inputs) -> DataFrame:
    return D.most_frequent(D.label_counts(labelled(x)), 20)


@query("w2_label_index", "notes", "diagnoses", sql=f"WITH {LABELLED} SELECT (row_number() OVER (ORDER BY n DESC, code) - 1)::int AS idx, code AS label FROM lc")
def w2(x: Inputs) -> DataFrame:
    return D.label_index(D.label_counts(labelled(x))).select("idx", "label")


def label_list(x: Inputs) -> list[str]:
    return [r.label for r in D.label_index(D.most_frequent(D.label_counts(labelled(x)), 30)).orderBy("idx").collect()]


L30 = "l30 AS (SELECT code, row_number() OVER (ORDER BY n DESC, code) - 1 AS idx FROM lc ORDER BY n DESC, code LIMIT 30)"


@query("f7_label_indices", "notes", "diagnoses", sql=f"WITH {LABELLED}, {L30} SELECT note_id, string_agg(idx, ',' ORDER BY code) AS idx FROM (SELECT note_id, unnest(labels) AS code FROM ln) JOIN l30 USING (code) GROUP BY note_id")
def f7(x: Inputs) -> DataFrame:
    return D.indexed(labelled(x), label_list(x)).select("note_id", F.array_join("label_indices", ",").alias("idx"))


@query("p15_label_list_filter", "notes", "diagnoses", sql=f"WITH {LABELLED}, {L30} SELECT note_id, string_agg(code, ',' ORDER BY code) AS labels FROM (SELECT note_id, unnest(labels) AS code FROM ln) JOIN l30 USING (code) GROUP BY note_id")
def p15(x: Inputs) -> DataFrame:
    return D.in_label_list(labelled(x), label_list(x)).select("note_id", F.array_join("labels", ",").alias("labels"))


@query("f6_multi_hot", "notes", "diagnoses", sql=f"WITH {LABELLED}, {L30} SELECT note_id, string_agg(CASE WHEN list_contains(labels, code) THEN '1' ELSE '0' END, '' ORDER BY idx) AS hot FROM ln, l30 GROUP BY note_id, labels")
def f6(x: Inputs) -> DataFrame:
    return labelled(x).select("note_id", F.array_join(T.multi_hot(c("labels"), F.lit(label_list(x))), "").alias("hot"))


@query("u5_label_intersection", "notes", "diagnoses", sql=f"WITH {LABELLED} SELECT note_id, array_to_string(list_sort(list_filter(labels, lambda v: v IN ('C01.0', 'E02.1', 'K03.2', 'J04.0', 'C05.1'))), ',') AS labels FROM ln WHERE len(list_filter(labels, lambda v: v IN ('C01.0', 'E02.1', 'K03.2', 'J04.0', 'C05.1'))) > 0")
def u5(x: Inputs) -> DataFrame:
    return D.in_label_list(labelled(x), ["C01.0", "E02.1", "K03.2", "J04.0", "C05.1"]).select("note_id", F.array_join("labels", ",").alias("labels"))


@query("p10_note_type_filter", "notes", sql="SELECT note_id, note_type FROM notes WHERE note_type = 'DS'")
def p10(x: Inputs) -> DataFrame:
    return D.kept_notes(x.notes, ["DS"]).select("note_id", "note_type")


@query("p11_missing_key_count", "notes", sql="SELECT count_if(hadm_id IS NULL) AS skipped, count_if(hadm_id IS NOT NULL) AS kept FROM notes")
def p11(x: Inputs) -> DataFrame:
    return x.notes.agg(F.count_if(c("hadm_id").isNull()).alias("skipped"), F.count_if(c("hadm_id").isNotNull()).alias("kept"))


@query("a6_notes_per_type", "notes", sql="SELECT note_type, count(*) AS n FROM notes GROUP BY ROLLUP (note_type)")
def a6(x: Inputs) -> DataFrame:
    return x.notes.rollup("note_type").agg(F.count("*").alias("n"))


@query("w9_first_per_group", "notes", sql="SELECT note_type, note_id, text FROM (SELECT *, row_number() OVER (PARTITION BY note_type ORDER BY note_id) AS r FROM notes) WHERE r <= 3")
def w9(x: Inputs) -> DataFrame:
    return D.first_rows(x.notes, 3, "note_id", by=["note_type"]).select("note_type", "note_id", "text")


@query("a11_distinct_subjects", "notes", sql="SELECT count(DISTINCT subject_id) AS n FROM notes WHERE subject_id <> ''")
def a11(x: Inputs) -> DataFrame:
    return x.notes.where("subject_id <> ''").agg(F.count_distinct("subject_id").alias("n"))


@query("j6_admission_subject", "notes", "diagnoses", sql="SELECT d.hadm_id, n.subject_id, count(*) AS n FROM diagnoses d LEFT JOIN notes n ON n.hadm_id = d.hadm_id GROUP BY ALL")
def j6(x: Inputs) -> DataFrame:
    return x.diagnoses.join(x.notes.select("hadm_id", "subject_id"), "hadm_id", "left").groupBy("hadm_id", "subject_id").agg(F.count("*").alias("n"))


@query("j5_code_descriptions", "diagnoses", "dx", sql=f"WITH {CODES} SELECT cc.code, coalesce(dx.phrase, '') AS description, n FROM cc LEFT JOIN (SELECT substr(code, 1, 3) AS cat, min(phrase) AS phrase FROM dx GROUP BY 1) dx ON dx.cat = substr(cc.code, 1, 3)")
def j5(x: Inputs) -> DataFrame:
    d = x.dx.groupBy(T.category(c("code")).alias("cat")).agg(F.min("phrase").alias("phrase"))
    counts = D.code_counts(x.diagnoses).withColumn("cat", T.category(c("code")))
    return counts.join(d, "cat", "left").select("code", F.coalesce("phrase", F.lit("")).alias("description"), "n")


SPLIT = f"sj AS (SELECT DISTINCT subject_id FROM notes), sr AS (SELECT subject_id, row_number() OVER (ORDER BY {order('subject_id')}, subject_id) AS r, count(*) OVER () AS t FROM sj), sp AS (SELECT subject_id, CASE WHEN r <= greatest(1, floor(t * 0.1::double)) THEN 'val' ELSE 'train' END AS split FROM sr)"


@query("w5_subject_split", "notes", sql=f"WITH {SPLIT} SELECT subject_id, split FROM sp")
def w5(x: Inputs) -> DataFrame:
    return D.subject_split(x.notes)


@query("j15_notes_by_split", "notes", sql=f"WITH {SPLIT} SELECT split, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM notes JOIN sp USING (subject_id) GROUP BY split")
def j15(x: Inputs) -> DataFrame:
    return x.notes.join(D.subject_split(x.notes), "subject_id").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"))


@query("v28_labelled_note_job", "notes", "diagnoses", sql=f"WITH {LABELLED}, {L30}, ls AS (SELECT DISTINCT subject_id FROM ln), lr AS (SELECT subject_id, row_number() OVER (ORDER BY {order('subject_id')}, subject_id) AS r, count(*) OVER () AS t FROM ls), ix AS (SELECT note_id, string_agg(idx, ',' ORDER BY code) AS idx FROM (SELECT note_id, unnest(labels) AS code FROM ln) JOIN l30 USING (code) GROUP BY note_id) SELECT note_id, text, idx, CASE WHEN r <= greatest(1, floor(t * 0.1::double)) THEN 'val' ELSE 'train' END AS split FROM ln JOIN ix USING (note_id) JOIN lr USING (subject_id)")
def v28(x: Inputs) -> DataFrame:
    notes = labelled(x)
    out = D.indexed(notes, label_list(x)).join(D.subject_split(notes), "subject_id")
    return out.select("note_id", "text", F.array_join("label_indices", ",").alias("idx"), "split")


EXAMPLES = f"WITH {CODES} SELECT DISTINCT 'Diagnosis: ' || coalesce(dx.phrase, 'Diagnosis code ' || cc.code) || '.' AS text, cc.code FROM cc LEFT JOIN dx ON dx.code = cc.code"


@query("u1_distinct_examples", "diagnoses", "dx", sql=EXAMPLES)
def u1(x: Inputs) -> DataFrame:
    return D.described_examples(x.diagnoses, x.dx.select("code", c("phrase").alias("description")))


@query("v29_description_job", "diagnoses", "dx", sql=f"{EXAMPLES} ORDER BY cc.code, text LIMIT 40")
def v29(x: Inputs) -> DataFrame:
    return D.first_rows(u1(x), 40, "code", "text")


# -- image metadata

MERGED = "mg AS (SELECT h.*, m.collection, m.subject_id IS NOT NULL AS metadata_matched FROM headers h LEFT JOIN header_meta m ON m.subject_id = h.patientid)"


def merged(x: Inputs) -> DataFrame:
    return D.with_metadata(x.headers, x.header_meta)


@query("j2_metadata_by_patient", "headers", "header_meta", sql=f"WITH {MERGED} SELECT file_path, collection FROM mg")
def j2(x: Inputs) -> DataFrame:
    return merged(x).select("file_path", "collection")


@query("j1_metadata_by_series", "headers", "header_meta", sql="SELECT file_path, m.collection FROM headers h LEFT JOIN header_meta m ON 'S' || m.subject_id = 'S' || h.patientid")
def j1(x: Inputs) -> DataFrame:
    h = x.headers.withColumn("seriesinstanceuid", F.concat(F.lit("S"), c("patientid")))
    return D.with_metadata(h, x.header_meta.withColumn("series_uid", F.concat(F.lit("S"), c("subject_id")))).select("file_path", "collection")


@query("j3_match_flag", "headers", "header_meta", sql=f"WITH {MERGED} SELECT file_path, metadata_matched FROM mg")
def j3(x: Inputs) -> DataFrame:
    return merged(x).select("file_path", "metadata_matched")


@query("a10_matched_entries", "headers", "header_meta", sql=f"WITH {MERGED} SELECT sum(metadata_matched::int)::bigint AS matched, count(*) AS total FROM mg")
def a10(x: Inputs) -> DataFrame:
    return merged(x).agg(F.sum(c("metadata_matched").cast("int")).alias("matched"), F.count("*").alias("total"))


@query("v30_metadata_job", "headers", "header_meta", sql=f"WITH {MERGED} SELECT coalesce(modality, 'Unknown') AS modality, count(*) AS n, sum(metadata_matched::int)::bigint AS matched FROM mg GROUP BY 1")
def v30(x: Inputs) -> DataFrame:
    out = D.with_metadata(D.image_headers(x.headers), x.header_meta)
    return out.groupBy("modality").agg(F.count("*").alias("n"), F.sum(c("metadata_matched").cast("int")).alias("matched"))


@query("a4_patient_profile", "headers", sql="SELECT patientid, coalesce(array_to_string(list_sort(list(DISTINCT modality) FILTER (modality IS NOT NULL)), ','), '') AS modality FROM headers GROUP BY patientid")
def a4(x: Inputs) -> DataFrame:
    return D.patient_profile(x.headers).select("patientid", F.array_join("modality", ",").alias("modality"))


@query("a5_value_counts", "headers", sql="SELECT modality, count(*) AS n FROM headers GROUP BY modality ORDER BY n DESC")
def a5(x: Inputs) -> DataFrame:
    return x.headers.groupBy("modality").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


JPEG = "jp AS (SELECT 'jpeg/' || regexp_replace(file_path, '\\.[^./]*$', '.jpg') AS jpeg_path, row_number() OVER (ORDER BY file_path) AS k, * FROM headers), ex AS (SELECT jpeg_path FROM jp WHERE patientid <> 'P7')"


def existing(x: Inputs) -> DataFrame:
    return x.headers.where("patientid <> 'P7'").select(F.concat(F.lit("jpeg/"), T.swap_suffix(c("file_path"), ".jpg")).alias("jpeg_path")).distinct()


@query("p16_path_derivation", "headers", sql=f"WITH {JPEG} SELECT file_path, jpeg_path FROM jp")
def p16(x: Inputs) -> DataFrame:
    return x.headers.select("file_path", F.concat(F.lit("jpeg/"), T.swap_suffix(c("file_path"), ".jpg")).alias("jpeg_path"))


@query("j14_existing_images", "headers", sql=f"WITH {JPEG} SELECT file_path FROM jp WHERE jpeg_path IN (SELECT jpeg_path FROM ex)")
def j14(x: Inputs) -> DataFrame:
    return D.image_dataset(x.headers, existing(x)).select("file_path")


@query("u6_missing_files", "headers", sql=f"WITH {JPEG} SELECT jpeg_path FROM jp WHERE jpeg_path NOT IN (SELECT jpeg_path FROM ex)")
def u6(x: Inputs) -> DataFrame:
    return p16(x).select("jpeg_path").join(existing(x), "jpeg_path", "left_anti")


LOC = "contains(imagetype, 'LOCALIZER')"


@query("p17_image_types", "headers", sql=f"SELECT file_path, CASE WHEN imagetype = 'Unknown' THEN NULL WHEN {LOC} THEN 'ORIGINAL,PRIMARY,LOCALIZER' ELSE 'ORIGINAL,PRIMARY,AXIAL' END AS types FROM headers")
def p17(x: Inputs) -> DataFrame:
    return x.headers.select("file_path", F.array_join(T.list_literal(c("imagetype")), ",").alias("types"))


@query("a9_localizer_counts", "headers", sql=f"WITH {JPEG} SELECT count(*) AS total, count_if({LOC}) AS localizers, count_if(NOT {LOC}) AS others FROM jp WHERE patientid <> 'P7'")
def a9(x: Inputs) -> DataFrame:
    return D.image_dataset(x.headers, existing(x)).agg(F.count("*").alias("total"), F.count_if("is_localizer").alias("localizers"), F.count_if(~c("is_localizer")).alias("others"))


@query("v31_image_dataset_job", "headers", sql=f"WITH {JPEG} SELECT jpeg_path, {LOC} AS is_localizer FROM jp WHERE patientid <> 'P7'")
def v31(x: Inputs) -> DataFrame:
    return D.image_dataset(x.headers, existing(x)).select("jpeg_path", "is_localizer")


@query("t3_first_files", "headers", sql="SELECT file_path FROM headers ORDER BY file_path LIMIT 50")
def t3(x: Inputs) -> DataFrame:
    return D.first_rows(x.headers, 50, "file_path").select("file_path")


@query("u2_union_of_lists", "headers", sql="SELECT file_path, 'CT' AS list FROM headers WHERE modality = 'CT' UNION ALL SELECT file_path, 'P1' FROM headers WHERE patientid = 'P1'")
def u2(x: Inputs) -> DataFrame:
    a = x.headers.where("modality = 'CT'").select("file_path", F.lit("CT").alias("list"))
    return a.unionByName(x.headers.where("patientid = 'P1'").select("file_path", F.lit("P1").alias("list")))


CLS = "CASE cast(path_id % 4 AS int) WHEN 0 THEN 'colon_aca' WHEN 1 THEN 'lung_n' WHEN 2 THEN 'forge_copy' ELSE 'other' END"


@query("p21_class_relabel", "image_scores", sql=f"SELECT path_id, CASE WHEN {CLS} IN ('colon_aca', 'lung_n') THEN 'authentic' WHEN {CLS} = 'forge_copy' THEN 'tampered' END AS side FROM image_scores")
def p21(x: Inputs) -> DataFrame:
    return x.image_scores.select("path_id", D.authenticity(F.expr(CLS)).alias("side"))


ST = f"st AS (SELECT path_id, label, row_number() OVER (PARTITION BY label ORDER BY {order('path_id')}, path_id) AS r, count(*) OVER (PARTITION BY label) AS t FROM image_scores)"


@query("w3_stratified_split", "image_scores", sql=f"WITH {ST} SELECT path_id, label, CASE WHEN r <= floor(t * 0.15::double) THEN 'val' ELSE 'train' END AS split FROM st")
def w3(x: Inputs) -> DataFrame:
    return D.split(x.image_scores.select("path_id", "label"), "path_id", 0.15, by=["label"])


@query("a8_split_class_sizes", "image_scores", sql=f"WITH {ST} SELECT split, label, count(*) AS n FROM (SELECT *, CASE WHEN r <= floor(t * 0.15::double) THEN 'val' ELSE 'train' END AS split FROM st) GROUP BY CUBE (split, label)")
def a8(x: Inputs) -> DataFrame:
    return w3(x).cube("split", "label").agg(F.count("*").alias("n"))


@query("w7_random_split", "image_scores", sql=f"WITH r AS (SELECT path_id, row_number() OVER (ORDER BY {order('path_id', 7)}, path_id) AS r, count(*) OVER () AS t FROM image_scores) SELECT path_id, CASE WHEN r <= floor(t * 0.1::double) THEN 'val' ELSE 'train' END AS split FROM r")
def w7(x: Inputs) -> DataFrame:
    return D.split(x.image_scores.select("path_id"), "path_id", 0.1, seed=7)


@query("w6_seeded_sample", "image_scores", sql=f"SELECT path_id, label FROM image_scores ORDER BY {order('path_id')}, path_id LIMIT 1000")
def w6(x: Inputs) -> DataFrame:
    return D.sample(x.image_scores.select("path_id", "label"), "path_id", 1000)


@query("w4_balanced_sample", "image_scores", sql=f"WITH n AS (SELECT floor(count(*) * 0.5::double) AS k FROM image_scores WHERE label = 1), a AS (SELECT path_id, label, row_number() OVER (ORDER BY {order('path_id')}, path_id) AS r FROM image_scores WHERE label = 0) SELECT path_id, label FROM image_scores WHERE label = 1 UNION ALL SELECT path_id, label FROM a, n WHERE r <= k")
def w4(x: Inputs) -> DataFrame:
    return D.balanced(x.image_scores.select("path_id", "label"), "path_id", c("label") == 1, 0.5)


@query("a34_text_profile", sql="WITH f AS (SELECT * FROM pages ORDER BY page_id LIMIT 200), l AS (SELECT 'html' AS column_name, page_id, html AS v FROM f UNION ALL SELECT 'url', page_id, url FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY page_id) AS r FROM l WHERE trim(v) <> '') SELECT column_name, page_id, left(v, 400) AS sample FROM r WHERE r <= 5")
def a34(x: Inputs) -> DataFrame:
    return D.text_profile(x.pages, "page_id", ["html", "url"])


# -- evaluation

FUSED = "(cnn * 0.5::double + ela * 0.3::double + coalesce(phash, 0.5::double) * 0.2::double)"


def scores(x: Inputs) -> DataFrame:
    return x.image_scores.withColumn("fused", I.fuse(c("cnn"), c("ela"), c("phash"), (0.5, 0.3, 0.2)))


def roc(score: str, source: str = "sc", by: str = "") -> str:
    b, pb = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""g AS (SELECT {b}{score} AS score, sum(label)::double AS tp, sum(1 - label)::double AS fp FROM {source} GROUP BY ALL),
w AS (SELECT *, sum(tp) OVER ({pb} ORDER BY score DESC) AS ctp, sum(fp) OVER ({pb} ORDER BY score DESC) AS cfp FROM g),
m AS (SELECT {b}sum(fp * (2 * ctp - tp)) / 2 / nullif(sum(tp) * sum(fp), 0) AS auc, sum(tp * ctp / (ctp + cfp)) / nullif(sum(tp), 0) AS ap FROM w {f'GROUP BY {by}' if by else ''})"""


SC = f"sc AS (SELECT *, {FUSED} AS fused FROM image_scores)"


@query("j17_scores_with_truth", "image_scores", sql=f"WITH {SC} SELECT path_id, label, cnn, round(fused, 9) AS fused FROM sc")
def j17(x: Inputs) -> DataFrame:
    truth = x.image_scores.select("path_id", "label")
    return scores(x).drop("label").join(truth, "path_id").select("path_id", "label", "cnn", F.round("fused", 9).alias("fused"))


@query("a18_roc_auc", "image_scores", sql=f"WITH {SC}, {roc('cnn')} SELECT round(auc, 6) AS auc FROM m")
def a18(x: Inputs) -> DataFrame:
    return E.auc(scores(x), "cnn").select(F.round("auc", 6).alias("auc"))


@query("a18_rank_auc", "image_scores", sql=f"WITH {SC}, {roc('cnn')} SELECT round(auc, 6) AS auc FROM m")
def a18r(x: Inputs) -> DataFrame:
    return E.rank_auc(scores(x), "cnn").select(F.round("auc", 6).alias("auc"))


@query("w8_cumulative_curve", "image_scores", sql=f"WITH {SC}, {roc('cnn')} SELECT round(score, 9) AS score, ctp::bigint AS cum_tp, cfp::bigint AS cum_fp FROM w")
def w8(x: Inputs) -> DataFrame:
    return E.curve(scores(x), "cnn").select(F.round("score", 9).alias("score"), "cum_tp", "cum_fp")


@query("a19_average_precision", "image_scores", sql=f"WITH {SC}, {roc('cnn')} SELECT round(ap, 6) AS ap FROM m")
def a19(x: Inputs) -> DataFrame:
    return E.auc(scores(x), "cnn").select(F.round("average_precision", 6).alias("ap"))


@query("v33_evaluation_job", "image_scores", sql=f"WITH {SC}, lg AS (SELECT 'cnn' AS model, cnn AS s, label FROM sc UNION ALL SELECT 'ela', ela, label FROM sc), {roc('s', 'lg', 'model')} SELECT model, round(auc, 6) AS auc, round(ap, 6) AS ap FROM m")
def v33(x: Inputs) -> DataFrame:
    long = scores(x).select("label", F.inline(F.array(F.struct(F.lit("cnn").alias("model"), c("cnn").alias("s")), F.struct(F.lit("ela").alias("model"), c("ela").alias("s")))))
    return E.auc(long, "s", by=["model"]).select("model", F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("ap"))


@query("a23_macro_auc", "image_scores", sql=f"WITH lg AS (SELECT path_id % 3 AS class, label, ela AS s FROM image_scores), {roc('s', 'lg', 'class')} SELECT round(avg(auc), 6) AS macro_auc FROM m")
def a23(x: Inputs) -> DataFrame:
    long = x.image_scores.select((c("path_id") % 3).alias("class"), "label", c("ela").alias("s"))
    return E.macro_auc(long, "class", "s", "label").select(F.round("macro_auc", 6).alias("macro_auc"))


BIN = "bn AS (SELECT count_if(label = 1 AND cnn >= 0.35::double)::double AS tp, count_if(label = 0 AND cnn >= 0.35::double)::double AS fp, count_if(label = 1 AND cnn < 0.35::double)::double AS fn, count(*) AS n, count_if((label = 1) = (cnn >= 0.35::double))::double AS ok FROM image_scores)"


@query("a20_binary_report", "image_scores", sql=f"WITH {BIN} SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(ok / n, 9) AS accuracy, n FROM bn")
def a20(x: Inputs) -> DataFrame:
    marked = x.image_scores.withColumn("said", (c("cnn") >= 0.35).cast("int"))
    return E.binary_report(marked, "label", "said").select(*(F.round(m, 9).alias(m) for m in ("precision", "recall", "f1", "accuracy")), "n")


CL = "k AS (SELECT cast(path_id % 5 AS int) AS t, cast(path_id * 7 % 11 % 5 AS int) AS p FROM image_scores), cr AS (SELECT v AS class, count_if(t = v AND p = v)::double AS tp, count_if(p = v)::double AS cl, count_if(t = v) AS support FROM k, (SELECT unnest(range(0, 5)) AS v) GROUP BY v), rp AS (SELECT class::int AS class, coalesce(tp / nullif(cl, 0), 0) AS precision, tp / support AS recall, 2 * tp / (cl + support) AS f1, support FROM cr)"


def classes(x: Inputs) -> DataFrame:
    return x.image_scores.select((c("path_id") % 5).cast("int").alias("t"), (c("path_id") * 7 % 11 % 5).cast("int").alias("p"))


@query("a24_class_report", "image_scores", sql=f"WITH {CL} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rp")
def a24(x: Inputs) -> DataFrame:
    return E.class_report(classes(x), "t", "p").select("class", *(F.round(m, 9).alias(m) for m in ("precision", "recall", "f1")), "support")


@query("a22_weighted_report", "image_scores", sql=f"WITH {CL} SELECT round(sum(precision * support) / sum(support), 9) AS precision, round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1 FROM rp")
def a22(x: Inputs) -> DataFrame:
    return E.weighted_report(classes(x), "t", "p").select(*(F.round(m, 9).alias(m) for m in ("precision", "recall", "f1")))


ML = r"""tr AS (SELECT DISTINCT claim_id AS doc_id, unnest(list_transform(regexp_extract_all(clinical_text, '\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Za-z]{1,4})?)\b', 1, 'i'), lambda v: upper(v))) AS label FROM claims),
pd AS (SELECT 'half' AS model, doc_id, code AS label FROM predictions WHERE prob >= 0.5::double UNION SELECT 'strict', doc_id, code FROM predictions WHERE prob >= 0.8::double),
al AS (SELECT coalesce(t.model, p.model) AS model, coalesce(t.label, p.label) AS label, t.label IS NOT NULL AS t, p.label IS NOT NULL AS p FROM (SELECT * FROM tr, (VALUES ('half'), ('strict')) AS v(model)) t FULL JOIN pd p ON p.model = t.model AND p.doc_id = t.doc_id AND p.label = t.label),
pl AS (SELECT model, label, count_if(t AND p)::double AS tp, count_if(p AND NOT t)::double AS fp, count_if(t AND NOT p)::double AS fn FROM al GROUP BY ALL)"""


def multilabel(x: Inputs) -> DataFrame:
    truth = x.claims.select(c("claim_id").alias("doc_id"), F.explode(T.declared_codes(c("clinical_text"))).alias("label"))
    truth = truth.withColumn("model", F.explode(F.array(F.lit("half"), F.lit("strict"))))
    p = x.predictions.select("doc_id", c("code").alias("label"), "prob")
    said = p.where("prob >= 0.5D").withColumn("model", F.lit("half")).unionByName(p.where("prob >= 0.8D").withColumn("model", F.lit("strict")))
    return E.multilabel_f1(truth, said, keys=["model"])


@query("a21_multilabel_f1", "claims", "predictions", sql=f"WITH {ML} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1 FROM pl WHERE model = 'half'")
def a21(x: Inputs) -> DataFrame:
    return multilabel(x).where("model = 'half'").select(*(F.round(m, 9).alias(m) for m in ("micro_f1", "macro_f1")))


@query("v27_model_comparison", "claims", "predictions", sql=f"WITH {ML} SELECT model, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1 FROM pl GROUP BY model")
def v27(x: Inputs) -> DataFrame:
    return multilabel(x).select("model", *(F.round(m, 9).alias(m) for m in ("micro_f1", "macro_f1")))


@query("p14_valid_scores", "technique_scores", sql="SELECT technique, count(*) AS n FROM technique_scores WHERE score >= 0 GROUP BY technique")
def p14(x: Inputs) -> DataFrame:
    return E.valid(x.technique_scores).groupBy("technique").agg(F.count("*").alias("n"))


TECH = "SELECT technique, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(*) AS n FROM technique_scores WHERE score >= 0 GROUP BY technique"


@query("a12_technique_stats", "technique_scores", sql=TECH)
def a12(x: Inputs) -> DataFrame:
    return E.by_technique(x.technique_scores).withColumn("avg_score", F.round("avg_score", 6))


RIGHT = "CASE WHEN technique IN ('enhancement') THEN score < 0.5::double ELSE score >= 0.5::double END"


@query("a13_technique_accuracy", "technique_scores", sql=f"SELECT technique, round(avg(({RIGHT})::int), 9) AS accuracy, count(*) AS n FROM technique_scores WHERE score >= 0 GROUP BY ROLLUP (technique)")
def a13(x: Inputs) -> DataFrame:
    return E.accuracy_at(x.technique_scores, ["enhancement"]).withColumn("accuracy", F.round("accuracy", 9))


@query("a14_weak_techniques", "technique_scores", sql="SELECT technique FROM technique_scores WHERE score >= 0 GROUP BY technique HAVING avg(score) < 0.5::double")
def a14(x: Inputs) -> DataFrame:
    return E.weak_techniques(x.technique_scores).select("technique")


@query("v34_robustness_report", "technique_scores", sql=f"SELECT technique, CASE WHEN avg(({RIGHT})::int) * 100 >= 90 THEN 'excellent' WHEN avg(({RIGHT})::int) * 100 >= 75 THEN 'good' ELSE 'needs improvement' END AS grade FROM technique_scores WHERE score >= 0 GROUP BY ROLLUP (technique)")
def v34(x: Inputs) -> DataFrame:
    return E.accuracy_at(x.technique_scores, ["enhancement"]).select("technique", E.grade(c("accuracy") * 100).alias("grade"))


CATV = "SELECT CASE WHEN path_id % 3 = 0 THEN 'authentic' ELSE 'forged' END AS category, CASE WHEN cnn < 0.2 THEN 'authentic' WHEN cnn < 0.35 THEN 'suspicious' ELSE 'tampered' END AS verdict FROM image_scores"


@query("a15_category_summary", "image_scores", sql=f"WITH k AS ({CATV}) SELECT category, count_if(r) AS right, count(*) AS n, count_if(r) = count(*) AS passed FROM (SELECT *, CASE WHEN category = 'authentic' THEN verdict IN ('authentic', 'suspicious') ELSE verdict = 'tampered' END AS r FROM k) GROUP BY category")
def a15(x: Inputs) -> DataFrame:
    return E.category_summary(x.sql(CATV, "image_scores"), "category", "verdict")


@query("a16_score_distribution", "image_scores", sql=f"WITH {SC} SELECT round(avg(cnn), 6) AS cnn_mean, round(stddev_pop(cnn), 6) AS cnn_std, round(avg(fused), 6) AS fused_mean, round(stddev_pop(fused), 6) AS fused_std, round(100 * count_if(fused >= 0.5::double) / count(*), 6) AS over_pct, count(*) AS n FROM sc")
def a16(x: Inputs) -> DataFrame:
    return E.score_distribution(scores(x), "cnn", "fused").select(*(F.round(m, 6).alias(m) for m in ("cnn_mean", "cnn_std", "fused_mean", "fused_std", "over_pct")), "n")


@query("a17_histogram", "image_scores", sql="WITH e AS (SELECT min(ela) AS lo, (max(ela) - min(ela)) / 50 AS w FROM image_scores) SELECT least(floor((ela - lo) / w), 49)::int AS bin, count(*) AS n FROM image_scores, e GROUP BY 1")
def a17(x: Inputs) -> DataFrame:
    return E.histogram(x.image_scores, "ela")


@query("a25_best_run", "runs", sql="SELECT run_id, epoch, auc FROM runs WHERE NOT isnan(auc) ORDER BY auc DESC, run_id, epoch LIMIT 1")
def a25(x: Inputs) -> DataFrame:
    return E.best_run(x.runs)


@query("a26_run_status", "runs", sql="SELECT run_id, max(epoch) AS latest, count(*) AS checkpoints, max(epoch) = 99 AS completed FROM runs GROUP BY run_id")
def a26(x: Inputs) -> DataFrame:
    return E.run_status(x.runs, 99)


# -- pixels and embeddings

PX = "list_transform(embedding, lambda v: cast(floor((v::double + 1) * 100) AS int))"
PX2 = "list_transform(embedding, lambda v: cast(floor((v::double + 1) * 103) AS int))"
LONG = f"lp AS (SELECT vec_id, unnest({PX}) AS px FROM embeddings)"


def pixels(x: Inputs) -> DataFrame:
    scaled = lambda k: F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * k).cast("int"))
    return x.embeddings.select("vec_id", scaled(100).alias("px"), scaled(103).alias("px2"), "embedding")


@query("f15_window_level", sql=f"SELECT vec_id, array_to_string(list_transform({PX}, lambda v: trunc((greatest(70::double, least(130::double, v::double)) - 70) / 60 * 255)::int), ',') AS px FROM embeddings")
def f15(x: Inputs) -> DataFrame:
    return pixels(x).select("vec_id", F.array_join(I.window_level(c("px"), 100.0, 60.0), ",").alias("px"))


@query("f16_intensity_rescale", sql=f"WITH p AS (SELECT vec_id, {PX} AS px FROM embeddings) SELECT vec_id, array_to_string(list_transform(px, lambda v: trunc((v - list_min(px)) * 255::double / (list_max(px) - list_min(px)))::int), ',') AS px, round(list_sum(list_transform(px, lambda v: v * 2::double - 1024)), 6) AS hu FROM p")
def f16(x: Inputs) -> DataFrame:
    hu = F.aggregate(I.slope_intercept(c("px"), 2.0, -1024.0), F.lit(0.0), lambda s, v: s + v)
    return pixels(x).select("vec_id", F.array_join(I.rescale(c("px")), ",").alias("px"), F.round(hu, 6).alias("hu"))


WRAP = f"list_transform(list_zip({PX}, {PX2}), lambda z: ((((z[1] - z[2]) % 256 + 256) % 256) * 10) % 256)"


@query("f17_recompression_difference", sql=f"SELECT vec_id, array_to_string({WRAP}, ',') AS diff, array_to_string(list_transform(list_zip({PX}, {PX2}), lambda z: least(abs(z[1] - z[2]) * 10, 255)), ',') AS true_diff FROM embeddings")
def f17(x: Inputs) -> DataFrame:
    d, t = (I.recompression_difference(c("px"), c("px2"), wrap=w) for w in (True, False))
    return pixels(x).select("vec_id", F.array_join(d, ",").alias("diff"), F.array_join(t, ",").alias("true_diff"))


@query("a30_difference_score", sql=f"WITH d AS (SELECT vec_id, list_sum({WRAP})::double / 64 / 255 AS m FROM embeddings) SELECT vec_id, round(m, 9) AS score, round(0.7::double * least(1, greatest(0, (vec_id % 20) / 15::double)) + 0.3::double * m, 9) AS with_area FROM d")
def a30(x: Inputs) -> DataFrame:
    d = I.recompression_difference(c("px"), c("px2"))
    return pixels(x).select("vec_id", F.round(I.difference_score(d), 9).alias("score"), F.round(I.difference_score(d, (c("vec_id") % 20).cast("double")), 9).alias("with_area"))


@query("a31_percentile_level", sql=f"WITH {LONG} SELECT vec_id, round(quantile_cont(px::double, 0.99), 6) AS level FROM lp GROUP BY vec_id")
def a31(x: Inputs) -> DataFrame:
    long = pixels(x).select("vec_id", F.explode("px").alias("px"))
    return E.clip_level(long, "vec_id", "px").withColumn("level", F.round("level", 6))


REG = "rg AS (SELECT l_orderkey AS image, l_linenumber AS region_id, cast(l_quantity AS double) AS area FROM lineitem), kr AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, region_id) AS r FROM rg WHERE area >= 20)"


def regions(x: Inputs) -> DataFrame:
    return x.lineitem.select(c("l_orderkey").alias("image"), c("l_linenumber").alias("region_id"), c("l_quantity").cast("double").alias("area"))


@query("a32_suspicious_area", sql=f"WITH {REG} SELECT image, 100 * sum(area) / 1000::double AS area_pct, count(*) AS regions FROM kr WHERE r <= 5 GROUP BY image")
def a32(x: Inputs) -> DataFrame:
    return E.suspicious_area(regions(x), "image", 1000.0)


@query("t4_largest_regions", sql=f"WITH {REG} SELECT image, region_id, area FROM kr WHERE r <= 5")
def t4(x: Inputs) -> DataFrame:
    kept = regions(x).where("area >= 20").withColumn("_neg", -c("area"))
    return D.first_rows(kept, 5, "_neg", "region_id", by=["image"]).select("image", "region_id", "area")


@query("a33_masked_mean", sql="WITH l AS (SELECT vec_id // 10 AS doc, CASE WHEN vec_id % 3 = 0 THEN 0::double ELSE 1::double END AS m, unnest(range(0, 64)) AS pos, unnest(embedding)::double AS v FROM embeddings) SELECT doc, pos::int AS pos, round(sum(v * m) / greatest(sum(m), 1e-9), 6) AS value FROM l GROUP BY ALL")
def a33(x: Inputs) -> DataFrame:
    tokens = x.embeddings.select(F.floor(c("vec_id") / 10).alias("doc"), (c("vec_id") % 3 != 0).cast("int").alias("m"), "embedding")
    return E.pooled(tokens, "doc", "embedding", "m").withColumn("value", F.round("value", 6))


@query("v26_linear_head_scores", sql="SELECT a.vec_id, b.vec_id AS label, round(1 / (1 + exp(-list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)))), 6) AS prob FROM embeddings a, embeddings b WHERE b.vec_id < 5")
def v26(x: Inputs) -> DataFrame:
    from sparkverity.operators.models import head_scores

    head = x.embeddings.where("vec_id < 5").select(c("vec_id").alias("label"), c("embedding").alias("weights"), F.lit(0.0).alias("bias"))
    return head_scores(x.embeddings.select("vec_id", "embedding"), head).withColumn("prob", F.round("prob", 6))
