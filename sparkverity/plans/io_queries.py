"""Queries that write a table in one of the engine's formats and read it back, and the models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkverity.functions import text as T
from sparkverity.operators import claims as C
from sparkverity.operators import datasets as D
from sparkverity.operators import models as M
from sparkverity.session import new_dir
from sparkverity.sources import io
from sparkverity.sources.views import Inputs, query

c = F.col


@query("s3_gz_csv", "notes", sql="SELECT note_id::varchar AS note_id, note_type, text FROM notes")
def s3(x: Inputs) -> DataFrame:
    io.write_table(x.notes.select("note_id", "note_type", "text"), path := new_dir(x.spark, "gz"), compression="gzip")
    return io.read_gz(x.spark, path, 8)


@query("s4_json_lines", "notes", sql="SELECT note_id, subject_id, hadm_id, note_type, text, array_to_string([note_type, 'x'], ',') AS labels FROM notes")
def s4(x: Inputs) -> DataFrame:
    io.write_lines(x.notes.withColumn("labels", F.array("note_type", F.lit("x"))), path := new_dir(x.spark, "lines"))
    return io.read_lines(x.spark, path).withColumn("labels", F.array_join("labels", ","))


@query("s5_label_map", "diagnoses", sql="SELECT replace(upper(trim(icd_code)), ' ', '') AS label, (row_number() OVER (ORDER BY count(*) DESC, replace(upper(trim(icd_code)), ' ', '')) - 1)::int AS idx FROM diagnoses GROUP BY 1")
def s5(x: Inputs) -> DataFrame:
    io.write_label_map(D.label_index(D.code_counts(x.diagnoses)), path := new_dir(x.spark, "labels"))
    return io.read_label_map(x.spark, path)


@query("s6_hash_table", sql="SELECT 'IMG' || vec_id AS filename, lpad(format('{:x}', vec_id * 7919), 16, '0') AS phash_hex FROM embeddings")
def s6(x: Inputs) -> DataFrame:
    rows = x.embeddings.select(F.concat(F.lit("IMG"), c("vec_id")).alias("filename"), F.lower(F.lpad(F.hex(c("vec_id") * 7919), 16, "0")).alias("phash_hex"))
    io.write_hashes(rows, path := new_dir(x.spark, "hashes"))
    return io.read_hashes(x.spark, path)


@query("s11_metadata_csv", "header_meta", sql='SELECT subject_id AS "Subject ID", collection FROM header_meta')
def s11(x: Inputs) -> DataFrame:
    io.write_table(x.header_meta.select(F.concat(F.lit(" "), "subject_id", F.lit(" ")).alias("Subject ID"), "collection"), path := new_dir(x.spark, "meta"))
    return io.read_metadata(x.spark, path)


@query("s12_claims_json", "claims", sql="SELECT claim_id, clinical_text, claim_amount, previous_claim_count, phash_score FROM claims")
def s12(x: Inputs) -> DataFrame:
    x.claims.write.mode("overwrite").json(path := new_dir(x.spark, "claims"))
    return x.spark.read.schema(io.CLAIMS).json(path).select("claim_id", "clinical_text", "claim_amount", "previous_claim_count", "phash_score")


@query("s13_claim_reports", "claims", sql="SELECT claim_id, claim_amount > 10000 AS large FROM claims")
def s13(x: Inputs) -> DataFrame:
    io.write_reports(C.verify(x.claims), path := new_dir(x.spark, "reports"))
    back = x.spark.read.text(path).select(F.from_json("value", "claim_id bigint, features struct<claim_amount_log double>").alias("r"))
    return back.select("r.claim_id", (c("r.features.claim_amount_log") > F.log1p(F.lit(10000.0))).alias("large"))


@query("s14_result_csv", "image_scores", sql="SELECT path_id::varchar AS path_id, label::varchar AS label FROM image_scores")
def s14(x: Inputs) -> DataFrame:
    io.write_table(x.image_scores.select("path_id", "label"), path := new_dir(x.spark, "scores"))
    return io.read_strings(x.spark, path)


@query("s15_metric_json", "image_scores", sql="SELECT count(*) AS n, sum(label)::bigint AS positive FROM image_scores")
def s15(x: Inputs) -> DataFrame:
    io.write_metrics(x.image_scores.agg(F.count("*").alias("n"), F.sum("label").alias("positive")), path := new_dir(x.spark, "metrics"))
    return x.spark.read.schema("n long, positive long").json(path)


def _training(x: Inputs) -> DataFrame:
    rows = C.verify(x.claims).select("claim_id", "features.*", "claim_amount")
    return rows.withColumn("fraud", ((c("ela_score") > 0.35) & (c("phash_score") > 0.3)).cast("int"))


@query("s16_fraud_training_csv", "claims", sql="SELECT count(*) AS n, sum(CASE WHEN ela_score > 0.35::double AND phash_score > 0.3::double THEN 1 ELSE 0 END)::bigint AS fraud FROM claims")
def s16(x: Inputs) -> DataFrame:
    _training(x).select(*io.columns(io.FRAUD_TRAINING)).write.mode("overwrite").option("header", True).csv(path := new_dir(x.spark, "training"))
    return io.read_training(x.spark, path).agg(F.count("*").alias("n"), F.sum("fraud").alias("fraud"))


#: The label is a rule on two features, which the first tree finds; each later one adds a tenth of what
#: the log loss still asks for. So the margin after some rounds is known, and with it the probability.
def _boosted(rounds: int) -> float:
    margin = 1.0
    for _ in range(rounds - 1):
        margin += 0.1 * 4 / (1 + math.exp(2 * margin))
    return margin


RULE = "(ela_score > 0.35::double AND coalesce(phash_score, 0.0::double) > 0.3::double)"
PROB = "round(1 / (1 + exp(-2 * CASE WHEN fraud = 1 THEN {m} ELSE -{m} END)), 6)"


@query("v24_fraud_model", "claims", sql=f"""WITH l AS (SELECT claim_id, {RULE}::int AS fraud FROM claims), s AS (SELECT *, row_number() OVER (PARTITION BY fraud ORDER BY md5(claim_id || '-42'), claim_id) AS r, count(*) OVER (PARTITION BY fraud) AS t FROM l)
SELECT claim_id, fraud, {PROB.format(m=f"{_boosted(5)!r}::double")} AS probability FROM s WHERE r <= floor(t * 0.2::double)""")
def v24(x: Inputs) -> DataFrame:
    rows = D.split(_training(x).drop("claim_amount"), "claim_id", 0.2, by=["fraud"])
    trees = M.tree_rows(M.fit_fraud(rows.where("split = 'train'"), rounds=5), x.spark)
    return M.tree_scores(trees, rows.where("split = 'val'")).select("claim_id", "fraud", F.round("probability", 6).alias("probability"))


@query("s17_model_round_trip", "claims", sql=f"SELECT claim_id, {PROB.format(m=f'{_boosted(2)!r}::double')} AS probability, true AS alike FROM (SELECT claim_id, {RULE}::int AS fraud FROM claims)")
def s17(x: Inputs) -> DataFrame:
    """A model saved as rows and loaded scores as the saved model of the library does."""
    rows = _training(x).drop("claim_amount")
    model = M.fit_fraud(rows, rounds=2)
    io.save_trees(M.tree_rows(model, x.spark), path := new_dir(x.spark, "tree-rows"))
    io.save_model(model, whole := new_dir(x.spark, "model"))
    both = M.tree_scores(io.load_trees(x.spark, path), M.fraud_scores(io.load_model(whole), rows).withColumnRenamed("probability", "other"))
    return both.select("claim_id", F.round("probability", 6).alias("probability"), (F.abs(c("probability") - c("other")) < 1e-12).alias("alike"))


@query("a35_driver_ranking", sql="SELECT feature, 'High image forgery confidence' AS driver FROM (VALUES ('ela_score'), ('phash_score')) AS t(feature)")
def a35(x: Inputs) -> DataFrame:
    """Of the features that matter at all: the two the label was made from."""
    return M.drivers(M.tree_rows(M.fit_fraud(_training(x).drop("claim_amount"), rounds=3), x.spark)).where("importance > 0.001").select("feature", "driver")


@query("v25_text_baseline")
def v25(x: Inputs) -> DataFrame:
    """A head for every code of the code list."""
    rows = x.claims.select("claim_id", "clinical_text", T.declared_codes(c("clinical_text")).alias("labels")).withColumn("text", T.mask_codes(c("clinical_text")))
    labels = [r.code for r in x.dx.select("code").distinct().orderBy("code").collect()]
    prepare, head = M.fit_text_labels(rows, labels)
    return M.text_label_scores(prepare, head, rows, "claim_id")


#: The same heads by plain descent: 250 steps of 1 / (half a unit of curvature + penalty) with momentum, on rows of length one.
_M = ((0.505**0.5 - 0.1) / (0.505**0.5 + 0.1))
HEAD_SQL = f"""WITH RECURSIVE d AS (SELECT vec_id, list_concat(list_transform(embedding, lambda v: v::double), [1::double]) AS x, embedding[1] > 0 AS up FROM embeddings),
f AS (SELECT vec_id, generate_subscripts(x, 1) AS j, unnest(x) AS v FROM d), m AS (SELECT count(*) AS n, max(len(x)) AS k FROM d),
t(step, w, ahead) AS (
 SELECT 0, list_transform(range(k), lambda j: 0::double), list_transform(range(k), lambda j: 0::double) FROM m
 UNION ALL
 SELECT step + 1, new, list_transform(range(1, len(new) + 1), lambda j: new[j] + {_M}::double * (new[j] - w[j])) FROM (
  SELECT step, w, list_transform(range(1, len(w) + 1), lambda j: ahead[j] - (g[j] / n + CASE WHEN j < len(w) THEN 0.01::double * ahead[j] ELSE 0 END) / 0.51::double) AS new FROM (
   SELECT t.step, t.w, t.ahead, (SELECT n FROM m) AS n, (SELECT list(s ORDER BY j) FROM (SELECT j, sum(v * (p - up::int)) AS s FROM f JOIN
     (SELECT vec_id, up, 1 / (1 + exp(-list_dot_product(x, (SELECT any_value(ahead) FROM t)))) AS p FROM d) USING (vec_id) GROUP BY j)) AS g FROM t WHERE t.step < 250)))
SELECT vec_id, label, round(CASE WHEN label = 'up' THEN p ELSE 1 - p END, 4) AS prob FROM (SELECT vec_id, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM d, t WHERE step = 250), (VALUES ('up'), ('down')) AS l(label)"""


@query("v26_linear_head", sql=HEAD_SQL)
def v26(x: Inputs) -> DataFrame:
    rows = x.embeddings.select("vec_id", "embedding", F.array(F.when(c("embedding")[0] > 0, "up").otherwise("down")).alias("labels"))
    return M.head_scores(rows.select("vec_id", "embedding"), M.fit_head(rows, ["up", "down"])).withColumn("prob", F.round("prob", 4))


def _matrix(n: int = 8, size: int = 32, keep: int = 8) -> str:
    """The same matrix of whole numbers for pictures of n pixels a side, as a list for the SQL."""
    at = [max(0, min(2 * size * (n - 1), (2 * k + 1) * n - size)) for k in range(size)]

    def cosine(u: int, k: int) -> int:
        half = min(turn := (2 * k + 1) * u % (4 * size), 4 * size - turn)
        quarter = round(math.sqrt((1 if u == 0 else 2) / size) * math.cos(math.pi * min(half, 2 * size - half) / (2 * size)) / io.COSINE_UNIT)
        return -quarter if half > size else quarter

    rows = [[sum(cosine(u, k) * max(0, 2 * size - abs(at[k] - 2 * size * i)) for k in range(size)) for i in range(n)] for u in range(keep)]
    return str(rows) + "::hugeint[][]"


def _pixels() -> Column:
    """Each vector stands for a grey picture of 8 x 8 pixels; NaN and null are the lightest."""
    px = F.transform("embedding", lambda v: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + 0.5) * 255))).cast("int")), 2, "0"))
    return F.unhex(F.array_join(px, ""))


@query("v32_hash_table_job", sql=f"""WITH a AS (SELECT {_matrix()} AS a), p AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, floor((v::double + 0.5::double) * 255)))::hugeint) AS px FROM embeddings WHERE len(embedding) = 64),
t AS (SELECT vec_id, a, list_transform(a, lambda r: list_transform(range(0, 8), lambda x: list_sum(list_transform(range(0, 8), lambda y: r[y + 1] * px[y * 8 + x + 1])))) AS t FROM p, a),
k AS (SELECT vec_id, flatten(list_transform(t, lambda r: list_transform(a, lambda b: list_sum(list_transform(range(1, 9), lambda x: r[x] * b[x]))))) AS k FROM t),
m AS (SELECT vec_id, k, list_sort(k)[32] + list_sort(k)[33] AS m FROM k)
SELECT vec_id::varchar AS filename, lower(printf('%016x', array_to_string(list_transform(k, lambda x: CASE WHEN x + x > m THEN '1' ELSE '0' END), '')::bit::bigint)) AS phash_hex FROM m""")
def v32(x: Inputs) -> DataFrame:
    """The picture of a vector that isn't 64 long is unreadable."""
    return io.hash_table(x.embeddings.select(c("vec_id").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), _pixels().alias("grey")))


@query("s8_image_directory", sql="SELECT label || '/IMG' || vec_id || CASE WHEN vec_id % 2 = 0 THEN '.png' ELSE '.JPG' END AS path, 64::bigint AS bytes FROM embeddings")
def s8(x: Inputs) -> DataFrame:
    """A picture file for each vector, in folders by label, beside a text file for each; the pictures are found again."""
    name = F.concat(c("label"), F.lit("/IMG"), c("vec_id"))
    kinds = F.array(F.struct(F.when(c("vec_id") % 2 == 0, ".png").otherwise(".JPG").alias("end"), _pixels().alias("content")), F.struct(F.lit(".txt").alias("end"), F.lit("no picture").cast("binary").alias("content")))
    files = x.embeddings.select(name.alias("name"), F.inline(kinds)).select(F.concat("name", "end").alias("path"), "content")
    io.write_files(files, folder := new_dir(x.spark, "pictures"))
    return io.image_listing(x.spark, folder).select("path", "bytes")


@query("f29_code_items", "predictions", sql="SELECT doc_id, code, CASE WHEN ord % 4 = 3 THEN 0::double ELSE prob END AS prob FROM predictions")
def f29(x: Inputs) -> DataFrame:
    """Predictions that arrive as JSON maps of two kinds, lists or plain text, as (code, confidence)."""
    kind = c("ord") % 4
    raw = (
        F.when(kind == 0, F.to_json(F.struct("code", c("prob").alias("confidence")))).when(kind == 1, F.to_json(F.array(c("code"), c("prob").cast("string"))))
        .when(kind == 2, F.to_json(F.struct(c("code").alias("icd"), c("prob").alias("confidence")))).otherwise(F.concat(F.lit('"'), c("code"), F.lit('"')))
    )
    v = F.parse_json(raw)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    code = F.coalesce(get("$.code", "string"), get("$.icd", "string"), get("$[0]", "string"), get("$", "string"))
    return x.predictions.select("doc_id", code.alias("code"), F.coalesce(get("$.confidence", "double"), get("$[1]", "string").try_cast("double"), F.lit(0.0)).alias("prob"))
