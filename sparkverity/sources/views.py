"""Views over the base tables, as one SQL text for Spark and DuckDB, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "dx": """SELECT * FROM (VALUES
 (0,'essential hypertension','I10'),(1,'diabetes mellitus type 2','E11.9'),
 (2,'colon cancer of sigmoid','C18.7'),(3,'bacterial pneumonia','J15.9'),
 (4,'copd with exacerbation','J44.0'),(5,'asthma with bronchitis','J45.9'),
 (6,'covid infection','U07.1'),(7,'femur fracture','S72.9'),
 (8,'ischemic heart disease','I25.9'),(9,'stroke','I63.9'),
 (10,'breast cancer','C50.9'),(11,'abdominal pain','R10.4'),
 (12,'lung nodule','R91.1')) AS t(i, phrase, code)""",
    "claims": """SELECT o.o_orderkey AS claim_id, concat('P', cast(o.o_custkey AS string)) AS patient_id,
 concat(CASE WHEN o.o_orderkey % 4 <> 0 THEN concat('Patient ID: P', cast(o.o_custkey AS string), '. ') ELSE '' END,
  'Diagnosis: ', d.phrase, '. ICD-10: ', d.code,
  CASE WHEN o.o_orderkey % 3 = 0 THEN concat(', also ', lower(e.code)) ELSE '' END, '.') AS clinical_text,
 o.o_totalprice / cast(20 AS double) AS claim_amount,
 cast(count(*) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS int) AS previous_claim_count,
 CASE WHEN o.o_orderkey % 6 = 0 THEN NULL WHEN o.o_orderkey % 6 = 1 THEN concat('P', cast(o.o_custkey + 1 AS string))
  ELSE concat('p', cast(o.o_custkey AS string)) END AS img_patient_id,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'CT' WHEN 1 THEN 'MR' WHEN 2 THEN 'XA' WHEN 3 THEN 'Other' ELSE NULL END AS img_modality,
 CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE (o.o_orderkey * 37 % 101) / cast(140 AS double) END AS cnn_score,
 (o.o_orderkey * 53 % 101) / cast(180 AS double) AS ela_score,
 CASE WHEN o.o_orderkey % 10 < 4 THEN NULL ELSE (o.o_orderkey * 71 % 101) / cast(115 AS double) END AS phash_score,
 o.o_orderdate AS claim_ts
FROM orders o JOIN dx d ON d.i = (o.o_orderkey * 7 + 3) % 13 JOIN dx e ON e.i = (o.o_orderkey * 5 + 1) % 13""",
    "predictions": """SELECT o.o_orderkey AS doc_id,
 CASE WHEN o.o_orderkey % 4 = 1 THEN concat(substr(d.code, 1, 3), '.8') ELSE d.code END AS code,
 ((o.o_orderkey * (d.i + 3) * 29 + d.i * 17) % 101) / cast(100 AS double) AS prob, d.i AS ord
FROM orders o CROSS JOIN dx d WHERE o.o_orderkey % 5 <> 0""",
    "hash_refs": "SELECT vec_id, concat('IMG', cast(vec_id AS string)) AS image_id, bits FROM hash_bits WHERE vec_id % 2 = 0",
    "hash_queries": """SELECT vec_id, cast(vec_id % 13 AS int) AS flipped,
 concat(translate(substr(bits, 1, cast(vec_id % 13 AS int)), '01', '10'), substr(bits, cast(vec_id % 13 AS int) + 1, 64)) AS bits
FROM hash_bits""",
    "diagnoses": """SELECT l_orderkey AS hadm_id, concat(CASE cast(l_partkey % 5 AS int) WHEN 0 THEN 'c' WHEN 1 THEN 'E' WHEN 2 THEN 'I ' WHEN 3 THEN 'J' ELSE 'K' END,
 lpad(cast(l_suppkey % 20 AS string), 2, '0'), '.', cast(l_linenumber % 3 AS string)) AS icd_code FROM lineitem""",
    "notes": """SELECT claim_id AS note_id, patient_id AS subject_id, CASE WHEN claim_id % 17 = 0 THEN NULL ELSE claim_id END AS hadm_id,
 CASE WHEN claim_id % 3 = 0 THEN 'RR' ELSE 'DS' END AS note_type, clinical_text AS text FROM claims""",
    "image_scores": """SELECT claim_id AS path_id, CASE WHEN claim_id * 37 % 101 + claim_id * 91 % 60 > 90 THEN 1 ELSE 0 END AS label,
 coalesce(cnn_score, cast(0 AS double)) AS cnn, ela_score AS ela, phash_score AS phash FROM claims""",
    "technique_scores": """SELECT CASE cast(l_linenumber AS int) WHEN 1 THEN 'copy_move' WHEN 2 THEN 'splicing' WHEN 3 THEN 'enhancement'
 WHEN 4 THEN 'blur' WHEN 5 THEN 'noise' WHEN 6 THEN 'compression' ELSE 'removal' END AS technique,
 CASE WHEN l_quantity < 3 THEN cast(-1 AS double) ELSE (l_partkey * 31 % 101) / cast(100 AS double) END AS score FROM lineitem""",
    "headers": """SELECT concat('P', cast(p_partkey % 50 AS string), '/S', cast(p_size AS string), '/', cast(p_partkey AS string), '.dcm') AS file_path,
 concat('P', cast(p_partkey % 50 AS string)) AS patientid,
 CASE cast(p_partkey % 7 AS int) WHEN 0 THEN 'Unknown' WHEN 1 THEN '[''ORIGINAL'', ''PRIMARY'', ''LOCALIZER'']'
  ELSE '[''ORIGINAL'', ''PRIMARY'', ''AXIAL'']' END AS imagetype,
 CASE cast(p_size % 4 AS int) WHEN 0 THEN 'CT' WHEN 1 THEN 'MR' WHEN 2 THEN 'PT' ELSE NULL END AS modality FROM part""",
    "header_meta": "SELECT concat('P', cast(s_suppkey AS string)) AS subject_id, s_name AS collection FROM supplier WHERE s_suppkey % 3 <> 0",
    "runs": """SELECT user_id AS run_id, event_id % 100 AS epoch,
 CASE WHEN event_type = 'error' THEN cast('NaN' AS double) ELSE value / cast(100 AS double) END AS auc FROM events""",
}
#: Spark and DuckDB write lambdas differently.
HASH_BITS = {
    "spark": """SELECT vec_id, element_at(transform(array(named_struct('e', embedding, 'm', (element_at(sort_array(embedding), 32) + element_at(sort_array(embedding), 33)) / 2)),
 s -> array_join(transform(s.e, x -> CASE WHEN x > s.m THEN '1' ELSE '0' END), '')), 1) AS bits FROM embeddings""",
    "duckdb": """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS bits FROM
 (SELECT vec_id, embedding, (list_sort(embedding)[32] + list_sort(embedding)[33]) / 2 AS m FROM embeddings)""",
}
NEEDS = {"claims": ["dx"], "predictions": ["dx"], "notes": ["claims"], "image_scores": ["claims"], "hash_refs": ["hash_bits"], "hash_queries": ["hash_bits"]}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _with(names: list[str], dialect: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    texts = {**VIEWS, "hash_bits": HASH_BITS[dialect]}
    return "WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in wanted) if wanted else ""


class Inputs:
    """The base tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, *views: str) -> DataFrame:
        """A SELECT over base tables and the named views."""
        full = f"{_with(list(views), 'spark')} {text}"
        used = {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", full)}
        for t in used:
            self.table(t).createOrReplaceTempView(f"sv_{t}")
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(sorted(used)) or 'none'})\b", r"\1 sv_\2", full))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name) if name in TABLES else self.sql(f"SELECT * FROM {name}", name)


def _rounded(sql: str) -> str:
    """printf of a number, with the number rounded first: Java rounds decimal halves up, C binary ones."""
    out, at = [], 0
    for m in re.finditer(r"printf\('%\.(\d)f', ", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at : m.end()], f"round({_rounded(sql[m.end() : end - 1])}, {m[1]}))"]
        at = end
    return "".join(out) + sql[at:]


def query(name: str, *views: str, sql: str | None = None) -> Callable:
    """Register a function of Inputs under a name, with SQL over the named views where there is some."""

    def add(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: function(Inputs(spark, sf_dir))
        if sql is not None:
            prefix = _with(list(views), "duckdb")
            text = _rounded(sql.strip())
            if prefix and text[:5].upper() == "WITH ":
                text = ", " + text[5:]
            SQL[name] = f"{prefix} {text}"
        return function

    return add
