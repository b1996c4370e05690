"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkverity.llm import decontam, divergence, langid, licenses, mixing, pii, ranges, resampling, simhash, tokenout, topk, toxicity, warc
from sparkverity.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the contract, and every match with its containment as text."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    shares = F.transform(F.array_sort(F.map_entries("found")), lambda e: F.format_string("%s:%.3f", e["key"], e["value"]))
    return found.withColumn("matches", F.array_join(shares, ",")).drop("found")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS m, list_slice(w, s + 1, s + least(10, len(w))) AS win
       FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, s, list_slice(w, s + 1, s + m) AS win
       FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM d, ms WHERE len(w) >= m)),
hits AS (SELECT r, s, dw.m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.materialise(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the interleaved order."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, cast(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
y AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM x)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f < page_id THEN f END AS refers_to
FROM y
"""


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a word's bytes, by the usual table of 256 entries that is worked out from its polynomial.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d), bw AS (SELECT unnest({_WORDS.format("text")}) AS w FROM benchmark),
steps AS (SELECT list(c ORDER BY n) AS tbl FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
          FROM (SELECT cast(unnest(range(256)) AS BIGINT) AS n))),
voc AS (SELECT w, hex(w) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(range(0, len(h) // 2), lambda i: cast(16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS BIGINT)) AS y FROM voc),
crc AS (SELECT w, xor(list_reduce(list_concat([cast(4294967295 AS BIGINT)], y), lambda a, b: xor(a // 256, tbl[xor(a % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM bytes, steps),
ds AS (SELECT r, bucket, count(*) AS n FROM dw JOIN crc USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM ds GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
sums AS (SELECT cast(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS big_s, cast(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS big_t),
g AS (SELECT bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (big_s + 10000) / ((s + 1.0::DOUBLE) * (big_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
wt AS (SELECT r, sum(n) AS n, cast(sum(n * gain) AS BIGINT) AS total FROM ds JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, cast(coalesce(n, 0) AS BIGINT) AS n_features, cast(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
      list_reduce(list_concat([cast(0 AS BIGINT)], list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(cast(doc_id AS VARCHAR), '')), i, 1)) - 1)), lambda a, b: a * 16 + b) AS h
      FROM d LEFT JOIN wt USING (r)),
y AS (SELECT *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS many FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * many // 100 THEN place END AS rank FROM z
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
gs AS (SELECT DISTINCT lang, source FROM d), dw AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM dw GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM dw JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS big_n FROM c GROUP BY ALL),
p AS (SELECT gs.lang, gs.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(n.big_n, 0) + 2 * l.v) AS p,
      1 + (1000000000 * (k.lc + 2)::HUGEINT) // (l.ln + 2 * l.v) AS q
      FROM gs JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = k.term LEFT JOIN n ON n.lang = gs.lang AND n.source = gs.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(f.value, 0) AS BIGINT) AS value FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, cast((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op13_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_exact_topk": op2_exact_topk,
        "op3_license_scan": op3_license_scan,
        "op4_decontamination": op4_decontamination,
        "op5_token_output": op5_token_output,
        "op6_pii": op6_pii,
        "op7_language_id": op7_language_id,
        "op8_warc_chunks": op8_warc_chunks,
        "op9_source_mixing": op9_source_mixing,
        "op10_simhash_near_duplicates": op10_simhash_near_duplicates,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_source_divergence": op12_source_divergence,
        "op13_embedding_near_duplicates": op13_embedding_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op4_decontamination": OP4_SQL, "op8_warc_chunks": OP8_SQL, "op11_importance_resampling": OP11_SQL, "op12_source_divergence": OP12_SQL}
