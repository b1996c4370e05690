from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from sparkverity.llm import decontam, langid, mixing, simhash
from sparkverity.llm.common import table
from tests.compare import connect, differences
from tests.llm.test_operators import awkward

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_is_the_chain_of_its_stages(spark):
    docs = table(spark, FOLDER, "documents")
    known = {r.doc_id for r in langid.identify(docs).where("lang_pred <> 'und' AND NOT ambiguous").collect()}
    one = {r.doc_id for r in simhash.near_duplicates(docs.where(docs.doc_id.isin(list(known)))).where("doc_id = component_id").collect()}
    leaked = {r.doc_id for r in decontam.find(docs, table(spark, FOLDER, "benchmark")).where("contaminated").collect()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == one - leaked
    assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_training_order_follows_the_mix(spark):
    rows = sorted(corpus_pipeline.run(spark, FOLDER).collect(), key=lambda r: r.slot)
    source = {r.doc_id: r.source for r in table(spark, FOLDER, "documents").collect()}
    docs = table(spark, FOLDER, "documents").where(F.col("doc_id").isin(list({r.doc_id for r in rows})))
    weights = {k[1:]: w for k, (_, w) in mixing.targets(docs).items()}
    of, total = [source[r.doc_id] for r in rows], sum(weights.values())
    left = Counter(of)
    for at, own in enumerate(of, 1):
        left[own] -= 1
        if not left[own]:
            break
        if at % 32 == 0:
            got = Counter(of[:at])
            assert all(abs(got[k] - at * w / total) < 2 * 32 for k, w in weights.items())
    assert len(weights) > 1 and at > 64


def test_stages_keep_columns(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark).withColumn("_key", F.lit("k")).withColumn("_row", F.lit(1))
    kept = {"language_id": None, "simhash_near_dedup": None, "benchmark_decontamination": docs.count(), "source_mixing": docs.count()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert kept[name] is None or out.count() == kept[name], name
        none = stage(spark, docs.limit(0), FOLDER)
        assert none.columns == docs.columns and none.count() == 0, name
    one = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert Counter(r.text for r in one.collect())["same text here"] == 1
    tokens = corpus_pipeline.tokens(spark, docs, FOLDER)
    assert sorted(r.slot for r in tokens.collect()) == list(range(tokens.count())) and corpus_pipeline.tokens(spark, docs.limit(0), FOLDER).count() == 0


def test_against_sql(spark):
    con = connect(FOLDER)
    for name in ("op2_exact_topk", "op4_decontamination", "op8_warc_chunks"):
        assert differences(entry.queries()[name](spark, FOLDER).toPandas(), con.sql(entry.oracle_sql()[name]).df()) == "", name


def test_all_numbers_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
