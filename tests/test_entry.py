"""The driver contract, and every query with SQL at the smallest scale."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from sparkverity.sources.views import QUERIES, SQL
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["v20_verdict_counts", "v3_evaluation_rows", "j11_banded_pairs", "v28_labelled_note_job", "v33_evaluation_job", "v31_image_dataset_job", "f29_code_items", "st1_verify_stream", "v32_hash_table_job", "x1_text_predictor", "s8_image_directory"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 150 and len(SQL) > 140


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER).toPandas(), connect(FOLDER).sql(entry.oracle_sql()[name]).df()) == ""


def test_hash_table_of_tied_and_unreadable_pictures(spark, tmp_path):
    """Pictures with equal coefficients at the median (one colour, mirror images, bands), and vectors that are no picture."""
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    vectors = [None, [], [0.1] * 63, [0.1] * 65, [None] + [0.1] * 63, [None] + [0.1] * 64, [nan] * 64, [nan, inf, -inf] + [0.1] * 61, [-9.0] * 64, [9.0] * 64, [0.0] * 64]
    for _ in range(20):
        m = [[(rng.randrange(256) + 0.5) / 255 - 0.5 for _ in range(8)] for _ in range(8)]
        diagonal, across, down = [[m[min(i, j)][max(i, j)] for j in range(8)] for i in range(8)], [r[:4] + r[3::-1] for r in m], m[:4] + m[3::-1]
        vectors += [sum(p, []) for p in (m, diagonal, across, down, across[:4] + across[3::-1], [[v] * 8 for v in m[0]], [[0.3 * (v > 0) for v in r] for r in m])]
    columns = {"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}
    pq.write_table(pa.table(columns), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = entry.queries()["v32_hash_table_job"](spark, str(tmp_path)).toPandas()
    assert differences(got, con.sql(entry.oracle_sql()["v32_hash_table_job"]).df()) == ""
    assert len(got) == len(vectors) - 5 and set(got.phash_hex[got.filename.isin(["8", "9", "10"])]) == {"0000000000000000", "8000000000000000"}
