"""Compare registered queries with their SQL on one folder: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows under the same column names."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    names = sorted(got.columns)

    def rows(df: pd.DataFrame) -> list[str]:
        def text(x) -> str:
            if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
                return "~"
            if isinstance(x, float):
                return f"{x:.9g}"
            return str(x.isoformat()) if hasattr(x, "isoformat") else str(x)

        df = df[names].astype(object)
        floats = {c for c in names if any(isinstance(v, float) for v in df[c])}
        return sorted("|".join(text(float(v)) if c in floats and isinstance(v, int | float) and v == v and v is not None else text(v) for c, v in zip(names, r, strict=True)) for r in df.itertuples(index=False, name=None))

    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, queries, failed = connect(folder), e.oracle_sql(), e.queries(), 0
    for name in names or list(queries):
        if not any(name == q or q.startswith(name) for q in queries):
            print("no such query", name)
            failed += 1
        for q in [q for q in queries if q == name or (name not in queries and q.startswith(name))]:
            began = time.time()
            try:
                got = queries[q](spark, folder).toPandas()
                said = differences(got, con.sql(sql[q]).df()) if q in sql else "no SQL"
                said = said or ("ok" if len(got) else "ok, but EMPTY")
            except Exception as x:  # noqa: BLE001
                said = "ERROR " + str(x)[:600]
            failed += not said.startswith(("ok", "no SQL"))
            print(f"{q}: {said} ({time.time() - began:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
