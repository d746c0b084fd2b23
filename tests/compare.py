"""Compare registered queries with their SQL: `python tests/compare.py SF_DIR [query ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as spark_entry  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        files = f if f.is_file() else f / "*.parquet"
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{files}'")
    return con


def _ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.astype(object).where(df.notna(), None)
    return text.sort_values(by=list(text.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    got_df = spark_entry.queries()[name](spark, sf_dir)
    got = got_df.toPandas()
    rel = con.sql(spark_entry.oracle_sql()[name])
    want = rel.df()
    kinds = {
        "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN",
    }
    got_types = {n: kinds.get(t, t) for n, t in got_df.dtypes}
    want_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if got_types != want_types:
        return f"types {sorted(got_types.items() ^ want_types.items())}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL {len(want)}"
    a, b = _ordered(got), _ordered(want)
    for c in a.columns:
        same = [x == y or (x is None and y is None) for x, y in zip(a[c], b[c])]
        if not all(same):
            i = same.index(False)
            return f"{c}: {a.iloc[i].to_dict()} SQL {b.iloc[i].to_dict()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from conftest import make_session

    spark = make_session()
    con = duck(sf_dir)
    bad = 0
    for name in names or spark_entry.queries():
        start = time.time()
        if name not in spark_entry.oracle_sql():
            n, why = spark_entry.queries()[name](spark, sf_dir).count(), None
            print(f"rows {n:8d} {time.time() - start:6.2f}s {name}", flush=True)
            continue
        try:
            why = difference(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {time.time() - start:6.2f}s {name} {why or ''}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
