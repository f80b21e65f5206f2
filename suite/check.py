"""Compare every registered query with its SQL equivalent.

    python -m suite.check <sf_dir> [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def _sorted(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, statement: str) -> str | None:
    """None when equal, else the first difference."""
    expected = con.execute(statement)
    columns = [d[0] for d in expected.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = _sorted(columns, expected.fetchall())
    got = _sorted(df.columns, df.collect())
    if len(want) != len(got):
        return f"{len(got)} rows, expected {len(want)}; first {next((p for p in zip(got, want) if p[0] != p[1]), None)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {str(bad[0])[:3000]}" if bad else None


def main(sf_dir: str, names: list[str]) -> int:
    from sourceloom.session import local_session
    from suite.oracles import sql
    from suite.queries import REGISTRY

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, statements, failed = database(sf_dir), sql(), 0
    for name in names or list(REGISTRY):
        start = time.time()
        try:
            df = REGISTRY[name](spark, sf_dir)
            result = compare(df, con, statements[name]) if name in statements else "no SQL"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += result is not None
        print(f"{name}: {result or 'equal'} ({time.time() - start:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
