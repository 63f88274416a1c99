"""Run registered queries next to their oracles and report differences.

    python -m catalog.compare [folder of the tables] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame

from .oracles import ORACLES
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _sorted(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def differences(con: duckdb.DuckDBPyConnection, df: DataFrame, sql: str) -> str | None:
    """None when both sides agree, else what differs first."""
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = {c[0]: str(c[1]) for c in result.description}
    types = {c: (t, kinds[c]) for c, t in df.dtypes if _KINDS.get(t, t) != kinds[c] and '"NULL"' not in kinds[c]}
    expected = _sorted(columns, result.fetchall())
    actual = _sorted(df.columns, df.collect())
    if len(expected) != len(actual):
        return f"rows {len(actual)} != {len(expected)}"
    for got, want in zip(actual, expected, strict=True):
        if got != want:
            return f"{str(got)[:300]} != {str(want)[:300]}"
    return f"types {types}" if types else None


def main() -> int:
    from textsieve.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(8), connect(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.perf_counter()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = differences(con, df, ORACLES[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} {time.perf_counter() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
