"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Used by the test-suite: both results are compared as order-insensitive
multisets of rows after sorting columns by name and rounding floats.
"""

from __future__ import annotations

import math
from collections import Counter

from pagetide.sources.tables import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def rows_of_spark(df, digits: int = 6):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_norm(r[c], digits) for c in cols) for r in df.select(*cols).collect())


def rows_of_duckdb(con, sql: str, digits: int = 6):
    rel = con.sql(sql)
    cols = list(rel.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = Counter(tuple(_norm(r[i], digits) for i in order) for r in rel.fetchall())
    return [cols[i] for i in order], rows


def compare(df, con, sql: str, digits: int = 6) -> tuple[bool, str]:
    s_cols, s_rows = rows_of_spark(df, digits)
    d_cols, d_rows = rows_of_duckdb(con, sql, digits)
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} oracle={d_cols}"
    if s_rows != d_rows:
        only_s = list((s_rows - d_rows).elements())[:3]
        only_d = list((d_rows - s_rows).elements())[:3]
        return False, (f"rows differ: spark={sum(s_rows.values())} oracle={sum(d_rows.values())}; "
                       f"spark-only {only_s}; oracle-only {only_d}")
    return True, f"{sum(s_rows.values())} rows equal"
