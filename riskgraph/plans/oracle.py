"""Oracle SQL as handed to the checker: every double (and double-list)
column of a query's SQL is rounded to the same 6 places as the Spark side,
and DuckDB's 128-bit integer results are cast to BIGINT (Spark's type).

Column types are found with DuckDB ``DESCRIBE`` (binds, does not run) over
the smallest driver tables; if that is not possible the SQL is returned
unchanged."""

from __future__ import annotations

import os
from functools import lru_cache

from riskgraph.sources.tables import DRIVER_TABLES

_DESCRIBE_DIR = os.environ.get("RISKGRAPH_DESCRIBE_SF", "/root/testdata/sf0.001")


@lru_cache(maxsize=1)
def _con():
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{_DESCRIBE_DIR}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def rounded_sql(sql: str, places: int = 6) -> str:
    try:
        cols = _con().execute(f"DESCRIBE {sql}").fetchall()
    except Exception:  # noqa: BLE001 - fall back to the plain SQL
        return sql
    out = []
    for name, dtype, *_ in cols:
        q = '"' + name.replace('"', '""') + '"'
        if dtype in ("DOUBLE", "FLOAT", "REAL") or dtype.startswith("DECIMAL"):
            out.append(f"round(CAST({q} AS DOUBLE), {places}) AS {q}")
        elif dtype in ("HUGEINT", "UHUGEINT"):
            out.append(f"CAST({q} AS BIGINT) AS {q}")  # DuckDB sums / count_if; Spark gives bigint
        elif dtype in ("DOUBLE[]", "FLOAT[]"):
            out.append(f"list_transform({q}, lambda x: round(CAST(x AS DOUBLE), {places})) AS {q}")
        else:
            out.append(q)
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS q"
