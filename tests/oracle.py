"""Compares a Spark result with the same query in DuckDB, value by value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(x)}" for k, x in sorted(v.items())) + "}"
    return f"{type(v).__name__}:{v}"


def rows_of(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    cols = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*cols)) if cols else []


def compare(spark_df, sql: str, con) -> list[str]:
    """Differences found (empty when equal)."""
    a_t = spark_df.toArrow()
    b_t = con.sql(sql).to_arrow_table()
    a_names, a = rows_of(a_t)
    b_names, b = rows_of(b_t)
    out = []
    if a_names != b_names:
        return [f"columns {a_names} != {b_names}"]
    at = {n: str(a_t.schema.field(n).type) for n in a_names}
    bt = {n: str(b_t.schema.field(n).type) for n in a_names}
    soft = {n: (at[n], bt[n]) for n in a_names if at[n] != bt[n] and not at[n].startswith("timestamp")}
    if soft:
        out.append(f"types {soft}")
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = sorted(sa - sb), sorted(sb - sa)
        out.append(f"values differ: {len(only_a)} only in spark, {len(only_b)} only in sql; e.g. {only_a[:2]} vs {only_b[:2]}")
    return out
