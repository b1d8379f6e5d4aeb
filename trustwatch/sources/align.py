"""Bringing an arriving frame to the known schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_incoming(df: DataFrame, schema: Mapping[str, str], start_row: int, batch_id: str, aliases: Mapping[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Columns matched exactly, then ignoring case, then by alias, then by position when the counts agree; missing ones
    become NULL, extra ones are dropped, values are cast where they can be. Rows continue the numbering."""
    have = {c.lower(): c for c in df.columns}
    back = {v.lower(): k for k, v in (aliases or {}).items()}
    found = {}
    for c in schema:
        for cand in (c.lower(), (aliases or {}).get(c, "").lower(), back.get(c.lower(), "").lower()):
            if cand and cand in have:
                found[c] = have[cand]
                break
    if not found and len(df.columns) == len(schema):
        found = dict(zip(schema, df.columns))
    cols = [(F.expr(f"try_cast(`{found[c]}` AS {t})") if c in found else F.lit(None).cast(t)).alias(c) for c, t in schema.items()]
    keys = order or [c for c in ("row", "pos", "ts") if c in schema] or list(schema)[:1]
    out = df.select(*cols)
    if "row" not in schema:
        from trustwatch.operators.ordered import number_file_rows

        out = number_file_rows(out, keys).withColumn("row", F.col("row") + start_row)
    return out.withColumn("batch_id", F.lit(batch_id))
