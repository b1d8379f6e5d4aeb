"""Null-safe comparison by operator name: a missing reading never violates anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = (">", ">=", "<", "<=", "==", "!=")


def cmp(c: Column, op: str, value: float) -> Column:
    v = F.lit(float(value))
    test = {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "==": c == v, "!=": c != v}[op]
    return F.coalesce(test, F.lit(False))
