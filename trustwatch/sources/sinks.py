"""Sinks: datasets laid out for row-range pruning, JSON-lines objects, idempotent per-batch writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_dataset(df: DataFrame, path: str, order: Sequence[str] = ("row",), codec: str = "zstd") -> None:
    """Range-partitioned and sorted by ``order``, so that min/max statistics prune row ranges and groups; without an order, as the rows come."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    (d.write.mode("overwrite").option("compression", codec).parquet(path))


def write_objects(df: DataFrame, path: str) -> None:
    """Findings, flags and other nested objects as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_by_batch(df: DataFrame, path: str, batch_col: str = "batch_id", codec: str = "zstd") -> None:
    """Replaces exactly the batches present in ``df``: writing a batch twice leaves one copy."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec)
     .partitionBy(batch_col).parquet(path))
