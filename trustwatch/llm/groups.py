"""Bounded groups as Arrow batches, and connected components of a link table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustwatch.llm.stage import written


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by ``key``, several to a table; each group must be small enough for one task."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() == k[-1] and k[0] == k[-1]:
            held.append(b)
            continue
        cut = int(np.searchsorted(k, k[-1])) if k[0] != k[-1] else 0
        if cut or held:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, parts: int | None = None) -> DataFrame:
    """``fn(table, bounds)`` over tables that hold whole groups of the long column ``key``; bounds: where each group begins, and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, key):
            t = t.combine_chunks()
            k = t.column(key).to_numpy()
            out = fn(t, np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)] if len(k) else np.zeros(1, int))
            if out is not None and out.num_rows:
                yield out

    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)


def _stars(e: DataFrame) -> bool:
    """Whether links (u > v) already form stars: no centre is a leaf and no leaf has two centres. The centre is then the smallest."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter("leaf > 1 OR leaf > 0 AND centre > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of ``links`` (a, b); alternating large and small stars until only stars are left."""
    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = written(small.filter("u <> v").distinct(), "stars")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
