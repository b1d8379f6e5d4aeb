"""Batches: half-open stretches of rows that tile the table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.operators import ordered


def widened_window(window_s: float, period_s: float, min_rows: int) -> float:
    """The window as a multiple of its length that holds at least ``min_rows`` readings."""
    need = min_rows * period_s
    return window_s * -(-need // window_s) if need > window_s else window_s


def time_segments(df: DataFrame, ts: str, window_s: float) -> DataFrame:
    """Consecutive rows of a group inside the same time window."""
    d = df.select("grp", "row", "pos", F.floor(F.unix_micros(F.col(ts)) / F.lit(window_s * 1e6)).cast("long").alias("win"), F.col(ts).alias("_ts"))
    return ordered.segments(d, ["grp"], lambda w: F.lag("win").over(w).isNotNull() & (F.lag("win").over(w) != F.col("win")),
                            aggs={"win": ("min", F.col("win")), "time_start": ("min", F.col("_ts")), "time_end": ("max", F.col("_ts"))})


def coalesce_segments(segs: DataFrame, min_rows: int, max_rows: int) -> DataFrame:
    """Tiny segments joined to the next of their group, huge ones split. The fold is sequential, so it runs over the
    sorted segment table of a slab of groups, never over rows; a slab hands its open batch on inside one group only."""

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur = None
        for pdf in pdfs:
            out = []
            for g, a, b in zip(pdf["grp"], pdf["row_start"], pdf["row_end"]):
                if cur and cur[0] == g and cur[2] - cur[1] + 1 < min_rows:
                    cur = (g, cur[1], b)
                else:
                    if cur:
                        out.append(cur)
                    cur = (g, a, b)
            yield pd.DataFrame(out, columns=["grp", "row_start", "row_end"])
        if cur:
            yield pd.DataFrame([cur], columns=["grp", "row_start", "row_end"])

    s = segs.select("grp", "row_start", "row_end").repartition("grp").sortWithinPartitions("grp", "row_start")
    merged = s.mapInPandas(fold, "grp string, row_start long, row_end long")
    n = F.col("row_end") - F.col("row_start") + 1
    parts = F.ceil(n / F.lit(max_rows)).cast("long")
    step = F.ceil(n / parts).cast("long")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    d = merged.withColumn("_step", step).withColumn("_j", cut)
    start = F.col("row_start") + F.col("_j") * F.col("_step")
    return d.select("grp", start.alias("row_start"), F.least("row_end", start + F.col("_step") - 1).alias("row_end"))


def row_batches(groups: DataFrame, target: int) -> DataFrame:
    """Groups longer than ``target`` split evenly; the others packed by the slot their start falls into."""
    n = F.col("n_rows")
    parts = F.when(n > target, F.ceil(n / F.lit(target)).cast("long")).otherwise(F.lit(1).cast("long"))
    d = groups.withColumn("_p", parts).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    a = F.col("row_start") + F.floor(n * F.col("_i") / F.col("_p")).cast("long")
    b = F.col("row_start") + F.floor(n * (F.col("_i") + 1) / F.col("_p")).cast("long") - 1
    slot = F.when(n > target, F.concat_ws("/", "grp", "_i")).otherwise(F.floor(F.col("row_start") / target).cast("string"))
    return (d.select(slot.alias("_slot"), (n > target).alias("_long"), a.alias("row_start"), b.alias("row_end"))
            .groupBy("_long", "_slot").agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"), F.count(F.lit(1)).alias("n_groups"))
            .drop("_long", "_slot"))


def define_batches(df: DataFrame, ts: str, window_s: float) -> DataFrame:
    """Windows anchored at the earliest time; gaps between windows are closed so that every row has a batch."""
    t = F.unix_micros(F.col(ts)) / F.lit(1e6)
    t0 = df.agg(F.min(t).alias("_t0"), F.max("row").alias("_last"))
    d = df.crossJoin(F.broadcast(t0))
    b = (d.filter(F.col(ts).isNotNull()).groupBy(F.floor((t - F.col("_t0")) / F.lit(window_s)).cast("long").alias("window"), "_last")
         .agg(F.min("row").alias("row_start"), F.count(F.lit(1)).alias("n_readings")))
    w = Window.orderBy("row_start")
    return b.select("window", "n_readings", "row_start", F.coalesce(F.lead("row_start").over(w) - 1, F.col("_last")).alias("row_end"))


def split_merge(ranges: DataFrame, min_rows: int, max_rows: int) -> DataFrame:
    return coalesce_segments(ranges, min_rows, max_rows)


def batch_groups(batches: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups overlapping each batch."""
    g = groups.select("grp", F.col("row_start").alias("b_start"), (F.col("row_start") + F.col("n_rows") - 1).alias("b_end"))
    o = ordered.overlap_intervals(batches, g, [])
    return o.groupBy("batch_id").agg(F.sort_array(F.collect_set("grp")).alias("groups"))


def batch_of_row(df: DataFrame, batches: DataFrame) -> DataFrame:
    return ordered.join_intervals(df, batches, [])
