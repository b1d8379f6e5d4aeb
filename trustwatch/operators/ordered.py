"""Ordered computations that never need a whole group in one task.

Every series (a group, or a group and a signal) has a contiguous 0-based ``pos``. Positions are cut
into chunks of ``chunk_rows``; windows are partitioned by (series keys, chunk), so the largest task
is bounded by the chunk, not by the largest group:

* bounded frames (lag, rolling statistics) get *halo* rows copied from the neighbouring chunks;
* running totals add the prefix of the per-chunk totals (one summary row per chunk);
* islands are built per chunk, and only fragments touching a chunk edge are merged afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trustwatch.session import checkpoint_dir

CHUNK_ROWS = 262_144
CHUNK = "_chunk"
OWN = "_own"


# ------------------------------------------------------------------ numbering
def exclusive_prefix(table: DataFrame, order: str, value: str, out: str, bucket: Column) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``order``, in two levels.

    ``bucket`` must be a monotone coarsening of ``order`` with a bounded number of values (a string
    prefix, a quotient): only the bucket totals are ordered in one task.
    """
    t = table.withColumn("_b", bucket)
    tops = t.groupBy("_b").agg(F.sum(value).alias("_bv"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_b", F.coalesce(F.sum("_bv").over(before), F.lit(0)).alias("_bo"))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (t.join(tops, "_b")
            .withColumn(out, (F.col("_bo") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
            .drop("_b", "_bo"))


def _counted(df: DataFrame, keys: Sequence[str], sl: Sequence[str], total: str | None) -> DataFrame:
    """keys, slices and ``_off``, the rows of earlier slices; ``total``: those of all slices."""
    counts = df.groupBy(*keys, *sl).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*sl).rowsBetween(Window.unboundedPreceding, -1)
    cols = {"_off": F.coalesce(F.sum("_n").over(before), F.lit(0))}
    if total:
        cols[total] = F.sum("_n").over(Window.partitionBy(*keys))
    return counts.withColumns(cols).drop("_n")


def _placed(d: DataFrame, offsets: DataFrame, keys: Sequence[str], sl: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """The rows of ``d`` with their rank inside (series, slice) plus ``_off``, and the other columns of ``offsets`` (keys, slices, ...).

    Offsets travel as the first row of their slice, so that one range shuffle does for the join, the ranks and the order of the result:
    its partitions and the rows in them ascend by keys, slices and ``order``.
    """
    more = [c for c in offsets.columns if c not in (*keys, *sl)]
    both = d.withColumn("_mark", F.lit(0)).unionByName(offsets.withColumn("_mark", F.lit(1)), allowMissingColumns=True).repartitionByRange(*keys, *sl)
    w = Window.partitionBy(*keys, *sl).orderBy(F.desc("_mark"), *order)
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumns({out: F.row_number().over(w)} | {c: F.first(c).over(first) for c in more})
    return ranked.filter("_mark = 0").withColumn(out, (F.col("_off") + F.col(out) - 2).cast("long")).drop("_mark", "_off", *sl)


def _sliced(df: DataFrame, keys: Sequence[str], slices: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    sl = [f"_sl{i}" for i in range(len(slices))]
    return df.withColumns(dict(zip(sl, slices))).dropna(subset=[*keys, *sl]), sl


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slices: Sequence[Column],
              out: str = "pos", total: str | None = None) -> DataFrame:
    """0-based position of each row inside its series, ordered by ``order``.

    ``slices`` is a non-null monotone coarsening of the leading order columns (for example the day of
    the timestamp). Rows are ranked inside (series, slice) and shifted by the rows of earlier slices,
    so a series of any length is spread over its slices.
    """
    d, sl = _sliced(df, keys, slices)
    return _placed(d, _counted(d, keys, sl, total), keys, sl, order, out)


def number_rows(df: DataFrame, group: str, order: Sequence[Column | str], slices: Sequence[Column],
                prefix: int = 2) -> DataFrame:
    """Adds ``pos`` (inside the group), ``row`` (whole table, groups contiguous in key order),
    ``group_start`` and ``group_rows``. Partitions and the rows in them ascend by ``row``."""
    d, sl = _sliced(df, [group], slices)
    checkpoint_dir(df.sparkSession)
    counted = _counted(d, [group], sl, "group_rows").checkpoint()  # a row per group and slice, read for starts and for offsets
    sizes = counted.groupBy(group).agg(F.max("group_rows").alias("_gn"))
    starts = exclusive_prefix(sizes, group, "_gn", "group_start", F.substring(F.col(group), 1, prefix)).drop("_gn")
    d = _placed(d, counted.join(starts, group), [group], sl, order, "pos")
    return d.withColumn("row", F.col("group_start") + F.col("pos"))


def number_file_rows(df: DataFrame, order: Sequence[str], checkpoint: bool = True) -> DataFrame:
    """Global 0-based ``row`` for a table without a usable slice: one range shuffle on ``order``, the
    index inside the partition, plus the prefix of the partition sizes.

    The range bounds are sampled, so the sorted table is checkpointed before it is read twice.
    """
    d = (df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
         .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        checkpoint_dir(df.sparkSession)
        d = d.checkpoint()
    pid = F.shiftright("_mid", 33)
    d = d.withColumn("_pid", pid).withColumn("_idx", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    sizes = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return d.join(sizes, "_pid").withColumn("row", (F.col("_off") + F.col("_idx")).cast("long")).drop("_mid", "_pid", "_idx", "_off")


# ------------------------------------------------------------------ chunks
def chunked(df: DataFrame, before: int = 0, after: int = 0, pos: str = "pos",
            chunk_rows: int | None = None) -> DataFrame:
    """Adds the chunk id and copies of the rows a neighbouring chunk needs (``_own`` is false on copies)."""
    c_rows = chunk_rows or CHUNK_ROWS
    if before > c_rows or after > c_rows:
        raise ValueError("a halo cannot be longer than a chunk")
    p = F.col(pos)
    c = F.floor(p / F.lit(c_rows)).cast("long")
    if not before and not after:
        return df.withColumn(CHUNK, c).withColumn(OWN, F.lit(True))
    inside = F.pmod(p, F.lit(c_rows))
    none = F.lit(None).cast("long")
    to_next = F.when(inside >= c_rows - before, c + 1) if before else none
    to_prev = F.when((inside < after) & (c > 0), c - 1) if after else none
    return (df.withColumn(CHUNK, F.explode(F.array_compact(F.array(c, to_next, to_prev))))
            .withColumn(OWN, F.col(CHUNK) == c))


def chunk_window(keys: Sequence[str], pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(pos)


def owned(df: DataFrame, keep_chunk: bool = False) -> DataFrame:
    d = df.filter(F.col(OWN)).drop(OWN)
    return d if keep_chunk else d.drop(CHUNK)


def with_windows(df: DataFrame, keys: Sequence[str], exprs, before: int = 0, after: int = 0, pos: str = "pos",
                 chunk_rows: int | None = None, keep_chunk: bool = False) -> DataFrame:
    """Bounded-frame window columns. ``exprs(w)`` returns {name: Column} for the chunk window ``w``."""
    d = chunked(df, before, after, pos, chunk_rows).withColumns(exprs(chunk_window(keys, pos)))
    return owned(d, keep_chunk)


def series_of(t: pa.Table, key: str = "grp") -> tuple[np.ndarray, np.ndarray]:
    """First rows of the (group, chunk) series of a sorted table, and the series of each row."""
    grp, chunk = t.column(key).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), t.column(CHUNK).to_numpy()
    new = np.r_[True, (chunk[1:] != chunk[:-1]) | (grp[1:] != grp[:-1])]
    return np.flatnonzero(new), np.cumsum(new) - 1


def whole_series(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, or of one series if that is longer, that no (group, chunk) series is cut by. The batches are sorted by group and chunk."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(series_of(t)[0][-1])  # the last series may go on
            if cut:
                yield t.slice(0, cut).combine_chunks()
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def sorted_chunks(d: DataFrame, key: str = "grp", pos: str = "pos") -> DataFrame:
    """The rows of ``chunked``, dealt by group and chunk and in order."""
    return d.repartition(key, CHUNK).sortWithinPartitions(key, CHUNK, pos)


# ------------------------------------------------------------------ islands
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def islands(flagged: DataFrame, keys: Sequence[str], pos: str = "pos", row: str = "row",
            aggs: dict[str, tuple[str, Column]] | None = None, min_len: int = 1,
            chunk_rows: int | None = None) -> DataFrame:
    """Maximal stretches of consecutive positions among the rows of ``flagged``.

    Returns keys, pos_start, pos_end, row_start, row_end (inclusive), n and the mergeable ``aggs``
    ({name: (sum|min|max, column)}). Only flagged rows are shuffled; fragments that do not touch a
    chunk edge are final at once.
    """
    c_rows = chunk_rows or CHUNK_ROWS
    aggs = aggs or {}
    d = flagged if CHUNK in flagged.columns else flagged.withColumn(CHUNK, F.floor(F.col(pos) / F.lit(c_rows)).cast("long"))
    rank = F.row_number().over(chunk_window(keys, pos))
    first = [F.min(pos).alias("pos_start"), F.max(pos).alias("pos_end"), F.min(row).alias("row_start"),
             F.max(row).alias("row_end"), F.count(F.lit(1)).alias("n")]
    frag = (d.withColumn("_isl", F.col(pos) - rank)
            .groupBy(*keys, CHUNK, "_isl")
            .agg(*first, *[_MERGE[fn](c).alias(name) for name, (fn, c) in aggs.items()]))
    edge = ((F.pmod("pos_start", F.lit(c_rows)) == 0) & (F.col("pos_start") > 0)) | (F.pmod("pos_end", F.lit(c_rows)) == c_rows - 1)
    frag = frag.withColumn("_edge", edge)
    if min_len > 1:
        frag = frag.filter(F.col("_edge") | (F.col("n") >= min_len))
    frag = frag.withColumn("_lane", F.when(F.col("_edge"), F.lit(-1).cast("long")).otherwise(F.col(CHUNK)))
    w = Window.partitionBy(*keys, "_lane").orderBy("pos_start")
    frag = frag.withColumn("_new", F.when(F.lag("pos_end").over(w) == F.col("pos_start") - 1, 0).otherwise(1))
    frag = frag.withColumn("_id", F.sum("_new").over(w))
    merged = (frag.groupBy(*keys, "_lane", "_id")
              .agg(F.min("pos_start").alias("pos_start"), F.max("pos_end").alias("pos_end"),
                   F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"), F.sum("n").alias("n"),
                   *[_MERGE[fn](name).alias(name) for name, (fn, _) in aggs.items()])
              .drop("_lane", "_id"))
    return merged.filter(F.col("n") >= min_len) if min_len > 1 else merged


def value_runs(wide: DataFrame, keys: Sequence[str], signals: Sequence[str], pos: str = "pos", row: str = "row",
               min_len: int = 2, carry: Sequence[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """Runs of equal consecutive non-null values of each signal: keys, signal, run bounds, n, value.

    One pass over the wide rows finds repeats with a lag of all signals at once; only repeated
    readings become long rows. ``carry`` columns (a batch id) also break a run when they change.
    """
    before = {c: f"_before_{c}" for c in dict.fromkeys([*signals, *carry, row])}
    d = with_windows(wide.select(*dict.fromkeys([*keys, pos, row, *signals, *carry])), keys,
                     lambda w: {b: F.lag(c).over(w) for c, b in before.items()}, before=1, pos=pos,
                     chunk_rows=chunk_rows, keep_chunk=True)
    unbroken = F.lit(True)
    for c in carry:
        unbroken = unbroken & (F.col(c) == F.col(before[c]))
    same = {s: F.coalesce(F.col(s) == F.col(before[s]), F.lit(False)) for s in signals}
    d = d.filter(unbroken & reduce(or_, same.values()))  # most rows repeat nothing
    repeats = F.array_compact(F.array(*[
        F.when(same[s], F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")))
        for s in signals]))
    rep = (d.select(*keys, *carry, CHUNK, pos, row, F.col(before[row]).alias("_prow"), F.explode(repeats).alias("_r"))
           .select("*", "_r.signal", "_r.value").drop("_r"))
    runs = islands(rep, [*dict.fromkeys([*keys, *carry]), "signal"], pos, row,
                   {"_first": ("min", F.col("_prow")), "value": ("min", F.col("value"))}, max(1, min_len - 1), chunk_rows)
    return (runs.withColumn("row_start", F.col("_first")).withColumn("pos_start", F.col("pos_start") - 1)
            .withColumn("n", F.col("n") + 1).drop("_first"))


def merge_gaps(isl: DataFrame, keys: Sequence[str], max_gap: int, aggs: dict[str, str] | None = None) -> DataFrame:
    """Joins islands separated by at most ``max_gap`` positions. Works on the island table."""
    aggs = aggs or {}
    w = Window.partitionBy(*keys).orderBy("pos_start")
    d = isl.withColumn("_new", F.when(F.col("pos_start") - F.lag("pos_end").over(w) - 1 <= max_gap, 0).otherwise(1))
    d = d.withColumn("_id", F.sum("_new").over(w))
    return (d.groupBy(*keys, "_id")
            .agg(F.min("pos_start").alias("pos_start"), F.max("pos_end").alias("pos_end"),
                 F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"), F.sum("n").alias("n"),
                 *[_MERGE[fn](c).alias(c) for c, fn in aggs.items()])
            .drop("_id"))


# ------------------------------------------------------------------ running totals
def running_sums(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], pos: str = "pos",
                 chunk_rows: int | None = None) -> DataFrame:
    """Inclusive running sums over the whole series: inside the chunk plus the prefix of chunk totals."""
    d = chunked(df, pos=pos, chunk_rows=chunk_rows).drop(OWN)
    w = chunk_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_x_{k}": v for k, v in sums.items()})
    totals = d.groupBy(*keys, CHUNK).agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*keys, CHUNK, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    d = d.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_x_{k}").over(w), F.lit(0)) for k in sums}).join(offs, [*keys, CHUNK])
    d = d.withColumns({k: F.col(f"_l_{k}") + F.col(f"_o_{k}") for k in sums})
    return d.drop(CHUNK, *[f"{p}{k}" for k in sums for p in ("_x_", "_l_", "_o_")])


def cusum(df: DataFrame, keys: Sequence[str], steps: dict[str, Column], pos: str = "pos",
          chunk_rows: int | None = None) -> DataFrame:
    """One-sided CUSUM max(0, S + step) for each step column, by the reflection identity
    S = C - min(0, running min C); running sum and running min both in two levels."""
    d = chunked(df, pos=pos, chunk_rows=chunk_rows).drop(OWN)
    w = chunk_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_c_{k}": F.sum(F.coalesce(v, F.lit(0.0))).over(w) for k, v in steps.items()})
    d = d.withColumns({f"_m_{k}": F.min(f"_c_{k}").over(w) for k in steps})
    summary = d.groupBy(*keys, CHUNK).agg(
        *[F.max_by(f"_c_{k}", pos).alias(f"_t_{k}") for k in steps], *[F.min(f"_c_{k}").alias(f"_n_{k}") for k in steps])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns({f"_o_{k}": F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0.0)) for k in steps})
    summary = summary.withColumns({f"_g_{k}": F.coalesce(F.min(F.col(f"_o_{k}") + F.col(f"_n_{k}")).over(before), F.lit(0.0)) for k in steps})
    summary = summary.select(*keys, CHUNK, *[f"_{p}_{k}" for k in steps for p in "og"])
    d = d.join(summary, [*keys, CHUNK])
    d = d.withColumns({k: F.col(f"_o_{k}") + F.col(f"_c_{k}") - F.least(F.lit(0.0), F.col(f"_g_{k}"), F.col(f"_o_{k}") + F.col(f"_m_{k}")) for k in steps})
    return d.drop(CHUNK, *[f"_{p}_{k}" for k in steps for p in "cmog"])


def ewma(df: DataFrame, keys: Sequence[str], values: dict[str, Column], lam: float, pos: str = "pos",
         chunk_rows: int = 2048) -> DataFrame:
    """E_t = lam * x_t + (1 - lam) * E_{t-1}, E_{-1} = 0, null readings count as 0.

    E_t is a weighted running sum inside the chunk; the halo is long enough for everything before it
    to be below double precision, and chunk + halo keep the weights far from overflow.
    """
    q = 1.0 - lam
    halo = math.ceil(17 * math.log(10) / -math.log(q))
    c_rows = min(chunk_rows, int(280 * math.log(10) / -math.log(q)) - halo)
    d = chunked(df, before=halo, pos=pos, chunk_rows=c_rows)
    w = chunk_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    t = F.col(pos) - (F.col(CHUNK) * c_rows - halo)
    d = d.withColumn("_t", t.cast("double"))
    d = d.withColumns({k: F.lit(lam) * F.pow(F.lit(q), F.col("_t")) * F.sum(F.coalesce(v, F.lit(0.0)) * F.pow(F.lit(q), -F.col("_t"))).over(w)
                       for k, v in values.items()})
    return owned(d).drop("_t")


# ------------------------------------------------------------------ intervals
def join_intervals(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], row: str = "row",
                   start: str = "row_start", end: str = "row_end", bucket_rows: int = 4096, how: str = "inner") -> DataFrame:
    """Rows matched with the intervals that contain them: equi-join on a row bucket plus a residual test."""
    b = F.lit(bucket_rows)
    lo, hi = F.floor(F.col(start) / b).cast("long"), F.floor(F.col(end) / b).cast("long")
    iv = intervals.withColumn("_bk", F.explode(F.sequence(lo, hi)))
    r = rows.withColumn("_bk", F.floor(F.col(row) / b).cast("long"))
    iv = iv.select(*[F.col(c).alias(f"_k_{c}") if c in keys or c == "_bk" else F.col(c) for c in iv.columns])
    cond = r["_bk"] == iv["_k__bk"]
    for k in keys:
        cond = cond & (r[k] == iv[f"_k_{k}"])
    cond = cond & (r[row] >= iv[start]) & (r[row] <= iv[end])
    out = r.join(iv, cond, how)
    return out.drop("_bk", "_k__bk", *[f"_k_{k}" for k in keys])


def overlap_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str], bucket_rows: int = 65_536,
                      a_cols: tuple[str, str] = ("row_start", "row_end"), b_cols: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Pairs of overlapping intervals: joined on shared buckets, each pair kept in its first shared bucket."""
    bk = F.lit(bucket_rows)

    def spread(d: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
        return d.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / bk).cast("long"), F.floor(F.col(hi) / bk).cast("long"))))

    x, y = spread(a, *a_cols, "_bk"), spread(b, *b_cols, "_bk")
    first = F.greatest(F.floor(F.col(a_cols[0]) / bk), F.floor(F.col(b_cols[0]) / bk)).cast("long")
    return (x.join(y, [*keys, "_bk"])
            .filter((F.col(a_cols[0]) <= F.col(b_cols[1])) & (F.col(b_cols[0]) <= F.col(a_cols[1])) & (F.col("_bk") == first))
            .drop("_bk"))


def first_k(df: DataFrame, keys: Iterable[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key; the rank filter lets Spark cut each map task to k rows before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def segments(df: DataFrame, keys: Sequence[str], start, pos: str = "pos", row: str = "row", before: int = 1,
             aggs: dict[str, tuple[str, Column]] | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Cuts each series where ``start(w)`` is true (it may look ``before`` rows back) into consecutive segments.

    Every row belongs to exactly one segment. Only fragments at chunk edges are merged in a second step.
    """
    c_rows = chunk_rows or CHUNK_ROWS
    aggs = aggs or {}
    d = with_windows(df, keys, lambda w: {"_start": F.coalesce(start(w).cast("int"), F.lit(0))}, before=before, pos=pos,
                     chunk_rows=chunk_rows, keep_chunk=True)
    d = d.withColumn("_sid", F.sum("_start").over(chunk_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)))
    frag = d.groupBy(*keys, CHUNK, "_sid").agg(
        F.min(pos).alias("pos_start"), F.max(pos).alias("pos_end"), F.min(row).alias("row_start"), F.max(row).alias("row_end"),
        F.count(F.lit(1)).alias("n"), F.max("_start").alias("_st"), *[_MERGE[fn](c).alias(name) for name, (fn, c) in aggs.items()])
    edge = (F.pmod("pos_start", F.lit(c_rows)) == 0) | (F.pmod("pos_end", F.lit(c_rows)) == c_rows - 1)
    frag = frag.withColumn("_lane", F.when(edge, F.lit(-1).cast("long")).otherwise(F.col(CHUNK)))
    w = Window.partitionBy(*keys, "_lane").orderBy("pos_start")
    joined = (F.lag("pos_end").over(w) == F.col("pos_start") - 1) & (F.col("_st") == 0)
    frag = frag.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_id", F.sum("_new").over(w))
    return (frag.groupBy(*keys, "_lane", "_id")
            .agg(F.min("pos_start").alias("pos_start"), F.max("pos_end").alias("pos_end"), F.min("row_start").alias("row_start"),
                 F.max("row_end").alias("row_end"), F.sum("n").alias("n"), *[_MERGE[fn](name).alias(name) for name, (fn, _) in aggs.items()])
            .drop("_lane", "_id"))
