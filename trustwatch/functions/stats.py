"""Robust statistics as Column expressions and small aggregate tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.session import checkpoint_dir, release

ACCURACY = 10_000
"""Of the sketch that brackets a quantile; the quantile itself is counted out exactly."""
AROUND = 3.0 / ACCURACY
FEW_ROWS = 10_000
"""A series of fewer rows is its own bracket."""
PIVOTS = 16
"""One row in so many makes the sketch that places the brackets of ``wide_quantiles``. Pivots only say which values are counted one by one: every row is counted."""
WIDTHS = tuple(AROUND * 2 ** j for j in range(10))
"""Half widths, in ranks, on offer for a bracket; the narrowest that covers SIGMAS standard deviations of a pivot's rank is taken."""
SIGMAS = 4.5
SLICE = 1 << 20
"""Distinct values that one task orders; a bracket with more of them is narrowed first."""
BUCKETS = 1000


def quantile(col: Column | str, p: float) -> Column:
    """Exact quantile of a group of bounded size (a chunk, a window, a cycle). For groups that grow with the data see ``group_quantiles``."""
    return F.percentile(F.col(col) if isinstance(col, str) else col, F.lit(p))


# ------------------------------------------------------------------ quantiles at any size
def _kept(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


def _bracket_aggs(v: Column, ps: Sequence[float]) -> list[Column]:
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in ps for d in (-AROUND, AROUND)])
    return [F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile_approx(v, ends, F.lit(ACCURACY)).alias("e")]


def _pivot_aggs(v: Column, ps: Sequence[float]) -> list[Column]:
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + sign * d))) for p in ps for d in WIDTHS for sign in (-1, 1)])
    return [F.count(v).alias("m"), F.percentile_approx(v, ends, F.lit(ACCURACY)).alias("e")]


def _brackets(r, ps: Sequence[float]) -> list[tuple[float, float]]:
    """Disjoint brackets that hold the quantiles (but for a chance below 1e-5), from the pivots; none, for all values, where these are too few."""
    if r.m * PIVOTS < FEW_ROWS or not r.m:
        return []
    out = []
    for k, p in enumerate(ps):
        need = SIGMAS * (math.sqrt(p * (1 - p) / r.m) + 1.0 / r.m) + 1.0 / ACCURACY
        j = next((j for j, d in enumerate(WIDTHS) if d >= need), None)
        at = 2 * (k * len(WIDTHS) + (j or 0))
        # a bracket that reaches over the last pivot holds all values beyond it
        out.append((-math.inf if j is None or p - WIDTHS[j] <= 0 else r.e[at], math.inf if j is None or p + WIDTHS[j] >= 1 else r.e[at + 1]))
    return _disjoint(out)


def _disjoint(pairs: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _narrowed(counts: DataFrame, keys: Sequence[str], ps: Sequence[float], limit: int) -> DataFrame:
    """counts (keys, at, v, c) with the values that can't be at a wanted rank summed up, until no series has more than ``limit`` of them.

    A series' values are cut into BUCKETS parts of about equally many distinct values; only parts that hold a wanted rank keep their values.
    """
    before = None
    while True:
        most = counts.groupBy(*keys).agg(F.count("v").alias("k")).agg(F.max("k")).first()[0] or 0
        if most <= limit or most == before:
            return counts
        before = most
        cuts = F.percentile_approx("v", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(ACCURACY))
        d = counts.join(counts.groupBy(*keys).agg(cuts.alias("cuts"), F.sum("c").alias("n")), list(keys)) if keys else counts.crossJoin(F.broadcast(counts.agg(cuts.alias("cuts"), F.sum("c").alias("n"))))
        d = d.withColumn("part", F.when(F.col("v").isNotNull(), F.size(F.filter("cuts", lambda x: x < F.col("v")))).otherwise(0)).drop("cuts")
        w = Window.partitionBy(*keys).orderBy("at", "part")
        tops = d.groupBy(*keys, "at", "part").agg(F.sum("c").alias("m"), F.max("n").alias("n")).withColumn("upto", F.sum("m").over(w))
        wanted = F.lit(False)
        for p in ps:
            r = F.lit(float(p)) * (F.col("n") - 1)
            wanted = wanted | ((F.floor(r) < F.col("upto")) & (F.ceil(r) >= F.col("upto") - F.col("m")))
        tops = tops.withColumn("wanted", wanted).withColumn("to", F.row_number().over(w))
        d = d.join(tops.select(*keys, "at", "part", "wanted", "to"), [*keys, "at", "part"])
        counts = d.groupBy(*keys, F.col("to").alias("at"), F.when(F.col("wanted"), F.col("v")).alias("v")).agg(F.sum("c").alias("c"))
        counts = _kept(counts)


def _picked(counts: DataFrame, keys: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """keys, n and q (array) from the counts of values (keys, at, v, c); v is null where only a count was kept, and q too if a rank falls there."""
    order = Window.partitionBy(*keys).orderBy("at", "v")
    d = counts.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    aggs = []
    for i, p in enumerate(ps):
        r = F.lit(float(p)) * (F.col("n") - 1)
        for name, rank in (("l", F.floor(r)), ("u", F.ceil(r))):
            aggs.append(F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c")), F.col("v"))).alias(f"{name}{i}"))
    got = d.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    values = []
    for i, p in enumerate(ps):
        r = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"l{i}"), F.col(f"u{i}")
        values.append(F.when(lo == hi, lo).otherwise((F.ceil(r) - r) * lo + (r - F.floor(r)) * hi))
    return got.select(*keys, "n", F.array(*values).alias("q"))


def quantile_rows(df: DataFrame, columns: dict[str, Column], ps: Sequence[float]) -> dict[str, tuple[int, list[float | None]]]:
    """Each column's (n, q) on the driver: the exact quantiles ``ps`` of each column over all rows (linear between ranks, nulls left out), at any number of rows.

    A mergeable sketch of pivots, one row in ``PIVOTS``, brackets every quantile (a few numbers per column meet on the driver). A second pass over all rows counts
    the values between brackets together and those inside a bracket one by one; nothing but these counts is shuffled. A rank that the sketch should have missed is found by counting all values of its column.
    """
    names = list(columns)
    if not names:
        return {}
    data = df.select(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(columns.values())])
    sketch = data.filter(F.rand(17) < 1.0 / PIVOTS).agg(*[F.struct(*_pivot_aggs(F.col(f"_{i}"), ps)).alias(f"_{i}") for i in range(len(names))]).first()
    pairs = {i: _brackets(sketch[f"_{i}"], ps) for i in range(len(names))}

    def counted(which: dict[int, list[tuple[float, float]]]) -> DataFrame:
        def run(batches):
            gaps = {i: np.zeros(2 * len(ends) + 1, np.int64) for i, ends in which.items()}

            def rows(i, at, v, c, valid):
                return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at, pa.int32()), pa.array(v, pa.float64(), mask=~valid), pa.array(c, pa.int64())], ["i", "at", "v", "c"])

            for b in batches:
                out = []
                for i, ends in which.items():
                    v = b.column(b.schema.get_field_index(f"_{i}")).drop_null().to_numpy()
                    if ends:
                        at = sum((v >= lo).astype(np.int64) + (v > hi) for lo, hi in ends)
                        at[np.isnan(v)] = 2 * len(ends)  # NaN is the largest value
                        gaps[i] += np.bincount(at, minlength=2 * len(ends) + 1)
                        v = v[at % 2 == 1]
                    v, c = np.unique(v, return_counts=True)
                    out.append((np.full(len(v), i), sum(((v >= lo).astype(np.int64) + (v > hi) for lo, hi in ends), np.zeros(len(v), np.int64)), v, c))
                yield rows(*[np.concatenate(x) for x in zip(*out)], np.ones(sum(len(x[0]) for x in out), bool))
            few = [(i, at, 0.0, c) for i, g in gaps.items() for at, c in enumerate(g) if at % 2 == 0 and c]
            if few:
                yield rows(*[np.array(x) for x in zip(*few)], np.zeros(len(few), bool))

        long = data.select(*[f"_{i}" for i in which]).mapInArrow(run, "i int, at int, v double, c long")
        counts = long.groupBy("i", "at", "v").agg(F.sum("c").alias("c"))
        if max(sketch[f"_{i}"].m for i in which) * PIVOTS * 2 > SLICE:  # fewer rows can't have more values
            counts = _narrowed(_kept(counts), ["i"], ps, SLICE)
        return _picked(counts, ["i"], ps)

    rows = {r.i: r for r in counted(pairs).collect()}  # a row per column that has values
    missed = {i: [] for i, r in rows.items() if None in r.q}
    if missed:
        rows |= {r.i: r for r in counted(missed).collect()}
    return {n: (rows[i].n, list(rows[i].q)) if i in rows else (0, [None] * len(ps)) for i, n in enumerate(names)}


def counted_quantiles(counts: DataFrame, value: str, count: str, ps: Sequence[float]) -> list[float | None]:
    """The exact quantiles of values that are counted already (a value may have several rows); None without values."""
    c = _kept(counts.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(count).alias("c")).withColumn("at", F.lit(0)))
    got = _picked(_narrowed(c, [], ps, SLICE), [], ps).first()
    return list(got.q) if got and got.n else [None] * len(ps)


def wide_quantiles(df: DataFrame, columns: dict[str, Column], ps: Sequence[float]) -> DataFrame:
    """feature, n and q: ``quantile_rows`` as a table."""
    rows = [(name, n, q) for name, (n, q) in quantile_rows(df, columns, ps).items()]
    return df.sparkSession.createDataFrame(rows, "feature string, n long, q array<double>")


def group_quantiles(df: DataFrame, by: Sequence[str], value: Column | str, ps: Sequence[float]) -> DataFrame:
    """by, n and q: the exact quantiles of ``value`` in each group, for groups of any size and number (nulls left out; groups without values are missing).

    As ``wide_quantiles``, but brackets stay a table and meet the rows by key.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    if not by:
        return wide_quantiles(df, {"": v}, ps).filter("n > 0").drop("feature")
    data = df.select(*by, v.alias("_v")).filter("_v IS NOT NULL")
    b = data.groupBy(*by).agg(*_bracket_aggs(F.col("_v"), ps))
    few = F.col("n") < FEW_ROWS
    # brackets in ascending order of ps; an end never lies before the bracket below, so they are disjoint but for shared ends
    order = sorted(range(len(ps)), key=lambda k: ps[k])
    ends = []
    for j, k in enumerate(order):
        lo = F.when(few, F.col("lo") if j == 0 else None).otherwise(F.get("e", F.lit(2 * k)))
        hi = F.when(few, F.col("hi") if j == 0 else None).otherwise(F.get("e", F.lit(2 * k + 1)))
        ends += [lo.alias(f"_lo{j}"), hi.alias(f"_hi{j}")]
    d = data.join(b.select(*by, *ends), list(by))
    inside = reduce(or_, [F.coalesce(F.col("_v").between(F.col(f"_lo{j}"), F.col(f"_hi{j}")), F.lit(False)) for j in range(len(ps))])
    below = sum((F.coalesce((F.col("_v") > F.col(f"_hi{j}")).cast("int"), F.lit(0)) for j in range(len(ps))), F.lit(0))
    # overlapping brackets: what is inside any is kept by value, and a value's place must not fall with the value
    at = F.when(inside, F.lit(None)).otherwise(below)
    counts = d.select(*by, at.alias("gap"), F.when(inside, F.col("_v")).alias("v"), F.col("_v").alias("_w")).groupBy(*by, "gap", "v").agg(F.count(F.lit(1)).alias("c"), F.min("_w").alias("first"))
    counts = _kept(counts.select(*by, F.col("first").alias("at"), "v", "c"))
    got = _picked(_narrowed(counts, list(by), ps, SLICE), list(by), ps)
    missed = got.filter(F.exists("q", lambda x: x.isNull())).select(*by)
    if missed.isEmpty():
        return got
    whole = data.join(missed, list(by), "left_semi").groupBy(*by, F.col("_v").alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("at", F.col("v"))
    whole = _narrowed(_kept(whole.select(*by, "at", "v", "c")), list(by), ps, SLICE)
    return got.join(missed, list(by), "left_anti").unionByName(_picked(whole, list(by), ps))


def finite(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def robust_scale(mad: Column, q01: Column, q25: Column, q75: Column, q99: Column, std: Column) -> Column:
    """1.4826 MAD, not below a quarter of the quantile spread; else the spread; else the standard deviation."""
    spread = F.greatest(F.when(q75 > q25, (q75 - q25) / F.lit(1.349)), F.when(q99 > q01, (q99 - q01) / F.lit(4.65)))
    from_mad = F.when(mad > 0, F.greatest(F.lit(1.4826) * mad, F.lit(0.25) * F.coalesce(spread, F.lit(0.0))))
    return F.coalesce(from_mad, spread, F.when(std > 0, std), F.lit(0.0))


STAT_QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def signal_stats(long: DataFrame, by: Sequence[str] = ("signal",), value: str = "value") -> DataFrame:
    """One row per signal: counts, moments, quantiles, MAD and the robust scale. Exact at any size; only counts are shuffled."""
    v = F.col(value)
    first = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    q = group_quantiles(long, by, v, list(STAT_QUANTILES.values())).select(*by, *[F.get("q", F.lit(i)).alias(a) for i, a in enumerate(STAT_QUANTILES)])
    dev = long.filter(v.isNotNull()).join(q.select(*by, F.col("median").alias("_med")), list(by)).withColumn("_dev", F.abs(v - F.col("_med")))
    mad = group_quantiles(dev, by, "_dev", [0.5]).select(*by, F.get("q", F.lit(0)).alias("mad"))
    s = first.join(q, list(by), "left").join(mad, list(by), "left")
    return s.withColumn("scale", robust_scale(F.col("mad"), F.col("q01"), F.col("q25"), F.col("q75"), F.col("q99"), F.col("std")))


def wide_stats(wide: DataFrame, columns: dict[str, Column], name: str = "signal") -> DataFrame:
    """``signal_stats`` of the columns of a wide table, without unpivoting it: one row per column."""
    spark = wide.sparkSession
    d = wide.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    cols = {n: F.col(f"c{i}") for i, n in enumerate(columns)}
    first = d.agg(F.count(F.lit(1)).alias("n_rows"), *[F.struct(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(f"s{i}") for i, c in enumerate(cols.values())]).first()
    q = {f: r[1] for f, r in quantile_rows(d, cols, list(STAT_QUANTILES.values())).items()}
    mid = list(STAT_QUANTILES).index("median")
    mad = {f: r[1][0] for f, r in quantile_rows(d, {n: F.abs(c - F.lit(q[n][mid])) if q[n][mid] is not None else F.lit(None) for n, c in cols.items()}, [0.5]).items()}
    rows = [(n, first.n_rows, *[first[f"s{i}"][k] for k in ("n", "min", "max", "mean", "std")], *q[n], mad[n]) for i, n in enumerate(columns)]
    s = spark.createDataFrame(rows, f"{name} string, n_rows long, n long, min double, max double, mean double, std double, " + ", ".join(f"{a} double" for a in STAT_QUANTILES) + ", mad double")
    return s.withColumn("scale", robust_scale(F.col("mad"), F.col("q01"), F.col("q25"), F.col("q75"), F.col("q99"), F.col("std")))


def threshold_of(q: Column, margin: float = 1.1) -> Column:
    """min(q, max(q75 + 3 IQR, q90)) times the margin, at least 1.5 medians. ``q``: quantiles (q, 0.9, 0.75, 0.25, 0.5)."""
    at = lambda i: F.get(q, F.lit(i))
    fence = F.greatest(at(2) + 3 * (at(2) - at(3)), at(1))
    return F.greatest(F.least(at(0), fence) * margin, F.lit(1.5) * at(4), F.lit(1e-6))


def robust_threshold(by: Sequence[str], df: DataFrame, score: str, q: float = 0.995, margin: float = 1.1) -> DataFrame:
    return group_quantiles(df, by, score, (q, 0.9, 0.75, 0.25, 0.5)).select(*by, "n", threshold_of(F.col("q"), margin).alias("threshold"))


def confidence(n: Column, ratio: Column | None = None) -> Column:
    """n / (n + 30) times how far the evidence is from its threshold (0.97 for exact tests)."""
    nn = F.greatest(n.cast("double"), F.lit(0.0))
    size = nn / (nn + 30.0)
    if ratio is None:
        margin = F.lit(0.97)
    else:
        margin = F.greatest(F.lit(0.02), 0.5 + 0.5 * F.tanh(1.5 * F.log(F.greatest(ratio, F.lit(1e-6)))))
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), size * margin)), 2)


def median_of(values: Sequence[Column]) -> Column:
    """Median of the non-null values among a fixed list of columns."""
    a = F.sort_array(F.array_compact(F.array(*values)))
    n = F.size(a)
    lo = F.element_at(a, F.greatest(F.floor((n + 1) / 2).cast("int"), F.lit(1)))
    hi = F.element_at(a, F.greatest(F.floor(n / 2).cast("int") + 1, F.lit(1)))
    return F.when(n > 0, (lo + hi) / 2.0)


def common_mode_k(n_signals: int) -> int:
    """Signals that must share a finding: 3, or a tenth of the signals when fewer, never below 2."""
    return min(3, max(2, -(-n_signals // 10)))


def average_ranks(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by, value) -> average rank and number of ties. Distinct values are counted, dealt to partitions by range (bounds are sampled, so outliers
    don't gather the rest in one place), and ranked in two levels: totals of a series per partition, then inside each partition."""
    c = long.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = _kept(c.repartitionByRange(n, *by, value).withColumn("_part", F.spark_partition_id()))
    tops = c.groupBy(*by, "_part").agg(F.sum("_c").alias("_m"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = c.join(tops, [*by, "_part"])
    return d.select(*by, value, (F.col("_o") + F.coalesce(F.sum("_c").over(inside), F.lit(0)) + (F.col("_c") + 1) / 2.0).alias("rank"), F.col("_c").alias("ties"))
