"""Groups that follow the same course: resampled trajectories, candidates by random hyperplanes, verified by correlation.

A group of any length becomes ``points`` values per signal. Each of its rows knows from its position and its group's size which points it lies next to, so where
rows carry that size (``size``) all but about two rows per point are dropped before anything is shuffled. Signatures are centred and scaled per signal, so copies that were
shifted or scaled as a whole agree. Equal signatures meet by digest; different ones are compared only where they lie on the same side of all
hyperplanes of a band. Two signatures that correlate above 0.999 share a band of 12 sides with probability above 0.84, and none of 16 bands with one below 1e-12.
Bands get a side more whenever signatures double, so that unrelated ones meet about as often as there are signatures, not as there are pairs; more bands keep that chance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import ordered
from trustwatch.operators.graph import connected_components
from trustwatch.operators.quality import once

POINTS, BANDS, SIDES, ALIKE = 32, 16, 12, 0.999
MISSED = 1e-12


def resampled(wide: DataFrame, signals: Sequence[str], points: int = POINTS, size: str | None = None) -> DataFrame:
    """grp, k and each signal at ``points`` evenly spaced places of the group, linear between rows; a gap counts as the group's median of the signal.

    ``size``: the column that holds the rows of a group; without it they are counted and joined to all rows."""
    if size:
        d = wide.select("grp", "pos", *signals, F.col(size).alias("_n"))
    else:
        d = wide.select("grp", "pos", *signals).join(wide.groupBy("grp").agg((F.max("pos") + 1).alias("_n")), "grp")
    step = (F.col("_n") - 1) / F.lit(float(points - 1))  # rows from one point to the next
    # points k with |k * step - pos| < 1, each with its weight in the interpolation; a group of one row stands for all points
    lo = F.when(F.col("_n") > 1, F.greatest(F.lit(0), F.floor((F.col("pos") - 1) / step) + 1)).otherwise(0)
    hi = F.when(F.col("_n") > 1, F.least(F.lit(points - 1), F.ceil((F.col("pos") + 1) / step) - 1)).otherwise(points - 1)
    near = d.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")}).filter("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    weight = F.when(F.col("_n") > 1, 1.0 - F.abs(F.col("k") * step - F.col("pos"))).otherwise(1.0)
    near = once(near.withColumn("_w", weight).filter("_w > 0").select("grp", "k", "_w", *[S.finite(F.col(s)).alias(s) for s in signals]))
    gaps = near.filter(" OR ".join(f"`{s}` IS NULL" for s in signals)).select("grp").distinct()
    if not gaps.isEmpty():
        long = wide.join(gaps, "grp", "left_semi").select("grp", *[S.finite(F.col(s)).alias(s) for s in signals]).unpivot(["grp"], list(signals), "signal", "value")
        med = S.group_quantiles(long, ["grp", "signal"], "value", [0.5]).groupBy("grp").agg(*[F.max(F.when(F.col("signal") == s, F.get("q", F.lit(0)))).alias(f"_m_{s}") for s in signals])
        near = near.join(med, "grp", "left").select("grp", "k", "_w", *[F.coalesce(s, f"_m_{s}", F.lit(0.0)).alias(s) for s in signals])
    return near.groupBy("grp", "k").agg(*[(F.sum(F.col("_w") * F.col(s)) / F.sum("_w")).alias(s) for s in signals])


def signatures(wide: DataFrame, signals: Sequence[str], points: int = POINTS, size: str | None = None) -> DataFrame:
    """grp and signature: the resampled course, per signal centred and scaled, as one vector of length 1 (null where nothing moves)."""
    r = resampled(wide, signals, points, size)
    at = r.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", *signals))).alias("x"))  # ``points`` entries

    def units(batches):
        for b in batches:
            x, out = b.column("x"), [None] * b.num_rows
            lengths, flat = np.diff(x.offsets.to_numpy()), x.flatten()
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            v = np.stack([flat.field(i + 1).to_numpy(zero_copy_only=False) for i in range(len(signals))])
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                y = v[:, starts[at][:, None] + np.arange(n)]  # signal x group x point
                y = y - y.mean(2, keepdims=True)
                sd = np.sqrt((y * y).mean(2, keepdims=True))
                y = np.where(sd > 1e-12, y / np.where(sd > 1e-12, sd, 1.0), 0.0).transpose(1, 0, 2).reshape(len(at), -1)
                norm = np.sqrt((y * y).sum(1))
                for i, one, size in zip(at, y, norm):
                    out[i] = one / size if size > 1e-12 else None
            yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(out, pa.list_(pa.float64()))], ["grp", "signature"])

    return at.mapInArrow(units, f"grp {dict(at.dtypes)['grp']}, signature array<double>")


def band_shape(n: int, alike: float = ALIKE, bands: int = BANDS, sides: int = SIDES) -> tuple[int, int]:
    """(bands, sides) for ``n`` signatures, never fewer than those given: 2 ** sides reaches n, and a pair that correlates by ``alike`` is missed with a chance of at most MISSED."""
    sides = max(sides, math.ceil(math.log2(max(n, 2))))
    shared = (1 - math.acos(alike) / math.pi) ** sides
    return max(bands, math.ceil(math.log(MISSED) / math.log1p(-shared))) if 0 < shared < 1 else bands, sides


def near_duplicate_groups(wide: DataFrame, signals: Sequence[str], points: int = POINTS, alike: float = ALIKE, bands: int = BANDS, sides: int = SIDES, seed: int = 0, size: str | None = None) -> DataFrame:
    """Pairs (a, b, r) of groups whose courses correlate above ``alike``: equal ones with the first of them, others with one another."""
    sig = signatures(wide, signals, points, size).filter("signature IS NOT NULL")
    digest = F.sha2(F.concat_ws(",", F.transform("signature", lambda e: F.round(e, 9).cast("string"))), 256)
    sig = once(sig.withColumn("digest", digest).withColumn("first", F.min("grp").over(Window.partitionBy("digest"))))
    equal = sig.filter("grp <> first").select(F.col("first").alias("a"), F.col("grp").alias("b"), F.lit(1.0).alias("r"))
    firsts = sig.filter("grp = first").select("grp", "signature")
    bands, sides = band_shape(firsts.count(), alike, bands, sides)
    planes = np.random.default_rng(seed).normal(size=(bands * sides, points * len(signals)))

    def keys(batches):
        for b in batches:
            x = b.column("signature").flatten().to_numpy().reshape(b.num_rows, -1)
            bit = (x @ planes.T > 0).reshape(b.num_rows, bands, sides)
            key = bit @ (1 << np.arange(sides)) + (np.arange(bands) << sides)
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("signature"), pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), pa.array(key.ravel().astype(np.int64)))], ["grp", "signature", "keys"])

    one = firsts.mapInArrow(keys, f"grp {dict(sig.dtypes)['grp']}, signature array<double>, keys array<long>")
    one = once(one)
    k = one.select("grp", F.explode("keys").alias("key"))
    met = k.select(F.col("grp").alias("a"), "key").join(k.select(F.col("grp").alias("b"), "key"), "key").filter("a < b").select("a", "b").distinct()
    both = met.join(one.select(F.col("grp").alias("a"), F.col("signature").alias("x")), "a").join(one.select(F.col("grp").alias("b"), F.col("signature").alias("y")), "b")
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    near = both.select("a", "b", dot.alias("r")).filter(F.col("r") > alike)
    return equal.unionByName(near)


def families(groups: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``groups`` with component: near-duplicates, directly or over others, share one."""
    fam = connected_components(groups.select(F.col("grp").alias("id")), duplicates)
    return groups.join(fam.withColumnRenamed("id", "grp"), "grp")


def train_val_split(groups: DataFrame, duplicates: DataFrame | None = None, frac: float = 0.25, seed: int = 0) -> DataFrame:
    """``groups`` (grp, n_rows) with is_val: whole families, in the order of a hash, until ``frac`` of the rows is reached; where there are
    two families or more, each side has one."""
    d = families(groups, duplicates) if duplicates is not None else groups.withColumn("component", F.col("grp"))
    fam = once(d.groupBy("component").agg(F.sum("n_rows").alias("n")).withColumn("_h", F.xxhash64("component", F.lit(seed))))
    total, count = fam.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not count:
        return d.withColumn("is_val", F.lit(False)).drop("component")
    placed = ordered.exclusive_prefix(fam.withColumn("_one", F.lit(1)), "_h", "n", "_before", F.shiftright("_h", 54))
    placed = ordered.exclusive_prefix(placed, "_h", "_one", "_rank", F.shiftright("_h", 54))
    val = (F.col("_before") < frac * total) & (F.col("_rank") < count - 1)
    return d.join(placed.select("component", val.alias("is_val")), "component").drop("component")
