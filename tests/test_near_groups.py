"""Groups that follow the same course: no shuffle of whole groups, and candidates that grow with the groups, not with their pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustwatch.operators import trajectories as T


def _wide(spark, n=60, rows=90):
    rng = np.random.default_rng(7)
    parts = []
    for g in range(n):
        x = rng.normal(size=(rows, 2)).cumsum(axis=0)
        parts.append(pd.DataFrame({"grp": f"g{g:03d}", "pos": np.arange(rows), "a": x[:, 0], "b": x[:, 1], "group_rows": rows}))
        if g % 10 == 0:  # nearly, but not quite, the same course
            parts.append(parts[-1].assign(grp=f"t{g:03d}", a=x[:, 0] + rng.normal(scale=1e-4, size=rows)))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True)).repartition(4)


def test_rows_between_points_are_dropped_before_the_shuffle(spark):
    w = _wide(spark, 6)
    joined, carried = T.resampled(w, ["a", "b"]), T.resampled(w, ["a", "b"], size="group_rows")
    key = ["grp", "k"]
    x, y = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (joined, carried))
    assert (x[key] == y[key]).all().all() and np.allclose(x[["a", "b"]], y[["a", "b"]])
    held = []
    once = T.once
    T.once = lambda d: held.append(d) or once(d)
    try:
        T.resampled(w, ["a", "b"], size="group_rows")
    finally:
        T.once = once
    assert "Join" not in held[0]._jdf.queryExecution().executedPlan().toString()


def test_bands_grow_with_the_groups():
    assert T.band_shape(1000) == (T.BANDS, T.SIDES)
    for n in (1000, 60_000, 360_000, 10_000_000):
        bands, sides = T.band_shape(n)
        chance = (n * (n - 1) / 2) * bands / 2 ** sides
        shared = (1 - math.acos(T.ALIKE) / math.pi) ** sides
        assert chance <= 0.5 * bands * n and bands < 40 and (1 - shared) ** bands <= T.MISSED


def test_near_copies_are_found_with_any_shape(spark):
    w = _wide(spark)
    for sides in (T.SIDES, 20):
        got = T.near_duplicate_groups(w, ["a", "b"], sides=sides, size="group_rows")
        assert {(r.a, r.b) for r in got.collect()} == {(f"g{g:03d}", f"t{g:03d}") for g in range(0, 60, 10)}
    assert T.near_duplicate_groups(w.filter("false"), ["a", "b"], size="group_rows").count() == 0


def test_signature_work_is_in_proportion_to_its_points(spark):
    """Means and deviations are found once per group and signal, not anew in a lambda for every point."""
    d = spark.range(4000).select(F.concat(F.lit("g"), (F.col("id") % 20).cast("string")).alias("grp"), F.floor(F.col("id") / 20).alias("pos"), F.sin(F.col("id") * 0.37).alias("s01"), F.lit(4.0).alias("s02"))
    sig = T.signatures(d, ["s01", "s02"])
    assert "aggregate(" not in sig._jdf.queryExecution().optimizedPlan().toString()
    r = T.resampled(d, ["s01", "s02"]).toPandas().sort_values(["grp", "k"])
    got = {x.grp: x.signature for x in sig.collect()}
    for g, rows in r.groupby("grp"):
        y = rows.s01.to_numpy() - rows.s01.mean()
        assert got[g] == pytest.approx([*(y / np.sqrt((y * y).sum())), *[0.0] * 32], abs=1e-9)
