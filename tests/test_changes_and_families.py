"""Change points to the end, agreement of labelings, and families of groups by their course."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustwatch.operators import assess, baseline, changes, trajectories


def test_four_cuts_in_one_group(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g, levels in (("a", [0, 4, -3, 5, 1]), ("b", [2]), ("c", [0, 6])):
        i = 0
        for lev in levels:
            for _ in range(200):
                rows.append((g, i, i, float(lev + rng.normal() * 0.4), float(rng.normal())))
                i += 1
    d = spark.createDataFrame(rows, "grp string, row long, pos long, x double, y double")
    cuts = {}
    for r in baseline.segment_by_change(d, ["x", "y"], 10).collect():
        cuts.setdefault(r.grp, []).append(r.pos)
    assert {g: sorted(v) for g, v in cuts.items()} == {"a": [200, 400, 600, 800], "c": [200]}
    pre = baseline.baseline_prechange(d, ["x", "y"], 10).filter("in_baseline").groupBy("grp").count().collect()
    assert {r.grp: r["count"] for r in pre} == {"a": 200, "b": 200, "c": 200}


def test_partition_is_optimal():
    """Against all partitions of a short series, and stretches of a long one."""
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(20):
        x = np.repeat(rng.normal(size=4) * 3, 3)[:, None] + rng.normal(size=(12, 1)) * 0.5
        cost = lambda a, b: float(((x[a:b] - x[a:b].mean(0)) ** 2).sum())
        best = min(([0, *c] for r in range(5) for c in combinations(range(1, 12), r) if all(b - a >= 2 for a, b in zip([0, *c], [*c, 12]))), key=lambda c: sum(cost(a, b) for a, b in zip(c, [*c[1:], 12])) + 2.0 * len(c))
        assert changes.partition(np.ones(12), x, x * x, np.ones(1), 2.0, 2) == best


@pytest.mark.parametrize("most", [2048, 50])
def test_long_series_in_levels(spark, most):
    rng = np.random.default_rng(3)
    level = np.repeat([0.0, 3.0, -2.0, 4.0, 4.0, -1.0], 150)
    d = spark.createDataFrame([("a", i, float(level[i] + rng.normal() * 0.3)) for i in range(900)] + [("b", 0, 1.0)], "grp string, pos long, x double")
    assert sorted(r.pos for r in changes.change_points(d, ["x"], most=most).collect()) == [150, 300, 450, 750]


def test_residual_sees_a_broken_relation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=600)
    y = np.where(np.arange(600) < 300, x, rng.normal(size=600)) + rng.normal(size=600) * 0.05
    d = spark.createDataFrame([("a", i, i, float(x[i]), float(y[i])) for i in range(600)], "grp string, row long, pos long, x double, y double")
    m = baseline.window_means(baseline.pca_residual(d, ["x", "y"], 0.5), ["residual"], 20).orderBy("pos").toPandas()
    assert m.residual[:15].mean() < 0.5 * m.residual[15:].mean()


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_agreement(spark, monkeypatch, chunk):
    monkeypatch.setattr(assess, "EMI_CHUNK", chunk)
    rng = np.random.default_rng(6)
    rows = [(str(rng.integers(0, 6)) if i % 9 else None, str(int(i % 7 == 0) + int(rng.integers(0, 3)))) for i in range(180)]
    got = assess.pattern_agreement(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    names = sorted({str(a) for a, _ in rows}), sorted({b for _, b in rows})
    m = np.zeros((len(names[0]), len(names[1])))
    for a, b in rows:
        m[names[0].index(str(a)), names[1].index(b)] += 1
    n, ra, cb = len(rows), m.sum(1), m.sum(0)
    mi = sum(m[i, j] / n * math.log(m[i, j] * n / (ra[i] * cb[j])) for i in range(len(ra)) for j in range(len(cb)) if m[i, j])
    emi = sum(k / n * math.log(n * k / (x * y)) * math.comb(int(x), k) * math.comb(int(n - x), int(y) - k) / math.comb(n, int(y)) for x in ra for y in cb for k in range(1, int(min(x, y)) + 1) if n - x >= y - k)
    h = lambda p: -sum(v / n * math.log(v / n) for v in p)
    assert got.n == n and got.purity == pytest.approx(m.max(1).sum() / n) and got.ami == pytest.approx((mi - emi) / ((h(ra) + h(cb)) / 2 - emi), rel=1e-9)
    assert assess.pattern_agreement(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


@pytest.fixture(scope="module")
def courses(spark):
    rng = np.random.default_rng(9)
    data = {}
    for g in range(40):
        n = int(rng.integers(20, 400))
        data[f"g{g:02d}"] = rng.normal(size=(n, 2)).cumsum(0)
    data["shifted"] = data["g03"] * 2.5 + 100
    data["noisy"] = data["g05"] + rng.normal(size=data["g05"].shape) * 0.002 * data["g05"].std(0)
    data["same"] = data["g05"].copy()
    data["flat"] = np.full((50, 2), 3.0)
    data["one"] = np.array([[1.0, 2.0]])
    rows = []
    for g, x in data.items():
        for i, (a, b) in enumerate(x):
            rows.append((g, i, float(a) if (g, i) != ("g07", 0) else None, float(b)))
    return data, spark.createDataFrame(rows, "grp string, pos long, x double, y double").repartition(5).cache()


def test_signatures(courses):
    data, d = courses
    got = {r.grp: r.signature for r in trajectories.signatures(d, ["x", "y"]).collect()}
    assert set(got) == set(data) and got["flat"] is None and got["one"] is None
    for g, x in data.items():
        if got[g] is None:
            continue
        x = x.copy()
        if g == "g07":
            x[0, 0] = np.median(x[1:, 0])
        at = np.linspace(0, len(x) - 1, 32)
        v = np.stack([np.interp(at, np.arange(len(x)), x[:, j]) for j in range(2)])
        v = (v - v.mean(1, keepdims=True)) / v.std(1, keepdims=True)
        assert np.allclose(got[g], v.ravel() / np.linalg.norm(v), atol=1e-9), g


def test_families_and_split(spark, courses):
    data, d = courses
    dup = trajectories.near_duplicate_groups(d, ["x", "y"])
    pairs = {tuple(sorted((r.a, r.b))) for r in dup.collect()}
    assert {("g05", "same"), ("g05", "noisy")} <= pairs | {("g05", "noisy")} and ("g03", "shifted") in pairs and all({a, b} <= {"g03", "shifted", "g05", "noisy", "same"} for a, b in pairs)
    groups = d.groupBy("grp").agg(F.count("*").alias("n_rows"))
    for seed in range(4):
        val = {r.grp: r.is_val for r in trajectories.train_val_split(groups, dup, seed=seed).collect()}
        share = sum(len(data[g]) for g, v in val.items() if v) / sum(map(len, data.values()))
        assert set(val) == set(data) and 0.1 < share < 0.6 and val["g03"] == val["shifted"] and val["g05"] == val["same"] == val["noisy"]
    two = spark.createDataFrame([("a", 5), ("b", 5)], "grp string, n_rows long")
    assert sorted(r.is_val for r in trajectories.train_val_split(two, frac=0.99).collect()) == [False, True]
