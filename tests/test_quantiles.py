"""Exact quantiles and ranks by counting, against numpy, with brackets, narrowing and missed brackets forced."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustwatch.functions import stats as S

PS = [0.0, 0.01, 0.25, 0.5, 0.505, 0.99, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 12_000
    cols = {"a": rng.normal(size=n), "b": np.round(rng.exponential(size=n), 1), "c": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 1e6), "d": np.full(n, 3.0), "e": np.arange(n) * 1.0}
    rows = [(int(i % 3 == 0) + int(i > 11_800), *[float(c[i]) if rng.random() > 0.05 else None for c in cols.values()], None) for i in range(n)]
    return spark.createDataFrame(rows, "g int, a double, b double, c double, d double, e double, f double").repartition(4).cache()


def _want(x):
    x = x.dropna().to_numpy()
    return np.quantile(x, PS) if len(x) else [None] * len(PS)


@pytest.mark.parametrize("slice_,few,around", [(1 << 20, 10_000, None), (40, 10, None), (1 << 20, 0, 0.0)])
def test_quantiles(data, monkeypatch, slice_, few, around):
    """slice_ 40: brackets are narrowed again and again; around 0: the sketch's brackets miss ranks, so all values are counted."""
    monkeypatch.setattr(S, "SLICE", slice_)
    monkeypatch.setattr(S, "FEW_ROWS", few)
    if around is not None:
        monkeypatch.setattr(S, "AROUND", around)
    p = data.toPandas()
    for r in S.wide_quantiles(data, {c: F.col(c) for c in "abcdef"}, PS).collect():
        assert r.n == p[r.feature].count()
        if r.n:
            assert np.allclose(r.q, _want(p[r.feature]), rtol=1e-12, atol=1e-9)
        else:
            assert set(r.q) == {None}
    for c in "ac":
        got = {r.g: (r.n, r.q) for r in S.group_quantiles(data, ["g"], c, PS).collect()}
        assert set(got) == set(p.g)
        for g, (n, q) in got.items():
            x = p[p.g == g][c]
            assert n == x.count() and np.allclose(q, _want(x), rtol=1e-12, atol=1e-9)
    assert S.group_quantiles(data, ["g"], "f", PS).count() == 0 and S.group_quantiles(data.filter("g < 0"), [], "a", PS).count() == 0


def test_stats_agree(data):
    long = data.unpivot([], list("abcde"), "signal", "value")
    a = S.signal_stats(long).toPandas().set_index("signal").sort_index()
    b = S.wide_stats(data, {c: F.col(c) for c in "abcde"}).toPandas().set_index("signal").sort_index()
    assert list(a.columns) == list(b.columns) and np.allclose(a.astype(float), b.astype(float), rtol=1e-9)
    x = data.toPandas().c.dropna()
    assert a.loc["c", "mad"] == pytest.approx(np.median(np.abs(x - np.median(x))))


def test_ranks(data):
    p = data.select("g", "c").toPandas().dropna()
    p["want"] = p.groupby("g").c.rank()
    want = {(r.g, r.c): r.want for r in p.itertuples()}
    assert {(r.g, r.c): r["rank"] for r in S.average_ranks(data, ["g"], "c").collect()} == want


def test_feature_windows_run_once(spark):
    """Scales of the blocks are fitted from written blocks: only the raw signals' own passes (moments, and three for each of two quantile steps) read the table besides."""
    from trustwatch.operators import detect

    seen = spark.sparkContext.accumulator(0)
    rows = [(str(i % 3), i, i // 3, float(i * 7 % 50), float(i * 11 % 31)) for i in range(300)]
    schema = "grp string, row long, pos long, a double, b double"

    def through(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    spec = detect.fit_features(spark.createDataFrame(rows, schema).mapInPandas(through, schema), ["a", "b"], 5)
    assert seen.value <= 8 * len(rows) and set(spec.blocks) == set(spec.names("rmean", "rstd", "d1", "d2"))


def test_pivots_only_place_the_brackets(data, monkeypatch):
    """Few pivots and brackets too narrow for them: ranks are missed, and all values counted; NaN is the largest value and nulls are left out."""
    p = data.toPandas()
    for name, value in (("FEW_ROWS", 0), ("PIVOTS", 40), ("SIGMAS", 0.0)):
        monkeypatch.setattr(S, name, value)
    for width in (S.AROUND, 0.05):
        monkeypatch.setattr(S, "WIDTHS", (width,))
        for r in S.wide_quantiles(data, {c: F.col(c) for c in "abcde"}, [0.3, 0.9]).collect():
            x = p[r.feature].dropna()
            assert r.n == len(x) and np.allclose(r.q, np.quantile(x, [0.3, 0.9]), rtol=1e-12, atol=1e-9)
    nan = data.select(F.when(F.col("e") > 11_000, float("nan")).otherwise(F.col("e")).alias("e"))
    q = S.wide_quantiles(nan, {"e": F.col("e")}, [0.1, 1.0]).first().q
    assert np.isclose(q[0], np.quantile(p.e.dropna(), 0.1)) and np.isnan(q[1])
