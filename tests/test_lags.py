"""Cross-lag sums and the lags chosen from them, against brute force and planted delays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustwatch.operators import detect, lags


def series(sizes, seed=3):
    """a: random walk of short memory; b follows a by 3 rows; c is a held over 5 rows after 2 rows of delay; e is noise; with gaps and non-finite readings."""
    rng = np.random.default_rng(seed)
    frames = []
    for g, n in enumerate(sizes):
        x = np.zeros(n + 8)
        for i in range(1, n + 8):
            x[i] = 0.6 * x[i - 1] + rng.normal()
        a = x[8:]
        b = x[5:n + 5] + 0.1 * rng.normal(size=n) + 0.01 * np.arange(n) * g
        c = np.array([x[8 + i - i % 5 - 2] for i in range(n)])
        f = pd.DataFrame({"grp": f"g{g}", "pos": np.arange(n), "a": a + 1000, "b": b, "c": c, "e": rng.normal(size=n)})
        f.loc[f.pos % 37 == 5, "b"] = np.nan
        f.loc[f.pos % 91 == 7, "e"] = np.inf
        frames.append(f)
    return pd.concat(frames, ignore_index=True)


def expected(pdf, u, v, lag, kind, held):
    """Correlation of u ``lag`` rows before v, pooled over groups, from the definition."""
    x, y = [], []
    for _, f in pdf.groupby("grp"):
        cols = {}
        for s in (u, v):
            raw = f[s].to_numpy().copy()
            raw[~np.isfinite(raw)] = np.nan
            ok = np.isfinite(raw)
            p = np.arange(len(raw), dtype=float)
            slope = np.polyfit(p[ok], raw[ok], 1)[0] if ok.sum() > 1 else 0.0
            z = raw - raw[ok].mean() - slope * (p - p[ok].mean())
            if kind == "d":
                z = np.r_[np.nan, np.diff(z)]
            if kind == "u" and s in held:
                step = np.r_[1.0, np.diff(raw)]
                z = np.where(np.isfinite(step) & (step != 0), z, np.nan)
            cols[s] = z
        for t in range(lag, len(f)):
            i, j = cols[u][t - lag], cols[v][t]
            if np.isfinite(i) and np.isfinite(j):
                x.append(i)
                y.append(j)
    return (np.corrcoef(x, y)[0, 1] if len(x) >= 20 else None), len(x)


@pytest.mark.parametrize("chunk_rows", [11, 64, 100_000])
def test_curves_equal_brute_force(spark, chunk_rows):
    pdf = series([1, 2, 7, 60, 233])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # batches cut chunks anywhere
    try:
        d = spark.createDataFrame(pdf).repartition(3)
        got = {(r.a, r.b, r.kind, r.lag): (r.n, r.r) for r in lags.curves(lags.lag_sums(d, [("a", "b"), ("a", "c"), ("c", "e")], 6, ["c"], chunk_rows=chunk_rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3 * 3 * 13
    for (a, b, kind, lag), (n, r) in got.items():
        u, v = (a, b) if lag >= 0 else (b, a)
        want, rows = expected(pdf, u, v, abs(lag), kind, ["c"])
        assert n == rows
        assert (r is None) == (want is None) and (r is None or r == pytest.approx(want, abs=1e-9))


def test_planted_delays(spark):
    d = spark.createDataFrame(series([400, 300]))
    e = {frozenset((r.a, r.b)): r for r in lags.lagged_xcorr(d, [("a", "b"), ("b", "e"), ("c", "a")], 12, held=["c"]).collect()}
    ab, ca = e[frozenset("ab")], e[frozenset("ca")]
    assert (ab.a, ab.b, ab.lag, ab.method) == ("a", "b", 3, "difference") and ab.r_at_lag > 0.9
    assert (ca.a, ca.b, ca.lag, ca.method) == ("a", "c", 2, "update_instants") and ca.r_at_lag > 0.99
    assert abs(e[frozenset("be")].r_at_lag) < 0.3


def test_plateau_takes_the_smallest_lag(spark):
    t = spark.createDataFrame([("a", "b", "x", k, 100, {-2: 0.91, 0: 0.5, 1: 0.92, 4: 1.0}.get(k, 0.1)) for k in range(-5, 6)] + [("a", "b", "d", k, 100, 0.05) for k in range(-5, 6)], "a string, b string, kind string, lag int, n long, r double")
    r = lags.best_lags(t).first()
    assert (r.a, r.b, r.lag, r.r_at_lag, r.r, r.method) == ("a", "b", 1, 0.92, 0.5, "level")
    tie = spark.createDataFrame([("a", "b", "x", k, 100, 0.4) for k in (-1, 1)], "a string, b string, kind string, lag int, n long, r double")
    assert lags.best_lags(tie).first().a == "a"


def test_empty_and_constant(spark):
    none = spark.createDataFrame([], "grp string, pos long, a double, b double")
    assert lags.lagged_xcorr(none, [("a", "b")], 3).count() == 0
    flat = spark.createDataFrame([("g", i, 5.0, float(i % 3)) for i in range(90)], "grp string, pos long, a double, b double")
    assert lags.lagged_xcorr(flat, [("a", "b")], 3).count() == 0
    m = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.9), ("b", "c", 0.2)], "a string, b string, r double")
    assert lags.strongest_pairs(m) == [("a", "c"), ("a", "b")] and lags.strongest_pairs(m, 1) == [("a", "c")]


def test_peers_are_read_at_their_lag(spark):
    """b follows a by 3 rows until a fault cuts it off; without the lag the two hardly correlate."""
    pdf = series([300, 300, 300], seed=5)[["grp", "pos", "a", "b"]].fillna({"b": 0.0})
    pdf["row"] = np.arange(len(pdf))
    late = (pdf.grp == "g2") & (pdf.pos >= 200)
    pdf.loc[late, "b"] = np.random.default_rng(1).permutation(pdf.loc[late, "b"].to_numpy())
    d = spark.createDataFrame(pdf).withColumn("in_baseline", F.col("grp") != "g2")
    s = detect.fit_features(d, ["a", "b"], 20, F.col("in_baseline"))
    f = detect.features(d, s).join(d.select("row", "in_baseline"), "row").cache()
    m = detect.fit_corr_break(f, s, "in_baseline")
    assert m.shift[next(iter(m.coef["value__b"]))] == ("value__a", 3)
    assert all(k >= 0 for _, k in m.shift.values())
    res = detect._residuals(f, m).toPandas().set_index("row").value__b
    wide = f.toPandas().set_index("row")
    for row in (0, 2, 50, 333):  # from the definition; before the first row of a group the peer counts as 0
        peer = wide.value__a[row - 3] if pdf.pos[row] >= 3 else 0.0
        assert res[row] == pytest.approx(wide.value__b[row] - m.icpt["value__b"] - m.coef["value__b"]["value__a__lag3"] * peer, abs=1e-9)
    score = detect.score_corr_break(f, m, s).toPandas().set_index("row").score
    assert score[late[late].index].median() > 3 * score[pdf.index[(pdf.grp == "g2") & (pdf.pos < 200)]].median()
