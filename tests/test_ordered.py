"""Chunked computations equal the plain ones, whatever the chunk size (brute force on a small series)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustwatch.operators import ordered

CHUNKS = [5, 7, 64, 100_000]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, n in (("a", 103), ("b", 1), ("c", 40)):
        v = rng.integers(0, 3, n).astype(float)
        rows += [(g, i, 1000 * (ord(g) - 97) + i, float(x), float(rng.normal())) for i, x in enumerate(v)]
    pdf = pd.DataFrame(rows, columns=["grp", "pos", "row", "v", "x"])
    pdf.loc[(pdf.grp == "a") & pdf.pos.between(30, 62), "v"] = 2.0
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


@pytest.mark.parametrize("c", CHUNKS)
def test_lag_and_rolling(series, c):
    pdf, df = series
    got = ordered.with_windows(df, ["grp"], lambda w: {"l": F.lag("x", 2).over(w), "m": F.avg("x").over(w.rowsBetween(-3, 1))}, before=3, after=1, chunk_rows=c).toPandas().sort_values(["grp", "pos"]).reset_index(drop=True)
    exp = pdf.sort_values(["grp", "pos"]).reset_index(drop=True)
    lag = exp.groupby("grp")["x"].shift(2)
    assert np.allclose(got["l"].fillna(-9), lag.fillna(-9))
    mean = [exp[(exp.grp == g) & exp.pos.between(p - 3, p + 1)]["x"].mean() for g, p in zip(exp.grp, exp.pos)]
    assert np.allclose(got["m"], mean)


def runs(pdf, flag):
    out, cur = [], None
    for g, p, r, f in pdf.sort_values(["grp", "pos"])[["grp", "pos", "row", flag]].itertuples(index=False):
        if f and cur and cur[0] == g and cur[2] == p - 1:
            cur = (g, cur[1], p, cur[3], r)
        elif f:
            if cur:
                out.append(cur)
            cur = (g, p, p, r, r)
        elif cur:
            out.append(cur)
            cur = None
    return sorted(out + ([cur] if cur else []))


@pytest.mark.parametrize("c", CHUNKS)
def test_islands(series, c):
    pdf, df = series
    p = pdf.assign(flag=pdf.v >= 1)
    got = ordered.islands(df.filter("v >= 1"), ["grp"], chunk_rows=c, aggs={"s": ("sum", F.col("v"))}).toPandas()
    assert sorted(zip(got.grp, got.pos_start, got.pos_end, got.row_start, got.row_end)) == runs(p, "flag")
    assert got["n"].sum() == p.flag.sum() and got["s"].sum() == p[p.flag].v.sum()
    long = ordered.islands(df.filter("v >= 1"), ["grp"], chunk_rows=c, min_len=4).toPandas()
    assert sorted(zip(long.grp, long.pos_start, long.pos_end)) == [(a, b, e) for a, b, e, *_ in runs(p, "flag") if e - b >= 3]


@pytest.mark.parametrize("c", CHUNKS)
def test_value_runs_and_segments(series, c):
    pdf, df = series
    got = ordered.value_runs(df, ["grp"], ["v"], min_len=4, chunk_rows=c).toPandas()
    exp, cur = [], []
    for r in pdf.sort_values(["grp", "pos"]).itertuples():
        if cur and cur[-1].grp == r.grp and cur[-1].v == r.v:
            cur.append(r)
        else:
            if len(cur) >= 4:
                exp.append((cur[0].grp, cur[0].row, cur[-1].row, len(cur), cur[0].v))
            cur = [r]
    if len(cur) >= 4:
        exp.append((cur[0].grp, cur[0].row, cur[-1].row, len(cur), cur[0].v))
    assert sorted(zip(got.grp, got.row_start, got.row_end, got.n, got.value)) == sorted(exp)
    seg = ordered.segments(df, ["grp"], lambda w: F.lag("v").over(w) != F.col("v"), chunk_rows=c).toPandas()
    assert seg["n"].sum() == len(pdf)
    changes = (pdf.sort_values(["grp", "pos"]).groupby("grp")["v"].apply(lambda v: (v != v.shift()).sum())).sum()
    assert len(seg) == changes


@pytest.mark.parametrize("c", CHUNKS)
def test_running_totals(series, c):
    pdf, df = series
    exp = pdf.sort_values(["grp", "pos"]).reset_index(drop=True)
    got = ordered.running_sums(df, ["grp"], {"r": F.col("x")}, chunk_rows=c).toPandas().sort_values(["grp", "pos"])
    assert np.allclose(got["r"], exp.groupby("grp")["x"].cumsum())
    cu = ordered.cusum(df, ["grp"], {"s": F.col("x") - 0.1}, chunk_rows=c).toPandas().sort_values(["grp", "pos"])
    s = []
    for _, g in exp.groupby("grp"):
        cur = 0.0
        for x in g["x"]:
            cur = max(0.0, cur + x - 0.1)
            s.append(cur)
    assert np.allclose(cu["s"], s)


def test_ewma(series):
    pdf, df = series
    exp = pdf.sort_values(["grp", "pos"])
    for c in (300, 2048):
        got = ordered.ewma(df, ["grp"], {"e": F.col("x")}, 0.15, chunk_rows=c).toPandas().sort_values(["grp", "pos"])
        e = []
        for _, g in exp.groupby("grp"):
            cur = 0.0
            for x in g["x"]:
                cur = 0.15 * x + 0.85 * cur
                e.append(cur)
        assert np.allclose(got["e"], e)


def test_numbering_and_intervals(spark, series):
    pdf, df = series
    d = df.select("grp", F.col("pos").alias("t"), "x")
    n = ordered.number_rows(d, "grp", ["t"], [F.floor(F.col("t") / 10)], prefix=1).toPandas().sort_values("row")
    assert list(n["row"]) == list(range(len(pdf))) and list(n["grp"]) == sorted(n["grp"]) and (n["pos"] == n["t"]).all()
    f = ordered.number_file_rows(d, ["grp", "t"]).toPandas().sort_values("row")
    assert list(zip(f.grp, f.t)) == sorted(zip(d.toPandas().grp, d.toPandas().t)) and list(f["row"]) == list(range(len(pdf)))
    iv = spark.createDataFrame([("a", 3, 50), ("a", 40, 45), ("c", 2000, 2039)], "grp string, row_start long, row_end long")
    got = ordered.join_intervals(df.select("grp", "row"), iv, ["grp"], bucket_rows=8).count()
    assert got == 48 + 6 + 40
    b = iv.select("grp", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end"))
    assert ordered.overlap_intervals(iv, b, ["grp"], bucket_rows=8).count() == 5


def test_rolling_std_on_its_limit_is_decided_as_in_sql(spark):
    """Windows whose deviation is 8 but for the last digit."""
    from tests.oracle import duck
    from trustwatch.operators import rules

    at_limit = [[29, 41, 26, 37, 21, 26, 45, 27, 43, 33, 40, 40], [20, 35, 22, 31, 44, 34, 43, 24, 26, 29, 38, 38], [42, 40, 38, 40, 27, 33, 40, 20, 42, 35, 31, 20]]
    rows = [(str(g), 12 * g + i, i, float(v)) for g, w in enumerate(at_limit) for i, v in enumerate(w)]
    spec = dict(rule_id="R", type="rolling_stat", signal="s01", stat="std", window=12, op=">=", value=8.0)
    got = rules.rule_episodes(spark.createDataFrame(rows, "grp string, row long, pos long, s01 double"), [spec])
    values = ", ".join(f"('{g}', {p}, {x})" for g, _, p, x in rows)
    want = duck("/none").sql(f"SELECT grp FROM (SELECT grp, pos, stddev_samp(CAST(x AS DOUBLE)) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM (VALUES {values}) AS t(grp, pos, x)) WHERE pos = 11 AND NOT v >= 8").fetchall()
    assert sorted((r.grp,) for r in got.collect()) == sorted(want) == [("0",)]
