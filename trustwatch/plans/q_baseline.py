"""Baseline candidates on sensor_wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import baseline as B
from trustwatch.operators.quality import once
from trustwatch.plans import views as V
from trustwatch.plans.q_detect import sc
from trustwatch.plans.q_profile import WL
from trustwatch.plans.registry import query

COLS = [f"z_{s}" for s in V.SIGNALS]
W = "WITH " + V.SENSOR_WIDE


def z(spark, sf):
    return B.zscores(V.sensor_wide(spark, sf), V.SIGNALS)


ZL = WL + ", " + sc("rs", "wl", "signal") + ", zl AS (SELECT grp, row, pos, wl.signal, least(10.0, greatest(-10.0, coalesce((value - med) / scale, 0.0))) AS z FROM wl JOIN rs USING (signal))"
MODES = ZL + """, h0 AS (SELECT signal, least(199, CAST(floor((z + 10.0::DOUBLE) * 10.0::DOUBLE + 1e-9) AS INT)) AS bin, count(*) AS c FROM zl GROUP BY 1, 2),
h1 AS (SELECT s.signal, b.bin, coalesce(c, 0) AS c FROM (SELECT DISTINCT signal FROM zl) s CROSS JOIN (SELECT unnest(range(200)) AS bin) b LEFT JOIN h0 ON h0.signal = s.signal AND h0.bin = b.bin),
h2 AS (SELECT *, sum(c) OVER (PARTITION BY signal ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM h1),
md AS (SELECT signal, bin * 0.1::DOUBLE - 10.0::DOUBLE + 0.05::DOUBLE AS mode FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY sm DESC, bin) AS rn FROM h2) WHERE rn = 1)"""


@query("i1_signal_modes", MODES + " SELECT signal, round(mode, 4) AS mode FROM md")
def i1_modes(spark, sf):
    d = B.modes(z(spark, sf), COLS)
    return d.select(F.regexp_replace("signal", "^z_", "").alias("signal"), F.round("mode", 4).alias("mode"))


@query("i1_baseline_modes", MODES + """, ty AS (SELECT row, avg(exp(-0.5 * (z - mode) * (z - mode))) AS typ FROM zl JOIN md USING (signal) GROUP BY row),
lim AS (SELECT min(typ) AS lo, max(typ) AS hi, quantile_cont(typ, 0.1) AS q1, quantile_cont(typ, 0.7) AS q7 FROM ty),
o0 AS (SELECT least(127, CAST(floor((typ - lo) / (hi - lo) * 128) AS INT)) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS c FROM ty, lim GROUP BY 1),
o1 AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 128 AS x FROM o0), o2 AS (SELECT *, sum(c) OVER w AS w0, sum(c * x) OVER w AS s0, sum(c) OVER () AS w, sum(c * x) OVER () AS s FROM o1 WINDOW w AS (ORDER BY bin)),
o3 AS (SELECT lo + (bin + 1) * (hi - lo) / 128 AS otsu FROM o2 ORDER BY CASE WHEN w = w0 THEN -1 ELSE w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2) END DESC, bin LIMIT 1)
SELECT CAST(count(*) FILTER (typ >= least(greatest(otsu, q1), q7)) AS BIGINT) AS n_baseline, round(max(least(greatest(otsu, q1), q7)), 4) AS threshold FROM ty, o3, lim""")
def i1(spark, sf):
    t = once(B.typicality(z(spark, sf), COLS).select("typ"))
    return t.crossJoin(F.broadcast(B.mode_threshold(t))).agg(F.count(F.when(F.col("typ") >= F.col("thr"), 1)).alias("n_baseline"), F.round(F.max("thr"), 4).alias("threshold"))


@query("i2_prechange_rows")
def i2(spark, sf):
    return B.baseline_prechange(z(spark, sf), COLS, 20)


@query("i3_early_segment")
def i3(spark, sf):
    return B.baseline_early(z(spark, sf), COLS, 20)


@query("i4_dense_windows")
def i4(spark, sf):
    return B.baseline_dense(z(spark, sf), COLS, 20)


@query("i5_robust_ellipsoid")
def i5(spark, sf):
    return B.baseline_ellipsoid(z(spark, sf), COLS)


@query("i6_candidate_scores")
def i6(spark, sf):
    _, scores = B.estimate_baseline(V.sensor_wide(spark, sf), V.SIGNALS)
    return scores


@query("i7_smooth_mask", W + """, m AS (SELECT *, avg(CASE WHEN s01 < 30 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) >= 0.5 AS sm FROM sensor_wide),
r AS (SELECT grp, row, count(*) OVER (PARTITION BY grp, isl) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY grp ORDER BY pos) AS isl FROM m WHERE sm)) SELECT grp, row FROM r WHERE n >= 10""")
def i7(spark, sf):
    m = V.sensor_wide(spark, sf).select("grp", "row", "pos", (F.col("s01") < 30).alias("in_baseline"))
    return B.smooth_mask(m, 21, 10).select("grp", "row")


@query("i8_reference_period", W + " SELECT row, grp IN ('3', '4') OR row BETWEEN 1000 AND 1999 AS in_baseline FROM sensor_wide")
def i8(spark, sf):
    return B.baseline_reference(V.sensor_wide(spark, sf), [(1000, 1999)], ["3", "4"]).select("row", "in_baseline")


@query("i9_best_split", W + """, c AS (SELECT grp, row, pos, sum(s02) OVER w AS c1, sum(s02 * s02) OVER w AS c2, pos + 1.0 AS t, sum(s02) OVER g AS t1, sum(s02 * s02) OVER g AS t2, count(*) OVER g AS m
  FROM sensor_wide WINDOW w AS (PARTITION BY grp ORDER BY pos), g AS (PARTITION BY grp)),
gn AS (SELECT *, (t2 - t1 * t1 / m) - (c2 - c1 * c1 / t) - ((t2 - c2) - (t1 - c1) * (t1 - c1) / (m - t)) AS gain FROM c WHERE t >= 20 AND m - t >= 20)
SELECT grp, row + 1 AS row, round((t1 - c1) / (m - t) - c1 / t, 2) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gain DESC, pos) AS rn FROM gn) WHERE rn = 1""")
def i9(spark, sf):
    return B.best_split(V.sensor_wide(spark, sf), "s02", 20).select("grp", "row", F.round("shift", 2).alias("shift"))


@query("c10_segment_by_change")
def c10(spark, sf):
    return B.segment_by_change(B.zscores(V.dirty_wide(spark, sf), V.SIGNALS), COLS, 20)
