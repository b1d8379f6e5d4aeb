"""Fingerprints, relations and roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import lags as L
from trustwatch.operators import ordered
from trustwatch.operators import profile as P
from trustwatch.plans import q_quality as QQ
from trustwatch.plans import views as V
from trustwatch.plans.registry import query

D, W = "WITH " + V.DIRTY_WIDE, "WITH " + V.SENSOR_WIDE
WL = W + ", wl AS (" + " UNION ALL ".join(f"SELECT grp, row, pos, '{s}' AS signal, {s} AS value FROM sensor_wide" for s in V.SIGNALS) + ")"


def rd(d, keep, cols, k=4):
    return d.select(*keep, *[F.round(c, k).alias(c) for c in cols])


def dirty_long(spark, sf):
    return V.to_long(V.dirty_wide(spark, sf).select(*V.SIGNALS), [])


@query("e1_global_stats", D + """ SELECT signal, CAST(count(value) AS BIGINT) AS count, round(1 - count(value) / count(*), 6) AS missing_rate, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max,
round(quantile_cont(value, 0.01), 4) AS q01, round(quantile_cont(value, 0.05), 4) AS q05, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75,
round(quantile_cont(value, 0.95), 4) AS q95, round(quantile_cont(value, 0.99), 4) AS q99, round(skewness(value), 3) AS skew, round(kurtosis(value), 3) AS kurtosis, CAST(count(DISTINCT value) AS BIGINT) AS n_unique,
bool_and(value = floor(value)) AS integer_valued FROM dirty_long GROUP BY signal""")
def e1(spark, sf):
    long = dirty_long(spark, sf)
    d = P.global_stats(long)
    return d.select("signal", "count", F.round("missing_rate", 6).alias("missing_rate"), F.round("mean", 4).alias("mean"), "min", "max", *[F.round(c, 4).alias(c) for c in ("q01", "q05", "q25", "q50", "q75", "q95", "q99")],
                    F.round("skew", 3).alias("skew"), F.round("kurtosis", 3).alias("kurtosis"), "n_unique", "integer_valued")


@query("e2_share_at_limits", D + """ SELECT signal, round(avg(CAST(value = mn AS INT)), 6) AS share_at_min, round(avg(CAST(value = mx AS INT)), 6) AS share_at_max
FROM (SELECT *, min(value) OVER (PARTITION BY signal) AS mn, max(value) OVER (PARTITION BY signal) AS mx FROM dirty_long) WHERE value IS NOT NULL GROUP BY signal""")
def e2(spark, sf):
    return rd(P.share_at_limits(dirty_long(spark, sf), QQ.dirty_stats(spark, sf)), ["signal"], ["share_at_min", "share_at_max"], 6)


@query("e3_robust_scale", "WITH " + QQ.STATS + " SELECT signal, round(mad, 4) AS mad, round(scale, 4) AS scale FROM stats")
def e3(spark, sf):
    return rd(P.robust_scale(S.signal_stats(dirty_long(spark, sf))), ["signal"], ["mad", "scale"])


DYN = WL + """, l AS (SELECT *, lag(value) OVER w AS x1, lag(value, 5) OVER w AS x5, avg(value) OVER (PARTITION BY grp, signal) AS mu, stddev_pop(value) OVER (PARTITION BY grp, signal) AS sd FROM wl WINDOW w AS (PARTITION BY grp, signal ORDER BY pos)),
r0 AS (SELECT grp, signal, pos, coalesce(lead(pos) OVER (PARTITION BY grp, signal ORDER BY pos), (SELECT 1)) AS nxt, lead(pos) OVER (PARTITION BY grp, signal ORDER BY pos) AS nx FROM l WHERE x1 IS NULL OR value <> x1),
g AS (SELECT grp, count(*) AS n FROM sensor_wide GROUP BY 1), r1 AS (SELECT grp, signal, coalesce(nx, n) - pos AS len FROM r0 JOIN g USING (grp)), rm AS (SELECT grp, signal, quantile_cont(len, 0.5) AS hold FROM r1 GROUP BY 1, 2),
rr AS (SELECT grp, signal, hold, greatest(0.0, 1 - least(1.0, 1.4826 * quantile_cont(abs(len - hold), 0.5) / hold)) AS reg FROM r1 JOIN rm USING (grp, signal) GROUP BY grp, signal, hold),
u AS (SELECT grp, signal, avg((value - mu) * (x1 - mu)) / max(sd * sd) AS a1, avg((value - mu) * (x5 - mu)) / max(sd * sd) AS a5, stddev_pop(value - x1) / max(sd) AS noise, avg(CAST(value = x1 AS INT)) AS stuck, abs(corr(value, pos)) AS trend,
      quantile_cont(CASE WHEN value <> x1 THEN abs(value - x1) END, 0.01) AS q, quantile_cont(CASE WHEN value <> x1 THEN abs(value - x1) END, 0.5) / max(sd) AS jump, avg(CASE WHEN value <> x1 THEN CAST(abs(value - x1) > 0.5 * sd AS INT) END) AS big FROM l GROUP BY 1, 2)
SELECT signal, CAST(count(*) AS BIGINT) AS n_units, round(quantile_cont(a1, 0.5), 4) AS autocorr_lag1, round(quantile_cont(a5, 0.5), 4) AS autocorr_lag5, round(quantile_cont(noise, 0.5), 4) AS noise_level, round(quantile_cont(stuck, 0.5), 4) AS stuck_fraction,
round(quantile_cont(hold, 0.5), 4) AS hold_period, round(quantile_cont(reg, 0.5), 4) AS hold_regularity, round(quantile_cont(q, 0.5), 4) AS quantization_step, round(quantile_cont(jump, 0.5), 4) AS jump_ratio, round(quantile_cont(big, 0.5), 4) AS large_jump_share, round(quantile_cont(trend, 0.5), 4) AS trend_strength
FROM u JOIN rr USING (grp, signal) GROUP BY signal"""


@query("e4_dynamics", DYN)
def e4(spark, sf):
    d = P.dynamics(V.sensor_wide(spark, sf), V.SIGNALS)
    return rd(d, ["signal", "n_units"], ["autocorr_lag1", "autocorr_lag5", "noise_level", "stuck_fraction", "hold_period", "hold_regularity", "quantization_step", "jump_ratio", "large_jump_share", "trend_strength"])


@query("e5_dominant_period")
def e5(spark, sf):
    w = V.sensor_wide(spark, sf)
    w = w.withColumn("s06", F.col("s01") / 10 + 20 * F.sin(F.col("pos") * 2 * 3.141592653589793 / 24))
    return P.dominant_period(w, ["s01", "s02", "s06"])


def fingerprints(spark, sf):
    return V.staged(spark, sf, "fingerprints", lambda s, d: P.fingerprints(V.sensor_wide(s, d), V.SIGNALS), ["signal"])


@query("e6_shape", WL + """, a AS (SELECT signal, count(value)::DOUBLE AS n, count(DISTINCT value) AS nu, skewness(value) AS sk, kurtosis(value) AS ku FROM wl GROUP BY 1), b AS (SELECT *, (sk * sk + 1) / (ku + 3 * (n - 1) * (n - 1) / greatest(1, (n - 2) * (n - 3))) AS bc FROM a)
SELECT signal, CASE WHEN nu <= 1 THEN 'constant' WHEN nu <= 10 THEN 'discrete' WHEN bc > 0.555 THEN CASE WHEN abs(sk) > 1 THEN 'bimodal_or_skewed' ELSE 'bimodal' END WHEN abs(sk) > 1 THEN 'skewed' WHEN ku > 3 THEN 'heavy_tailed' ELSE 'unimodal' END AS distribution_shape FROM b""")
def e6(spark, sf):
    long = V.to_long(V.sensor_wide(spark, sf).select(*V.SIGNALS), [])
    return P.shape(P.global_stats(long)).select("signal", "distribution_shape")


@query("e7_boundedness", WL + """, a AS (SELECT signal, min(value) AS mn, max(value) AS mx FROM wl GROUP BY 1), b AS (SELECT a.*, (SELECT avg(CAST(value = a.mn AS INT)) FROM wl WHERE wl.signal = a.signal) AS lo, (SELECT avg(CAST(value = a.mx AS INT)) FROM wl WHERE wl.signal = a.signal) AS hi FROM a)
SELECT signal, CASE WHEN mn >= 0 AND mx <= 100 AND mx - mn >= 20 AND (mn < 5 OR mx > 95 OR lo > 0.001 OR hi > 0.001) THEN '0-100' WHEN mn >= 0 AND mx <= 1.0000001 AND mx - mn > 0.2 THEN '0-1' WHEN mn >= 0 THEN 'nonnegative' ELSE 'unbounded' END AS boundedness FROM b""")
def e7(spark, sf):
    return fingerprints(spark, sf).select("signal", "boundedness")


@query("e8_winsorize", "WITH " + QQ.STATS + """ SELECT row, signal, round(CASE WHEN mad > 0 THEN least(greatest(value, median - 6 * 1.4826 * mad), median + 6 * 1.4826 * mad) ELSE value END, 4) AS value
FROM dirty_long JOIN stats USING (signal) WHERE value IS NOT NULL""")
def e8(spark, sf):
    d = P.winsorize(V.to_long(V.dirty_wide(spark, sf), ["row"]).filter("value is not null"), QQ.dirty_stats(spark, sf))
    return d.select("row", "signal", F.round("value", 4).alias("value"))


PAIRS = [(a, b) for i, a in enumerate(V.SIGNALS) for b in V.SIGNALS[i + 1:]]


@query("e9_corr_matrix", W + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM sensor_wide" for a, b in PAIRS))
def e9(spark, sf):
    return rd(P.corr_matrix(V.sensor_wide(spark, sf), V.SIGNALS), ["a", "b"], ["r"])


@query("e9_spearman", W + ", k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS {s}" for s in V.SIGNALS) + " FROM sensor_wide) " +
       " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM k" for a, b in PAIRS))
def e9_spearman(spark, sf):
    return rd(P.spearman_matrix(V.sensor_wide(spark, sf), V.SIGNALS), ["a", "b"], ["r"])


LAGGED = [*V.SIGNALS, "s06", "s07"]
LAG_PAIRS = [(a, b) for i, a in enumerate(LAGGED) for b in LAGGED[i + 1:]]
MAX_LAG = 30


def lag_view(spark, sf):
    """s06 follows s01 by two rows; s07 samples s03 of the row before every fourth row and holds it."""
    w = V.sensor_wide(spark, sf).select("grp", "pos", "row", *V.SIGNALS)

    def cols(x):
        held = F.coalesce(*[F.when(F.pmod("pos", F.lit(4)) == k, F.lag("s03", k + 1).over(x)) for k in range(4)])
        return {"s06": F.lag("s01", 2).over(x) + F.col("s03"), "s07": held}

    return ordered.with_windows(w, ["grp"], cols, before=4)


def lag_curves_sql(pairs, kinds=("x", "d")) -> str:
    """The correlation of every pair at every lag by one join of rows with earlier rows; the small wide result is then turned into rows."""
    both = [(a, b, c, u, v, f"{u}|{v}|{c}") for a, b in pairs for c in kinds for u, v in ((a, b), (b, a))]
    lines = ", ".join(f"avg({s}) AS m_{s}, coalesce(regr_slope({s}, pos), 0) AS b_{s}, avg(CASE WHEN {s} IS NOT NULL THEN pos END) AS p_{s}" for s in LAGGED)
    level = ", ".join(f"{s} - m_{s} - b_{s} * (pos - p_{s}) AS x_{s}" for s in LAGGED)
    step = ", ".join(f"x_{s} - lag(x_{s}) OVER w AS d_{s}" for s in LAGGED)
    fresh = ", ".join(f"CASE WHEN pos = 0 OR {s} <> lag({s}) OVER w THEN x_{s} END AS u_{s}" if s in HELD else f"x_{s} AS u_{s}" for s in LAGGED)
    corr = ", ".join(f'CASE WHEN count(CASE WHEN u.{c}_{u} IS NOT NULL THEN v.{c}_{v} END) >= 20 THEN corr(u.{c}_{u}, v.{c}_{v}) END AS "{n}"' for _, _, c, u, v, n in both)
    rows = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, '{c}' AS kind, CAST({'k' if u == a else '-k'} AS INTEGER) AS lag, \"{n}\" AS r FROM wide_curves" + ("" if u == a else " WHERE k > 0") for a, b, c, u, v, n in both)
    return W + f""", raw AS (SELECT grp, pos, s01, s02, s03, s04, s05, lag(s01, 2) OVER w + s03 AS s06, CASE pos % 4 WHEN 0 THEN lag(s03, 1) OVER w WHEN 1 THEN lag(s03, 2) OVER w WHEN 2 THEN lag(s03, 3) OVER w ELSE lag(s03, 4) OVER w END AS s07
  FROM sensor_wide WINDOW w AS (PARTITION BY grp ORDER BY pos)),
fit AS (SELECT grp, {lines} FROM raw GROUP BY grp), lev AS (SELECT raw.*, {level} FROM raw JOIN fit USING (grp)),
lv AS MATERIALIZED (SELECT *, {step}, {fresh} FROM lev WINDOW w AS (PARTITION BY grp ORDER BY pos)),
wide_curves AS MATERIALIZED (SELECT k, {corr} FROM (SELECT unnest(range(0, {MAX_LAG + 1})) AS k) l, lv v JOIN lv u ON u.grp = v.grp AND u.pos = v.pos - k GROUP BY k),
xc AS MATERIALIZED ({rows}),
pk AS (SELECT a, b, max(CASE WHEN kind = 'd' THEN abs(r) END) AS pd, max(CASE WHEN kind = 'x' THEN abs(r) END) AS px, max(CASE WHEN kind = 'u' THEN abs(r) END) AS pu, count(CASE WHEN kind = 'u' THEN r END) AS nu, max(CASE WHEN kind = 'x' AND lag = 0 THEN r END) AS r0 FROM xc GROUP BY 1, 2),
us AS (SELECT *, CASE WHEN nu >= 3 THEN 'u' WHEN pd >= 0.1 THEN 'd' ELSE 'x' END AS use FROM pk),
bs AS (SELECT xc.*, r0, row_number() OVER (PARTITION BY xc.a, xc.b ORDER BY abs(lag), abs(r) DESC, lag DESC) AS rn FROM xc JOIN us USING (a, b)
       WHERE kind = use AND abs(r) >= CASE use WHEN 'u' THEN pu WHEN 'd' THEN 0.9 * pd ELSE 0.9 * px END),
edges AS (SELECT CASE WHEN lag < 0 THEN b ELSE a END AS a, CASE WHEN lag < 0 THEN a ELSE b END AS b, abs(lag) AS lag, r AS r_at_lag, r0 AS r, kind FROM bs WHERE rn = 1)"""


HELD = ["s07"]
XC = lag_curves_sql(LAG_PAIRS)
XM = lag_curves_sql([p for p in LAG_PAIRS if "s07" in p], ("x", "d", "u"))


def find_edges(spark, sf):
    """All pairs, as the planted ones have no correlation at lag 0; ``strongest_pairs`` would choose them otherwise."""
    return L.lagged_xcorr(lag_view(spark, sf), LAG_PAIRS, MAX_LAG)


def edges(spark, sf):
    """The written relation graph."""
    return V.staged(spark, sf, "edges", find_edges, ["a", "b"])


@query("e10_lagged_xcorr", XC + " SELECT a, b, lag, round(r_at_lag, 4) AS r_at_lag, round(r, 4) AS r FROM edges")
def e10(spark, sf):
    return rd(find_edges(spark, sf), ["a", "b", "lag"], ["r_at_lag", "r"])


@query("e10_strongest_pairs", W + ", c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM sensor_wide" for a, b in PAIRS) + ") SELECT a, b FROM c WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC LIMIT 80")
def e10_pairs(spark, sf):
    w = V.sensor_wide(spark, sf)
    return spark.createDataFrame(L.strongest_pairs(P.corr_matrix(w, V.SIGNALS)), "a string, b string")


@query("e11_masked_xcorr", XM + " SELECT a, b, lag, round(r_at_lag, 4) AS r_at_lag FROM edges")
def e11(spark, sf):
    d = L.lagged_xcorr(lag_view(spark, sf), [p for p in LAG_PAIRS if "s07" in p], MAX_LAG, held=HELD)
    return rd(d, ["a", "b", "lag"], ["r_at_lag"])


def clusters(spark, sf):
    w = V.sensor_wide(spark, sf)
    nodes = w.limit(1).select(F.explode(F.array(*[F.lit(s) for s in V.SIGNALS])).alias("id"))
    return P.signal_clusters(nodes, P.corr_matrix(w, V.SIGNALS))


@query("e12_signal_clusters", W + ", e AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM sensor_wide" for a, b in PAIRS) + """),
n AS (SELECT unnest(['s01', 's02', 's03', 's04', 's05']) AS id), RECURSIVE_E AS (SELECT a, b FROM e WHERE abs(r) >= 0.6 UNION SELECT b, a FROM e WHERE abs(r) >= 0.6 UNION SELECT id, id FROM n),
h2 AS (SELECT DISTINCT x.a, y.b FROM RECURSIVE_E x JOIN RECURSIVE_E y ON x.b = y.a), h4 AS (SELECT DISTINCT x.a, y.b FROM h2 x JOIN h2 y ON x.b = y.a) SELECT a AS id, min(b) AS component FROM h4 GROUP BY a""")
def e12(spark, sf):
    return clusters(spark, sf)


@query("e13_redundant_signals")
def e13(spark, sf):
    w = V.sensor_wide(spark, sf).withColumn("s06", 2 * F.col("s03") + F.col("s04"))
    d = P.redundant_signals(w, [*V.SIGNALS, "s06"])
    return d.select("signal", F.concat_ws("+", "partners").alias("partners"), F.round("r2", 4).alias("r2"), "derived")


@query("e14_leaders", XC + " SELECT b AS signal, a AS leader, lag, round(r_at_lag, 4) AS r_at_lag FROM edges WHERE lag > 0")
def e14(spark, sf):
    return rd(P.leaders(edges(spark, sf)), ["signal", "leader", "lag"], ["r_at_lag"])


@query("e15_structural_role")
def e15(spark, sf):
    return P.structural_role(fingerprints(spark, sf), ["s05"]).select("signal", "role")


@query("e16_manipulated_score")
def e16(spark, sf):
    return P.manipulated_score(fingerprints(spark, sf), edges(spark, sf)).select("signal", "manipulated")


def catalog(spark, sf):
    return P.signal_catalog(fingerprints(spark, sf), edges(spark, sf), clusters(spark, sf), ["s05"])


@query("e17_role_hypotheses")
def e17(spark, sf):
    return P.role_hypotheses(catalog(spark, sf))


@query("e18_signal_catalog")
def e18(spark, sf):
    return catalog(spark, sf).select("signal", "role", "manipulated", "cluster", "boundedness", "distribution_shape", "n_unique")


@query("e19_test_actuators")
def e19(spark, sf):
    return P.test_actuators(catalog(spark, sf), edges(spark, sf))
