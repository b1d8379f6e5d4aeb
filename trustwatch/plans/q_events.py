"""Events, attribution and patterns; deterministic scores for the SQL-checked ones, model scores for the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.operators import detect as J
from trustwatch.operators import events as K
from trustwatch.operators import lags as L
from trustwatch.operators import onsets as O
from trustwatch.operators.baseline import zscores
from trustwatch.plans import q_detect as QD
from trustwatch.plans import q_profile as QP
from trustwatch.plans import q_trust as QT
from trustwatch.plans import views as V
from trustwatch.plans.q_baseline import ZL
from trustwatch.plans.registry import query

SS = ["s03", "s04"]
W = "WITH " + V.SENSOR_WIDE + ", sc AS (SELECT grp, row, pos, s02 / 50000.0 AS score, s03 AS share_s03, s04 AS share_s04, (s02 - 50000) / 10000.0 AS zz FROM sensor_wide)"


def simple(spark, sf):
    return V.sensor_wide(spark, sf).select("grp", "row", "pos", (F.col("s02") / 50000.0).alias("score"), F.col("s03").alias("share_s03"), F.col("s04").alias("share_s04"), ((F.col("s02") - 50000) / 10000.0).alias("zz"))


MED = W + ", md AS (SELECT *, quantile_cont(score, 0.5) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM sc)"


@query("k1_sustained", MED + " SELECT row, med >= 1.2 AS sustained FROM md")
def k1(spark, sf):
    return K.sustained(simple(spark, sf), 11, 1.2).select("row", "sustained")


@query("k1_sustained_threshold", MED + """ SELECT CAST(count(*) AS BIGINT) AS n, round(least(1.0, greatest(0.5, greatest(least(quantile_cont(med, 0.995), greatest(quantile_cont(med, 0.75) + 3 * (quantile_cont(med, 0.75) - quantile_cont(med, 0.25)), quantile_cont(med, 0.9))) * 1.1, 1.5 * quantile_cont(med, 0.5)))), 4) AS threshold FROM md""")
def k1_thr(spark, sf):
    return K.sustained_threshold(simple(spark, sf), 11).select("n", F.round("threshold", 4).alias("threshold"))


SEG = W + """, hot AS (SELECT *, lag(row) OVER (PARTITION BY grp ORDER BY pos) AS pr, lag(pos) OVER (PARTITION BY grp ORDER BY pos) AS pp FROM sc WHERE score >= 1),
sid AS (SELECT *, sum(CASE WHEN pp IS NOT NULL AND pos - pp - 1 <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY pos) AS seg FROM hot),
sg AS (SELECT grp, min(row) AS row_start, max(row) AS row_end, max(pos) - min(pos) + 1 AS n, count(*) AS n_hot, avg(score) AS mean_score, max(score) AS peak FROM sid GROUP BY grp, seg),
segs AS (SELECT * FROM sg WHERE n >= 5 AND (n >= 40 OR mean_score >= 1.25 OR peak >= 2))"""


def segs(spark, sf):
    return K.segments(simple(spark, sf), gap=3)


@query("k2_segments", SEG + " SELECT grp, row_start, row_end, CAST(n AS BIGINT) AS n, CAST(n_hot AS BIGINT) AS n_hot, round(mean_score, 4) AS mean_score, round(peak, 4) AS peak FROM segs")
def k2(spark, sf):
    return segs(spark, sf).select("grp", "row_start", "row_end", "n", "n_hot", F.round("mean_score", 4).alias("mean_score"), F.round("peak", 4).alias("peak"))


@query("k2_segments_sustained")
def k2_sustained(spark, sf):
    return K.segments(QD.score_table(spark, sf), sustain=0.9)


LEAD = "CASE WHEN share_s04 >= share_s03 THEN 's04' ELSE 's03' END"


@query("k3_group_summary", W + f""", c AS (SELECT grp, {LEAD} AS lead, count(*) AS c FROM sc WHERE score >= 1 GROUP BY 1, 2), m AS (SELECT grp, lead FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY c DESC, lead) = 1)
SELECT grp, round(max(score), 4) AS max_score, round(avg(score), 4) AS mean_score, round(avg(CAST(score >= 1 AS INT)), 4) AS flagged_share, min(CASE WHEN score >= 1 THEN row END) AS first_row, any_value(m.lead) AS leading_signal FROM sc LEFT JOIN m USING (grp) GROUP BY grp""")
def k3(spark, sf):
    d = K.group_summary(simple(spark, sf), SS)
    return d.select("grp", *[F.round(c, 4).alias(c) for c in ("max_score", "mean_score", "flagged_share")], "first_row", "leading_signal")


@query("k4_summary_events", SEG + """, tp AS (SELECT * FROM segs QUALIFY row_number() OVER (PARTITION BY grp ORDER BY mean_score * ln(1 + n) DESC, row_start) <= 2)
SELECT t.grp, t.row_start, t.row_end, round(avg(share_s03), 9) AS share_s03, round(avg(share_s04), 9) AS share_s04 FROM tp t JOIN sc ON sc.grp = t.grp AND sc.row BETWEEN t.row_start AND t.row_end WHERE score >= 1 GROUP BY 1, 2, 3""")
def k4(spark, sf):
    d = K.summary_events(segs(spark, sf), simple(spark, sf), SS)
    return d.select("grp", "row_start", "row_end", F.round("share_s03", 9).alias("share_s03"), F.round("share_s04", 9).alias("share_s04"))


@query("k5_point_events", W + """, i AS (SELECT grp, min(row) AS row_start, max(row) AS row_end, count(*) AS n, max(score) AS peak, max(abs(zz)) AS mz FROM (SELECT *, pos - row_number() OVER (PARTITION BY grp ORDER BY pos) AS isl FROM sc WHERE score >= 1) GROUP BY grp, isl)
SELECT grp, row_start, row_end, CAST(n AS BIGINT) AS n, round(peak, 4) AS peak FROM i WHERE n <= 2 AND peak >= 1.5 AND mz >= 4""")
def k5(spark, sf):
    return K.point_events(simple(spark, sf), "zz").select("grp", "row_start", "row_end", "n", F.round("peak", 4).alias("peak"))


def model_points(spark, sf):
    z = zscores(V.dirty_wide(spark, sf), V.SIGNALS).select("grp", "row", F.greatest(*[F.abs(f"z_{s}") for s in V.SIGNALS]).alias("zmax"))
    return K.point_events(QD.score_table(spark, sf).join(z, ["grp", "row"]), "zmax")


@query("k6_drop_echoes")
def k6(spark, sf):
    wide = K.repair_points(V.dirty_wide(spark, sf), model_points(spark, sf), V.SIGNALS)
    again = J.score_rows(wide, QD.final_model(spark, sf))
    return K.drop_echoes(K.segments(QD.score_table(spark, sf)), again)


def onset_table(spark, sf):
    return V.staged(spark, sf, "onsets", lambda s, d: O.estimate(QD.score_table(s, d)), ["grp"])


def flags(spark, sf):
    return V.staged(spark, sf, "flags", lambda s, d: K.build_flags(
        K.summary_events(K.segments(QD.score_table(s, d)), QD.score_table(s, d), V.SIGNALS, None), model_points(s, d), onset_table(s, d)), ["grp", "row_start"])


@query("k7_flags")
def k7(spark, sf):
    return flags(spark, sf)


@query("k8_onsets", W + """, c AS (SELECT *, sum(score - 0.75) OVER (PARTITION BY grp ORDER BY pos) AS cc FROM sc), s AS (SELECT *, cc - least(0, min(cc) OVER (PARTITION BY grp ORDER BY pos)) AS st FROM c),
al AS (SELECT grp, min(pos) AS alarm FROM s WHERE st > 3 GROUP BY 1), o AS (SELECT s.grp, any_value(alarm) AS alarm, least(any_value(alarm), coalesce(max(CASE WHEN st <= 1e-9 AND pos <= alarm THEN pos END) + 1, 0)) AS onset FROM s JOIN al USING (grp) GROUP BY s.grp)
SELECT o.grp, sc.row, onset AS pos, alarm FROM o JOIN sc ON sc.grp = o.grp AND sc.pos = onset""")
def k8(spark, sf):
    return alarm_rows(spark, sf).select("grp", "row", "pos", "alarm")


def alarm_rows(spark, sf):
    m = O.moments(simple(spark, sf))
    return O.alarms(m).withColumnRenamed("alarm_pos", "pos").join(m.select("grp", "pos", "row"), ["grp", "pos"])


KNEE = W + """, x0 AS (SELECT grp, pos, ln(1 + greatest(score, 0)) AS x FROM sc), r AS (SELECT grp, pos, count(*) OVER g AS n, avg(x) OVER g AS m, sum(x) OVER g AS t1, sum(x * x) OVER g AS t2, sum(x * pos) OVER g AS tt,
  sum(x) OVER o AS s1, sum(x * x) OVER o AS s2, sum(x * pos) OVER o AS st FROM x0 WINDOW g AS (PARTITION BY grp), o AS (PARTITION BY grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, pos + 1 AS k, s1 / (pos + 1) AS a, CAST(n - pos - 1 AS DOUBLE) AS j FROM r WHERE n >= 80 AND pos + 1 >= greatest(2, floor(0.05 * n)) AND pos + 1 < n - greatest(3, floor(0.1 * n))),
f AS (SELECT *, (tt - st - k * (t1 - s1) - a * (j - 1) * j / 2) / ((j - 1) * j * (2 * j - 1) / 6) AS b FROM k),
e AS (SELECT grp, k, t2 - t1 * m AS flat, s2 - s1 * a + t2 - s2 - 2 * a * (t1 - s1) + j * a * a - b * b * ((j - 1) * j * (2 * j - 1) / 6) AS sse FROM f WHERE b > 0)"""


@query("k8_knee_onsets", KNEE + " SELECT grp, min_by(k, sse) AS knee_pos, round(1 - min(sse) / any_value(flat), 6) AS knee_gain FROM e WHERE sse < flat AND flat > 1e-9 GROUP BY grp")
def k8_knee(spark, sf):
    m = O.moments(simple(spark, sf))
    ends = m.groupBy("grp").agg((F.max("pos") + 1).alias("end"))
    return O.knees(m, ends).select("grp", "knee_pos", F.round("knee_gain", 6).alias("knee_gain"))


@query("k8_onset_estimates")
def k8_estimates(spark, sf):
    return onset_table(spark, sf)


def first_moves(spark, sf, thr=1.2):
    return K.signal_onsets(zscores(V.sensor_wide(spark, sf), V.SIGNALS), V.SIGNALS, thr)


@query("k9_signal_onsets", ZL + """, f AS (SELECT *, sum(CAST(abs(z) > 1.2 AS INT)) OVER w3 AS k, avg(CAST(z > 1.2 AS INT)) OVER w10 - avg(CAST(z < -1.2 AS INT)) OVER w10 AS u FROM zl
  WINDOW w3 AS (PARTITION BY grp, signal ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), w10 AS (PARTITION BY grp, signal ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT grp, signal, min(row) AS row, CASE WHEN min_by(u, pos) >= 0 THEN 'up' ELSE 'down' END AS direction FROM f WHERE k = 3 GROUP BY 1, 2""")
def k9(spark, sf):
    return first_moves(spark, sf).select("grp", "signal", "row", "direction")


@query("k10_change_order")
def k10(spark, sf):
    return K.change_order(zscores(V.sensor_wide(spark, sf), V.SIGNALS), first_moves(spark, sf), V.SIGNALS)


def ranked(spark, sf):
    return V.staged(spark, sf, "ranked", lambda s, d: K.attribute(K.segments(QD.score_table(s, d)), QD.score_table(s, d), first_moves(s, d, 1.0), V.SIGNALS), ["grp", "row_start"])


@query("k11_attribution")
def k11(spark, sf):
    return ranked(spark, sf)


@query("k12_cause")
def k12(spark, sf):
    return K.classify_cause(ranked(spark, sf), QT.checks_table(spark, sf))


def learned(spark, sf):
    """How every pair of signals moves together: who leads, by how many rows, and the correlation there or, if larger, of the same rows."""
    e = L.lagged_xcorr(V.sensor_wide(spark, sf), QP.PAIRS, QP.MAX_LAG)
    return e.select("a", "b", "lag", F.when(F.abs("r") > F.abs("r_at_lag"), F.col("r")).otherwise(F.col("r_at_lag")).alias("r"))


def rel(spark, sf):
    return V.staged(spark, sf, "relations", learned, ["a", "b"])


@query("k13_propagation")
def k13(spark, sf):
    return K.propagation(ranked(spark, sf), rel(spark, sf))


@query("k14_cascades")
def k14(spark, sf):
    r = ranked(spark, sf)
    return K.cascades(r, QP.clusters(spark, sf), K.propagation(r, rel(spark, sf)))


def found_patterns(spark, sf):
    return K.patterns(K.event_vectors(ranked(spark, sf), V.SIGNALS), max_k=4)


@query("k15_patterns")
def k15(spark, sf):
    return found_patterns(spark, sf)[0].select("grp", "row_start", "pattern", "similarity")


@query("k16_assign_pattern", """WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY 1),
xn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1), s AS (SELECT x.vec_id, c.label AS k, sum(x.x * c.c) / (any_value(xn.n) * any_value(cn.n)) AS s FROM x JOIN c ON c.i = x.i JOIN cn ON cn.label = c.label JOIN xn ON xn.vec_id = x.vec_id GROUP BY 1, 2)
SELECT vec_id, CASE WHEN s >= 0.1 THEN k END AS label, round(s, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k DESC) = 1""")
def k16(spark, sf):
    e = V.table(spark, sf, "embeddings")
    d = K.assign_pattern(e.select("vec_id", "embedding"), ["vec_id"], "embedding", K.centroids(e, "label", "embedding"), "label", 0.1)
    return d.select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


@query("k17_pattern_reliability")
def k17(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return K.pattern_reliability(e.select(F.col("label").alias("pattern"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("vec_id").alias("grp"), F.lit(0).alias("row_start")))


@query("k18_suspicious_rows")
def k18(spark, sf):
    p = K.point_events(simple(spark, sf), "zz")
    return K.suspicious_rows(p, QT.checks_table(spark, sf)).select("row_start", "row_end", "n", "n_sources", F.round("strength", 4).alias("strength"))


