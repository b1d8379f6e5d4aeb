"""Features, detectors and ensemble on sensor_wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import detect as J
from trustwatch.operators import trajectories as T
from trustwatch.plans import views as V
from trustwatch.plans.q_profile import WL
from trustwatch.plans.q_select import groups
from trustwatch.plans.registry import query

_SPEC: dict[str, J.Spec] = {}


def fitted(spark, sf):
    """The written feature blocks and their spec: windows run once, spec, features and every detector read the written table."""
    key = f"{spark.sparkContext.applicationId}/{sf}"
    new = key not in _SPEC
    if new:
        _SPEC[key] = J.fit_raw(V.sensor_wide(spark, sf), V.SIGNALS, 20)
    b = V.staged(spark, sf, "blocks", lambda s, d: J.raw_blocks(V.sensor_wide(s, d), _SPEC[key]), [])  # every reader scans it whole, none prunes rows
    if new:
        J.fit_blocks(b, _SPEC[key])
    return b, _SPEC[key]


def spec(spark, sf) -> J.Spec:
    return fitted(spark, sf)[1]


def feats(spark, sf):
    """The features that every detector reads."""
    return J.standardised(*fitted(spark, sf))


def sc(name: str, src: str, by: str, val: str = "value", floor: str = "1e-6") -> str:
    return (f"{name}0 AS (SELECT {by}, quantile_cont({val}, 0.5) AS med, avg({val}) AS mean, stddev_pop({val}) AS std FROM {src} WHERE {val} IS NOT NULL GROUP BY {by}), "
            f"{name} AS (SELECT {', '.join('s.' + b.strip() for b in by.split(','))}, any_value(m.med) AS med, any_value(m.mean) AS mean, greatest(1.4826 * quantile_cont(abs(s.{val} - m.med), 0.5), 0.5 * any_value(m.std), quantile_cont(abs(s.{val} - m.med), 0.99) / 5.0, {floor}) AS scale "
            f"FROM {src} s JOIN {name}0 m ON {' AND '.join(f's.{b.strip()} = m.{b.strip()}' for b in by.split(','))} WHERE s.{val} IS NOT NULL GROUP BY {', '.join('s.' + b.strip() for b in by.split(','))})")


FL = WL + ", " + sc("rs", "wl", "signal") + """,
zl AS (SELECT wl.grp, wl.row, wl.pos, wl.signal, least(10.0, greatest(-10.0, coalesce((value - med) / scale, 0.0))) AS z FROM wl JOIN rs USING (signal)),
bw AS (SELECT *, avg(z) OVER r AS rmean, CASE WHEN pos >= 5 THEN ln(coalesce(stddev_pop(z) OVER r, 0) + 0.02) END AS rstd, coalesce(z - lag(z) OVER w, 0) AS d1, coalesce(z - 2 * lag(z) OVER w + lag(z, 2) OVER w, 0) AS d2
       FROM zl WINDOW w AS (PARTITION BY grp, signal ORDER BY pos), r AS (PARTITION BY grp, signal ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
bl AS (SELECT grp, row, pos, block || '__' || signal AS feature, block, value FROM (SELECT grp, row, pos, signal, unnest(['rmean', 'rstd', 'd1', 'd2']) AS block, unnest([rmean, rstd, d1, d2]) AS value FROM bw)),
""" + sc("bs", "bl", "feature, block", floor="1e-3") + """,
fl AS MATERIALIZED (SELECT grp, row, pos, 'value__' || signal AS feature, z AS value FROM zl UNION ALL
  SELECT bl.grp, bl.row, bl.pos, bl.feature, least(10.0, greatest(-10.0, coalesce((value - med) / greatest(scale, CASE WHEN bl.block IN ('d1', 'd2', 'rstd') THEN 0.05 ELSE 0.0 END), 0.0))) FROM bl JOIN bs USING (feature))"""


@query("j1_features", FL + " SELECT row, feature, round(value, 4) AS value FROM fl")
def j1(spark, sf):
    s = spec(spark, sf)
    d = feats(spark, sf)
    return d.select("row", *s.names()).unpivot(["row"], s.names(), "feature", "value").select("row", "feature", F.round("value", 4).alias("value"))


def ext(name: str, src: str, floor: float) -> str:
    return f"{name} AS (SELECT feature, greatest(least(quantile_cont(abs(value), 0.995), greatest(quantile_cont(abs(value), 0.75) + 3 * (quantile_cont(abs(value), 0.75) - quantile_cont(abs(value), 0.25)), quantile_cont(abs(value), 0.9))), 2 * quantile_cont(abs(value), 0.5), {floor}) AS q FROM {src} GROUP BY feature)"


@query("j2_feature_extreme", FL + ", " + ext("ex", "fl", 2.0) + " SELECT feature, round(q, 4) AS extreme FROM ex")
def j2(spark, sf):
    return J.feature_extreme(feats(spark, sf), spec(spark, sf).names(), 2.0).select("feature", F.round("extreme", 4).alias("extreme"))


LIN = FL + ", vr AS (SELECT * FROM fl WHERE feature LIKE 'value%' OR feature LIKE 'rstd%'), " + sc("ls", "vr", "feature", floor="0.25")
RZ = LIN + ", rz AS (SELECT grp, row, pos, feature, (value - med) / scale AS value FROM vr JOIN ls USING (feature)), " + ext("rq", "rz", 2.0) + ", rzs AS (SELECT row, any_value(grp) AS grp, any_value(pos) AS pos, max(abs(value / q)) AS score FROM rz JOIN rq USING (feature) GROUP BY row)"
MZ = LIN + ", mz AS (SELECT grp, row, pos, feature, (value - mean) / scale AS value FROM vr JOIN ls USING (feature))"
EW = MZ + """, ew AS (SELECT grp, row, pos, feature, 0.15::DOUBLE * pow(0.85::DOUBLE, pos) * sum(value * pow(0.85::DOUBLE, -pos)) OVER (PARTITION BY grp, feature ORDER BY pos) / sqrt(0.15 / 1.85) AS value FROM mz), """ + ext("eq", "ew", 1.0)
CU = MZ + """, cc AS (SELECT *, sum(value - 1) OVER w AS cu, sum(-value - 1) OVER w AS cd FROM mz WINDOW w AS (PARTITION BY grp, feature ORDER BY pos)),
cs AS (SELECT grp, row, pos, feature, least(30.0, greatest(cu - least(0, min(cu) OVER w), cd - least(0, min(cd) OVER w))) AS value FROM cc WINDOW w AS (PARTITION BY grp, feature ORDER BY pos)), """ + ext("cq", "cs", 3.0)


def score4(d):
    return d.select("row", F.round("score", 4).alias("score"))


@query("j3_robust_z", RZ + " SELECT row, round(score, 4) AS score FROM rzs")
def j3(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    return score4(J.score_robust_z(f, J.fit_robust_z(f, s), s))


@query("j4_pca")
def j4(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    return score4(J.score_pca(f, J.fit_pca(f, s), s))


@query("j5_ewma", EW + " SELECT row, round(max(abs(value / q)), 4) AS score FROM ew JOIN eq USING (feature) GROUP BY row")
def j5(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    return score4(J.score_ewma(f, J.fit_ewma(f, s), s))


@query("j6_cusum", CU + " SELECT row, round(max(abs(value / q)), 4) AS score FROM cs JOIN cq USING (feature) GROUP BY row")
def j6(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    return score4(J.score_cusum(f, J.fit_cusum(f, s), s))


@query("j7_corr_break")
def j7(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    return score4(J.score_corr_break(f, J.fit_corr_break(f, s), s))


@query("j8_resid_spread")
def j8(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    return score4(J.score_resid_spread(f, J.fit_resid_spread(f, s), s))


@query("j9_isolation_forest")
def j9(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    return score4(J.score_iforest(f, J.grown_forest(f, s), s))


def twin_groups(spark, sf):
    """Every third group is a copy of another one, so that near-duplicates exist."""
    w = V.sensor_wide(spark, sf)
    c = w.filter(F.pmod(F.col("grp").cast("int"), F.lit(3)) == 0).withColumn("grp", F.concat(F.lit("copy"), "grp"))
    return w.unionByName(c)


@query("j10_near_duplicate_groups", "WITH " + V.SENSOR_WIDE + " SELECT DISTINCT 'copy' || grp AS a, grp AS b FROM sensor_wide WHERE CAST(grp AS INT) % 3 = 0 AND 'copy' || grp < grp UNION ALL SELECT DISTINCT grp, 'copy' || grp FROM sensor_wide WHERE CAST(grp AS INT) % 3 = 0 AND NOT 'copy' || grp < grp")
def j10(spark, sf):
    return T.near_duplicate_groups(twin_groups(spark, sf), V.SIGNALS, size="group_rows").select("a", "b")


def duplicates(spark, sf):
    return V.staged(spark, sf, "duplicates", lambda s, d: T.near_duplicate_groups(V.sensor_wide(s, d), V.SIGNALS, size="group_rows"), ["a", "b"])


def folds(spark, sf, k=3):
    return J.group_folds(groups(spark, sf), duplicates(spark, sf), k)


@query("j10_group_folds")
def j10_folds(spark, sf):
    return folds(spark, sf).select("grp", "fold")


@query("j11_train_val_split")
def j11(spark, sf):
    return T.train_val_split(groups(spark, sf), duplicates(spark, sf)).select("grp", "is_val")


THR = """greatest(least(quantile_cont(score, 0.995), greatest(quantile_cont(score, 0.75) + 3 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)), quantile_cont(score, 0.9))) * 1.1, 1.5 * quantile_cont(score, 0.5), 1e-6)"""


@query("j12_robust_threshold", RZ + f" SELECT CAST(count(*) AS BIGINT) AS n, round({THR}, 4) AS threshold FROM rzs")
def j12(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    return S.robust_threshold([], J.score_robust_z(f, J.fit_robust_z(f, s), s), "score").select("n", F.round("threshold", 4).alias("threshold"))


@query("j14_ensemble", "WITH " + RZ[5:] + ", " + EW[len(LIN) + 2:].replace("mz AS", "mz AS", 1) + ", " + CU[len(MZ) + 2:] + """,
d AS (SELECT row, score AS robust_z FROM rzs), e AS (SELECT row, max(abs(value / q)) AS ewma FROM ew JOIN eq USING (feature) GROUP BY row), c AS (SELECT row, max(abs(value / q)) AS cusum FROM cs JOIN cq USING (feature) GROUP BY row),
a AS (SELECT row, least(20, robust_z) AS x, least(20, ewma) AS y, least(20, cusum) AS z FROM d JOIN e USING (row) JOIN c USING (row))
SELECT row, round(0.7 * greatest(x, y, z) + 0.3 * (x + y + z) / 3.0, 4) AS score FROM a""")
def j14(spark, sf):
    s = spec(spark, sf)
    f = feats(spark, sf)
    m = J.Model(s, J.fit_detectors(("robust_z", "ewma", "cusum"), f, s), {})
    return score4(J.score_detectors(f, m))


ALL = tuple(J.DETECTORS)
_FOLDS: dict[str, dict[int, J.Model]] = {}
_MODEL: dict[str, J.Model] = {}


def fold_models(spark, sf, k=2):
    """Out-of-fold models of all detectors, fitted once per application and table."""
    fl = V.staged(spark, sf, "folds", lambda s, d: folds(s, d, k), ["grp"])
    key = f"{spark.sparkContext.applicationId}/{sf}"
    if key not in _FOLDS:
        _FOLDS[key] = J.fit_folds(V.sensor_wide(spark, sf), fl, k, V.SIGNALS, duplicates(spark, sf), detectors=ALL, trim=False)
    return fl, _FOLDS[key]


def final_model(spark, sf) -> J.Model:
    key = f"{spark.sparkContext.applicationId}/{sf}"
    if key not in _MODEL:
        _MODEL[key] = J.fit_final(V.sensor_wide(spark, sf), V.SIGNALS, fold_models(spark, sf)[1], detectors=ALL, trim=False)
    return _MODEL[key]


def score_table(spark, sf):
    """Scores of the dirty table by a model of the clean one, written once, as they come: sampling bounds for an order would score every row twice."""
    return V.staged(spark, sf, "scores", lambda s, d: J.score_rows(V.dirty_wide(s, d), final_model(s, d)), [])


def fold_scores(spark, sf):
    """Every row scored by the model that never saw its group, written once."""
    def build(s, d):
        fl, models = fold_models(s, d)
        return J.score_all(V.sensor_wide(s, d), fl, models)

    return V.staged(spark, sf, "fold_scores", build, [])


@query("j13_fold_thresholds")
def j13(spark, sf):
    _, models = fold_models(spark, sf)
    rows = [(f, n, float(t)) for f, m in models.items() for n, t in m.thresholds.items()]
    return spark.createDataFrame(rows, "fold int, detector string, threshold double")


@query("j15_select_detectors")
def j15(spark, sf):
    _, models = fold_models(spark, sf)
    rows = [(n, float(t)) for m in models.values() for n, t in m.thresholds.items()]
    thr = spark.createDataFrame(rows, "detector string, threshold double")
    return J.select_detectors(thr, fold_scores(spark, sf), list(ALL))


@query("j16_score_all_rows")
def j16(spark, sf):
    return J.top_signals(fold_scores(spark, sf), V.SIGNALS)


@query("j17_score_batch")
def j17(spark, sf):
    return score4(J.score_rows(V.dirty_wide(spark, sf).filter("batch_id = 'B0006'"), final_model(spark, sf)))


@query("j18_rescore_window")
def j18(spark, sf):
    return score4(J.rescore(V.dirty_wide(spark, sf), final_model(spark, sf), 3000, 3600))
