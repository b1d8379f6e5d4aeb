"""The out-of-fold protocol with all detectors on planted faults, and rows scored again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustwatch.operators import detect, trajectories

SIG = ["s01", "s02", "s03"]


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(9):
        x = np.zeros(260)
        for i in range(1, 260):
            x[i] = 0.9 * x[i - 1] + rng.normal()
        for i in range(260):
            a, b = 50 + x[i] + rng.normal() * 0.2, 20 + 0.7 * x[i] + rng.normal() * 0.2
            rows.append((f"g{g}", g * 260 + i, i, float(a + (9 if g == 8 and i >= 160 else 0)), float(b), float(rng.normal())))
    return spark.createDataFrame(rows, "grp string, row long, pos long, s01 double, s02 double, s03 double").repartition(4).cache()


def test_trimming_and_calibration(runs):
    """A stretch of faulty rows among the fitted ones sets the scale of normal unless it is trimmed."""
    odd = runs.withColumn("s01", F.when((F.col("grp") == "g0") & F.col("pos").between(100, 129), F.col("s01") + 40).otherwise(F.col("s01")))
    loose, tight = (detect.fit_model(odd, SIG, ("pca",), mask=F.col("grp") != "g8", trim=t) for t in (False, True))
    assert tight.fitted["pca"].t2_ref < loose.fitted["pca"].t2_ref or tight.fitted["pca"].spe_ref < loose.fitted["pca"].spe_ref
    other = detect.fit_model(odd, SIG, ("pca",), mask=F.col("grp") != "g8", calibration=F.col("grp") == "g3", trim=False)
    assert other.fitted["pca"].t2_ref == pytest.approx(loose.fitted["pca"].t2_ref) and other.thresholds != loose.thresholds


def test_protocol(spark, runs):
    groups = runs.groupBy("grp").agg(F.count("*").alias("n_rows"))
    dup = trajectories.near_duplicate_groups(runs, SIG)
    folds = detect.group_folds(groups, dup, 2).cache()
    models = detect.fit_folds(runs, folds, 2, SIG, dup, detectors=tuple(detect.DETECTORS), trim=False)
    assert all(set(m.thresholds) == set(detect.DETECTORS) and len(m.thresholds) == 7 and all(t > 0 for t in m.thresholds.values()) for m in models.values())
    s = detect.score_all(runs, folds, models).toPandas()
    assert len(s) == 9 * 260 and s.row.is_unique
    where = {r.grp: r.fold for r in folds.collect()}
    assert all(where[g] == f for g, f in zip(s.grp, s.fold))
    clean, sick = s[s.grp != "g8"], s[(s.grp == "g8") & (s.pos >= 165)]
    assert (clean.score >= 1).mean() < 0.12 and (sick.score >= 1).mean() > 0.8 and sick.share_s01.mean() > 0.4
    sel = {r.detector: r.selected for r in detect.select_detectors(spark.createDataFrame([(n, float(t)) for m in models.values() for n, t in m.thresholds.items()], "detector string, threshold double"), spark.createDataFrame(s), list(detect.DETECTORS)).collect()}
    assert set(sel) == set(detect.DETECTORS) and any(sel.values())


def test_rescore_equals_a_full_score(runs):
    m = detect.fit_model(runs, SIG, ("robust_z", "ewma", "cusum"), mask=F.col("grp") != "g8", trim=False)
    full = {r.row: r.score for r in detect.score_rows(runs, m).filter("row BETWEEN 500 AND 560").collect()}
    again = {r.row: r.score for r in detect.rescore(runs, m, 500, 560).collect()}
    assert set(full) == set(again) and all(again[i] == pytest.approx(full[i], abs=1e-9) for i in full)


def test_dilation_stays_in_its_group(runs):
    d = detect.dilated(runs, F.col("row").isin(0, 259, 700), 3, "near").filter("near")
    assert sorted(r.row for r in d.collect()) == [0, 1, 2, 3, 256, 257, 258, 259, *range(697, 704)]


def test_shared_fits_equal_single_ones(runs, monkeypatch):
    """Scales and regressions found once for several detectors give each the fit it finds alone."""
    spec = detect.fit_features(runs, SIG)
    feats = detect.features(runs, spec).cache()
    calls = []
    ridge = detect._ridge
    monkeypatch.setattr(detect, "_ridge", lambda *a: calls.append(a) or ridge(*a))
    got = detect.fit_detectors(("robust_z", "cusum", "corr_break", "resid_spread"), feats, spec)
    assert len(calls) == 1
    for name in ("robust_z", "cusum"):
        one = detect.DETECTORS[name][0](feats, spec)
        for x, y in ((got[name].center, one.center), (got[name].scale, one.scale), (got[name].q, one.q)):
            assert x == pytest.approx(y)
    assert got["resid_spread"].ridge.coef == got["corr_break"].coef and not got["resid_spread"].ridge.q
