"""All detectors from one pass along the groups give what each gives alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustwatch.operators import detect

SIG = ["s01", "s02", "s03"]
ALONE = dict(detect.DETECTORS)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(11)
    parts, row = [], 0
    for g, n in enumerate((1500, 300, 7, 800)):  # chunks of 600 rows: groups of one, two and three
        x = rng.normal(size=n).cumsum() * 0.3 + rng.normal(size=n)
        parts.append(pd.DataFrame({"grp": f"g{g}", "row": row + np.arange(n), "pos": np.arange(n), "s01": x + (np.arange(n) > 700) * 3, "s02": np.r_[np.zeros(min(n, 3)), x[:-3]] + rng.normal(size=n), "s03": rng.normal(size=n)}))
        row += n
    wide = spark.createDataFrame(pd.concat(parts)).withColumn("s03", F.when(F.col("row") % 97 != 0, F.col("s03")))
    spec = detect.fit_features(wide, SIG)
    feats = detect.features(wide, spec).repartition(4).cache()
    return feats, spec, detect.fit_detectors(tuple(ALONE), feats, spec)


def test_fits_equal_those_of_each_detector(fitted):
    feats, spec, fits = fitted
    for n in ("robust_z", "ewma", "cusum", "corr_break"):
        one = ALONE[n][0](feats, spec)
        assert fits[n].q == pytest.approx(one.q), n
    assert fits["corr_break"].qe == pytest.approx(one.qe)
    spread = ALONE["resid_spread"][0](feats, spec)
    assert fits["resid_spread"].center == pytest.approx(spread.center) and fits["resid_spread"].scale == pytest.approx(spread.scale)
    pca = ALONE["pca"][0](feats, spec)
    assert fits["pca"].t2_ref == pytest.approx(pca.t2_ref) and fits["pca"].spe_ref == pytest.approx(pca.spe_ref)


def test_scores_equal_those_of_each_detector(fitted, monkeypatch):
    feats, spec, fits = fitted
    m = detect.Model(spec, fits, {})
    monkeypatch.setattr(detect, "running", lambda d, f, s, run=detect.running: run(d, f, s, 600))
    got = detect.raw_scores(feats, m).toPandas().sort_values("row")
    assert len(got) == feats.count()
    for n, (_, score) in ALONE.items():
        one = score(feats, fits[n], spec).toPandas().sort_values("row")
        assert got[n].to_numpy() == pytest.approx(one.score.to_numpy(), rel=1e-9, abs=1e-9), n
        total = np.maximum(sum(one[f"c_{s}"] for s in SIG), 1e-9)
        for s in SIG:
            assert got[f"{n}_{s}"].to_numpy() == pytest.approx((one[f"c_{s}"] / total).to_numpy(), rel=1e-6, abs=1e-6), (n, s)


def test_scores_need_one_shuffle_of_the_rows(fitted):
    feats, spec, fits = fitted
    plan = detect.raw_scores(feats, detect.Model(spec, fits, {}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2  # with the sums of earlier chunks, and inside these


def test_a_final_model_takes_no_thresholds_of_its_own(spark, fitted, monkeypatch):
    feats, _, _ = fitted
    wide = feats.select("grp", "row", "pos", *[F.col(f"value__{s}").alias(s) for s in SIG])
    monkeypatch.setattr(detect, "_fence", lambda *a: pytest.fail("rows were scored for thresholds that are thrown away"))
    m = detect.fit_final(wide, SIG, {i: detect.Model(None, {}, {"robust_z": float(t)}, float(t)) for i, t in enumerate((1, 2, 6))}, detectors=("robust_z",), trim=False)
    assert m.thresholds == {"robust_z": 2.0} and m.ensemble == 2.0


def test_first_hashed_rows_do_not_depend_on_the_bound(spark):
    d = spark.range(30_000).select(F.col("id").alias("row")).repartition(8)
    key = F.xxhash64("row", F.lit(3))
    assert [r.row for r in detect.first_hashed(d, key, 200).collect()] == [r.row for r in d.orderBy(key, "row").limit(200).collect()]
    assert "Filter" in detect.first_hashed(d, key, 200)._jdf.queryExecution().optimizedPlan().toString()
    assert detect.first_hashed(d.withColumn("k", F.lit(1 << 62)), F.col("k"), 200).count() == 200  # no hash: all rows take part
