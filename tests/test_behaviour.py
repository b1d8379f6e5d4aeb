"""Planted truth on small frames, and operators that have no SQL twin."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustwatch.operators import audit, detect, graph, lags, monitor, profile, quality, rules
from trustwatch.plans import views as V


@pytest.fixture(scope="module")
def plant(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(6):
        u = rng.normal(size=300).cumsum() * 0.3
        for i in range(300):
            a, b = 50 + u[i] + rng.normal() * 0.2, 20 + (u[i - 2] if i >= 2 else 0) + rng.normal() * 0.1
            rows.append((str(g), g * 300 + i, i, float(a), float(b), float(a + b)))
    pdf = pd.DataFrame(rows, columns=["grp", "row", "pos", "s01", "s02", "s03"])
    pdf.loc[(pdf.grp == "5") & (pdf.pos >= 200), "s01"] += 15
    return spark.createDataFrame(pdf).cache()


def test_relations_and_redundancy(plant):
    e = lags.lagged_xcorr(plant, [("s01", "s02")], 5).first()
    assert (e["a"], e["b"], e["lag"]) == ("s01", "s02", 2)
    red = {r["signal"]: set(r["partners"]) for r in profile.redundant_signals(plant, ["s01", "s02", "s03"]).collect()}
    assert red["s03"] == {"s01", "s02"}


def test_ensemble_flags_the_shift(plant):
    m = detect.fit_model(plant, ["s01", "s02", "s03"], ("robust_z", "ewma", "pca", "corr_break"), mask=F.col("grp") != "5")
    s = detect.score_rows(plant, m).toPandas()
    hot = s[(s.grp == "5") & (s.pos >= 210)].score.mean()
    assert hot > 1.0 and s[(s.grp != "5")].score.median() < 0.8
    f = detect.grown_forest(detect.features(plant, m.spec), m.spec)
    sc = detect.score_iforest(detect.features(plant, m.spec), f, m.spec).toPandas()
    assert sc[(sc.grp == "5") & (sc.pos >= 205)].score.mean() > sc[sc.grp != "5"].score.mean()


def test_planted_defects(spark, sf="/root/testdata/sf0.01"):
    checks = quality.run_checks(quality.build_context(V.dirty_wide(spark, sf), V.SIGNALS, time="ts_reg"), [("s01", "s05", 1.0)], [("s05", {"s01": 1.0}, 1000.0)]).toPandas()
    n = V.table(spark, sf, "lineitem").count()
    got = {(c.check_type, "+".join(c.signals)): c for c in checks.itertuples()}
    assert got["missing", "s01"].status == "warn" and got["missing", "s01"].row_start == n * 12 // 100
    assert got["empty_rows", ""].n == 10
    assert got["plausibility", "s02"].row_start == n * 33 // 100
    assert got["stuck", "s02"].n == 81
    assert got["frozen_block", "s01+s02+s05"].n == 40
    assert got["unit_shift", "s05"].values["k"] == 3
    assert got["duplicate_rows", ""].n == 5
    assert ("stuck", "s01") not in got and ("out_of_range", "s02") not in got


def test_rules_validation(spark):
    bad = rules.rules_table(spark, [dict(rule_id="A", type="range", signal="s01"), dict(rule_id="B", type="nope", signal="s01"), dict(rule_id="C", type="drift", signal="s09", window=1, max_delta=-1.0), dict(rule_id="D", type="stuck", signal="s01", samples=3)])
    err = {r["rule_id"]: r["errors"] for r in rules.validate_rules(bad, ["s01"]).collect()}
    assert err["A"] and err["B"] and len(err["C"]) == 3 and not err["D"]


def test_hash_chain(spark):
    d = spark.createDataFrame([("x", i, f"e{i}") for i in range(25)] + [("y", i, "z") for i in range(3)], "log string, seq long, body string")
    c = audit.append_chain(d, "log", "seq", ["log", "seq", "body"], 10).cache()
    assert audit.verify_chain(c, "log", "seq", ["log", "seq", "body"], 10).count() == 0
    t = c.withColumn("body", F.when((F.col("log") == "x") & (F.col("seq") == 13), "changed").otherwise(F.col("body")))
    assert audit.verify_chain(t, "log", "seq", ["log", "seq", "body"], 10).first()["first_bad_seq"] == 13


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(9, 10)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert [got[i] for i in range(12)] == [0] * 9 + [9, 9, 11]


def test_hysteresis(spark):
    cases = [("quiet", 0.4, 1, 2, True, "imminent"), ("quiet", 0.7, 2, 2, False, "occurring"), ("occurring", 0.5, 1, 2, False, "occurring"), ("occurring", 0.1, 0, 0, False, "quiet")]
    d = spark.createDataFrame(cases, "before string, score double, matched int, moving int, rising boolean, after string")
    d = d.withColumn("map", monitor.status_map(F.col("score"), F.col("matched"), F.col("moving"), F.lit(2), F.col("rising"), F.col("score")))
    for r in d.collect():
        assert monitor.STATUS[r.map[monitor.STATUS.index(r.before)]] == r.after


def test_sealed_segments_show_what_was_removed(spark):
    rows = spark.range(100).selectExpr("'a' AS log", "id AS seq", "CAST(id AS STRING) AS body")
    chain = audit.append_chain(rows, "log", "seq", ["seq", "body"], 10)
    heads = audit.seal_segments(chain, "log", "seq", 10)
    root = audit.seal_root(heads, "log", 4).collect()
    assert len(root) == 1 and root == audit.seal_root(heads, "log", 4).collect()
    assert root != audit.seal_root(heads.filter("segment <> 9"), "log", 4).collect()
    cut = chain.filter("seq NOT BETWEEN 30 AND 39 AND seq <> 55")
    found = {(r.segment, r.problem) for r in audit.verify_segments(cut, heads, "log", "seq", 10).collect()}
    assert found == {(3, "missing"), (5, "changed")}
    assert audit.verify_segments(chain, heads, "log", "seq", 10).isEmpty()
