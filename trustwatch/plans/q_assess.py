"""Evaluation and assessor."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.operators import assess as A
from trustwatch.operators.events import centroids
from trustwatch.plans import q_baseline as QB
from trustwatch.plans import q_events as QE
from trustwatch.plans import q_profile as QP
from trustwatch.plans import q_quality as QQ
from trustwatch.plans import q_trust as QT
from trustwatch.plans import views as V
from trustwatch.plans.registry import query

SD = "WITH " + V.SCORED_DOCS


def r4(d, keep, cols):
    return d.select(*keep, *[F.round(c, 4).alias(c) for c in cols])


@query("l1_auroc", SD + """, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM scored_docs)
SELECT CAST(count(*) FILTER (label = '1') AS BIGINT) AS n_positive, CAST(count(*) FILTER (label <> '1') AS BIGINT) AS n_negative,
round((sum(CASE WHEN label = '1' THEN k ELSE 0 END) - count(*) FILTER (label = '1') * (count(*) FILTER (label = '1') + 1) / 2.0) / (count(*) FILTER (label = '1') * count(*) FILTER (label <> '1')), 4)::DOUBLE AS auroc FROM r""")
def l1(spark, sf):
    return r4(A.auroc(V.scored_docs(spark, sf), "score", F.col("label") == "1"), ["n_positive", "n_negative"], ["auroc"])


@query("l2_normal_label", SD + " SELECT label, round(avg(score), 6) AS mean_score, CAST(count(*) AS BIGINT) AS n FROM scored_docs GROUP BY 1 HAVING count(*) >= 100 ORDER BY avg(score), label LIMIT 1")
def l2(spark, sf):
    return A.normal_label(V.scored_docs(spark, sf), "label", "score").select("label", F.round("mean_score", 6).alias("mean_score"), "n")


@query("l3_detection_metrics", QE.W + """, d AS (SELECT sc.grp, sc.pos, score >= 1.6 AS f, s01 > 45 AND sc.pos > 200 AND CAST(sc.grp AS INT) % 2 = 0 AS t FROM sc JOIN sensor_wide w ON w.row = sc.row),
g AS (SELECT grp, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn, min(CASE WHEN t THEN pos END) AS t0, bool_or(t) AS faulty, bool_or(f) AS af FROM d GROUP BY 1),
dl AS (SELECT d.grp, min(pos - t0) AS delay FROM d JOIN g USING (grp) WHERE f AND pos >= t0 GROUP BY 1)
SELECT round(sum(tp) / sum(tp + fp), 4) AS precision, round(sum(tp) / sum(tp + fn), 4) AS recall, CAST(count(*) FILTER (faulty) AS BIGINT) AS n_faulty, CAST(count(delay) AS BIGINT) AS n_detected, CAST(count(*) FILTER (NOT faulty AND af) AS BIGINT) AS n_false_alarms, quantile_cont(delay, 0.5) AS median_delay FROM g LEFT JOIN dl USING (grp)""")
def l3(spark, sf):
    d = QE.simple(spark, sf).join(V.sensor_wide(spark, sf).select("row", "s01"), "row")
    truth = (F.col("s01") > 45) & (F.col("pos") > 200) & (F.pmod(F.col("grp").cast("int"), F.lit(2)) == 0)
    return A.detection_metrics(d, F.col("score") >= 1.6, truth).select(F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), "n_faulty", "n_detected", "n_false_alarms", "median_delay")


@query("l4_calibration", SD + """ SELECT CASE WHEN score < 0.5 THEN '0.00-0.50' WHEN score < 0.7 THEN '0.50-0.70' WHEN score < 0.85 THEN '0.70-0.85' ELSE '0.85-1.00' END AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_confidence, round(avg(CAST(label = '1' AS INT)), 6) AS share_correct FROM scored_docs GROUP BY 1""")
def l4(spark, sf):
    d = A.calibration(V.scored_docs(spark, sf), "score", F.col("label") == "1")
    return d.select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("share_correct", 6).alias("share_correct"))


@query("l5_purity", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT round(sum(m) / sum(s), 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS s FROM c GROUP BY source)")
def l5(spark, sf):
    return A.purity(V.table(spark, sf, "documents"), "source", "lang").select(F.round("purity", 6).alias("purity"))


@query("l5_pattern_agreement")
def l5_ami(spark, sf):
    return A.pattern_agreement(V.table(spark, sf, "documents"), "source", "lang")


def dq_sql(tv: str = "tv") -> str:
    return QT.EXPO + f""", cat AS (SELECT unnest(['completeness', 'validity', 'consistency', 'timeliness']) AS category), w AS (SELECT *, severity * CASE WHEN status = 'fail' THEN 1.0 WHEN status = 'warn' THEN 0.4 ELSE 0 END AS w FROM all_checks),
nb AS (SELECT count(*)::DOUBLE AS nb, avg(trust_score) AS mt FROM {tv}), pen AS (SELECT cat.category, coalesce(sum(CASE WHEN signal <> '' THEN w END), 0) AS s1, coalesce(sum(CASE WHEN signal = '' THEN w END), 0) AS s0, coalesce(bool_and(status = 'not_testable'), false) AS nt FROM cat LEFT JOIN w ON w.category = cat.category GROUP BY 1),
s AS (SELECT category, CASE WHEN nt THEN NULL ELSE round(greatest(0.0, 1 - least(1.0, (s1 / (nb * 5) + 0.5 * s0 / nb) / 0.3)), 4) END AS score FROM pen, nb)
SELECT category, CAST(score AS DOUBLE) AS score FROM s UNION ALL SELECT 'overall', round(0.7 * coalesce(avg(score), 1) + 0.3 * max(mt), 4) FROM s, nb"""


@query("l6_dq_scores", dq_sql())
def l6(spark, sf):
    d = A.dq_scores(QT.checks_table(spark, sf), QT.verdicts(spark, sf), len(V.SIGNALS))
    return d.select("category", F.round("score", 4).alias("score"))


@query("l7_worst_signals", QT.EXPO + """, c AS (SELECT sig AS signal, sum(severity * CASE WHEN status = 'fail' THEN 1.0 ELSE 0.4 END) AS s, count(*) AS n FROM sg1 GROUP BY 1), u AS (SELECT sig AS signal, count(*) AS ub FROM sg WHERE weight IS NOT NULL GROUP BY 1)
SELECT signal, CAST(coalesce(ub, 0) AS BIGINT) AS untrusted_batches, CAST(n AS BIGINT) AS n_checks, round(s, 4) AS severity_sum FROM c LEFT JOIN u USING (signal) ORDER BY coalesce(ub, 0) DESC, s DESC, signal LIMIT 8""")
def l7(spark, sf):
    d = A.worst_signals(QT.checks_table(spark, sf), QT.verdicts(spark, sf))
    return d.select("signal", "untrusted_batches", "n_checks", F.round("severity_sum", 4).alias("severity_sum"))


@query("l8_unit_fingerprints", QP.WL + " SELECT grp, signal, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 4) AS std FROM wl GROUP BY 1, 2")
def l8(spark, sf):
    d = A.unit_fingerprints(V.to_long(V.sensor_wide(spark, sf), ["grp"]), ["grp"])
    return d.select("grp", "signal", "n", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"))


def vectors(spark, sf):
    return A.unit_vectors(V.sensor_wide(spark, sf), V.SIGNALS[:4])


@query("l9_regimes")
def l9(spark, sf):
    return A.regimes(vectors(spark, sf), 4).select("grp", "regime")


@query("l10_project_units", """WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY 1, 2),
d AS (SELECT x.vec_id, c.label AS k, sqrt(sum((x.x - c.c) * (x.x - c.c))) AS d FROM x JOIN c ON c.i = x.i GROUP BY 1, 2), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)
SELECT vec_id, k AS label, round(d, 4) AS distance, d > (SELECT quantile_cont(d, 0.95) FROM b) AS novel FROM b""")
def l10(spark, sf):
    e = V.table(spark, sf, "embeddings")
    d = A.project_units(e, centroids(e, "label", "embedding"), "label", "embedding", "vec_id")
    return d.select("vec_id", "label", F.round("distance", 4).alias("distance"), "novel")


@query("l11_label_balance", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM c) SELECT CAST(max(k) AS BIGINT) AS n_values, round(-sum(p * ln(p)) / ln(max(k)), 6) AS balance FROM p")
def l11(spark, sf):
    return A.label_balance(V.table(spark, sf, "embeddings"), "label").select("n_values", F.round("balance", 6).alias("balance"))


@query("l11_low_information", V.SENSOR_WIDE.join(["WITH ", ""]) + " " + " UNION ALL ".join(f"SELECT '{b}' AS signal, 'redundant with {a}' AS why FROM sensor_wide HAVING abs(corr({a}, {b})) >= 0.98" for a, b in QP.PAIRS))
def l11_low(spark, sf):
    return A.low_information(QQ.dirty_stats(spark, sf), QP.P.corr_matrix(V.sensor_wide(spark, sf), V.SIGNALS))


@query("l12_learning_curve")
def l12(spark, sf):
    return A.learning_curve(QB.z(spark, sf), QB.COLS[:4], (0.2, 0.5, 1.0))


@query("l13_with_without_signal")
def l13(spark, sf):
    return A.compare_without(QB.z(spark, sf), QB.COLS[:4], ["z_s03"])


@query("l14_what_if_drop_signal")
def l14(spark, sf):
    return A.evaluate_action({"type": "drop_signal", "signals": ["s05"]}, QT.checks_table(spark, sf), QT.sizes(spark, sf), len(V.SIGNALS))


@query("l15_assess_new_table")
def l15(spark, sf):
    v = vectors(spark, sf)
    reg = A.regimes(v, 3)
    d = V.dirty_wide(spark, sf)
    return A.assess_new_table(d, v, centroids(reg, "regime", "vector"), V.SIGNALS, A.unit_vectors(d, V.SIGNALS[:4]))


@query("l16_candidate_actions")
def l16(spark, sf):
    low = A.low_information(QQ.dirty_stats(spark, sf), QP.P.corr_matrix(V.sensor_wide(spark, sf), V.SIGNALS))
    return A.candidate_actions(QT.checks_table(spark, sf), QT.verdicts(spark, sf), low)


@query("l17_fit_score_subset")
def l17(spark, sf):
    return A.fit_score_subset(V.sensor_wide(spark, sf), V.SIGNALS[:4], ["1", "2", "3", "4", "5"])
