"""Operating rules on the planted-defect table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.operators import quality as Q
from trustwatch.operators import rules as R
from trustwatch.plans import q_quality as QQ
from trustwatch.plans import views as V
from trustwatch.plans.registry import query

SPECS = {
    "g1": dict(rule_id="R01", type="range", signal="s01", min=2.0, max=49.0, severity=0.6, status="active"),
    "g2": dict(rule_id="R02", type="rate_of_change", signal="s02", max_delta=60000.0, samples=2, status="active"),
    "g3": dict(rule_id="R03", type="acceleration", signal="s01", max_delta=80.0, status="draft"),
    "g4a": dict(rule_id="R04", type="duration", signal="s01", condition="above", value=30.0, min_samples=5, status="active"),
    "g4b": dict(rule_id="R05", type="duration", signal="s04", condition="between", min=0.02, max=0.05, min_samples=6, status="active"),
    "g4c": dict(rule_id="R06", type="duration", signal="s01", condition="missing", min_samples=20, status="active"),
    "g4d": dict(rule_id="R07", type="duration", signal="s03", condition="constant", min_samples=4, status="active"),
    "g5": dict(rule_id="R08", type="cross_signal", signal="s02", op=">=", value=10000.0, if_signal="s01", if_op=">", if_value=45.0, status="active"),
    "g6": dict(rule_id="R09", type="rolling_stat", signal="s01", stat="mean", window=12, op="<", value=34.0, status="active"),
    "g6b": dict(rule_id="R10", type="rolling_stat", signal="s01", stat="std", window=12, op=">=", value=8.0, status="active"),
    "g7": dict(rule_id="R11", type="missing", signal="s02", samples=5, status="active"),
    "g8": dict(rule_id="R12", type="stuck", signal="s02", samples=20, status="active"),
    "g9": dict(rule_id="R13", type="drift", signal="s05", window=10, max_delta=48.0, status="active"),
}

WITH = "WITH " + V.DIRTY_WIDE + ","


def episodes_sql(rule_id: str, src: str, where: str, value: str, min_len: int = 1) -> str:
    return (f"SELECT '{rule_id}' AS rule_id, grp, CAST(min(row) AS BIGINT) AS row_start, CAST(max(row) AS BIGINT) AS row_end, CAST(count(*) AS BIGINT) AS n, "
            f"round(min({value}), 4) AS value_min, round(max({value}), 4) AS value_max FROM (SELECT *, pos - row_number() OVER (PARTITION BY grp ORDER BY pos) AS isl "
            f"FROM {src} WHERE {where}) GROUP BY grp, isl HAVING count(*) >= {min_len}")


W = "OVER (PARTITION BY grp ORDER BY pos)"
ROLL = "OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
R11 = ROLL.replace("{n}", "11")
R9 = ROLL.replace("{n}", "9")
SQL = {
    "g1": episodes_sql("R01", "dirty_wide", "s01 < 2 OR s01 > 49", "s01"),
    "g2": episodes_sql("R02", f"(SELECT *, lag(s02, 2) {W} AS p FROM dirty_wide)", "abs(s02 - p) > 60000", "s02"),
    "g3": episodes_sql("R03", f"(SELECT *, lag(s01, 1) {W} AS p, lag(s01, 2) {W} AS pp FROM dirty_wide)", "abs(s01 - 2 * p + pp) > 80", "s01"),
    "g4a": episodes_sql("R04", "dirty_wide", "s01 > 30", "s01", 5),
    "g4b": episodes_sql("R05", "dirty_wide", "s04 >= 0.02 AND s04 <= 0.05", "s04", 6),
    "g4c": episodes_sql("R06", "dirty_wide", "s01 IS NULL", "s01", 20),
    "g4d": episodes_sql("R07", f"(SELECT *, lag(s03) {W} AS p, lead(s03) {W} AS f FROM dirty_wide)", "s03 = p OR s03 = f", "s03", 4),
    "g5": episodes_sql("R08", "dirty_wide", "s01 > 45 AND NOT (s02 >= 10000) AND s02 IS NOT NULL", "s02"),
    "g6": episodes_sql("R09", f"(SELECT *, CASE WHEN count(s01) {R11} = 12 THEN avg(s01) {R11} END AS v FROM dirty_wide)", "NOT (v < 34)", "v"),
    "g6b": episodes_sql("R10", f"(SELECT *, CASE WHEN count(s01) {R11} = 12 THEN stddev_samp(s01) {R11} END AS v FROM dirty_wide)", "NOT (v >= 8)", "v"),
    "g7": episodes_sql("R11", "dirty_wide", "s02 IS NULL", "s02", 6),
    "g8": "SELECT 'R12' AS rule_id, grp, CAST(min(row) AS BIGINT) AS row_start, CAST(max(row) AS BIGINT) AS row_end, CAST(count(*) AS BIGINT) AS n, round(min(s02), 4) AS value_min, round(max(s02), 4) AS value_max "
          f"FROM (SELECT *, sum(st) {W} AS rid FROM (SELECT *, CASE WHEN s02 = lag(s02) {W} THEN 0 ELSE 1 END AS st FROM dirty_wide)) WHERE s02 IS NOT NULL GROUP BY grp, rid HAVING count(*) > 20",
    "g9": episodes_sql("R13", f"(SELECT *, CASE WHEN count(s05) {R9} = 10 THEN max(s05) {R9} - min(s05) {R9} END AS v FROM dirty_wide)", "v > 48", "v"),
}
NAMES = {"g1": "g1_range", "g2": "g2_rate_of_change", "g3": "g3_acceleration", "g4a": "g4_duration_above", "g4b": "g4_duration_between", "g4c": "g4_duration_missing", "g4d": "g4_duration_constant",
         "g5": "g5_cross_signal", "g6": "g6_rolling_stat", "g6b": "g6_rolling_std", "g7": "g7_missing", "g8": "g8_stuck", "g9": "g9_drift"}


def _out(e):
    return e.select("rule_id", "grp", "row_start", "row_end", "n", F.round("value_min", 4).alias("value_min"), F.round("value_max", 4).alias("value_max"))


for _k, _name in NAMES.items():
    def _run(spark, sf, _k=_k):
        return _out(R.rule_episodes(V.dirty_wide(spark, sf), [SPECS[_k]]))

    query(_name, WITH[:-1] + " " + SQL[_k])(_run)

DECISIONS = [("R03", 1, "approve"), ("R13", 1, "approve"), ("R13", 2, "retire"), ("R05", 1, "reject")]
ACTIVE = [k for k, s in SPECS.items() if s["rule_id"] not in ("R13", "R05")]


def active_rules(spark):
    rules = R.validate_rules(R.rules_table(spark, SPECS.values()), V.SIGNALS).filter(F.size("errors") == 0)
    dec = spark.createDataFrame(DECISIONS, "rule_id string, decided_at int, decision string")
    return R.set_rule_status(rules, dec)


EPISODES_SQL = WITH + " ep AS (" + " UNION ALL ".join(f"({SQL[k]})" for k in ACTIVE) + ")"


@query("g10_active_rule_episodes", EPISODES_SQL + " SELECT * FROM ep")
def g10(spark, sf):
    """Every approved rule in one pass over the table."""
    return _out(R.rule_episodes(V.dirty_wide(spark, sf), R.active(active_rules(spark))))


@query("g10_rule_checks", EPISODES_SQL + """, b AS (SELECT batch_id, min(row) AS b0, max(row) AS b1 FROM dirty_wide GROUP BY 1),
ids AS (SELECT * FROM (VALUES """ + ", ".join(f"('{SPECS[k]['rule_id']}', {SPECS[k].get('severity') or 0.7})" for k in ACTIVE) + """) AS t(rule_id, sev)),
v AS (SELECT batch_id, rule_id, sum(least(row_end, b1) - greatest(row_start, b0) + 1) AS n, count(*) AS n_episodes, min(greatest(row_start, b0)) AS row_start, max(least(row_end, b1)) AS row_end
      FROM ep JOIN b ON row_start <= b1 AND row_end >= b0 GROUP BY 1, 2)
SELECT 'rule:' || ids.rule_id AS check_type, b.batch_id, CASE WHEN v.n IS NULL THEN 'pass' ELSE 'fail' END AS status, CAST(CASE WHEN v.n IS NULL THEN 0 ELSE sev END AS DOUBLE) AS severity,
       CAST(coalesce(v.n, 0) AS BIGINT) AS n, CAST(coalesce(n_episodes, 0) AS BIGINT) AS n_episodes, CAST(row_start AS BIGINT) AS row_start, CAST(row_end AS BIGINT) AS row_end,
       CAST(""" + QQ.conf("(b1 - b0 + 1)") + """ AS DOUBLE) AS confidence FROM b CROSS JOIN ids LEFT JOIN v ON v.batch_id = b.batch_id AND v.rule_id = ids.rule_id""")
def g10_checks(spark, sf):
    wide = V.dirty_wide(spark, sf)
    rules = R.active(active_rules(spark))
    b = wide.groupBy("batch_id").agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"))
    c = R.rule_checks(R.rule_episodes(wide, rules), rules, b)
    return c.select("check_type", "batch_id", "status", "severity", "n", "n_episodes", "row_start", "row_end", "confidence")


@query("g11_widened_ranges", "WITH " + QQ.STATS + "," + QQ.RANGES + """
SELECT signal, round(CASE WHEN signal = 's01' AND -500 < lo THEN -500.0 ELSE lo END, 4) AS lo, round(CASE WHEN signal = 's02' AND 1e6 > hi THEN 1e6 ELSE hi END, 4) AS hi,
       CASE WHEN signal = 's01' AND -500 < lo THEN 'rule' ELSE 'other' END AS lo_from, CASE WHEN signal = 's02' AND 1e6 > hi THEN 'rule' ELSE 'other' END AS hi_from FROM ranges""")
def g11(spark, sf):
    rules = R.rules_table(spark, [dict(rule_id="W1", type="range", signal="s01", min=-500.0, status="active"), dict(rule_id="W2", type="range", signal="s02", max=1e6, status="approved"),
                                  dict(rule_id="W3", type="range", signal="s03", min=-9e9, status="draft"), dict(rule_id="W4", type="range", signal="s04", max=9e9, grp="1", status="active")])
    r = Q.build_context(V.dirty_wide(spark, sf), V.SIGNALS, rule_limits=R.range_limits(rules)).ranges
    src = lambda c: F.when(F.col(c) == "rule", "rule").otherwise("other")
    return r.select("signal", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), src("lo_source").alias("lo_from"), src("hi_source").alias("hi_from"))
