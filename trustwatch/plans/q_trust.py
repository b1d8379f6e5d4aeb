"""Trust verdicts from the findings of the planted-defect table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.operators import trust as T
from trustwatch.plans import q_quality as QQ
from trustwatch.plans import views as V
from trustwatch.plans.registry import query


def checks_table(spark, sf):
    """The written findings table: every trust operator reads it instead of re-running the checks."""
    return V.staged(spark, sf, "checks", QQ.all_checks, ["batch_id"])


def sizes(spark, sf):
    return V.dirty_wide(spark, sf).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))


def verdicts(spark, sf):
    return T.trust_verdicts(checks_table(spark, sf), sizes(spark, sf), len(V.SIGNALS))


# every finding with its exposure; a frozen block counts its duplicate rows only once
EXPO = QQ.ALL_CTES + """,
ex0 AS (SELECT c.*, s.n_rows, CASE WHEN check_type = 'relation_break' AND signal = 's01+s05' THEN n / s.n_rows WHEN check_type = 'relation_break' THEN 1.0 ELSE coalesce(fraction, 1.0) END AS e
        FROM all_checks c JOIN sizes s USING (batch_id) WHERE status IN ('warn', 'fail')),
ex1 AS (SELECT ex0.*, CASE WHEN check_type = 'frozen_block' THEN greatest(0, n - coalesce((SELECT sum(also) FROM fb_dup d WHERE d.batch_id = ex0.batch_id AND d.members = ex0.signal), 0)) / n_rows END AS rf FROM ex0),
ex AS (SELECT *, least(1.0, greatest(0.0, e)) AS expo, severity * (0.15 + 0.85 * least(1.0, greatest(0.0, e))) AS eff,
              check_type IN ('duplicate_rows', 'duplicate_key', 'frozen_block', 'missing_block', 'empty_rows') AS record,
              check_type IN ('gap', 'out_of_order', 'duplicate_timestamp', 'irregular_sampling') AS batchlevel FROM ex1),
ex2 AS (SELECT *, record AND (check_type NOT IN ('duplicate_rows', 'duplicate_key') OR expo >= 0.02) AS scoped, CASE WHEN record THEN CASE WHEN rf IS NULL THEN expo ELSE least(expo, greatest(0, rf)) END ELSE 0 END AS own FROM ex),
fb_mem AS (SELECT b.batch_id, b.members, r.signal, sum(r.row_end - r.row_start + 1) AS rows FROM blocks b JOIN runs r ON r.batch_id = b.batch_id AND r.row_start <= b1 AND r.row_end >= b0
           WHERE (r.stuck_m OR r.sat_m) AND least(r.row_end, b1) - greatest(r.row_start, b0) + 1 >= 0.5 * (r.row_end - r.row_start + 1) GROUP BY 1, 2, 3),
sg0 AS (SELECT *, unnest(string_split(signal, '+')) AS sig FROM ex2 WHERE signal <> ''),
sg1 AS (SELECT s.*, coalesce(CASE WHEN check_type = 'frozen_block' THEN least(1.0, m.rows / n_rows) END, expo) AS sshare FROM sg0 s LEFT JOIN fb_mem m ON m.batch_id = s.batch_id AND m.members = s.signal AND m.signal = s.sig),
sg AS (SELECT batch_id, sig, max(CASE WHEN scoped AND sshare >= 0.25 THEN severity * (0.5 + 0.5 * sshare)
                                      WHEN NOT record AND status = 'fail' AND (expo >= 0.25 OR eff >= 0.35) THEN greatest(eff, severity * (0.5 + 0.5 * expo)) END) AS weight,
              bool_or(NOT record AND NOT (status = 'fail' AND (expo >= 0.25 OR eff >= 0.35))) AS warned FROM sg1 GROUP BY 1, 2),
sgb AS (SELECT batch_id, sum(coalesce(weight, 0)) AS s, count(weight) AS n_untrusted, count(*) FILTER (weight IS NULL AND warned) AS n_warned, string_agg(CASE WHEN weight IS NOT NULL THEN sig END, '+' ORDER BY -weight, sig) AS sigs FROM sg GROUP BY 1),
bt AS (SELECT batch_id, least(1.0, sum(own)) AS record_share, least(1.0, sum(CASE WHEN scoped THEN own ELSE 0 END)) AS row_scoped, max(CASE WHEN batchlevel AND status = 'fail' THEN severity ELSE 0 END) AS batch_sev,
              count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'warn') AS n_warn FROM ex2 GROUP BY 1),
tv0 AS (SELECT batch_id, n_rows, coalesce(record_share, 0) AS record_share, coalesce(row_scoped, 0) AS row_scoped, coalesce(n_untrusted, 0) AS n_untrusted, coalesce(sigs, '') AS sigs, coalesce(n_fail, 0) AS n_fail, coalesce(n_warn, 0) AS n_warn,
               greatest(0.0, least(1.0, 1 - 0.7 * least(1.0, coalesce(s, 0) / 5 / 0.3) - 0.5 * least(1.0, coalesce(record_share, 0) / 0.1) - 0.3 * least(1.0, coalesce(batch_sev, 0)) - least(0.1, 0.1 * coalesce(n_warned, 0) / 5))) AS sc
        FROM sizes LEFT JOIN bt USING (batch_id) LEFT JOIN sgb USING (batch_id)),
tv AS (SELECT *, CASE WHEN record_share >= 0.1 AND sc >= 0.5 THEN 0.45 ELSE sc END AS trust_score, record_share < 0.1 AND sc >= 0.5 AS trusted FROM tv0)"""


@query("h1_exposure", EXPO + " SELECT check_type, batch_id, signal, round(expo, 6) AS exposure, round(eff, 6) AS effective_severity FROM ex")
def h1(spark, sf):
    d = T.exposure(checks_table(spark, sf))
    return d.select("check_type", "batch_id", F.array_join("signals", "+").alias("signal"), F.round("expo", 6).alias("exposure"), F.round("effective_severity", 6).alias("effective_severity"))


@query("h2_trust_verdicts", EXPO + """ SELECT batch_id, CAST(n_rows AS BIGINT) AS n_rows, trusted, round(trust_score, 4) AS trust_score, round(record_share, 6) AS record_share, sigs AS untrusted_signals,
CAST(n_fail AS BIGINT) AS n_fail, CAST(n_warn AS BIGINT) AS n_warn FROM tv""")
def h2(spark, sf):
    return verdicts(spark, sf).select("batch_id", "n_rows", "trusted", F.round("trust_score", 4).alias("trust_score"), F.round("record_share", 6).alias("record_share"),
                                      F.array_join("untrusted_signals", "+").alias("untrusted_signals"), F.col("n_fail").cast("long").alias("n_fail"), F.col("n_warn").cast("long").alias("n_warn"))


@query("h3_untrusted_signals", EXPO + " SELECT batch_id, sig AS signal, round(weight, 4) AS weight FROM sg WHERE weight IS NOT NULL")
def h3_signals(spark, sf):
    s, _, _ = T.untrusted(checks_table(spark, sf), sizes(spark, sf))
    return s.select("batch_id", "signal", F.round("weight", 4).alias("weight"))


@query("h3_untrusted_rows", EXPO + """ SELECT batch_id, check_type, CAST(row_start AS BIGINT) AS row_start, CAST(row_end AS BIGINT) AS row_end FROM (
  SELECT batch_id, 'empty_rows' AS check_type, row_start, row_end FROM er_isl UNION ALL SELECT batch_id, 'missing_block', row_start, row_end FROM mb_isl
  UNION ALL SELECT batch_id, 'frozen_block', b0, b1 FROM blocks UNION ALL SELECT batch_id, 'duplicate_rows', row_start, row_end FROM du_isl)
  WHERE (batch_id, check_type) IN (SELECT (batch_id, check_type) FROM ex2 WHERE scoped)""")
def h3_rows(spark, sf):
    _, _, rows = T.untrusted(checks_table(spark, sf), sizes(spark, sf))
    return rows.select("batch_id", "check_type", "row_start", "row_end")


@query("h3_local_untrusted")
def h3_local(spark, sf):
    _, local, _ = T.untrusted(checks_table(spark, sf), sizes(spark, sf))
    return local


@query("h4_signal_trust", EXPO + " SELECT sig AS signal, CAST(count(*) AS BIGINT) AS n_untrusted, round(count(*) / (SELECT count(*) FROM sizes), 4) AS fraction FROM sg WHERE weight IS NOT NULL GROUP BY 1")
def h4(spark, sf):
    return T.signal_trust(verdicts(spark, sf)).select("signal", "n_untrusted", F.round("fraction", 4).alias("fraction"))


@query("h5_problem_weights", EXPO + " SELECT check_type AS problem, round(sum(severity * greatest(coalesce(rf, fraction, 0.01), 1e-6)), 6) AS weight FROM ex2 WHERE status = 'fail' GROUP BY 1")
def h5_weights(spark, sf):
    return T.problem_weights(checks_table(spark, sf)).select("problem", F.round("weight", 6).alias("weight"))


@query("h5_run_verdict", EXPO + """,
tot2 AS (SELECT count(*) AS n_batches, count(*) FILTER (NOT trusted) AS n_untrusted, sum(CASE WHEN trusted THEN 0 ELSE n_rows END) / sum(n_rows) AS bad,
                sum(CASE WHEN trusted THEN row_scoped * n_rows ELSE 0 END) / sum(n_rows) AS scoped, sum(n_fail) AS n_fail, sum(n_warn) AS n_warn FROM tv)
SELECT CASE WHEN n_untrusted > 0 AND bad >= 0.5 THEN 'untrusted' WHEN n_untrusted > 0 THEN 'partly_untrusted' WHEN n_fail > 0 OR scoped > 0 THEN 'usable_with_problems' ELSE 'clean' END AS verdict,
       CAST(n_batches AS BIGINT) AS n_batches, CAST(n_untrusted AS BIGINT) AS n_untrusted, round(bad, 6) AS untrusted_row_share, round(scoped, 6) AS row_scoped_share, CAST(n_fail AS BIGINT) AS n_fail, CAST(n_warn AS BIGINT) AS n_warn FROM tot2""")
def h5(spark, sf):
    c, s = checks_table(spark, sf), sizes(spark, sf)
    _, local, _ = T.untrusted(c, s)
    v = T.run_verdict(T.trust_verdicts(c, s, len(V.SIGNALS)), local)
    big = lambda x: F.col(x).cast("long").alias(x)
    return v.select("verdict", big("n_batches"), big("n_untrusted"), F.round("untrusted_row_share", 6).alias("untrusted_row_share"), F.round("row_scoped_share", 6).alias("row_scoped_share"), big("n_fail"), big("n_warn"))


@query("n8_trust_series", EXPO + """ SELECT CAST(bucket AS INT) AS bucket, min(batch_id) AS first_batch, round(min(trust_score), 4) AS min_score, bool_and(trusted) AS all_trusted
FROM (SELECT *, ntile(4) OVER (ORDER BY batch_id) AS bucket FROM tv) GROUP BY bucket""")
def n8(spark, sf):
    return T.trust_series(verdicts(spark, sf), 4).select(F.col("bucket").cast("int").alias("bucket"), "first_batch", F.round("min_score", 4).alias("min_score"), "all_trusted")
