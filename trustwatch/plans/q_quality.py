"""Data-quality checks on the planted-defect table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import quality as Q
from trustwatch.plans import views as V
from trustwatch.plans.registry import query


# ------------------------------------------------------------------ SQL building blocks
def conf(n: str, ratio: str | None = None) -> str:
    size = f"(greatest(CAST({n} AS DOUBLE), 0) / (greatest(CAST({n} AS DOUBLE), 0) + 30))"
    m = "0.97" if ratio is None else f"greatest(0.02, 0.5 + 0.5 * tanh(1.5 * ln(greatest({ratio}, 1e-6))))"
    return f"round(least(0.99, greatest(0.01, {size} * {m})), 2)"


def isl(name: str, src: str, keys: str, where: str = "true", aggs: str = "") -> str:
    return (f"{name} AS (SELECT {keys}, min(row) AS row_start, max(row) AS row_end, min(pos) AS pos_start, max(pos) AS pos_end, count(*) AS n {', ' + aggs if aggs else ''} "
            f"FROM (SELECT *, pos - row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS isl FROM {src} WHERE {where}) GROUP BY {keys}, isl)")


def out(check_type: str, batch: str, signal: str, status: str, severity: str, rs: str, re_: str, n: str, fraction: str, confidence: str, src: str) -> str:
    return (f"SELECT {check_type} AS check_type, {batch} AS batch_id, {signal} AS signal, {status} AS status, CAST({severity} AS DOUBLE) AS severity, "
            f"CAST({rs} AS BIGINT) AS row_start, CAST({re_} AS BIGINT) AS row_end, CAST({n} AS BIGINT) AS n, CAST({fraction} AS DOUBLE) AS fraction, "
            f"CAST({confidence} AS DOUBLE) AS confidence FROM {src}")


FINAL = ("SELECT check_type, batch_id, signal, status, round(severity, 4) AS severity, row_start, row_end, n, round(fraction, 6) AS fraction, confidence FROM ")

STATS = V.DIRTY_WIDE + """,
sizes AS (SELECT batch_id, count(*) AS n_rows FROM dirty_wide GROUP BY batch_id),
st0 AS (SELECT signal, count(*) AS n_rows, count(value) AS n, min(value) AS mn, max(value) AS mx, avg(value) AS mean, stddev_samp(value) AS std,
               quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
               quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.99) AS q99 FROM dirty_long GROUP BY signal),
st1 AS (SELECT signal, quantile_cont(abs(value - median), 0.5) AS mad FROM dirty_long JOIN st0 USING (signal) GROUP BY signal),
st2 AS (SELECT st0.*, mad, greatest(CASE WHEN q75 > q25 THEN (q75 - q25) / 1.349 END, CASE WHEN q99 > q01 THEN (q99 - q01) / 4.65 END) AS spread FROM st0 JOIN st1 USING (signal)),
stats AS (SELECT *, CASE WHEN mad > 0 THEN greatest(1.4826 * mad, 0.25 * coalesce(spread, 0)) WHEN spread IS NOT NULL THEN spread WHEN std > 0 THEN std ELSE 0 END AS scale FROM st2),
nulls AS (SELECT *, (s01 IS NULL)::INT + (s02 IS NULL)::INT + (s03 IS NULL)::INT + (s04 IS NULL)::INT + (s05 IS NULL)::INT AS n_null FROM dirty_wide),
kmiss AS (SELECT greatest(2, CAST(ceil(e + 4 * sqrt(e) + 1) AS INT)) AS k FROM (
          SELECT coalesce(sum(r), 0) AS e FROM (SELECT 1 - n::DOUBLE / n_rows AS r FROM stats) WHERE r > 0 AND r < 1))"""

CHECKS: dict[str, str] = {}

CHECKS["missing"] = """
miss_long AS (SELECT l.*, z.n_null < k.k AS own FROM dirty_long l JOIN nulls z USING (row), kmiss k WHERE l.value IS NULL),
""" + isl("miss_isl", "miss_long", "batch_id, grp, signal", "own") + """,
miss_own AS (SELECT batch_id, signal, sum(n) AS n, max(n) AS longest, min(row_start) AS row_start, max(row_end) AS row_end FROM miss_isl GROUP BY 1, 2),
miss_t AS (SELECT a.batch_id, a.signal, a.n_all, coalesce(o.n, 0) AS n, o.row_start, o.row_end, s.n_rows, coalesce(o.n, 0) / s.n_rows AS rate
           FROM (SELECT batch_id, signal, count(*) AS n_all FROM miss_long GROUP BY 1, 2) a LEFT JOIN miss_own o USING (batch_id, signal) JOIN sizes s USING (batch_id)),
c_missing AS (""" + out("CASE WHEN n_all = n_rows AND rate >= 0.2 THEN 'dropout' ELSE 'missing' END", "batch_id", "signal",
                       "CASE WHEN rate >= 0.2 THEN 'fail' ELSE 'warn' END",
                       "CASE WHEN n_all = n_rows AND rate >= 0.2 THEN 1.0 WHEN rate >= 0.2 THEN greatest(0.15, least(1.0, 0.8 * rate / 0.2)) ELSE greatest(0.15, least(0.5, 0.5 * rate / 0.2)) END",
                       "row_start", "row_end", "n", "rate", f"CASE WHEN n_all = n_rows AND rate >= 0.2 THEN {conf('n_rows')} ELSE {conf('n_rows', 'rate / 0.02')} END",
                       "miss_t WHERE rate >= 0.02") + ")"

CHECKS["empty_rows"] = isl("er_isl", "nulls", "batch_id, grp", "n_null = 5") + """,
er_t AS (SELECT batch_id, sum(n) AS n, min(row_start) AS row_start, max(row_end) AS row_end, max(n_rows) AS n_rows FROM er_isl JOIN sizes USING (batch_id) GROUP BY 1),
c_empty_rows AS (""" + out("'empty_rows'", "batch_id", "''", "CASE WHEN n / n_rows >= 0.01 THEN 'fail' ELSE 'warn' END", "CASE WHEN n / n_rows >= 0.01 THEN 0.6 ELSE 0.3 END",
                          "row_start", "row_end", "n", "n / n_rows", conf("n_rows"), "er_t") + ")"

CHECKS["missing_block"] = isl("mb_isl", "nulls", "batch_id, grp", "n_null >= (SELECT k FROM kmiss) AND n_null < 5", "sum(n_null) AS cells") + """,
mb_t AS (SELECT batch_id, sum(n) AS n, sum(cells) AS cells, min(row_start) AS row_start, max(row_end) AS row_end, max(n_rows) AS n_rows FROM mb_isl JOIN sizes USING (batch_id) GROUP BY 1),
mb_core AS (SELECT z.batch_id, string_agg(signal, '+' ORDER BY signal) AS sig FROM (
              SELECT l.batch_id, l.signal, count(*) AS r FROM dirty_long l JOIN nulls z USING (row), kmiss k WHERE l.value IS NULL AND z.n_null >= k.k AND z.n_null < 5 GROUP BY 1, 2) z
            JOIN mb_t t ON t.batch_id = z.batch_id WHERE r >= 0.5 * t.n GROUP BY 1),
c_missing_block AS (""" + out("'missing_block'", "batch_id", "sig", "CASE WHEN n / n_rows >= 0.02 THEN 'fail' ELSE 'warn' END", "0.4 + 0.6 * least(1.0, n / n_rows / 0.1)",
                             "row_start", "row_end", "n", "n / n_rows", conf("n * round(cells / n)", "round(cells / n) / (SELECT k FROM kmiss)"), "mb_t JOIN mb_core USING (batch_id)") + ")"

CHECKS["impossible"] = isl("imp_isl", "dirty_long", "batch_id, grp, signal", "abs(value) > {absurd}") + """,
c_impossible AS (""" + out("'impossible_value'", "batch_id", "signal", "'fail'", "0.9", "min(row_start)", "max(row_end)", "sum(n)", "sum(n) / max(n_rows)", conf("max(n_rows)"),
                          "imp_isl JOIN sizes USING (batch_id) GROUP BY batch_id, signal") + ")"

WINDOWS = """
win AS (SELECT batch_id, grp, signal, pos // 25 AS win, quantile_cont(value, 0.5) AS wmed, count(value) AS valid, count(DISTINCT value) AS dist, min(row) AS row_start, max(row) AS row_end, max(median) AS median
        FROM dirty_long JOIN stats USING (signal) WHERE scale > 0 AND abs(median) > 3 * scale GROUP BY 1, 2, 3, 4 HAVING count(*) = 25),
shift AS (SELECT *, CAST(round(lg) AS INT) AS k FROM (SELECT *, CASE WHEN wmed / median <> 0 THEN log10(abs(wmed / median)) END AS lg FROM win) WHERE abs(round(lg)) >= 1 AND abs(lg - round(lg)) < 0.2)"""

RANGES = WINDOWS + """,
rng0 AS (SELECT *, CASE WHEN q99 > q01 THEN q99 - q01 ELSE 4.65 * scale END AS span FROM stats),
rng1 AS (SELECT *, q01 >= -1 AND q99 <= 101 AND q99 - q01 >= 10 AND (q01 <= 0.5 OR q99 >= 99.5) AS pct FROM rng0 WHERE span > 0),
ranges AS (SELECT signal, q01, q99, span, median, scale,
                  CASE WHEN pct AND -1 > q01 - 3 * span THEN -1.0 WHEN NOT pct AND q01 >= 0 AND -0.01 * span > q01 - 3 * span THEN -0.01 * span ELSE q01 - 3 * span END AS lo,
                  CASE WHEN pct AND 101 < q99 + 3 * span THEN 101.0 ELSE q99 + 3 * span END AS hi,
                  CASE WHEN pct THEN 'percentage' WHEN q01 >= 0 AND -0.01 * span > q01 - 3 * span THEN 'non_negative' END AS hint FROM rng1),
flags AS (SELECT l.*, abs(value - r.median) / r.scale AS z, value < lo AS below, value > hi AS above, lo, hi, span,
                 EXISTS (SELECT 1 FROM shift s WHERE s.batch_id = l.batch_id AND s.grp = l.grp AND s.signal = l.signal AND s.win = l.pos // 25) AS shifted
          FROM dirty_long l JOIN ranges r USING (signal) WHERE value IS NOT NULL AND abs(value) <= 1e30)"""

CHECKS["plausibility"] = isl("pl_isl", "flags", "batch_id, grp, signal", "below OR above", "bool_or(shifted) AS shifted, max(CASE WHEN below THEN lo - value ELSE value - hi END) AS excess, max(span) AS span") + """,
pl_t AS (SELECT batch_id, signal, sum(n) AS n, min(row_start) AS row_start, max(row_end) AS row_end, max(n_rows) AS n_rows, max(excess) AS excess, max(span) AS span
         FROM pl_isl JOIN sizes USING (batch_id) WHERE NOT shifted GROUP BY 1, 2),
c_plausibility AS (""" + out("'plausibility'", "batch_id", "signal", "CASE WHEN n >= 3 OR n / n_rows >= 0.001 OR excess / span >= 1 THEN 'fail' ELSE 'warn' END",
                            "least(1.0, 0.45 + 0.35 * least(1.0, n / n_rows / 0.02) + 0.2 * least(1.0, excess / span))", "row_start", "row_end", "n", "n / n_rows",
                            conf("n_rows", "1 + excess / (0.1 * span)"), "pl_t") + ")"

CHECKS["out_of_range"] = isl("oor_isl", "flags", "batch_id, grp, signal", "z > 6 AND (NOT (below OR above) OR shifted)", "bool_or(shifted) AS shifted, max(z) AS max_z") + """,
oor_t AS (SELECT batch_id, signal, sum(n) AS n, min(row_start) AS row_start, max(row_end) AS row_end, max(n_rows) AS n_rows, max(max_z) AS max_z FROM oor_isl JOIN sizes USING (batch_id) WHERE NOT shifted GROUP BY 1, 2),
c_out_of_range AS (""" + out("'out_of_range'", "batch_id", "signal", "CASE WHEN n / n_rows >= 0.01 OR max_z / 6 >= 5 THEN 'fail' ELSE 'warn' END",
                            "0.4 + 0.4 * least(1.0, n / n_rows / 0.05) + 0.2 * least(1.0, (max_z / 6 - 1) / 10)", "row_start", "row_end", "n", "n / n_rows", conf("n_rows", "max_z / 6"), "oor_t") + ")"

CHECKS["local_spike"] = """
sp0 AS (SELECT l.batch_id, l.grp, l.row, l.pos, l.signal, l.value, s.scale, coalesce(l.value, s.median) AS f, count(*) OVER (PARTITION BY l.grp, l.signal) AS glen FROM dirty_long l JOIN stats s USING (signal)),
sp1 AS (SELECT *, f - quantile_cont(f, 0.5) OVER (PARTITION BY grp, signal ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS r FROM sp0),
sp2 AS (SELECT *, abs(r) AS a, avg(abs(r)) OVER (PARTITION BY batch_id, signal) AS gavg,
               sum(abs(r)) OVER w51 AS s51, count(*) OVER w51 AS c51, lag(abs(r)) OVER w1 AS lft, lead(abs(r)) OVER w1 AS rgt
        FROM sp1 WINDOW w1 AS (PARTITION BY grp, signal ORDER BY pos), w51 AS (PARTITION BY grp, signal ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)),
sp3 AS (SELECT *, a / greatest(1.2533 * (s51 - a) / greatest(1, c51 - 1), 0.5 * 1.2533 * gavg, 0.15 * scale / 10, 1e-12) AS z FROM sp2),
sp_gr AS (SELECT grp, count(*) AS group_rows FROM sensor_wide GROUP BY grp),
""" + isl("sp_isl", "sp3", "batch_id, grp, signal", "z > 10 AND value IS NOT NULL AND scale > 0", "max(a) AS peak, max(z) AS max_z, min_by(coalesce(lft, 0), pos) AS lft, max_by(coalesce(rgt, 0), pos) AS rgt") + """,
sp_c AS (SELECT *, count(*) OVER (PARTITION BY batch_id, grp, signal ORDER BY pos_start RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) - 1 AS near FROM sp_isl),
sp_t AS (SELECT batch_id, signal, sum(n) AS n, min(row_start) AS row_start, max(row_end) AS row_end, max(max_z) AS max_z, max(n_rows) AS n_rows
         FROM sp_c JOIN sizes USING (batch_id) JOIN sp_gr USING (grp)
         WHERE n <= 2 AND near < 2 AND pos_start >= 4 AND pos_end <= group_rows - 4 AND greatest(lft, rgt) < 0.4 * peak GROUP BY 1, 2),
c_local_spike AS (""" + out("'local_spike'", "batch_id", "signal", "CASE WHEN n >= 10 THEN 'fail' ELSE 'warn' END", "least(0.7, 0.25 + 0.03 * n + 0.01 * least(20.0, max_z))",
                           "row_start", "row_end", "n", "n / n_rows", conf("n_rows", "max_z / 10"), "sp_t") + ")"

CHECKS["unit_shift"] = """
us_r AS (SELECT batch_id, grp, signal, min(row_start) AS row_start, max(row_end) AS row_end, 25 * count(*) AS n, min(k) AS k
         FROM (SELECT *, win - row_number() OVER (PARTITION BY batch_id, grp, signal ORDER BY win) AS isl FROM shift) GROUP BY batch_id, grp, signal, isl),
c_unit_shift AS (""" + out("'unit_shift'", "batch_id", "signal", "'fail'", "0.9", "min(row_start)", "max(row_end)", "sum(n)", "sum(n) / max(n_rows)",
                          conf("max(n_rows)", "1 + 0.5 * count(*)"), "us_r JOIN sizes USING (batch_id) GROUP BY batch_id, signal") + ")"

RUNS = """
vr0 AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY grp, batch_id, signal ORDER BY pos) THEN 0 ELSE 1 END AS st FROM dirty_long),
vr1 AS (SELECT *, sum(st) OVER (PARTITION BY grp, batch_id, signal ORDER BY pos) AS rid FROM vr0),
runs0 AS (SELECT grp, batch_id, signal, min(row) AS row_start, max(row) AS row_end, count(*) AS n, min(value) AS value FROM vr1 WHERE value IS NOT NULL GROUP BY grp, batch_id, signal, rid HAVING count(*) >= {min_keep}),
runs1 AS (SELECT r.*, abs(value - mn) <= 1e-9 * greatest(1, abs(mn), abs(mx)) AS at_min, abs(value - mx) <= 1e-9 * greatest(1, abs(mn), abs(mx)) AS at_max FROM runs0 r JOIN stats USING (signal)),
runs AS (SELECT *, at_min OR at_max AS sat, NOT (at_min OR at_max) AND n >= 30 AS stuck_m, (at_min OR at_max) AND n >= 30 AS sat_m FROM runs1),
cover AS (SELECT w.batch_id, w.grp, w.row, w.row AS pos FROM dirty_wide w JOIN runs r ON r.batch_id = w.batch_id AND r.grp = w.grp AND w.row BETWEEN r.row_start AND r.row_end
          WHERE r.stuck_m OR r.sat_m GROUP BY 1, 2, 3 HAVING count(*) >= 2),
""" + isl("blk0", "cover", "batch_id, grp") + """,
blk AS (SELECT batch_id, grp, row_start AS b0, row_end AS b1, n AS bn FROM blk0 WHERE n >= 15),
blk_ov AS (SELECT b.*, r.signal, sum(least(r.row_end, b1) - greatest(r.row_start, b0) + 1) AS ov, sum(r.row_end - r.row_start + 1) AS own
           FROM blk b JOIN runs r ON r.batch_id = b.batch_id AND r.grp = b.grp AND r.row_start <= b1 AND r.row_end >= b0 WHERE r.stuck_m OR r.sat_m GROUP BY ALL),
blocks AS (SELECT batch_id, grp, b0, b1, bn, string_agg(signal, '+' ORDER BY signal) AS members, count(*) AS nm FROM blk_ov WHERE ov >= 0.5 * bn OR ov >= 0.5 * own GROUP BY ALL HAVING count(*) >= 2),
left_runs AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.batch_id = r.batch_id AND b.grp = r.grp AND r.row_start <= b1 AND r.row_end >= b0
              AND least(r.row_end, b1) - greatest(r.row_start, b0) + 1 >= 0.5 * (r.row_end - r.row_start + 1)))"""

CHECKS["stuck"] = """
sk_t AS (SELECT batch_id, signal, sum(n) AS n, max(n) AS longest, min(row_start) AS row_start, max(row_end) AS row_end, max(n_rows) AS n_rows FROM left_runs JOIN sizes USING (batch_id) WHERE stuck_m GROUP BY 1, 2),
c_stuck AS (""" + out("'stuck'", "batch_id", "signal", "CASE WHEN n / n_rows >= 0.02 OR (longest >= 300 AND n / n_rows >= 0.005) THEN 'fail' ELSE 'warn' END",
                     "least(1.0, 0.15 + 0.45 * least(1.0, n / n_rows / 0.5) + 0.4 * least(1.0, longest / 300.0))", "row_start", "row_end", "n", "n / n_rows", conf("n_rows", "longest / 30.0"), "sk_t") + ")"

CHECKS["saturation"] = """
sa_t AS (SELECT batch_id, signal, sum(n) AS n, max(n) AS longest, arg_max(row_start, n * 1000000000 - row_start) AS l_start, max(n_rows) AS n_rows FROM left_runs JOIN sizes USING (batch_id) WHERE sat_m GROUP BY 1, 2),
c_saturation AS (""" + out("'saturation'", "batch_id", "signal", "CASE WHEN longest >= 90 THEN 'fail' ELSE 'warn' END", "CASE WHEN longest >= 90 THEN 0.7 ELSE 0.35 END",
                          "l_start", "l_start + longest - 1", "n", "n / n_rows", conf("n_rows", "longest / 30.0"), "sa_t") + ")"

DUPS = """
dups AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, s01, s02, s03, s04, s05, {tcol} ORDER BY row) AS rn FROM dirty_wide) WHERE rn > 1)"""

CHECKS["duplicate_rows"] = isl("du_isl", "dups", "batch_id, grp") + """,
du_t AS (SELECT batch_id, sum(n) AS n, min(row_start) AS row_start, max(row_end) AS row_end, max(n_rows) AS n_rows FROM du_isl JOIN sizes USING (batch_id) GROUP BY 1),
c_duplicate_rows AS (""" + out("'duplicate_rows'", "batch_id", "''", "CASE WHEN n / n_rows >= 0.01 THEN 'fail' ELSE 'warn' END", "least(1.0, 0.3 + 20 * n / n_rows)", "row_start", "row_end", "n", "n / n_rows",
                              conf("n_rows"), "du_t") + ")"

CHECKS["frozen_block"] = """
fb_dup AS (SELECT b.batch_id, b.members, count(*) AS also FROM blocks b JOIN dups d ON d.batch_id = b.batch_id AND d.row BETWEEN b0 AND b1 GROUP BY 1, 2),
fb_t AS (SELECT batch_id, members, sum(bn) AS n, max(bn) AS longest, min(b0) AS row_start, max(b1) AS row_end, quantile_cont(nm, 0.5) AS per_block, max(nm) AS nm, max(n_rows) AS n_rows FROM blocks JOIN sizes USING (batch_id) GROUP BY 1, 2),
c_frozen_block AS (""" + out("'frozen_block'", "batch_id", "members", "CASE WHEN n / n_rows >= 0.005 OR longest >= 300 THEN 'fail' ELSE 'warn' END",
                            "0.5 + 0.5 * least(1.0, n / n_rows / 0.1)", "row_start", "row_end", "n", "n / n_rows", conf("n * nm", "per_block / 2"), "fb_t") + ")"

CHECKS["duplicate_key"] = """
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, grp, {tcol} ORDER BY row) AS rn FROM dirty_wide) WHERE rn > 1),
""" + isl("dk_isl", "dk", "batch_id, grp") + """,
dk_t AS (SELECT batch_id, sum(n) AS n, min(row_start) AS row_start, max(row_end) AS row_end, max(n_rows) AS n_rows FROM dk_isl JOIN sizes USING (batch_id) GROUP BY 1),
c_duplicate_key AS (""" + out("'duplicate_key'", "batch_id", "''", "CASE WHEN n / n_rows < 0.01 THEN 'warn' ELSE 'fail' END", "least(1.0, 0.3 + 10 * n / n_rows)", "row_start", "row_end", "n", "n / n_rows",
                             conf("n_rows"), "dk_t") + ")"

TIME = """
tdiff AS (SELECT batch_id, grp, row, pos, lag(row) OVER w AS prev_row, (epoch_us({tcol}) - epoch_us(lag({tcol}) OVER w)) / 1e6 AS step FROM dirty_wide WINDOW w AS (PARTITION BY grp, batch_id ORDER BY pos)),
tsteps AS (SELECT * FROM tdiff WHERE step IS NOT NULL),
per AS (SELECT quantile_cont(step, 0.5) AS period FROM tsteps WHERE step > 0),
tn AS (SELECT batch_id, count(*) AS n_steps, count(*) FILTER (abs(step - period) > 0.2 * period AND step <= 3 * period AND step > 0) AS n_odd FROM tsteps, per GROUP BY 1)"""

CHECKS["gap"] = """
c_gap AS (""" + out("'gap'", "batch_id", "''", "CASE WHEN max(step) / max(period) >= 20 THEN 'fail' ELSE 'warn' END", "CASE WHEN max(step) / max(period) >= 20 THEN 0.7 ELSE 0.4 END",
                   "min(prev_row)", "max(row)", "count(*)", "NULL", conf("max(n_steps)", "max(step) / max(period) / 3"), "tsteps JOIN tn USING (batch_id), per WHERE step > 3 * period GROUP BY batch_id") + ")"

CHECKS["out_of_order"] = isl("oo_isl", "tsteps", "batch_id, grp", "step < 0") + """,
c_out_of_order AS (""" + out("'out_of_order'", "batch_id", "''", "'fail'", "0.6", "min(row_start)", "max(row_end)", "sum(n)", "sum(n) / max(n_steps)", conf("max(n_steps)"), "oo_isl JOIN tn USING (batch_id) GROUP BY batch_id") + ")"

CHECKS["duplicate_timestamp"] = isl("dt_isl", "tsteps", "batch_id, grp", "step = 0") + """,
c_duplicate_timestamp AS (""" + out("'duplicate_timestamp'", "batch_id", "''", "CASE WHEN sum(n) / max(n_steps) >= 0.05 THEN 'fail' ELSE 'warn' END", "CASE WHEN sum(n) / max(n_steps) >= 0.05 THEN 0.6 ELSE 0.3 END",
                                   "min(row_start)", "max(row_end)", "sum(n)", "sum(n) / max(n_steps)", conf("max(n_steps)"), "dt_isl JOIN tn USING (batch_id) GROUP BY batch_id") + ")"

CHECKS["irregular_sampling"] = "c_irregular_sampling AS (" + out("'irregular_sampling'", "batch_id", "''", "'warn'", "0.3", "NULL", "NULL", "n_odd", "n_odd / n_steps", conf("n_steps", "n_odd / n_steps / 0.05"),
                                                                "tn WHERE n_odd / n_steps >= 0.05") + ")"

CHECKS["timeliness_not_testable"] = "c_timeliness_not_testable AS (" + out("'timeliness_not_testable'", "batch_id", "''", "'not_testable'", "0.0", "NULL", "NULL", "NULL", "NULL", "0.0",
                                                                          "(SELECT batch_id FROM dirty_wide GROUP BY batch_id HAVING count({tcol}) < 2)") + ")"

CHECKS["relation_pairs"] = "c_relation_pairs AS (" + out("'relation_break'", "batch_id", "'s01+s05'", "CASE WHEN abs(r) < 0.7 THEN 'fail' ELSE 'warn' END", "CASE WHEN abs(r) < 0.7 THEN 0.7 ELSE 0.5 END", "NULL", "NULL", "m", "NULL",
                                                        conf("m", "0.9 / greatest(abs(r), 0.05)"),
                                                        "(SELECT batch_id, corr(s01, s05) AS r, count(*) AS m FROM dirty_wide WHERE s01 IS NOT NULL AND s05 IS NOT NULL GROUP BY 1) WHERE m >= 10 AND abs(r) < 0.9") + ")"

CHECKS["relation_derived"] = "c_relation_derived AS (" + out("'relation_break'", "batch_id", "'s05'", "CASE WHEN rms >= scale THEN 'fail' ELSE 'warn' END", "CASE WHEN rms >= scale THEN 0.7 ELSE 0.5 END", "NULL", "NULL", "m", "NULL",
                                                            conf("m", "rms / (0.5 * scale)"),
                                                            "(SELECT batch_id, sqrt(avg((s05 - (1000 + s01)) * (s05 - (1000 + s01)))) AS rms, count(s05 - s01) AS m FROM dirty_wide GROUP BY 1), (SELECT scale FROM stats WHERE signal = 's05') WHERE m >= 10 AND scale > 0 AND rms > 0.5 * scale") + ")"

NEEDS = {"plausibility": [RANGES], "out_of_range": [RANGES], "unit_shift": [WINDOWS], "stuck": [RUNS], "saturation": [RUNS], "frozen_block": [RUNS, DUPS],
         "duplicate_rows": [DUPS], "gap": [TIME], "out_of_order": [TIME], "duplicate_timestamp": [TIME], "irregular_sampling": [TIME]}


def checks_ctes(*names: str, tcol: str = "ts_reg", absurd: str = "1e30", min_keep: int = 10) -> str:
    parts: list[str] = []
    for n in names:
        for need in NEEDS.get(n, []):
            if need == WINDOWS and RANGES in parts:
                continue
            if need not in parts:
                parts.append(need)
        parts.append(CHECKS[n])
    if RANGES in parts and WINDOWS in parts:
        parts.remove(WINDOWS)
    body = ",".join([STATS, *parts])
    return "WITH " + body.replace("{tcol}", tcol).replace("{absurd}", absurd).replace("{min_keep}", str(min_keep))


def check_sql(name: str, **kw) -> str:
    return checks_ctes(name, **kw) + " " + FINAL + "c_" + name


# ------------------------------------------------------------------ queries
def dirty_stats(spark, sf):
    """Statistics of the table: a written artifact, as every check needs them."""
    return V.staged(spark, sf, "dirty_stats", lambda sp, d: Q.table_stats(V.dirty_wide(sp, d), V.SIGNALS), ["signal"])


def context(spark, sf, time="ts_reg", **kw) -> Q.Context:
    return Q.build_context(V.dirty_wide(spark, sf), V.SIGNALS, time=time, stats=dirty_stats(spark, sf), **kw)


@query("f1_missing", check_sql("missing"))
def f1(spark, sf):
    return Q.report(Q.check_missing(context(spark, sf)))


def _dropped(spark, sf):
    """s04 lost for the whole fourth batch and s03 for most of the fifth."""
    d = V.dirty_wide(spark, sf)
    null = F.lit(None).cast("double")
    d = d.withColumn("s04", F.when(F.col("batch_id") != "B0004", F.col("s04")).otherwise(null))
    return d.withColumn("s03", F.when((F.col("batch_id") != "B0005") | (F.col("pos") % 4 == 0), F.col("s03")).otherwise(null))


@query("f2_dropout", (checks_ctes("missing") + " " + FINAL + "c_missing").replace("dirty_wide AS (SELECT dirty1.*,", """dirty1b AS (
  SELECT grp, row, pos, ts, ts_reg, s01, s02, CASE WHEN 1 + least(9, row * 10 // n) <> 5 OR pos % 4 = 0 THEN s03 END AS s03,
         CASE WHEN 1 + least(9, row * 10 // n) <> 4 THEN s04 END AS s04, s05 FROM dirty1, tot),
dirty_wide AS (SELECT dirty1.*,""").replace("FROM dirty1, tot),\ndirty_long", "FROM dirty1b dirty1, tot),\ndirty_long"))
def f2(spark, sf):
    return Q.report(Q.check_missing(Q.build_context(_dropped(spark, sf), V.SIGNALS)))


@query("f3_empty_rows", check_sql("empty_rows"))
def f3(spark, sf):
    return Q.report(Q.check_empty_rows(context(spark, sf)))


@query("f4_missing_block", check_sql("missing_block").replace("WHEN row >= n * 12 // 100 AND row < n * 124 // 1000 THEN NULL\n              WHEN grp = g_common AND pos BETWEEN 200 AND 239 THEN 25.0 ELSE s01",
                                                              "WHEN row >= n * 12 // 100 AND row < n * 124 // 1000 THEN NULL\n              WHEN grp = g_common AND pos BETWEEN 200 AND 239 THEN 25.0 ELSE s01")
       .replace("ELSE s03 END AS s03,", "WHEN row >= n * 12 // 100 AND row < n * 124 // 1000 THEN NULL ELSE s03 END AS s03,"))
def f4(spark, sf):
    d = V.dirty_wide(spark, sf)
    d = d.withColumn("s03", F.when(F.col("s01").isNotNull(), F.col("s03")))
    return Q.report(Q.check_missing_block(Q.build_context(d, V.SIGNALS)))


@query("f5_impossible_value", check_sql("impossible", absurd="5e7"))
def f5(spark, sf):
    return Q.report(Q.check_impossible(context(spark, sf, limits=Q.Limits(absurd=5e7))))


@query("f6_plausibility", check_sql("plausibility"))
def f6(spark, sf):
    return Q.report(Q.check_plausibility(context(spark, sf)))


@query("f6_plausible_ranges", "WITH " + STATS + "," + RANGES + " SELECT signal, round(lo, 4) AS lo, round(hi, 4) AS hi, round(span, 4) AS span, hint FROM ranges")
def f6_ranges(spark, sf):
    r = context(spark, sf, time=None).ranges
    return r.select("signal", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round("span", 4).alias("span"), "hint")


@query("f7_out_of_range", check_sql("out_of_range").replace("z > 6 AND", "z > 1.2 AND").replace("max_z / 6", "max_z / 1.2"))
def f7(spark, sf):
    return Q.report(Q.check_out_of_range(context(spark, sf, limits=Q.Limits(range_sigma=1.2))))


@query("f8_local_spike", check_sql("local_spike"))
def f8(spark, sf):
    return Q.report(Q.check_local_spike(context(spark, sf)))


@query("f9_unit_shift", check_sql("unit_shift"))
def f9(spark, sf):
    return Q.report(Q.check_unit_shift(context(spark, sf)))


QUANT_SQL = (checks_ctes("unit_shift", "stuck") + """,
qw AS (SELECT *, dist / valid AS uniq FROM win WHERE valid >= 12),
qref AS (SELECT batch_id, signal, quantile_cont(uniq, 0.5) AS ref FROM qw GROUP BY 1, 2 HAVING count(*) >= 4 AND quantile_cont(uniq, 0.5) >= 0.6),
qhit AS (SELECT qw.*, uniq / ref AS ratio FROM qw JOIN qref USING (batch_id, signal) WHERE uniq < 0.5 * ref AND dist >= 2),
qrun AS (SELECT batch_id, grp, signal, min(row_start) AS row_start, max(row_end) AS row_end, 25 * count(*) AS n, min(ratio) AS ratio
         FROM (SELECT *, win - row_number() OVER (PARTITION BY batch_id, grp, signal ORDER BY win) AS isl FROM qhit) GROUP BY batch_id, grp, signal, isl),
qcand AS (SELECT * FROM qrun q WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE (r.stuck_m OR r.sat_m) AND r.batch_id = q.batch_id AND r.grp = q.grp AND r.signal = q.signal AND r.row_start <= q.row_end AND r.row_end >= q.row_start)),
qt AS (SELECT batch_id, signal, sum(n) AS n, min(row_start) AS row_start, max(row_end) AS row_end, min(ratio) AS ratio, max(n_rows) AS n_rows FROM qcand JOIN sizes USING (batch_id)
       WHERE (batch_id, signal) NOT IN (SELECT (batch_id, signal) FROM shift) GROUP BY 1, 2),
c_q AS (""" + out("'quantization_change'", "batch_id", "signal", "'warn'", "0.3", "row_start", "row_end", "n", "n / n_rows", conf("n_rows", "0.5 / greatest(ratio, 1e-6)"), "qt") + ") " + FINAL + "c_q").replace(
    "WHEN grp = g_shift AND pos BETWEEN 100 AND 199 THEN s05 * 1000 ELSE s05 END AS s05",
    "WHEN grp = g_shift AND pos BETWEEN 100 AND 199 THEN s05 * 1000 WHEN grp = (SELECT grp FROM sensor_wide WHERE row = (SELECT n FROM tot) * 82 // 100) AND pos BETWEEN 300 AND 399 THEN 1000 + 25 * floor((s05 - 1000) / 25) ELSE s05 END AS s05")


@query("f10_quantization_change", QUANT_SQL)
def f10(spark, sf):
    d = V.dirty_wide(spark, sf)
    mark = V.table(spark, sf, "lineitem").count() * 82 // 100
    coarse = (F.col("group_start") <= mark) & (mark < F.col("group_start") + F.col("group_rows")) & F.col("pos").between(300, 399)
    d = d.withColumn("s05", F.when(coarse, 1000 + 25 * F.floor((F.col("s05") - 1000) / 25)).otherwise(F.col("s05")))
    change, _ = Q.check_quantization(Q.build_context(d, V.SIGNALS))
    return Q.report(change)


@query("f11_stuck", check_sql("stuck"))
def f11(spark, sf):
    return Q.report(Q.check_runs(context(spark, sf, time=None))["stuck"])


@query("f12_saturation", check_sql("saturation").replace("n >= 30 AS sat_m", "n >= 10 AS sat_m").replace("n >= 30 AS stuck_m", "n >= 10 AS stuck_m").replace("longest >= 90", "longest >= 30")
       .replace("longest / 30.0", "longest / 10.0").replace("WHERE n >= 15", "WHERE n >= 5").replace(
           "dirty_wide AS (SELECT dirty1.*,", "dirty_x AS (SELECT grp, row, pos, ts, ts_reg, s01, s02, CASE WHEN pos BETWEEN 50 AND 89 AND row < n // 4 AND s03 IS NOT NULL THEN 0.1 ELSE s03 END AS s03, s04, s05 FROM dirty1, tot),\ndirty_wide AS (SELECT dirty1.*,")
       .replace("FROM dirty1, tot),\ndirty_long", "FROM dirty_x dirty1, tot),\ndirty_long").replace("HAVING count(*) >= 10", "HAVING count(*) >= 3"))
def f12(spark, sf):
    d = V.dirty_wide(spark, sf)
    n = V.table(spark, sf, "lineitem").count()
    clip = F.col("pos").between(50, 89) & (F.col("row") < n // 4) & F.col("s03").isNotNull()
    d = d.withColumn("s03", F.when(clip, 0.1).otherwise(F.col("s03")))
    return Q.report(Q.check_runs(Q.build_context(d, V.SIGNALS, limits=Q.Limits(stuck_min_run=10)))["saturation"])


STALE_SQL = checks_ctes("stuck", min_keep=4) + """,
sl_t AS (SELECT batch_id, signal, sum(n) AS n, max(n) AS longest, arg_max(row_start, n * 1000000000 - row_start) AS l_start, max(n_rows) AS n_rows
         FROM left_runs JOIN sizes USING (batch_id) WHERE signal = 's03' AND NOT sat AND n > 4 AND (batch_id, signal) NOT IN (SELECT (batch_id, signal) FROM sk_t) GROUP BY 1, 2),
c_stale AS (""" + out("'stale'", "batch_id", "signal", "'warn'", "0.4", "l_start", "l_start + longest - 1", "n", "n / n_rows", conf("n_rows", "longest / 4.0"), "sl_t") + ") " + FINAL + "c_stale"


@query("f13_stale", STALE_SQL)
def f13(spark, sf):
    return Q.report(Q.check_runs(context(spark, sf, time=None, roles={"s03": "held_sampled"}, holds={"s03": 2}))["stale"])


@query("f14_frozen_block", checks_ctes("frozen_block", tcol="ts") + " " + FINAL + "c_frozen_block")
def f14(spark, sf):
    return Q.report(Q.check_frozen_block(context(spark, sf, time="ts")))


@query("f14_common_blocks", checks_ctes("frozen_block", tcol="ts") + " SELECT batch_id, grp, CAST(b0 AS BIGINT) AS row_start, CAST(b1 AS BIGINT) AS row_end, CAST(bn AS BIGINT) AS n, members FROM blocks")
def f14_blocks(spark, sf):
    b = Q.frozen_blocks(context(spark, sf, time=None))
    return b.select("batch_id", "grp", "row_start", "row_end", "n", F.array_join("members", "+").alias("members"))


@query("f15_duplicate_rows", check_sql("duplicate_rows", tcol="ts"))
def f15(spark, sf):
    return Q.report(Q.check_duplicate_rows(context(spark, sf, time="ts")))


@query("f16_duplicate_key", check_sql("duplicate_key", tcol="ts_reg"))
def f16(spark, sf):
    return Q.report(Q.check_duplicate_key(context(spark, sf), "ts_reg"))


for _id, _name in (("f17_gap", "gap"), ("f18_out_of_order", "out_of_order"), ("f19_duplicate_timestamp", "duplicate_timestamp"), ("f20_irregular_sampling", "irregular_sampling")):
    for _t in ("ts_reg", "ts"):
        def _time_check(spark, sf, _name=_name, _t=_t):
            return Q.report(Q.check_time(context(spark, sf, time=_t))[_name])

        query(_id if _t == "ts_reg" else f"{_id}_ts", check_sql(_name, tcol=_t))(_time_check)


@query("f21_timeliness_not_testable", check_sql("timeliness_not_testable", tcol="CASE WHEN batch_id <> 'B0004' THEN ts_reg END"))
def f21(spark, sf):
    d = V.dirty_wide(spark, sf)
    d = d.withColumn("ts_reg", F.when(F.col("batch_id") != "B0004", F.col("ts_reg")))
    return Q.report(Q.check_timeliness_testable(Q.build_context(d, V.SIGNALS, time="ts_reg")))


PAIRS = [("s01", "s05", 1.0)]
FORMULAS = [("s05", {"s01": 1.0}, 1000.0)]


@query("f22_relation_pairs", check_sql("relation_pairs"))
def f22(spark, sf):
    return Q.report(Q.check_relation_pairs(context(spark, sf, time=None), PAIRS))


@query("f23_relation_derived", check_sql("relation_derived"))
def f23(spark, sf):
    return Q.report(Q.check_relation_derived(context(spark, sf, time=None), FORMULAS))


RUN_NAMES = ["missing", "empty_rows", "missing_block", "impossible", "plausibility", "out_of_range", "local_spike", "unit_shift", "stuck", "saturation", "frozen_block",
             "duplicate_rows", "gap", "out_of_order", "duplicate_timestamp", "irregular_sampling", "timeliness_not_testable", "relation_pairs", "relation_derived"]
CATEGORY = {"missing": "completeness", "dropout": "completeness", "empty_rows": "completeness", "missing_block": "completeness", "gap": "timeliness", "out_of_order": "timeliness",
            "duplicate_timestamp": "timeliness", "irregular_sampling": "timeliness", "timeliness_not_testable": "timeliness", "stuck": "consistency", "saturation": "consistency",
            "frozen_block": "consistency", "duplicate_rows": "consistency", "relation_break": "consistency"}
ALL_CTES = checks_ctes(*RUN_NAMES) + ",\nall_checks0 AS (" + " UNION ALL ".join(f"SELECT * FROM c_{n}" for n in RUN_NAMES) + "),\nall_checks AS (SELECT *, CASE " + " ".join(
    f"WHEN check_type = '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " ELSE 'validity' END AS category FROM all_checks0)"


def all_checks(spark, sf, passes: bool = False):
    return Q.run_checks(context(spark, sf), PAIRS, FORMULAS, passes=passes)


@query("f24_category_passes", ALL_CTES + " SELECT category || '_ok' AS check_type, batch_id, 'pass' AS status, CAST(" + conf("n_rows * 5") + """ AS DOUBLE) AS confidence
FROM sizes, (VALUES ('completeness'), ('validity'), ('consistency'), ('timeliness')) AS c(category) WHERE (batch_id, category) NOT IN (SELECT (batch_id, category) FROM all_checks)""")
def f24(spark, sf):
    d = all_checks(spark, sf, passes=True).filter("status = 'pass'")
    return d.select("check_type", "batch_id", "status", "confidence")


@query("f25_check_batch", ALL_CTES + " " + FINAL + "all_checks WHERE batch_id = 'B0006'")
def f25(spark, sf):
    """Everything found in one arriving batch, judged with statistics of the whole table."""
    return Q.report(all_checks(spark, sf).filter(F.col("batch_id") == "B0006"))
