"""Live monitor on the event stream: one sensor per event type, one cycle per day."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from trustwatch.operators import monitor as M
from trustwatch.operators import ordered
from trustwatch.operators import schema as C
from trustwatch.plans import q_quality as QQ
from trustwatch.plans import views as V
from trustwatch.plans.registry import query
from trustwatch.plans.q_schema import EV, kinds_sql
from trustwatch.session import checkpoint_dir
from trustwatch.streaming import monitor as SM
from trustwatch.streaming import watch as SW

LEARN = 4
DAY = 86400


def build_stream(spark, sf):
    e = V.sensor_long_raw(spark, sf)
    day0 = e.agg((F.min(F.floor(F.unix_micros("ts") / (DAY * 1_000_000)))).cast("long").alias("_d0"))
    d = ordered.positions(e, ["signal"], ["ts", "event_id"], [F.date_trunc("day", F.col("ts"))])
    return d.crossJoin(F.broadcast(day0)).select("signal", "ts", "event_id", "pos", "value", (F.floor(F.unix_micros("ts") / (DAY * 1_000_000)).cast("long") - F.col("_d0")).alias("cycle"))


def stream(spark, sf):
    return V.staged(spark, sf, "stream", build_stream, ["signal", "pos"])


def learned(spark, sf):
    st = stream(spark, sf)
    base0 = V.staged(spark, sf, "normal0", lambda s, d: M.learn(M.cycle_stats(stream(s, d)), LEARN), ["signal"])
    stats = V.staged(spark, sf, "cycles", lambda s, d: M.cycle_stats(st, base0), ["signal", "cycle"])
    return V.staged(spark, sf, "normal", lambda s, d: M.learn(stats, LEARN, stats), ["signal"]), stats


S0 = """st0 AS (SELECT event_type AS signal, CAST(floor(epoch_us(ts) / (86400 * 1e6)) - min(floor(epoch_us(ts) / (86400 * 1e6))) OVER () AS BIGINT) AS cycle, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events),
st AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY signal, cycle ORDER BY pos)) AS d FROM st0),
cs AS (SELECT signal, cycle, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(regr_slope(value, pos) * (count(*) - 1), 0) END AS change,
       CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(sqrt(greatest(0, regr_syy(value, pos) - pow(regr_sxy(value, pos), 2) / nullif(regr_sxx(value, pos), 0)) / count(*)), 0) END AS noise, count(*) FILTER (d > 0) AS changes, coalesce(quantile_cont(CASE WHEN d > 0 THEN d END, 0.5), 0) AS move FROM st GROUP BY 1, 2),
lr0 AS (SELECT st0.signal, avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM st0 WHERE cycle < 4 GROUP BY 1),
lr1 AS (SELECT signal, avg(abs(change)) AS dr, avg(noise) AS nr, avg(move) AS mv, sum(changes) / greatest(1, sum(n - 1)) AS cr FROM cs WHERE cycle < 4 GROUP BY 1),
nm AS (SELECT signal, mu, CASE WHEN sd > 0 THEN sd ELSE greatest(abs(mu) * 1e-3, 1e-6) END AS sigma, lo, hi, cr, dr, nr, mv FROM lr0 JOIN lr1 USING (signal)),
nb AS (SELECT signal, mu, sigma, lo, hi, cr AS change_rate, CASE WHEN abs(mu) >= 2 * sigma THEN abs(mu) ELSE greatest(hi - lo, sigma) END AS basis, greatest(dr, sigma * 0.05) AS drift_ref, greatest(nr, sigma * 1e-3, 1e-9) AS noise_ref, greatest(mv, sigma * 1e-3, 1e-12) AS move_ref FROM nm),
ex AS (SELECT st.signal, st.cycle, avg(CASE WHEN value < nb.lo OR value > nb.hi THEN 1.0 ELSE 0.0 END) * 100 AS outside, coalesce(avg(CASE WHEN d IS NOT NULL THEN CAST(d > greatest(4 * noise_ref, 0.5 * sigma) AS INT) END), 0) AS steps FROM st JOIN nb USING (signal) GROUP BY 1, 2)"""
W = "WITH " + S0


@query("m1_sensor_columns", "WITH " + kinds_sql("events", EV) + " SELECT name, kind FROM kinds WHERE kind IN ('numeric', 'integer') AND NOT regexp_matches(name, '(?i)(^|_)(id|key|time|ts|date|label)($|_)')")
def m1(spark, sf):
    return M.sensor_columns(C.column_kinds(V.table(spark, sf, "events")))


@query("m2_cycle_stats", W + """ SELECT signal, cycle, CAST(n AS BIGINT) AS n, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS lo, round(hi, 4) AS hi, round(change, 3) AS change, round(noise, 3) AS noise, CAST(changes AS BIGINT) AS changes, round(move, 3) AS move, round(outside, 4) AS outside, round(steps, 4) AS steps FROM cs JOIN ex USING (signal, cycle)""")
def m2(spark, sf):
    base, _ = learned(spark, sf)
    d = M.cycle_stats(stream(spark, sf), base)
    return d.select("signal", "cycle", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "lo", "hi")], *[F.round(c, 3).alias(c) for c in ("change", "noise")], "changes", F.round("move", 3).alias("move"), F.round("outside", 4).alias("outside"), F.round("steps", 4).alias("steps"))


@query("m3_learn_normal", W + """, sr AS (SELECT signal, avg(steps) AS step_ref FROM ex WHERE cycle < 4 GROUP BY 1) SELECT signal, round(mu, 4) AS mu, round(sigma, 4) AS sigma, round(basis, 4) AS basis, round(drift_ref, 5) AS drift_ref, round(noise_ref, 5) AS noise_ref, round(move_ref, 5) AS move_ref, round(change_rate, 4) AS change_rate, round(step_ref, 4) AS step_ref FROM nb JOIN sr USING (signal)""")
def m3(spark, sf):
    base, _ = learned(spark, sf)
    return base.select("signal", *[F.round(c, 4).alias(c) for c in ("mu", "sigma", "basis")], *[F.round(c, 5).alias(c) for c in ("drift_ref", "noise_ref", "move_ref")], F.round("change_rate", 4).alias("change_rate"), F.round("step_ref", 4).alias("step_ref"))


JUDGE = W + """, h AS (SELECT cs.*, outside, nb.mu, sigma, basis, drift_ref, noise_ref, change_rate, lag(mean, 1) OVER w AS m1, lag(mean, 2) OVER w AS m2, lag(mean, 3) OVER w AS m3 FROM cs JOIN ex USING (signal, cycle) JOIN nb USING (signal) WINDOW w AS (PARTITION BY signal ORDER BY cycle)),
j0 AS (SELECT *, mean - mu AS dev, abs(mean - mu) / (basis / 100) AS lv, CASE WHEN ((m2 > m3 AND m1 > m2 AND mean > m1) OR (m2 < m3 AND m1 < m2 AND mean < m1)) AND abs(mean - mu) > abs(m3 - mu) AND abs(mean - m3) >= 0.5 * sigma THEN abs(mean - m3) / (basis / 100) ELSE 0 END AS cross_,
       CASE WHEN abs(change) >= greatest(2 * drift_ref, 3 * noise_ref * sqrt(12.0 / greatest(n, 3))) THEN abs(change) / (basis / 100) ELSE 0 END AS w0, noise / noise_ref AS ratio FROM h),
j1 AS (SELECT *, CASE WHEN lv >= 2 THEN 2 WHEN lv >= 1 THEN 1 ELSE 0 END AS level, greatest(cross_, CASE WHEN (mean - mu) * change < 0 AND lv >= 1 THEN 0 ELSE w0 END) AS tv FROM j0),
j2 AS (SELECT *, CASE WHEN tv >= 2 THEN 2 WHEN tv >= 1 THEN 1 ELSE 0 END AS trend, CASE WHEN ratio >= 4 THEN 2 WHEN ratio >= 2 THEN 1 WHEN ratio <= 0.5 AND change_rate > 0 THEN 1 ELSE 0 END AS noise_level, CASE WHEN outside >= 40 THEN 2 WHEN outside >= 20 THEN 1 ELSE 0 END AS range_level FROM j1),
jd AS (SELECT *, CASE WHEN changes = 0 AND (change_rate * (n - 1) >= 3 OR change_rate = 0) THEN 'dead' ELSE CASE greatest(level, trend, noise_level, range_level) WHEN 2 THEN 'alarm' WHEN 1 THEN 'watch' ELSE 'ok' END END AS status FROM j2 WHERE cycle >= 4)"""


def judged(spark, sf):
    base, stats = learned(spark, sf)
    return M.judge(stats, base, first_cycle=LEARN)


@query("m4_judge", JUDGE + " SELECT signal, cycle, status, level, trend, noise_level, range_level FROM jd")
def m4(spark, sf):
    return judged(spark, sf).select("signal", "cycle", "status", "level", "trend", "noise_level", "range_level")


@query("m5_verdict", JUDGE + """, v AS (SELECT cycle, count(*) FILTER (status = 'dead') AS b, count(*) FILTER (status = 'alarm') AS a, count(*) FILTER (status = 'watch') AS w FROM jd GROUP BY 1)
SELECT cycle, CAST(b AS BIGINT) AS n_broken, CAST(a AS BIGINT) AS n_alarm, CAST(w AS BIGINT) AS n_watch, CASE WHEN b > 0.25 * 5 AND b >= 2 THEN 'untrusted' WHEN b > 0 THEN 'quality' WHEN a > 0 THEN 'drift' WHEN w > 0 THEN 'watch' ELSE 'ok' END AS verdict FROM v""")
def m5(spark, sf):
    return M.verdict(judged(spark, sf), 5)


@query("m6_gap_verdict", W + ", c AS (SELECT cycle, sum(n) AS n FROM cs GROUP BY 1), e AS (SELECT unnest(range(min(cycle), max(cycle) + 1)) AS cycle FROM c) SELECT e.cycle, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(n, 0) < 0.5 * 480.0 AS stream_gap FROM e LEFT JOIN c ON c.cycle = e.cycle")
def m6(spark, sf):
    return M.gap_verdict(learned(spark, sf)[1], 480.0)


FEAT = W + """, sr AS (SELECT signal, avg(steps) AS step_ref FROM ex WHERE cycle < 4 GROUP BY 1), f0 AS (SELECT signal, cycle, (mean - mu) / sigma AS z, noise / noise_ref AS var_ratio, change / sigma AS slope, (steps + 0.002) / (step_ref + 0.002) AS jump_ratio, move / move_ref AS move_ratio FROM cs JOIN ex USING (signal, cycle) JOIN nb USING (signal) JOIN sr USING (signal)),
f1 AS (SELECT *, max(abs(z)) OVER (PARTITION BY signal ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS peak4 FROM f0)"""


def feats(spark, sf):
    base, stats = learned(spark, sf)
    return M.features(stats, base)


@query("m7_signature_features", FEAT + " SELECT signal, cycle, round(z, 4) AS z, round(var_ratio, 4) AS var_ratio, round(slope, 4) AS slope, round(jump_ratio, 4) AS jump_ratio, round(move_ratio, 4) AS move_ratio FROM f0")
def m7(spark, sf):
    return feats(spark, sf).select("signal", "cycle", *[F.round(c, 4).alias(c) for c in ("z", "var_ratio", "slope", "jump_ratio", "move_ratio")])


IND = """, f2 AS (SELECT f1.*, e.steps - r.step_ref AS more, coalesce(max(abs(z)) OVER (PARTITION BY signal ORDER BY cycle ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS peak3, coalesce(list(z) OVER (PARTITION BY signal ORDER BY cycle ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS hist
  FROM f1 JOIN ex e USING (signal, cycle) JOIN sr r USING (signal)),
f3 AS (SELECT *, list_filter([(hist || [z])[i + 1] - (hist || [z])[i] FOR i IN range(1, len(hist) + 1)], lambda x: abs(x) >= 0.15) AS big FROM f2),
f4 AS (SELECT *, CASE WHEN len(big) = 0 THEN 0 ELSE greatest(len(list_filter(big[greatest(1, len(big) - 3):], lambda x: x > 0)), len(list_filter(big[greatest(1, len(big) - 3):], lambda x: x < 0))) / 4.0 END AS mono,
  greatest(0.0, least(1.0, (abs(z) - 1) / 3)) AS shift, greatest(0.0, least(1.0, coalesce((jump_ratio - 1) / 3, 0))) * greatest(0.0, least(1.0, coalesce(more / 0.04, 0))) * greatest(0.0, least(1.0, coalesce((1.45 - move_ratio) / 0.3, 0))) AS jumpy,
  greatest(abs(z), peak3) AS p3, greatest(abs(z), coalesce(peak4, 0)) AS p4 FROM f3),
ind AS (SELECT signal, cycle, unnest(['mean_shift', 'slow_drift', 'brief_bump', 'fading_shift', 'collapse', 'variance_increase', 'jumpy']) AS pattern,
  unnest([shift, shift * CASE WHEN mono >= 0.75 AND len(hist) >= 3 THEN 1 ELSE 0.3 END, greatest(0.0, least(1.0, (p3 - 1) / 3)) * CASE WHEN abs(z) < p3 - 0.5 THEN 1 ELSE 0.8 END, greatest(0.0, least(1.0, (p4 - 1) / 3)),
    greatest(0.0, least(1.0, (-z - 4) / 6)) * CASE WHEN slope <= -2 OR len(list_filter(hist, lambda x: x - z >= 3)) > 0 THEN 1 ELSE 0.15 END, greatest(0.0, least(1.0, (var_ratio - 1) / 2)) * (1 - jumpy), jumpy]) AS ind FROM f4)"""


@query("m8_indicators", FEAT + IND + " SELECT signal, cycle, pattern, round(ind, 4) AS ind FROM ind")
def m8(spark, sf):
    return M.indicators(feats(spark, sf)).select("signal", "cycle", "pattern", F.round("ind", 4).alias("ind"))


def catalogue(spark, sf):
    """Signatures over the sensors found in the stream: every sensor pair of neighbours in name order, and generic ones."""
    s = stream(spark, sf).select("signal").distinct()
    from pyspark.sql import Window

    pairs = s.withColumn("b", F.lead("signal").over(Window.orderBy("signal"))).filter("b is not null")
    pats = F.array(*[F.lit(p) for p in ("mean_shift", "variance_increase", "slow_drift", "unknown")])
    spec = pairs.withColumn("pattern", F.explode(pats)).select(F.concat_ws("+", "signal", "b", "pattern").alias("signature_id"), F.lit(1).alias("source_rank"), "pattern", F.lit(False).alias("generic"), F.lit(True).alias("visible"), F.array("signal", "b").alias("columns"))
    gen = s.limit(1).withColumn("pattern", F.explode(pats)).select(F.concat(F.lit("any+"), "pattern").alias("signature_id"), F.lit(2).alias("source_rank"), "pattern", F.lit(True).alias("generic"), F.lit(True).alias("visible"), F.array().cast("array<string>").alias("columns"))
    return spec.unionByName(gen)


def faulty_feats(spark, sf):
    """Features of the stream with a planted fault: from half of the cycles on, the first two sensors in name order leave normal by 0.8 sigma a cycle, up to 4."""
    base, stats = learned(spark, sf)
    from pyspark.sql import Window

    sick = stats.select("signal").distinct().withColumn("_k", F.row_number().over(Window.orderBy("signal"))).filter("_k <= 2")
    half = stats.agg((F.max("cycle") / 2).alias("_half"))
    d = stats.crossJoin(F.broadcast(half)).join(F.broadcast(sick), "signal", "left").join(base.select("signal", "sigma"), "signal")
    away = F.when(F.col("_k").isNotNull() & (F.col("cycle") > F.col("_half")), F.col("sigma") * F.least(F.lit(4.0), 0.8 * (F.col("cycle") - F.col("_half")))).otherwise(0.0)
    return M.features(d.withColumn("mean", F.col("mean") + away).select(*stats.columns), base)


def signature_status(spark, sf):
    """Every fifth cycle the second sensor is dead and takes no part."""
    cat = M.merge_signatures(catalogue(spark, sf))
    f = faulty_feats(spark, sf)
    dead = f.filter("cycle % 5 = 4").groupBy("cycle").agg(F.min("signal").alias("_first"), F.array_sort(F.collect_set("signal")).alias("s")).filter("size(s) > 1").select("cycle", F.get("s", F.lit(1)).alias("signal"))
    return M.evaluate_signatures(M.signature_scores(M.indicators(f), cat, dead), f.select("cycle"))


@query("m9_evaluate_signatures")
def m9(spark, sf):
    return signature_status(spark, sf).drop("sensors")


@query("m10_best_cause")
def m10(spark, sf):
    return M.best_cause(signature_status(spark, sf)).select("cycle", "signature_id", "status", "score")


@query("m11_status_events", JUDGE + """, e AS (SELECT signal, cycle, status, lag(status) OVER (PARTITION BY signal ORDER BY cycle) AS previous, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY signal ORDER BY cycle) AS run FROM jd),
o AS (SELECT *, sum(CAST(status <> 'ok' AS INT)) OVER (PARTITION BY signal, run ORDER BY cycle) AS off_for FROM e) SELECT signal, cycle, previous, status, CAST(off_for AS BIGINT) AS off_for FROM o WHERE previous IS DISTINCT FROM status""")
def m11(spark, sf):
    return M.status_events(judged(spark, sf), "signal")


@query("m12_merge_signatures", """WITH s AS (SELECT DISTINCT event_type AS a FROM events), p AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM s), t AS (SELECT unnest(['mean_shift', 'variance_increase', 'slow_drift']) AS pattern)
SELECT a || '+' || b || '+' || pattern AS signature_id, pattern, 3::INT AS source_rank FROM p, t WHERE b IS NOT NULL UNION ALL SELECT 'any+' || pattern, pattern, 3 FROM t""")
def m12(spark, sf):
    cat = catalogue(spark, sf)
    newer = cat.withColumn("source_rank", F.lit(3))
    return M.merge_signatures(cat.unionByName(newer)).select("signature_id", "pattern", F.col("source_rank").cast("int").alias("source_rank"))


@query("m13_rejudge")
def m13(spark, sf):
    base, stats = learned(spark, sf)
    return M.rejudge(stats, base, M.Settings(mode="spreads", watch=0.5, alarm=1.0), 8)


# ------------------------------------------------------------------ streaming forms
def _scratch(spark) -> str:
    return tempfile.mkdtemp(prefix="stream-", dir=checkpoint_dir(spark).removeprefix("file:")) if checkpoint_dir(spark).removeprefix("file:").startswith("/") else f"{checkpoint_dir(spark)}/stream-{spark.sparkContext.applicationId}-{id(spark)}"


def read_stream(spark, sf):
    e = V.table(spark, sf, "events")
    s = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*")
    return s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("signal"), F.col("value").cast("double").alias("value"))


def run_to_table(spark, df, mode: str):
    base = _scratch(spark)
    out = f"{base}/out"

    def write(b, i):
        b.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("m2_stream_tumbling", "SELECT event_type AS signal, epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS start_us, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def m2_stream(spark, sf):
    d = SM.windowed_stats(read_stream(spark, sf), "ts", "1 day")
    return run_to_table(spark, d, "complete").select("signal", F.unix_micros("start").alias("start_us"), "n", F.round("mean", 6).alias("mean"))


@query("m2_stream_sliding", """WITH h AS (SELECT unnest([0, 1]) AS k) SELECT event_type AS signal, CAST((floor(epoch(ts) / 43200) - k) * 43200 * 1000000 AS BIGINT) AS start_us, CAST(count(*) AS BIGINT) AS n FROM events, h GROUP BY 1, 2""")
def m2_sliding(spark, sf):
    d = SM.windowed_stats(read_stream(spark, sf), "ts", "1 day", "12 hours")
    return run_to_table(spark, d, "complete").select("signal", F.unix_micros("start").alias("start_us"), "n")


@query("m2_stream_session", """WITH l AS (SELECT event_type AS signal, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS st FROM events),
s AS (SELECT *, sum(st) OVER (PARTITION BY signal ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l) SELECT signal, epoch_us(CAST(min(ts) AS TIMESTAMP)) AS start_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY signal, sid""")
def m2_session(spark, sf):
    d = SM.session_stats(read_stream(spark, sf), "ts", "1 hour")
    return run_to_table(spark, d, "complete").select("signal", F.unix_micros("start").alias("start_us"), "n")


@query("m14_process_batch")
def m14(spark, sf):
    """The dirty table replayed file by file through alignment, checks and verdicts."""
    base = _scratch(spark)
    d = V.dirty_wide(spark, sf)
    d.repartitionByRange(2, "row").sortWithinPartitions("row").write.parquet(f"{base}/in")
    ctx = QQ.context(spark, sf)
    types = {n: t for n, t in d.dtypes if n != "batch_id"}
    SW.replay(spark, f"{base}/in", f"{base}/cp", SW.process_batch(ctx, f"{base}/out", types, lambda: 0)).awaitTermination()
    return spark.read.parquet(f"{base}/out/trust").select("batch_id", "trusted", "n_fail", "n_warn", "trust_score")


