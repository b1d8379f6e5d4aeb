"""Schema inference over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.operators import schema as C
from trustwatch.plans import views as V
from trustwatch.plans.q_select import n_rows
from trustwatch.plans.registry import query

L, W, D, R = ("WITH " + x for x in (V.SENSOR_LONG, V.SENSOR_WIDE, V.DIRTY_WIDE, V.RECORD_ORDERS))
EV = {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
ORD = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}


def kinds_sql(tab: str, types: dict[str, str]) -> str:
    parts = []
    for c, t in types.items():
        s = f"trim(CAST({c} AS VARCHAR))"
        num = f"TRY_CAST({s} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS name, count({c}) AS n, count(DISTINCT {c}) AS n_unique, coalesce(bool_and(abs({num} - round({num})) < 1e-9), false) AS integer_valued, min({num}) AS lo, max({num}) AS hi,
        count({num}) / count({c}) AS num_share, '{t}' AS t FROM {tab}""")
    return "k0 AS (" + " UNION ALL ".join(parts) + """), kinds AS (SELECT name, CASE WHEN n = 0 THEN 'empty' WHEN n_unique = 1 THEN 'constant' WHEN t = 'timestamp' THEN 'datetime'
      WHEN t IN ('bigint', 'double') AND integer_valued AND lo >= 0 AND hi <= 1 THEN 'boolean' WHEN t = 'bigint' OR (t = 'double' AND integer_valued) THEN 'integer' WHEN t = 'double' OR num_share >= 0.95 THEN 'numeric'
      WHEN n_unique / n >= 0.9 AND n >= 50 THEN 'identifier' WHEN n_unique <= greatest(20, floor(0.02 * n)) THEN 'categorical' ELSE 'text' END AS kind, CAST(n AS BIGINT) AS n, CAST(n_unique AS BIGINT) AS n_unique,
      integer_valued AND t <> 'timestamp' AS integer_valued, n_unique <= greatest(2, least(30, CAST(floor(0.05 * n) AS INT))) AS low_cardinality, t FROM k0)"""


def kinds_cols(d):
    return d.select("name", "kind", "n", "n_unique", "low_cardinality")


@query("c1_column_kinds_events", "WITH " + kinds_sql("events", EV) + " SELECT name, kind, n, n_unique, low_cardinality FROM kinds")
def c1_events(spark, sf):
    return kinds_cols(C.column_kinds(V.table(spark, sf, "events")))


@query("c1_column_kinds_orders", "WITH " + kinds_sql("orders", ORD) + " SELECT name, kind, n, n_unique, low_cardinality FROM kinds")
def c1_orders(spark, sf):
    return kinds_cols(C.column_kinds(V.table(spark, sf, "orders")))


@query("c2_datetime_format", "SELECT CAST(count(*) AS BIGINT) AS n, 'dd.MM.yyyy HH:mm' AS format, 1.0::DOUBLE AS share FROM events")
def c2(spark, sf):
    e = V.table(spark, sf, "events").select(F.date_format("ts", "dd.MM.yyyy HH:mm").alias("stamp"))
    return C.datetime_format(e, "stamp")


@query("c3_epoch_unit", L + """ SELECT CASE WHEN min(epoch_ms(ts)) >= 6.3e11 AND max(epoch_ms(ts)) <= 4.2e12 THEN 'ms' END AS unit,
round(avg(CASE WHEN d IS NOT NULL THEN CAST(d >= 0 AS INT) END), 4) AS non_decreasing FROM (SELECT ts, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY grp ORDER BY pos) AS d FROM sensor_long)""")
def c3(spark, sf):
    d = C.epoch_unit(V.sensor_long(spark, sf), F.unix_millis("ts"))
    return d.select("unit", F.round("non_decreasing", 4).alias("non_decreasing"))


TS = """, d AS (SELECT (epoch_us({t}) - epoch_us(lag({t}) OVER (PARTITION BY grp ORDER BY pos))) / 1e6 AS step FROM {v}), p AS (SELECT quantile_cont(step, 0.5) AS period FROM d WHERE step > 0)
SELECT CAST(count(step) AS BIGINT) AS n_steps, round(avg(CAST(step >= 0 AS INT)), 6) AS monotone, round(max(period), 6) AS period, round(avg(CAST(abs(step - period) > 0.5 * period AS INT)), 6) AS irregular,
round(avg(CAST(step = 0 AS INT)), 6) AS zero_share, round(avg(CAST(step < 0 AS INT)), 6) AS negative_share FROM d, p WHERE step IS NOT NULL"""


def ts_out(d):
    return d.select("n_steps", *[F.round(c, 6).alias(c) for c in ("monotone",)], *[F.round(c, 6).alias(c) for c in ("period", "irregular", "zero_share", "negative_share")])


@query("c4_time_stats", L + TS.replace("{t}", "ts").replace("{v}", "sensor_long"))
def c4(spark, sf):
    return ts_out(C.time_stats(V.sensor_long(spark, sf), "ts"))


@query("c4_time_stats_dirty", D + TS.replace("{t}", "ts_reg").replace("{v}", "dirty_wide"))
def c4_dirty(spark, sf):
    return ts_out(C.time_stats(V.dirty_wide(spark, sf), "ts_reg"))


@query("c5_counter_stats", L + """, d AS (SELECT event_id - lag(event_id) OVER (ORDER BY row) AS step FROM sensor_long), m AS (SELECT step AS mode FROM d WHERE step > 0 GROUP BY step ORDER BY count(*) DESC, step LIMIT 1)
SELECT CAST(count(step) AS BIGINT) AS n_steps, CAST(max(mode) AS DOUBLE) AS step, round(avg(CAST(step = mode AS INT)), 6) AS step_share, CAST(count(*) FILTER (step < 0) AS BIGINT) AS resets FROM d, m WHERE step IS NOT NULL""")
def c5(spark, sf):
    d = C.counter_stats(V.sensor_long(spark, sf), "event_id")
    return d.select("n_steps", "step", F.round("step_share", 6).alias("step_share"), "resets")


def key_sql(key: str, name: str) -> str:
    return f"""SELECT 'key_columns' AS method, '{name}' AS columns, count(*) AS n_groups, quantile_cont(n, 0.5) AS median_len, sum(CASE WHEN n = e - s + 1 THEN n ELSE 0 END) / sum(n) AS contiguity,
  quantile_cont(abs(n - med), 0.5) AS mad, sum(n) AS n_rows FROM (SELECT *, quantile_cont(n, 0.5) OVER () AS med FROM (SELECT {key} AS key, min(row) AS s, max(row) AS e, count(*) AS n FROM sensor_wide GROUP BY 1))"""


KEYS = W + ", c0 AS (" + " UNION ALL ".join([key_sql("grp", "grp"), key_sql("s03", "s03"), key_sql("grp || '|' || s04", "grp+s04")]) + """),
c1 AS (SELECT *, CASE WHEN n_groups < 2 THEN 1.0 ELSE greatest(0.0, 1 - least(1.0, 1.4826 * mad / median_len)) END AS regularity,
       CASE WHEN n_groups < 2 OR median_len < 3 THEN 0.0 ELSE (CASE WHEN median_len < 20 THEN median_len / 20.0 ELSE 1.0 END) * (CASE WHEN n_groups > n_rows / 10 THEN 0.3 ELSE 1.0 END) END AS pl FROM c0),
cands AS (SELECT method, columns, n_groups, median_len, contiguity, regularity, (0.6 * contiguity + 0.25 * regularity + 0.15) * pl AS score FROM c1)"""


def key_cands(spark, sf):
    return C.score_group_keys(V.sensor_wide(spark, sf), [["grp"], ["s03"], ["grp", "s04"]])


@query("c6_group_key_scores", KEYS + " SELECT columns, CAST(n_groups AS BIGINT) AS n_groups, median_len, round(contiguity, 4) AS contiguity, round(regularity, 4) AS regularity, round(score, 4) AS score FROM cands")
def c6(spark, sf):
    return key_cands(spark, sf).select("columns", "n_groups", "median_len", *[F.round(c, 4).alias(c) for c in ("contiguity", "regularity", "score")])


def seg_sql(view: str, cond: str, pre: str = "") -> str:
    return f"""s0 AS (SELECT *, CASE WHEN {cond} THEN 1 ELSE 0 END AS st FROM (SELECT *, {pre} FROM {view})),
segs AS (SELECT min(row) AS row_start, max(row) AS row_end, count(*) AS n FROM (SELECT *, sum(st) OVER (ORDER BY row) AS sid FROM s0) GROUP BY sid)"""


SEG_OUT = " SELECT row_start, row_end, CAST(n AS BIGINT) AS n FROM segs"
RESET = seg_sql("sensor_wide", "epoch_us(ts) < p", "lag(epoch_us(ts)) OVER (ORDER BY row) AS p")


@query("c7_segment_by_reset", W + "," + RESET + SEG_OUT)
def c7(spark, sf):
    return C.segment_by_reset(V.sensor_wide(spark, sf), "ts").select("row_start", "row_end", "n")


@query("c8_segment_by_gap", L + "," + seg_sql("sensor_long", "abs(epoch_us(ts) - p) > 86400e6", "lag(epoch_us(ts)) OVER (ORDER BY row) AS p") + SEG_OUT)
def c8(spark, sf):
    return C.segment_by_gap(V.sensor_long(spark, sf), "ts", 86400.0).select("row_start", "row_end", "n")


@query("c9_key_blocks", R + """, b AS (SELECT *, row_number() OVER (ORDER BY row) - row_number() OVER (PARTITION BY o_orderstatus ORDER BY row) AS isl FROM record_orders)
SELECT o_orderstatus AS key, min(row) AS row_start, max(row) AS row_end, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY o_orderstatus, isl""")
def c9(spark, sf):
    return C.key_blocks(V.record_orders(spark, sf), F.col("o_orderstatus")).select("key", "row_start", "row_end", "n")


CHOOSE = KEYS + "," + RESET + """, sg AS (SELECT count(*) AS n_groups, quantile_cont(n, 0.5) AS median_len FROM segs), sm AS (SELECT quantile_cont(abs(n - (SELECT median_len FROM sg)), 0.5) AS mad FROM segs),
sc AS (SELECT 'counter_reset' AS method, '' AS columns, n_groups, median_len, 1.0 AS contiguity, CASE WHEN n_groups < 2 THEN 1.0 ELSE greatest(0.0, 1 - least(1.0, 1.4826 * mad / median_len)) END AS regularity FROM sg, sm),
sc2 AS (SELECT method, columns, n_groups, median_len, contiguity, regularity, (0.5 + 0.35 * regularity) * (CASE WHEN n_groups < 2 OR median_len < 3 THEN 0.0 ELSE (CASE WHEN median_len < 20 THEN median_len / 20.0 ELSE 1.0 END) * (CASE WHEN n_groups > (SELECT count(*) FROM lineitem) / 10.0 THEN 0.3 ELSE 1.0 END) END) AS score FROM sc),
al AS (SELECT * FROM cands UNION ALL SELECT * FROM sc2),
ag AS (SELECT a.*, (SELECT count(*) FROM al b WHERE (a.method <> b.method OR a.columns <> b.columns) AND abs(a.n_groups - b.n_groups) <= greatest(1.0, 0.1 * a.n_groups)) AS agreement FROM al a)
SELECT method, columns, CAST(n_groups AS BIGINT) AS n_groups, CAST(agreement AS BIGINT) AS agreement, round(least(1.0, score + 0.05 * agreement), 4) AS score FROM ag"""


@query("c11_choose_grouping", CHOOSE)
def c11(spark, sf):
    seg = C.segmentation_candidate(C.segment_by_reset(V.sensor_wide(spark, sf), "ts"), "counter_reset", n_rows(spark, sf))
    d = C.choose_grouping(key_cands(spark, sf).unionByName(seg))
    return d.select("method", "columns", "n_groups", "agreement", F.round("score", 4).alias("score"))


@query("c12_assign_groups", W + "," + RESET + " SELECT w.row, CAST(s.row_start AS VARCHAR) AS new_grp FROM sensor_wide w JOIN segs s ON w.row BETWEEN s.row_start AND s.row_end")
def c12(spark, sf):
    w = V.sensor_wide(spark, sf)
    return C.assign_groups(w.select("row"), C.segment_by_reset(w, "ts"), "new_grp").select("row", "new_grp")


CLS_COLS = {k: v for k, v in ORD.items() if k not in ("o_custkey",)}
CLS_L = " UNION ALL ".join(f"SELECT grp, '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM record_orders" for c in CLS_COLS)


@query("c13_classify_columns", R + "," + kinds_sql("orders", CLS_COLS) + f""", l AS ({CLS_L}), per AS (SELECT name, grp, count(DISTINCT value) AS nu, count(*) AS c, min(value) AS v FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
a AS (SELECT name, avg(CAST(nu <= 1 AS INT)) AS within_, avg(CASE WHEN c >= 3 THEN CAST(nu <= 1 AS INT) END) AS within3, min(v) AS va, max(v) AS vb, count(*) AS n_groups FROM per GROUP BY 1),
j AS (SELECT k.*, within_, CASE WHEN kind IN ('integer', 'numeric') AND NOT low_cardinality THEN coalesce(within3 >= 0.98, false) AND va <> vb AND n_groups >= 20 ELSE within_ >= 0.9 AND va <> vb AND n_groups > 1 END AS const_, n_groups FROM kinds k JOIN a USING (name))
SELECT name, kind, CASE WHEN kind IN ('empty', 'identifier', 'datetime', 'text') THEN 'meta' WHEN kind = 'constant' THEN 'signal' WHEN const_ THEN CASE WHEN kind IN ('integer', 'numeric') AND NOT low_cardinality AND n_unique > greatest(50, 0.05 * n_groups) THEN 'meta' ELSE 'label' END
  WHEN kind = 'categorical' THEN 'meta' ELSE 'signal' END AS role, round(within_, 6) AS constant_within FROM j""")
def c13(spark, sf):
    o = V.record_orders(spark, sf)
    d = C.classify_columns(o, C.column_kinds(o, list(CLS_COLS)), list(CLS_COLS))
    return d.select("name", "kind", "role", F.round("constant_within", 6).alias("constant_within"))


@query("c14_domain_likelihood")
def c14(spark, sf):
    from trustwatch.operators import profile as P

    w = V.sensor_wide(spark, sf)
    kinds = C.column_kinds(w.select("grp", "ts", *V.SIGNALS))
    ac = P.dynamics(w, V.SIGNALS).select(F.col("autocorr_lag1").alias("autocorr"))
    return C.domain_likelihood(kinds, ac, C.time_stats(w, "ts_reg").select("irregular"))


@query("c15_derive_event_signals", L + """, c AS (SELECT signal AS v, count(*) AS c FROM sensor_long GROUP BY 1), p AS (SELECT v FROM c WHERE c >= greatest(5, 0.001 * (SELECT count(*) FROM sensor_long)) ORDER BY c, v LIMIT 4)
SELECT grp, row, 'share_signal_' || p.v AS signal, round(avg(CASE WHEN s.signal = p.v THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY grp, p.v ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS value FROM sensor_long s CROSS JOIN p""")
def c15(spark, sf):
    d = C.derive_event_signals(V.sensor_long(spark, sf), ["signal"])
    return d.select("grp", "row", "signal", F.round("value", 6).alias("value"))


@query("c16_override_schema", "SELECT o_orderstatus || '|' || o_orderpriority AS grp, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def c16(spark, sf):
    d = C.override_schema(V.table(spark, sf, "orders"), {"group_columns": ["o_orderstatus", "o_orderpriority"], "time_column": "o_orderdate"})
    return d.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
