"""Batching over rows and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.operators import batches as B
from trustwatch.plans import views as V
from trustwatch.plans.q_select import groups
from trustwatch.plans.registry import query

L = "WITH " + V.SENSOR_LONG
W = "WITH " + V.SENSOR_WIDE
SEG = L + """, f AS (SELECT *, floor(epoch_us(ts) / (43200 * 1e6)) AS win FROM sensor_long),
s AS (SELECT *, sum(CASE WHEN win IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY pos) AS seg FROM (SELECT *, lag(win) OVER (PARTITION BY grp ORDER BY pos) AS p FROM f)),
segs AS (SELECT grp, min(row) AS row_start, max(row) AS row_end, count(*) AS n FROM s GROUP BY grp, seg)"""


@query("d1_time_segments", SEG + " SELECT grp, row_start, row_end, CAST(n AS BIGINT) AS n FROM segs")
def d1(spark, sf):
    return B.time_segments(V.sensor_long(spark, sf), "ts", 43200).select("grp", "row_start", "row_end", "n")


@query("d1_time_batches")
def d1_batches(spark, sf):
    return B.coalesce_segments(B.time_segments(V.sensor_long(spark, sf), "ts", 3600), 5, 2_000_000)


@query("d2_row_batches", W + """, g AS (SELECT grp, min(row) AS a, count(*) AS n FROM sensor_wide GROUP BY grp),
p AS (SELECT grp, a, n, CASE WHEN n > 400 THEN CAST(ceil(n / 400.0) AS BIGINT) ELSE 1 END AS parts FROM g),
e AS (SELECT *, unnest(range(parts)) AS i FROM p)
SELECT min(a + CAST(floor(n * i / parts) AS BIGINT)) AS row_start, max(a + CAST(floor(n * (i + 1) / parts) AS BIGINT) - 1) AS row_end, CAST(count(*) AS BIGINT) AS n_groups
FROM e GROUP BY n > 400, CASE WHEN n > 400 THEN grp || '/' || i ELSE CAST(a // 400 AS VARCHAR) END""")
def d2(spark, sf):
    return B.row_batches(groups(spark, sf), 400)


@query("d3_define_batches", W + """, t AS (SELECT min(epoch_us(ts_reg)) AS t0, max(row) AS last FROM sensor_wide),
b AS (SELECT CAST(floor((epoch_us(ts_reg) - t0) / 1e6 / 86400) AS BIGINT) AS win, min(row) AS row_start, count(*) AS n, max(last) AS last FROM sensor_wide, t GROUP BY 1)
SELECT win AS window, CAST(n AS BIGINT) AS n_readings, row_start, coalesce(lead(row_start) OVER (ORDER BY row_start) - 1, last) AS row_end FROM b""")
def d3(spark, sf):
    return B.define_batches(V.sensor_wide(spark, sf), "ts_reg", 86400.0)


@query("d4_split_merge")
def d4(spark, sf):
    b = B.time_segments(V.sensor_wide(spark, sf), "ts", 86400.0 * 30)
    return B.split_merge(b, 60, 100)


BT = "b AS (SELECT batch_id, min(row) AS b0, max(row) AS b1 FROM dirty_wide GROUP BY 1)"


def batch_table(spark, sf):
    return V.dirty_wide(spark, sf).groupBy("batch_id").agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"))


@query("d5_batch_groups", "WITH " + V.DIRTY_WIDE + "," + BT + """, g AS (SELECT grp, min(row) AS a, max(row) AS z FROM sensor_wide GROUP BY grp)
SELECT batch_id, string_agg(grp, '+' ORDER BY grp) AS groups FROM b JOIN g ON a <= b1 AND z >= b0 GROUP BY batch_id""")
def d5(spark, sf):
    return B.batch_groups(batch_table(spark, sf), groups(spark, sf)).select("batch_id", F.array_join("groups", "+").alias("groups"))


@query("d6_batch_of_row", "WITH " + V.DIRTY_WIDE + "," + BT + " SELECT row, b.batch_id FROM dirty_wide d JOIN b ON d.row BETWEEN b0 AND b1")
def d6(spark, sf):
    return B.batch_of_row(V.dirty_wide(spark, sf).select("row"), batch_table(spark, sf)).select("row", "batch_id")
