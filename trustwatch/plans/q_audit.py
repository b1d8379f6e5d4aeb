"""Audit trail and reporting tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.operators import audit as N
from trustwatch.operators import events as K
from trustwatch.plans import q_diagnose as QG
from trustwatch.plans import q_events as QE
from trustwatch.plans import views as V
from trustwatch.plans.registry import query

L = "WITH " + V.SENSOR_LONG
FIELDS = ["grp", "pos", "ts", "signal", "value"]
SEGMENT = 64


def log(spark, sf):
    return N.append_chain(V.sensor_long(spark, sf).select(*FIELDS), "grp", "pos", FIELDS, SEGMENT)


@query("n1_hash_chain")
def n1(spark, sf):
    return log(spark, sf).select("grp", "pos", "prev_hash", "hash")


@query("n1_segment_heads")
def n1_heads(spark, sf):
    return N.seal_segments(log(spark, sf), "grp", "pos", SEGMENT)


@query("n2_verify_chain", L + " SELECT grp, min(pos) AS first_bad_seq, CAST(count(*) AS BIGINT) AS n_bad FROM sensor_long WHERE pos % 50 = 49 GROUP BY grp")
def n2(spark, sf):
    """Every fiftieth entry was changed after it had been written."""
    d = log(spark, sf).withColumn("value", F.when(F.pmod("pos", F.lit(50)) == 49, F.col("value") + 1).otherwise(F.col("value")))
    return N.verify_chain(d, "grp", "pos", FIELDS, SEGMENT)


@query("n1_log_root")
def n1_root(spark, sf):
    return N.seal_root(N.seal_segments(log(spark, sf), "grp", "pos", SEGMENT), "grp", SEGMENT)


@query("n2_verify_segments", L + " SELECT DISTINCT grp, CAST(pos // 64 AS BIGINT) AS segment, CASE WHEN (pos // 64) % 5 = 1 THEN 'missing' ELSE 'changed' END AS problem FROM sensor_long WHERE (pos // 64) % 5 = 1 OR (pos // 64) % 5 = 3 AND pos % 64 = 7")
def n2_segments(spark, sf):
    """Of five segments one was removed and one lost its eighth entry after sealing."""
    d = log(spark, sf)
    part = F.pmod(F.floor(F.col("pos") / SEGMENT), F.lit(5))
    kept = d.filter((part != 1) & ~((part == 3) & (F.pmod("pos", F.lit(SEGMENT)) == 7)))
    return N.verify_segments(kept, N.seal_segments(d, "grp", "pos", SEGMENT), "grp", "pos", SEGMENT)


@query("n3_completeness", """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n_objects, CAST(count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS BIGINT) AS n_missing FROM orders GROUP BY 1""")
def n3(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return N.completeness(V.table(spark, sf, "orders"), li, "o_orderkey", "o_orderstatus")


@query("n4_resolve_evidence", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def n4(spark, sf):
    o = V.table(spark, sf, "orders")
    cited = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderkey").alias("evidence"))
    objs = V.table(spark, sf, "customer").select("c_custkey").join(cited, "c_custkey")
    return N.resolve_evidence(objs, o.select("o_orderkey", "o_totalprice"), "evidence", "o_orderkey").select("c_custkey", "o_orderkey", "o_totalprice")


@query("n5_run_totals", QG.FLAGS + " SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, CASE WHEN grouping(cause) = 1 THEN 'all' ELSE cause END AS cause, CAST(count(*) AS BIGINT) AS n, round(max(severity), 4) AS max_severity FROM (SELECT *, 'anomaly' AS kind FROM fl) GROUP BY ROLLUP (kind, cause)")
def n5(spark, sf):
    return N.run_totals(QG.simple_flags(spark, sf)).select("kind", "cause", "n", F.round("max_severity", 4).alias("max_severity"))


@query("n5_top_groups", QE.W + " SELECT grp, round(max(score), 4) AS max_score FROM sc GROUP BY grp HAVING max(score) >= 1 ORDER BY max(score) DESC, grp LIMIT 10")
def n5_top(spark, sf):
    d = N.top_groups(K.group_summary(QE.simple(spark, sf), QE.SS))
    return d.select("grp", F.round("max_score", 4).alias("max_score"))


@query("n6_varied_sample", QG.FLAGS + """, r AS (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY severity DESC, row_start) AS r FROM dg)
SELECT grp, cause, CAST(r AS INT) AS round FROM (SELECT * FROM r WHERE r <= 12 ORDER BY r, severity DESC, row_start LIMIT 12)""")
def n6(spark, sf):
    return N.varied_sample(QG.diag(spark, sf), ["cause"], 12).select("grp", "cause", "round")


@query("n7_drift_trends", QG.FLAGS + """, tp AS (SELECT * FROM fl ORDER BY severity DESC, grp, row_start LIMIT 8), p AS (SELECT t.grp, t.row_start, w.row, w.s02 AS v FROM tp t JOIN sensor_wide w ON w.grp = t.grp AND w.row BETWEEN t.row_start AND t.row_end)
SELECT a.grp, a.row_start, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(sign(b.v - a.v)), 4) AS tau, round(quantile_cont((b.v - a.v) / (b.row - a.row), 0.5), 4) AS slope FROM p a JOIN p b ON a.grp = b.grp AND a.row_start = b.row_start AND a.row < b.row GROUP BY 1, 2""")
def n7(spark, sf):
    d = N.drift_trends(QG.simple_flags(spark, sf), V.sensor_wide(spark, sf), "s02")
    return d.select("grp", "row_start", "n_pairs", F.round("tau", 4).alias("tau"), F.round("slope", 4).alias("slope"))


TL = QE.SEG + """, g AS (SELECT grp, count(*) AS n FROM sc GROUP BY 1), tl AS (SELECT sc.grp, CAST(floor(pos * 50 / greatest(n, 50)) AS BIGINT) AS bucket, min(row) AS row_start, max(row) AS row_end, max(score) AS max_score FROM sc JOIN g USING (grp) GROUP BY 1, 2)"""


@query("n9_score_timeline", TL + " SELECT grp, bucket, row_start, row_end, round(max_score, 4) AS max_score FROM tl")
def n9(spark, sf):
    return N.score_timeline(QE.simple(spark, sf), 50).select("grp", "bucket", "row_start", "row_end", F.round("max_score", 4).alias("max_score"))


@query("n9_flagged_spans", TL + " SELECT tl.grp, bucket, CAST(count(*) AS BIGINT) AS n_segments FROM tl JOIN segs s ON s.grp = tl.grp AND s.row_start <= tl.row_end AND s.row_end >= tl.row_start GROUP BY 1, 2")
def n9_spans(spark, sf):
    return N.flagged_spans(N.score_timeline(QE.simple(spark, sf), 50), QE.segs(spark, sf))


QUERY = "system data model test"


@query("n10_search", """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 0) AS w FROM documents),
q0 AS (SELECT string_split('""" + QUERY + """', ' ') AS w), one AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w),
t AS (SELECT doc_id, term, count(*) AS tf FROM one GROUP BY 1, 2), idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM t GROUP BY 1),
qt AS (SELECT term, count(*) AS tf FROM (SELECT unnest(w) AS term FROM q0 UNION ALL SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM q0) GROUP BY 1), q AS (SELECT term, (1 + ln(tf)) * idf AS qw FROM qt JOIN idf USING (term)),
d AS (SELECT doc_id, sum((1 + ln(tf)) * idf * coalesce(qw, 0)) AS dot, sqrt(sum(pow((1 + ln(tf)) * idf, 2))) AS nrm FROM t JOIN idf USING (term) LEFT JOIN q USING (term) GROUP BY 1)
SELECT doc_id, round(dot / nrm / (SELECT sqrt(sum(qw * qw)) FROM q), 6) AS score FROM d WHERE dot > 0 ORDER BY dot / nrm DESC, doc_id LIMIT 10""")
def n10(spark, sf):
    return N.search(V.table(spark, sf, "documents"), "doc_id", "text", QUERY).select("doc_id", F.round("score", 6).alias("score"))
