"""Reading, sampling, curation, summaries and disclosure."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.functions.compare import cmp
from trustwatch.operators import select as L
from trustwatch.plans import views as V
from trustwatch.plans.registry import query

W = "WITH " + V.SENSOR_WIDE
D = "WITH " + V.DIRTY_WIDE
N = "(SELECT count(*) FROM lineitem)"


def n_rows(spark, sf):
    return V.table(spark, sf, "lineitem").count()


def r4(c, name=None):
    return F.round(c, 4).alias(name or c)


def groups(spark, sf):
    return V.sensor_wide(spark, sf).groupBy("grp").agg(F.min("row").alias("row_start"), F.count(F.lit(1)).alias("n_rows"))


G = "g AS (SELECT grp, min(row) AS row_start, count(*) AS n_rows FROM sensor_wide GROUP BY grp)"


@query("b1_rows_between", W + f" SELECT row, grp, s01, s02 FROM sensor_wide WHERE row >= {N} // 4 AND row < {N} // 2")
def b1(spark, sf):
    n = n_rows(spark, sf)
    return L.rows_between(V.sensor_wide(spark, sf), n // 4, n // 2, ["row", "grp", "s01", "s02"])


@query("b2_group_rows", W + " SELECT row, s01 FROM sensor_wide WHERE grp = '7' AND row >= 100")
def b2(spark, sf):
    return L.group_rows(V.sensor_wide(spark, sf), "7", 100, 2**62).select("row", "s01")


@query("b3_rows_in_blocks", W + "," + G + " SELECT row, s01, s02 FROM sensor_wide JOIN g USING (grp) WHERE pos < 20 OR pos BETWEEN 40 AND 49")
def b3(spark, sf):
    b = groups(spark, sf).select(F.explode(F.array(F.struct(F.col("row_start").alias("row_start"), (F.col("row_start") + 20).alias("row_end")),
                                                   F.struct((F.col("row_start") + 40).alias("row_start"), (F.col("row_start") + 50).alias("row_end")))).alias("b")).select("b.*")
    return L.rows_in_blocks(V.sensor_wide(spark, sf), b).select("row", "s01", "s02")


@query("b4_chunk_sample", W + f""" SELECT row, c AS chunk, s01 FROM (SELECT *, CAST(least(floor(row / ({N} / 16.0::DOUBLE)), 15) AS BIGINT) AS c FROM sensor_wide)
WHERE row - floor(c * ({N} / 16.0::DOUBLE)) < ({N} // 10) // 16""")
def b4(spark, sf):
    n = n_rows(spark, sf)
    return L.chunk_sample(V.sensor_wide(spark, sf), n, n // 10, 16).select("row", "chunk", "s01")


@query("b5_plan_blocks", W + "," + G + """, r AS (SELECT *, row_number() OVER (ORDER BY row_start) AS rank FROM g),
o AS (SELECT *, CAST(floor(((rank * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE) * greatest(0, n_rows - 100)) AS BIGINT) AS off FROM r)
SELECT grp, row_start AS block_start, row_start + least(n_rows, 100) AS block_end, row_start AS read_start FROM o
UNION ALL SELECT grp, row_start + off, row_start + off + least(n_rows, 100), row_start + greatest(0, off - 20) FROM o WHERE off >= 100""")
def b5(spark, sf):
    from pyspark.sql import Window

    g = groups(spark, sf).withColumn("rank", F.row_number().over(Window.orderBy("row_start")))
    return L.plan_blocks(g, 100, 20)


@query("b6_stride", D + " SELECT row, s01 FROM dirty_wide WHERE row % 7 = 0")
def b6(spark, sf):
    return L.stride(V.dirty_wide(spark, sf), 7).select("row", "s01")


@query("b7_sample_groups", W + "," + G + """, r AS (SELECT *, row_number() OVER (ORDER BY row_start) - 1 AS r, count(*) OVER () AS k FROM g),
keep AS (SELECT grp FROM r WHERE r = 0 OR floor(r * 6 / k) > floor((r - 1) * 6 / k))
SELECT row, grp, s01 FROM sensor_wide WHERE grp IN (SELECT grp FROM keep) AND pos < 200""")
def b7(spark, sf):
    return L.sample_groups(V.sensor_wide(spark, sf), 6, 1200).select("row", "grp", "s01")


@query("b8_resolve_columns", """WITH c AS (SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS alias, n_name AS col FROM nation), w AS (SELECT DISTINCT lower(n_name) || ' ' AS name FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT name, min(alias) AS alias FROM w JOIN c ON lower(regexp_replace(name, '[\\s_.\\-]+', '', 'g')) = lower(regexp_replace(col, '[\\s_.\\-]+', '', 'g')) GROUP BY name""")
def b8(spark, sf):
    nat, cust = V.table(spark, sf, "nation"), V.table(spark, sf, "customer")
    cat = nat.select(F.concat(F.lit("S"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("alias"), F.col("n_name").alias("column"), F.initcap("n_name").alias("display"))
    wanted = cust.join(nat, cust["c_nationkey"] == nat["n_nationkey"]).select(F.concat(F.lower("n_name"), F.lit(" ")).alias("name")).distinct()
    return L.resolve_columns(wanted, cat)


@query("b9_compare", D + """ SELECT op, CAST(count(*) FILTER (hit) AS BIGINT) AS n FROM (SELECT unnest(['>', '>=', '<', '<=', '==', '!=']) AS op,
unnest([s01 > 25, s01 >= 25, s01 < 25, s01 <= 25, s01 = 25, s01 <> 25]) AS hit FROM dirty_wide) GROUP BY op""")
def b9(spark, sf):
    d = V.dirty_wide(spark, sf)
    ops = [">", ">=", "<", "<=", "==", "!="]
    row = d.agg(*[F.sum(cmp(F.col("s01"), o, 25.0).cast("long")).alias(o) for o in ops])
    return row.unpivot([], [F.col(f"`{o}`") for o in ops], "op", "n")


@query("b10_drop_signal", D + " SELECT row, s01, s02, s04 FROM dirty_wide")
def b10_signal(spark, sf):
    return L.curate(V.dirty_wide(spark, sf), {"type": "drop_signal", "signals": ["s03", "s05"]}).select("row", "s01", "s02", "s04")


@query("b10_drop_group", D + " SELECT row, s01 FROM dirty_wide WHERE grp NOT IN ('1', '5', '9')")
def b10_group(spark, sf):
    return L.curate(V.dirty_wide(spark, sf), {"type": "drop_group", "groups": ["1", "5", "9"]}).select("row", "s01")


@query("b10_drop_range", D + " SELECT row, s01 FROM dirty_wide WHERE NOT (row BETWEEN 1000 AND 2999)")
def b10_range(spark, sf):
    return L.curate(V.dirty_wide(spark, sf), {"type": "drop_range", "row_start": 1000, "row_end": 2999}).select("row", "s01")


@query("b10_downsample", D + " SELECT row, s01 FROM dirty_wide WHERE pos % 5 = 0")
def b10_down(spark, sf):
    return L.curate(V.dirty_wide(spark, sf), {"type": "downsample", "factor": 5}).select("row", "s01")


@query("b10_drop_regime", D + ", m AS (SELECT grp FROM dirty_wide GROUP BY grp HAVING avg(s01) > 25.5) SELECT row, s01 FROM dirty_wide WHERE grp NOT IN (SELECT grp FROM m)")
def b10_regime(spark, sf):
    d = V.dirty_wide(spark, sf)
    m = d.groupBy("grp").agg(F.when(F.avg("s01") > 25.5, 1).otherwise(0).alias("regime"))
    return L.curate(d, {"type": "drop_regime", "regime": 1, "members": m}).select("row", "s01")


@query("b11_drop_duplicates", D + " SELECT row, batch_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, s01, s02, s03, s04, s05, ts ORDER BY row) AS rn FROM dirty_wide) WHERE rn = 1")
def b11(spark, sf):
    return L.drop_duplicates(V.dirty_wide(spark, sf), ["batch_id", "s01", "s02", "s03", "s04", "s05", "ts"]).select("row", "batch_id")


@query("b12_append_aligned", W + """, l AS (SELECT *, row_number() OVER (ORDER BY user_id::VARCHAR, ts, event_id) - 1 AS p FROM events)
SELECT row, grp, s01, s02 FROM sensor_wide UNION ALL SELECT p + (SELECT count(*) FROM lineitem), 'new:events', value, NULL FROM l""")
def b12(spark, sf):
    new = V.sensor_long(spark, sf).select("value", F.col("row").alias("pos"))
    return L.append_aligned(V.sensor_wide(spark, sf), new, {"value": "s01"}, "events", n_rows(spark, sf)).select("row", "grp", "s01", "s02")


@query("b13_query", D + " SELECT grp, CAST(count(*) AS BIGINT) AS n, round(avg(s01), 4) AS mean FROM dirty_wide WHERE s02 < 50000 GROUP BY grp ORDER BY grp LIMIT 1000")
def b13(spark, sf):
    return L.query(spark, "SELECT grp, count(*) AS n, round(avg(s01), 4) AS mean FROM dataset WHERE s02 < 50000 GROUP BY grp ORDER BY grp", {"dataset": V.dirty_wide(spark, sf)}, 1000)


STAT_SQL = """CAST(count(s02) AS BIGINT) AS n, round(avg(s02), 4) AS mean, round(stddev_samp(s02), 4) AS std, min(s02) AS min, round(quantile_cont(s02, 0.05), 4) AS q05,
round(quantile_cont(s02, 0.5), 4) AS median, round(quantile_cont(s02, 0.95), 4) AS q95, max(s02) AS max, CAST(count(*) - count(s02) AS BIGINT) AS n_null FROM dirty_wide"""


@query("b14_signal_stats", D + " SELECT grp, " + STAT_SQL + " GROUP BY grp")
def b14(spark, sf):
    d = L.signal_summary(V.dirty_wide(spark, sf), "s02", ["grp"])
    return d.select("grp", "n", r4("mean"), r4("std"), "min", r4("q05"), r4("median"), r4("q95"), "max", "n_null")


@query("b15_series_buckets", W + f""", k AS (SELECT greatest(1, CAST(ceil({N} / 500.0) AS BIGINT)) AS b)
SELECT CAST(row // b AS BIGINT) AS bucket, min(row) AS row_start, CAST(count(*) AS BIGINT) AS n, round(avg(s01), 6) AS s01_mean, min(s01) AS s01_min, max(s01) AS s01_max, round(avg(s02), 6) AS s02_mean, min(s02) AS s02_min, max(s02) AS s02_max FROM sensor_wide, k GROUP BY row // b""")
def b15(spark, sf):
    d = L.series_buckets(V.sensor_wide(spark, sf), ["s01", "s02"], 0, n_rows(spark, sf), 500)
    return d.select("bucket", "row_start", "n", F.round("s01_mean", 6).alias("s01_mean"), "s01_min", "s01_max", F.round("s02_mean", 6).alias("s02_mean"), "s02_min", "s02_max")


@query("b17_coarse_series", D + """, t AS (SELECT max(row) + 1 AS n FROM dirty_wide), k AS (SELECT CAST(ceil(n / 20.0) AS BIGINT) AS b, n FROM t),
p AS (SELECT avg(s01) AS m, stddev_samp(s01) AS s FROM dirty_wide)
SELECT CAST(row // b AS BIGINT) AS bucket, CAST(count(s01) AS BIGINT) AS n, round(avg(s01), 4) AS mean, round((avg(s01) - max(m)) / max(s), 4) AS mean_std FROM dirty_wide, k, p GROUP BY row // b HAVING count(s01) >= 30""")
def b17(spark, sf):
    d = L.coarse_series(V.dirty_wide(spark, sf), "s01", 0, n_rows(spark, sf) + 5)
    return d.select("bucket", "n", r4("mean"), r4("mean_std"))


def sig3(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} * pow(10.0, 2 - floor(log10(abs({x}))))) / pow(10.0, 2 - floor(log10(abs({x})))) END"


@query("b18_safe_release", f"""WITH a AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS mean_value, stddev_samp(value) AS std_value FROM events GROUP BY 1, 2)
SELECT event_type AS S01, user_id AS S02, CAST(n AS BIGINT) AS n, CASE WHEN n >= 15 THEN {sig3('mean_value')} END AS mean_S03, CASE WHEN n >= 15 THEN {sig3('std_value')} END AS std_S03 FROM a""")
def b18(spark, sf):
    e = V.table(spark, sf, "events")
    a = e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"), F.min("value").alias("value_min"), F.max("value").alias("value_max"))
    return L.safe_release(a, "n", {"event_type": "S01", "user_id": "S02", "mean_value": "mean_S03", "std_value": "std_S03"}, min_n=15)


def _redact_sql(c: str) -> str:
    for p, r in L.REDACTIONS:
        c = f"regexp_replace({c}, '{p}', '{r.replace('$1', chr(92) + '1')}', 'g')"
    return c


@query("b19_redact_text", "SELECT doc_id, md5(" + _redact_sql("text") + ") AS digest FROM documents")
def b19(spark, sf):
    d = L.redact_text(V.table(spark, sf, "documents"), "text")
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("b19_find_unsafe", "SELECT * FROM (SELECT doc_id, concat_ws('+', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for (p, _), n in zip(L.REDACTIONS, ("date", "clock", "file", "decimal"))) +
       ") AS violations FROM documents) WHERE violations <> ''")
def b19_unsafe(spark, sf):
    return L.find_unsafe(V.table(spark, sf, "documents"), "text").select("doc_id", "violations")


@query("b19_redact_values", """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
v AS (SELECT DISTINCT lower(x) AS v FROM (SELECT lang AS x FROM documents UNION ALL SELECT source FROM documents))
SELECT doc_id, md5(string_agg(CASE WHEN v.v IS NOT NULL THEN '[value]' ELSE w END, ' ' ORDER BY i)) AS digest FROM w LEFT JOIN v ON lower(w.w) = v.v GROUP BY doc_id""")
def b19_values(spark, sf):
    d = V.table(spark, sf, "documents")
    voc = d.select(F.explode(F.array("lang", "source")).alias("value")).distinct()
    return L.redact_values(d.select("doc_id", "text"), "doc_id", "text", voc).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
