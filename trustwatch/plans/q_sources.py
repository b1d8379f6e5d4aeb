"""Readers and sinks: the driver tables written in other formats by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustwatch.operators import ordered
from trustwatch.plans import views as V
from trustwatch.plans.q_monitor import _scratch
from trustwatch.plans.registry import query
from trustwatch.sources import align, readers, sinks
from trustwatch.streaming import watch

ORD = "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders"


def orders(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("a1_read_delimited", ORD)
def a1(spark, sf):
    p = f"{_scratch(spark)}/csv"
    o = orders(spark, sf).withColumn("o_totalprice", F.regexp_replace(F.col("o_totalprice").cast("decimal(18,4)").cast("string"), r"\.", ","))
    o.write.csv(p, header=True, sep=";")
    d = readers.read_delimited(spark, p, ";", decimal=",")
    return d.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("a2_read_whitespace", ORD)
def a2(spark, sf):
    p = f"{_scratch(spark)}/txt"
    orders(spark, sf).select(F.concat_ws("   ", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,4)")).alias("value")).write.text(p)
    d = readers.read_whitespace(spark, p, ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return d.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("a3_read_parquet_nested", "SELECT vec_id, label, CAST(len(embedding) AS INT) AS n FROM embeddings")
def a3(spark, sf):
    d = readers.read_parquet(spark, f"{sf}/embeddings.parquet")
    return d.select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).alias("n"))


@query("a4_read_json", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def a4(spark, sf):
    p = f"{_scratch(spark)}/json"
    sinks.write_objects(orders(spark, sf), p)
    return readers.read_json(spark, p).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("a5_transpose_matrix", "SELECT CAST(i - 1 AS BIGINT) AS row, max(CASE WHEN vec_id = 0 THEN x END) AS col_0, max(CASE WHEN vec_id = 1 THEN x END) AS col_1, max(CASE WHEN vec_id = 2 THEN x END) AS col_2 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def a5(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ").alias("line"))
    return readers.transpose_matrix(e, "vec_id", "line", 3)


@query("a6_dialect_profile")
def a6(spark, sf):
    base = _scratch(spark)
    o = orders(spark, sf)
    o.write.csv(f"{base}/comma", header=True)
    o.write.csv(f"{base}/semi", header=True, sep=";")
    return readers.dialect_profile(spark, f"{base}/*/*.csv").select("delimiter", "n_fields", "consistency", "numeric_share", "decimal")


@query("a7_orientation", "WITH " + V.SENSOR_WIDE + """, l AS (SELECT *, lag(s01) OVER w AS a, lag(s02) OVER w AS b, lag(s03) OVER w AS c FROM sensor_wide WINDOW w AS (PARTITION BY grp ORDER BY pos)), p AS (SELECT unnest([s01, s02]) AS x, unnest([s02, s03]) AS y FROM sensor_wide)
SELECT round((SELECT (corr(s01, a) + corr(s02, b) + corr(s03, c)) / 3 FROM l), 4) AS down, round((SELECT corr(x, y) FROM p), 4) AS along""")
def a7(spark, sf):
    return readers.orientation_stats(V.sensor_wide(spark, sf), ["s01", "s02", "s03"]).select(F.round("down", 4).alias("down"), F.round("along", 4).alias("along"))


@query("a8_sanitize_columns", "SELECT o_orderkey AS order_id, o_orderstatus AS col_1, o_totalprice AS order_ID_2 FROM orders")
def a8(spark, sf):
    return readers.sanitize_columns(orders(spark, sf).toDF(" order_id\n", "Unnamed: 1", "order_ID"))


@query("a9_normalize_nulls", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice < 300000 THEN o_totalprice END AS o_totalprice FROM orders")
def a9(spark, sf):
    o = orders(spark, sf)
    o = o.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", " n/a").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("o_totalprice") >= 300000, F.lit(float("inf"))).otherwise(F.col("o_totalprice")))
    return readers.normalize_nulls(o)


@query("a10_narrow_floats", "SELECT l_orderkey, CAST(l_discount AS FLOAT) AS l_discount, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem")
def a10(spark, sf):
    return readers.narrow_floats(V.table(spark, sf, "lineitem").select("l_orderkey", "l_discount", F.col("l_quantity").cast("double").alias("l_quantity")))


@query("a11_row_numbers", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row FROM events")
def a11(spark, sf):
    return ordered.number_file_rows(V.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row")


@query("a12_align_incoming", "SELECT CAST(event_id AS BIGINT) AS event_id, value, NULL::DOUBLE AS missing_signal, row_number() OVER (ORDER BY event_id) - 1 + 1000 AS row, 'B0009' AS batch_id FROM events")
def a12(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("EVENT_ID"), F.col("value").alias("reading"), "props")
    return align.align_incoming(e, {"event_id": "bigint", "value": "double", "missing_signal": "double"}, 1000, "B0009", {"value": "reading"}, ["event_id"])


@query("a13_sample_rows")
def a13(spark, sf):
    return readers.sample_rows(V.sensor_wide(spark, sf).select("row", "s01"), 500)


def _collect_batches(spark, sf, runner):
    base = _scratch(spark)
    src = f"{base}/in"
    V.sensor_wide(spark, sf).select("row", "grp", "s01").repartitionByRange(3, "row").write.parquet(src)
    out = f"{base}/out"
    runner(src, f"{base}/cp", lambda df, b: sinks.write_by_batch(df.withColumn("batch_id", F.lit(b)), out)).awaitTermination()
    return spark.read.parquet(out).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("a14_watch_folder", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def a14(spark, sf):
    schema = V.sensor_wide(spark, sf).select("row", "grp", "s01").schema
    return _collect_batches(spark, sf, lambda src, cp, fn: watch.watch_folder(spark, src, schema, cp, fn)).agg(F.sum("n").alias("n"))


@query("a15_replay", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def a15(spark, sf):
    return _collect_batches(spark, sf, lambda src, cp, fn: watch.replay(spark, src, cp, fn)).agg(F.sum("n").alias("n"))


@query("a16_sinks", "WITH " + V.DIRTY_WIDE + " SELECT batch_id, CAST(count(*) AS BIGINT) AS n FROM dirty_wide GROUP BY 1")
def a16(spark, sf):
    """Batches written twice leave one copy."""
    p = f"{_scratch(spark)}/batches"
    d = V.dirty_wide(spark, sf).select("batch_id", "row", "s01")
    sinks.write_by_batch(d, p)
    sinks.write_by_batch(d.filter("batch_id in ('B0002', 'B0003')"), p)
    return spark.read.parquet(p).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


