"""Canonical views over the driver tables, as DataFrames and as SQL text for the checks against DuckDB.

``sensor_long``  events: grp = user, signal = event type, one reading per row
``sensor_wide``  lineitem: grp = supplier, five numeric signals, an irregular and a regular clock
``dirty_wide``   ``sensor_wide`` with planted defects
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustwatch.operators import ordered
from trustwatch.session import checkpoint_dir, release
from trustwatch.sources.sinks import write_dataset

SIGNALS = ["s01", "s02", "s03", "s04", "s05"]
N_BATCHES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STAGED: set[str] = set()


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame], order: list[str]) -> DataFrame:
    """The ingest stage: a numbered view is written once per application, range-partitioned and sorted by row (by ``order``; none where the rows
    come so), in the shared checkpoint folder; every query then scans it with column pruning and row-range push-down."""
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark)}/trustwatch-{app}/{name}-{zlib.crc32(sf_dir.encode()):08x}"
    if path not in _STAGED:
        write_dataset(build(spark, sf_dir), path, order)
        _STAGED.add(path)
        release(spark)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ sensor_wide
def sensor_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("grp"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").cast("double").alias("s01"), F.col("l_extendedprice").cast("double").alias("s02"),
        F.col("l_discount").cast("double").alias("s03"), F.col("l_tax").cast("double").alias("s04"),
        (F.lit(1000.0) + F.col("l_quantity")).cast("double").alias("s05"))


def sensor_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "sensor_wide", build_sensor_wide, [])


def build_sensor_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ordered.number_rows(sensor_raw(spark, sf_dir), "grp",
                            ["ts", "l_orderkey", "l_linenumber", "l_partkey", "s01", "s02", "s03", "s04"],
                            [F.date_trunc("month", F.col("ts"))])
    return d.select("grp", "row", "pos", "group_start", "group_rows", "ts",
                    (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("row") * 180)).alias("ts_reg"), *SIGNALS)


SENSOR_WIDE = """
sensor_wide0 AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS grp, CAST(l_shipdate AS TIMESTAMP) AS ts,
         CAST(l_quantity AS DOUBLE) AS s01, CAST(l_extendedprice AS DOUBLE) AS s02, CAST(l_discount AS DOUBLE) AS s03,
         CAST(l_tax AS DOUBLE) AS s04, CAST(1000 + l_quantity AS DOUBLE) AS s05,
         row_number() OVER (ORDER BY CAST(l_suppkey AS VARCHAR), l_shipdate, l_orderkey, l_linenumber, l_partkey,
                            l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS row
  FROM lineitem),
sensor_wide AS (
  SELECT *, row - min(row) OVER (PARTITION BY grp) AS pos, min(row) OVER (PARTITION BY grp) AS group_start,
         count(*) OVER (PARTITION BY grp) AS group_rows,
         TIMESTAMP '2026-01-01 00:00:00' + to_seconds(180 * row) AS ts_reg
  FROM sensor_wide0)"""


# ------------------------------------------------------------------ dirty_wide
_SIZES: dict[str, int] = {}


def dirty_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not written: defects are planted row by row while ``sensor_wide`` is read, so columns and row ranges are still pruned there."""
    key = f"{spark.sparkContext.applicationId}/{sf_dir}"
    if key not in _SIZES:
        _SIZES[key] = table(spark, sf_dir, "lineitem").count()
    n = _SIZES[key]
    d = sensor_wide(spark, sf_dir)
    row, pos = F.col("row"), F.col("pos")

    def rows(lo: int, hi: int) -> Column:
        return (row >= lo) & (row < hi)

    def in_group_of(r: int) -> Column:
        return (F.col("group_start") <= r) & (r < F.col("group_start") + F.col("group_rows"))

    empty = rows(n * 205 // 1000, n * 205 // 1000 + 10)
    frozen = in_group_of(n * 55 // 100) & pos.between(100, 180)
    common = in_group_of(n * 65 // 100) & pos.between(200, 239)
    shifted = in_group_of(n * 72 // 100) & pos.between(100, 199)
    null = F.lit(None).cast("double")
    names = F.array(*[F.lit(f"B{i + 1:04d}") for i in range(N_BATCHES)])  # a row's name is picked, not formatted
    late = F.when(rows(n * 40 // 100, n * 40 // 100 + 26), F.lit(-2 * 86400_000_000)).otherwise(0)
    gap = F.when(row >= n * 45 // 100, F.lit(45 * 60_000_000)).otherwise(0)
    first = n * 9 // 10

    def planted(d: DataFrame, row_out: Column, pos_out: Column) -> DataFrame:
        batch_no = F.least(F.lit(N_BATCHES - 1), F.floor(row_out * N_BATCHES / F.lit(n)).cast("int"))
        return d.select(
            "grp", row_out.alias("row"), pos_out.alias("pos"), "group_start", "group_rows", "ts",
            F.timestamp_micros(F.unix_micros("ts_reg") + late + gap).alias("ts_reg"),
            F.when(empty | rows(n * 12 // 100, n * 124 // 1000), null).when(common, 25.0).otherwise(F.col("s01")).alias("s01"),
            F.when(empty, null).when(row == n * 33 // 100, 99999999.0).when(frozen, 20000.5).when(common, 30000.25).otherwise(F.col("s02")).alias("s02"),
            F.when(empty, null).otherwise(F.col("s03")).alias("s03"),
            F.when(empty, null).otherwise(F.col("s04")).alias("s04"),
            F.when(empty, null).when(common, 1025.0).when(shifted, F.col("s05") * 1000).otherwise(F.col("s05")).alias("s05"),
            F.element_at(names, batch_no + 1).alias("batch_id"))

    copies = planted(d.filter(rows(first, first + 5)), row - first + n, F.col("group_rows") + row - first)
    return planted(d, row, pos).unionByName(copies)


DIRTY_WIDE = SENSOR_WIDE + """,
tot AS (SELECT count(*) AS n FROM lineitem),
marks AS (
  SELECT n, (SELECT grp FROM sensor_wide WHERE row = n * 55 // 100) AS g_frozen,
         (SELECT grp FROM sensor_wide WHERE row = n * 65 // 100) AS g_common,
         (SELECT grp FROM sensor_wide WHERE row = n * 72 // 100) AS g_shift
  FROM tot),
dirty0 AS (
  SELECT grp, row, pos, ts, group_rows,
         ts_reg + to_seconds(CASE WHEN row >= n * 45 // 100 THEN 2700 ELSE 0 END
                             - CASE WHEN row >= n * 40 // 100 AND row < n * 40 // 100 + 26 THEN 172800 ELSE 0 END) AS ts_reg,
         CASE WHEN row >= n * 205 // 1000 AND row < n * 205 // 1000 + 10 THEN NULL
              WHEN row >= n * 12 // 100 AND row < n * 124 // 1000 THEN NULL
              WHEN grp = g_common AND pos BETWEEN 200 AND 239 THEN 25.0 ELSE s01 END AS s01,
         CASE WHEN row >= n * 205 // 1000 AND row < n * 205 // 1000 + 10 THEN NULL
              WHEN row = n * 33 // 100 THEN 99999999.0
              WHEN grp = g_frozen AND pos BETWEEN 100 AND 180 THEN 20000.5
              WHEN grp = g_common AND pos BETWEEN 200 AND 239 THEN 30000.25 ELSE s02 END AS s02,
         CASE WHEN row >= n * 205 // 1000 AND row < n * 205 // 1000 + 10 THEN NULL ELSE s03 END AS s03,
         CASE WHEN row >= n * 205 // 1000 AND row < n * 205 // 1000 + 10 THEN NULL ELSE s04 END AS s04,
         CASE WHEN row >= n * 205 // 1000 AND row < n * 205 // 1000 + 10 THEN NULL
              WHEN grp = g_common AND pos BETWEEN 200 AND 239 THEN 1025.0
              WHEN grp = g_shift AND pos BETWEEN 100 AND 199 THEN s05 * 1000 ELSE s05 END AS s05
  FROM sensor_wide, marks),
dirty1 AS (
  SELECT grp, row, pos, ts, ts_reg, CAST(s01 AS DOUBLE) AS s01, CAST(s02 AS DOUBLE) AS s02, s03, s04, CAST(s05 AS DOUBLE) AS s05 FROM dirty0
  UNION ALL
  SELECT grp, n + row - n * 9 // 10, group_rows + row - n * 9 // 10, ts, ts_reg, s01, s02, s03, s04, s05
  FROM dirty0, tot WHERE row >= n * 9 // 10 AND row < n * 9 // 10 + 5),
dirty_wide AS (SELECT dirty1.*, 'B' || lpad(CAST(1 + least(9, row * 10 // n) AS VARCHAR), 4, '0') AS batch_id FROM dirty1, tot),
dirty_long AS (
  SELECT batch_id, grp, row, pos, signal, value FROM (
    SELECT batch_id, grp, row, pos, unnest(['s01', 's02', 's03', 's04', 's05']) AS signal,
           unnest([s01, s02, s03, s04, s05]) AS value FROM dirty_wide))"""


def to_long(wide: DataFrame, ids: list[str], signals: list[str] = SIGNALS) -> DataFrame:
    return wide.unpivot(ids, signals, "signal", "value")


# ------------------------------------------------------------------ sensor_long
def sensor_long_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("grp"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                    F.col("event_type").alias("signal"), F.col("value").cast("double").alias("value"))


def sensor_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos`` counts the readings of a group, ``spos`` those of a (group, signal) series."""
    return staged(spark, sf_dir, "sensor_long", build_sensor_long, ["row"])


def build_sensor_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = [F.date_trunc("day", F.col("ts"))]
    d = ordered.number_rows(sensor_long_raw(spark, sf_dir), "grp", ["ts", "event_id"], day)
    d = ordered.positions(d, ["grp", "signal"], ["row"], day, out="spos")
    return d.select("grp", "row", "pos", "spos", "group_start", "group_rows", "ts", "event_id", "signal", "value")


SENSOR_LONG = """
sensor_long0 AS (
  SELECT CAST(user_id AS VARCHAR) AS grp, CAST(ts AS TIMESTAMP) AS ts, event_id, event_type AS signal, CAST(value AS DOUBLE) AS value,
         row_number() OVER (ORDER BY CAST(user_id AS VARCHAR), ts, event_id) - 1 AS row
  FROM events),
sensor_long AS (
  SELECT *, row - min(row) OVER (PARTITION BY grp) AS pos, min(row) OVER (PARTITION BY grp) AS group_start,
         count(*) OVER (PARTITION BY grp) AS group_rows,
         row_number() OVER (PARTITION BY grp, signal ORDER BY ts, event_id) - 1 AS spos
  FROM sensor_long0)"""


# ------------------------------------------------------------------ record_orders
def record_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as business records: one group per customer, ordered by date."""
    return staged(spark, sf_dir, "record_orders", build_record_orders, [])


def build_record_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("grp", F.col("o_custkey").cast("string"))
    return ordered.number_rows(o, "grp", ["o_orderdate", "o_orderkey"], [F.date_trunc("month", F.col("o_orderdate"))])


RECORD_ORDERS = """
record_orders0 AS (
  SELECT *, CAST(o_custkey AS VARCHAR) AS grp,
         row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR), o_orderdate, o_orderkey) - 1 AS row FROM orders),
record_orders AS (SELECT *, row - min(row) OVER (PARTITION BY grp) AS pos FROM record_orders0)"""


# ------------------------------------------------------------------ scored_docs
def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a deterministic score, for the evaluation operators."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    lab = table(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id")
            .select("doc_id", "lang", F.col("quality").cast("string").alias("label"),
                    (F.pmod(F.col("n_chars") * 37, F.lit(1009)) / F.lit(1009.0)).cast("double").alias("score")))


SCORED_DOCS = """
scored_docs AS (
  SELECT d.doc_id, d.lang, CAST(l.quality AS VARCHAR) AS label, CAST((d.n_chars * 37) % 1009 AS DOUBLE) / 1009.0 AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
