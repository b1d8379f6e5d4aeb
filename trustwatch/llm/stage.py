"""Shared helpers: intermediate tables in the shared folder, and columns that outer tables may lack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustwatch.session import checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named, alone (extra columns never travel); a null text is empty. Rows without a doc_id are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more).filter("doc_id IS NOT NULL")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


BITS = 1 << 25
SEGMENT = 8 * 4096


def _marked(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_maybe``: false only where ``key`` is surely not in ``ids``. The bits broadcast take 4 MB at most, however many ids there are."""
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    at = lambda d: d.withColumn("_segment", F.floor(bit / SEGMENT)).withColumn("_at", bit % SEGMENT)
    bits = at(ids.select(key)).repartition("_segment").groupBy("_segment").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.expr("CAST(conv(hex(substring(_bits, CAST(_at div 8 AS INT) + 1, 1)), 16, 10) AS BIGINT)")
    return at(df).join(F.broadcast(bits), "_segment", "left").withColumn("_maybe", F.coalesce(F.getbit(byte, F.expr("CAST(_at % 8 AS INT)")) == 1, F.lit(False))).select(*df.columns, "_maybe")


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (exact); only rows that may be are shuffled."""
    return _marked(df, ids, key).filter("_maybe").drop("_maybe").join(ids.select(key), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids`` or null (exact); only rows that may be in it are shuffled."""
    m = _marked(df, ids, key)
    return m.filter("NOT _maybe").drop("_maybe").unionByName(m.filter("_maybe").drop("_maybe").join(ids.select(key), key, "left_anti"))
