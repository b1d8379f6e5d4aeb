"""Streams of batches: a watched folder, a replayed dataset, and the work done on each arriving batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trustwatch.operators import quality, trust
from trustwatch.sources.align import align_incoming
from trustwatch.sources.sinks import write_by_batch

BatchFn = Callable[[DataFrame, str], None]


def watch_folder(spark: SparkSession, path: str, schema: StructType, checkpoint: str, fn: BatchFn, fmt: str = "parquet", files_per_batch: int = 1, once: bool = True) -> StreamingQuery:
    """Each new file becomes one batch; the checkpoint remembers which files were seen."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    w = reader.load(path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: fn(df, f"B{i + 1:04d}"))
    return (w.trigger(availableNow=True) if once else w).start()


def replay(spark: SparkSession, path: str, checkpoint: str, fn: BatchFn) -> StreamingQuery:
    """A stored dataset, one file after the other, through the same callback."""
    return watch_folder(spark, path, spark.read.parquet(path).schema, checkpoint, fn)


def process_batch(reference: quality.Context, out: str, schema: dict[str, str], next_row: Callable[[], int]) -> BatchFn:
    """Align, check and judge one arriving batch with the learned statistics; writes are keyed by batch id, so a
    repeated batch replaces itself."""

    def run(df: DataFrame, batch_id: str) -> None:
        d = align_incoming(df, schema, next_row(), batch_id)
        ctx = quality.Context(d, reference.signals, reference.stats, d.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows")), reference.time, reference.period, reference.limits, reference.roles, reference.holds, reference.ranges)
        checks = quality.once(quality.run_checks(ctx))
        write_by_batch(checks, f"{out}/checks")
        write_by_batch(trust.trust_verdicts(checks, ctx.sizes, len(ctx.signals)), f"{out}/trust")

    return run
