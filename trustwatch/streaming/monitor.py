"""The monitor on a stream: windowed cycle statistics and a stateful judge per sensor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def cycle_window(ts: str, interval: str, slide: str | None = None) -> Column:
    return F.window(ts, interval, slide) if slide else F.window(ts, interval)


def windowed_stats(stream: DataFrame, ts: str, interval: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or sliding) statistics of each signal; rows later than the watermark are left out.

    The trend is the regression on event time, so no ordering inside the window is needed."""
    t = F.unix_micros(F.col(ts)) / F.lit(1e6)
    w = cycle_window(ts, interval, slide)
    d = stream.withWatermark(ts, late).groupBy(w.alias("w"), "signal")
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.regr_slope(F.col("value"), t).alias("slope"),
                 (F.avg(F.col("value").isNull().cast("double")) * 100).alias("miss")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "signal", "n", "mean", "std", "lo", "hi", "slope", "miss")


def session_stats(stream: DataFrame, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of readings separated by more than ``gap``."""
    d = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), "signal")
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "signal", "n", "mean")


JUDGED = "signal string, start timestamp, mean double, status string, off_for long"
STATE = "history array<double>, off_for long, mu double, sigma double, learned long"


def judge_stream(stats: DataFrame, n_cycles: int = 4, watch: float = 1.5, alarm: float = 3.0) -> DataFrame:
    """Stateful judge keyed by sensor: learns from its first cycles, then grades each cycle mean in learned spreads."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history, off, mu, sigma, learned = state.get if state.exists else ([], 0, 0.0, 0.0, 0)
        history, out = list(history), []
        for pdf in batches:
            for r in pdf.sort_values("start").itertuples():
                if learned < n_cycles:
                    history.append(float(r.mean))
                    learned += 1
                    mu = sum(history) / len(history)
                    sigma = max(float(r.std), abs(mu) * 1e-3, 1e-6)
                    out.append((key[0], r.start, float(r.mean), "learning", 0))
                    continue
                dev = abs(float(r.mean) - mu) / sigma
                status = "alarm" if dev >= alarm else "watch" if dev >= watch else "ok"
                off = off + 1 if status != "ok" else 0
                history = (history + [float(r.mean)])[-6:]
                out.append((key[0], r.start, float(r.mean), status, off))
        state.update((history, off, mu, sigma, learned))
        yield pd.DataFrame(out, columns=["signal", "start", "mean", "status", "off_for"])

    return stats.groupBy("signal").applyInPandasWithState(step, JUDGED, STATE, "append", "NoTimeout")
