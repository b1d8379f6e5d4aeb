"""Data-quality checks: one row per finding, the same columns for every check.

``row_start`` / ``row_end`` are inclusive and span all events of the finding; ``events`` holds
all of its stretches. Runs never cross a group boundary or a batch boundary. A batch holds a bounded
number of rows, so per-batch work is bounded too; work per group always goes through chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import ordered
from trustwatch.session import checkpoint_dir, release

SHIFT_WINDOW = 25
FEW_KEYS = 1 << 16
"""Hashes that are sent to every task."""
FEW_ROWS = 1 << 22
"""Rows of findings that are kept rather than found again by each check."""
CATEGORIES = ("completeness", "validity", "consistency", "timeliness")


@dataclass(frozen=True)
class Limits:
    """Thresholds with their usual values."""

    missing_warn: float = 0.02
    missing_fail: float = 0.20
    stuck_min_run: int = 30
    stuck_fraction_warn: float = 0.5
    range_sigma: float = 6.0
    spike_sigma: float = 10.0
    spike_max_len: int = 2
    spike_min_scale: float = 0.15
    gap_factor: float = 3.0
    absurd: float = 1e30
    record_share: float = 0.10


@dataclass(frozen=True)
class Context:
    """What the checks look at: the wide rows (grp, row, pos, batch_id, signals) and per-signal knowledge."""

    wide: DataFrame
    signals: Sequence[str]
    stats: DataFrame
    sizes: DataFrame
    time: str | None = None
    period: DataFrame | None = None
    limits: Limits = field(default_factory=Limits)
    roles: dict[str, str] = field(default_factory=dict)
    holds: dict[str, int] = field(default_factory=dict)
    ranges: DataFrame | None = None
    group_rows: str | None = "group_rows"
    windows: DataFrame | None = None
    steps: DataFrame | None = None
    nulls: DataFrame | None = None

    def role(self, s: str) -> str:
        return self.roles.get(s, "continuous_measured")

    def with_roles(self, *roles: str) -> list[str]:
        return [s for s in self.signals if self.role(s) in roles]

    def checkable(self) -> list[str]:
        return self.with_roles("continuous_measured", "actuator_like", "held_sampled", "derived_redundant", "unknown")


def build_context(wide: DataFrame, signals: Sequence[str], time: str | None = None, limits: Limits | None = None,
                  roles: dict[str, str] | None = None, holds: dict[str, int] | None = None,
                  rule_limits: DataFrame | None = None, stats: DataFrame | None = None) -> Context:
    """``stats``: written statistics of the table; computed and checkpointed here when missing."""
    lim = limits or Limits()
    st = stats if stats is not None else table_stats(wide, signals)
    sizes = wide.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))
    period = steps = None
    if time:
        steps = once(step_counts(wide, time))
        middle = S.counted_quantiles(steps.filter(F.col("step") > 0), "step", "n", [0.5])[0]
        period = wide.sparkSession.createDataFrame([(middle,)], "period double")
    ranges = plausible_ranges(st, roles or {}, rule_limits)
    return Context(wide, list(signals), st, sizes, time, period, lim, roles or {}, holds or {}, ranges, steps=steps)


def table_stats(wide: DataFrame, signals: Sequence[str]) -> DataFrame:
    return S.wide_stats(wide, {s: S.finite(F.col(s)) for s in signals})


def once(df: DataFrame) -> DataFrame:
    """A small intermediate used by several checks: computed once, kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


# ------------------------------------------------------------------ assembly
VALUES = "map<string,double>"


def _check(d: DataFrame, check_type: Column | str, category: Column | str, status: Column | str, severity: Column | float,
           support: Column, ratio: Column | None = None, signals: Column | None = None,
           values: dict[str, Column] | None = None, exposure: Column | None = None, members: Column | None = None,
           events: Column | None = None, row_start: Column | None = None, row_end: Column | None = None) -> DataFrame:
    """Brings a finding table to the common check columns."""
    cols = d.columns
    pick = lambda name, typ: F.col(name).cast(typ) if name in cols else F.lit(None).cast(typ)
    st = F.lit(status) if isinstance(status, str) else status
    sev = F.lit(severity) if isinstance(severity, (int, float)) else severity
    sig = signals if signals is not None else (F.array("signal") if "signal" in cols else F.array().cast("array<string>"))
    vals = F.lit(None).cast(VALUES)
    if values:
        vals = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])
    ev = events if events is not None else (F.col("events") if "events" in cols else F.array().cast("array<struct<row_start:bigint,row_end:bigint>>"))
    return d.select(
        F.lit(check_type).alias("check_type"), F.lit(category).alias("category"), sig.alias("signals"), F.col("batch_id"),
        st.alias("status"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), sev.cast("double"))).alias("severity"),
        (row_start if row_start is not None else pick("row_start", "long")).alias("row_start"),
        (row_end if row_end is not None else pick("row_end", "long")).alias("row_end"),
        pick("n", "long").alias("n"), pick("fraction", "double").alias("fraction"),
        (exposure if exposure is not None else pick("fraction", "double")).cast("double").alias("exposure"),
        pick("record_fraction", "double").alias("record_fraction"),
        S.confidence(support, ratio).alias("confidence"), vals.alias("values"),
        (members if members is not None else F.lit(None).cast("map<string,bigint>")).alias("members"),
        ev.cast("array<struct<row_start:bigint,row_end:bigint>>").alias("events"))


def summarize(events: DataFrame, by: Sequence[str], aggs: Sequence[Column] = ()) -> DataFrame:
    """Events to one row per finding: n, n_events, full extent and all stretches, in order (no more than the batch has rows)."""
    stretch = F.struct(F.col("row_start").cast("long").alias("row_start"), F.col("row_end").cast("long").alias("row_end"))
    return (events.groupBy(*by)
            .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_events"), F.min("row_start").alias("row_start"),
                 F.max("row_end").alias("row_end"), F.sort_array(F.collect_list(stretch)).alias("events"), *aggs))


def _sized(d: DataFrame, ctx: Context) -> DataFrame:
    return d.join(ctx.sizes, "batch_id")


def _signal_structs(ctx: Context, signals: Sequence[str], cond=None) -> Column:
    """Array of (signal, value) structs of one wide row, only those passing ``cond(column)``."""
    items = []
    for s in signals:
        st = F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value"))
        items.append(F.when(cond(F.col(s)), st) if cond else st)
    return F.array_compact(F.array(*items))


def explode_signals(ctx: Context, signals: Sequence[str], keep: Sequence[str], cond=None) -> DataFrame:
    if not signals:
        return ctx.wide.select(*keep, F.lit(None).cast("string").alias("signal"), F.lit(None).cast("double").alias("value")).filter(F.lit(False))
    return (ctx.wide.select(*keep, F.explode(_signal_structs(ctx, signals, cond)).alias("_s"))
            .select(*keep, "_s.signal", "_s.value"))


ROW_KEYS = ("batch_id", "grp", "row", "pos")


def _known(ctx: Context) -> dict[str, Row]:
    """The statistics of each signal, one row each."""
    return {r.signal: r for r in ctx.stats.select("signal", "median", "scale").collect()}


# ------------------------------------------------------------------ completeness
def _missing_k(ctx: Context) -> DataFrame:
    """Signals that must be missing together, raised above what independent gaps would produce."""
    rate = 1 - F.col("n") / F.col("n_rows")
    e = F.coalesce(F.sum(F.when((rate > 0) & (rate < 1), rate)), F.lit(0.0))
    k = F.greatest(F.lit(S.common_mode_k(len(ctx.signals))), F.ceil(e + 4 * F.sqrt(e) + 1).cast("int"))
    return ctx.stats.agg(k.alias("k_missing"))


def null_rows(ctx: Context) -> DataFrame:
    """ROW_KEYS and signals of the rows that have a null, and how many (_nulls). They are kept if they are few."""
    nulls = reduce(lambda a, b: a + b, [F.col(s).isNull().cast("int") for s in ctx.signals])
    # the id keeps the count from being worked out again in every filter on it
    d = ctx.wide.select(*ROW_KEYS, *ctx.signals, nulls.alias("_nulls"), F.monotonically_increasing_id().alias("_id")).filter((F.col("_nulls") > 0) & (F.col("_id") >= 0)).drop("_id")
    cells = ctx.stats.filter(F.col("signal").isin(list(ctx.signals))).agg(F.sum(F.col("n_rows") - F.col("n")), F.count(F.lit(1))).first()
    return once(d) if cells[1] == len(ctx.signals) and (cells[0] or 0) <= FEW_ROWS else d


def _null_counts(ctx: Context) -> DataFrame:
    return (ctx.nulls if ctx.nulls is not None else null_rows(ctx)).crossJoin(F.broadcast(_missing_k(ctx)))


def check_missing(ctx: Context) -> DataFrame:
    """Own gaps of each signal (``missing``) and signals without any value in a batch (``dropout``)."""
    lim, keys = ctx.limits, ["batch_id", "grp", "signal"]
    d = _null_counts(ctx)
    gaps = F.array_compact(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in ctx.signals]))
    miss = d.select("batch_id", "grp", "row", "pos", (F.col("_nulls") < F.col("k_missing")).alias("own"), F.explode(gaps).alias("signal"))
    total = miss.groupBy("batch_id", "signal").agg(F.count(F.lit(1)).alias("n_missing"))
    own = summarize(ordered.islands(miss.filter("own"), keys), ["batch_id", "signal"], [F.max("n").alias("longest")])
    t = _sized(total.join(own, ["batch_id", "signal"], "left"), ctx)
    n_rows = F.col("n_rows")
    t = t.withColumn("fraction", F.coalesce(F.col("n"), F.lit(0)) / n_rows).withColumn("_all", F.col("n_missing") / n_rows)
    rate, is_drop = F.col("fraction"), (F.col("_all") >= 1.0) & (F.col("fraction") >= lim.missing_fail)
    warn_sev = F.least(F.lit(0.5), 0.5 * rate / lim.missing_fail)
    fail_sev = F.least(F.lit(1.0), 0.8 * rate / lim.missing_fail)
    failed = rate >= lim.missing_fail
    miss_rows = t.filter(~is_drop & (rate >= lim.missing_warn))
    a = _check(miss_rows, "missing", "completeness", F.when(failed, "fail").otherwise("warn"),
               F.greatest(F.when(failed, fail_sev).otherwise(warn_sev), F.lit(0.15)), n_rows, rate / lim.missing_warn,
               values={"missing_rate": rate, "longest_missing": F.col("longest"), "missing_rate_total": F.col("_all")})
    b = _check(t.filter(is_drop), "dropout", "completeness", "fail", 1.0, n_rows, values={"missing_rate": F.lit(1.0)})
    return a.unionByName(b)


def check_empty_rows(ctx: Context) -> DataFrame:
    d = (ctx.nulls if ctx.nulls is not None else ctx.wide).filter(F.coalesce(*[F.col(s).cast("double") for s in ctx.signals]).isNull()).select(*ROW_KEYS)
    t = _sized(summarize(ordered.islands(d, ["batch_id", "grp"]), ["batch_id"]), ctx)
    t = t.withColumn("fraction", F.col("n") / F.col("n_rows"))
    bad = F.col("fraction") >= 0.01
    return _check(t, "empty_rows", "completeness", F.when(bad, "fail").otherwise("warn"), F.when(bad, 0.6).otherwise(0.3), F.col("n_rows"))


def check_missing_block(ctx: Context) -> DataFrame:
    """Rows missing in many signals at once, but not in all of them."""
    d = _null_counts(ctx).filter((F.col("_nulls") >= F.col("k_missing")) & (F.col("_nulls") < len(ctx.signals)))
    marks = [F.col(s).isNull().cast("long").alias(f"m_{s}") for s in ctx.signals]
    flags = d.select(*ROW_KEYS, F.col("_nulls").cast("long").alias("_nulls"), "k_missing", *marks)
    isl = ordered.islands(flags, ["batch_id", "grp"], aggs={
        "_nulls": ("sum", F.col("_nulls")), "k_missing": ("max", F.col("k_missing")), **{f"m_{s}": ("sum", F.col(f"m_{s}")) for s in ctx.signals}})
    t = summarize(isl, ["batch_id"], [F.sum("_nulls").alias("_cells"), F.max("k_missing").alias("k_missing"),
                                      *[F.sum(f"m_{s}").alias(f"m_{s}") for s in ctx.signals]])
    t = _sized(t, ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    typical = F.round(F.col("_cells") / F.col("n"))
    core = F.array_compact(F.array(*[F.when(F.col(f"m_{s}") >= 0.5 * F.col("n"), F.lit(s)) for s in ctx.signals]))
    by_rows = F.slice(F.sort_array(F.array(*[F.struct((-F.col(f"m_{s}")).alias("k"), F.lit(s).alias("s")) for s in ctx.signals])), F.lit(1), F.greatest(F.lit(2), F.col("k_missing")))
    sig = F.when(F.size(core) >= 2, core).otherwise(F.sort_array(F.transform(by_rows, lambda x: x["s"])))
    members = F.map_filter(F.create_map(*[x for s in ctx.signals for x in (F.lit(s), F.col(f"m_{s}"))]), lambda k, v: v > 0)
    frac = F.col("fraction")
    return _check(t, "missing_block", "completeness", F.when(frac >= ctx.limits.missing_warn, "fail").otherwise("warn"),
                  0.4 + 0.6 * F.least(F.lit(1.0), frac / ctx.limits.record_share), F.col("n") * F.greatest(F.lit(1.0), typical),
                  typical / F.greatest(F.lit(1), F.col("k_missing")), signals=sig, members=members, values={"signals_per_row": typical})


# ------------------------------------------------------------------ validity
def plausible_ranges(st: DataFrame, roles: dict[str, str] | None = None, rule_limits: DataFrame | None = None) -> DataFrame:
    """signal, lo, hi, span and where each bound comes from. Rule limits only widen a range."""
    q01, q99 = F.col("q01"), F.col("q99")
    span = F.when(q99 > q01, q99 - q01).otherwise(4.65 * F.col("scale"))
    d = st.withColumn("span", span).filter(F.col("span") > 0)
    sp = F.col("span")
    actuators = [s for s, r in (roles or {}).items() if r == "actuator_like"]
    constants = [s for s, r in (roles or {}).items() if r == "constant"]
    if constants:
        d = d.filter(~F.col("signal").isin(constants))
    pct = (q01 >= -1) & (q99 <= 101) & (q99 - q01 >= 10) & ((q01 <= 0.5) | (q99 >= 99.5) | F.col("signal").isin(actuators or [""]))
    tol = 0.01 * sp
    lo, hi = q01 - 3.0 * sp, q99 + 3.0 * sp
    lo_pct, hi_pct = pct & (F.lit(-1.0) > lo), pct & (F.lit(101.0) < hi)
    nonneg = ~pct & (q01 >= 0) & (-tol > lo)
    d = d.select("signal", "q01", "q99", "span", "median", "scale",
                 F.when(lo_pct, -1.0).when(nonneg, -tol).otherwise(lo).alias("lo"), F.when(hi_pct, 101.0).otherwise(hi).alias("hi"),
                 F.when(lo_pct, "percentage").when(nonneg, "non_negative").otherwise("data").alias("lo_source"),
                 F.when(hi_pct, "percentage").otherwise("data").alias("hi_source"),
                 F.when(pct, "percentage").when(nonneg, "non_negative").alias("hint"))
    return d if rule_limits is None else widen_ranges(d, rule_limits)


def widen_ranges(ranges: DataFrame, rule_limits: DataFrame) -> DataFrame:
    """``rule_limits``: signal, rule_min, rule_max of the active range rules."""
    r = rule_limits.groupBy("signal").agg(F.min("rule_min").alias("_rmin"), F.max("rule_max").alias("_rmax"))
    d = ranges.join(r, "signal", "left")
    low, high = F.col("_rmin") < F.col("lo"), F.col("_rmax") > F.col("hi")
    return (d.withColumn("lo_source", F.when(low, "rule").otherwise(F.col("lo_source")))
            .withColumn("hi_source", F.when(high, "rule").otherwise(F.col("hi_source")))
            .withColumn("lo", F.when(low, F.col("_rmin")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(high, F.col("_rmax")).otherwise(F.col("hi"))).drop("_rmin", "_rmax"))


def _impossible(ctx: Context, v: Column) -> Column:
    return F.isnan(v) | (F.abs(v) > F.lit(ctx.limits.absurd))


def check_impossible(ctx: Context, flags: DataFrame | None = None) -> DataFrame:
    """Non-finite readings or absurd magnitudes (on raw input, before nulls are normalised)."""
    d = flags.filter("impossible") if flags is not None else explode_signals(ctx, ctx.checkable(), ROW_KEYS, lambda c: _impossible(ctx, c.cast("double")))
    t = _sized(summarize(ordered.islands(d, ["batch_id", "grp", "signal"]), ["batch_id", "signal"]), ctx)
    t = t.withColumn("fraction", F.col("n") / F.col("n_rows"))
    return _check(t, "impossible_value", "validity", "fail", 0.9, F.col("n_rows"), exposure=F.col("fraction"))


def _windows25(ctx: Context) -> DataFrame:
    """Full 25-row windows of each group inside a batch, for signals whose median is far above their spread."""
    if ctx.windows is not None:
        return ctx.windows
    known = _known(ctx)
    high = {c: known[c].median for c in ctx.checkable() if c in known and (known[c].scale or 0) > 0 and known[c].median is not None and abs(known[c].median) > 3.0 * known[c].scale}
    median = F.element_at(F.create_map(*[F.lit(x) for kv in (high or {"": 0.0}).items() for x in kv]), F.col("signal"))
    win = F.floor(F.col("pos") / SHIFT_WINDOW).cast("long")
    v, n = F.col("_v"), F.size("_v")
    lo, hi = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
    d = (explode_signals(ctx, list(high), ROW_KEYS).groupBy("batch_id", "grp", "signal", win.alias("win"))
         .agg(F.sort_array(F.collect_list(F.col("value") + 0.0)).alias("_v"), F.count(F.lit(1)).alias("rows"), F.min("row").alias("row_start"), F.max("row").alias("row_end"))
         .filter(F.col("rows") == SHIFT_WINDOW))
    return d.select("batch_id", "grp", "signal", "win", F.when(lo == hi, lo).otherwise(0.5 * lo + 0.5 * hi).alias("wmed"), "rows", n.cast("long").alias("valid"),
                    F.size(F.array_distinct(v)).cast("long").alias("distinct"), "row_start", "row_end", median.alias("median"))


def shift_windows(ctx: Context) -> DataFrame:
    """Windows whose median is about 10^k times the usual median."""
    d = _windows25(ctx)
    lg = F.when(F.col("wmed") / F.col("median") != 0, F.log10(F.abs(F.col("wmed") / F.col("median"))))
    k = F.round(lg)
    return d.withColumn("k", k.cast("int")).filter((F.abs(k) >= 1) & (F.abs(lg - k) < 0.2))


def check_unit_shift(ctx: Context) -> DataFrame:
    w = shift_windows(ctx)
    runs = ordered.islands(w, ["batch_id", "grp", "signal"], pos="win", row="row_start",
                           aggs={"_end": ("max", F.col("row_end")), "_rows": ("sum", F.col("rows")), "k": ("min", F.col("k"))})
    runs = runs.withColumn("row_end", F.col("_end")).withColumn("n", F.col("_rows"))
    t = summarize(runs, ["batch_id", "signal"], [F.min("k").alias("k")])
    t = _sized(t, ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    return _check(t, "unit_shift", "validity", "fail", 0.9, F.col("n_rows"), 1.0 + 0.5 * F.col("n_events"), values={"k": F.col("k")})


def check_quantization(ctx: Context, frozen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows with far fewer distinct values than usual: (quantization_change, quantization_block)."""
    w = _windows25(ctx).filter(F.col("valid") >= max(10, SHIFT_WINDOW // 2)).withColumn("uniq", F.col("distinct") / F.col("valid"))
    ref = (w.groupBy("batch_id", "signal").agg(F.percentile("uniq", F.lit(0.5)).alias("ref"), F.count(F.lit(1)).alias("nw"))
           .filter((F.col("nw") >= 4) & (F.col("ref") >= 0.6)))
    hit = w.join(ref, ["batch_id", "signal"]).filter((F.col("uniq") < 0.5 * F.col("ref")) & (F.col("distinct") >= 2))
    runs = ordered.islands(hit, ["batch_id", "grp", "signal"], pos="win", row="row_start",
                           aggs={"_end": ("max", F.col("row_end")), "_rows": ("sum", F.col("rows")), "ratio": ("min", F.col("uniq") / F.col("ref"))})
    runs = runs.withColumn("row_end", F.col("_end")).withColumn("n", F.col("_rows")).drop("_end", "_rows", "pos_start", "pos_end")
    fz = (frozen if frozen is not None else frozen_runs(ctx)).filter("stuck_m or sat_m")
    touched = ordered.overlap_intervals(runs, fz.select("batch_id", "grp", "signal", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end")), ["batch_id", "grp", "signal"])
    cand = runs.join(touched.select("batch_id", "grp", "signal", "row_start").distinct(), ["batch_id", "grp", "signal", "row_start"], "left_anti")
    blocks = common_blocks(cand, S.common_mode_k(len(ctx.signals)), 1)
    left = _unexplained(cand, blocks)
    shifted = shift_windows(ctx).select("batch_id", "signal").distinct()
    t = summarize(left, ["batch_id", "signal"], [F.min("ratio").alias("ratio")]).join(shifted, ["batch_id", "signal"], "left_anti")
    t = _sized(t, ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    change = _check(t, "quantization_change", "validity", "warn", 0.3, F.col("n_rows"), 0.5 / F.greatest(F.col("ratio"), F.lit(1e-6)),
                    exposure=F.least(F.lit(1.0), F.col("fraction")), values={"uniqueness_ratio": F.col("ratio")})
    fam = _families(ctx, blocks)
    block = _check(fam, "quantization_block", "validity", "warn", 0.35, F.col("n") * F.greatest(F.lit(1), F.size("signals")),
                   F.col("per_block") / S.common_mode_k(len(ctx.signals)), signals=F.col("signals"))
    return change, block


def _range_flags(ctx: Context) -> DataFrame:
    """Impossible readings, and others outside the plausible range or beyond the usual spread, with their unit-shift window."""
    known, ranges = _known(ctx), {r.signal: r for r in ctx.ranges.select("signal", "lo", "hi", "span").collect()}  # a row per signal

    def flag(c: str) -> Column:
        v, k, r = F.col(c).cast("double"), known.get(c), ranges.get(c) if c in known else None
        num = lambda x: F.lit(x).cast("double")
        median, scale = (num(k[x]) if k else num(None) for x in ("median", "scale"))
        lo, hi, span = (num(r[x]) if r else num(None) for x in ("lo", "hi", "span"))
        z = F.when(scale > 0, F.abs(v - median) / scale)
        out = (v < lo) | (v > hi) | (z > ctx.limits.range_sigma)
        return F.when(F.coalesce(_impossible(ctx, v) | out, F.lit(False)), F.struct(F.lit(c).alias("signal"), v.alias("value"), median.alias("median"), scale.alias("scale"), lo.alias("lo"), hi.alias("hi"), span.alias("span")))

    none = F.array().cast("array<struct<signal:string,value:double,median:double,scale:double,lo:double,hi:double,span:double>>")
    flags = [flag(c) for c in ctx.checkable()]
    d = ctx.wide.select(*ROW_KEYS, F.explode(F.array_compact(F.array(*flags)) if flags else none).alias("_f")).select(*ROW_KEYS, "_f.*")
    v = F.col("value")
    d = d.withColumns({"z": F.when(F.col("scale") > 0, F.abs(v - F.col("median")) / F.col("scale")), "below": F.coalesce(v < F.col("lo"), F.lit(False)), "above": F.coalesce(v > F.col("hi"), F.lit(False)),
                       "impossible": _impossible(ctx, v)})
    sh = shift_windows(ctx).select("batch_id", "grp", "signal", "win").withColumn("shifted", F.lit(1))
    win = F.floor(F.col("pos") / SHIFT_WINDOW).cast("long")
    return d.withColumn("win", win).join(sh, ["batch_id", "grp", "signal", "win"], "left").withColumn("shifted", F.coalesce("shifted", F.lit(0)))


def check_plausibility(ctx: Context, flags: DataFrame | None = None) -> DataFrame:
    """Readings outside the plausible range; stretches touching a unit shift are left to that check."""
    v = F.col("value")
    d = (flags if flags is not None else _range_flags(ctx)).filter("(below or above) and not impossible")
    excess = F.when(F.col("below"), F.col("lo") - v).otherwise(v - F.col("hi"))
    isl = ordered.islands(d, ["batch_id", "grp", "signal"], aggs={
        "shifted": ("max", F.col("shifted")), "n_below": ("sum", F.col("below").cast("long")), "n_above": ("sum", F.col("above").cast("long")),
        "lowest": ("min", v), "highest": ("max", v), "excess": ("max", excess), "span": ("max", F.col("span"))}).filter("shifted = 0")
    t = summarize(isl, ["batch_id", "signal"], [F.sum("n_below").alias("n_below"), F.sum("n_above").alias("n_above"), F.min("lowest").alias("lowest"),
                                                F.max("highest").alias("highest"), F.max("excess").alias("excess"), F.max("span").alias("span")])
    t = _sized(t, ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    spans = F.col("excess") / F.col("span")
    bad = (F.col("n") >= 3) | (F.col("fraction") >= 0.001) | (spans >= 1.0)
    sev = F.least(F.lit(1.0), 0.45 + 0.35 * F.least(F.lit(1.0), F.col("fraction") / 0.02) + 0.2 * F.least(F.lit(1.0), spans))
    return _check(t, "plausibility", "validity", F.when(bad, "fail").otherwise("warn"), sev, F.col("n_rows"), 1.0 + F.col("excess") / (0.1 * F.col("span")),
                  values={"n_below": F.col("n_below"), "n_above": F.col("n_above"), "lowest": F.col("lowest"), "highest": F.col("highest"), "worst_excess": F.col("excess")})


def check_out_of_range(ctx: Context, flags: DataFrame | None = None) -> DataFrame:
    """More than ``range_sigma`` robust scales from the median, yet plausible."""
    lim = ctx.limits
    d = (flags if flags is not None else _range_flags(ctx)).filter(~F.col("impossible") & (F.col("z") > lim.range_sigma) & (~(F.col("below") | F.col("above")) | (F.col("shifted") == 1)))
    isl = ordered.islands(d, ["batch_id", "grp", "signal"], aggs={"shifted": ("max", F.col("shifted")), "max_z": ("max", F.col("z"))}).filter("shifted = 0")
    t = _sized(summarize(isl, ["batch_id", "signal"], [F.max("max_z").alias("max_z")]), ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    ratio = F.col("max_z") / lim.range_sigma
    bad = (F.col("fraction") >= 0.01) | (ratio >= 5.0)
    sev = 0.4 + 0.4 * F.least(F.lit(1.0), F.col("fraction") / 0.05) + 0.2 * F.least(F.lit(1.0), (ratio - 1.0) / 10.0)
    return _check(t, "out_of_range", "validity", F.when(bad, "fail").otherwise("warn"), sev, F.col("n_rows"), ratio, values={"max_robust_z": F.col("max_z")})


NEAR, REACH = 25, 3
BUFFER_ROWS = 100_000


def _residuals_of(f: np.ndarray, rank: np.ndarray, left: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """|residual| to the rolling median of 7 rows, the mean of the other 50 around it, and those of the rows before and after. ``rank`` and ``left``: rows before and behind
    a row in its series; ``at``: its place in an array of ``width`` where series stand NEAR places apart."""
    k = np.arange(-REACH, REACH + 1)
    padded = np.full(width, np.nan)
    padded[at] = f
    seven = np.sort(padded[at[:, None] + k], axis=1)  # what is outside the series sorts last
    n = np.minimum(rank, REACH) + 1 + np.minimum(left, REACH)
    rows = np.arange(len(f))
    a = np.abs(f - (seven[rows, (n + 1) // 2 - 1] + seven[rows, n // 2]) / 2.0)
    padded = np.zeros(width)
    padded[at] = a
    total = np.zeros(width - 2 * NEAR)
    for i in range(2 * NEAR + 1):
        total += padded[i:i + len(total)]
    others = np.minimum(rank, NEAR) + np.minimum(left, NEAR)
    return a, (total[at - NEAR] - a) / np.maximum(1, others), padded[at - 1], padded[at + 1]


def local_residuals(ctx: Context, signals: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Residuals to the rolling median of 7 rows: readings that may stand out from the 50 around them (ROW_KEYS, group_rows, signal, scale, a, near, left, right), and the
    mean residual of each batch and signal (glob) over its _n rows.

    One pass: rows come in order with a halo, numpy does the windows of a few whole series at a time. Signals without a scale have no residuals.
    """
    lim, known = ctx.limits, _known(ctx)
    signals = [s for s in signals if s in known and known[s].median is not None and (known[s].scale or 0) > 0]
    if not signals:
        empty = explode_signals(ctx, [], [*ROW_KEYS, "group_rows"])
        zero = F.lit(0.0)
        return empty.select(*ROW_KEYS, "group_rows", "signal", *[zero.alias(c) for c in ("scale", "a", "near", "left", "right")]), empty.select("batch_id", "signal", zero.alias("glob"), F.lit(0).alias("_n"))
    median, scale = [float(known[s].median) for s in signals], [float(known[s].scale) for s in signals]
    halo = NEAR + REACH + 2
    d = ordered.chunked(ctx.wide.select(*[F.col(c).cast(t) for c, t in (("batch_id", "string"), ("grp", "string"))], *[F.col(c).cast("long") for c in ("row", "pos", "group_rows")], *[F.col(s).cast("double").alias(f"_v{i}") for i, s in enumerate(signals)]), halo, halo)
    d = ordered.sorted_chunks(d)
    names = ["batch_id", "grp", "row", "pos", "group_rows", "signal", "scale", "a", "near", "left", "right", "_n"]

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """What whole series give."""
        n = t.num_rows
        starts, series = ordered.series_of(t)
        size = np.diff(np.r_[starts, n])
        rank = np.arange(n) - starts[series]
        left, at, width = size[series] - 1 - rank, np.arange(n) + NEAR * (series + 1), n + NEAR * (len(starts) + 1)
        own = t.column(ordered.OWN).to_numpy()
        batch = t.column("batch_id").combine_chunks().dictionary_encode()
        code = batch.indices.fill_null(len(batch.dictionary)).to_numpy(zero_copy_only=False)
        kinds = len(batch.dictionary) + 1
        count = np.bincount(code[own], minlength=kinds)
        some = np.flatnonzero(count[:-1])
        for i, s in enumerate(signals):
            v = t.column(f"_v{i}").combine_chunks()
            there = v.is_valid().to_numpy(zero_copy_only=False)
            a, near, before, behind = _residuals_of(v.fill_null(median[i]).to_numpy(zero_copy_only=False), rank, left, at, width)
            total = np.bincount(code[own], weights=a[own], minlength=kinds).astype(float)  # whole numbers where there are no rows
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.dictionary.take(pa.array(some)), pa.nulls(len(some), pa.string()), none, none, none, pa.array([s] * len(some), pa.string()), pa.nulls(len(some), pa.float64()), pa.array(total[some]),
                                              *[pa.nulls(len(some), pa.float64())] * 3, pa.array(count[some])], names)
            floor = np.maximum(1.2533 * near, max(lim.spike_min_scale * scale[i] / lim.spike_sigma, 1e-12))
            hit = np.flatnonzero(own & there & ~(a < (1 - 1e-9) * lim.spike_sigma * floor))  # the batch's mean comes in later
            if len(hit):
                rows = t.select(["batch_id", "grp", "row", "pos", "group_rows"]).take(pa.array(hit)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks() for c in names[:5]], pa.array([s] * len(hit), pa.string()), pa.array(np.full(len(hit), scale[i])), *[pa.array(x[hit]) for x in (a, near, before, behind)], pa.nulls(len(hit), pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in ordered.whole_series(batches, BUFFER_ROWS):
            yield from of(t)

    kinds = "batch_id string, grp string, row long, pos long, group_rows long, signal string, scale double, a double, near double, left double, right double, _n long"
    got = once(d.mapInArrow(run, kinds))
    mean = got.filter("_n IS NOT NULL").groupBy("batch_id", "signal").agg((F.sum("a") / F.sum("_n")).alias("glob"), F.sum("_n").alias("_n"))
    return got.filter("_n IS NULL").drop("_n"), mean


def check_local_spike(ctx: Context) -> DataFrame:
    """Isolated readings (at most two) that jump away from their neighbourhood and come straight back."""
    lim = ctx.limits
    keys = ["batch_id", "grp", "signal"]
    d, means = local_residuals(ctx, ctx.with_roles("continuous_measured", "derived_redundant", "unknown"))
    d = d.join(means.filter("_n >= 60").select("batch_id", "signal", "glob"), ["batch_id", "signal"])
    floor = lim.spike_min_scale * F.col("scale") / lim.spike_sigma
    local = F.greatest(1.2533 * F.col("near"), 0.5 * 1.2533 * F.col("glob"), floor, F.lit(1e-12))
    cand = d.withColumn("z", F.col("a") / local).filter(F.col("z") > lim.spike_sigma)
    isl = ordered.islands(cand, keys, aggs={"peak": ("max", F.col("a")), "max_z": ("max", F.col("z")), "_left": ("min", F.struct("pos", F.coalesce("left", F.lit(0.0)).alias("a"))),
                                            "_right": ("max", F.struct("pos", F.coalesce("right", F.lit(0.0)).alias("a"))), "group_rows": ("max", F.col("group_rows"))})
    around = Window.partitionBy(*keys).orderBy("pos_start").rangeBetween(-20, 20)
    isl = isl.withColumn("_near", F.count(F.lit(1)).over(around) - 1)
    isl = isl.filter((F.col("n") <= lim.spike_max_len) & (F.col("_near") < 2) & (F.col("pos_start") >= 4) & (F.col("pos_end") <= F.col("group_rows") - 4)
                     & (F.greatest(F.col("_left.a"), F.col("_right.a")) < 0.4 * F.col("peak")))
    t = _sized(summarize(isl, ["batch_id", "signal"], [F.max("max_z").alias("max_z")]), ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    sev = F.least(F.lit(0.7), 0.25 + 0.03 * F.col("n") + 0.01 * F.least(F.lit(20.0), F.col("max_z")))
    return _check(t, "local_spike", "validity", F.when(F.col("n") >= 10, "fail").otherwise("warn"), sev, F.col("n_rows"), F.col("max_z") / lim.spike_sigma, values={"max_local_z": F.col("max_z")})


# ------------------------------------------------------------------ runs of identical readings
def frozen_runs(ctx: Context) -> DataFrame:
    """Runs long enough to matter, with the thresholds of their signal and whether they sit at a global limit."""
    lim = ctx.limits
    signals = ctx.checkable()
    min_keep = max(2, lim.stuck_min_run // 3)
    lens = {s: ctx.holds.get(s, 0) for s in signals}
    keep = min([min_keep] + [2 * h for h in lens.values() if h > 1])
    runs = ordered.value_runs(ctx.wide, ["grp"], signals, min_len=max(2, keep), carry=["batch_id"])
    hold = F.lit(None).cast("int")
    stuck_thr, sat_thr = F.lit(lim.stuck_min_run), F.lit(lim.stuck_min_run)
    for s in signals:
        this, h, actuator = F.col("signal") == s, ctx.holds.get(s, 0), ctx.role(s) == "actuator_like"
        base = max(lim.stuck_min_run, 4 * h) if h > 1 else lim.stuck_min_run
        if h > 1:
            hold = F.when(this, h).otherwise(hold)
        stuck_thr = F.when(this, max(base, 20 * lim.stuck_min_run) if actuator else base).otherwise(stuck_thr)
        sat_thr = F.when(this, 4 * lim.stuck_min_run if actuator else base).otherwise(sat_thr)
    d = runs.join(F.broadcast(ctx.stats.select("signal", F.col("min").alias("gmin"), F.col("max").alias("gmax"))), "signal")
    tol = 1e-9 * F.greatest(F.lit(1.0), F.abs("gmin"), F.abs("gmax"))
    at_max, at_min = F.abs(F.col("value") - F.col("gmax")) <= tol, F.abs(F.col("value") - F.col("gmin")) <= tol
    d = d.withColumns({"sat": at_min | at_max, "at_min": at_min, "hold": hold, "stuck_thr": stuck_thr, "sat_thr": sat_thr})
    d = d.filter(F.col("n") >= F.greatest(F.lit(min_keep), 2 * F.coalesce("hold", F.lit(0)))) if not any(h > 1 for h in lens.values()) else d
    return d.withColumns({"stuck_m": ~F.col("sat") & (F.col("n") >= F.col("stuck_thr")), "sat_m": F.col("sat") & (F.col("n") >= F.col("sat_thr"))})


def common_blocks(intervals: DataFrame, k: int, min_len: int, share: float = 0.5) -> DataFrame:
    """Stretches where at least k signals carry an interval: a sweep over interval bounds.

    ``intervals``: batch_id, grp, signal, row_start, row_end. Returns batch_id, grp, row_start, row_end,
    n, members (sorted, members cover half of the block or have half of their own interval in it).
    """
    keys = ["batch_id", "grp"]
    ends = intervals.select(*keys, F.explode(F.array(
        F.struct(F.col("row_start").alias("p"), F.lit(1).alias("d")), F.struct((F.col("row_end") + 1).alias("p"), F.lit(-1).alias("d")))).alias("e"))
    net = ends.groupBy(*keys, F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("p")
    seg = net.withColumns({"cov": F.sum("d").over(w), "q": F.lead("p").over(w)}).filter((F.col("cov") >= k) & F.col("q").isNotNull())
    new = F.when(F.lag("q").over(w) == F.col("p"), 0).otherwise(1)
    seg = seg.withColumn("_new", new).withColumn("_id", F.sum("_new").over(w))
    blocks = (seg.groupBy(*keys, "_id").agg(F.min("p").alias("b_start"), (F.max("q") - 1).alias("b_end"))
              .withColumn("b_n", F.col("b_end") - F.col("b_start") + 1).filter(F.col("b_n") >= min_len).drop("_id"))
    pairs = ordered.overlap_intervals(intervals.select(*keys, "signal", "row_start", "row_end"), blocks, keys)
    inside = F.least("row_end", "b_end") - F.greatest("row_start", "b_start") + 1
    mem = (pairs.groupBy(*keys, "b_start", "b_end", "b_n", "signal")
           .agg(F.sum(inside).alias("ov"), F.sum(F.col("row_end") - F.col("row_start") + 1).alias("own"))
           .filter((F.col("ov") >= share * F.col("b_n")) | (F.col("ov") >= share * F.col("own"))))
    return (mem.groupBy(*keys, "b_start", "b_end", "b_n").agg(F.sort_array(F.collect_set("signal")).alias("members"))
            .filter(F.size("members") >= k)
            .select(*keys, F.col("b_start").alias("row_start"), F.col("b_end").alias("row_end"), F.col("b_n").alias("n"), "members"))


def _unexplained(intervals: DataFrame, blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """Intervals of which less than half lies inside the common blocks of their batch."""
    b = blocks.select("batch_id", "grp", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end"))
    iv = intervals.select("batch_id", "grp", "signal", "row_start", "row_end")
    inside = F.least("row_end", "b_end") - F.greatest("row_start", "b_start") + 1
    hit = (ordered.overlap_intervals(iv, b, ["batch_id", "grp"]).groupBy("batch_id", "grp", "signal", "row_start", "row_end").agg(F.sum(inside).alias("ov"))
           .filter(F.col("ov") >= share * (F.col("row_end") - F.col("row_start") + 1)))
    return intervals.join(hit.select("batch_id", "grp", "signal", "row_start"), ["batch_id", "grp", "signal", "row_start"], "left_anti")


def cluster_blocks(blocks: DataFrame, jaccard: float = 0.5, max_clusters: int = 5) -> DataFrame:
    """Family number of each distinct member set of a batch: sets are taken in order of their first block and
    join the most similar family. Only the distinct sets of a batch reach the grouped step."""
    sets = blocks.groupBy("batch_id", "members").agg(F.min("row_start").alias("first_row"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        reps: list[set] = []
        out = []
        for m in pdf.sort_values("first_row")["members"]:
            s = set(m)
            scores = [len(s & r) / max(1, len(s | r)) for r in reps]
            best = max(range(len(scores)), key=scores.__getitem__) if scores else -1
            if best < 0 or (scores[best] < jaccard and len(reps) < max_clusters):
                reps.append(s)
                best = len(reps) - 1
            out.append((list(m), best))
        return pd.DataFrame({"batch_id": pdf["batch_id"].iloc[0], "members": [m for m, _ in out], "family": [f for _, f in out]})

    return sets.groupBy("batch_id").applyInPandas(greedy, "batch_id string, members array<string>, family int")


def _families(ctx: Context, blocks: DataFrame) -> DataFrame:
    fam = cluster_blocks(blocks)
    b = blocks.join(fam, ["batch_id", "members"])
    t = summarize(b, ["batch_id", "family"], [
        F.max("n").alias("longest"), F.percentile(F.size("members"), F.lit(0.5)).alias("per_block")])
    sig = b.select("batch_id", "family", F.explode("members").alias("s")).groupBy("batch_id", "family").agg(F.sort_array(F.collect_set("s")).alias("signals"))
    return _sized(t.join(sig, ["batch_id", "family"]), ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))


def frozen_blocks(ctx: Context, runs: DataFrame | None = None) -> DataFrame:
    r = runs if runs is not None else frozen_runs(ctx)
    return common_blocks(r.filter("stuck_m or sat_m"), S.common_mode_k(len(ctx.signals)), max(2, ctx.limits.stuck_min_run // 2))


def check_frozen_block(ctx: Context, runs: DataFrame | None = None, duplicates: DataFrame | None = None,
                       blocks: DataFrame | None = None) -> DataFrame:
    """Rows frozen in several signals at once: one finding per family of blocks."""
    lim, k = ctx.limits, S.common_mode_k(len(ctx.signals))
    r = runs if runs is not None else frozen_runs(ctx)
    blocks = blocks if blocks is not None else frozen_blocks(ctx, r)
    fam = _families(ctx, blocks)
    dup = (duplicates if duplicates is not None else duplicate_flags(ctx)).select("batch_id", "row")
    iv = blocks.select("batch_id", "members", "row_start", "row_end").join(cluster_blocks(blocks), ["batch_id", "members"])
    also = ordered.join_intervals(dup, iv, ["batch_id"]).groupBy("batch_id", "family").agg(F.count(F.lit(1)).alias("also_dup"))
    find = F.col("stuck_m") | F.col("sat_m")
    inside = F.least("row_end", "b_end") - F.greatest("row_start", "b_start") + 1
    pairs = ordered.overlap_intervals(r.filter(find).select("batch_id", "signal", "row_start", "row_end"),
                                      iv.select("batch_id", "family", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end")), ["batch_id"])
    full = pairs.groupBy("batch_id", "family", "signal", "row_start", "row_end").agg(F.sum(inside).alias("ov"))
    length = F.col("row_end") - F.col("row_start") + 1
    mem = (full.filter(F.col("ov") >= 0.5 * length).groupBy("batch_id", "family", "signal").agg(F.sum(length).alias("rows"))
           .groupBy("batch_id", "family").agg(F.map_from_entries(F.collect_list(F.struct("signal", "rows"))).alias("mem")))
    t = fam.join(also, ["batch_id", "family"], "left").join(mem, ["batch_id", "family"], "left")
    t = t.withColumn("record_fraction", F.greatest(F.lit(0), F.col("n") - F.coalesce("also_dup", F.lit(0))) / F.col("n_rows"))
    frac = F.col("fraction")
    bad = (frac >= 0.005) | (F.col("longest") >= 10 * lim.stuck_min_run)
    return _check(t, "frozen_block", "consistency", F.when(bad, "fail").otherwise("warn"), 0.5 + 0.5 * F.least(F.lit(1.0), frac / lim.record_share),
                  F.col("n") * F.greatest(F.lit(1), F.size("signals")), F.col("per_block") / k, signals=F.col("signals"), members=F.col("mem"),
                  values={"n_blocks": F.col("n_events"), "longest_block": F.col("longest"), "signals_per_block": F.col("per_block")})


def check_runs(ctx: Context, runs: DataFrame | None = None, blocks: DataFrame | None = None) -> dict[str, DataFrame]:
    """``stuck``, ``saturation`` and ``stale``: what is left of the runs after the common blocks."""
    lim = ctx.limits
    r = runs if runs is not None else frozen_runs(ctx)
    left = _unexplained(r, blocks if blocks is not None else frozen_blocks(ctx, r))
    by = ["batch_id", "signal"]
    aggs = [F.max("n").alias("longest"), F.max("stuck_thr").alias("thr"), F.max("sat_thr").alias("sthr"), F.max("hold").alias("hold"),
            F.max_by("value", F.struct("n", -F.col("row_start"))).alias("value"),
            F.max_by("row_start", F.struct("n", -F.col("row_start"))).alias("l_start"), F.max_by("at_min", F.struct("n", -F.col("row_start"))).alias("l_min")]
    st = _sized(summarize(left.filter("stuck_m"), by, aggs), ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    frac, longest, thr = F.col("fraction"), F.col("longest"), F.col("thr")
    sev = F.least(F.lit(1.0), 0.15 + 0.45 * F.least(F.lit(1.0), frac / lim.stuck_fraction_warn) + 0.4 * F.least(F.lit(1.0), longest / (10.0 * thr)))
    bad = (frac >= 0.02) | ((longest >= 10 * thr) & (frac >= 0.005))
    stuck = _check(st, "stuck", "consistency", F.when(bad, "fail").otherwise("warn"), sev, F.col("n_rows"), longest / thr,
                   values={"longest_run": longest, "value": F.col("value"), "threshold": thr})
    actuators = ctx.with_roles("actuator_like") or [""]
    sa = _sized(summarize(left.filter("sat_m"), by, aggs), ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    sbad = (longest >= 3 * F.col("sthr")) & ~F.col("signal").isin(actuators)
    saturation = _check(sa, "saturation", "consistency", F.when(sbad, "fail").otherwise("warn"), F.when(sbad, 0.7).otherwise(0.35), F.col("n_rows"),
                        longest / F.col("sthr"), row_start=F.col("l_start"), row_end=F.col("l_start") + longest - 1,
                        values={"longest_run": longest, "value": F.col("value"), "at_minimum": F.col("l_min").cast("double")})
    stale_rows = left.filter(F.col("hold").isNotNull() & ~F.col("sat") & (F.col("n") > 2 * F.col("hold")))
    ss = _sized(summarize(stale_rows, by, aggs), ctx).join(st.select(*by), by, "left_anti").withColumn("fraction", F.col("n") / F.col("n_rows"))
    stale = _check(ss, "stale", "timeliness", "warn", 0.4, F.col("n_rows"), longest / (2.0 * F.col("hold")), row_start=F.col("l_start"),
                   row_end=F.col("l_start") + longest - 1, values={"longest_run": longest, "hold_period": F.col("hold")})
    return {"stuck": stuck, "saturation": saturation, "stale": stale}


# ------------------------------------------------------------------ records
def duplicate_flags(ctx: Context, keys: Sequence[str] | None = None, salt: int = 32) -> DataFrame:
    """Rows that repeat an earlier row of their batch. Hashes of contents are counted first, so only rows that share theirs travel whole; of these,
    repeated contents are joined back, spread over ``salt`` slots so one content may hold any share of the rows."""
    cols = list(keys) if keys else [*ctx.signals, *([ctx.time] if ctx.time else [])]
    enc = [F.struct(F.col(c)).alias(f"_e{i}") for i, c in enumerate(cols)]  # structs make NULL equal to NULL
    ek = [f"_e{i}" for i in range(len(cols))]
    kinds = dict(ctx.wide.dtypes)
    key = F.xxhash64(*[F.col(c) + 0.0 if kinds[c] in ("double", "float") else F.col(c) for c in cols])  # 0 and -0 are one value
    d = ctx.wide.select(*ROW_KEYS, *enc, key.alias("_h"))
    again = once(d.groupBy("batch_id", "_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    n_keys, n_rows = again.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    d = d.join(F.broadcast(again.drop("_n")) if n_keys <= FEW_KEYS else again.drop("_n"), ["batch_id", "_h"], "left_semi").drop("_h")
    d = once(d) if n_rows <= FEW_ROWS else d
    rep = d.groupBy("batch_id", *ek).agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    rep = rep.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    d = d.withColumn("_slot", F.pmod("row", F.lit(salt)).cast("int"))
    return d.join(rep, ["batch_id", *ek, "_slot"]).filter(F.col("row") > F.col("_first")).select(*ROW_KEYS)


def check_duplicate_rows(ctx: Context, flags: DataFrame | None = None) -> DataFrame:
    d = flags if flags is not None else duplicate_flags(ctx)
    t = _sized(summarize(ordered.islands(d, ["batch_id", "grp"]), ["batch_id"]), ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    frac = F.col("fraction")
    return _check(t, "duplicate_rows", "consistency", F.when(frac >= 0.01, "fail").otherwise("warn"), F.least(F.lit(1.0), 0.3 + 20 * frac), F.col("n_rows"))


def check_duplicate_key(ctx: Context, order: str, dup_rows: DataFrame | None = None) -> DataFrame:
    """Rows repeating an existing (group, order) key; those that are exact copies as well count once for trust."""
    d = duplicate_flags(ctx, ["grp", order])
    copies = (dup_rows if dup_rows is not None else duplicate_flags(ctx)).select("batch_id", "row").withColumn("_dup", F.lit(1))
    d = d.join(copies, ["batch_id", "row"], "left").withColumn("_dup", F.coalesce("_dup", F.lit(0)))
    isl = ordered.islands(d, ["batch_id", "grp"], aggs={"_dup": ("sum", F.col("_dup"))})
    t = _sized(summarize(isl, ["batch_id"], [F.sum("_dup").alias("_dup")]), ctx).withColumn("fraction", F.col("n") / F.col("n_rows"))
    t = t.withColumn("record_fraction", (F.col("n") - F.col("_dup")) / F.col("n_rows"))
    frac = F.col("fraction")
    return _check(t, "duplicate_key", "consistency", F.when(frac < 0.01, "warn").otherwise("fail"), F.least(F.lit(1.0), 0.3 + 10 * frac), F.col("n_rows"),
                  values={"rows_also_duplicate": F.col("_dup")})


# ------------------------------------------------------------------ time
def time_steps(wide: DataFrame, time: str, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Seconds since the previous row of the group in the same batch."""
    sec = F.unix_micros(F.col(time)) / F.lit(1e6)
    d = wide.select(*dict.fromkeys([*keys, "batch_id", "row", "pos"]), sec.alias("_t"))
    d = ordered.with_windows(d, list(keys), lambda w: {"_p": F.lag(F.struct("batch_id", "row", "_t")).over(w)}, before=1)
    return (d.filter(F.col("_p.batch_id") == F.col("batch_id"))
            .select(*dict.fromkeys([*keys, "batch_id"]), "row", "pos", F.col("_p.row").alias("prev_row"), (F.col("_t") - F.col("_p._t")).alias("step"))
            .filter(F.col("step").isNotNull()))


def step_counts(wide: DataFrame, time: str) -> DataFrame:
    """batch_id, step and n: how often each step occurs. Counts are combined before they travel."""
    return time_steps(wide, time).groupBy("batch_id", "step").agg(F.count(F.lit(1)).alias("n"))


def check_time(ctx: Context) -> dict[str, DataFrame]:
    """``gap``, ``out_of_order``, ``duplicate_timestamp``, ``irregular_sampling``."""
    lim = ctx.limits
    step, per = F.col("step"), F.col("period")
    gap = step > lim.gap_factor * per
    odd = (F.abs(step - per) > 0.2 * per) & ~gap & (step > 0)
    steps = ctx.steps if ctx.steps is not None else step_counts(ctx.wide, ctx.time)
    n_steps = once(steps.crossJoin(F.broadcast(ctx.period)).groupBy("batch_id").agg(F.sum("n").alias("n_steps"), F.sum(F.when(odd, F.col("n"))).alias("n_odd"), F.max("period").alias("period")))
    d = once(time_steps(ctx.wide, ctx.time).crossJoin(F.broadcast(ctx.period)).filter(gap | (step <= 0)))  # the rows that are findings

    def events(cond: Column, aggs: dict | None = None, extra: Sequence[Column] = ()) -> DataFrame:
        t = summarize(ordered.islands(d.filter(cond), ["batch_id", "grp"], aggs=aggs), ["batch_id"], list(extra))
        return t.join(n_steps, "batch_id").withColumn("fraction", F.col("n") / F.col("n_steps"))

    back = events(step < 0)
    out = {"out_of_order": _check(back, "out_of_order", "timeliness", "fail", 0.6, F.col("n_steps"))}
    same = events(step == 0)
    many = F.col("fraction") >= 0.05
    out["duplicate_timestamp"] = _check(same, "duplicate_timestamp", "timeliness", F.when(many, "fail").otherwise("warn"), F.when(many, 0.6).otherwise(0.3), F.col("n_steps"))
    gaps = d.filter(gap).select("batch_id", F.col("prev_row").alias("row_start"), F.col("row").alias("row_end"), F.lit(1).cast("long").alias("n"), step.alias("step"))
    g = summarize(gaps, ["batch_id"], [F.max("step").alias("max_gap")]).join(n_steps, "batch_id")
    big = F.col("max_gap") / F.col("period")
    out["gap"] = _check(g, "gap", "timeliness", F.when(big >= 20, "fail").otherwise("warn"), F.when(big >= 20, 0.7).otherwise(0.4), F.col("n_steps"), big / lim.gap_factor,
                        values={"max_gap_s": F.col("max_gap"), "period_s": F.col("period")})
    irr = n_steps.withColumn("fraction", F.col("n_odd") / F.col("n_steps")).withColumn("n", F.col("n_odd")).filter("fraction >= 0.05")
    out["irregular_sampling"] = _check(irr, "irregular_sampling", "timeliness", "warn", 0.3, F.col("n_steps"), F.col("fraction") / 0.05, values={"period_s": F.col("period")})
    return out


def check_timeliness_testable(ctx: Context) -> DataFrame:
    """A batch without usable timestamps is neither passed nor failed on timeliness."""
    usable = F.count(F.col(ctx.time)) if ctx.time else F.lit(0)
    t = ctx.wide.groupBy("batch_id").agg(usable.alias("_ok"), F.count(F.lit(1)).alias("n_rows")).filter("_ok < 2")
    c = _check(t, "timeliness_not_testable", "timeliness", "not_testable", 0.0, F.col("n_rows"))
    return c.withColumn("confidence", F.lit(0.0))


# ------------------------------------------------------------------ relations
def check_relation_pairs(ctx: Context, pairs: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Normally redundant pairs that no longer agree inside a batch."""
    strong = [(a, b, r) for a, b, r in pairs if abs(r) >= 0.98]
    aggs = []
    for i, (a, b, _) in enumerate(strong):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r{i}"), F.sum(both.cast("long")).alias(f"n{i}")]
    d = ctx.wide.groupBy("batch_id").agg(*aggs)
    t = d.select("batch_id", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(r)).alias("expected"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
                                                 for i, (a, b, r) in enumerate(strong)])).alias("p")).select("batch_id", "p.*")
    t = _sized(t.filter((F.col("n") >= 10) & (F.abs("r") < 0.9)), ctx)
    bad = F.abs("r") < 0.7
    return _check(t, "relation_break", "consistency", F.when(bad, "fail").otherwise("warn"), F.when(bad, 0.7).otherwise(0.5), F.col("n"), 0.9 / F.greatest(F.abs("r"), F.lit(0.05)),
                  signals=F.array("a", "b"), exposure=F.least(F.lit(1.0), F.col("n") / F.col("n_rows")), values={"r_batch": F.col("r"), "r_expected": F.col("expected")})


def check_relation_derived(ctx: Context, formulas: Sequence[tuple[str, dict[str, float], float]]) -> DataFrame:
    """Signals that no longer match the linear formula they are derived from."""
    parts = []
    for target, coef, icpt in formulas:
        resid = F.col(target) - reduce(lambda x, y: x + y, [F.lit(c) * F.col(s) for s, c in coef.items()], F.lit(icpt))
        parts.append(ctx.wide.groupBy("batch_id").agg(F.sqrt(F.avg(resid * resid)).alias("rms"), F.count(resid).alias("n")).withColumn("signal", F.lit(target)))
    d = reduce(DataFrame.unionByName, parts).join(F.broadcast(ctx.stats.select("signal", "scale")), "signal")
    t = d.filter((F.col("n") >= 10) & (F.col("scale") > 0) & (F.col("rms") > 0.5 * F.col("scale")))
    bad = F.col("rms") >= F.col("scale")
    return _check(t, "relation_break", "consistency", F.when(bad, "fail").otherwise("warn"), F.when(bad, 0.7).otherwise(0.5), F.col("n"), F.col("rms") / (0.5 * F.col("scale")),
                  exposure=F.lit(1.0), values={"rms_residual": F.col("rms"), "scale": F.col("scale")})


def add_passes(checks: DataFrame, ctx: Context) -> DataFrame:
    """A pass row for every category without a finding in a batch."""
    cats = ctx.sizes.select("batch_id", "n_rows", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    found = checks.filter("status <> 'pass'").select("batch_id", "category").distinct()
    p = cats.join(found, ["batch_id", "category"], "left_anti")
    return checks.unionByName(_check(p, F.concat("category", F.lit("_ok")), F.col("category"), "pass", 0.0, F.col("n_rows") * len(ctx.signals)))


def run_checks(ctx: Context, pairs: Sequence[tuple[str, str, float]] = (), formulas: Sequence[tuple[str, dict[str, float], float]] = (),
               order: str | None = None, passes: bool = False) -> DataFrame:
    """All checks on all batches."""
    runs, dups, windows = once(frozen_runs(ctx)), once(duplicate_flags(ctx)), once(_windows25(ctx))
    ctx = replace(ctx, windows=windows, nulls=null_rows(ctx), sizes=once(ctx.sizes), period=once(ctx.period) if ctx.period is not None else None)
    blocks, flags = once(frozen_blocks(ctx, runs)), once(_range_flags(ctx))
    change, qblock = check_quantization(ctx, runs)
    parts = [check_missing(ctx), check_empty_rows(ctx), check_missing_block(ctx), check_impossible(ctx, flags), check_plausibility(ctx, flags),
             check_out_of_range(ctx, flags), check_local_spike(ctx), check_unit_shift(ctx), change, qblock,
             check_frozen_block(ctx, runs, dups, blocks), *check_runs(ctx, runs, blocks).values(), check_duplicate_rows(ctx, dups)]
    if order:
        parts.append(check_duplicate_key(ctx, order, dups))
    if ctx.time:
        parts += [*check_time(ctx).values(), check_timeliness_testable(ctx)]
    if pairs:
        parts.append(check_relation_pairs(ctx, pairs))
    if formulas:
        parts.append(check_relation_derived(ctx, formulas))
    out = reduce(DataFrame.unionByName, parts)
    return add_passes(out, ctx) if passes else out


def report(checks: DataFrame) -> DataFrame:
    """The flat part of the check columns."""
    return checks.select("check_type", "batch_id", F.array_join("signals", "+").alias("signal"), "status", F.round("severity", 4).alias("severity"),
                         "row_start", "row_end", "n", F.round("fraction", 6).alias("fraction"), "confidence")
