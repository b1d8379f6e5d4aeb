"""From findings to trust: exposure, verdict per batch, untrusted signals and rows, run summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: how finding types are counted
BATCH_LEVEL = ["duplicate_rows", "duplicate_key", "gap", "out_of_order", "duplicate_timestamp", "irregular_sampling", "empty_rows"]
RECORD_LEVEL = ["duplicate_rows", "duplicate_key", "frozen_block", "missing_block", "empty_rows"]
DUPLICATES = ["duplicate_rows", "duplicate_key"]
DQ_RULES = ["missing", "stuck"]


@dataclass(frozen=True)
class TrustLimits:
    fail: float = 0.5
    critical_share: float = 0.3
    local_severity: float = 0.35
    batch_exposure: float = 0.25
    duplicate_scope: float = 0.02
    record_share: float = 0.10


def exposure(checks: DataFrame) -> DataFrame:
    """Problems only, with the share of rows they touch and the severity weighted by it."""
    expo = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("exposure", F.lit(1.0))))
    d = checks.filter(F.col("status").isin("warn", "fail")).withColumn("expo", expo)
    return d.withColumn("effective_severity", F.col("severity") * (0.15 + 0.85 * F.col("expo")))


def _weighed(checks: DataFrame, sizes: DataFrame, lim: TrustLimits) -> DataFrame:
    """Each problem with its record-level, batch-level and signal-level contribution."""
    d = exposure(checks).join(sizes.select("batch_id", "n_rows"), "batch_id")
    record, dup = F.col("check_type").isin(RECORD_LEVEL), F.col("check_type").isin(DUPLICATES)
    own = F.when(F.col("record_fraction").isNotNull(), F.least("expo", F.greatest(F.lit(0.0), "record_fraction"))).otherwise(F.col("expo"))
    scoped = record & (~dup | (F.col("expo") >= lim.duplicate_scope))
    batch = ~record & (F.col("check_type").isin(BATCH_LEVEL) | (F.size("signals") == 0))
    fail = F.col("status") == "fail"
    wide = (F.col("expo") >= lim.batch_exposure) | (F.col("effective_severity") >= lim.local_severity)
    return d.withColumns({
        "record": record, "scoped": scoped, "record_own": F.when(record, own).otherwise(0.0), "row_scoped": F.when(scoped, own).otherwise(0.0),
        "batch_sev": F.when(batch & fail, F.col("severity")).otherwise(0.0), "signal_level": ~record & ~batch, "failed": fail, "batch_wide": wide})


def _signals(weighed: DataFrame, lim: TrustLimits) -> DataFrame:
    """(batch, signal) -> weight when untrusted for the whole batch, else whether it only warned."""
    d = weighed.filter(F.size("signals") > 0).withColumn("signal", F.explode("signals"))
    share = F.when(F.col("members").isNotNull() & F.element_at("members", F.col("signal")).isNotNull(),
                   F.least(F.lit(1.0), F.element_at("members", F.col("signal")) / F.col("n_rows"))).otherwise(F.col("expo"))
    rec = F.when(F.col("scoped") & (share >= lim.batch_exposure), F.col("severity") * (0.5 + 0.5 * share))
    own = F.when(F.col("signal_level") & F.col("failed") & F.col("batch_wide"),
                 F.greatest(F.col("effective_severity"), F.col("severity") * (0.5 + 0.5 * F.col("expo"))))
    warn = F.col("signal_level") & ~(F.col("failed") & F.col("batch_wide"))
    return d.groupBy("batch_id", "signal").agg(F.max(F.coalesce(rec, own)).alias("weight"), F.max(warn.cast("int")).alias("warned"))


def trust_verdicts(checks: DataFrame, sizes: DataFrame, n_signals: int, lim: TrustLimits = TrustLimits()) -> DataFrame:
    """One verdict per batch. ``checks`` should be a written table: it is read twice."""
    w = _weighed(checks, sizes, lim)
    per_sig = _signals(w, lim).groupBy("batch_id").agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("sig_sum"), F.count("weight").alias("n_untrusted"),
        F.sum(F.when(F.col("weight").isNull(), F.col("warned")).otherwise(0)).alias("n_warned"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("weight").isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col("signal").alias("s"))))), lambda x: x["s"]).alias("untrusted_signals"))
    per_batch = w.groupBy("batch_id").agg(F.least(F.lit(1.0), F.sum("record_own")).alias("record_share"), F.least(F.lit(1.0), F.sum("row_scoped")).alias("row_scoped_share"),
                                          F.max("batch_sev").alias("batch_sev"), F.sum((F.col("status") == "fail").cast("int")).alias("n_fail"), F.sum((F.col("status") == "warn").cast("int")).alias("n_warn"))
    d = sizes.select("batch_id", "n_rows").join(per_batch, "batch_id", "left").join(per_sig, "batch_id", "left")
    d = d.na.fill(0.0, ["record_share", "row_scoped_share", "batch_sev", "sig_sum"]).na.fill(0, ["n_untrusted", "n_warned", "n_fail", "n_warn"])
    d = d.withColumns({
        "signal_penalty": 0.7 * F.least(F.lit(1.0), F.col("sig_sum") / n_signals / lim.critical_share),
        "record_penalty": (1.0 - lim.fail) * F.least(F.lit(1.0), F.col("record_share") / lim.record_share),
        "batch_penalty": 0.3 * F.least(F.lit(1.0), F.col("batch_sev")), "warn_penalty": F.least(F.lit(0.1), 0.1 * F.col("n_warned") / n_signals)})
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("signal_penalty") - F.col("record_penalty") - F.col("batch_penalty") - F.col("warn_penalty")))
    whole = F.col("record_share") >= lim.record_share
    d = d.withColumn("_s", score).withColumn("trust_score", F.when(whole & (F.col("_s") >= lim.fail), F.lit(lim.fail - 0.05)).otherwise(F.col("_s")))
    return d.withColumn("trusted", (F.col("trust_score") >= lim.fail) & ~whole).withColumn("untrusted_signals", F.coalesce("untrusted_signals", F.array().cast("array<string>"))).drop("_s", "sig_sum")


def untrusted(checks: DataFrame, sizes: DataFrame, lim: TrustLimits = TrustLimits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batch-wide untrusted signals, row-scoped ranges per signal, row ranges untrusted for every signal)."""
    w = _weighed(checks, sizes, lim)
    signals = _signals(w, lim).filter("weight is not null").select("batch_id", "signal", "weight")
    span = F.array(F.struct(F.col("row_start").alias("row_start"), F.col("row_end").alias("row_end")))
    w = w.withColumn("_ev", F.when(F.size("events") > 0, F.col("events")).when(F.col("row_start").isNotNull(), span))
    share = F.coalesce(F.element_at("members", F.col("signal")) / F.col("n_rows"), F.col("expo"))
    per = w.filter(F.size("signals") > 0).withColumn("signal", F.explode("signals"))
    local = (per.filter((F.col("signal_level") & F.col("failed")) | (F.col("scoped") & (share < lim.batch_exposure)))
             .select("batch_id", "signal", "check_type", F.col("severity"), F.explode("_ev").alias("e")).select("batch_id", "signal", "check_type", "severity", "e.row_start", "e.row_end"))
    rows = w.filter("scoped").select("batch_id", "check_type", F.explode("_ev").alias("e")).select("batch_id", "check_type", "e.row_start", "e.row_end")
    return signals, local, rows


def signal_trust(trust: DataFrame) -> DataFrame:
    """In how many batches each signal was untrusted."""
    n = trust.agg(F.count(F.lit(1)).alias("n_batches"))
    d = trust.select("batch_id", F.explode("untrusted_signals").alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n_untrusted"))
    return d.crossJoin(F.broadcast(n)).withColumn("fraction", F.col("n_untrusted") / F.col("n_batches"))


def problem_weights(checks: DataFrame) -> DataFrame:
    """Severity times the covered share, per problem type (failing checks only)."""
    share = F.greatest(F.coalesce("record_fraction", "fraction", F.lit(0.01)), F.lit(1e-6))
    kind: Column = F.when(F.col("check_type").startswith("rule"), "rule").otherwise(F.col("check_type"))
    return checks.filter("status = 'fail'").groupBy(kind.alias("problem")).agg(F.sum(F.col("severity") * share).alias("weight"))


def dominant_problem(checks: DataFrame) -> DataFrame:
    return problem_weights(checks).orderBy(F.desc("weight"), "problem").limit(1)


def run_verdict(trust: DataFrame, local: DataFrame) -> DataFrame:
    """untrusted | partly_untrusted | usable_with_problems | clean, for the whole run."""
    loc = local.join(trust.filter("trusted").select("batch_id"), "batch_id", "left_semi").agg(F.count_distinct("signal").alias("n_local_signals"))
    t = trust.agg(F.count(F.lit(1)).alias("n_batches"), F.sum((~F.col("trusted")).cast("int")).alias("n_untrusted"),
                  F.sum("n_rows").alias("total"), F.sum(F.when(~F.col("trusted"), F.col("n_rows")).otherwise(0)).alias("bad_rows"),
                  F.sum(F.when(F.col("trusted"), F.col("row_scoped_share") * F.col("n_rows")).otherwise(0.0)).alias("scoped_rows"),
                  F.sum("n_fail").alias("n_fail"), F.sum("n_warn").alias("n_warn")).crossJoin(F.broadcast(loc))
    bad, scoped = F.col("bad_rows") / F.col("total"), F.col("scoped_rows") / F.col("total")
    v = (F.when((F.col("n_untrusted") > 0) & (bad >= 0.5), "untrusted").when(F.col("n_untrusted") > 0, "partly_untrusted")
         .when((F.col("n_fail") > 0) | (scoped > 0) | (F.col("n_local_signals") > 0), "usable_with_problems").otherwise("clean"))
    return t.select(v.alias("verdict"), "n_batches", "n_untrusted", bad.alias("untrusted_row_share"), scoped.alias("row_scoped_share"), "n_fail", "n_warn", "n_local_signals")


def trust_series(trust: DataFrame, n: int) -> DataFrame:
    """Lowest score of each of n consecutive stretches of batches (one row per batch, so one task is enough)."""
    b = F.ntile(n).over(Window.orderBy("batch_id"))
    return (trust.withColumn("bucket", b).groupBy("bucket")
            .agg(F.min("batch_id").alias("first_batch"), F.min("trust_score").alias("min_score"), F.bool_and("trusted").alias("all_trusted")))
