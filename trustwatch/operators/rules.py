"""Operating rules: closed specs in, violation episodes and one check per (rule, batch) out.

All active rules are evaluated in one pass over the wide rows; only violating rows become long.
Episodes never cross a group boundary.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.functions.compare import OPS, cmp
from trustwatch.operators import ordered

# fixed values: the closed rule schema
TYPES = ["range", "rate_of_change", "acceleration", "duration", "cross_signal", "rolling_stat", "missing", "stuck", "drift"]
STATS = ["mean", "std", "min", "max"]
CONDITIONS = ["above", "below", "between", "missing", "constant"]
DEFAULT_SEVERITY = 0.7

SCHEMA = ("rule_id string, type string, signal string, min double, max double, max_delta double, samples int, condition string, value double, "
          "min_samples int, if_signal string, if_op string, if_value double, op string, stat string, window int, grp string, severity double, status string")
FIELDS = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]


def rules_table(spark: SparkSession, specs: Iterable[Mapping]) -> DataFrame:
    return spark.createDataFrame([tuple(s.get(f) for f in FIELDS) for s in specs], SCHEMA)


def validate_rules(rules: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Adds ``errors``: why a spec breaks the closed schema (empty when valid)."""
    t, known = F.col("type"), F.col("signal").isin(list(signals))

    def when_type(name: str, bad: Column, text: str) -> Column:
        return F.when((t == name) & bad, F.lit(text))

    none = lambda c: F.col(c).isNull()
    pos = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    tests = [
        F.when(none("type") | ~t.isin(TYPES), F.lit("unknown rule type")),
        F.when(none("signal") | ~known, F.lit("signal is not in the catalog")),
        when_type("range", none("min") & none("max"), "range needs min and/or max"),
        when_type("range", F.col("min") > F.col("max"), "range min must be <= max"),
        when_type("rate_of_change", pos("max_delta"), "max_delta must be positive"),
        when_type("rate_of_change", F.col("samples") < 1, "samples must be >= 1"),
        when_type("acceleration", pos("max_delta"), "max_delta must be positive"),
        when_type("duration", none("condition") | ~F.col("condition").isin(CONDITIONS), "unknown condition"),
        when_type("duration", F.coalesce(F.col("min_samples") < 1, F.lit(True)), "min_samples must be >= 1"),
        when_type("duration", F.col("condition").isin("above", "below") & none("value"), "value is required"),
        when_type("duration", (F.col("condition") == "between") & (none("min") | none("max")), "min and max are required"),
        when_type("cross_signal", none("if_signal") | ~F.col("if_signal").isin(list(signals)) | none("if_op") | ~F.col("if_op").isin(list(OPS)) | none("if_value"), "incomplete if-condition"),
        when_type("cross_signal", none("op") | ~F.col("op").isin(list(OPS)) | none("value"), "incomplete then-condition"),
        when_type("rolling_stat", none("stat") | ~F.col("stat").isin(STATS), "unknown statistic"),
        when_type("rolling_stat", none("op") | ~F.col("op").isin(list(OPS)) | none("value"), "op and value are required"),
        F.when(t.isin("rolling_stat", "drift") & F.coalesce(F.col("window") < 2, F.lit(True)), F.lit("window must be >= 2")),
        when_type("missing", F.coalesce(F.col("samples") < 0, F.lit(True)), "samples must be >= 0"),
        when_type("stuck", F.coalesce(F.col("samples") < 1, F.lit(True)), "samples must be >= 1"),
        when_type("drift", pos("max_delta"), "max_delta must be positive"),
        F.when(~F.col("severity").between(0.0, 1.0), F.lit("severity must be within 0..1")),
    ]
    return rules.withColumn("errors", F.array_compact(F.array(*tests)))


def set_rule_status(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions``: rule_id, decided_at, decision (approve | reject | retire); the latest one wins."""
    last = decisions.groupBy("rule_id").agg(F.max_by("decision", "decided_at").alias("_d"))
    d = rules.join(last, "rule_id", "left")
    st = F.when(F.col("_d") == "approve", "active").when(F.col("_d") == "reject", "rejected").when(F.col("_d") == "retire", "retired").otherwise(F.col("status"))
    return d.withColumn("status", st).drop("_d")


def active(rules: DataFrame) -> list[dict]:
    """The rules to run: configuration of bounded size, read once to build the plan."""
    return [r.asDict() for r in rules.filter(F.col("status").isin("active", "approved")).orderBy("rule_id").collect()]


def _lookback(r: Mapping) -> int:
    return {"rate_of_change": r.get("samples") or 1, "acceleration": 2, "rolling_stat": (r.get("window") or 1) - 1,
            "drift": (r.get("window") or 1) - 1, "duration": 1 if r.get("condition") == "constant" else 0}.get(r["type"], 0)


def _std(x: Column, roll) -> Column:
    """Sample standard deviation of a short full frame by Welford's recurrence in row order. Rules compare it with a limit that readings can meet exactly,
    so its last digit decides: it must not depend on how the engine groups its sums."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, v: Column) -> Column:
        mean = s["mean"] + (v - s["mean"]) / (s["n"] + 1.0)
        return F.struct((s["n"] + 1.0).alias("n"), mean.alias("mean"), (s["m2"] + (v - mean) * (v - s["mean"])).alias("m2"))

    return F.aggregate(F.collect_list(x.cast("double")).over(roll), start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1.0))))


def _violation(r: Mapping, w) -> tuple[Column, Column]:
    """(violated, watched value) of one rule on the ordered rows of a group."""
    x, t = F.col(r["signal"]), r["type"]
    if t == "range":
        low = cmp(x, "<", r["min"]) if r.get("min") is not None else F.lit(False)
        high = cmp(x, ">", r["max"]) if r.get("max") is not None else F.lit(False)
        return low | high, x
    if t == "rate_of_change":
        return cmp(F.abs(x - F.lag(x, r.get("samples") or 1).over(w)), ">", r["max_delta"]), x
    if t == "acceleration":
        return cmp(F.abs(x - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)), ">", r["max_delta"]), x
    if t == "duration":
        c = r["condition"]
        held = {"above": lambda: cmp(x, ">", r["value"]), "below": lambda: cmp(x, "<", r["value"]),
                "between": lambda: cmp(x, ">=", r["min"]) & cmp(x, "<=", r["max"]), "missing": lambda: x.isNull(),
                "constant": lambda: F.coalesce(x == F.lag(x).over(w), F.lit(False)) | F.coalesce(x == F.lead(x).over(w), F.lit(False))}
        return held[c](), x
    if t == "cross_signal":
        return cmp(F.col(r["if_signal"]), r["if_op"], r["if_value"]) & ~cmp(x, r["op"], r["value"]) & x.isNotNull(), x
    if t == "missing":
        return x.isNull(), x
    n = r["window"]
    roll = w.rowsBetween(-(n - 1), 0)
    full = F.count(x).over(roll) == n
    if t == "rolling_stat":
        fn = {"mean": F.avg, "min": F.min, "max": F.max}
        stat = F.when(full, _std(x, roll) if r["stat"] == "std" else fn[r["stat"]](x).over(roll))
        return stat.isNotNull() & ~cmp(stat, r["op"], r["value"]), stat
    if t == "drift":
        span = F.when(full, F.max(x).over(roll) - F.min(x).over(roll))
        return cmp(span, ">", r["max_delta"]), span
    raise ValueError(f"no row test for rule type {t}")


def _min_len(r: Mapping) -> int:
    return {"duration": r.get("min_samples") or 1, "missing": (r.get("samples") or 0) + 1}.get(r["type"], 1)


def rule_episodes(wide: DataFrame, rules: Sequence[Mapping], chunk_rows: int | None = None) -> DataFrame:
    """rule_id, grp, row_start, row_end, n, value_min, value_max, pos bounds; one shuffle for all row tests."""
    tests = [r for r in rules if r["type"] != "stuck"]
    parts = []
    if tests:
        cols = sorted({r["signal"] for r in tests} | {r["if_signal"] for r in tests if r.get("if_signal")})
        look = max(_lookback(r) for r in tests)
        ahead = 1 if any(r.get("condition") == "constant" for r in tests) else 0

        def columns(w):
            out = {}
            for i, r in enumerate(tests):
                bad, val = _violation(r, w)
                if r.get("grp") is not None:
                    bad = bad & (F.col("grp") == str(r["grp"]))
                out[f"_r{i}"] = F.when(bad, F.struct(F.lit(r["rule_id"]).alias("rule_id"), val.cast("double").alias("value")))
            return out

        d = ordered.with_windows(wide.select("grp", "row", "pos", *cols), ["grp"], columns, before=look, after=ahead, chunk_rows=chunk_rows)
        d = d.select("grp", "row", "pos", F.explode(F.array_compact(F.array(*[F.col(f"_r{i}") for i in range(len(tests))]))).alias("_v")).select("grp", "row", "pos", "_v.*")
        isl = ordered.islands(d, ["rule_id", "grp"], aggs={"value_min": ("min", F.col("value")), "value_max": ("max", F.col("value"))}, chunk_rows=chunk_rows)
        need = F.lit(1)
        for r in tests:
            if _min_len(r) > 1:
                need = F.when(F.col("rule_id") == r["rule_id"], _min_len(r)).otherwise(need)
        parts.append(isl.filter(F.col("n") >= need))
    for r in rules:
        if r["type"] == "stuck":
            src = wide if r.get("grp") is None else wide.filter(F.col("grp") == str(r["grp"]))
            runs = ordered.value_runs(src, ["grp"], [r["signal"]], min_len=r["samples"] + 1, chunk_rows=chunk_rows)
            runs = runs.withColumns({"value_min": F.col("value"), "value_max": F.col("value")}).drop("value", "signal")
            m = ordered.merge_gaps(runs, ["grp"], 0, {"value_min": "min", "value_max": "max"})
            parts.append(m.withColumn("rule_id", F.lit(r["rule_id"])))
    return reduce(DataFrame.unionByName, parts)


def rule_checks(episodes: DataFrame, rules: Sequence[Mapping], batches: DataFrame) -> DataFrame:
    """One row per (rule, batch): fail with its violations or pass. ``batches``: batch_id, row_start, row_end."""
    ids = F.array(*[F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["type"]).alias("rule_type"),
                             F.lit(float(r["severity"] if r.get("severity") is not None else DEFAULT_SEVERITY)).alias("severity")) for r in rules])
    b = batches.select("batch_id", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end"))
    every = b.withColumn("r", F.explode(ids)).select("batch_id", (F.col("b_end") - F.col("b_start") + 1).alias("n_rows"), "r.*")
    cut = ordered.overlap_intervals(episodes.select("rule_id", "row_start", "row_end"), b, [])
    cut = cut.select("batch_id", "rule_id", F.greatest("row_start", "b_start").alias("row_start"), F.least("row_end", "b_end").alias("row_end"))
    v = cut.groupBy("batch_id", "rule_id").agg(F.sum(F.col("row_end") - F.col("row_start") + 1).alias("n"), F.count(F.lit(1)).alias("n_episodes"),
                                               F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"))
    d = every.join(v, ["batch_id", "rule_id"], "left")
    bad = F.col("n").isNotNull()
    return d.select(F.concat(F.lit("rule:"), "rule_id").alias("check_type"), F.lit("rule").alias("category"), "batch_id", "rule_id", "rule_type",
                    F.when(bad, "fail").otherwise("pass").alias("status"), F.when(bad, F.col("severity")).otherwise(0.0).alias("severity"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("n_episodes", F.lit(0)).cast("long").alias("n_episodes"), "row_start", "row_end",
                    S.confidence(F.col("n_rows")).alias("confidence"))


def range_limits(rules: DataFrame) -> DataFrame:
    """signal, rule_min, rule_max of the active range rules without a group restriction."""
    return (rules.filter("status in ('active', 'approved') and type = 'range' and grp is null")
            .select("signal", F.col("min").alias("rule_min"), F.col("max").alias("rule_max")))


def strongest_first(episodes: DataFrame, k: int) -> DataFrame:
    """The k longest episodes of each rule."""
    rn = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("n"), "row_start"))
    return episodes.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")
