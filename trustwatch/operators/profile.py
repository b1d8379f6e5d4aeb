"""Fingerprints of signals, how signals move together, and their structural roles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import ordered
from trustwatch.operators.graph import connected_components
from trustwatch.operators.quality import once


# ------------------------------------------------------------------ aggregates
def global_stats(long: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Counts, moments, quantiles, bias-corrected skewness and kurtosis, distinct values, integer test, per signal. ``stats``: ``signal_stats`` of the same readings, if they are there."""
    v = F.col("value")
    st = stats if stats is not None else S.signal_stats(long)
    n = F.col("n").cast("double")
    nu = long.filter(v.isNotNull()).groupBy("signal", "value").agg(F.lit(1).alias("_")).groupBy("signal").agg(F.count(F.lit(1)).alias("n_unique"))
    mom = long.groupBy("signal").agg(F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"), F.sum((v != F.floor(v)).cast("long")).alias("_frac"))
    d = st.join(mom, "signal").join(nu, "signal", "left")
    return d.select(
        "signal", F.col("n").alias("count"), (1 - F.col("n") / F.col("n_rows")).alias("missing_rate"), "mean", "std", "min", "max", "q01", "q05", "q25", F.col("median").alias("q50"), "q75", "q95", "q99",
        F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"), ((F.coalesce("_frac", F.lit(0)) == 0) & (F.col("n") > 0)).alias("integer_valued"), (F.col("q75") - F.col("q25")).alias("iqr"), "mad", "scale")


def share_at_limits(long: DataFrame, stats: DataFrame) -> DataFrame:
    d = long.filter("value is not null").join(F.broadcast(stats.select("signal", "min", "max")), "signal")
    return d.groupBy("signal").agg(F.avg((F.col("value") == F.col("min")).cast("double")).alias("share_at_min"), F.avg((F.col("value") == F.col("max")).cast("double")).alias("share_at_max"))


def robust_scale(stats: DataFrame) -> DataFrame:
    return stats.select("signal", "mad", "scale")


# ------------------------------------------------------------------ dynamics
MEASURES = ("autocorr_lag1", "autocorr_lag5", "noise_level", "stuck_fraction", "hold_period", "hold_regularity", "level_autocorr", "quantization_step", "jump_ratio", "large_jump_share", "trend_strength")
BUFFER_ROWS = 100_000


def _unit_quantiles(x: np.ndarray, unit: np.ndarray, units: int, ps: Sequence[float]) -> list[np.ndarray]:
    """Exact quantiles of each unit's values, linear between ranks; NaN without values."""
    n = np.bincount(unit, minlength=units)
    x = x[np.lexsort((x, unit))]
    start = np.cumsum(n) - n
    out = []
    for p in ps:
        q = np.full(units, np.nan)
        some = np.flatnonzero(n)
        r = (n[some] - 1) * p
        lo, hi = x[start[some] + np.floor(r).astype(np.int64)], x[start[some] + np.ceil(r).astype(np.int64)]
        q[some] = np.where(lo == hi, lo, (np.ceil(r) - r) * lo + (r - np.floor(r)) * hi)
        out.append(q)
    return out


def _unit_dynamics(pos: np.ndarray, x: np.ndarray, x1: np.ndarray, has1: np.ndarray, x5: np.ndarray, has5: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which units have ten readings, and the MEASURES of all (NaN where there is none). Readings are in order; x1 and x5 are those one and five rows earlier, where they are there."""
    total = lambda v, at=None: np.bincount(unit if at is None else unit[at], weights=v if at is None else v[at], minlength=units)
    count = lambda at: np.bincount(unit[at], minlength=units).astype(float)
    first = np.zeros(units)
    first[unit[::-1]] = x[::-1]  # sums are of differences to a unit's first reading: a constant has no spread at all
    n = np.bincount(unit, minlength=units).astype(float)
    y, y1, y5 = x - first[unit], x1 - first[unit], x5 - first[unit]
    mean = total(y) / n
    sd = np.sqrt(total((y - mean[unit]) ** 2) / n)
    over = np.where(sd > 0, sd, np.nan)

    def auto(v: np.ndarray, at: np.ndarray, m: np.ndarray, s: np.ndarray, least: int) -> np.ndarray:
        k = count(at)
        return np.where(k >= least, total((y - m[unit]) * (v - m[unit]), at) / np.where(k > 0, k, np.nan) / (s * s), np.nan)

    dx = np.where(has1, x - x1, 0.0)
    n1 = count(has1)
    some1 = np.where(n1 > 0, n1, np.nan)
    base = np.zeros(units)
    k1 = np.flatnonzero(has1)
    base[unit[k1][::-1]] = dx[k1][::-1]
    steps = dx - base[unit]
    step = total(steps, has1) / some1
    sdd = np.sqrt(total((steps - step[unit]) ** 2, has1) / some1)
    moving = has1 & ~(dx == 0)
    least, middle = _unit_quantiles(np.abs(dx[moving]), unit[moving], units, (0.01, 0.5))
    level = ~has1 | moving
    ln = count(level)
    lmean = total(y, level) / np.where(ln > 0, ln, np.nan)
    lsd = np.sqrt(total((y - lmean[unit]) ** 2, level) / np.where(ln > 0, ln, np.nan))
    p = pos - (total(pos) / n)[unit]
    across = np.sqrt(total((y - mean[unit]) ** 2) * total(p * p))
    jumps = count(moving)
    # how long a level is held: to the next one, the last to the end of the unit
    at = np.flatnonzero(level)
    u, begin = unit[at], pos[at]
    last = np.r_[u[1:] != u[:-1], True] if len(at) else np.zeros(0, bool)
    start = np.zeros(units)
    start[u[::-1]] = begin[::-1]
    length = np.where(last, start[u] + n[u], np.r_[begin[1:], 0.0] if len(at) else begin) - begin
    hold = _unit_quantiles(length, u, units, (0.5,))[0]
    mad = _unit_quantiles(np.abs(length - hold[u]), u, units, (0.5,))[0]
    return n >= 10, dict(zip(MEASURES, (
        auto(y1, has1, mean, over, 6), auto(y5, has5, mean, over, 6), sdd / over, count(has1 & (dx == 0)) / some1, hold, np.maximum(0.0, 1.0 - np.minimum(1.0, 1.4826 * mad / np.where(hold == 0, np.nan, hold))),
        auto(y1, has1 & moving, lmean, np.where(lsd > 0, lsd, np.nan), 10), least, middle / over, count(moving & (np.abs(dx) > 0.5 * sd[unit])) / np.where(jumps > 0, jumps, np.nan),
        np.abs(total((y - mean[unit]) * p)) / np.where(across > 0, across, np.nan))))


def dynamics(wide: DataFrame, signals: Sequence[str], chunk_rows: int = 100_000) -> DataFrame:
    """Autocorrelation, noise, holds, jumps and trend of each signal: per stretch of a group, then the median.

    One shuffle of the wide rows; a stretch is a whole group, or a chunk of a long group. numpy takes the stretches of a few groups at a time."""
    d = ordered.sorted_chunks(ordered.chunked(wide.select("grp", F.col("pos").cast("long").alias("pos"), *[F.col(s).cast("double").alias(f"_v{i}") for i, s in enumerate(signals)]), before=5, chunk_rows=chunk_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in ordered.whole_series(batches, BUFFER_ROWS):
            starts, series = ordered.series_of(t)
            rank = np.arange(t.num_rows) - starts[series]
            own, pos = t.column(ordered.OWN).to_numpy(), t.column("pos").to_numpy().astype(float)
            for i, s in enumerate(signals):
                v = t.column(f"_v{i}").combine_chunks()
                there = v.is_valid().to_numpy(zero_copy_only=False)
                v = v.fill_null(0.0).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(own & there)
                if not len(at):
                    continue
                back = [(np.where(ok := (rank[at] >= k) & there[at - np.minimum(k, rank[at])], v[at - np.minimum(k, rank[at])], 0.0), ok) for k in (1, 5)]
                with np.errstate(all="ignore"):
                    enough, m = _unit_dynamics(pos[at], v[at], *back[0], *back[1], series[at], len(starts))
                keep = np.flatnonzero(enough)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(keep), pa.string()), *[pa.array(x[keep], pa.float64(), mask=np.isnan(x[keep])) for x in m.values()]], ["signal", *m])

    u = once(d.mapInArrow(run, "signal string, " + ", ".join(f"{c} double" for c in MEASURES)))
    cols = list(MEASURES)
    mid = S.group_quantiles(u.unpivot(["signal"], cols, "measure", "x"), ["signal", "measure"], "x", [0.5]).groupBy("signal").agg(*[F.max(F.when(F.col("measure") == c_, F.get("q", F.lit(0)))).alias(c_) for c_ in cols])
    return u.groupBy("signal").agg(F.count(F.lit(1)).alias("n_units")).join(mid, "signal", "left")


def dominant_period(wide: DataFrame, signals: Sequence[str], chunk_rows: int = 16_384, prominence: float = 8.0) -> DataFrame:
    """Strongest FFT period per stretch (detrended, Hann window), kept when prominent in half of the stretches.

    Stretches are chunks of at most ``chunk_rows`` rows of one group and signal, so the arrays stay small."""
    d = ordered.chunked(wide.select("grp", "pos", *signals), chunk_rows=chunk_rows).drop(ordered.OWN)
    d = d.unpivot(["grp", ordered.CHUNK, "pos"], list(signals), "signal", "value")

    def fft(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pos")
        x = p["value"].interpolate(limit_direction="both").to_numpy(dtype=float)
        period, prom = None, 0.0
        if len(x) >= 32 and np.isfinite(x).all():
            t = np.arange(len(x))
            x = x - np.polyval(np.polyfit(t, x, 1), t)
            power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
            power[:2] = 0.0
            i, mid = int(power.argmax()), float(np.median(power[2:]))
            prom = float(power[i] / mid) if mid > 0 else 0.0
            period = len(x) / i if i and len(x) / i <= len(x) / 3 else None
        return pd.DataFrame({"signal": [pdf["signal"].iloc[0]], "period": [period], "prom": [prom]})

    u = d.groupBy("grp", ordered.CHUNK, "signal").applyInPandas(fft, "signal string, period double, prom double")
    good = F.when((F.col("prom") >= prominence), F.col("period"))
    a = u.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.count(good).alias("k"), F.percentile(good, F.lit(0.5)).alias("p"), F.percentile("prom", F.lit(0.5)).alias("prominence"))
    return a.select("signal", F.when(F.col("k") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.col("p")).alias("dominant_period"), "prominence")


# ------------------------------------------------------------------ shape and bounds
def shape(fp: DataFrame) -> DataFrame:
    sk, ku, n = F.col("skew"), F.col("kurtosis"), F.col("count").cast("double")
    bc = (sk * sk + 1.0) / (ku + 3.0 * (n - 1) * (n - 1) / F.greatest(F.lit(1.0), (n - 2) * (n - 3)))
    s = (F.when(F.col("n_unique") <= 1, "constant").when(F.col("n_unique") <= 10, "discrete").when(sk.isNull() | ku.isNull() | (n < 50), "unknown")
         .when(bc > 0.555, F.when(F.abs(sk) > 1, "bimodal_or_skewed").otherwise("bimodal")).when(F.abs(sk) > 1, "skewed").when(ku > 3, "heavy_tailed").otherwise("unimodal"))
    return fp.withColumns({"distribution_shape": s, "bimodality": F.when((F.col("n_unique") > 10) & (n >= 50), bc)})


def boundedness(fp: DataFrame) -> DataFrame:
    mn, mx = F.col("min"), F.col("max")
    pct = (mn >= 0) & (mx <= 100) & (mx - mn >= 20) & ((mn < 5) | (mx > 95) | (F.col("share_at_min") > 0.001) | (F.col("share_at_max") > 0.001))
    return fp.withColumn("boundedness", F.when(mn.isNull() | mx.isNull(), "unknown").when(pct, "0-100").when((mn >= 0) & (mx <= 1.0000001) & (mx - mn > 0.2), "0-1").when(mn >= 0, "nonnegative").otherwise("unbounded"))


def fingerprints(wide: DataFrame, signals: Sequence[str]) -> DataFrame:
    long = wide.select(*signals).unpivot([], list(signals), "signal", "value")
    st = once(global_stats(long, S.wide_stats(wide, {s: F.col(s) for s in signals})))
    d = st.join(share_at_limits(long, st), "signal", "left").join(dynamics(wide, signals), "signal", "left")
    return boundedness(shape(d))


def winsorize(long: DataFrame, stats: DataFrame, k: float = 6.0) -> DataFrame:
    """Readings clipped at median +- k * 1.4826 MAD."""
    d = long.join(F.broadcast(stats.select("signal", "median", "mad")), "signal")
    r = k * 1.4826 * F.col("mad")
    return d.withColumn("value", F.when(F.col("mad") > 0, F.least(F.greatest(F.col("value"), F.col("median") - r), F.col("median") + r)).otherwise(F.col("value"))).drop("median", "mad")


# ------------------------------------------------------------------ relations
def gram(wide: DataFrame, signals: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per unit: n and the sums of x_i and x_i x_j over complete rows, as one array (partial sums inside Arrow batches)."""
    k = len(signals)
    schema = ", ".join([f"{b} {dict(wide.dtypes)[b]}" for b in by] + ["m array<double>"])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pdf.groupby(list(by), sort=False) if by else [((), pdf)]
            out = []
            for key, g in groups:
                x = g[list(signals)].to_numpy(dtype=float)
                x = x[np.isfinite(x).all(axis=1)]
                x = np.column_stack([np.ones(len(x)), x])
                out.append((*key, (x.T @ x).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*by, "m"])

    parts = wide.select(*by, *signals).mapInPandas(part, schema)
    n = (k + 1) ** 2
    return parts.groupBy(*by).agg(F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(n)]).alias("m"))


def corr_matrix(wide: DataFrame, signals: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair, missing readings taken as the column mean: sums of one pass only."""
    pairs = list(combinations(signals, 2))
    mu = wide.agg(*[F.avg(s).alias(f"_m_{s}") for s in signals])
    d = wide.select(*signals).crossJoin(F.broadcast(mu)).select(*[F.coalesce(F.col(s), F.col(f"_m_{s}")).alias(s) for s in signals])
    a = d.agg(*[F.corr(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    return a.select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)])).alias("p")).select("p.*")


def spearman_matrix(wide: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Rank correlation: average ranks per signal by value counts, joined back to the rows signal by signal."""
    long = wide.select(*signals).unpivot([], list(signals), "signal", "value")
    ranks = S.average_ranks(long, ["signal"])
    d = wide.select(*signals)
    for s in signals:
        r = ranks.filter(F.col("signal") == s).select(F.col("value").alias(s), F.col("rank").alias(f"_r_{s}"))
        d = d.join(r, s, "left")
    return corr_matrix(d.select(*[F.col(f"_r_{s}").alias(s) for s in signals]), signals)


def signal_clusters(nodes: DataFrame, pairs: DataFrame, min_r: float = 0.6) -> DataFrame:
    """Signals that move together: connected components over |r| >= min_r. ``nodes``: id."""
    return connected_components(nodes, pairs.filter(F.abs("r") >= min_r).select("a", "b"))


def leaders(edges: DataFrame) -> DataFrame:
    return edges.filter("lag > 0").select(F.col("b").alias("signal"), F.col("a").alias("leader"), "lag", "r_at_lag")


def redundant_signals(wide: DataFrame, signals: Sequence[str], max_regressors: int = 4, r2_min: float = 0.9995, chunk_rows: int = 100_000) -> DataFrame:
    """Signals reproduced by at most four others in (almost) every group.

    The regressors are picked forward on the pooled Gram matrix (one small array); every subset of them is then tested
    on the Gram matrix of each group, in parallel over groups, and the smallest subset that stays near-exact wins."""
    names = list(signals)
    k = len(names)

    def cov(m: np.ndarray) -> np.ndarray:
        g = m.reshape(k + 1, k + 1)
        n, mu = g[0, 0], g[0, 1:] / max(g[0, 0], 1.0)
        return g[1:, 1:] / max(n, 1.0) - np.outer(mu, mu)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        c = cov(np.asarray(pdf["m"].iloc[0], dtype=float))
        sd = np.sqrt(np.maximum(np.diag(c), 0.0))
        out = []
        for j in range(k):
            if sd[j] <= 0:
                continue
            r = np.abs(c[j]) / np.where(sd > 0, sd * sd[j], np.inf)
            r[j] = 0.0
            if r.max() < 0.2:
                continue
            chosen: list[int] = []
            while len(chosen) < min(max_regressors, k - 1):
                beta = np.linalg.lstsq(c[np.ix_(chosen, chosen)], c[chosen, j], rcond=None)[0] if chosen else np.zeros(0)
                res_cov = c[:, j] - (c[:, chosen] @ beta if chosen else 0.0)
                score = np.where(sd > 0, np.abs(res_cov) / np.where(sd > 0, sd, 1.0), 0.0)
                score[[j, *chosen]] = -1.0
                nxt = int(score.argmax())
                if score[nxt] <= 1e-9 * sd[j]:
                    break
                chosen.append(nxt)
            for m in range(1, len(chosen) + 1):
                for sub in combinations(sorted(chosen), m):
                    beta = np.linalg.lstsq(c[np.ix_(sub, sub)], c[list(sub), j], rcond=None)[0]
                    out.append((names[j], [names[i] for i in sub], float(c[j, j]), bool((beta > 0).all() or (beta < 0).all())))
        return pd.DataFrame(out, columns=["signal", "partners", "variance", "same_sign"])

    pooled = gram(wide, names)
    sets = pooled.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(pick, "signal string, partners array<string>, variance double, same_sign boolean")
    cand = sets.agg(F.collect_list(F.struct("signal", "partners")).alias("sets"))  # at most 15 sets per signal
    c = F.floor(F.col("pos") / chunk_rows).cast("long")
    units = gram(wide.withColumn("_unit", c), names, ["grp", "_unit"]).crossJoin(F.broadcast(cand))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {s: i for i, s in enumerate(names)}
        for pdf in batches:
            out = []
            for m, group_sets in zip(pdf["m"], pdf["sets"]):
                arr = np.asarray(m, dtype=float)
                g = cov(arr)
                for s in group_sets:
                    j, sub = at[s["signal"]], [at[p] for p in s["partners"]]
                    if arr[0] < len(sub) + 20 or g[j, j] <= 0:
                        continue
                    beta = np.linalg.lstsq(g[np.ix_(sub, sub)], g[sub, j], rcond=None)[0]
                    out.append((s["signal"], list(s["partners"]), float(g[sub, j] @ beta / g[j, j])))
            yield pd.DataFrame(out, columns=["signal", "partners", "r2"])

    r2 = units.mapInPandas(fit, "signal string, partners array<string>, r2 double")
    q = r2.groupBy("signal", "partners").agg(F.percentile("r2", F.lit(0.7)).alias("r2"), F.percentile("r2", F.lit(0.5)).alias("r2_median")).filter((F.col("r2") >= r2_min) & (F.col("r2_median") >= 0.95))
    best = ordered.first_k(q, ["signal"], [F.size("partners"), F.desc("r2"), F.concat_ws("+", "partners")], 1).join(sets, ["signal", "partners"])
    fam = F.concat_ws("+", F.array_sort(F.array_union(F.array("signal"), F.col("partners"))))
    first = F.row_number().over(Window.partitionBy(fam).orderBy(F.desc("same_sign"), F.desc("variance"), F.desc("signal")))
    return best.withColumn("derived", first == 1)


# ------------------------------------------------------------------ roles
#: Limits that make a trait, over the columns of the fingerprints (absent measures count as 0, an absent hold period as 1).
TRAITS = {
    "empty": "count = 0",
    "single": "n_unique <= 1 OR std = 0 OR min = max",
    "whole": "integer_valued",
    "percent": "boundedness = '0-100'",
    "few": "n_unique <= 10",
    "climbs": "n_unique > 20 AND trend_strength > 0.95 AND autocorr_lag1 > 0.99 AND stuck_fraction < 0.05 AND jump_ratio < 0.05",
    "narrow": "mean <> 0 AND abs(std / nullif(mean, 0)) < 0.1",
    "recurs": "n_unique >= 20 AND n_unique / count <= 0.2 AND abs(autocorr_lag1) < 0.2 AND stuck_fraction < 0.2",
    "rests": "stuck_fraction >= 0.4",
    "cadence": "hold_period BETWEEN 2 AND 20 AND (hold_regularity >= 0.9 OR (hold_regularity >= 0.6 AND level_autocorr >= 0.5))",
    "leaps": "boundedness = '0-100' OR large_jump_share >= 0.3 OR jump_ratio >= 0.5 OR hold_period > 20",
    "holds": "hold_period >= 2",
    "strides": "large_jump_share >= 0.5 AND hold_period >= 1.5",
}
#: What a role asks for, and what it must not have; the first row that fits names the role.
ROLES = [
    ("unknown", {"empty"}, set()),
    ("constant", {"single"}, set()),
    ("derived_redundant", {"derived"}, set()),
    ("counter", {"whole", "climbs"}, set()),
    ("categorical", {"whole", "few"}, {"percent"}),
    ("categorical", {"whole", "narrow", "recurs"}, set()),
    ("held_sampled", {"rests", "cadence"}, set()),
    ("actuator_like", {"rests", "leaps"}, set()),
    ("held_sampled", {"rests", "holds"}, set()),
    ("actuator_like", {"percent", "strides"}, {"rests"}),
    ("continuous_measured", set(), set()),
]
#: Evidence for a manipulated variable (the rows of a kind exclude each other) and its weight.
EVIDENCE = [
    ("a percentage from end to end", "top = 100 AND at_low AND at_high", 0.55),
    ("a percentage up to one end", "top = 100 AND at_low <> at_high", 0.2),
    ("a fraction from end to end", "top = 1 AND at_low AND at_high", 0.2),
    ("a fraction up to one end", "top = 1 AND at_low <> at_high", 0.1),
    ("readings at a limit", "top IS NOT NULL AND greatest(share_at_min, share_at_max) > 0.001", 0.35),
    ("steps", "stuck_fraction >= 0.4 AND (large_jump_share >= 0.3 OR jump_ratio >= 0.5)", 0.25),
    ("others follow", "followers > 0", 0.25),
    ("follows others", "drivers > 0 AND coalesce(followers, 0) = 0", 0.1),
]
#: Ranges of a percentage and of a fraction: least, greatest and extent that is used.
RANGES = {100: (-3.0, 103.0, 20.0), 1: (-0.03, 1.03, 0.2)}
#: Guesses from structure alone, the first that fits; its confidence as SQL.
GUESSES = [
    ("manipulated variable", "role = 'actuator_like' AND manipulated > 0", "least(0.5, 0.25 + 0.3 * manipulated)"),
    ("valve / actuator position", "role = 'actuator_like'", "CASE WHEN boundedness = '0-100' THEN 0.45 ELSE 0.35 END"),
    ("analyzer / composition", "role = 'held_sampled'", "0.4"),
    ("controller output / valve position", "boundedness = '0-100'", "0.3"),
    ("temperature-like", "noise_level < 0.2 AND autocorr_lag1 > 0.98", "0.3"),
    ("flow-like", "noise_level > 0.6", "0.3"),
    ("pressure / level-like", "true", "0.2"),
]
ABSENT = {"autocorr_lag1": 0.0, "stuck_fraction": 0.0, "hold_period": 1.0, "hold_regularity": 0.0, "large_jump_share": 0.0, "trend_strength": 0.0, "noise_level": 1.0}
MANIPULATED = 0.55


def _filled(fp: DataFrame) -> DataFrame:
    """Absent measures as the traits read them."""
    return fp.na.fill({c: v for c, v in ABSENT.items() if c in fp.columns})


def structural_role(fp: DataFrame, derived: Sequence[str] = ()) -> DataFrame:
    """constant, derived_redundant, counter, categorical, held_sampled, actuator_like or continuous_measured: traits first, then the first role they fit."""
    d = _filled(fp)
    traits = d.select("signal", *[F.coalesce(F.expr(t).cast("boolean"), F.lit(False)).alias(f"_{n}") for n, t in TRAITS.items()], F.col("signal").isin(list(derived) or [""]).alias("_derived"))
    fits = [F.when(reduce(and_, [F.col(f"_{t}") for t in sorted(has)] + [~F.col(f"_{t}") for t in sorted(lacks)], F.lit(True)), role) for role, has, lacks in ROLES]
    return fp.join(traits.select("signal", F.coalesce(*fits).alias("role")), "signal")


def manipulated_score(fp: DataFrame, edges: DataFrame) -> DataFrame:
    """How much a signal looks like a controller output or valve: the weights of the evidence that holds; MANIPULATED and above means actuator."""
    strong = edges.filter((F.abs("r") >= 0.5) & (F.col("lag") >= 1))
    ends = strong.select(F.explode(F.array(F.struct(F.col("a").alias("signal"), F.lit(1).alias("leads")), F.struct(F.col("b").alias("signal"), F.lit(0).alias("leads")))).alias("x")).groupBy("x.signal").agg(F.sum("x.leads").alias("followers"), F.sum(1 - F.col("x.leads")).alias("drivers"))
    inside = {t: (F.col("min") >= lo) & (F.col("max") <= hi) & (F.col("max") - F.col("min") >= used) for t, (lo, hi, used) in RANGES.items()}
    top = F.when(inside[100], 100.0).when(inside[1] & ~F.col("integer_valued"), 1.0)
    d = _filled(fp).join(ends, "signal", "left").withColumn("top", top).withColumn("at_low", F.col("min") <= 0.03 * F.col("top")).withColumn("at_high", F.col("max") >= 0.97 * F.col("top"))
    weight = sum((F.when(F.expr(holds), w).otherwise(0.0) for _, holds, w in EVIDENCE), F.lit(0.0))
    return fp.join(d.select("signal", F.round(F.least(F.lit(1.0), weight), 3).alias("manipulated")), "signal")


def role_hypotheses(cat: DataFrame) -> DataFrame:
    """Low-confidence instrument guesses from structure only, for measured signals and actuators."""
    d = _filled(cat).filter("role IN ('continuous_measured', 'held_sampled', 'actuator_like')")
    value = F.coalesce(*[F.when(F.expr(fits), F.struct(F.lit(name).alias("hypothesis"), F.expr(f"CAST({sure} AS DOUBLE)").alias("confidence"))) for name, fits, sure in GUESSES])
    return d.select("signal", value.alias("g")).select("signal", "g.hypothesis", "g.confidence")


def signal_catalog(fp: DataFrame, edges: DataFrame, clusters: DataFrame, derived: Sequence[str] = ()) -> DataFrame:
    """Role, score, cluster and leaders of every signal; a manipulated score of 0.55 turns a measurement into an actuator."""
    d = manipulated_score(structural_role(fp, derived), edges)
    d = d.withColumn("role", F.when((F.col("role").isin("continuous_measured", "held_sampled")) & (F.col("manipulated") >= MANIPULATED), "actuator_like").otherwise(F.col("role")))
    d = d.join(clusters.select(F.col("id").alias("signal"), F.col("component").alias("cluster")), "signal", "left")
    lead = leaders(edges).groupBy("signal").agg(F.sort_array(F.collect_list(F.struct("lag", "leader"))).alias("leaders"))
    return d.join(lead, "signal", "left")


def test_actuators(cat: DataFrame, edges: DataFrame) -> DataFrame:
    """Confirmed when a measured signal follows the actuator, consistent when the actuator follows one."""
    e = edges.filter((F.abs("r") >= 0.5) & (F.col("lag") >= 1))
    meas = cat.filter("role <> 'actuator_like'").select(F.col("signal").alias("b"))
    foll = e.join(meas, "b").groupBy(F.col("a").alias("signal")).agg(F.count(F.lit(1)).alias("followers"))
    driv = e.groupBy(F.col("b").alias("signal")).agg(F.count(F.lit(1)).alias("drivers"))
    d = cat.filter("role = 'actuator_like'").select("signal").join(foll, "signal", "left").join(driv, "signal", "left")
    return d.select("signal", F.when(F.col("followers") > 0, "confirmed").when(F.col("drivers") > 0, "consistent").otherwise("not confirmed").alias("result"))
