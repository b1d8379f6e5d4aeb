"""Features, detectors and the ensemble.

A model is a handful of numbers per signal: it is fitted with aggregates, collected as a small table and
turned into column expressions (or broadcast as one row to Arrow batches for matrix models and trees).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import lags, ordered
from trustwatch.operators.quality import once
from trustwatch.operators.trajectories import families, train_val_split

BLOCKS = ("value", "rmean", "rstd", "d1", "d2")
CLIP = 10.0
PEERS = 8
RSTD_EPS = 0.02
ID = ["grp", "row", "pos"]


def fname(block: str, signal: str) -> str:
    return f"{block}__{signal}"


def _clip(c: Column) -> Column:
    return F.least(F.lit(CLIP), F.greatest(F.lit(-CLIP), F.coalesce(c, F.lit(0.0))))


# ------------------------------------------------------------------ features
@dataclass
class Spec:
    signals: list[str]
    window: int
    raw: dict[str, tuple[float, float]]
    blocks: dict[str, tuple[float, float]] = field(default_factory=dict)

    def names(self, *blocks: str) -> list[str]:
        return [fname(b, s) for b in (blocks or BLOCKS) for s in self.signals]


def scales_of(wide: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """Per column: median, mean and max(1.4826 MAD, std / 2, q99 of the deviation / 5). The wide rows are read as they are; only counts are shuffled."""
    x = {c: F.col(c).cast("double") for c in cols}
    moments = wide.agg(*[F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).alias(f"_{i}") for i, v in enumerate(x.values())]).first()
    med = {c: q[0] for c, (_, q) in S.quantile_rows(wide, x, [0.5]).items()}
    known = [c for c in cols if med.get(c) is not None]
    dev = {c: q for c, (_, q) in S.quantile_rows(wide, {c: F.abs(x[c] - F.lit(med[c])) for c in known}, [0.5, 0.99]).items()}
    at = {c: moments[f"_{i}"] for i, c in enumerate(cols)}
    return {c: {"med": med[c], "mean": at[c].mean, "scale": max(1.4826 * dev[c][0], 0.5 * at[c].std, dev[c][1] / 5.0)} for c in known}


def _z(spec: Spec, s: str) -> Column:
    c, k = spec.raw[s]
    return _clip((F.col(s) - F.lit(c)) / F.lit(k))


def raw_blocks(wide: DataFrame, spec: Spec, keep: Sequence[str] = ()) -> DataFrame:
    warm = max(3, spec.window // 4)
    d = wide.select(*ID, *keep, *[_z(spec, s).alias(fname("value", s)) for s in spec.signals])

    def cols(w):
        roll = w.rowsBetween(-(spec.window - 1), 0)
        out = {}
        for s in spec.signals:
            z = F.col(fname("value", s))
            out[fname("rmean", s)] = F.avg(z).over(roll)
            out[fname("rstd", s)] = F.when(F.col("pos") >= warm, F.log(F.coalesce(F.stddev_pop(z).over(roll), F.lit(0.0)) + RSTD_EPS))
            out[fname("d1", s)] = F.coalesce(z - F.lag(z, 1).over(w), F.lit(0.0))
            out[fname("d2", s)] = F.coalesce(z - 2 * F.lag(z, 1).over(w) + F.lag(z, 2).over(w), F.lit(0.0))
        return out

    return ordered.with_windows(d, ["grp"], cols, before=max(2, spec.window - 1))


def fit_raw(wide: DataFrame, signals: Sequence[str], window: int = 20, mask: Column | None = None) -> Spec:
    """Centres and scales of the raw signals only; enough for ``raw_blocks``."""
    raw = scales_of(wide.filter(mask) if mask is not None else wide, signals)
    return Spec(list(signals), window, {s: (raw[s]["med"], max(raw[s]["scale"], 1e-6)) for s in signals})


def fit_blocks(blocks: DataFrame, spec: Spec, mask: str | None = None) -> Spec:
    """``spec`` with the centres and scales of the feature blocks. ``blocks`` is read several times: write it first."""
    t = scales_of(blocks.filter(mask) if mask else blocks, spec.names(*BLOCKS[1:]))
    for n in spec.names(*BLOCKS[1:]):
        r = t.get(n, {"med": 0.0, "scale": 0.0})
        spec.blocks[n] = (r["med"], max(r["scale"], 1e-3, 0.05 if n.split("__")[0] in ("d1", "d2", "rstd") else 0.0))
    return spec


def fit_features(wide: DataFrame, signals: Sequence[str], window: int = 20, mask: Column | None = None) -> Spec:
    """Centres and scales of the raw signals and of the five feature blocks, on the baseline rows only."""
    spec = fit_raw(wide, signals, window, mask)
    src = wide.withColumn("_mask", mask) if mask is not None else wide
    keep = ["_mask"] if mask is not None else []
    return fit_blocks(once(raw_blocks(src, spec, keep)), spec, "_mask" if keep else None)


def standardised(blocks: DataFrame, spec: Spec, keep: Sequence[str] = ()) -> DataFrame:
    """Standardised, clipped features of blocks that are there already: no shuffle."""
    out = [F.col(n) for n in spec.names("value")]
    out += [_clip((F.col(n) - F.lit(spec.blocks[n][0])) / F.lit(spec.blocks[n][1])).alias(n) for n in spec.names(*BLOCKS[1:])]
    return blocks.select(*ID, *keep, *out)


def features(wide: DataFrame, spec: Spec, keep: Sequence[str] = ()) -> DataFrame:
    """Standardised, clipped features: one shuffle with a halo of one window."""
    return standardised(raw_blocks(wide, spec, keep), spec, keep)


def extremes_of(feats: DataFrame, cols: dict[str, Column], floors: dict[str, float]) -> dict[str, float]:
    """Normal extreme of |column|: max(min(q995, max(q75 + 3 IQR, q90)), 2 medians, floor). Columns without values are missing."""
    q = S.quantile_rows(feats, {n: F.abs(c) for n, c in cols.items()}, (0.995, 0.9, 0.75, 0.25, 0.5))
    return {n: max(min(a, max(c + 3 * (c - d), b)), 2 * e, float(floors[n])) for n, (rows, (a, b, c, d, e)) in q.items() if rows}


def feature_extreme(feats: DataFrame, cols: Sequence[str], floor: float) -> DataFrame:
    """``extremes_of`` features as a table."""
    return feats.sparkSession.createDataFrame(list(_extremes(feats, cols, floor).items()), "feature string, extreme double")


# ------------------------------------------------------------------ detectors
@dataclass
class Linear:
    """(feature - centre) / scale, compared with a normal extreme."""

    center: dict[str, float]
    scale: dict[str, float]
    q: dict[str, float] = field(default_factory=dict)

    def z(self, c: str) -> Column:
        return (F.col(c) - F.lit(self.center[c])) / F.lit(self.scale[c])


def _base(feats: DataFrame, mask: str | None) -> DataFrame:
    return feats.filter(mask) if mask else feats


def _fit_linear(feats: DataFrame, cols: Sequence[str], mask: str | None, center: str, scales: dict[str, dict] | None) -> Linear:
    t = scales or scales_of(_base(feats, mask), cols)
    return Linear({c: t[c][center] for c in cols}, {c: max(t[c]["scale"], 0.25) for c in cols})


def _extremes(d: DataFrame, cols: Sequence[str], floor: float) -> dict[str, float]:
    return extremes_of(d, {c: F.col(c) for c in cols}, dict.fromkeys(cols, floor))


def fit_robust_z(feats: DataFrame, spec: Spec, mask: str | None = None, scales: dict[str, dict] | None = None) -> Linear:
    cols = spec.names("value", "rstd")
    m = _fit_linear(feats, cols, mask, "med", scales)
    m.q = _extremes(_base(feats, mask).select(*[m.z(c).alias(c) for c in cols]), cols, 2.0)
    return m


def _max_score(d: DataFrame, cols: Sequence[str], spec: Spec, keep: Sequence[str] = ()) -> DataFrame:
    """Largest |feature| as the score, summed squares per signal as contributions."""
    blocks = sorted({c.split("__")[0] for c in cols})
    contrib = [sum((F.col(fname(b, s)) * F.col(fname(b, s)) for b in blocks), F.lit(0.0)).alias(f"c_{s}") for s in spec.signals]
    return d.select(*ID, *keep, F.greatest(*[F.abs(c) for c in cols]).alias("score"), *contrib)


def score_robust_z(feats: DataFrame, m: Linear, spec: Spec) -> DataFrame:
    cols = list(m.q)
    return _max_score(feats.select(*ID, *[(m.z(c) / F.lit(m.q[c])).alias(c) for c in cols]), cols, spec)


def _ewma(feats: DataFrame, m: Linear, lam: float) -> DataFrame:
    cols = list(m.center)
    d = feats.select(*[c for c in feats.columns if c in (*ID, "in_baseline")], *[m.z(c).alias(c) for c in cols])
    limit = math.sqrt(lam / (2 - lam))
    e = ordered.ewma(d, ["grp"], {f"_e{i}": F.col(c) for i, c in enumerate(cols)}, lam)
    return e.select(*[c for c in e.columns if c in (*ID, "in_baseline")], *[(F.col(f"_e{i}") / F.lit(limit)).alias(c) for i, c in enumerate(cols)])


def fit_ewma(feats: DataFrame, spec: Spec, mask: str | None = None, lam: float = 0.15, scales: dict[str, dict] | None = None) -> Linear:
    m = _fit_linear(feats, spec.names("value", "rstd"), mask, "mean", scales)
    m.q = _extremes(once(_base(_ewma(feats, m, lam), mask).select(*m.center)), list(m.center), 1.0)
    return m


def score_ewma(feats: DataFrame, m: Linear, spec: Spec, lam: float = 0.15) -> DataFrame:
    d = _ewma(feats, m, lam)
    return _max_score(d.select(*ID, *[(F.col(c) / F.lit(m.q[c])).alias(c) for c in m.q]), list(m.q), spec)


def _cusum(feats: DataFrame, m: Linear, k: float, cap: float) -> DataFrame:
    cols = list(m.center)
    d = feats.select(*[c for c in feats.columns if c in (*ID, "in_baseline")], *[m.z(c).alias(c) for c in cols])
    steps = {f"_u{i}": F.col(c) - k for i, c in enumerate(cols)} | {f"_d{i}": -F.col(c) - k for i, c in enumerate(cols)}
    r = ordered.cusum(d, ["grp"], steps)
    return r.select(*[c for c in r.columns if c in (*ID, "in_baseline")], *[F.least(F.lit(cap), F.greatest(f"_u{i}", f"_d{i}")).alias(c) for i, c in enumerate(cols)])


def fit_cusum(feats: DataFrame, spec: Spec, mask: str | None = None, k: float = 1.0, cap: float = 30.0, scales: dict[str, dict] | None = None) -> Linear:
    m = _fit_linear(feats, spec.names("value", "rstd"), mask, "mean", scales)
    m.q = _extremes(once(_base(_cusum(feats, m, k, cap), mask).select(*m.center)), list(m.center), 0.1 * cap)
    return m


def score_cusum(feats: DataFrame, m: Linear, spec: Spec, k: float = 1.0, cap: float = 30.0) -> DataFrame:
    d = _cusum(feats, m, k, cap)
    return _max_score(d.select(*ID, *[(F.col(c) / F.lit(m.q[c])).alias(c) for c in m.q]), list(m.q), spec)


def _gram(df: DataFrame, cols: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and covariance from one pass (columns x columns numbers reach the driver)."""
    from trustwatch.operators.profile import gram

    g = np.asarray(gram(df, cols).first()["m"], dtype=float).reshape(len(cols) + 1, len(cols) + 1)
    n = max(g[0, 0], 1.0)
    mu = g[0, 1:] / n
    return n, mu, g[1:, 1:] / n - np.outer(mu, mu)


def gram_sums(df: DataFrame, cols: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and covariance of any number of columns: a task sends one matrix for all its rows, cells are added up as rows."""
    k = len(cols) + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for f in batches:
            x = f.to_numpy(dtype=float)
            x = x[np.isfinite(x).all(axis=1)]
            x = np.column_stack([np.ones(len(x)), x])
            total += x.T @ x
        if total[0, 0]:
            yield pd.DataFrame({"i": np.arange(k), "x": list(total)})

    cells = df.select(*cols).mapInPandas(part, "i int, x array<double>").select("i", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    g = np.zeros((k, k))
    for r in cells.collect():
        g[r.i, r.j] = r.x
    n = max(g[0, 0], 1.0)
    mu = g[0, 1:] / n
    return n, mu, g[1:, 1:] / n - np.outer(mu, mu)


@dataclass
class Pca:
    cols: list[str]
    mean: np.ndarray
    p: np.ndarray
    lam: np.ndarray
    t2_ref: float = 1.0
    spe_ref: float = 1.0


def _pca_of(x: np.ndarray, m: Pca, signals: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """T², squared residual, score and each signal's contribution of rows."""
    owner = [c.split("__")[1] for c in m.cols]
    xc = x - m.mean
    t = xc @ m.p
    r = xc - t @ m.p.T
    t2, spe = ((t * t) / m.lam).sum(1), (r * r).sum(1)
    contrib = r * r / m.spe_ref + np.clip(xc * ((t / m.lam) @ m.p.T), 0, None) / m.t2_ref
    return t2, spe, np.maximum(t2 / m.t2_ref, spe / m.spe_ref), [contrib[:, [i for i, o in enumerate(owner) if o == s]].sum(1) for s in signals]


def _pca_raw(feats: DataFrame, m: Pca, signals: Sequence[str], keep: Sequence[str]) -> DataFrame:
    schema = ", ".join([f"{c} {t}" for c, t in feats.dtypes if c in keep] + ["t2 double", "spe double", "score double"] + [f"c_{s} double" for s in signals])
    keep = [c for c in feats.columns if c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            out["t2"], out["spe"], out["score"], parts = _pca_of(pdf[m.cols].to_numpy(dtype=float), m, signals)
            for s, part in zip(signals, parts):
                out[f"c_{s}"] = part
            yield out

    return feats.select(*keep, *m.cols).mapInPandas(run, schema)


def fit_pca(feats: DataFrame, spec: Spec, mask: str | None = None, explained: float = 0.9, max_components: int = 40) -> Pca:
    cols = spec.names("value", "rmean", "rstd")
    n, mu, cov = _gram(_base(feats, mask), cols)
    w, v = np.linalg.eigh(cov * n / max(n - 1, 1) + np.eye(len(cols)) * 1e-4)
    w, v = np.maximum(w[::-1], 1e-6), v[:, ::-1]
    k = int(np.searchsorted(np.cumsum(w) / w.sum(), explained) + 1)
    k = max(2, min(k, max_components, len(cols) - 1))
    m = Pca(cols, mu, v[:, :k], w[:k])
    q = S.quantile_rows(_pca_raw(_base(feats, mask), m, spec.signals, ID), {"t2": F.col("t2"), "spe": F.col("spe")}, [0.99])
    m.t2_ref, m.spe_ref = max(q["t2"][1][0] or 0.0, 1e-3), max(q["spe"][1][0] or 0.0, 1e-3)
    return m


def score_pca(feats: DataFrame, m: Pca, spec: Spec) -> DataFrame:
    return _pca_raw(feats, m, spec.signals, ID)


@dataclass
class Ridge:
    """Per target: coefficients of shifted peers, intercept and normal extremes. ``shift``: shifted peer to its column and lag in rows."""

    coef: dict[str, dict[str, float]]
    icpt: dict[str, float]
    q: dict[str, float] = field(default_factory=dict)
    qe: dict[str, float] = field(default_factory=dict)
    shift: dict[str, tuple[str, int]] = field(default_factory=dict)


def _shifted(feats: DataFrame, shift: dict[str, tuple[str, int]]) -> DataFrame:
    """The peers' readings ``lag`` rows earlier in their group; 0, the centre, before its first row."""
    late = {n: at for n, at in shift.items() if at[1]}
    if not late:
        return feats
    return ordered.with_windows(feats, ["grp"], lambda w: {n: F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) for n, (c, k) in late.items()}, before=max(k for _, k in late.values()))


def _residuals(feats: DataFrame, m: Ridge) -> DataFrame:
    keep = [c for c in feats.columns if c in (*ID, "in_baseline")]
    res = [(F.col(t) - F.lit(m.icpt[t]) - sum((F.lit(b) * F.col(p) for p, b in pb.items()), F.lit(0.0))).alias(t) for t, pb in m.coef.items()]
    return _shifted(feats, m.shift).select(*keep, *res)


def peer_lags(feats: DataFrame, cols: Sequence[str], mask: str | None = None, max_lag: int = 10, gain: float = 0.02) -> dict[tuple[str, str], tuple[int, float]]:
    """(target, peer) -> (lag, |r|): how many rows before the target the peer is read, and their correlation there.

    Only earlier rows of the peer are asked, so that a score never depends on rows to come. Lag 0 stays unless another one is better by ``gain``; ties: the smallest lag.
    """
    c = lags.curves(lags.lag_sums(feats, list(combinations(cols, 2)), max_lag, kinds=("x",), detrend=False, mask=F.expr(mask) if mask else None)).filter("r IS NOT NULL")
    a_leads = F.when(F.col("lag") >= 0, F.struct(F.col("b").alias("t"), F.col("a").alias("p"), F.abs("lag").alias("k"), F.abs("r").alias("r")))
    b_leads = F.when(F.col("lag") <= 0, F.struct(F.col("a").alias("t"), F.col("b").alias("p"), F.abs("lag").alias("k"), F.abs("r").alias("r")))
    sides = c.select(F.explode(F.array_compact(F.array(a_leads, b_leads))).alias("x")).select("x.*")
    best = sides.groupBy("t", "p").agg(F.coalesce(F.max(F.when(F.col("k") == 0, F.col("r"))), F.lit(0.0)).alias("r0"), F.max(F.struct("r", (-F.col("k")).alias("back"))).alias("best"))
    return {(r.t, r.p): (-r.best.back, r.best.r) if r.best.r > r.r0 + gain else (0, r.r0) for r in best.collect()}  # as many as the Gram matrix has entries


def _ridge(feats: DataFrame, spec: Spec, mask: str | None, peers: int, max_lag: int = 10) -> Ridge:
    """Each signal predicted by ridge regression from the peers that correlate most with it at their best lag."""
    cols = spec.names("value")
    best = peer_lags(feats, cols, mask, max_lag) if len(cols) > 1 else {}
    chosen, shift = {}, {}
    for t in cols:
        order = sorted((p for p in cols if (t, p) in best), key=lambda p: (-best[t, p][1], cols.index(p)))[:peers]
        chosen[t] = [p if best[t, p][0] == 0 else f"{p}__lag{best[t, p][0]}" for p in order]
        shift.update({n: (p, best[t, p][0]) for n, p in zip(chosen[t], order)})
    names = [*cols, *sorted(n for n, (_, k) in shift.items() if k)]
    at = {n: i for i, n in enumerate(names)}
    n, mu, cov = gram_sums(_base(_shifted(feats, shift), mask), names)
    m = Ridge({}, {}, shift=shift)
    for t in cols:
        j, order = at[t], [at[p] for p in chosen[t]]
        if not order:
            continue
        a = cov[np.ix_(order, order)] + 0.05 * np.eye(len(order))
        b = np.linalg.solve(a, cov[order, j])
        if cov[j, j] <= 0 or 1 - (cov[j, j] - 2 * b @ cov[order, j] + b @ cov[np.ix_(order, order)] @ b) / cov[j, j] > 0.99:
            continue  # a derived signal has no residual of its own
        m.coef[t] = {p: float(x) for p, x in zip(chosen[t], b)}
        m.icpt[t] = float(mu[j] - b @ mu[order])
    used = {p for pb in m.coef.values() for p in pb}
    m.shift = {p: x for p, x in shift.items() if p in used}
    return m


def fit_corr_break(feats: DataFrame, spec: Spec, mask: str | None = None, peers: int = PEERS, lam: float = 0.08, ridge: Ridge | None = None) -> Ridge:
    """Peers' ridge regressions, and the normal extremes of their residuals and of the residuals' running means."""
    m = replace(ridge) if ridge else _ridge(feats, spec, mask, peers)
    if not m.coef:
        return m
    targets = list(m.coef)
    e = ordered.ewma(_residuals(feats, m), ["grp"], {f"_e{i}": F.col(c) for i, c in enumerate(targets)}, lam)
    e = once(_base(e, mask).select(*targets, *[f"_e{i}" for i in range(len(targets))]))
    m.q = _extremes(e, targets, 1.0)
    qe = _extremes(e, [f"_e{i}" for i in range(len(targets))], 0.2)
    m.qe = {c: qe[f"_e{i}"] for i, c in enumerate(targets)}
    return m


def score_corr_break(feats: DataFrame, m: Ridge, spec: Spec, lam: float = 0.08) -> DataFrame:
    t = list(m.coef)
    if not t:
        return feats.select(*ID, F.lit(0.0).alias("score"), *[F.lit(0.0).alias(f"c_{s}") for s in spec.signals])
    e = ordered.ewma(_residuals(feats, m), ["grp"], {f"_e{i}": F.col(c) for i, c in enumerate(t)}, lam)
    stat = {c: F.greatest(F.abs(c) / F.lit(m.q[c]), F.abs(f"_e{i}") / F.lit(m.qe[c])) for i, c in enumerate(t)}
    contrib = [(stat[fname("value", s)] * stat[fname("value", s)] if fname("value", s) in stat else F.lit(0.0)).alias(f"c_{s}") for s in spec.signals]
    return e.select(*ID, F.greatest(F.lit(0.0), *stat.values()).alias("score"), *contrib)


@dataclass
class Spread:
    ridge: Ridge
    center: dict[str, float]
    scale: dict[str, float]


def _log_spread(feats: DataFrame, m: Ridge, window: int) -> DataFrame:
    """Log rolling standard deviation of every residual; null while the window fills."""
    d = ordered.with_windows(_residuals(feats, m), ["grp"], lambda w: {f"_s{i}": F.log(F.coalesce(F.stddev_pop(c).over(w.rowsBetween(-(window - 1), 0)), F.lit(0.0)) + RSTD_EPS) for i, c in enumerate(m.coef)}, before=window - 1)
    keep = [c for c in feats.columns if c in (*ID, "in_baseline")]
    return d.select(*keep, *[F.when(F.col("pos") >= max(3, window // 4), F.col(f"_s{i}")).alias(c) for i, c in enumerate(m.coef)])


def fit_resid_spread(feats: DataFrame, spec: Spec, mask: str | None = None, ridge: Ridge | None = None) -> Spread:
    """How widely the residuals of ``corr_break`` spread within a window, normally."""
    m = ridge or _ridge(feats, spec, mask, PEERS)
    t = scales_of(once(_base(_log_spread(feats, m, spec.window), mask).select(*m.coef)), list(m.coef)) if m.coef else {}
    return Spread(m, {c: t[c]["med"] for c in t}, {c: max(t[c]["scale"], 0.25) for c in t})


def score_resid_spread(feats: DataFrame, m: Spread, spec: Spec) -> DataFrame:
    """The largest standardised log spread is the score."""
    if not m.center:
        return feats.select(*ID, F.lit(0.0).alias("score"), *[F.lit(0.0).alias(f"c_{s}") for s in spec.signals])
    stat = {c: F.coalesce(F.abs((F.col(c) - F.lit(m.center[c])) / F.lit(m.scale[c])), F.lit(0.0)) for c in m.center}
    contrib = [(stat[fname("value", s)] * stat[fname("value", s)] if fname("value", s) in stat else F.lit(0.0)).alias(f"c_{s}") for s in spec.signals]
    return _log_spread(feats, m.ridge, spec.window).select(*ID, F.greatest(F.lit(0.0), *stat.values()).alias("score"), *contrib)


def first_hashed(d: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys (a hash), equal ones by row. Tasks pass on about as many rows as are wanted, not ``n`` each: the others' keys lie above a bound
    that far more than ``n`` rows are below (counted; if not, all rows take part)."""
    total = d.count()
    if total > 4 * n:
        bound = int(-(1 << 63) + (1 << 64) * (1.1 * n + 1000) / total)
        low = d.filter(key <= F.lit(bound))
        d = low if low.count() >= n else d
    return d.orderBy(key, "row").limit(n)


def fit_iforest(feats: DataFrame, spec: Spec, mask: str | None = None, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """One tree per task, each on its own hash-chosen rows. Returns tree, nodes (feature, threshold, left, right, size)."""
    cols = spec.names("value", "rmean", "rstd")
    rows = first_hashed(_base(feats, mask), F.xxhash64("row", F.lit(seed)), trees * sample)
    t = rows.select(F.pmod(F.xxhash64("row", F.lit(seed + 1)), F.lit(trees)).cast("int").alias("tree"), "row", *cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("row")[cols].to_numpy(dtype=float)
        rng = np.random.default_rng(int(pdf["tree"].iloc[0]) + seed)
        limit = math.ceil(math.log2(max(2, len(x))))
        nodes: list[list[float]] = []

        def split(idx: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1.0, 0.0, 0.0, 0.0, float(len(idx))])
            if depth >= limit or len(idx) <= 1:
                return at
            lo, hi = x[idx].min(0), x[idx].max(0)
            able = np.flatnonzero(hi > lo)
            if not len(able):
                return at
            f = int(rng.choice(able))
            thr = float(rng.uniform(lo[f], hi[f]))
            left = x[idx, f] < thr
            a, b = split(idx[left], depth + 1), split(idx[~left], depth + 1)
            nodes[at] = [float(f), thr, float(a), float(b), float(len(idx))]
            return at

        split(np.arange(len(x)), 0)
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "nodes": [nodes], "n": [len(x)]})

    return t.groupBy("tree").applyInPandas(grow, "tree int, nodes array<array<double>>, n long")


def _path(n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _compiled(model: list[tuple[np.ndarray, int]]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]], float]:
    """Per tree: feature, threshold, both children (a leaf is its own child on the left), path length and depth; and the sum of the trees' normal path lengths."""
    out = []
    for nodes, n in model:
        leaf = nodes[:, 0] < 0
        own = np.arange(len(nodes))
        kids = np.column_stack([np.where(leaf, own, nodes[:, 2]), np.where(leaf, own, nodes[:, 3])]).astype(np.int64)
        level = np.zeros(len(nodes))
        for i in np.flatnonzero(~leaf):  # parents come before their children
            level[kids[i]] = level[i] + 1
        out.append((np.where(leaf, 0, nodes[:, 0]).astype(np.int64), np.where(leaf, np.inf, nodes[:, 1]), kids.ravel(), level + _path(nodes[:, 4]), int(level.max())))
    return out, sum(float(_path(np.array([n]))[0]) for _, n in model)


def _forest_of(x: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]], ref: float) -> np.ndarray:
    """Isolation score of rows, a tree and a level at a time."""
    flat, first, depth = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    for feature, cut, kids, path, levels in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(levels):
            right = flat.take(first + feature.take(at)) >= cut.take(at)
            at = kids.take(2 * at + right)
        depth += path.take(at)
    return 2.0 ** (-depth / max(ref, 1e-9))


def score_iforest(feats: DataFrame, model: list[tuple[np.ndarray, int]], spec: Spec) -> DataFrame:
    cols = spec.names("value", "rmean", "rstd")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, ref = _compiled(model)
        for pdf in batches:
            yield pd.DataFrame({**{c: pdf[c] for c in ID}, "score": _forest_of(pdf[cols].to_numpy(dtype=float), trees, ref)})

    return feats.select(*ID, *cols).mapInPandas(run, ", ".join(f"{c} {t}" for c, t in feats.select(*ID).dtypes) + ", score double")


# ------------------------------------------------------------------ folds
def group_folds(groups: DataFrame, duplicates: DataFrame, k: int) -> DataFrame:
    """Fold of each group: near-duplicates stay together, families are dealt in order of size (largest first)."""
    d = families(groups, duplicates)
    sizes = d.groupBy("component").agg(F.sum("n_rows").alias("n"))
    r = F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1
    snake = F.when(F.pmod(F.floor(r / k), F.lit(2)) == 0, F.pmod(r, F.lit(k))).otherwise(k - 1 - F.pmod(r, F.lit(k)))
    return d.join(sizes.select("component", snake.cast("int").alias("fold")), "component").select("grp", "fold", "n_rows")


# ------------------------------------------------------------------ ensemble
def combine(norm: Sequence[Column], cap: float = 20.0) -> Column:
    """0.7 of the largest plus 0.3 of the mean of the three largest normalised scores."""
    a = F.sort_array(F.array(*[F.least(F.lit(cap), c) for c in norm]), asc=False)
    k = min(3, len(norm))
    top = F.aggregate(F.slice(a, 1, k), F.lit(0.0), lambda x, y: x + y) / F.lit(float(k))
    return 0.7 * F.element_at(a, 1) + 0.3 * top


def grown_forest(feats: DataFrame, spec: Spec, mask: str | None = None) -> list[tuple[np.ndarray, int]]:
    """The trees of an isolation forest as arrays: trees x 2 * sample nodes, whatever the table."""
    return [(np.asarray(r["nodes"], dtype=float), r["n"]) for r in fit_iforest(feats, spec, mask).orderBy("tree").collect()]


def score_grown_forest(feats: DataFrame, trees: list[tuple[np.ndarray, int]], spec: Spec) -> DataFrame:
    """Isolation scores; no signal is named as their cause."""
    return score_iforest(feats, trees, spec).select("*", *[F.lit(0.0).alias(f"c_{s}") for s in spec.signals])


DETECTORS = {"robust_z": (fit_robust_z, score_robust_z), "ewma": (fit_ewma, score_ewma), "cusum": (fit_cusum, score_cusum), "pca": (fit_pca, score_pca), "corr_break": (fit_corr_break, score_corr_break),
             "resid_spread": (fit_resid_spread, score_resid_spread), "iforest": (grown_forest, score_grown_forest)}
CAP = 20.0


SEQUENTIAL = ("ewma", "cusum", "corr_break", "resid_spread")
LAM, RESID_LAM, DRIFT, CUSUM_CAP = 0.15, 0.08, 1.0, 30.0
RUN_ROWS = 2048
"""Rows of a chunk in ``running``: with its halo short enough for the weights of running means."""


def _halo(lam: float) -> int:
    return math.ceil(17 * math.log(10) / -math.log(1.0 - lam))


def _ridges(fits: dict) -> dict[str, Ridge]:
    """The regressions that have targets, by the prefix of their residuals."""
    both = {"_c": fits.get("corr_break"), "_s": fits["resid_spread"].ridge if "resid_spread" in fits else None}
    return {k: r for k, r in both.items() if r is not None and r.coef}


def _cusum_steps(m: Linear) -> dict[str, Column]:
    out = {}
    for c in m.center:
        z = F.coalesce(m.z(c), F.lit(0.0))
        out |= {f"_u_{c}": z - DRIFT, f"_d_{c}": -z - DRIFT}
    return out


def _cusum_starts(feats: DataFrame, m: Linear, chunk_rows: int) -> DataFrame:
    """Of groups longer than a chunk, per chunk: what the running sums of earlier chunks come to (_o) and their smallest value so far (_g)."""
    steps = _cusum_steps(m)
    d = feats.join(feats.filter(F.col("pos") >= chunk_rows).select("grp").distinct(), "grp", "left_semi")
    d = ordered.chunked(d.select("grp", "pos", *m.center), chunk_rows=chunk_rows)
    d = d.withColumns({k: F.sum(v).over(ordered.chunk_window(["grp"]).rowsBetween(Window.unboundedPreceding, 0)) for k, v in steps.items()})
    t = d.groupBy("grp", ordered.CHUNK).agg(*[F.max_by(k, "pos").alias(f"_t{k}") for k in steps], *[F.min(k).alias(f"_n{k}") for k in steps])
    before = Window.partitionBy("grp").orderBy(ordered.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({f"_o{k}": F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0.0)) for k in steps})
    return t.select("grp", ordered.CHUNK, *[f"_o{k}" for k in steps], *[F.min(F.col(f"_o{k}") + F.col(f"_n{k}")).over(before).alias(f"_g{k}") for k in steps])


def running(feats: DataFrame, fits: dict, spec: Spec, chunk_rows: int = RUN_ROWS) -> DataFrame:
    """``feats`` with all that ``fits`` keep along a group: ewma__<feature>, cusum__<feature>, and per regression (_c, _s) the residual _cr_<target>, its running mean _ce_<target> or its
    log spread _ss_<target>. All of it comes from one shuffle by (group, chunk), with a halo of rows copied from the chunk before."""
    ridges = _ridges(fits)
    if not ridges and not {"ewma", "cusum"} & set(fits):
        return feats
    shift = {n: at for r in ridges.values() for n, at in r.shift.items() if at[1]}
    halo = max(_halo(LAM), _halo(RESID_LAM), spec.window) + max([k for _, k in shift.values()], default=0)
    d = ordered.chunked(feats, before=halo, chunk_rows=chunk_rows)
    w = ordered.chunk_window(["grp"])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = (F.col("pos") - (F.col(ordered.CHUNK) * chunk_rows - halo)).cast("double")
    d = d.withColumns({f"_p{i}": F.pow(F.lit(1.0 - lam), -t) for i, lam in enumerate((LAM, RESID_LAM))})
    first = {n: F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) for n, (c, k) in shift.items()}
    drop = ["_p0", "_p1", *first]
    if "ewma" in fits:
        first |= {f"ewma__{c}": F.lit(math.sqrt(LAM * (2 - LAM))) / F.col("_p0") * F.sum(F.coalesce(fits["ewma"].z(c), F.lit(0.0)) * F.col("_p0")).over(upto) for c in fits["ewma"].center}
    steps = _cusum_steps(fits["cusum"]) if "cusum" in fits else {}
    first |= {k: F.sum(F.when(F.col(ordered.OWN), v).otherwise(F.lit(0.0))).over(upto) for k, v in steps.items()}
    d = d.withColumns(first)
    d = d.withColumns({f"{k}r_{c}": F.col(c) - F.lit(r.icpt[c]) - sum((F.lit(b) * F.col(p) for p, b in pb.items()), F.lit(0.0)) for k, r in ridges.items() for c, pb in r.coef.items()})
    second = {f"_m{k}": F.min(k).over(upto) for k in steps}
    if "_c" in ridges:
        second |= {f"_ce_{c}": F.lit(RESID_LAM) / F.col("_p1") * F.sum(F.coalesce(F.col(f"_cr_{c}"), F.lit(0.0)) * F.col("_p1")).over(upto) for c in ridges["_c"].coef}
    if "_s" in ridges:
        roll = w.rowsBetween(-(spec.window - 1), 0)
        second |= {f"_ss_{c}": F.when(F.col("pos") >= max(3, spec.window // 4), F.log(F.coalesce(F.stddev_pop(f"_sr_{c}").over(roll), F.lit(0.0)) + RSTD_EPS)) for c in ridges["_s"].coef}
        drop += [f"_sr_{c}" for c in ridges["_s"].coef]
    d = d.withColumns(second)
    if steps:
        starts = _cusum_starts(feats, fits["cusum"], chunk_rows)
        d = d.join(starts, ["grp", ordered.CHUNK], "left")
        zero = F.lit(0.0)
        at = {k: F.coalesce(F.col(f"_o{k}"), zero) for k in steps}
        d = d.withColumns({f"_x{k}": o + F.col(k) - F.least(zero, F.coalesce(F.col(f"_g{k}"), zero), o + F.col(f"_m{k}")) for k, o in at.items()})
        d = d.withColumns({f"cusum__{c}": F.least(F.lit(CUSUM_CAP), F.greatest(f"_x_u_{c}", f"_x_d_{c}")) for c in fits["cusum"].center})
        drop += [f"{p}{k}" for k in steps for p in ("", "_m", "_o", "_g", "_x")]
    return ordered.owned(d).drop(*drop)


def _fitted(names: Sequence[str], feats: DataFrame, spec: Spec, mask: str | None, rows: str | None = None) -> tuple[dict, DataFrame]:
    """The detectors, and the rows of ``rows`` (all) with the running statistics that they score: written once, for fits and for scores."""
    base = _base(feats, mask)
    fits: dict = {}
    if {"robust_z", "ewma", "cusum"} & set(names):
        scales = scales_of(base, spec.names("value", "rstd"))
        fits |= {n: _fit_linear(feats, spec.names("value", "rstd"), mask, "med" if n == "robust_z" else "mean", scales) for n in ("robust_z", "ewma", "cusum") if n in names}
    if {"corr_break", "resid_spread"} & set(names):
        ridge = _ridge(feats, spec, mask, PEERS)
        fits |= {"corr_break": replace(ridge, q={}, qe={})} if "corr_break" in names else {}
        fits |= {"resid_spread": Spread(ridge, {}, {})} if "resid_spread" in names else {}
    keep = [c for c in feats.columns if c in (*ID, "in_baseline", "in_calibration")]
    d = running(feats.select(*keep, *spec.names("value", "rmean", "rstd")), fits, spec)
    if set(SEQUENTIAL) & set(names):
        d = once(d.filter(rows) if rows else d)
    base = _base(d, mask)
    cols, floors = {}, {}
    for n, floor in (("robust_z", 2.0), ("ewma", 1.0), ("cusum", 0.1 * CUSUM_CAP)):
        if n in fits:
            cols |= {f"{n}__{c}": fits[n].z(c) if n == "robust_z" else F.col(f"{n}__{c}") for c in fits[n].center}
            floors |= {f"{n}__{c}": floor for c in fits[n].center}
    residuals = list(fits["corr_break"].coef) if "corr_break" in fits else []
    for k, floor in (("_cr_", 1.0), ("_ce_", 0.2)):
        cols |= {k + c: F.col(k + c) for c in residuals}
        floors |= {k + c: floor for c in residuals}
    q = extremes_of(base, cols, floors)
    for n in ("robust_z", "ewma", "cusum"):
        if n in fits:
            fits[n].q = {c: q[f"{n}__{c}"] for c in fits[n].center if f"{n}__{c}" in q}
    if residuals:
        fits["corr_break"].q, fits["corr_break"].qe = {c: q[f"_cr_{c}"] for c in residuals}, {c: q[f"_ce_{c}"] for c in residuals}
    if "resid_spread" in fits and fits["resid_spread"].ridge.coef:
        t = scales_of(base, [f"_ss_{c}" for c in fits["resid_spread"].ridge.coef])
        fits["resid_spread"] = Spread(fits["resid_spread"].ridge, {c[4:]: r["med"] for c, r in t.items()}, {c[4:]: max(r["scale"], 0.25) for c, r in t.items()})
    for n in names:
        if n not in fits:
            fits[n] = DETECTORS[n][0](base, spec)
    return {n: fits[n] for n in names}, d


def fit_detectors(names: Sequence[str], feats: DataFrame, spec: Spec, mask: str | None = None) -> dict:
    """The detectors fitted together: scales, regressions and running statistics that several of them stand on are found once."""
    return _fitted(names, feats, spec, mask)[0]


@dataclass
class Model:
    spec: Spec
    fitted: dict
    thresholds: dict[str, float]
    ensemble: float = 1.0


def _matrix_scores(d: DataFrame, m: Model) -> DataFrame:
    """``d`` with the scores of the ellipsoid (pca, pca_<signal>) and the forest (iforest), both in one pass of Arrow batches; the other columns travel as they are."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    pca, forest, signals = m.fitted.get("pca"), m.fitted.get("iforest"), m.spec.signals
    if pca is None and forest is None:
        return d
    cols, new = m.spec.names("value", "rmean", "rstd"), (["pca", *[f"_pca_{s}" for s in signals]] if pca is not None else []) + (["iforest"] if forest is not None else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _compiled(forest) if forest is not None else None
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in cols]) if b.num_rows else np.zeros((0, len(cols)))
            out = []
            if pca is not None:
                _, _, score, parts = _pca_of(x, pca, signals)
                out += [score, *parts]
            if trees is not None:
                out.append(_forest_of(x, *trees))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v) for v in out]], [*b.schema.names, *new])

    return d.mapInArrow(run, StructType([*d.schema.fields, *[StructField(n, DoubleType()) for n in new]]))


def _scores_of(d: DataFrame, m: Model) -> DataFrame:
    """``raw_scores`` of rows that have their ``running`` statistics: row by row, no shuffle and no join."""
    spec, zero = m.spec, F.lit(0.0)
    score, share = {}, {}
    for n, fit in m.fitted.items():
        contrib = dict.fromkeys(spec.signals, zero)
        if n in ("robust_z", "ewma", "cusum"):
            stat = {c: (fit.z(c) if n == "robust_z" else F.col(f"{n}__{c}")) / F.lit(q) for c, q in fit.q.items()}
            score[n] = F.greatest(*[F.abs(x) for x in stat.values()])
            contrib = {s: sum((x * x for c, x in stat.items() if c.split("__")[1] == s), zero) for s in spec.signals}
        elif n in ("corr_break", "resid_spread"):
            if n == "corr_break":
                stat = {c: F.greatest(F.abs(f"_cr_{c}") / F.lit(fit.q[c]), F.abs(f"_ce_{c}") / F.lit(fit.qe[c])) for c in fit.coef}
            else:
                stat = {c: F.coalesce(F.abs((F.col(f"_ss_{c}") - F.lit(fit.center[c])) / F.lit(fit.scale[c])), zero) for c in fit.center}
            score[n] = F.greatest(zero, *stat.values()) if stat else zero
            contrib |= {s: stat[fname("value", s)] * stat[fname("value", s)] for s in spec.signals if fname("value", s) in stat}
        else:
            score[n] = F.col(n)
            contrib = {s: F.col(f"_pca_{s}") for s in spec.signals} if n == "pca" else contrib
        share[n] = contrib
    used = list(dict.fromkeys([*ID, *[c for c in d.columns if c in ("in_baseline", "in_calibration")], *spec.names("value", "rmean", "rstd"), *[c for c in d.columns if c.startswith(("ewma__", "cusum__", "_cr_", "_ce_", "_ss_"))]]))
    d = _matrix_scores(d.select(*used), m)
    marks = [c for c in used if c in ("in_baseline", "in_calibration")]
    d = d.select(*ID, *marks, *[score[n].alias(n) for n in score], *[share[n][s].alias(f"_{n}_{s}") for n in share for s in spec.signals])
    total = {n: F.greatest(sum((F.col(f"_{n}_{s}") for s in spec.signals), zero), F.lit(1e-9)) for n in score}
    return d.select(*ID, *marks, *score, *[(F.col(f"_{n}_{s}") / total[n]).alias(f"{n}_{s}") for n in score for s in spec.signals])


def raw_scores(feats: DataFrame, m: Model) -> DataFrame:
    """Score of every detector as it is, and its share of each signal: one shuffle for what runs along a group, then row by row."""
    d = feats.select(*ID, *m.spec.names("value", "rmean", "rstd"))
    return _scores_of(running(d, m.fitted, m.spec), m)


def score_detectors(feats: DataFrame, m: Model) -> DataFrame:
    """Normalised scores of every detector, the ensemble and the share of each signal."""
    names = list(m.fitted)
    norm = [F.least(F.lit(CAP), F.col(n) / F.lit(max(m.thresholds.get(n, 1.0), 1e-9))).alias(n) for n in names]
    d = raw_scores(feats, m).select("grp", "row", "pos", *norm, *[f"{n}_{s}" for n in names for s in m.spec.signals])
    w = sum((F.col(n) for n in names), F.lit(0.0))
    shares = [sum((F.col(n) / F.greatest(w, F.lit(1e-6)) * F.col(f"{n}_{s}") for n in names), F.lit(0.0)).alias(f"share_{s}") for s in m.spec.signals]
    raw = combine([F.col(n) for n in names])
    return d.select("grp", "row", "pos", *names, raw.alias("raw"), (raw / F.lit(m.ensemble)).alias("score"), *shares)


def _fence(d: DataFrame, names: Sequence[str], q: float, margin: float) -> dict[str, float]:
    """``S.threshold_of`` of each column."""
    t = S.quantile_rows(d, {n: F.col(n) for n in names}, (q, 0.9, 0.75, 0.25, 0.5))
    return {n: max(min(a, max(c + 3 * (c - d), b)) * margin, 1.5 * e, 1e-6) if rows else 1e-6 for n, (rows, (a, b, c, d, e)) in t.items()}


def fit_model(wide: DataFrame, signals: Sequence[str], detectors: Sequence[str] = ("robust_z", "ewma", "cusum"), window: int = 20, mask: Column | None = None, calibration: Column | None = None, trim: bool = True, calibrate: bool = True) -> Model:
    """Fit on the rows of ``mask``; drop those that the fitted ensemble itself finds beyond their own fence (unless they are many) and fit again;
    take every detector's threshold, and the ensemble's, from the rows of ``calibration`` (those of ``mask`` if there are none). Without ``calibrate`` there are no thresholds."""
    true = F.lit(True)
    src = wide.withColumns({"in_baseline": mask if mask is not None else true, "in_calibration": calibration if calibration is not None else (mask if mask is not None else true)})
    marks = ["in_baseline", "in_calibration"]
    used = "in_baseline OR in_calibration"
    spec = fit_raw(src, signals, window, F.col("in_baseline"))
    blocks = once(raw_blocks(src, spec, marks))
    feats = standardised(blocks, fit_blocks(blocks, spec, "in_baseline"), marks)
    names = list(detectors)
    fitted, d = _fitted(names, feats, spec, "in_baseline", used)
    m = Model(spec, fitted, {})

    def scored(rows: str) -> DataFrame:
        return once(_scores_of(d.filter(rows), m).select("grp", "row", *names))

    if trim:
        own = scored("in_baseline")
        thr = _fence(own, names, 0.995, 1.1)
        own = own.withColumn("_e", combine([F.least(F.lit(CAP), F.col(n) / F.lit(thr[n])) for n in names]))
        beyond = once(own.filter(F.col("_e") > F.lit(_fence(own, ["_e"], 0.995, 1.0)["_e"])).select("grp", "row", F.lit(1).alias("_hot")))
        if 0 < beyond.count() < 0.4 * own.count():
            feats = once(feats.join(beyond, ["grp", "row"], "left").withColumn("in_baseline", F.col("in_baseline") & F.col("_hot").isNull()).drop("_hot"))
            m.fitted, d = _fitted(names, feats, spec, "in_baseline", used)
    if not calibrate:
        return m
    rows = scored("in_calibration")
    if rows.isEmpty():
        rows = scored("in_baseline")
    m.thresholds = _fence(rows, names, 0.995, 1.1)
    both = rows.select(combine([F.least(F.lit(CAP), F.col(n) / F.lit(m.thresholds[n])) for n in names]).alias("_e"))
    m.ensemble = max(_fence(both, ["_e"], 0.99, 1.0)["_e"], 0.05)
    return m


def score_rows(wide: DataFrame, m: Model) -> DataFrame:
    return score_detectors(features(wide, m.spec), m)


def dilated(rows: DataFrame, mask: Column, around: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the mask, or a row of it within ``around`` rows of the same group (a normal core is too calm to calibrate on alone)."""
    d = rows.withColumn("_m", mask.cast("int"))
    return ordered.with_windows(d, ["grp"], lambda w: {out: F.max("_m").over(w.rowsBetween(-around, around)) == 1}, before=around, after=around).drop("_m")


def fit_folds(wide: DataFrame, folds: DataFrame, k: int, signals: Sequence[str], duplicates: DataFrame | None = None, baseline: Column | None = None, window: int = 20, **how) -> dict[int, Model]:
    """One model per fold, which never saw the fold's groups. Of the other groups whole families are kept back for calibration: detectors are fitted
    on baseline rows of the rest, thresholds come from the baseline rows of those kept back and their neighbours within a window."""
    base = baseline if baseline is not None else F.lit(True)
    d = wide.join(folds.select("grp", "fold"), "grp").withColumn("_base", base)
    models = {}
    for f in range(k):
        others = folds.filter(F.col("fold") != f).select("grp", "n_rows")
        split = once(train_val_split(others, duplicates, 0.25, f).select("grp", "is_val"))
        mine = dilated(d.join(split, "grp"), F.col("is_val") & F.col("_base"), window, "_near").withColumn("_cal", F.col("is_val") & F.col("_near"))
        models[f] = fit_model(once(mine), signals, window=window, mask=~F.col("is_val") & F.col("_base"), calibration=F.col("_cal"), **how)
    return models


def fit_final(wide: DataFrame, signals: Sequence[str], folds: dict[int, Model], **how) -> Model:
    """A model of all baseline rows with the median thresholds of the folds' models, which come from rows they were not fitted on."""
    m = fit_model(wide, signals, calibrate=False, **how)
    m.thresholds = {n: float(np.median([f.thresholds[n] for f in folds.values()])) for n in m.fitted}
    m.ensemble = float(np.median([f.ensemble for f in folds.values()]))
    return m


def score_all(wide: DataFrame, folds: DataFrame, models: dict[int, Model]) -> DataFrame:
    """Every row scored by the model that never saw its group."""
    d = wide.join(folds.select("grp", "fold"), "grp")
    parts = [score_rows(d.filter(F.col("fold") == f), m).withColumn("fold", F.lit(f)) for f, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_signals(scores: DataFrame, signals: Sequence[str], k: int = 3) -> DataFrame:
    """The k signals with the largest shares per row."""
    a = F.slice(F.sort_array(F.array(*[F.struct(F.col(f"share_{s}").alias("share"), F.lit(s).alias("signal")) for s in signals]), asc=False), 1, k)
    return scores.select("grp", "row", "score", a.alias("top"))


def select_detectors(fold_thresholds: DataFrame, scores: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Reliability: half stability of the thresholds over folds, half mean rank agreement with the other detectors."""
    from trustwatch.operators.profile import spearman_matrix

    st = fold_thresholds.groupBy("detector").agg((1 - F.least(F.lit(1.0), F.coalesce(F.stddev_pop("threshold") / F.avg("threshold"), F.lit(0.0)))).alias("stability"))
    r = spearman_matrix(scores, detectors)
    both = r.select(F.col("a").alias("detector"), "r").unionByName(r.select(F.col("b").alias("detector"), "r"))
    ag = both.groupBy("detector").agg(F.avg(F.greatest(F.lit(0.0), F.col("r"))).alias("agreement"))
    d = st.join(ag, "detector").withColumn("reliability", 0.5 * F.col("stability") + 0.5 * F.col("agreement"))
    best = d.agg(F.max("reliability").alias("_b"))
    return d.crossJoin(F.broadcast(best)).withColumn("selected", F.col("reliability") >= 0.6 * F.col("_b")).drop("_b")


def rescore(wide: DataFrame, m: Model, a: int, b: int) -> DataFrame:
    """Rows [a, b] scored again. Running statistics reach back to the start of a group, so the rows before [a, b] of its groups are scored with it:
    the result is that of a full score."""
    touched = wide.filter(F.col("row").between(a, b)).select("grp").distinct()
    return score_rows(wide.filter(F.col("row") <= b).join(touched, "grp", "left_semi"), m).filter(F.col("row").between(a, b))
