"""Which rows are normal, without labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import ordered
from trustwatch.operators.changes import change_points
from trustwatch.operators.quality import once

BINS = 200


def zscores(wide: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Signals standardised by median and robust scale, clipped at 10, gaps as 0; columns z_<signal>."""
    from trustwatch.operators.detect import scales_of

    t = scales_of(wide, signals)
    z = [F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.coalesce((F.col(s) - F.lit(t[s]["med"])) / F.lit(max(t[s]["scale"], 1e-6)), F.lit(0.0)))).alias(f"z_{s}") for s in signals]
    return wide.select("grp", "row", "pos", *z)


def modes(z: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Density mode of each signal: 200 bins on -10..10, smoothed over 5 bins."""
    long = z.select(*cols).unpivot([], list(cols), "signal", "z")
    b = F.least(F.lit(BINS - 1), F.floor((F.col("z") + 10.0) * 10.0 + 1e-9).cast("int"))
    h = once(long.groupBy("signal", b.alias("bin")).agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy("signal").orderBy("bin").rangeBetween(-2, 2)
    bins = h.select("signal").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    h = bins.join(h, ["signal", "bin"], "left").withColumn("sm", F.sum(F.coalesce("c", F.lit(0))).over(w))
    return h.groupBy("signal").agg((F.max_by("bin", F.struct("sm", -F.col("bin"))) * 0.1 - 10.0 + 0.05).alias("mode"))


def typicality(z: DataFrame, cols: Sequence[str]) -> DataFrame:
    m = {r["signal"]: r["mode"] for r in modes(z, cols).collect()}  # one row per signal
    t = sum((F.exp(-0.5 * (F.col(c) - F.lit(m[c])) * (F.col(c) - F.lit(m[c]))) for c in cols), F.lit(0.0)) / float(len(cols))
    return z.select("grp", "row", "pos", t.alias("typ"))


def otsu(d: DataFrame, col: str, bins: int = 128) -> DataFrame:
    """Otsu's threshold from a histogram: everything after the counts runs on at most ``bins`` rows."""
    lim = d.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"))
    h = d.crossJoin(F.broadcast(lim)).groupBy(b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
    step = (F.col("hi") - F.col("lo")) / bins
    h = h.withColumn("x", F.col("lo") + (F.col("bin") + 0.5) * step)
    up, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    h = h.withColumns({"w0": F.sum("c").over(up), "s0": F.sum(F.col("c") * F.col("x")).over(up), "w": F.sum("c").over(every), "s": F.sum(F.col("c") * F.col("x")).over(every)})
    w1 = F.col("w") - F.col("w0")
    diff = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0))
    between = F.coalesce(F.col("w0") * w1 * diff * diff, F.lit(-1.0))
    return h.withColumn("g", between).agg((F.max_by("lo", F.struct("g", -F.col("bin"))) + (F.max_by("bin", F.struct("g", -F.col("bin"))) + 1) * F.max(step)).alias("otsu"))


def mode_threshold(t: DataFrame) -> DataFrame:
    """thr (one row): Otsu's threshold of ``typ``, clamped to its 10-70 % quantiles. ``t`` is read several times: write it first."""
    q = S.wide_quantiles(t, {"typ": F.col("typ")}, (0.1, 0.7)).select(F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi")).crossJoin(F.broadcast(otsu(t, "typ")))
    return q.select(F.least(F.greatest("otsu", "lo"), F.col("hi")).alias("thr"))


def baseline_modes(z: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where most signals sit near their density mode (threshold by Otsu, clamped to the 10-70 % quantiles)."""
    t = typicality(z, cols)
    thr = mode_threshold(t.select("typ"))
    return t.crossJoin(F.broadcast(thr)).select("row", "grp", "pos", (F.col("typ") >= F.col("thr")).alias("in_baseline"))


def best_split(d: DataFrame, value: str, min_size: int, keys: Sequence[str] = ("grp",), pos: str = "pos", row: str = "row") -> DataFrame:
    """The split of each series with the largest l2 gain, from running sums in two levels.

    Returns keys, row and pos of the first row after the split, gain, shift and effect (shift / pooled std)."""
    x = F.col(value)
    r = ordered.running_sums(d.select(*dict.fromkeys([*keys, row, pos, value])), list(keys), {"c1": x, "c2": x * x, "cn": F.lit(1.0)}, pos=pos)
    tot = d.groupBy(*keys).agg(F.sum(x).alias("t1"), F.sum(x * x).alias("t2"), F.count(x).cast("double").alias("m"))
    r = r.join(tot, list(keys))
    t, m = F.col("cn"), F.col("m")
    a = F.col("c2") - F.col("c1") * F.col("c1") / t
    b = (F.col("t2") - F.col("c2")) - (F.col("t1") - F.col("c1")) * (F.col("t1") - F.col("c1")) / F.nullif(m - t, F.lit(0.0))
    gain = (F.col("t2") - F.col("t1") * F.col("t1") / m) - a - b
    r = r.filter((t >= min_size) & (m - t >= min_size)).withColumns({"gain": gain, "va": a / t, "vb": b / (m - t), "shift": (F.col("t1") - F.col("c1")) / (m - t) - F.col("c1") / t})
    pick = F.struct("gain", (-F.col(pos)).alias("_p"))
    best = r.groupBy(*keys).agg(F.max_by(F.struct(F.col(row).alias("row"), F.col(pos).alias("pos"), "gain", "shift", "va", "vb"), pick).alias("b"))
    e = F.abs("b.shift") / F.sqrt((F.col("b.va") + F.col("b.vb")) / 2.0 + 0.05)
    return best.select(*keys, (F.col("b.row") + 1).alias("row"), (F.col("b.pos") + 1).alias("pos"), F.col("b.gain").alias("gain"), F.col("b.shift").alias("shift"), e.alias("effect"))


def window_means(d: DataFrame, values: Sequence[str], window: int) -> DataFrame:
    """Means of runs of ``window`` rows of each group; pos counts the runs."""
    return d.groupBy("grp", F.floor(F.col("pos") / window).cast("long").alias("pos")).agg(*[F.avg(v).alias(v) for v in values])


def segment_by_change(d: DataFrame, values: Sequence[str] | str, window: int, effect: float = 2.0) -> DataFrame:
    """Change-point segments of window means over all ``values``, cut to the end."""
    values = [values] if isinstance(values, str) else list(values)
    return change_points(window_means(d, values, window), values, 3, effect).select("grp", (F.col("pos") * window).alias("pos"))


def pca_residual(z: DataFrame, cols: Sequence[str], explained: float = 0.9, out: str = "residual") -> DataFrame:
    """``z`` with log(1 + squared distance from the leading principal components), an expression over the columns."""
    from trustwatch.operators.detect import _gram

    _, mu, cov = _gram(z, cols)
    w, v = np.linalg.eigh(cov + 1e-6 * np.eye(len(cols)))
    w, v = w[::-1], v[:, ::-1]
    k = min(int(np.searchsorted(np.cumsum(w) / w.sum(), explained) + 1), len(cols) - 1) if len(cols) > 1 else 0
    rest = v[:, k:]
    x = [F.coalesce(F.col(c), F.lit(float(m))) - F.lit(float(m)) for c, m in zip(cols, mu)]
    off = [sum((F.lit(float(rest[i, j])) * x[i] for i in range(len(cols))), F.lit(0.0)) for j in range(rest.shape[1])]
    return z.withColumn(out, F.log1p(sum((o * o for o in off), F.lit(0.0))))


def baseline_prechange(z: DataFrame, cols: Sequence[str] | str, window: int, margin: int = 0, residual: bool = True) -> DataFrame:
    """Rows before the first significant change of their group's window means, in any column or in the residual of their common movement."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    d, values = (pca_residual(z, cols), [*cols, "residual"]) if residual and len(cols) > 1 else (z, cols)
    c = change_points(window_means(d, values, window), values, 3, 2.0, 1.5).groupBy("grp").agg((F.min("pos") * window - margin).alias("_cut"))
    return z.join(c, "grp", "left").select("row", "grp", "pos", (F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))).alias("in_baseline"))


def baseline_early(z: DataFrame, cols: Sequence[str], window: int, share: float = 0.4) -> DataFrame:
    """The first 40 % of each group, cut at its first change in any column or in the residual."""
    n = z.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    pre = baseline_prechange(z, cols, window).select("grp", "row", F.col("in_baseline").alias("_b"))
    return z.join(n, "grp").join(pre, ["grp", "row"]).select("row", "grp", "pos", (F.col("_b") & (F.col("pos") < share * F.col("_n"))).alias("in_baseline"))


def baseline_dense(z: DataFrame, cols: Sequence[str], window: int, k: int = 4, min_share: float = 0.12, seed: int = 1) -> DataFrame:
    """Windows of the tightest k-means cluster of (mean, spread) vectors that holds at least 12 % of the windows."""
    win = F.floor(F.col("pos") / window).cast("long")
    feats = [f for c in cols for f in (f"m_{c}", f"s_{c}")]
    w = z.groupBy("grp", win.alias("win")).agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s_{c}"))])
    v = VectorAssembler(inputCols=feats, outputCol="v").transform(w)
    model = KMeans(k=k, featuresCol="v", predictionCol="cluster", seed=seed, maxIter=20).fit(v)
    d = model.transform(v)
    spread = sum((F.col(f"s_{c}") for c in cols), F.lit(0.0))
    c = d.groupBy("cluster").agg(F.avg(spread).alias("spread"), F.count(F.lit(1)).alias("n"))
    total = d.agg(F.count(F.lit(1)).alias("_t"))
    best = c.crossJoin(F.broadcast(total)).filter(F.col("n") >= min_share * F.col("_t")).orderBy("spread", "cluster").limit(1).select("cluster")
    keep = d.join(F.broadcast(best), "cluster", "left_semi").select("grp", "win").withColumn("_in", F.lit(True))
    return z.withColumn("win", win).join(keep, ["grp", "win"], "left").select("row", "grp", "pos", F.coalesce("_in", F.lit(False)).alias("in_baseline"))


def baseline_ellipsoid(z: DataFrame, cols: Sequence[str], support: float = 0.7, steps: int = 3) -> DataFrame:
    """Robust ellipsoid by concentration steps: covariance of the kept rows, distances of all rows, keep the closest 70 %."""
    from trustwatch.operators.detect import _gram

    cur, dist = z, None
    for _ in range(steps):
        _, mu, cov = _gram(cur, cols)
        inv = np.linalg.inv(cov + 1e-3 * np.eye(len(cols)))
        x = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mu)]
        dist = sum((F.lit(float(inv[i, j])) * x[i] * x[j] for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))
        cut = S.wide_quantiles(z, {"d": dist}, [support]).first().q[0]
        cur = z.filter(dist <= F.lit(cut))
    p = len(cols)
    chi2 = p * (1 - 2 / (9 * p) + 1.96 * (2 / (9 * p)) ** 0.5) ** 3  # 97.5 % point, Wilson-Hilferty
    med = S.wide_quantiles(z, {"d": dist}, [0.5]).first().q[0]
    scale = med / (p * (1 - 2 / (9 * p)) ** 3)
    return z.select("row", "grp", "pos", (dist / F.lit(max(scale, 1e-9)) <= F.lit(chi2)).alias("in_baseline"))


def score_baselines(cands: dict[str, DataFrame], z: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Candidates by separation of the distance from their own centre, coverage of groups, size and consensus."""
    names = list(cands)
    d = z
    for n, c in cands.items():
        d = d.join(c.select("grp", "row", F.col("in_baseline").alias(f"b_{n}")), ["grp", "row"])
    votes = sum((F.col(f"b_{n}").cast("int") for n in names), F.lit(0))
    d = once(d.withColumn("_major", votes * 2 >= len(names)))
    out = None
    for n in names:
        b = F.col(f"b_{n}")
        mu = d.filter(b).agg(*[F.avg(c).alias(f"mu_{c}") for c in cols])
        dist = sum(((F.col(c) - F.col(f"mu_{c}")) * (F.col(c) - F.col(f"mu_{c}")) for c in cols), F.lit(0.0))
        e = d.crossJoin(F.broadcast(mu)).withColumn("dist", dist)
        ranks = S.average_ranks(e.select("dist"), [], "dist")
        sums = e.join(ranks, "dist").agg(F.sum(F.when(~b, F.col("rank"))).alias("rs"), F.sum((~b).cast("double")).alias("np"), F.sum(b.cast("double")).alias("nn"))
        auc = (F.col("rs") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))
        g = d.groupBy("grp").agg(F.max(b.cast("int")).alias("c")).agg(F.avg("c").alias("coverage"))
        jac = d.agg((F.sum((b & F.col("_major")).cast("double")) / F.sum((b | F.col("_major")).cast("double"))).alias("consensus"))
        r = sums.crossJoin(g).crossJoin(jac).select(F.lit(n).alias("candidate"), F.coalesce(auc, F.lit(0.5)).alias("separation"), "coverage", "consensus", (F.col("nn") / (F.col("nn") + F.col("np"))).alias("share"))
        out = r if out is None else out.unionByName(r)
    size = F.least(F.lit(1.0), F.col("share") / 0.3)
    return out.withColumn("score", 0.55 * F.col("separation") + 0.15 * F.col("coverage") + 0.15 * size + 0.15 * F.col("consensus"))


def smooth_mask(mask: DataFrame, window: int, min_run: int) -> DataFrame:
    """Majority vote of the centred window, then runs shorter than ``min_run`` dropped."""
    h = window // 2
    m = ordered.with_windows(mask.select("grp", "row", "pos", "in_baseline"), ["grp"], lambda w: {"_s": F.avg(F.col("in_baseline").cast("double")).over(w.rowsBetween(-h, h)) >= 0.5}, before=h, after=h)
    runs = ordered.islands(m.filter("_s"), ["grp"], min_len=min_run).select("grp", "row_start", "row_end")
    return ordered.join_intervals(m.select("grp", "row", "pos"), runs, ["grp"]).select("grp", "row", "pos")


def baseline_reference(df: DataFrame, ranges: Sequence[tuple[int, int]] = (), groups: Sequence[str] = ()) -> DataFrame:
    """Rows a person marked as normal: row ranges (inclusive) and whole groups."""
    c = F.col("grp").isin(list(groups)) if groups else F.lit(False)
    for a, b in ranges:
        c = c | F.col("row").between(a, b)
    return df.select("row", "grp", "pos", c.alias("in_baseline"))


def estimate_baseline(wide: DataFrame, signals: Sequence[str], window: int = 20) -> tuple[DataFrame, DataFrame]:
    """(smoothed rows of the best candidate, candidate scores)."""
    z = once(zscores(wide, signals))
    cols = [f"z_{s}" for s in signals]
    cands = {"modes": baseline_modes(z, cols), "prechange": baseline_prechange(z, cols, window), "ellipsoid": baseline_ellipsoid(z, cols)}
    scores = score_baselines(cands, z, cols)
    best = scores.orderBy(F.desc("score"), "candidate").first()["candidate"]
    return smooth_mask(cands[best], window, window // 2), scores
