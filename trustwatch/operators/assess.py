"""Evaluation against labels, quality scores, coverage and the value of more or less data."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import detect, quality, trust
from trustwatch.operators.quality import once

WEIGHT = {"fail": 1.0, "warn": 0.4}


# ------------------------------------------------------------------ evaluation
def auroc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve from average ranks of the distinct scores."""
    c = df.withColumn("_y", positive.cast("long"))
    r = S.average_ranks(c.select(score), [], score)
    by = c.groupBy(score).agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_c")).join(r, score)
    a = by.agg(F.sum(F.col("rank") * F.col("_p")).alias("rs"), F.sum("_p").cast("double").alias("np"), F.sum(F.col("_c") - F.col("_p")).cast("double").alias("nn"))
    return a.select(F.col("np").cast("long").alias("n_positive"), F.col("nn").cast("long").alias("n_negative"), ((F.col("rs") - F.col("np") * (F.col("np") + 1) / 2) / F.nullif(F.col("np") * F.col("nn"), F.lit(0.0))).alias("auroc"))


def normal_label(df: DataFrame, label: str, score: str, min_n: int = 100) -> DataFrame:
    """The label value with the lowest mean score among those with enough rows."""
    a = df.groupBy(label).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    return a.orderBy("mean_score", label).limit(1)


def detection_metrics(df: DataFrame, flag: Column, truth: Column) -> DataFrame:
    """Row precision and recall, detected groups, false alarms, median delay to the first flag."""
    d = df.select("grp", "pos", flag.alias("f"), truth.alias("t"))
    g = d.groupBy("grp").agg(F.sum((F.col("f") & F.col("t")).cast("long")).alias("tp"), F.sum((F.col("f") & ~F.col("t")).cast("long")).alias("fp"), F.sum((~F.col("f") & F.col("t")).cast("long")).alias("fn"),
                             F.min(F.when(F.col("t"), F.col("pos"))).alias("t0"), F.max(F.col("t").cast("int")).alias("faulty"), F.max(F.col("f").cast("int")).alias("any_flag"))
    after = d.join(g.select("grp", "t0"), "grp").filter(F.col("f") & (F.col("pos") >= F.col("t0"))).groupBy("grp").agg(F.min(F.col("pos") - F.col("t0")).alias("delay"))
    a = g.join(after, "grp", "left")
    return a.agg((F.sum("tp") / F.nullif(F.sum(F.col("tp") + F.col("fp")), F.lit(0))).alias("precision"), (F.sum("tp") / F.nullif(F.sum(F.col("tp") + F.col("fn")), F.lit(0))).alias("recall"),
                 F.sum("faulty").cast("long").alias("n_faulty"), F.count("delay").alias("n_detected"), F.sum(F.when((F.col("faulty") == 0) & (F.col("any_flag") == 1), 1).otherwise(0)).cast("long").alias("n_false_alarms"),
                 F.percentile("delay", F.lit(0.5)).alias("median_delay"))


def calibration(df: DataFrame, conf: str, correct: Column) -> DataFrame:
    """Share of correct findings per confidence bin (0, 0.5, 0.7, 0.85, 1)."""
    c = F.col(conf)
    b = F.when(c < 0.5, "0.00-0.50").when(c < 0.7, "0.50-0.70").when(c < 0.85, "0.70-0.85").otherwise("0.85-1.00")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_confidence"), F.avg(correct.cast("double")).alias("share_correct"))


EMI_CHUNK = 1 << 20
"""Terms of the expected information that one row of work sums."""


def expected_information(rows: DataFrame, cols: DataFrame, n: int) -> DataFrame:
    """One row, emi: expected mutual information of two labelings with these totals (rows: x, mult; cols: y, mult; distinct totals and how often each occurs).

    Every pair of distinct totals sums k / n ln(n k / (x y)) over the hypergeometric chances of all k, in stretches of EMI_CHUNK terms that Spark deals out.
    """
    work = rows.select("x", F.col("mult").alias("mx")).join(cols.select("y", F.col("mult").alias("my")))
    lo, hi = F.greatest(F.lit(1).cast("long"), F.col("x") + F.col("y") - n), F.least("x", "y")
    work = work.withColumn("lo", lo).withColumn("hi", hi).filter("lo <= hi").withColumn("at", F.explode(F.sequence("lo", "hi", F.lit(EMI_CHUNK).cast("long")))).repartition("x", "y", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from math import lgamma

        for pdf in batches:
            total = 0.0
            for r in pdf.itertuples():
                x, y, k0 = int(r.x), int(r.y), int(r.at)
                first = lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k0 + 1) - lgamma(x - k0 + 1) - lgamma(y - k0 + 1) - lgamma(n - x - y + k0 + 1)
                k = np.arange(k0, min(int(r.hi), k0 + EMI_CHUNK - 1) + 1, dtype=float)
                step = np.log(x - k[:-1]) + np.log(y - k[:-1]) - np.log(k[1:]) - np.log(n - x - y + k[1:])  # from one k to the next
                p = np.exp(first + np.r_[0.0, np.cumsum(step)])
                total += float(r.mx) * float(r.my) * float((k / n * np.log(n * k / (float(x) * y)) * p).sum())
            yield pd.DataFrame({"emi": [total]})

    return work.mapInPandas(run, "emi double").agg(F.coalesce(F.sum("emi"), F.lit(0.0)).alias("emi"))


def pattern_agreement(df: DataFrame, pattern: str, label: str) -> DataFrame:
    """Purity and adjusted mutual information of two labelings (null is a label of its own), as aggregates over the contingency table: no task holds it."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    t = once(df.groupBy(name(pattern).alias("a"), name(label).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    n = t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([], "purity double, ami double, n long")
    ra, cb = t.groupBy("a").agg(F.sum("n").alias("x"), F.max("n").alias("most")), t.groupBy("b").agg(F.sum("n").alias("y"))
    entropy = lambda c: -F.sum(F.col(c) / n * F.log(F.col(c) / n))
    mi = t.join(ra, "a").join(cb, "b").agg(F.sum(F.col("n") / n * F.log(F.col("n") * float(n) / (F.col("x").cast("double") * F.col("y")))).alias("mi"))
    emi = expected_information(ra.groupBy("x").agg(F.count(F.lit(1)).alias("mult")), cb.groupBy("y").agg(F.count(F.lit(1)).alias("mult")), int(n))
    one = mi.crossJoin(emi).crossJoin(ra.agg(entropy("x").alias("hx"), (F.sum("most") / n).alias("purity"))).crossJoin(cb.agg(entropy("y").alias("hy")))  # four tables of one row
    return one.select("purity", ((F.col("mi") - F.col("emi")) / F.greatest((F.col("hx") + F.col("hy")) / 2 - F.col("emi"), F.lit(1e-12))).alias("ami"), F.lit(n).cast("long").alias("n"))


def purity(df: DataFrame, pattern: str, label: str) -> DataFrame:
    t = df.groupBy(pattern, label).agg(F.count(F.lit(1)).alias("n")).groupBy(pattern).agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return t.agg((F.sum("m") / F.sum("s")).alias("purity"))


# ------------------------------------------------------------------ quality scores
def dq_scores(checks: DataFrame, verdicts: DataFrame, n_signals: int, exclude_signals: Sequence[str] = (), exclude_batches: Sequence[str] = (), exclude_types: Sequence[str] = (), critical: float = 0.3) -> DataFrame:
    """Score per category and overall (0.7 of the mean plus 0.3 of the mean trust); a category that could not be tested is NULL."""
    c = checks.filter(F.col("category").isin(list(quality.CATEGORIES)))
    keep = F.col("status").isin("warn", "fail")
    if exclude_batches:
        keep = keep & ~F.col("batch_id").isin(list(exclude_batches))
    if exclude_types:
        keep = keep & ~F.col("check_type").isin(list(exclude_types))
    if exclude_signals:
        keep = keep & ~((F.size("signals") > 0) & F.forall("signals", lambda s: s.isin(list(exclude_signals))))
    v = verdicts.filter(~F.col("batch_id").isin(list(exclude_batches) or [""])).agg(F.count(F.lit(1)).cast("double").alias("nb"), F.avg("trust_score").alias("mean_trust"))
    n_sig = max(1, n_signals - len(exclude_signals))
    w = F.col("severity") * F.when(F.col("status") == "fail", WEIGHT["fail"]).otherwise(WEIGHT["warn"])
    pen = c.groupBy("category").agg(F.sum(F.when(keep & (F.size("signals") > 0), w).otherwise(0.0)).alias("s1"), F.sum(F.when(keep & (F.size("signals") == 0), w).otherwise(0.0)).alias("s0"),
                                    F.min((F.col("status") == "not_testable").cast("int")).alias("untestable"))
    cats = v.select("nb", "mean_trust", F.explode(F.array(*[F.lit(x) for x in quality.CATEGORIES])).alias("category")).join(pen, "category", "left").na.fill(0.0, ["s1", "s0"]).na.fill(0, ["untestable"])
    p = F.col("s1") / (F.col("nb") * n_sig) + 0.5 * F.col("s0") / F.col("nb")
    d = cats.select("category", "mean_trust", F.when(F.col("untestable") == 1, None).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), p / critical)), 4)).alias("score"))
    total = d.agg((0.7 * F.coalesce(F.avg("score"), F.lit(1.0)) + 0.3 * F.max("mean_trust")).alias("score")).select(F.lit("overall").alias("category"), "score")
    return d.select("category", "score").unionByName(total)


def worst_signals(checks: DataFrame, verdicts: DataFrame, k: int = 8) -> DataFrame:
    t = verdicts.select(F.explode("untrusted_signals").alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("untrusted_batches"))
    w = F.col("severity") * F.when(F.col("status") == "fail", WEIGHT["fail"]).otherwise(WEIGHT["warn"])
    c = checks.filter("status in ('warn', 'fail') and category <> 'rule'").select(w.alias("w"), F.explode("signals").alias("signal")).groupBy("signal").agg(F.sum("w").alias("severity_sum"), F.count(F.lit(1)).alias("n_checks"))
    d = c.join(t, "signal", "full").na.fill(0, ["untrusted_batches", "n_checks"]).na.fill(0.0, ["severity_sum"])
    return d.orderBy(F.desc("untrusted_batches"), F.desc("severity_sum"), "signal").limit(k)


def evaluate_action(action: Mapping, checks: DataFrame, sizes: DataFrame, n_signals: int) -> DataFrame:
    """What the scores would be without some signals, batches or finding types."""
    sig = list(action.get("signals", ())) if action["type"] == "drop_signal" else []
    types = ["duplicate_rows", "duplicate_key"] if action["type"] == "drop_duplicates" else []
    bat = list(action.get("batches", ())) if action["type"] == "drop_range" else []
    c = checks
    if sig:
        c = c.withColumn("_all", F.size("signals")).withColumn("signals", F.array_except("signals", F.array(*[F.lit(s) for s in sig]))).filter((F.col("_all") == 0) | (F.size("signals") > 0)).drop("_all")
    if types:
        c = c.filter(~F.col("check_type").isin(types))
    if bat:
        c = c.filter(~F.col("batch_id").isin(bat))
        sizes = sizes.filter(~F.col("batch_id").isin(bat))
    v = trust.trust_verdicts(c, sizes, n_signals - len(sig))
    return dq_scores(c, v, n_signals - len(sig))


# ------------------------------------------------------------------ coverage
def unit_fingerprints(long: DataFrame, unit: Sequence[str]) -> DataFrame:
    return long.groupBy(*unit, "signal").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def unit_vectors(wide: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Robustly standardised (mean, spread) vector of each group."""
    a = wide.groupBy("grp").agg(*[e for s in signals for e in (F.avg(s).alias(f"m_{s}"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias(f"d_{s}"))])
    cols = [c for c in a.columns if c != "grp"]
    t = detect.scales_of(a, cols)
    z = [F.least(F.lit(10.0), F.greatest(F.lit(-10.0), (F.coalesce(F.col(c), F.lit(t[c]["med"])) - F.lit(t[c]["med"])) / F.lit(max(t[c]["scale"], 1e-9)))) for c in cols]
    return a.select("grp", F.array(*z).alias("vector"))


def regimes(vectors: DataFrame, max_k: int = 6, min_silhouette: float = 0.15, seed: int = 2) -> DataFrame:
    """Operating regimes of units: k-means, k by silhouette; a single regime when no split separates well."""
    v = vectors.withColumn("v", array_to_vector("vector"))
    best = None
    for k in range(2, max_k + 1):
        d = KMeans(k=k, featuresCol="v", predictionCol="regime", seed=seed, maxIter=20).fit(v).transform(v)
        if d.select("regime").distinct().count() < 2:
            continue
        s = ClusteringEvaluator(featuresCol="v", predictionCol="regime").evaluate(d)
        if best is None or s > best[0]:
            best = (s, d)
    d = best[1].drop("v") if best and best[0] >= min_silhouette else vectors.withColumn("regime", F.lit(0))
    return d


def regime_balance(reg: DataFrame) -> DataFrame:
    """Entropy of the regime sizes (1 = evenly covered)."""
    c = reg.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    p = F.col("n") / F.col("t")
    return c.crossJoin(F.broadcast(tot)).agg(F.max("k").alias("n_regimes"), F.when(F.max("k") > 1, -F.sum(p * F.log(p)) / F.log(F.max("k"))).otherwise(1.0).alias("balance"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, t: s + t))


def project_units(vectors: DataFrame, centers: DataFrame, key: str, vec: str = "vector", id_col: str = "grp", q: float = 0.95) -> DataFrame:
    """Nearest centroid of each unit; novel when farther than the 95th percentile. Centroids are a handful of rows."""
    d = vectors.select(id_col, vec).crossJoin(F.broadcast(centers.select(key, "centroid"))).groupBy(id_col).agg(F.min(F.struct(distance(F.col(vec), F.col("centroid")).alias("d"), F.col(key).alias("k"))).alias("b"))
    d = d.select(id_col, F.col("b.k").alias(key), F.col("b.d").alias("distance"))
    lim = S.wide_quantiles(d, {"distance": F.col("distance")}, [q]).select(F.get("q", F.lit(0)).alias("_l"))
    return d.crossJoin(F.broadcast(lim)).withColumn("novel", F.col("distance") > F.col("_l")).drop("_l")


def label_balance(df: DataFrame, col: str) -> DataFrame:
    return regime_balance(df.select(F.col(col).alias("regime"))).select(F.col("n_regimes").alias("n_values"), "balance")


def low_information(stats: DataFrame, pairs: DataFrame, min_r: float = 0.98) -> DataFrame:
    """Near-constant and redundant signals."""
    near = stats.filter((F.col("std") <= 1e-9 * F.greatest(F.lit(1.0), F.abs("mean"))) | (F.col("q01") == F.col("q99"))).select("signal", F.lit("near_constant").alias("why"))
    return near.unionByName(pairs.filter(F.abs("r") >= min_r).select(F.col("b").alias("signal"), F.concat(F.lit("redundant with "), "a").alias("why")))


# ------------------------------------------------------------------ learning curve
def _spe(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Squared residual of the test rows on the principal subspace of the training rows."""
    n, mu, cov = detect._gram(train, cols)
    w, v = np.linalg.eigh(cov + 1e-6 * np.eye(len(cols)))
    k = max(1, int(np.searchsorted(np.cumsum(w[::-1]) / w.sum(), 0.9)) + 1)
    p = v[:, ::-1][:, : min(k, len(cols) - 1)]
    r = np.eye(len(cols)) - p @ p.T
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mu)]
    res = [sum((F.lit(float(r[i, j])) * x[j] for j in range(len(cols))), F.lit(0.0)) for i in range(len(cols))]
    return test.select("grp", "row", sum((e * e for e in res), F.lit(0.0)).alias("spe"))


def learning_curve(z: DataFrame, cols: Sequence[str], fractions: Sequence[float] = (0.1, 0.2, 0.4, 0.7, 1.0), holdback: float = 0.2, seed: int = 0) -> DataFrame:
    """How stable the reconstruction error on held-back groups is as more groups are used for fitting."""
    u = F.pmod(F.xxhash64("grp", F.lit(seed)), F.lit(10_000)) / 10_000.0
    d = z.withColumn("_u", u)
    test, pool = d.filter(F.col("_u") < holdback), d.filter(F.col("_u") >= holdback)
    ref = _spe(pool, test, cols).withColumnRenamed("spe", "ref")
    out = None
    for f in fractions:
        part = pool.filter(F.col("_u") < holdback + (1 - holdback) * f)
        s = _spe(part, test, cols).join(ref, ["grp", "row"])
        r = s.agg(F.corr(F.log1p("spe"), F.log1p("ref")).alias("agreement"), F.avg("spe").alias("mean_error"), F.count(F.lit(1)).alias("n")).withColumn("fraction", F.lit(float(f)))
        out = r if out is None else out.unionByName(r)
    w = Window.orderBy("fraction")
    return out.withColumn("gain", F.lag("mean_error").over(w) - F.col("mean_error"))


def compare_without(z: DataFrame, cols: Sequence[str], drop: Sequence[str]) -> DataFrame:
    a = learning_curve(z, cols, (1.0,)).withColumn("variant", F.lit("with"))
    return a.unionByName(learning_curve(z, [c for c in cols if c not in drop], (1.0,)).withColumn("variant", F.lit("without")))


def assess_new_table(new: DataFrame, old_vectors: DataFrame, centers: DataFrame, signals: Sequence[str], vectors: DataFrame) -> DataFrame:
    """Mapped share of the signals, missing share, and how many of its units are novel."""
    mapped = [s for s in signals if s in new.columns]
    miss = new.agg(*[F.avg(F.col(s).isNull().cast("double")).alias(s) for s in mapped]).select((sum((F.col(s) for s in mapped), F.lit(0.0)) / max(1, len(mapped))).alias("missing_share"))
    lim = S.wide_quantiles(project_units(old_vectors, centers, "regime"), {"distance": F.col("distance")}, [0.95]).select(F.get("q", F.lit(0)).alias("_l"))
    p = project_units(vectors, centers, "regime").crossJoin(F.broadcast(lim)).agg(F.count(F.lit(1)).alias("n_units"), F.avg((F.col("distance") > F.col("_l")).cast("double")).alias("novelty"))
    return p.crossJoin(miss).withColumn("mapped_share", F.lit(len(mapped) / len(signals))).withColumn("compatible", F.col("mapped_share") >= 0.8)


def candidate_actions(checks: DataFrame, verdicts: DataFrame, low: DataFrame) -> DataFrame:
    """Actions the evidence hints at."""
    dup = checks.filter("check_type = 'duplicate_rows' and status in ('warn', 'fail')").limit(1).select(F.lit("drop_duplicates").alias("action"), F.lit("").alias("target"))
    bad = trust.signal_trust(verdicts).filter("fraction >= 0.3").orderBy(F.desc("fraction"), "signal").limit(3).select(F.lit("drop_signal").alias("action"), F.col("signal").alias("target"))
    near = low.filter("why = 'near_constant'").limit(2).select(F.lit("drop_signal").alias("action"), F.col("signal").alias("target"))
    more = verdicts.limit(1).select(F.lit("add_more_like").alias("action"), F.lit("group").alias("target"))
    return dup.unionByName(bad).unionByName(near).unionByName(more).distinct()


def combined_score(fitness: float, coverage: DataFrame, dq: DataFrame) -> DataFrame:
    """0.4 fitness, 0.3 coverage, 0.3 data quality."""
    q = dq.filter("category = 'overall'").select(F.col("score").alias("dq"))
    return coverage.select("balance").crossJoin(q).select((0.4 * F.lit(fitness) + 0.3 * F.col("balance") + 0.3 * F.col("dq")).alias("combined"))


def fit_score_subset(wide: DataFrame, signals: Sequence[str], train: Sequence[str]) -> DataFrame:
    """Fit on some groups, summarise the scores of the others."""
    m = detect.fit_model(wide.filter(F.col("grp").isin(list(train))), signals, ("robust_z",), trim=False)
    s = detect.score_rows(wide.filter(~F.col("grp").isin(list(train))), m)
    return s.groupBy("grp").agg(F.avg((F.col("score") >= 1).cast("double")).alias("flagged_share"), F.max("score").alias("max_score"))


