"""From row scores to events: sustained rises, segments, points, onsets, attribution, cascades, patterns.

``scores``: grp, row, pos, score (1.0 = the alarm level) and share_<signal> columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import ordered


def window_median(scores: DataFrame, w: int) -> DataFrame:
    """Median score of the w rows centred on each row (frame cut at group ends)."""
    h = w // 2
    return ordered.with_windows(scores, ["grp"], lambda x: {"med": S.median_of(
        [F.lag("score", i).over(x) for i in range(h, 0, -1)] + [F.col("score")] + [F.lead("score", i).over(x) for i in range(1, h + 1)])}, before=h, after=h)


def sustained(scores: DataFrame, w: int, thr: float) -> DataFrame:
    return window_median(scores, w).withColumn("sustained", F.col("med") >= thr).drop("med")


def sustained_threshold(scores: DataFrame, w: int) -> DataFrame:
    """Robust threshold of the window median on baseline rows, clamped to 0.5..1.0."""
    t = S.robust_threshold([], window_median(scores, w), "med")
    return t.select("n", F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.col("threshold"))).alias("threshold"))


def bridged(d: DataFrame, flag: Column, gap: int) -> DataFrame:
    """Flagged rows plus the rows of gaps of at most ``gap`` rows between them; works row by row inside chunks."""
    hit = F.when(flag, F.col("pos"))
    x = ordered.with_windows(d, ["grp"], lambda w: {"_p": F.max(hit).over(w.rowsBetween(-gap - 1, 0)), "_n": F.min(hit).over(w.rowsBetween(0, gap + 1))}, before=gap + 1, after=gap + 1)
    return x.filter((F.col("_p") == F.col("pos")) | (F.col("_n") - F.col("_p") - 1 <= gap)).withColumn("_hot", F.col("_p") == F.col("pos")).drop("_p", "_n")


def segments(scores: DataFrame, min_len: int = 5, gap: int = 10, w: int = 21, sustain: float | None = None, window: int = 20) -> DataFrame:
    """Stretches at or above 1.0, joined over short gaps. Short ones must be clearly above; with ``sustain`` a run needs a
    lasting rise, and a lasting moderate rise that never reaches 1.0 is a segment of its own."""
    d = sustained(scores, w, sustain) if sustain is not None else scores.withColumn("sustained", F.lit(True))
    s = F.col("score")
    b = bridged(d.select("grp", "row", "pos", "score", "sustained"), s >= 1.0, gap)
    hot = F.col("_hot")
    isl = ordered.islands(b, ["grp"], aggs={"n_hot": ("sum", hot.cast("long")), "hot_sum": ("sum", F.when(hot, s).otherwise(0.0)), "peak": ("max", s), "_sus": ("max", F.col("sustained").cast("int"))})
    keep = isl.filter((F.col("n") >= min_len) & ((F.col("n") >= 2 * window) | (F.col("hot_sum") / F.col("n_hot") >= 1.25) | (F.col("peak") >= 2.0)) & (F.col("_sus") == 1))
    out = keep.select("grp", "pos_start", "pos_end", "row_start", "row_end", "n", "n_hot", (F.col("hot_sum") / F.col("n_hot")).alias("mean_score"), "peak")
    if sustain is None:
        return out
    rise = ordered.islands(d.filter("sustained"), ["grp"], min_len=max(min_len, 2 * window), aggs={"n_hot": ("sum", (s >= 1.0).cast("long")), "s": ("sum", s), "peak": ("max", s)})
    a = rise.select("grp", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end"))
    hit = ordered.overlap_intervals(out.select("grp", "row_start", "row_end"), a, ["grp"]).select("grp", F.col("b_start").alias("row_start")).distinct()
    extra = rise.join(hit, ["grp", "row_start"], "left_anti").select("grp", "pos_start", "pos_end", "row_start", "row_end", "n", "n_hot", (F.col("s") / F.col("n")).alias("mean_score"), "peak")
    return out.unionByName(extra)


def lead_signal(signals: Sequence[str]) -> Column:
    a = F.sort_array(F.array(*[F.struct(F.col(f"share_{s}").alias("v"), F.lit(s).alias("s")) for s in signals]), asc=False)
    return F.element_at(a, 1)["s"]


def group_summary(scores: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Largest and mean score, flagged share, first crossing and leading signal of each group."""
    d = scores.withColumn("lead", lead_signal(signals))
    hot = F.col("score") >= 1.0
    a = d.groupBy("grp").agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.avg(hot.cast("double")).alias("flagged_share"), F.min(F.when(hot, F.col("row"))).alias("first_row"))
    m = d.filter(hot).groupBy("grp", "lead").agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(F.min_by("lead", F.struct((-F.col("c")).alias("c"), "lead")).alias("leading_signal"))
    return a.join(m, "grp", "left")


def summary_events(segs: DataFrame, scores: DataFrame, signals: Sequence[str], k: int | None = 2) -> DataFrame:
    """The two strongest segments of each group (all for k = None) with the mean share of their leading signal."""
    top = segs if k is None else ordered.first_k(segs, ["grp"], [F.desc(F.col("mean_score") * F.log1p(F.col("n"))), "row_start"], k)
    j = ordered.join_intervals(scores.select("grp", "row", F.col("score").alias("row_score"), *[f"share_{s}" for s in signals]), top, ["grp"]).filter("row_score >= 1")
    a = j.groupBy("grp", "row_start", "row_end", "n", "mean_score", "peak").agg(*[F.avg(f"share_{s}").alias(f"share_{s}") for s in signals])
    return a.withColumn("leading_signal", lead_signal(signals))


def point_events(scores: DataFrame, z: str, max_len: int = 2, peak: float = 1.5, z_min: float = 4.0) -> DataFrame:
    """Excursions of at most two readings with a high peak and a large |z|."""
    d = scores.filter("score >= 1")
    i = ordered.islands(d, ["grp"], aggs={"peak": ("max", F.col("score")), "max_z": ("max", F.abs(z))})
    return i.filter((F.col("n") <= max_len) & (F.col("peak") >= peak) & (F.col("max_z") >= z_min))


def repair_points(wide: DataFrame, points: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Rows of point events replaced by the median of the three rows on each side."""
    hit = ordered.join_intervals(wide.select("grp", "row"), points.select("grp", "row_start", "row_end"), ["grp"]).select("grp", "row").withColumn("_hit", F.lit(1))
    d = wide.join(hit, ["grp", "row"], "left")
    near = lambda w, s: S.median_of([F.lag(s, i).over(w) for i in (3, 2, 1)] + [F.lead(s, i).over(w) for i in (1, 2, 3)])
    d = ordered.with_windows(d, ["grp"], lambda w: {f"_r_{s}": near(w, s) for s in signals}, before=3, after=3)
    return d.withColumns({s: F.when(F.col("_hit") == 1, F.col(f"_r_{s}")).otherwise(F.col(s)) for s in signals}).drop("_hit", *[f"_r_{s}" for s in signals])


def drop_echoes(segs: DataFrame, rescored: DataFrame, **kw) -> DataFrame:
    """Segments that vanish once spike rows are repaired were echoes of those spikes."""
    again = segments(rescored, **kw).select("grp", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end"))
    keep = ordered.overlap_intervals(segs, again, ["grp"]).select("grp", "row_start").distinct()
    return segs.join(keep, ["grp", "row_start"], "left_semi")


def severity(mean: Column, n: Column, window: int) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.2 + 0.5 * F.tanh((mean - 1.0) / 3.0) + 0.3 * F.least(F.lit(1.0), n / F.lit(5.0 * window))))


def build_flags(events: DataFrame, points: DataFrame, onset: DataFrame, window: int = 20, per_group: int | None = None) -> DataFrame:
    """Anomaly, drift, changepoint and point flags: all of them, or for a report the ``per_group`` most severe of each group."""
    e = events.join(onset.select("grp", F.col("row").alias("onset_row"), "kind"), "grp", "left")
    inside = F.col("onset_row").between(F.col("row_start") - window, F.col("row_end"))
    kind = F.when(inside & (F.col("kind") == "gradual"), "drift").when(inside, "changepoint").otherwise("anomaly")
    a = e.select(kind.alias("kind"), "grp", "row_start", "row_end", "n", "mean_score", "peak", severity(F.col("mean_score"), F.col("n"), window).alias("severity"), "leading_signal", F.when(inside, F.col("onset_row")).alias("onset"))
    p = points.select(F.lit("point").alias("kind"), "grp", "row_start", "row_end", "n", F.col("peak").alias("mean_score"), "peak", severity(F.col("peak"), F.col("n"), window).alias("severity"), F.lit(None).cast("string").alias("leading_signal"), F.lit(None).cast("long").alias("onset"))
    f = a.unionByName(p)
    if per_group is not None:
        f = ordered.first_k(f, ["grp"], [F.desc("severity"), "row_start", "kind"], per_group)
    return f.withColumn("flag_id", F.concat_ws("-", F.lit("F"), "grp", "row_start", "kind"))


# ------------------------------------------------------------------ onsets
def signal_onsets(z: DataFrame, signals: Sequence[str], thr: float = 2.5, run: int = 3) -> DataFrame:
    """First three consecutive rows beyond the threshold, per group and signal, with the direction of the next ten rows."""
    def cols(w):
        return {f"_{s}": (F.sum((F.abs(f"z_{s}") > thr).cast("int")).over(w.rowsBetween(0, run - 1)) == run) & (F.count(F.lit(1)).over(w.rowsBetween(0, run - 1)) == run) for s in signals} | {
            f"u_{s}": F.avg((F.col(f"z_{s}") > thr).cast("double")).over(w.rowsBetween(0, 9)) - F.avg((F.col(f"z_{s}") < -thr).cast("double")).over(w.rowsBetween(0, 9)) for s in signals}

    d = ordered.with_windows(z, ["grp"], cols, after=max(run - 1, 9))
    hit = F.array_compact(F.array(*[F.when(F.col(f"_{s}"), F.struct(F.lit(s).alias("signal"), F.col(f"u_{s}").alias("u"))) for s in signals]))
    e = d.select("grp", "row", "pos", F.explode(hit).alias("h")).select("grp", "row", "pos", "h.*")
    first = e.groupBy("grp", "signal").agg(F.min_by(F.struct("row", "pos", "u"), "pos").alias("f"))
    return first.select("grp", "signal", F.col("f.row").alias("row"), F.col("f.pos").alias("pos"), F.when(F.col("f.u") >= 0, "up").otherwise("down").alias("direction"))


def change_order(z: DataFrame, first: DataFrame, signals: Sequence[str], window: int = 20) -> DataFrame:
    """First order (level jump) or second order (slope change) around each signal onset."""
    long = z.unpivot(["grp", "pos"], [f"z_{s}" for s in signals], "signal", "z").withColumn("signal", F.regexp_replace("signal", "^z_", ""))
    d = long.join(first.select("grp", "signal", F.col("pos").alias("o")), ["grp", "signal"]).filter((F.col("pos") >= F.col("o") - 2 * window) & (F.col("pos") < F.col("o") + 3 * window))
    pre, post = F.col("pos") < F.col("o"), F.col("pos") >= F.col("o")
    x = F.col("pos").cast("double")
    a = d.groupBy("grp", "signal").agg(
        F.count(F.when(pre, 1)).alias("n0"), F.count(F.when(post, 1)).alias("n1"), F.regr_slope(F.when(pre, F.col("z")), F.when(pre, x)).alias("b0"), F.regr_slope(F.when(post, F.col("z")), F.when(post, x)).alias("b1"),
        F.avg(F.when(pre & (F.col("pos") >= F.col("o") - window), F.col("z"))).alias("m0"), F.avg(F.when(post & (F.col("pos") < F.col("o") + window), F.col("z"))).alias("m1"))
    slope, jump = F.abs(F.col("b1") - F.col("b0")) * F.col("n1"), F.abs(F.col("m1") - F.col("m0"))
    return a.filter("n0 >= 4 and n1 >= 4").select("grp", "signal", F.when((slope >= 1.0) & (slope > 1.5 * jump), "second").otherwise("first").alias("change_order"))


# ------------------------------------------------------------------ attribution
def attribute(segs: DataFrame, scores: DataFrame, first: DataFrame, signals: Sequence[str], k: int = 5) -> DataFrame:
    """The five signals with the largest mean share of each event's hot rows, with their lag behind the first mover."""
    j = ordered.join_intervals(scores.select("grp", "row", F.col("score").alias("row_score"), *[f"share_{s}" for s in signals]), segs.select("grp", "row_start", "row_end"), ["grp"]).filter("row_score >= 1")
    m = j.groupBy("grp", "row_start", "row_end").agg(*[F.avg(f"share_{s}").alias(s) for s in signals])
    long = m.unpivot(["grp", "row_start", "row_end"], list(signals), "signal", "share")
    top = ordered.first_k(long, ["grp", "row_start"], [F.desc("share"), "signal"], k)
    d = top.join(first.select("grp", "signal", F.col("row").alias("onset")), ["grp", "signal"], "left")
    w = Window.partitionBy("grp", "row_start")
    return d.withColumns({"lag": F.col("onset") - F.min("onset").over(w), "rank": F.row_number().over(w.orderBy(F.desc("share"), "signal"))})


def classify_cause(ranked: DataFrame, checks: DataFrame, actuators: Sequence[str] = ()) -> DataFrame:
    """data, sensor, process, mixed or unknown, from overlap with data-quality findings and the spread of the shares."""
    ev = ranked.groupBy("grp", "row_start", "row_end").agg(F.max_by("signal", F.struct("share", "signal")).alias("top_signal"), F.max("share").alias("top_share"), F.count(F.when(F.col("share") >= 0.1, 1)).alias("n_signals"))
    c = checks.filter("status in ('warn', 'fail') and row_start is not null").select("check_type", "signals", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end"))
    hit = ordered.overlap_intervals(ev.select("grp", "row_start", "row_end", "top_signal"), c, [])
    record = F.col("check_type").isin("duplicate_rows", "frozen_block", "missing_block", "empty_rows", "unit_shift")
    own = F.array_contains("signals", F.col("top_signal"))
    h = hit.groupBy("grp", "row_start").agg(F.max(record.cast("int")).alias("rec"), F.max((own & ~record).cast("int")).alias("own"))
    d = ev.join(h, ["grp", "row_start"], "left")
    cause = (F.when(F.col("rec") == 1, "data").when((F.col("own") == 1) & (F.col("top_share") >= 0.5), "sensor").when(F.col("own") == 1, "mixed")
             .when(F.col("n_signals") >= 2, "process").when(F.col("top_signal").isin(list(actuators) or [""]), "process").when(F.col("top_share") >= 0.6, "sensor").otherwise("unknown"))
    return d.withColumn("cause", cause).drop("rec", "own")


def propagation(ranked: DataFrame, edges: DataFrame, tolerance: int = 5) -> DataFrame:
    """Steps from each signal to its nearest earlier related signal, unless that contradicts the learned lag."""
    e = edges.filter(F.abs("r") >= 0.3).select(F.col("a").alias("source"), F.col("b").alias("signal"), F.col("lag").alias("learned"))
    e = e.unionByName(e.filter("learned = 0").select(F.col("signal").alias("source"), F.col("source").alias("signal"), "learned"))
    later = ranked.filter("lag is not null").select("grp", "row_start", "signal", "lag")
    early = later.select("grp", "row_start", F.col("signal").alias("source"), F.col("lag").alias("slag"))
    d = later.join(e, "signal").join(early, ["grp", "row_start", "source"]).filter(F.col("slag") < F.col("lag"))
    d = d.filter((F.col("learned") == 0) | (F.abs(F.col("lag") - F.col("slag") - F.col("learned")) <= F.greatest(F.lit(tolerance), F.col("learned"))))
    return ordered.first_k(d, ["grp", "row_start", "signal"], [F.desc("slag"), "source"], 1).select("grp", "row_start", "source", "signal", (F.col("lag") - F.col("slag")).alias("delay"))


def cascades(ranked: DataFrame, clusters: DataFrame, steps: DataFrame, min_gap: int = 2) -> DataFrame:
    """Events reaching a second cluster of signals at least two rows later, with a backed step between clusters."""
    c = clusters.select(F.col("id").alias("signal"), F.col("component").alias("cluster"))
    a = ranked.filter("lag is not null").join(c, "signal").groupBy("grp", "row_start", "cluster").agg(F.min("lag").alias("arrival"))
    w = Window.partitionBy("grp", "row_start").orderBy("arrival", "cluster")
    a = a.withColumns({"next": F.lead("cluster").over(w), "gap": F.lead("arrival").over(w) - F.col("arrival")}).filter(F.col("gap") >= min_gap)
    s = steps.join(c, "signal").withColumnRenamed("cluster", "c2").join(c.select(F.col("signal").alias("source"), F.col("cluster").alias("c1")), "source").filter("c1 <> c2").select("grp", "row_start").distinct()
    return a.join(s, ["grp", "row_start"], "left_semi")


def event_vectors(ranked: DataFrame, signals: Sequence[str]) -> DataFrame:
    return ranked.groupBy("grp", "row_start").agg(*[F.coalesce(F.max(F.when(F.col("signal") == s, F.col("share"))), F.lit(0.0)).alias(s) for s in signals]).select("grp", "row_start", F.array(*signals).alias("vector"))


def patterns(vectors: DataFrame, max_k: int = 8, min_events: int = 3, cohesion: float = 0.6, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Recurring event signatures: k-means on cosine distance, k by silhouette. Returns (members, centroids)."""
    v = vectors.withColumn("v", array_to_vector("vector"))
    n = v.count()
    best = None
    for k in range(2, min(max_k, max(2, n // min_events)) + 1):
        d = KMeans(k=k, featuresCol="v", predictionCol="pattern", distanceMeasure="cosine", seed=seed, maxIter=15).fit(v).transform(v)
        if d.select("pattern").distinct().count() < 2:
            continue
        sil = ClusteringEvaluator(featuresCol="v", predictionCol="pattern", distanceMeasure="cosine").evaluate(d)
        if best is None or sil > best[0]:
            best = (sil, d)
    d = (best[1] if best else v.withColumn("pattern", F.lit(0))).drop("v")
    c = centroids(d, "pattern", "vector")
    m = d.join(c, "pattern").withColumn("similarity", cosine(F.col("vector"), F.col("centroid")))
    ok = m.groupBy("pattern").agg(F.avg("similarity").alias("cohesion"), F.count(F.lit(1)).alias("n")).filter((F.col("cohesion") >= cohesion) & (F.col("n") >= min_events))
    return m.join(ok.select("pattern"), "pattern", "left_semi"), c.join(ok, "pattern")


def centroids(d: DataFrame, key: str, vec: str) -> DataFrame:
    e = d.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def assign_pattern(vectors: DataFrame, id_cols: Sequence[str], vec: str, centers: DataFrame, key: str, min_similarity: float = 0.6) -> DataFrame:
    """Nearest centroid by cosine (at most a handful of centroids), none below 0.6."""
    sim = cosine(F.col(vec), F.col("centroid"))
    d = vectors.crossJoin(F.broadcast(centers.select(key, "centroid"))).groupBy(*id_cols).agg(F.max(F.struct(sim.alias("s"), F.col(key).alias("k"))).alias("b"))
    return d.select(*id_cols, F.when(F.col("b.s") >= min_similarity, F.col("b.k")).alias(key), F.col("b.s").alias("similarity"))


def pattern_reliability(members: DataFrame, folds: int = 3, seed: int = 5) -> DataFrame:
    """Balanced accuracy of a random forest that predicts the pattern of events it has not seen."""
    from pyspark.ml.classification import RandomForestClassifier

    d = members.select(F.col("pattern").cast("double").alias("label"), array_to_vector("vector").alias("features"), F.pmod(F.xxhash64("grp", "row_start"), F.lit(folds)).alias("fold"))
    out = None
    for f in range(folds):
        m = RandomForestClassifier(numTrees=20, maxDepth=4, seed=seed).fit(d.filter(F.col("fold") != f))
        p = m.transform(d.filter(F.col("fold") == f)).select("label", "prediction")
        out = p if out is None else out.unionByName(p)
    recall = out.groupBy("label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"), F.count(F.lit(1)).alias("n_patterns"))


def suspicious_rows(points: DataFrame, checks: DataFrame, max_len: int = 10) -> DataFrame:
    """Point events and short check runs on one line: adjacent ranges merged, most sources first."""
    a = points.select("row_start", "row_end", F.lit("point").alias("source"), F.col("peak").cast("double").alias("strength"))
    b = checks.filter("status in ('warn', 'fail')").select("check_type", "severity", F.explode("events").alias("e")).select(
        "e.row_start", "e.row_end", F.col("check_type").alias("source"), F.col("severity").alias("strength")).filter(F.col("row_end") - F.col("row_start") < max_len)
    u = a.unionByName(b)
    rows = u.select(F.explode(F.sequence("row_start", "row_end")).alias("row"), "source", "strength")
    per = rows.groupBy("row").agg(F.collect_set("source").alias("src"), F.max("strength").alias("strength"))
    isl = ordered.islands(per.withColumn("pos", F.col("row")).select("row", "pos", "strength", F.size("src").alias("k")), [], aggs={"strength": ("max", F.col("strength")), "n_sources": ("max", F.col("k"))})
    return isl.select("row_start", "row_end", "n", "n_sources", "strength")
