"""Audit trail, evidence, run summaries and text search."""

from __future__ import annotations

from collections.abc import Sequence

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.operators import ordered

GENESIS = "0" * 64


def _body(fields: Sequence[str], prev: Column) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields], prev)


def append_chain(entries: DataFrame, log_id: str, seq: str, fields: Sequence[str], segment_rows: int = 10_000) -> DataFrame:
    """Hash chain per log. A chain is sequential, so a long log is cut into segments of bounded length, each started
    from a value derived from the log and the segment number. ``seal_segments`` gives the segment heads, ``seal_root`` chains those
    level by level, and ``verify_segments`` finds removed, added and replaced segments."""
    seg = F.floor(F.col(seq) / segment_rows).cast("long")
    d = entries.withColumn("_seg", seg).withColumn("_text", F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("_q")
        start = GENESIS if p["_seg"].iloc[0] == 0 else hashlib.sha256(f"{p['_l'].iloc[0]}:{p['_seg'].iloc[0]}".encode()).hexdigest()
        prev, prevs, hashes = start, [], []
        for text in p["_text"]:
            h = hashlib.sha256(f"{text}\x1f{prev}".encode()).hexdigest()
            prevs.append(prev)
            hashes.append(h)
            prev = h
        return pd.DataFrame({"_l": p["_l"], "_q": p["_q"], "prev_hash": prevs, "hash": hashes})

    h = (d.select(F.col(log_id).cast("string").alias("_l"), F.col(seq).cast("long").alias("_q"), "_seg", "_text").groupBy("_l", "_seg")
         .applyInPandas(chain, "_l string, _q long, prev_hash string, hash string"))
    return entries.join(h, (F.col(log_id).cast("string") == h["_l"]) & (F.col(seq).cast("long") == h["_q"])).drop("_l", "_q")


def seal_segments(chain: DataFrame, log_id: str, seq: str, segment_rows: int = 10_000) -> DataFrame:
    """Last hash of each segment: one row per segment, which ``seal_root`` chains."""
    return chain.groupBy(log_id, F.floor(F.col(seq) / segment_rows).cast("long").alias("segment")).agg(F.max_by("hash", seq).alias("head"), F.count(F.lit(1)).alias("n"))


def seal_root(heads: DataFrame, log_id: str, segment_rows: int = 10_000) -> DataFrame:
    """One value per log that depends on every segment head: heads are chained in segments, those heads again, until one is left."""
    level = heads.select(log_id, F.col("segment").alias("seq"), "head", "n")
    while True:
        level = seal_segments(append_chain(level, log_id, "seq", ["seq", "head", "n"], segment_rows), log_id, "seq", segment_rows)
        level = level.select(log_id, F.col("segment").alias("seq"), "head", "n").checkpoint()
        if level.filter("seq > 0").isEmpty():
            return level.select(log_id, F.col("head").alias("root"))


def verify_segments(log: DataFrame, sealed: DataFrame, log_id: str, seq: str, segment_rows: int = 10_000) -> DataFrame:
    """Segments of the log that are not as they were sealed: missing, added or changed."""
    now = seal_segments(log, log_id, seq, segment_rows).select(log_id, "segment", F.col("head").alias("_head"), F.col("n").alias("_n"))
    problem = F.when(F.col("_head").isNull(), "missing").when(F.col("head").isNull(), "added").when((F.col("head") != F.col("_head")) | (F.col("n") != F.col("_n")), "changed")
    return sealed.select(log_id, "segment", "head", "n").join(now, [log_id, "segment"], "full").select(log_id, "segment", problem.alias("problem")).filter("problem is not null")


def verify_chain(log: DataFrame, log_id: str, seq: str, fields: Sequence[str], segment_rows: int = 10_000) -> DataFrame:
    """First entry of each log whose link or content does not match; every entry is checked independently."""
    d = ordered.with_windows(log, [log_id], lambda w: {"_p": F.lag("hash").over(w)}, before=1, pos=seq)
    first = F.pmod(F.col(seq), F.lit(segment_rows)) == 0
    seg = F.floor(F.col(seq) / segment_rows).cast("long")
    start = F.when(seg == 0, F.lit(GENESIS)).otherwise(F.sha2(F.concat_ws(":", F.col(log_id).cast("string"), seg.cast("string")), 256))
    linked = F.when(first, F.col("prev_hash") == start).otherwise(F.coalesce(F.col("prev_hash") == F.col("_p"), F.lit(False)))
    content = F.sha2(_body(fields, F.col("prev_hash")), 256) == F.col("hash")
    return d.filter(~(linked & content)).groupBy(log_id).agg(F.min(seq).alias("first_bad_seq"), F.count(F.lit(1)).alias("n_bad"))


def completeness(objects: DataFrame, log: DataFrame, key: str, kind: str) -> DataFrame:
    """Objects without a log entry, per type."""
    miss = objects.join(log.select(key).distinct(), key, "left_anti").groupBy(kind).agg(F.count(F.lit(1)).alias("n_missing"))
    return objects.groupBy(kind).agg(F.count(F.lit(1)).alias("n_objects")).join(miss, kind, "left").na.fill(0, ["n_missing"])


def resolve_evidence(objects: DataFrame, evidence: DataFrame, ids: str, key: str) -> DataFrame:
    """One row per cited piece of evidence of an object."""
    return objects.withColumn(key, F.explode(ids)).drop(ids).join(evidence, key)


def run_totals(flags: DataFrame, kind: str = "kind", cause: str = "cause") -> DataFrame:
    """Flags by kind and cause with subtotals."""
    d = flags.rollup(kind, cause).agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("max_severity"))
    return d.select(F.coalesce(kind, F.lit("all")).alias("kind"), F.coalesce(cause, F.lit("all")).alias("cause"), "n", "max_severity")


def top_groups(summary: DataFrame, k: int = 10) -> DataFrame:
    return summary.filter("max_score >= 1").orderBy(F.desc("max_score"), "grp").limit(k)


def varied_sample(diag: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Round robin over the buckets, the most severe of each first."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("severity"), "row_start"))
    d = diag.withColumn("_r", r).filter(F.col("_r") <= n)
    return d.orderBy("_r", F.desc("severity"), "row_start").limit(n).withColumn("round", F.col("_r").cast("int")).drop("_r")


def drift_trends(events: DataFrame, rows: DataFrame, value: str, k: int = 8, points: int = 400) -> DataFrame:
    """Kendall's tau and the median slope of the k strongest events, on at most 400 evenly spaced rows each."""
    top = events.orderBy(F.desc("severity"), "grp", "row_start").limit(k)
    j = ordered.join_intervals(rows.select("grp", "row", F.col(value).cast("double").alias("v")), top.select("grp", "row_start", "row_end"), ["grp"]).filter("v is not null")
    step = F.greatest(F.lit(1), F.ceil((F.col("row_end") - F.col("row_start") + 1) / points))
    p = j.filter(F.pmod(F.col("row") - F.col("row_start"), step) == 0)
    a, b = p.alias("a"), p.alias("b")
    pair = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.row_start") == F.col("b.row_start")) & (F.col("a.row") < F.col("b.row")))
    dv = F.col("b.v") - F.col("a.v")
    return pair.groupBy(F.col("a.grp").alias("grp"), F.col("a.row_start").alias("row_start")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.signum(dv)).alias("tau"), F.percentile(dv / (F.col("b.row") - F.col("a.row")), F.lit(0.5)).alias("slope"))


def score_timeline(scores: DataFrame, points: int) -> DataFrame:
    """Largest score in each of ``points`` stretches of a group."""
    n = scores.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    b = F.floor(F.col("pos") * points / F.greatest(F.col("_n"), F.lit(points))).cast("long")
    return scores.join(n, "grp").groupBy("grp", b.alias("bucket")).agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"), F.max("score").alias("max_score"))


def flagged_spans(timeline: DataFrame, segs: DataFrame) -> DataFrame:
    """Timeline stretches touched by a segment."""
    s = segs.select("grp", F.col("row_start").alias("b_start"), F.col("row_end").alias("b_end"))
    return ordered.overlap_intervals(timeline, s, ["grp"]).groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n_segments"))


def terms(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf) of one- and two-word terms of the whole text."""
    w = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " "), lambda x: F.length(x) > 0)
    d = df.select(id_col, w.alias("w"))
    two = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    return d.select(id_col, F.explode(F.concat("w", two)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def search(df: DataFrame, id_col: str, text: str, query: str, k: int = 10) -> DataFrame:
    """Ranked search: sublinear tf, smoothed idf, cosine. Only query terms take part in the product."""
    spark = df.sparkSession
    t = terms(df, id_col, text)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    idf = t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = t.join(idf, "term").withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))
    q = terms(spark.createDataFrame([(0, query)], "q long, text string"), "q", "text").join(idf, "term").select("term", ((1.0 + F.log("tf")) * F.col("idf")).alias("qw"))
    qn = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("_qn"))
    dot = w.join(F.broadcast(q), "term", "left").groupBy(id_col).agg(F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).filter("dot > 0")
    return dot.crossJoin(F.broadcast(qn)).select(id_col, (F.col("dot") / F.col("norm") / F.col("_qn")).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
