"""Operator 1: toxicity by a factorization machine over hashed terms.

The machine is fitted in one task on a bounded, hash-ordered sample of labelled rows (``most`` rows, half of them of either
label where there are enough) and scores every whole text in Arrow batches. Its pairwise factors see terms together, such as an
insult and a group's name. Inputs are the text alone.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustwatch.llm.linear import Machine, fit, hashed_terms
from trustwatch.llm.stage import id_text, written

BITS, FACTORS, MOST = 18, 4, 12_000


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def fit_sample(rows: DataFrame, most: int, bits: int, factors: int, shapes: bool, seed: int = 7, **how) -> Machine | None:
    """The machine fitted to ``most`` rows at most of ``rows`` (doc_id, text, target), the first by a hash of doc_id; None without rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "target", "text"], kind="stable")
        terms, ptr = hashed_terms(pa.array(frame["text"], pa.large_string()), bits, shapes)
        m = fit(terms, ptr, frame["target"].to_numpy(float), bits, factors, seed=seed, **how)
        used = np.flatnonzero(m.w)
        return pd.DataFrame({"model": [pickle.dumps((m.bias, used.astype(np.int32), m.w[used], m.v[used].astype(np.float32)))]})

    near = lambda c, n: rows.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id", "target").limit(n)
    sample = written(near("target >= 0.5", most // 2).unionByName(near("target < 0.5", most // 2)), "sample")
    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").collect()
    if not got:
        return None
    bias, used, w, v = pickle.loads(bytes(got[0].model))
    m = Machine(bias, np.zeros(1 << bits, np.float32), np.zeros((1 << bits, v.shape[1]), np.float32))
    m.w[used], m.v[used] = w, v
    return m


def score_texts(docs: DataFrame, m: Machine | None, bits: int, shapes: bool, *more: str) -> DataFrame:
    """doc_id, the columns named and score of each row (0.5 where there is no model)."""
    model = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        for b in batches:
            if model.value is None:
                s = np.full(b.num_rows, 0.5)
            else:
                s = model.value.score(*hashed_terms(b.column("text"), bits, shapes)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in more], pa.array(s)], ["doc_id", *more, "score"])

    rows = id_text(docs, *more)
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text") + ", score double")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST, bits: int = BITS, factors: int = FACTORS, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``; rows of fold 0 teach nothing.

    Null and empty texts get the score of a text without terms; without labelled rows every score is 0.5; null labels are
    ignored, repeated labels count once per label; empty tables give no rows; extra columns are ignored.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("target")).distinct()
    picked = known.filter(fold(folds) != 0)
    # the ids of the sample are chosen before any text moves
    few = lambda c: picked.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
    ids = written(few("target >= 0.5").unionByName(few("target < 0.5")), "sample-ids")
    m = fit_sample(id_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "target"), most, bits, factors, False)
    return score_texts(docs, m, bits, False).select("doc_id", (fold(folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
