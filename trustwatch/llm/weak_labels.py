"""Operator 8: quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. How often each pattern of votes occurs is counted over
all documents (at most 3**labellers patterns, so the table is small whatever the corpus), expectation-maximisation estimates
from it the labellers' accuracies and the share of good documents, and each pattern gets its posterior. A linear scorer over
hashed terms of word shapes is fitted to the posteriors of a bounded, hash-ordered sample of documents, and scores every whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustwatch.llm.outliers import measure
from trustwatch.llm.stage import id_text, written
from trustwatch.llm.toxicity import fit_sample, score_texts

#: Name, bad if, good if (SQL over the counts of operator 7): the labellers.
LABELLERS = [
    ("length", "n_words < 40", "n_words BETWEEN 100 AND 20000"),
    ("symbols", "n_symbols > 0.05 * n_words", "n_symbols = 0"),
    ("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"),
    ("lines", "n_dup_lines > 3", "false"),
    ("upper", "upper > 0.5", "upper BETWEEN 0.05 AND 0.3"),
    ("marks", "marks > 0.3", "marks < 0.1"),
    ("word_length", "word_length < 0.9 OR word_length > 2.5", "word_length BETWEEN 1.3 AND 2.1"),
]
BITS, MOST = 16, 12_000


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, content (a hash of the text) and a pattern of votes: +, - or 0 for each labeller."""
    rows = id_text(docs).select("doc_id", "text", F.xxhash64("text").cast("string").alias("source"))
    return measure(rows).select("doc_id", F.col("source").alias("content"), F.concat(*[F.expr(f"CASE WHEN {bad} THEN '-' WHEN {good} THEN '+' ELSE '0' END") for _, bad, good in LABELLERS]).alias("pattern"))


def posteriors(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, accuracy of each labeller per class, share of good) by expectation-maximisation."""
    v = np.array([["0-+".index(c) for c in p] for p in patterns])
    one = np.stack([v == k for k in range(3)], 2).astype(float)  # pattern, labeller, vote
    good = np.clip(((v == 2).sum(1) + 1) / ((v > 0).sum(1) + 2), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        table = np.einsum("cp,plv->clv", weight, one) + 1.0
        table /= table.sum(2, keepdims=True)
        prior = np.clip(weight.sum(1) / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
        log = np.log(prior)[:, None] + np.einsum("plv,clv->cp", one, np.log(table))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good, table, float(prior[1])


def weak_quality(docs: DataFrame, most: int = MOST, bits: int = BITS) -> DataFrame:
    """doc_id, pattern, posterior (of good, from the votes), score (of the linear scorer) and kept (score >= 0.5), one row per row.

    Null and empty texts are voted on as texts without words. Rows that share a doc_id are judged each by its own text; rows without a doc_id
    are left out. An empty table gives no rows; extra columns are ignored.
    """
    v = written(votes(docs), "votes")
    seen = sorted(v.groupBy("pattern").agg(F.count("*").alias("n")).collect())
    if not seen:
        return v.select("doc_id", "pattern", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    p, _, _ = posteriors([r.pattern for r in seen], np.array([r.n for r in seen], float))
    table = docs.sparkSession.createDataFrame([(r.pattern, float(x)) for r, x in zip(seen, p)], "pattern string, posterior double")
    judged = v.join(F.broadcast(table), "pattern")
    few = lambda c: judged.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
    ids = written(few("posterior >= 0.5").unionByName(few("posterior < 0.5")).select("doc_id", F.col("posterior").alias("target")).distinct(), "sample-ids")
    m = fit_sample(id_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "target"), most, bits, 0, True)
    # rows equal in doc_id and text have one score
    scores = score_texts(id_text(docs).withColumn("content", F.xxhash64("text").cast("string")), m, bits, True, "content").groupBy("doc_id", "content").agg(F.max("score").alias("score"))
    return judged.join(scores, ["doc_id", "content"]).select("doc_id", "pattern", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
