"""Cleaning of a corpus in stages: each works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustwatch.llm.jaccard import jaccard_components
from trustwatch.llm.outliers import robust_quality
from trustwatch.llm.packing import pack
from trustwatch.llm.secret_scan import redact
from trustwatch.llm.stage import table, without_ids, written
from trustwatch.llm.winnow import contaminated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    kept = robust_quality(docs).filter("kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the document with the smallest id stays; empty texts stay."""
    gone = jaccard_components(docs, k=5, pct=80).filter("doc_id <> component_id").select("doc_id")
    return without_ids(docs.select(*COLUMNS), written(gone, "gone"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a span of ten words with a benchmark item go."""
    hit = contaminated(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("doc_id").distinct()
    return without_ids(docs.select(*COLUMNS), written(hit, "hit"), "doc_id")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind in brackets; n_chars follows the text."""
    clean = redact(docs.select(*COLUMNS), keep=["lang", "source"])
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", packing)]

#: SQL has no form for the outlier estimate, tokens and packing; tests hold the operators against brute force, and of the stages what they keep and return.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
