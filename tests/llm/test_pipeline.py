"""The corpus pipeline, and the driver contract with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__ as entry
import corpus_pipeline
from trustwatch.llm.queries import QUERIES
from trustwatch.llm.stage import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "test")
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == corpus_pipeline.COLUMNS and now <= ids, name
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == ids and len(ids) > 100
    assert docs.filter("text RLIKE 'AKIA[A-Z0-9]{12}'").count() == 0 and docs.filter("n_chars <> char_length(text)").count() == 0


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and len(QUERIES) == 13


def test_rest_stands_alone():
    code = "import sys\nfor m in ('corpus_pipeline', 'trustwatch.llm'):\n    sys.modules[m] = None\nimport __spark_entry__ as e\nassert not any(k.startswith('op') for k in e.queries()), 'left'\n"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
