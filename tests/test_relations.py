"""Relations that events are followed along: every pair of signals, with the lag it has."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustwatch.operators import events as K
from trustwatch.plans import q_events as QE


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Two suppliers: s05 is s01 + 1000, s04 follows s03 by two rows, s02 is noise."""
    rng = np.random.default_rng(6)
    rows = []
    for g in (1, 2):
        x = rng.normal(size=402)
        for i in range(400):
            rows.append((g, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), g * 1000 + i, 1, i, float(rng.normal()), float(rng.normal()), float(x[i + 2]), float(x[i] + 0.1 * math.sin(i))))
    d = str(tmp_path_factory.mktemp("relations"))
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_every_pair_has_its_lag(spark, table):
    e = {(r.a, r.b): (r.lag, round(abs(r.r), 1)) for r in QE.rel(spark, table).filter(F.abs("r") >= 0.3).collect()}
    assert e == {("s01", "s05"): (0, 1.0), ("s03", "s04"): (2, 1.0)}


def test_a_cascade_along_a_lag(spark, table):
    """A step from s03 to s04 is backed only by their relation two rows apart."""
    ranked = spark.createDataFrame([("1", 10, "s03", 0), ("1", 10, "s04", 3)], "grp string, row_start long, signal string, lag long")
    steps = K.propagation(ranked, QE.rel(spark, table))
    assert [tuple(r) for r in steps.collect()] == [("1", 10, "s03", "s04", 3)]
    clusters = spark.createDataFrame([("s03", "s03"), ("s04", "s04")], "id string, component string")
    assert K.cascades(ranked, clusters, steps).count() == 1
