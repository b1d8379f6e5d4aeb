"""Numbering moves the rows once: they come out in the order of ``row``, offsets and ranks need no join of the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trustwatch.operators import ordered
from trustwatch.plans import views as V


def _table(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"grp": np.r_[np.repeat("hot", 500), rng.choice(["a", "b", "zz"], 120)], "t": rng.permutation(620), "v": rng.normal(size=620)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_rows_are_numbered_in_one_shuffle(spark):
    pdf, d = _table(spark)
    n = ordered.number_rows(d, "grp", ["t"], [F.floor(F.col("t") / 50)], prefix=1)
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1
    parts = n.select("row", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).orderBy("at").toPandas()
    assert parts["row"].tolist() == list(range(len(pdf)))  # partitions and the rows in them ascend
    got = n.toPandas().sort_values("row").reset_index(drop=True)
    exp = pdf.sort_values(["grp", "t"]).reset_index(drop=True)
    assert (got[["grp", "t"]].to_numpy() == exp[["grp", "t"]].to_numpy()).all() and np.allclose(got["v"], exp["v"])
    by = exp.groupby("grp")["t"]
    assert (got["pos"] == by.cumcount()).all() and (got["group_rows"] == by.transform("size")).all()
    assert (got["group_start"] == got.groupby("grp")["row"].transform("min")).all()


def test_positions_of_two_keys_and_empty(spark):
    pdf, d = _table(spark)
    d = d.withColumn("k", F.pmod("t", F.lit(2)))
    got = ordered.positions(d, ["grp", "k"], ["t"], [F.floor(F.col("t") / 50)], out="p", total="n").toPandas().sort_values(["grp", "k", "t"])
    by = got.groupby(["grp", "k"])["t"]
    assert (got["p"] == by.cumcount()).all() and (got["n"] == by.transform("size")).all() and len(got) == len(pdf)
    assert ordered.number_rows(d.filter("false"), "grp", ["t"], [F.floor(F.col("t") / 50)]).count() == 0


def test_defects_are_planted_without_writing_or_moving_rows(spark, sf):
    d = V.dirty_wide(spark, sf)
    assert not any("dirty_wide" in f for f in d.inputFiles())
    plan = d.filter("row BETWEEN 10 AND 20").select("row", "s01")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThanOrEqual(row,10)" in plan
    n = V.sensor_wide(spark, sf).count()
    extra = d.filter(F.col("row") >= n).join(d.filter(F.col("row").between(n * 9 // 10, n * 9 // 10 + 4)).select("ts_reg", "s02", "s05"), ["ts_reg", "s02", "s05"], "left_semi")
    assert d.count() == n + 5 and extra.count() == 5 and d.filter(F.col("row") >= n).filter("batch_id = 'B0010' AND pos >= group_rows").count() == 5
