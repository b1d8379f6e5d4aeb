"""Checks against brute force, and how much of the table they let travel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import quality as Q

SIGNALS = ["x", "y"]


def made(spark, sizes=(3, 70, 260), seed=4):
    rng = np.random.default_rng(seed)
    rows, row = [], 0
    for g, n in enumerate(sizes):
        for i in range(n):
            x = float(rng.normal()) if i % 11 else None
            rows.append((f"g{g}", row, i, n, "A" if row < 150 else "B", x, float(rng.normal() + 5)))
            row += 1
    at = sizes[0] + sizes[1] + 100
    rows[at] = (*rows[at][:6], 5000.0)
    return rows, spark.createDataFrame(rows, "grp string, row long, pos long, group_rows long, batch_id string, x double, y double")


def residuals(rows, column, median):
    """Residual to the median of 7 rows, mean of the other 50, neighbours; row by row."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        f = [median if r[column] is None else r[column] for r in mine]
        a = [abs(f[i] - float(np.median(f[max(0, i - 3):i + 4]))) for i in range(len(f))]
        for i, r in enumerate(mine):
            near = a[max(0, i - 25):i + 26]
            out[r[1]] = (a[i], (sum(near) - a[i]) / max(1, len(near) - 1), a[i - 1] if i else 0.0, a[i + 1] if i + 1 < len(a) else 0.0)
    return out


@pytest.mark.parametrize("chunk, buffer", [(1 << 18, 1 << 17), (40, 64)])
def test_local_residuals(spark, monkeypatch, chunk, buffer):
    """Readings that may stand out have the figures of brute force; calm ones don't leave their task."""
    monkeypatch.setattr(Q.ordered, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(Q, "BUFFER_ROWS", buffer)
    rows, d = made(spark)
    ctx = Q.build_context(d, SIGNALS)
    med = {r.signal: r.median for r in ctx.stats.collect()}
    got, means = Q.local_residuals(ctx, SIGNALS)
    want = {(s, k): v for i, s in enumerate(SIGNALS) for k, v in residuals(rows, 5 + i, med[s]).items()}
    batch = {r[1]: r[4] for r in rows}
    mean = {(r.batch_id, r.signal): (r.glob, r["_n"]) for r in means.collect()}
    for s in SIGNALS:
        for b in "AB":
            a = [v[0] for (t, k), v in want.items() if t == s and batch[k] == b]
            assert mean[b, s] == (pytest.approx(np.mean(a)), len(a))
    found = {(r.signal, r.row): (r.a, r.near, r.left, r.right) for r in got.collect()}
    assert ("y", 173) in found and len(found) < 20
    for k, v in found.items():
        assert v == pytest.approx(want[k])
    scale = {r.signal: r.scale for r in ctx.stats.collect()}
    there = {(s, r[1]) for i, s in enumerate(SIGNALS) for r in rows if r[5 + i] is not None}
    assert {k for k, v in want.items() if k in there and v[0] > 10 * max(1.2533 * v[1], 0.15 * scale[k[0]] / 10, 1e-12)} == set(found)


def test_only_rows_that_share_a_hash_travel_whole(spark):
    rows = [("a", i, i, "A", float(i % 50) if i < 100 else float(i), None if i % 2 else 0.0 * (-1) ** (i // 2)) for i in range(200)]
    d = spark.createDataFrame(rows, "grp string, row long, pos long, batch_id string, x double, y double")
    ctx = Q.Context(d, SIGNALS, None, None)
    got = Q.duplicate_flags(ctx)
    first, again = set(), []
    for r in rows:
        key = (r[4], None if r[5] is None else 0.0)
        if key in first:
            again.append(r[1])
        first.add(key)
    assert sorted(r.row for r in got.collect()) == again == list(range(50, 100))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan or "RDD" in plan  # contents are grouped on what is kept of the table, not on the table


def test_steps_are_counted_once(spark):
    """Steps of time: the median of counted values, and findings from kept rows."""
    sec = [0, 60, 120, 180, 180, 240, 200, 900, 960, 1020]
    rows = [("a", i, i, "A", s, 1.0, 1.0) for i, s in enumerate(sec)]
    d = spark.createDataFrame(rows, "grp string, row long, pos long, batch_id string, t long, x double, y double").withColumn("t", F.timestamp_seconds("t"))
    ctx = Q.build_context(d, SIGNALS, time="t")
    assert ctx.period.first().period == 60.0 and ctx.steps.agg(F.sum("n")).first()[0] == 9
    got = Q.check_time(ctx)
    at = lambda k: [(r.row_start, r.row_end, r.n) for r in got[k].collect()]
    assert at("out_of_order") == [(6, 6, 1)] and at("duplicate_timestamp") == [(4, 4, 1)] and at("gap") == [(6, 7, 1)]


def test_quantiles_of_counts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v, c = np.unique(np.round(rng.normal(size=3000), 2), return_counts=True)
    d = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, c)] + [(None, 4)], "v double, n long")
    ps = [0.0, 0.25, 0.5, 0.995]
    want = list(np.quantile(np.repeat(v, c), ps))
    assert S.counted_quantiles(d, "v", "n", ps) == pytest.approx(want)
    monkeypatch.setattr(S, "SLICE", 100)
    assert S.counted_quantiles(d, "v", "n", ps) == pytest.approx(want)
    assert S.counted_quantiles(d.filter("n < 0"), "v", "n", [0.5]) == [None]


def test_null_rows_are_found_once(spark):
    rows = [("a", i, i, "A", None if i in (3, 4) else float(i), None if i in (4, 9) else 1.0) for i in range(30)]
    d = spark.createDataFrame(rows, "grp string, row long, pos long, batch_id string, x double, y double")
    ctx = Q.build_context(d, SIGNALS)
    got = Q.null_rows(ctx)
    assert sorted((r.row, r["_nulls"]) for r in got.collect()) == [(3, 1), (4, 2), (9, 1)]
    assert [(r.row_start, r.n) for r in Q.check_empty_rows(Q.replace(ctx, nulls=got)).collect()] == [(4, 1)]


def test_shuffle_files_of_finished_steps_go(spark, monkeypatch):
    """Steps that are kept leave no shuffle files behind once later ones begin."""
    import glob
    import os
    import time

    from trustwatch import session

    monkeypatch.setattr(session, "EVERY", 0.0)
    local = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS", "/tmp")
    held = lambda: {*glob.glob(f"{local}/blockmgr-*/*/shuffle_*")}
    before = held()
    kept = Q.once(spark.range(200_000).repartition(7, "id"))
    mine = held() - before
    assert mine
    for _ in range(20):
        Q.once(spark.range(3))
        if not mine & held():
            break
        time.sleep(0.5)
    assert not mine & held() and kept.count() == 200_000
