"""Minimum-covariance-determinant estimates against numpy on all rows, foreign rows in a group, groups of any size."""

import itertools

import numpy as np
import pandas as pd
import pytest

from trustwatch.llm import outliers as O

P = len(O.FEATURES)


def frame(spark, parts):
    """parts: (lang, source, rows x features)."""
    out = [pd.DataFrame(x, columns=O.FEATURES).assign(lang=lang, source=source) for lang, source, x in parts]
    return spark.createDataFrame(pd.concat(out, ignore_index=True))


def cloud(n, at, seed):
    rng = np.random.default_rng(seed)
    return np.asarray(at) + rng.normal(size=(n, P)) @ (np.diag(3 * O.FLOOR) + 0.3 * np.outer(O.FLOOR, O.FLOOR))


def literal(x, subset_of, support=0.5):
    """Concentration from the rows' present estimate, with exact subsets cut at a bin's edge; the log determinant it ends with."""
    def est(y, widen):
        v = np.cov(y.T, bias=True) * widen
        return y.mean(0), v + np.diag(np.maximum(O.FLOOR**2 - np.diag(v), 1e-9))

    c, v = subset_of
    last = None
    for _ in range(60):
        d = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(v), x - c)
        b = np.floor(np.log1p(d) / O.BIN)
        edge = np.sort(b)[int(np.ceil(support * len(x))) - 1]
        c2, v2 = est(x[b <= edge], O.HALF)
        det = np.linalg.slogdet(v2)[1]
        if last is not None and det >= last - 0.001:
            break
        c, v, last = c2, v2, det
    return last


SIZES = (1, 20, 199, 200, 900)
AWAY = np.full(P, 4.0) * O.FLOOR


@pytest.fixture(scope="module")
def data():
    return {"clean": cloud(360, np.zeros(P), 1), "foreign": cloud(240, np.full(P, 9.0) * O.FLOOR * 3, 2), "plain": cloud(400, np.zeros(P), 4)}


@pytest.fixture(scope="module")
def fitted(spark, data):
    """One fit: en holds foreign rows, de is plain, fr has sources of many sizes that lie apart from its large one."""
    d = frame(spark, [("en", "web", np.vstack([data["clean"], data["foreign"]])), ("de", "web", data["plain"]), ("fr", "big", cloud(2500, np.zeros(P), 5)), *[("fr", f"n{n}", cloud(n, AWAY, 6)) for n in SIZES]])
    est = O.covariance_estimates(d).cache()
    levels = O._shrunk(est, d.select("lang", "source").distinct(), 200.0)
    return {r.grp: r for r in est.collect()}, {(r.lang, r.source): r for r in levels.collect()}


def squared(r, y):
    return np.einsum("ij,jk,ik->i", y - r.centre, np.array(r.weight).reshape(P, P), y - r.centre)


def test_smallest_determinant(fitted, data):
    """The chosen determinant is that of the best literal run, from the classical and the median start and from twelve clusters of rows."""
    clean, foreign = data["clean"], data["foreign"]
    x = np.vstack([clean, foreign])
    assert {"s:en\u0001web", "l:en", "a:"} <= set(fitted[0])
    r = fitted[0]["l:en"]
    starts = [(x.mean(0), np.cov(x.T, bias=True)), (np.median(x, 0), np.diag(x.var(0)))]
    rng = np.random.default_rng(0)
    starts += [(x[i].mean(0), np.diag(x.var(0))) for i in (rng.choice(360, 40, False) for _ in range(12))]
    assert r.logdet <= min(literal(x, s) for s in starts) + 0.05
    # two rows of five are foreign: the estimate is that of the others
    assert np.abs((np.array(r.centre) - clean.mean(0)) / clean.std(0)).max() < 0.35
    assert (squared(r, foreign) > 24.32).all() and (squared(r, clean) > 24.32).mean() < 0.03


def test_final_estimate_is_that_of_the_near_rows(fitted, data):
    r = fitted[0]["l:de"]
    assert r.n == 400 and np.allclose(np.array(r.cov).reshape(P, P) @ np.array(r.weight).reshape(P, P), np.eye(P), atol=1e-6)
    assert 0.9 < squared(r, data["plain"]).mean() / P < 1.15  # consistent for normal rows


def test_small_groups_lean_on_larger_ones(fitted):
    """A group's weight grows with its rows, without a jump at any size."""
    mids = [float(np.mean(np.array(fitted[1]["fr", f"n{n}"].centre) / AWAY)) for n in SIZES]
    language = float(np.mean(np.array(fitted[0]["l:fr"].centre) / AWAY))
    assert all(b > a - 0.05 for a, b in itertools.pairwise(mids)) and mids[0] == pytest.approx(language, abs=0.05) and mids[-1] > 0.8
    assert mids[3] - mids[2] == pytest.approx(0, abs=0.05)


def test_verdict_is_the_distance(spark):
    """kept and distance of each row, recomputed from the estimates; null language, null id, repeated and empty rows have a verdict."""
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(words, 120)), "en", "web") for i in range(60)]
    rows += [(100, " ".join(f"{w}#$%&!?<>|*" for w in rng.choice(words, 120)), "en", "web"), (101, None, None, None), (5, "", "en", "web"), (None, rows[0][1], "en", "web"), rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = O.robust_quality(d).collect()
    assert len(got) == len(rows)
    m = O.measure(d).toPandas()
    lv = {(r.lang, r.source): r for r in O._shrunk(O.covariance_estimates(O.measure(d)), O.measure(d).select("lang", "source").distinct(), 200.0).collect()}
    want = []
    for r in m.to_dict("records"):
        e = lv[r["lang"], r["source"]]
        off = np.array([r[f] for f in O.FEATURES]) - e.centre
        want.append(round(float(off @ np.array(e.weight).reshape(P, P) @ off), 6))
    assert sorted(round(r.distance, 6) for r in got) == pytest.approx(sorted(want), abs=1e-4)
    assert all(r.kept == (not r.base_failed and r.distance <= 24.32) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.kept)
    assert by[100] == [False] and by[101] == [False] and by[5].count(True) == 1 and by[0] == [True, True] and by[None] == [True]
