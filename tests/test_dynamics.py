"""How signals move, against figures worked out stretch by stretch."""

import math

import numpy as np
import pytest

from trustwatch.operators import profile as P

SIGNALS = ["x", "y"]


def rows_of(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate((5, 40, 130, 64)):
        for i in range(n):
            x = None if i % 13 == 4 else float(np.round(rng.normal(), 1)) if g != 3 else 7.25
            rows.append((f"g{g}", i, x, 100.0 + float(rng.integers(3)) * (i // 7 % 2)))
    return rows


def stretch(pos, x, prev, prev5):
    """MEASURES of one stretch; prev: the readings a row and five rows earlier, or None."""
    n, mu, sd = len(x), np.mean(x), np.std(x)
    out = dict.fromkeys(P.MEASURES)
    for k, p, name in ((1, prev, "autocorr_lag1"), (5, prev5, "autocorr_lag5")):
        both = [(a, b) for a, b in zip(x, p) if b is not None]
        if sd > 0 and len(both) > 5:
            out[name] = sum((a - mu) * (b - mu) for a, b in both) / len(both) / sd ** 2
    dx = [a - b for a, b in zip(x, prev) if b is not None]
    moves = np.abs([d for d in dx if d])
    out["noise_level"] = np.std(dx) / sd if sd > 0 and dx else None
    out["stuck_fraction"] = np.mean([d == 0 for d in dx]) if dx else None
    out["trend_strength"] = abs(np.corrcoef(x, pos)[0, 1]) if sd > 0 else None
    if len(moves):
        out["quantization_step"], out["jump_ratio"], out["large_jump_share"] = np.quantile(moves, 0.01), np.median(moves) / sd if sd > 0 else None, np.mean(moves > 0.5 * sd)
    starts = [i for i in range(n) if prev[i] is None or prev[i] != x[i]]
    lev = [x[i] for i in starts]
    moved = [(x[i], prev[i]) for i in starts if prev[i] is not None]
    if len(moved) >= 10 and np.std(lev) > 0:
        out["level_autocorr"] = sum((a - np.mean(lev)) * (b - np.mean(lev)) for a, b in moved) / len(moved) / np.var(lev)
    if starts:
        at = [pos[i] for i in starts]
        length = np.diff([*at, at[0] + n])
        out["hold_period"] = np.median(length)
        out["hold_regularity"] = max(0.0, 1 - min(1.0, 1.4826 * np.median(np.abs(length - np.median(length))) / np.median(length)))
    return out


@pytest.mark.parametrize("chunk", [100_000, 50])
def test_dynamics(spark, monkeypatch, chunk):
    """Group g3 never changes: it has no spread, no trend and no moves, but counts as a stretch."""
    monkeypatch.setattr(P, "BUFFER_ROWS", 60)
    rows = rows_of()
    d = spark.createDataFrame(rows, "grp string, pos long, x double, y double").repartition(5)
    got = {r.signal: r for r in P.dynamics(d, SIGNALS, chunk_rows=chunk).collect()}
    for k, s in enumerate(SIGNALS):
        units = []
        for g in sorted({r[0] for r in rows}):
            mine = [r[2 + k] for r in rows if r[0] == g]
            for lo in range(0, len(mine), chunk):
                at = [i for i in range(lo, min(lo + chunk, len(mine))) if mine[i] is not None]
                if len(at) >= 10:
                    units.append(stretch([float(i) for i in at], [mine[i] for i in at], *[[mine[i - b] if i >= b else None for i in at] for b in (1, 5)]))
        assert got[s].n_units == len(units)
        for m in P.MEASURES:
            values = [u[m] for u in units if u[m] is not None and not math.isnan(u[m])]
            assert got[s][m] == (pytest.approx(np.median(values), rel=1e-9, abs=1e-9) if values else None), (s, m)


def test_lag_table_is_read_once(spark):
    """The sums over all rows are made once, though the best lag looks at them twice."""
    from trustwatch.operators import lags as L

    rng = np.random.default_rng(2)
    x = rng.normal(size=203)
    d = spark.createDataFrame([("a", i, float(x[i + 3]), float(x[i])) for i in range(200)], "grp string, pos long, x double, y double")
    got = L.lagged_xcorr(d, [("x", "y")], 5)
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.a, r.b, r.lag) for r in got.collect()] == [("x", "y", 3)]
