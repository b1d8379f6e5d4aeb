"""Cross-lag sums: how every signal moves with every other one some rows earlier or later, pooled over all rows.

Rows are dealt by (group, position chunk) with a halo, so a hot group is spread over many tasks. Inside Arrow batches the rows of one lag are two
matrices of counts, values and squares; their product holds the six sums of a Pearson correlation for all pairs at once. A task sends one row of sums per pair,
kind and lag, whatever it has read; Spark adds them up.

Kinds: ``x`` levels without their group's linear trend, ``d`` differences of consecutive rows, ``u`` levels at the rows where a held signal takes a new value.
Null and non-finite readings take no part; a pair of rows counts where both readings are there. Groups meet nowhere: no pair spans two groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import ordered
from trustwatch.operators.quality import once

KINDS = ("x", "d", "u")
SUMS = ("n", "su", "sv", "suu", "svv", "suv")


def detrended(wide: DataFrame, signals: Sequence[str], chunk_rows: int | None = None) -> DataFrame:
    """Each signal less the line fitted to its group. Lines are small rows, sent to every chunk of their group rather than joined on a hot group."""
    c_rows = chunk_rows or ordered.CHUNK_ROWS
    p = F.col("pos").cast("double")
    lines = wide.groupBy("grp").agg(F.max("pos").alias("_last"), *[F.coalesce(F.regr_slope(s, p), F.lit(0.0)).alias(f"_b{i}") for i, s in enumerate(signals)],
                                    *[F.avg(s).alias(f"_m{i}") for i, s in enumerate(signals)], *[F.avg(F.when(F.col(s).isNotNull(), p)).alias(f"_p{i}") for i, s in enumerate(signals)])
    lines = lines.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / F.lit(c_rows)).cast("long")))).drop("_last")
    d = wide.withColumn("_part", F.floor(F.col("pos") / F.lit(c_rows)).cast("long")).join(lines, ["grp", "_part"])
    keep = [c for c in wide.columns if c not in signals]
    return d.select(*keep, *[(F.col(s) - F.col(f"_m{i}") - F.col(f"_b{i}") * (p - F.col(f"_p{i}"))).alias(s) for i, s in enumerate(signals)])


class _Sums:
    """Sums of one task: for each kind and lag the product of (there, value, square) a lag earlier with (there, value, square) now."""

    def __init__(self, width: int, kinds: Sequence[str], max_lag: int) -> None:
        self.kinds = kinds
        self.total = np.zeros((len(kinds), max_lag + 1, 3 * width, 3 * width))

    def add(self, series: np.ndarray, held: np.ndarray, own: np.ndarray, moved: np.ndarray, first: np.ndarray) -> None:
        """series: which rows belong together; own: rows to be counted; moved: raw values, whose changes tell updates; first: first row of its group."""
        for i, kind in enumerate(self.kinds):
            x = moved[1] if kind != "d" else np.vstack([np.full((1, moved[1].shape[1]), np.nan), np.diff(moved[1], axis=0)])
            step = np.vstack([np.full((1, moved[0].shape[1]), np.nan), np.diff(moved[0], axis=0)])
            starts = np.r_[True, series[1:] != series[:-1]]
            if kind == "d":
                x[starts] = np.nan
            elif kind == "u":
                fresh = np.isfinite(step) & (step != 0) & ~starts[:, None] | first[:, None]
                x = np.where(fresh | ~held, x, np.nan)
            there = np.isfinite(x)
            v = np.where(there, x, 0.0)
            z = np.hstack([there.astype(float), v, v * v])
            plain = bool(np.isfinite(z).all())  # then what is not counted can be made 0 where it stands
            for lag in range(self.total.shape[1]):
                if lag >= len(z):
                    break
                ok = own[lag:] & (series[lag:] == series[:len(series) - lag])
                self.total[i, lag] += z[:len(z) - lag].T @ (z[lag:] * ok[:, None]) if plain else z[:len(z) - lag][ok].T @ z[lag:][ok]


def lag_sums(wide: DataFrame, pairs: Sequence[tuple[str, str]], max_lag: int, held: Sequence[str] = (), kinds: Sequence[str] = KINDS, detrend: bool = True,
             mask: Column | None = None, chunk_rows: int | None = None) -> DataFrame:
    """(a, b, kind, lag, n, su, sv, suu, svv, suv) for lags -max_lag..max_lag: u is the leading reading, |lag| rows before v; with lag >= 0 a leads, else b.

    ``mask`` counts only pairs whose later row meets it. Values are taken relative to one typical value per signal, so large offsets don't cost digits. An empty table gives no rows.
    """
    sig = sorted({s for p in pairs for s in p})
    k, at = len(sig), {s: i for i, s in enumerate(sig)}
    c_rows = chunk_rows or ordered.CHUNK_ROWS
    src = wide.select("grp", F.col("pos").cast("long").alias("pos"), (F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))).alias("_in"), *[S.finite(F.col(s).cast("double")).alias(s) for s in sig],
                      *[S.finite(F.col(s).cast("double")).alias(f"_r{i}") for i, s in enumerate(sig)])
    if detrend:
        src = detrended(src, sig, c_rows)
    else:
        mid = src.agg(*[F.coalesce(F.avg(s), F.lit(0.0)).alias(s) for s in sig]).first()
        src = src.withColumns({s: F.col(s) - F.lit(mid[s]) for s in sig})
    d = ordered.chunked(src, before=max_lag + 1, chunk_rows=c_rows)
    d = d.repartition("grp", ordered.CHUNK).sortWithinPartitions("grp", ordered.CHUNK, "pos")
    raw = [f"_r{i}" for i in range(k)]
    is_held = np.array([s in set(held) for s in sig])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, carry, seen = _Sums(k, kinds, max_lag), None, False
        for b in batches:
            f = b.to_pandas()
            if not len(f):
                continue
            seen = True
            f["_new"] = f[ordered.OWN] & f["_in"]
            if carry is not None:
                f = pd.concat([carry, f], ignore_index=True)
            new = (f["grp"] != f["grp"].shift()) | (f[ordered.CHUNK] != f[ordered.CHUNK].shift())
            sums.add(new.cumsum().to_numpy(), is_held, f["_new"].to_numpy(dtype=bool), (f[raw].to_numpy(dtype=float), f[sig].to_numpy(dtype=float)), (f["pos"] == 0).to_numpy())
            carry = f.tail(max_lag + 2).copy()  # rows that the next batch looks back to; they are counted already
            carry["_new"] = False
        if not seen:
            return
        out = []
        for i, kind in enumerate(kinds):
            for a, b_ in pairs:
                for lag in range(-max_lag, max_lag + 1):
                    u, v = (at[a], at[b_]) if lag >= 0 else (at[b_], at[a])
                    g = sums.total[i, abs(lag)]
                    out.append((a, b_, kind, lag, g[u, v], g[k + u, v], g[u, k + v], g[2 * k + u, v], g[u, 2 * k + v], g[k + u, k + v]))
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), *[pa.array(c, pa.float64()) for c in cols[4:]]],
                                         ["a", "b", "kind", "lag", *SUMS])

    parts = d.select("grp", ordered.CHUNK, ordered.OWN, "pos", "_in", *sig, *raw).mapInArrow(run, "a string, b string, kind string, lag int, " + ", ".join(f"{s} double" for s in SUMS))
    return parts.groupBy("a", "b", "kind", "lag").agg(*[F.sum(s).alias(s) for s in SUMS])


def curves(sums: DataFrame, least: int = 20) -> DataFrame:
    """(a, b, kind, lag, n, r): r is null where fewer than ``least`` pairs of rows stand behind it or a side does not vary."""
    n = F.col("n")
    vu, vv = F.col("suu") - F.col("su") * F.col("su") / n, F.col("svv") - F.col("sv") * F.col("sv") / n
    r = (F.col("suv") - F.col("su") * F.col("sv") / n) / F.sqrt(vu * vv)
    ok = (n >= least) & (vu > 1e-12 * F.col("suu")) & (vv > 1e-12 * F.col("svv"))
    return sums.select("a", "b", "kind", "lag", F.col("n").cast("long").alias("n"), F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def strongest_pairs(matrix: DataFrame, top: int = 80, least: float = 0.3) -> list[tuple[str, str]]:
    """The ``top`` pairs of a correlation matrix (a, b, r) with |r| >= least: names only, at most ``top`` reach the driver."""
    best = matrix.filter(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "a", "b").limit(top)
    return [(r.a, r.b) for r in best.collect()]


def best_lags(table: DataFrame, held: Sequence[str] = (), min_diff: float = 0.1, plateau: float = 0.9) -> DataFrame:
    """One edge per pair: a leads b by ``lag`` >= 0 rows, r_at_lag, r at lag 0 of the levels, method and n.

    With a held signal the largest correlation at update instants counts, if three lags have one. Else the differences' curve counts when its peak reaches ``min_diff``,
    and the levels' otherwise; the smallest lag within the ``plateau`` of the peak wins. Ties: the smaller lag, then the one in which a leads.
    """
    size = F.abs("r")
    peaks = table.groupBy("a", "b").agg(F.max(F.when(F.col("kind") == "d", size)).alias("pd"), F.max(F.when(F.col("kind") == "x", size)).alias("px"), F.max(F.when(F.col("kind") == "u", size)).alias("pu"),
                                        F.count(F.when(F.col("kind") == "u", F.col("r"))).alias("nu"), F.max(F.when((F.col("kind") == "x") & (F.col("lag") == 0), F.col("r"))).alias("r0"))
    either = F.col("a").isin(list(held)) | F.col("b").isin(list(held)) if held else F.lit(False)
    kind = F.when(either & (F.col("nu") >= 3), "u").when(F.col("pd") >= min_diff, "d").otherwise("x")
    c = table.join(peaks.withColumn("use", kind), ["a", "b"]).filter("kind = use AND r IS NOT NULL")
    c = c.filter(size >= F.when(F.col("use") == "u", F.col("pu")).when(F.col("use") == "d", plateau * F.col("pd")).otherwise(plateau * F.col("px")))
    best = ordered.first_k(c, ["a", "b"], [F.abs("lag"), F.desc(size), F.desc("lag")], 1)
    back = F.col("lag") < 0
    return best.select(F.when(back, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("b"), F.abs("lag").alias("lag"), F.col("r").alias("r_at_lag"), F.col("r0").alias("r"),
                       F.when(F.col("use") == "u", "update_instants").when(F.col("use") == "d", "difference").otherwise("level").alias("method"), "n")


def lagged_xcorr(wide: DataFrame, pairs: Sequence[tuple[str, str]], max_lag: int = 30, held: Sequence[str] = (), min_diff: float = 0.1, chunk_rows: int | None = None) -> DataFrame:
    """Lead and lag of each pair (``best_lags``) from the sums over all rows of all groups."""
    kinds = KINDS if held else KINDS[:2]
    return best_lags(once(curves(lag_sums(wide, pairs, max_lag, held, kinds, chunk_rows=chunk_rows))), held, min_diff)  # a row per pair, kind and lag, read twice
