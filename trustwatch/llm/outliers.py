"""Operator 7: quality rules by robust multivariate outliers.

One pass over the whole texts gives word and repetition counts and a vector of transformed statistics. Centre and covariance of every
(lang, source), every language and the whole table are minimum-covariance-determinant estimates over all rows:

* Four deterministic starts for each: mean and covariance of all rows; medians with quartile spreads; medians with correlations of tanh scores;
  medians with correlations of spatial signs.
* Concentration steps: the ``support`` nearest rows (by Mahalanobis distance) give the next estimate, until no determinant falls any more. The start
  with the smallest determinant wins. Rows within the 0.975 quantile of it give the final, reweighted estimate.
* A step is one grouped aggregation: counts and moment sums by distance bin (``BIN`` of the logarithm), so the support is cut at a bin's edge, and a group that
  holds a third of all rows is summed where its rows are. Estimates are joined to rows by (lang, source) and a salt.
* Shrinkage instead of a least size: a group's estimate counts n / (n + ``shrink``) and that of its language, itself shrunk to the whole table's, the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.llm import text as T
from trustwatch.llm.stage import written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "upper", "marks", "repeats", "dup_lines"]
#: Smallest standard deviation of each feature: below it a difference is of no account.
FLOOR = np.array([1.0, 0.15, 0.12, 0.2, 0.2, 0.35, 0.35])
SYMBOLS, UPPER = T._lut("#*$%&|<>"), T._lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
MARKS = T._lut("!?;:\"'()[]{}=+/\\~^_@`") | SYMBOLS
BIN, SALTS = 0.02, 16
#: Correction of the covariance of the nearest half, and of the rows within the 0.975 quantile, for seven normal variables; that quantile.
HALF, NEAR, CUT = 1.69, 1.045, 16.01
_U = np.uint64


def _row_key(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return T.mix(hashes + rows.astype(np.uint64) * _U(0xA24BAED4963EE407))


def _counts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and FEATURES of each text."""
    n = len(offs) - 1
    w = T.hash_words(buf, offs, T.SPACE, T.SAME)
    rows, per = w.rows(), np.diff(w.ptr)
    chars = T.row_counts(~T.SPACE[buf] & ((buf & 0xC0) != 0x80), offs)
    symbols, upper, marks = (T.row_counts(lut[buf], offs) for lut in (SYMBOLS, UPPER, MARKS))
    lines = T.hash_words(buf, offs, T.NEWLINE, T.SAME)
    has_word = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    line_rows = lines.rows()[has_word]
    keys = _row_key(lines.hash[has_word], line_rows)
    _, first = np.unique(keys, return_index=True)
    n_lines = np.bincount(line_rows, minlength=n)
    dup = n_lines - np.bincount(line_rows[first], minlength=n)
    tri = T.shingles(w.hash, 3)
    own = rows[:len(tri)] == rows[2:2 + len(tri)]
    at = np.flatnonzero(own)
    _, inverse, times = np.unique(_row_key(tri[at], rows[at]), return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    covered = np.zeros(len(rows), bool)
    for i in range(3):
        covered[again + i] = True
    repeats = np.bincount(rows[covered], minlength=n)
    some, visible = np.maximum(per, 1), np.maximum(chars, 1)
    feats = np.stack([np.log1p(per), np.log(np.maximum(chars, 1) / some), np.sqrt(symbols / visible), np.sqrt(upper / visible), np.sqrt(marks / visible), np.sqrt(repeats / some), np.sqrt(dup / np.maximum(n_lines, 1))], 1)
    return np.stack([per, chars, symbols, dup, repeats], 1).astype(np.int64), feats


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS and FEATURES of each row; a null text counts as empty, null lang and source as ''."""
    cols = {c.lower() for c in docs.columns}
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cols else F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            parts = [_counts(buf, offs) for _, _, buf, offs in T.slices(b.column("text"))]
            if parts:
                c, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *[pa.array(c[:, i]) for i in range(c.shape[1])], *[pa.array(f[:, i]) for i in range(f.shape[1])]], ["doc_id", "lang", "source", *COUNTS, *FEATURES])

    return src.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES))


def _level_names() -> list[F.Column]:
    return [F.concat(F.lit("s:"), F.col("lang"), F.lit("\u0001"), F.col("source")), F.concat(F.lit("l:"), F.col("lang")), F.lit("a:")]


def _rolled(sums: DataFrame, by: list[str]) -> DataFrame:
    """Sums of (lang, source) and ``by`` added up to all three levels."""
    cells = [c for c in sums.columns if c not in ("lang", "source", *by)]
    return sums.withColumn("grp", F.explode(F.array(*_level_names()))).groupBy("grp", *by).agg(*[F.sum(c).alias(c) for c in cells])


def _moments(cols: list[F.Column]) -> list[F.Column]:
    p = len(cols)
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(cols[i] * cols[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]]


def _cov(r: dict, p: int) -> tuple[np.ndarray, np.ndarray]:
    c = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
    return c, np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / r["n"] - np.outer(c, c)


def _floored(v: np.ndarray) -> np.ndarray:
    return v + np.diag(np.maximum(FLOOR**2 - np.diag(v), 1e-9))


ESTIMATE = "grp string, start int, n long, centre array<double>, cov array<double>, weight array<double>, logdet double"


def _entry(grp: str, start: int, n: int, c: np.ndarray, v: np.ndarray) -> tuple:
    v = _floored(v)
    return grp, start, n, c.tolist(), v.ravel().tolist(), np.linalg.inv(v).ravel().tolist(), float(np.linalg.slogdet(v)[1])


def _estimates(moments: DataFrame, widen: float) -> DataFrame:
    """Centre, covariance, its inverse and log determinant for each row of moments (grp, start, ...); computed in tasks, as groups may be many."""
    p = len(FEATURES)

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                c, v = _cov(r, p)
                out.append(_entry(r["grp"], r["start"], r["n"], c, v * widen))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ESTIMATE.split(", ")])

    return moments.mapInPandas(run, ESTIMATE)


def _distance() -> F.Column:
    p = len(FEATURES)
    d = [F.col(c) - F.col("centre")[i] for i, c in enumerate(FEATURES)]
    return sum((d[i] * d[j] * F.col("weight")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def _with_entries(rows: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    """Each row once for every entry of its three levels in ``table`` (grp, ...). The entries of a (lang, source), a dozen at most, are one row for each salt."""
    keys = rows.select("lang", "source").distinct().withColumn("grp", F.explode(F.array(*_level_names())))
    lists = keys.join(table, "grp").groupBy("lang", "source").agg(F.collect_list(F.struct("grp", *cols)).alias("entries"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int"))
    return salted.join(lists, ["lang", "source", "salt"]).withColumn("e", F.explode("entries")).select(*FEATURES, "e.*")


def _starts(rows: DataFrame) -> DataFrame:
    """The four starts of every level."""
    p = len(FEATURES)
    plain = _rolled(rows.groupBy("lang", "source").agg(*_moments([F.col(c) for c in FEATURES])), []).withColumn("start", F.lit(0))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(c) / float(FLOOR[i] / 16)).cast("int").alias("bin")) for i, c in enumerate(FEATURES)])
    hist = _rolled(rows.select("lang", "source", F.explode(cells).alias("x")).groupBy("lang", "source", "x.i", "x.bin").agg(F.count("*").alias("c")), ["i", "bin"])
    w = Window.partitionBy("grp", "i").orderBy("bin")  # bins are as many as a statistic's range holds
    ranked = hist.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy("grp", "i")))
    first = ranked.groupBy("grp", "i").agg(*[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))).alias(f"b{k}") for k, q in enumerate((0.25, 0.5, 0.75))])
    width = F.get(F.array(*[F.lit(float(x / 16)) for x in FLOOR]), F.col("i"))
    first = first.select("grp", "i", ((F.col("b1") + 0.5) * width).alias("mid"), ((F.col("b2") - F.col("b0") + 1) * width / 1.349).alias("spread"))
    robust = first.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", "mid", "spread"))).alias("x")) \
        .select("grp", F.transform("x", lambda e: e["mid"]).alias("mid"), F.transform("x", lambda e: F.greatest(e["spread"], F.get(F.array(*[F.lit(float(v)) for v in FLOOR]), e["i"]))).alias("spread"))
    robust = written(robust, "medians")
    z = _with_entries(rows, robust, ["mid", "spread"])
    z = z.select("grp", *[((F.col(c) - F.col("mid")[i]) / F.col("spread")[i]).alias(f"z{i}") for i, c in enumerate(FEATURES)])
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))), F.lit(1e-9))
    soft = z.groupBy("grp").agg(*_moments([F.tanh(f"z{i}") for i in range(p)])).withColumn("start", F.lit(2))
    sign = z.withColumn("norm", norm).groupBy("grp").agg(*_moments([F.col(f"z{i}") / F.col("norm") for i in range(p)])).withColumn("start", F.lit(3))
    shapes = soft.unionByName(sign).join(robust, "grp")

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mid, spread = np.asarray(r["mid"]), np.asarray(r["spread"])
                _, v = _cov(r, p)
                sd = np.sqrt(np.maximum(np.diag(v), 1e-12))
                corr = np.where(np.outer(sd, sd) > 1e-9, v / np.outer(sd, sd), 0.0)
                np.fill_diagonal(corr, 1.0)
                out.append(_entry(r["grp"], r["start"], r["n"], mid, corr * np.outer(spread, spread)))
                if r["start"] == 2:
                    out.append(_entry(r["grp"], 1, r["n"], mid, np.diag(spread**2)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ESTIMATE.split(", ")])

    return written(_estimates(plain, 1.0).unionByName(shapes.mapInPandas(run, ESTIMATE)), "mcd")


def _concentrated(rows: DataFrame, est: DataFrame, support: float) -> DataFrame:
    """The next estimates: those of the ``support`` nearest rows. One pass: counts and sums by bin, of which the near ones are added up."""
    far = _with_entries(rows, est, ["start", "centre", "weight"]).withColumn("bin", F.floor(F.log1p(F.greatest(_distance(), F.lit(0.0))) / BIN).cast("int"))
    sums = far.groupBy("grp", "start", "bin").agg(*_moments([F.col(c) for c in FEATURES]))
    w = Window.partitionBy("grp", "start")  # bins are bounded by the range of the logarithm
    near = sums.withColumn("seen", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(w)).filter(F.col("seen") < support * F.col("all"))
    cells = [c for c in sums.columns if c not in ("grp", "start", "bin")]
    return _estimates(near.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in cells]), HALF)


def covariance_estimates(m: DataFrame, support: float = 0.5, most_steps: int = 30) -> DataFrame:
    """(grp, n, centre, cov, weight, logdet, start) of every level: the start whose concentration ended with the smallest determinant, reweighted.

    ``most_steps`` only guards the loop; steps end when no log determinant falls by 0.001. Ties take the first start.
    """
    rows = m.select("lang", "source", *FEATURES)
    best = _starts(rows)
    open_ = best
    for step in range(most_steps):
        new = written(_concentrated(rows, open_, support), "mcd")
        if step == 0:
            best = open_ = new  # a start's own determinant is of all rows
            continue
        old = best.select("grp", "start", F.col("logdet").alias("before"))
        falls = written(new.join(old, ["grp", "start"]).filter("logdet < before - 0.001").drop("before"), "mcd")
        if falls.isEmpty():
            break
        best = written(best.join(falls, ["grp", "start"], "left_anti").unionByName(falls), "mcd")
        open_ = falls
    won = best.groupBy("grp").agg(F.min(F.struct("logdet", "start", "centre", "weight")).alias("x")).select("grp", "x.*")
    near = _with_entries(rows, won, ["start", "centre", "weight", "logdet"]).withColumn("_d", _distance())
    total = near.groupBy("grp", "start", "logdet").agg(F.count("*").alias("total"), *[c for c in _moments([F.when(F.col("_d") <= CUT, F.col(x)) for x in FEATURES])[1:]], F.count(F.when(F.col("_d") <= CUT, 1)).alias("n"))
    last = _estimates(total.drop("total", "logdet"), NEAR).drop("n", "logdet")
    return written(last.join(total.select("grp", F.col("total").alias("n"), "logdet"), "grp"), "mcd")


def _shrunk(est: DataFrame, keys: DataFrame, shrink: float) -> DataFrame:
    """(lang, source, centre, weight): each level's estimate mixed with that of the level above it by the number of rows behind it."""
    p = len(FEATURES)
    levels = keys.withColumn("x", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), g.alias("grp")) for i, g in enumerate(_level_names())]))).select("lang", "source", "x.*")
    lists = levels.join(est.select("grp", "n", "centre", "cov"), "grp").groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("level", "n", "centre", "cov"))).alias("x"))

    def run(frames):
        for f in frames:
            out = []
            for lang, source, x in zip(f["lang"], f["source"], f["x"]):
                c = v = None
                for e in reversed(list(x)):  # from the whole table down
                    own, spread = np.array(e["centre"], dtype=float), np.array(e["cov"], dtype=float).reshape(p, p)
                    w = e["n"] / (e["n"] + shrink) if c is not None else 1.0
                    off = own - c if c is not None else 0.0 * own
                    v = spread if v is None else w * spread + (1 - w) * v + w * (1 - w) * np.outer(off, off)
                    c = own if c is None else w * own + (1 - w) * c
                out.append((lang, source, c.tolist(), np.linalg.inv(_floored(v)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["lang", "source", "centre", "weight"])

    return lists.mapInPandas(run, "lang string, source string, centre array<double>, weight array<double>")


def robust_quality(docs: DataFrame, shrink: float = 200.0, cutoff: float = 24.32, min_words: int = 50, max_repeats: int = 50, support: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, distance (squared, Mahalanobis) and kept, one row per row of ``docs``.

    Base: fewer than ``min_words`` words, or more than ``max_repeats`` percent of the words inside repeated 3-word windows.
    The others stay unless their squared distance exceeds ``cutoff`` (the 0.999 quantile of chi-square with 7 degrees). Null or empty texts have no words and fail the base rule.
    Null lang or source are a group of their own; a null doc_id keeps its row; repeated rows are judged alike; an empty table gives no rows; extra columns are ignored.
    """
    m = written(measure(docs), "measures")
    levels = _shrunk(covariance_estimates(m, support), m.select("lang", "source").distinct(), shrink)
    levels = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return m.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")).join(levels, ["lang", "source", "salt"]).withColumn("distance", _distance()) \
        .withColumn("base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeats} * n_words")) \
        .select("doc_id", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))
