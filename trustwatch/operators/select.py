"""Reading, sampling, curating and releasing rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S

GOLDEN = 0.6180339887498949


def rows_between(df: DataFrame, a: int, b: int, cols: Sequence[str] = ("*",)) -> DataFrame:
    """Rows [a, b): the bounds reach the Parquet scan."""
    return df.filter((F.col("row") >= a) & (F.col("row") < b)).select(*cols)


def group_rows(df: DataFrame, grp: str, a: int, b: int) -> DataFrame:
    return df.filter((F.col("grp") == grp) & (F.col("row") >= a) & (F.col("row") < b))


def rows_in_blocks(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows inside any of the half-open blocks (row_start, row_end), by a semi-join on row ids."""
    ids = blocks.select(F.explode(F.sequence(F.col("row_start"), F.col("row_end") - 1)).alias("row")).distinct()
    return df.join(ids, "row", "left_semi")


def chunk_sample(df: DataFrame, n_rows: int, n: int, n_chunks: int) -> DataFrame:
    """About n rows in n_chunks contiguous stretches spread evenly over the table; adds ``chunk``."""
    if n >= n_rows:
        return df.withColumn("chunk", F.lit(0).cast("long"))
    size, step = max(1, n // n_chunks), n_rows / n_chunks
    c = F.least(F.floor(F.col("row") / F.lit(step)), F.lit(n_chunks - 1)).cast("long")
    return df.withColumn("chunk", c).filter(F.col("row") - F.floor(F.col("chunk") * F.lit(step)) < size)


def plan_blocks(groups: DataFrame, block_len: int, lead: int = 0) -> DataFrame:
    """One block at the start of each group and one at a golden-ratio offset, with ``lead`` rows before it."""
    n, a = F.col("n_rows"), F.col("row_start")
    room = F.greatest(F.lit(0), n - block_len)
    frac = F.pmod(F.col("rank") * GOLDEN, F.lit(1.0))
    off = F.floor(frac * room).cast("long")
    first = F.struct(a.alias("block_start"), (a + F.least(n, F.lit(block_len))).alias("block_end"), a.alias("read_start"))
    second = F.struct((a + off).alias("block_start"), (a + off + F.least(n, F.lit(block_len))).alias("block_end"), (a + F.greatest(F.lit(0), off - lead)).alias("read_start"))
    both = F.array_compact(F.array(first, F.when(off >= block_len, second)))
    return groups.select("grp", F.explode(both).alias("b")).select("grp", "b.*")


def stride(df: DataFrame, k: int, start: int = 0) -> DataFrame:
    return df.filter(F.pmod(F.col("row") - start, F.lit(k)) == 0)


def sample_groups(df: DataFrame, n_groups: int, max_rows: int) -> DataFrame:
    """Whole groups spread evenly over the file, each cut after its share of ``max_rows``."""
    sizes = df.groupBy("grp").agg(F.min("row").alias("_s"))
    w = Window.orderBy("_s")
    total = sizes.agg(F.count(F.lit(1)).alias("_k"))
    r = sizes.withColumn("_r", F.row_number().over(w) - 1).crossJoin(F.broadcast(total))
    slot = F.floor(F.col("_r") * n_groups / F.col("_k"))
    prev = F.floor((F.col("_r") - 1) * n_groups / F.col("_k"))
    keep = r.filter((F.col("_r") == 0) | (slot > prev)).select("grp")
    return df.join(keep, "grp", "left_semi").filter(F.col("pos") < max(1, max_rows // n_groups))


def loose_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_.\-]+", ""))


def resolve_columns(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """``wanted``: name. ``catalog``: alias, column, display. Best of alias, column, display, loose key."""
    names = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(c).alias("key")) for i, c in enumerate(("alias", "column", "display"))])
    exact = catalog.select("alias", F.explode(names).alias("n")).select("alias", "n.rank", "n.key")
    loose = exact.select("alias", (F.col("rank") + 10).alias("rank"), loose_key(F.col("key")).alias("key"))
    w = wanted.select("name", F.explode(F.array(F.struct(F.col("name").alias("k"), F.lit(False).alias("l")), F.struct(loose_key(F.col("name")).alias("k"), F.lit(True).alias("l")))).alias("w")).select("name", "w.*")
    keys = exact.withColumn("l", F.lit(False)).unionByName(loose.withColumn("l", F.lit(True)))
    hit = w.join(keys, (w["k"] == keys["key"]) & (w["l"] == keys["l"]))
    return hit.groupBy("name").agg(F.min_by("alias", F.struct("rank", "alias")).alias("alias"))


def curate(df: DataFrame, action: Mapping) -> DataFrame:
    """drop_signal | drop_group | drop_range | downsample | drop_regime."""
    kind = action["type"]
    if kind == "drop_signal":
        return df.drop(*action["signals"])
    if kind == "drop_group":
        return df.filter(~F.col("grp").isin(list(action["groups"])))
    if kind == "drop_range":
        return df.filter(~F.col("row").between(action["row_start"], action["row_end"]))
    if kind == "downsample":
        return df.filter(F.pmod("pos", F.lit(int(action["factor"]))) == 0)
    if kind == "drop_regime":
        return df.join(action["members"].filter(F.col("regime") == action["regime"]).select("grp"), "grp", "left_anti")
    raise ValueError(f"unknown action {kind}")


def drop_duplicates(df: DataFrame, keys: Sequence[str], salt: int = 32) -> DataFrame:
    """Exact duplicates removed, the first row kept. Unique contents pass by an aggregate only; a content
    holding any share of the rows is spread over ``salt`` slots."""
    enc = {f"_e{i}": F.struct(F.col(k)) for i, k in enumerate(keys)}
    d = df.withColumns(enc)
    first = d.groupBy(*enc).agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    first = first.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    d = d.withColumn("_slot", F.pmod("row", F.lit(salt)).cast("int")).join(first, [*enc, "_slot"], "left")
    return d.filter(F.col("_first").isNull() | (F.col("row") == F.col("_first"))).drop(*enc, "_slot", "_first")


def append_aligned(df: DataFrame, new: DataFrame, mapping: Mapping[str, str], name: str, n_rows: int) -> DataFrame:
    """A compatible table appended as group ``new:<name>``; columns it lacks become NULL, rows continue."""
    r = new.select(*[F.col(a).alias(b) for a, b in mapping.items()], F.lit(f"new:{name}").alias("grp"), F.col("pos"), (F.col("pos") + n_rows).alias("row"))
    return df.unionByName(r, allowMissingColumns=True)


def query(spark, sql: str, views: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql)
    return out.limit(limit) if limit else out


def signal_summary(df: DataFrame, signal: str, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(signal)
    a = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c.isNull().cast("long")).alias("n_null"))
    q = S.group_quantiles(df, by, c, (0.05, 0.5, 0.95)).drop("n")
    d = a.join(q, list(by), "left") if by else a.join(F.broadcast(q), how="left")
    return d.select(*by, "n", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(x) for i, x in enumerate(("q05", "median", "q95"))], "max", "n_null")


def bucket_of(lo: int, hi: int, max_points: int) -> tuple[int, Column]:
    size = max(1, -(-(hi - lo) // max_points))
    return size, F.floor((F.col("row") - lo) / size).cast("long")


def series_buckets(df: DataFrame, signals: Sequence[str], lo: int, hi: int, max_points: int) -> DataFrame:
    """Mean, min and max of each signal in at most ``max_points`` row buckets."""
    _, b = bucket_of(lo, hi, max_points)
    aggs = [f(F.col(s)).alias(f"{s}_{n}") for s in signals for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rows_between(df, lo, hi).groupBy(b.alias("bucket")).agg(F.min("row").alias("row_start"), F.count(F.lit(1)).alias("n"), *aggs)


def score_buckets(scores: DataFrame, detectors: Sequence[str], shares: Sequence[str], lo: int, hi: int, max_points: int) -> DataFrame:
    """Largest score, largest detector scores and mean contributions per row bucket."""
    _, b = bucket_of(lo, hi, max_points)
    return rows_between(scores, lo, hi).groupBy(b.alias("bucket")).agg(
        F.min("row").alias("row_start"), F.max("score").alias("score"), *[F.max(d).alias(d) for d in detectors], *[F.avg(s).alias(s) for s in shares])


def coarse_series(df: DataFrame, signal: str, lo: int, hi: int, points: int = 20, min_n: int = 30) -> DataFrame:
    """At most 20 buckets of at least 30 readings, also in standard deviations from pooled sums."""
    _, b = bucket_of(lo, hi, points)
    x = F.col(signal)
    d = rows_between(df, lo, hi).groupBy(b.alias("bucket")).agg(F.count(x).alias("n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    tot = d.agg(F.sum("n").alias("_tn"), F.sum("_s").alias("_ts"), F.sum("_q").alias("_tq"))
    mean, var = F.col("_ts") / F.col("_tn"), (F.col("_tq") - F.col("_ts") * F.col("_ts") / F.col("_tn")) / (F.col("_tn") - 1)
    return (d.filter(F.col("n") >= min_n).crossJoin(F.broadcast(tot))
            .select("bucket", "n", (F.col("_s") / F.col("n")).alias("mean"), ((F.col("_s") / F.col("n") - mean) / F.sqrt(var)).alias("mean_std")))


def significant(c: Column, digits: int = 3) -> Column:
    x = c.cast("double")
    p = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * p) / p)


def safe_release(agg: DataFrame, n_col: str, aliases: Mapping[str, str], drop: Sequence[str] = ("min", "max", "first", "last", "label"), min_n: int = 30, digits: int = 3) -> DataFrame:
    """Aggregates over too few readings suppressed, numbers rounded, names aliased, record-like columns dropped."""
    keep = [c for c, _ in agg.dtypes if c not in drop and not any(c.endswith("_" + d) for d in drop)]
    kinds = dict(agg.dtypes)
    ok = F.col(n_col) >= min_n
    cols = [(F.when(ok, significant(F.col(c), digits)) if kinds[c] in ("double", "float") else F.col(c)).alias(aliases.get(c, c)) for c in keep]
    return agg.select(*cols)


# fixed values: patterns replaced before text leaves
REDACTIONS = [
    (r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\b", "[time]"),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?\b", "[time]"),
    (r"\b[A-Za-z0-9_\-]+\.(?:csv|tsv|parquet|json|xlsx|dat|txt)\b", "[file]"),
    (r"\b(\d+\.\d{3})\d+\b", "$1"),
]


def redact_text(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    for pattern, repl in REDACTIONS:
        c = F.regexp_replace(c, pattern, repl)
    return df.withColumn(col, c)


def find_unsafe(df: DataFrame, col: str) -> DataFrame:
    """Which patterns a text still contains."""
    found = [F.when(F.col(col).rlike(p), F.lit(name)) for (p, _), name in zip(REDACTIONS, ("date", "clock", "file", "decimal"))]
    return df.withColumn("violations", F.array_join(F.array_compact(F.array(*found)), "+")).filter("violations <> ''")


def redact_values(df: DataFrame, id_col: str, col: str, vocabulary: DataFrame) -> DataFrame:
    """Known category values become [value]: words are matched with the vocabulary table and joined back in order."""
    words = df.select(id_col, F.posexplode(F.split(F.col(col), " ")).alias("i", "w"))
    voc = vocabulary.select(F.lower("value").alias("v")).distinct()
    m = words.join(voc, F.lower("w") == F.col("v"), "left").select(id_col, "i", F.when(F.col("v").isNotNull(), "[value]").otherwise(F.col("w")).alias("w"))
    return m.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias(col))


