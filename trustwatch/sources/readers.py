"""Tolerant readers: delimited and whitespace text, Parquet, JSON, transposed matrices, dialect profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustwatch.functions.stats import finite

# fixed values: tokens read as missing, delimiters tried, and reserved column names
NULL_TOKENS = ["", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "none", "-", "?", "#N/A", "#NA"]
DELIMITERS = [",", "\t", ";", "|", "whitespace"]
RESERVED = ["__row__", "__group__", "__chunk__"]


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Trimmed, single-line, non-empty names; repeated names (ignoring case) get a suffix."""
    seen: dict[str, int] = {}
    out = []
    for i, c in enumerate(df.columns):
        n = " ".join(c.replace("\n", " ").replace("\r", " ").split())
        if not n or n in RESERVED or n.lower().startswith("unnamed:"):
            n = f"col_{i}"
        k = seen.get(n.lower(), 0)
        seen[n.lower()] = k + 1
        out.append(n if not k else f"{n}_{k + 1}")
    return df.toDF(*out)


def normalize_nulls(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Missing tokens in text and non-finite numbers become NULL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(list(tokens)), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def numeric_columns(df: DataFrame, decimal: str = ".", min_share: float = 0.9) -> DataFrame:
    """Text columns of which at least 90 % of the values are numbers become DOUBLE (one pass counts all columns)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    num = {c: F.expr(f"try_cast(replace(trim(`{c}`), '{decimal}', '.') AS double)") for c in text}
    a = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(text)], *[F.count(num[c]).alias(f"k{i}") for i, c in enumerate(text)]).first()
    good = {c for i, c in enumerate(text) if a[f"n{i}"] and a[f"k{i}"] >= min_share * a[f"n{i}"]}
    return df.select(*[num[c].alias(c) if c in good else F.col(f"`{c}`") for c in df.columns])


def read_delimited(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", header: bool = True, decimal: str = ".", tokens: Sequence[str] = NULL_TOKENS, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text first; rows too long or too short are padded, and dropped only when Spark cannot read them."""
    df = spark.read.csv(paths, sep=delimiter, header=header, encoding=encoding, mode="PERMISSIVE", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return numeric_columns(normalize_nulls(sanitize_columns(df), tokens), decimal)


def read_whitespace(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str] | None = None, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Columns separated by any white space; the widest common field count gives the columns."""
    lines = spark.read.text(paths).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"))
    width = len(names) if names else lines.groupBy(F.size("f").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()["k"]
    cols = [F.get("f", F.lit(i)).alias(names[i] if names else f"col_{i}") for i in range(width)]
    return numeric_columns(normalize_nulls(lines.select(*cols), tokens))


def flatten_nested(df: DataFrame) -> DataFrame:
    nested = (T.StructType, T.MapType, T.ArrayType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with nested columns as JSON text."""
    return flatten_nested(spark.read.parquet(path))


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return normalize_nulls(flatten_nested(spark.read.json(path, multiLine=multiline)))


def transpose_matrix(lines: DataFrame, line_no: str, text: str, n_lines: int, sep: str = r"\s+") -> DataFrame:
    """Each line is a signal: rows become samples, columns the (few) lines."""
    d = lines.select(line_no, F.posexplode(F.split(F.trim(text), sep)).alias("row", "v"))
    p = d.groupBy("row").pivot(line_no, list(range(n_lines))).agg(F.first(F.expr("try_cast(v AS double)")))
    return p.select(F.col("row").cast("long").alias("row"), *[F.col(f"`{i}`").alias(f"col_{i}") for i in range(n_lines)])


def dialect_profile(spark: SparkSession, glob: str) -> DataFrame:
    """Best delimiter of each file of a folder: consistency of the field count, share of numeric fields, decimal comma."""
    d = spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    each = F.array(*[F.struct(F.lit(x).alias("delimiter"), (F.split(F.trim("value"), "\\s+") if x == "whitespace" else F.split("value", f"\\Q{x}\\E")).alias("f")) for x in DELIMITERS])
    e = d.select("file", "value", F.explode(each).alias("d")).select("file", "value", "d.delimiter", "d.f")
    num = F.size(F.filter("f", lambda x: x.rlike(r"^\s*[-+]?[0-9]+([.,][0-9]+)?([eE][-+]?[0-9]+)?\s*$"))) / F.size("f")
    comma = F.size(F.filter("f", lambda x: x.rlike(r"^\s*[-+]?[0-9]+,[0-9]+\s*$")))
    dot = F.size(F.filter("f", lambda x: x.rlike(r"^\s*[-+]?[0-9]+\.[0-9]+\s*$")))
    c = e.groupBy("file", "delimiter", F.size("f").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.sum(num).alias("s"), F.sum(comma).alias("nc"), F.sum(dot).alias("nd"))
    w = Window.partitionBy("file", "delimiter")
    c = c.withColumns({"t": F.sum("c").over(w), "S": F.sum("s").over(w), "NC": F.sum("nc").over(w), "ND": F.sum("nd").over(w)})
    m = c.filter("k > 1").withColumn("_r", F.row_number().over(w.orderBy(F.desc("c"), F.desc("k")))).filter("_r = 1")
    score = 2 * F.col("c") / F.col("t") + F.col("S") / F.col("t") + 0.001 * F.least("k", F.lit(500))
    best = m.withColumn("score", score).withColumn("_b", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "delimiter"))).filter("_b = 1")
    return best.select("file", "delimiter", F.col("k").alias("n_fields"), (F.col("c") / F.col("t")).alias("consistency"), (F.col("S") / F.col("t")).alias("numeric_share"), F.when(F.col("NC") > 2 * F.greatest(F.lit(1), F.col("ND")), ",").otherwise(".").alias("decimal"), "score")


def orientation_stats(wide: DataFrame, signals: Sequence[str], keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Mean lag-1 autocorrelation down the columns and along the rows; far larger along rows means transposed."""
    from trustwatch.operators import ordered

    d = ordered.with_windows(wide.select(*keys, "pos", *signals), list(keys), lambda w: {f"_l_{s}": F.lag(s).over(w) for s in signals}, before=1)
    down = [F.corr(s, f"_l_{s}") for s in signals]
    pairs = F.array(*[F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in zip(signals, signals[1:])])
    a = d.agg((sum((F.coalesce(c, F.lit(0.0)) for c in down), F.lit(0.0)) / len(signals)).alias("down"))
    b = wide.select(F.explode(pairs).alias("p")).agg(F.corr("p.x", "p.y").alias("along"))
    return a.crossJoin(b).withColumn("transposed", (F.col("along") - F.col("down") > 0.25) & (F.col("along") > 0.5))


def narrow_floats(df: DataFrame) -> DataFrame:
    """DOUBLE to FLOAT unless a column is integer-valued or reaches 1e7 (epochs included); one pass over the data."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    a = df.agg(*[F.max(F.abs(c)).alias(f"m{i}") for i, c in enumerate(cols)], *[F.sum((F.col(c) != F.floor(c)).cast("long")).alias(f"f{i}") for i, c in enumerate(cols)]).first()
    keep = {c for i, c in enumerate(cols) if a[f"m{i}"] is None or a[f"m{i}"] >= 1e7 or not a[f"f{i}"]}
    return df.select(*[F.col(c).cast("float").alias(c) if c in cols and c not in keep else F.col(c) for c in df.columns])


def sample_rows(df: DataFrame, n: int, key: str = "row", seed: int = 0) -> DataFrame:
    """n rows by the order of a seeded hash: the same rows every time, and a top-n without a full sort."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)

