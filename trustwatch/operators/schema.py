"""What the columns are: kinds, clocks, counters, group keys, labels, domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.functions import stats as S
from trustwatch.operators import ordered

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
INTEGRAL = ("tinyint", "smallint", "int", "bigint")

# fixed values: formats tried for text timestamps, in this order
DATETIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd",
                    "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"]


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, value as text, count): one map-side combined pass; distinct counts follow without an expand."""
    typed = [F.col(c).cast("string").alias(c) for c in cols]
    return df.select(*typed).unpivot([], list(cols), "name", "value").groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))


def column_kinds(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """name, kind, n, n_unique, numeric_share, date_share, integer_valued for every column."""
    types = {n: t.split("(")[0] for n, t in df.dtypes}
    cols = list(cols or types)
    v = value_counts(df, cols).withColumn("value", F.trim("value")).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    dot, comma = F.expr("try_cast(value AS double)"), F.expr("try_cast(replace(value, ',', '.') AS double)")
    date = F.expr("try_cast(value AS timestamp)")
    n = F.col("c")
    a = v.withColumns({"_d": dot, "_c": F.coalesce(dot, comma), "_t": date}).groupBy("name").agg(
        F.sum(n).alias("n"), F.count_distinct("value").alias("n_unique"), (F.sum(F.when(F.col("_d").isNotNull(), n).otherwise(0)) / F.sum(n)).alias("dot_share"),
        (F.sum(F.when(F.col("_c").isNotNull(), n).otherwise(0)) / F.sum(n)).alias("numeric_share"), (F.sum(F.when(F.col("_t").isNotNull() & F.col("_d").isNull() & (F.length("value") >= 6), n).otherwise(0)) / F.sum(n)).alias("date_share"),
        F.coalesce(F.bool_and(F.abs(F.col("_c") - F.round("_c")) < 1e-9), F.lit(False)).alias("integer_valued"), F.min("_c").alias("lo"), F.max("_c").alias("hi"))
    every = df.sparkSession.createDataFrame([(c, types[c]) for c in cols], "name string, type string")
    d = every.join(a, "name", "left").na.fill(0, ["n", "n_unique"])
    t, u = F.col("type"), F.col("n_unique")
    num = t.isin(*NUMERIC, "decimal") | (~t.isin("timestamp", "timestamp_ntz", "date", "boolean") & (F.col("numeric_share") >= 0.95))
    zero_one = F.col("integer_valued") & (F.col("lo") >= 0) & (F.col("hi") <= 1)
    kind = (F.when(F.col("n") == 0, "empty").when(u == 1, "constant").when(t.isin("timestamp", "timestamp_ntz", "date"), "datetime").when(t == "boolean", "boolean")
            .when(t.isin(*NUMERIC, "decimal") & zero_one, "boolean").when(t.isin(*INTEGRAL) | (t.isin("float", "double", "decimal") & F.col("integer_valued")), "integer").when(num, "numeric")
            .when(F.col("date_share") >= 0.95, "datetime").when((u / F.col("n") >= 0.9) & (F.col("n") >= 50), "identifier")
            .when(u <= F.greatest(F.lit(20), F.floor(0.02 * F.col("n"))), "categorical").otherwise("text"))
    low = u <= F.greatest(F.lit(2), F.least(F.lit(30), F.floor(0.05 * F.col("n")).cast("int")))
    return d.select("name", "type", kind.alias("kind"), "n", "n_unique", F.coalesce("integer_valued", F.lit(False)).alias("integer_valued"), low.alias("low_cardinality"),
                    F.when(F.col("numeric_share") > F.col("dot_share"), F.lit(",")).otherwise(".").alias("decimal"))


def datetime_format(df: DataFrame, col: str, min_share: float = 0.95) -> DataFrame:
    """The first format that parses at least 95 % of the values (all formats counted in one pass)."""
    c = F.col(col)
    parsed = [F.sum(F.try_to_timestamp(c, F.lit(f)).isNotNull().cast("long")).alias(f"f{i}") for i, f in enumerate(DATETIME_FORMATS)]
    a = df.filter(c.isNotNull()).agg(F.count(F.lit(1)).alias("n"), *parsed)
    ok = [F.when(F.col(f"f{i}") >= min_share * F.col("n"), F.struct(F.lit(f).alias("format"), (F.col(f"f{i}") / F.col("n")).alias("share"))) for i, f in enumerate(DATETIME_FORMATS)]
    return a.select("n", F.coalesce(*ok).alias("x")).select("n", "x.format", "x.share")


def steps(df: DataFrame, value: Column, keys: Sequence[str] = ("grp",), pos: str = "pos") -> DataFrame:
    d = df.select(*dict.fromkeys([*keys, pos]), value.cast("double").alias("_v"))
    return ordered.with_windows(d, list(keys), lambda w: {"step": F.col("_v") - F.lag("_v").over(w)}, before=1, pos=pos).filter("step is not null")


def epoch_unit(df: DataFrame, value: Column, keys: Sequence[str] = ("grp",), pos: str = "pos") -> DataFrame:
    """s, ms or ns when an integer column is an epoch clock (range, distinct values, 90 % non-decreasing)."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.approx_count_distinct(value).alias("nu"))
    up = steps(df, value, keys, pos).agg(F.avg((F.col("step") >= 0).cast("double")).alias("up"))
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    unit = F.when((lo >= 6.3e8) & (hi <= 4.2e9), "s").when((lo >= 6.3e11) & (hi <= 4.2e12), "ms").when((lo >= 6.3e17) & (hi <= 4.2e18), "ns")
    return r.crossJoin(F.broadcast(up)).select(F.when((F.col("nu") > 10) & (F.col("up") >= 0.9), unit).alias("unit"), F.col("up").alias("non_decreasing"))


def time_stats(df: DataFrame, ts: str, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Share of non-decreasing steps, period (median positive step), irregular, zero and negative shares."""
    d = steps(df, F.unix_micros(F.col(ts)) / F.lit(1e6), keys)
    per = S.wide_quantiles(d.filter("step > 0"), {"step": F.col("step")}, [0.5]).select(F.get("q", F.lit(0)).alias("period"))
    st = F.col("step")
    share = lambda c: F.avg(c.cast("double"))
    return d.crossJoin(F.broadcast(per)).agg(
        F.count(F.lit(1)).alias("n_steps"), share(st >= 0).alias("monotone"), F.max("period").alias("period"), share(F.abs(st - F.col("period")) > 0.5 * F.col("period")).alias("irregular"),
        share(st == 0).alias("zero_share"), share(st < 0).alias("negative_share")).withColumn("is_clock", F.col("monotone") >= 0.8)


def counter_stats(df: DataFrame, col: str, keys: Sequence[str] = (), pos: str = "row") -> DataFrame:
    """Modal positive step and its share; resets. A share of 0.9 makes an order column."""
    d = steps(df, F.col(col), keys, pos)
    mode = d.filter("step > 0").groupBy("step").agg(F.count(F.lit(1)).alias("c")).agg(F.max_by("step", F.struct("c", -F.col("step"))).alias("mode"))
    return d.crossJoin(F.broadcast(mode)).agg(
        F.count(F.lit(1)).alias("n_steps"), F.max("mode").alias("step"), F.avg((F.abs(F.col("step") - F.col("mode")) < 1e-9).cast("double")).alias("step_share"),
        F.sum((F.col("step") < 0).cast("long")).alias("resets")).withColumn("is_counter", F.col("step_share") >= 0.9)


def middle(d: DataFrame, col: str) -> DataFrame:
    """One row: median_len of ``col`` and _mad around it, exact at any number of rows."""
    med = S.wide_quantiles(d, {col: F.col(col)}, [0.5]).first().q[0]
    mad = S.wide_quantiles(d, {col: F.abs(F.col(col) - F.lit(med))}, [0.5]).first().q[0]
    return d.sparkSession.createDataFrame([(med, mad)], "median_len double, _mad double")


def score_group_keys(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """Contiguity, regularity and plausibility of key columns as group keys (rows in ``row`` order)."""
    out = None
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    for cols in candidates:
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
        g = df.groupBy(key.alias("key")).agg(F.min("row").alias("s"), F.max("row").alias("e"), F.count(F.lit(1)).alias("n"))
        a = g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.when(F.col("n") == F.col("e") - F.col("s") + 1, F.col("n")).otherwise(0)).alias("_in")).crossJoin(F.broadcast(middle(g, "n")))
        a = a.crossJoin(F.broadcast(total))
        cont = F.col("_in") / F.col("n_rows")
        reg = F.when(F.col("n_groups") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), 1.4826 * F.col("_mad") / F.col("median_len"))))
        pl = F.when((F.col("n_groups") < 2) | (F.col("median_len") < 3), 0.0).otherwise(
            F.when(F.col("median_len") < 20, F.col("median_len") / 20.0).otherwise(1.0) * F.when(F.col("n_groups") > F.col("n_rows") / 10, 0.3).otherwise(1.0))
        r = a.select(F.lit("key_columns").alias("method"), F.lit("+".join(cols)).alias("columns"), "n_groups", "median_len", cont.alias("contiguity"), reg.alias("regularity"),
                     ((0.6 * cont + 0.25 * reg + 0.15) * pl).alias("score"))
        out = r if out is None else out.unionByName(r)
    return out


def segment_by_reset(df: DataFrame, col: str, keys: Sequence[str] = (), pos: str = "row") -> DataFrame:
    """New segment where a counter falls."""
    return ordered.segments(df.select(*dict.fromkeys([*keys, pos, "row", col])), list(keys), lambda w: F.col(col) < F.lag(col).over(w), pos=pos)


def segment_by_gap(df: DataFrame, ts: str, max_gap_s: float, keys: Sequence[str] = (), pos: str = "row") -> DataFrame:
    """New segment where time jumps by more than ``max_gap_s`` in either direction."""
    t = F.unix_micros(F.col(ts)) / F.lit(1e6)
    d = df.select(*dict.fromkeys([*keys, pos, "row"]), t.alias("_t"))
    return ordered.segments(d, list(keys), lambda w: F.abs(F.col("_t") - F.lag("_t").over(w)) > max_gap_s, pos=pos)


def key_blocks(df: DataFrame, key: Column, keys: Sequence[str] = (), pos: str = "row") -> DataFrame:
    """Contiguous blocks of an equal key."""
    d = df.select(*dict.fromkeys([*keys, pos, "row"]), F.coalesce(key.cast("string"), F.lit("null")).alias("key"))
    return ordered.segments(d, list(keys), lambda w: F.lag("key").over(w).isNotNull() & (F.lag("key").over(w) != F.col("key")), pos=pos, aggs={"key": ("min", F.col("key"))})


def segmentation_candidate(segs: DataFrame, method: str, n_rows: int) -> DataFrame:
    a = segs.agg(F.count(F.lit(1)).alias("n_groups")).crossJoin(F.broadcast(middle(segs, "n")))
    reg = F.when(F.col("n_groups") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), 1.4826 * F.col("_mad") / F.col("median_len"))))
    pl = F.when((F.col("n_groups") < 2) | (F.col("median_len") < 3), 0.0).otherwise(F.when(F.col("median_len") < 20, F.col("median_len") / 20.0).otherwise(1.0) * F.when(F.col("n_groups") > n_rows / 10, 0.3).otherwise(1.0))
    return a.select(F.lit(method).alias("method"), F.lit("").alias("columns"), "n_groups", "median_len", F.lit(1.0).alias("contiguity"), reg.alias("regularity"), ((0.5 + 0.35 * reg) * pl).alias("score"))


def choose_grouping(cands: DataFrame) -> DataFrame:
    """Candidates that agree on the number of groups (within 10 %) support each other; best first."""
    a, b = cands.alias("a"), cands.alias("b")
    other = (F.col("a.method") != F.col("b.method")) | (F.col("a.columns") != F.col("b.columns"))
    near = F.abs(F.col("a.n_groups") - F.col("b.n_groups")) <= F.greatest(F.lit(1.0), 0.1 * F.col("a.n_groups"))
    agree = a.join(b, other & near).groupBy(F.col("a.method").alias("method"), F.col("a.columns").alias("columns")).agg(F.count(F.lit(1)).alias("agreement"))
    d = cands.join(agree, ["method", "columns"], "left").withColumn("agreement", F.coalesce("agreement", F.lit(0)))
    d = d.withColumn("score", F.least(F.lit(1.0), F.col("score") + 0.05 * F.col("agreement")))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "method", "columns")))


def assign_groups(df: DataFrame, blocks: DataFrame, name: str = "grp") -> DataFrame:
    """Group of each row from blocks (row_start, row_end inclusive)."""
    b = blocks.select("row_start", "row_end", F.col("row_start").cast("string").alias(name))
    return ordered.join_intervals(df, b, []).drop("row_start", "row_end")


def override_schema(df: DataFrame, decision: dict) -> DataFrame:
    """A person's decision wins: regroup by columns, or take another clock or order column."""
    d = df
    if decision.get("group_columns"):
        d = d.withColumn("grp", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in decision["group_columns"]]))
    if decision.get("time_column"):
        d = d.withColumn("ts", F.col(decision["time_column"]).cast("timestamp"))
    return d


def classify_columns(df: DataFrame, kinds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """signal, label or meta: columns constant inside most groups but different between them are labels or meta."""
    long = df.select("grp", *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["grp"], list(cols), "name", "value").filter("value is not null")
    per = long.groupBy("name", "grp", "value").agg(F.count(F.lit(1)).alias("c")).groupBy("name", "grp").agg(F.count(F.lit(1)).alias("nu"), F.sum("c").alias("c"), F.min("value").alias("v"))
    a = per.groupBy("name").agg(F.avg((F.col("nu") <= 1).cast("double")).alias("within"), F.avg(F.when(F.col("c") >= 3, (F.col("nu") <= 1).cast("double"))).alias("within3"),
                                F.min("v").alias("_a"), F.max("v").alias("_b"), F.count(F.lit(1)).alias("n_groups"))
    d = kinds.join(a, "name", "left")
    varies = (F.col("_a") != F.col("_b")) & (F.col("n_groups") > 1)
    k = F.col("kind")
    const = F.when(k.isin("integer", "numeric") & ~F.col("low_cardinality"), (F.col("within3") >= 0.98) & varies & (F.col("n_groups") >= 20)).otherwise((F.col("within") >= 0.9) & varies)
    role = (F.when(k.isin("empty", "identifier", "datetime", "text"), "meta").when(k == "constant", F.when(F.col("type").isin(*NUMERIC), "signal").otherwise("meta"))
            .when(F.coalesce(const, F.lit(False)), F.when(k.isin("integer", "numeric") & ~F.col("low_cardinality") & (F.col("n_unique") > F.greatest(F.lit(50.0), 0.05 * F.col("n_groups"))), "meta").otherwise("label"))
            .when(k == "categorical", "meta").otherwise("signal"))
    return d.select("name", "kind", role.alias("role"), F.coalesce("within", F.lit(0.0)).alias("constant_within"))


def domain_likelihood(kinds: DataFrame, autocorr: DataFrame, irregular: DataFrame) -> DataFrame:
    """Sensor stream, business records or event log, from column kinds, lag-1 autocorrelation and regularity.

    ``autocorr``: one row per continuous signal; ``irregular``: one row."""
    k = kinds.agg(F.avg(((F.col("kind") == "numeric") & (F.col("n_unique") > 50) & ~F.col("low_cardinality")).cast("double")).alias("cont"), F.avg(F.col("kind").isin("text", "categorical", "identifier").cast("double")).alias("text"),
                  F.max((F.col("kind") == "identifier").cast("double")).alias("ident"))
    ac = autocorr.agg(F.coalesce(F.percentile("autocorr", F.lit(0.5)), F.lit(0.0)).alias("ac"))
    d = k.crossJoin(F.broadcast(ac)).crossJoin(F.broadcast(irregular.select("irregular")))
    regular = F.when(F.col("irregular") < 0.1, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("irregular")))
    pos = F.greatest(F.lit(0.0), F.col("ac"))
    raw = {"sensor_stream": 0.45 * F.col("cont") + 0.4 * pos + 0.15 * regular, "business_records": 0.5 * F.col("text") + 0.3 * F.greatest(F.lit(0.0), 1.0 - pos) + 0.2 * F.col("ident"),
           "event_log": 0.4 * F.col("irregular") + 0.3 * F.col("text") + 0.3 * (1.0 - F.col("cont")), "unknown": F.lit(0.15)}
    total = sum(raw.values())
    return d.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in raw]), F.array(*[c / total for c in raw.values()]))).alias("domain", "likelihood"))


def derive_event_signals(df: DataFrame, cols: Sequence[str], window: int = 50, max_values: int = 4, min_share: float = 0.001, min_change: float = 0.02) -> DataFrame:
    """Rolling share of the rarest values of each category column over the last rows of the group, long format."""
    vc = value_counts(df, cols).filter("value is not null")
    w = Window.partitionBy("name")
    pick = (vc.withColumns({"k": F.count(F.lit(1)).over(w), "n": F.sum("c").over(w)}).filter(F.col("k").between(2, 12) & (F.col("c") >= F.greatest(F.lit(5.0), min_share * F.col("n")))))
    pick = ordered.first_k(pick, ["name"], ["c", "value"], max_values)
    chosen = [(r["name"], r["value"]) for r in pick.select("name", "value").orderBy("name", "value").collect()]  # at most 4 per column
    d = df.select("grp", "row", "pos", *[F.col(c).cast("string").alias(c) for c in cols])

    def exprs(win):
        roll = win.rowsBetween(-(window - 1), 0)
        return {f"share_{c}_{v}": F.avg((F.coalesce(F.col(c) == v, F.lit(False))).cast("double")).over(roll) for c, v in chosen}

    out = ordered.with_windows(d, ["grp"], exprs, before=window - 1)
    return out.select("grp", "row", *[f"share_{c}_{v}" for c, v in chosen]).unpivot(["grp", "row"], [f"share_{c}_{v}" for c, v in chosen], "signal", "value")
