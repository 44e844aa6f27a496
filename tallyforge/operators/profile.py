"""Profiling in wide aggregates: metadata, statistics, outliers, labels, time, keys, formats, prefilter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge import roles
from tallyforge.operators.ordered import is_sorted, quantiles
from tallyforge.functions.scalars import DATE_FORMATS, INFINITE, NUMBER, is_numeric, numeric_columns

#: Columns in one wide aggregate: more would pass the limits of generated code.
CHUNK = 150


def wide(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """One row of aggregates as a dict, in chunks of columns; the number of jobs depends on the columns alone."""
    names, out = list(exprs), {}
    for k in range(0, len(names), CHUNK):
        out |= df.agg(*[exprs[n].alias(n) for n in names[k : k + CHUNK]]).first().asDict()
    return out


def quoted(c: str) -> Column:
    return F.col(f"`{c}`")


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str | Column] = (), cast: str = "double") -> DataFrame:
    """Long form: the kept columns, ``feature`` and ``value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), quoted(c).cast(cast).alias("value")) for c in columns])
    long = df.select(*keep, F.explode(pairs).alias("__x"))
    return long.select(*long.columns[:-1], "__x.feature", "__x.value")


def n_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates: n_rows, n_unique, n_duplicates, duplicate_pct."""
    once = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    out = once.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_unique"))
    return out.withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique")).withColumn("duplicate_pct", F.coalesce(F.round(100.0 * F.try_divide(F.col("n_duplicates"), F.col("n_rows")), 4), F.lit(0.0)))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct values that are not null, by column: values are grouped by column and value, then counted."""
    same = lambda c: quoted(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType) else quoted(c)
    out = dict.fromkeys(columns, 0)
    for k in range(0, len(columns), CHUNK):
        cells = F.array(*[F.struct(F.lit(j).alias("f"), same(c).cast("string").alias("v")) for j, c in enumerate(columns[k : k + CHUNK])])
        once = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null").groupBy("f", "v").agg(F.lit(1))
        out |= {columns[k + r.f]: r.n for r in once.groupBy("f").agg(F.count("*").alias("n")).collect()}
    return out


def as_table(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small result, a row a column of the input, as a DataFrame."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def share(part: int, whole: int, digits: int, times: float = 100.0) -> float:
    return round(times * part / whole, digits) if whole else 0.0


def column_metadata(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """By column: n_rows, nulls, null_pct, n_unique and whether it is constant."""
    columns = list(columns or df.columns)
    got = wide(df, {"n": F.count("*"), **{f"c:{c}": F.count(quoted(c)) for c in columns}})
    unique, n = distinct_counts(df, columns), got["n"]
    rows = [(c, n, n - got[f"c:{c}"], unique[c], share(n - got[f"c:{c}"], n, 4), unique[c] <= 1) for c in columns]
    return as_table(df, rows, "column string, n_rows long, nulls long, n_unique long, null_pct double, is_constant boolean")


def inspect_metadata(df: DataFrame) -> dict:
    """Shape, types, nulls, duplicates and constant columns as a report."""
    cols = [r.asDict() for r in column_metadata(df).collect()]
    dup = n_duplicates(df).first()
    return {
        "n_rows": dup.n_rows, "n_columns": len(df.columns), "dtypes": dict(df.dtypes), "nulls": {r["column"]: r["nulls"] for r in cols if r["nulls"]},
        "null_pct": {r["column"]: r["null_pct"] for r in cols if r["nulls"]}, "duplicate_rows": dup.n_duplicates, "duplicate_pct": dup.duplicate_pct,
        "constant_columns": [r["column"] for r in cols if r["is_constant"]],
    }


def metadata_bands(df: DataFrame) -> DataFrame:
    """How many columns lie in each null band: over 90, 20 to 90, up to 20, none."""
    p = F.col("null_pct")
    band = F.when(p > 90, ">90").when(p > 20, "20-90").when(p > 0, "0-20").otherwise("0")
    return column_metadata(df).groupBy(band.alias("band")).agg(F.count("*").alias("n_columns"))


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, dict]]:
    """Rows, and by column: count, mean, std, min, max, skew (of the population), in chunks of columns."""
    f = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": F.skewness}
    got = wide(df, {"n": F.count("*"), **{f"{k}:{c}": g(quoted(c).cast("double")) for c in columns for k, g in f.items()}})
    return got["n"], {c: {k: got[f"{k}:{c}"] for k in f} for c in columns}


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: count, nulls, n_unique, mean, median, std, min, max."""
    n, m = moments(df, columns)
    unique, mid = distinct_counts(df, columns), quantiles({c: quoted(c) for c in columns}, df, [0.5])
    rows = [(c, x["count"], n - x["count"], unique[c], x["mean"], mid[c][0] if mid[c] else None, x["std"], x["min"], x["max"]) for c, x in m.items()]
    return as_table(df, rows, "column string, count long, nulls long, n_unique long, mean double, median double, std double, min double, max double")


def value_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.where(quoted(column).isNotNull()).groupBy(quoted(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def skew_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: null_pct, n_unique, mean, std, min, max and bias-adjusted skewness."""
    n, m = moments(df, columns)
    unique = distinct_counts(df, columns)
    adjust = lambda x, k: None if x is None or k <= 2 else x * (k * (k - 1)) ** 0.5 / (k - 2)
    rows = [(c, 100.0 * (n - x["count"]) / n if n else 0.0, unique[c], x["mean"], x["std"], x["min"], x["max"], adjust(x["skew"], x["count"])) for c, x in m.items()]
    return as_table(df, rows, "column string, null_pct double, n_unique long, mean double, std double, min double, max double, skew double")


def quartiles(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, tuple[float, float] | None]:
    """First and third quartiles of many columns; ``exact`` off uses sketches."""
    got = quantiles({c: quoted(c) for c in columns}, df, [0.25, 0.75], exact)
    return {c: (v[0], v[1]) if v else None for c, v in got.items()}


def detect_outliers(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """By column: q1, q3, iqr, bounds, outliers and their share of all rows.

    With an IQR of zero the column is zero-inflated: no bounds, and the share is that of the values off the mode.
    """
    fits = quartiles(df, columns)
    flat = [c for c in columns if fits[c] and fits[c][1] - fits[c][0] <= 0]
    modes = {c: (value_counts(df, c, 1).first() or [None, 0])[1] for c in flat}
    rows = []
    for c in columns:
        d = quoted(c).cast("double")
        if fits[c] is None or c in flat:
            low = high = None
            off = (F.count(d) - F.lit(modes.get(c, 0))).cast("long")
        else:
            spread = factor * (fits[c][1] - fits[c][0])
            low, high = fits[c][0] - spread, fits[c][1] + spread
            off = F.count(F.when((d < low) | (d > high), 1))
        num = lambda x: F.lit(x).cast("double")
        q1, q3 = fits[c] or (None, None)
        rows.append(F.struct(F.lit(c).alias("column"), num(q1).alias("q1"), num(q3).alias("q3"), num(None if q1 is None else q3 - q1).alias("iqr"), num(low).alias("low"), num(high).alias("high"), F.lit(c in flat).alias("zero_inflated"), off.alias("n_outliers"), F.coalesce(F.round(100.0 * F.try_divide(off, F.count("*")), 4), F.lit(0.0)).alias("outlier_pct")))
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def scan_outliers(df: DataFrame, most: int = 10, but: Sequence[str] = ()) -> DataFrame:
    return detect_outliers(df, numeric_columns(df, but)[:most])


def label_quality(df: DataFrame, label: str) -> DataFrame:
    """By class (null too): rows, share, and the ratio of the largest class to the smallest."""
    n = df.groupBy(quoted(label).cast("string").alias("class")).agg(F.count("*").alias("n"))
    stats = n.agg(F.sum("n").alias("total"), F.max(F.when(F.col("class").isNotNull(), F.col("n"))).alias("most"), F.min(F.when(F.col("class").isNotNull(), F.col("n"))).alias("least"))
    return n.crossJoin(F.broadcast(stats)).select("class", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(F.col("most") / F.col("least"), 6).alias("imbalance"))


def temporal_profile(df: DataFrame, column: str, now: str, order: str | None = None) -> DataFrame:
    """First and last time, days between, distinct, nulls, rows after ``now``, and (with ``order``) whether time follows it."""
    t = quoted(column)
    out = df.agg(F.min(t).alias("first"), F.max(t).alias("last"), F.datediff(F.max(t), F.min(t)).alias("range_days"), F.countDistinct(t).alias("n_unique"), F.count(F.when(t.isNull(), 1)).alias("nulls"), F.count(F.when(t > F.lit(now).cast("timestamp"), 1)).alias("n_future"))
    return out.crossJoin(is_sorted(df, column, order)) if order else out


def soft_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations with two rows or more: how many, the rows they have, and their share of all rows."""
    g = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    out = g.agg(F.count(F.when(many, 1)).alias("n_keys"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_rows"))
    total = df.agg(F.count("*").alias("total"))
    return out.crossJoin(F.broadcast(total)).withColumn("pct", F.coalesce(F.round(100.0 * F.try_divide(F.col("n_rows"), F.col("total")), 4), F.lit(0.0)))


def top_soft_duplicates(df: DataFrame, keys: Sequence[str], top: int = 5) -> DataFrame:
    g = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return g.orderBy(F.desc("n"), *keys).limit(top)


def rows_per_entity(df: DataFrame, entity: str, most: int = 1) -> DataFrame:
    """Entities with more than ``most`` rows: how many, their share, and a histogram (2, 3-5, 6-10, over 10)."""
    g = df.where(quoted(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("n"))
    n, count = F.col("n"), lambda c: F.count(F.when(c, 1))
    out = g.agg(F.count("*").alias("n_entities"), count(n > most).alias("n_over"), count(n == 2).alias("rows_2"), count(n.between(3, 5)).alias("rows_3_5"), count(n.between(6, 10)).alias("rows_6_10"), count(n > 10).alias("rows_over_10"))
    return out.withColumn("over_pct", F.coalesce(F.round(100.0 * F.try_divide(F.col("n_over"), F.col("n_entities")), 4), F.lit(0.0)))


def key_violations(df: DataFrame, keys: Sequence[str], label: str | None = None) -> DataFrame:
    """Composite key check: violating keys, their rows, most and mean rows a key, and keys with two labels or more."""
    labels = F.countDistinct(quoted(label)) if label else F.lit(0)
    g = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), labels.alias("labels"))
    many = F.col("n") > 1
    return g.agg(F.count("*").alias("n_keys"), F.count(F.when(many, 1)).alias("violations"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("affected_rows"), F.max("n").alias("max_rows"), F.round(F.avg("n"), 6).alias("avg_rows"), F.count(F.when(F.col("labels") > 1, 1)).alias("contaminated"))


def entity_resolution(df: DataFrame, entity: str, identities: Sequence[str]) -> DataFrame:
    """By identity column: null share, values, entities with two values or more, values of two entities or more."""
    outs = []
    for c in identities:
        v = quoted(c)
        have = df.where(v.isNotNull() & quoted(entity).isNotNull()).select(quoted(entity).alias("e"), v.alias("v")).distinct()
        by_e = have.groupBy("e").agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("entities_with_many"))
        by_v = have.groupBy("v").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_values"), F.count(F.when(F.col("n") > 1, 1)).alias("ambiguous_values"))
        null = df.agg(F.coalesce(F.round(100.0 * F.try_divide(F.count(F.when(v.isNull(), 1)), F.count("*")), 4), F.lit(0.0)).alias("null_pct"))
        outs.append(null.crossJoin(by_e).crossJoin(by_v).select(F.lit(c).alias("column"), "*"))
    return reduce(DataFrame.unionByName, outs)


def identity_histogram(df: DataFrame, entity: str, identity: str, most: int = 6) -> DataFrame:
    """How many entities have 1, 2, ... distinct values, up to ``most``."""
    n = df.where(quoted(identity).isNotNull() & quoted(entity).isNotNull()).groupBy(entity).agg(F.countDistinct(quoted(identity)).alias("n_values"))
    return n.groupBy("n_values").agg(F.count("*").alias("n_entities")).orderBy("n_values").limit(most)


def orphans(df: DataFrame, entity: str, identities: Sequence[str]) -> DataFrame:
    """Entities that have a row without any identity."""
    none = reduce(lambda a, b: a & b, [quoted(c).isNull() for c in identities])
    return df.agg(F.countDistinct(F.when(none, quoted(entity))).alias("n_orphans"), F.countDistinct(quoted(entity)).alias("n_entities"))


def column_formats(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.9, few: int = 50) -> DataFrame:
    """By column and issue: numeric_as_string, date_as_string, whitespace, mixed_case, unexpected_negative, with counts."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    money = [c for c in numeric_columns(df) if any(p in c.lower() for p in roles.MONEY_PARTS) and (columns is None or c in columns)]
    dates = "|".join(shape.strip("^$") for _, shape in DATE_FORMATS)
    exprs = [F.lit(None).cast("long").alias("__")]
    for k, c in enumerate(text):
        v = quoted(c)
        number, date = v.rlike(NUMBER) | v.rlike(INFINITE), v.rlike(f"^({dates})$")
        exprs += [F.count(v).alias(f"n{k}"), F.count(F.when(number, 1)).alias(f"num{k}"), F.count(F.when(date & ~number, 1)).alias(f"date{k}"), F.count(F.when(v.rlike(r"(?U)^\s|\s$"), 1)).alias(f"ws{k}"), F.countDistinct(v).alias(f"u{k}"), F.countDistinct(F.lower(v)).alias(f"l{k}")]
    exprs += [F.count(F.when(quoted(c) < 0, 1)).alias(f"neg{k}") for k, c in enumerate(money)]
    one = df.agg(*exprs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(name).alias("issue"), n.alias("n"), ok.alias("ok")) for k, c in enumerate(text) for name, n, ok in (
        ("numeric_as_string", F.col(f"num{k}"), F.col(f"num{k}") > share * F.col(f"n{k}")),
        ("date_as_string", F.col(f"date{k}"), F.col(f"date{k}") > share * F.col(f"n{k}")),
        ("whitespace", F.col(f"ws{k}"), F.col(f"ws{k}") > 0),
        ("mixed_case", F.col(f"u{k}") - F.col(f"l{k}"), (F.col(f"u{k}") < few) & (F.col(f"u{k}") > F.col(f"l{k}"))),
    )]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("unexpected_negative").alias("issue"), F.col(f"neg{k}").alias("n"), (F.col(f"neg{k}") > 0).alias("ok")) for k, c in enumerate(money)]
    if not rows:
        return one.select(F.lit("").alias("column"), F.lit("").alias("issue"), F.lit(0).cast("long").alias("n")).where("false")
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("ok").drop("ok")


def prefilter(df: DataFrame, protected: Sequence[str] = (), null_ratio: float = 0.95, dominant: float = 0.99, most_unique: int = 1000) -> DataFrame:
    """Columns to drop before anything else: (column, reason). Nulls first, then constants, then a dominant value."""
    columns = [c for c in df.columns if c not in set(protected)]
    first = wide(df, {"n": F.count("*"), **{f"{k}:{c}": f(c) for c in columns for k, f in (("n", lambda c: F.count(quoted(c))), ("u", lambda c: F.approx_count_distinct(quoted(c), 0.02)), ("lo", lambda c: F.min(quoted(c).cast("string"))), ("hi", lambda c: F.max(quoted(c).cast("string"))))}})
    n, reasons, look = first["n"] or 1, {}, []
    for c in columns:
        if 1 - first[f"n:{c}"] / n > null_ratio:
            reasons[c] = "null"
        elif first[f"lo:{c}"] == first[f"hi:{c}"]:
            reasons[c] = "constant"
        elif first[f"u:{c}"] <= 1.1 * most_unique:
            look.append(c)
    if look:
        counts = melt(df, look, cast="string").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
        for r in counts.groupBy("feature").agg(F.max("n").alias("top"), F.count("*").alias("u")).collect():
            if r.u <= most_unique and r.top / n > dominant:
                reasons[r.feature] = "dominant"
    spark = df.sparkSession
    return spark.createDataFrame([(c, reasons[c]) for c in columns if c in reasons], "column string, reason string")


def detect_key(df: DataFrame, entity: str) -> str | None:
    """The first column, dates first, that has no nulls and makes (entity, column) unique."""
    rest = [c for c in df.columns if c != entity]
    rest.sort(key=lambda c: not roles.is_date_name(c))
    got = wide(df, {"n": F.count("*"), **{f"k:{c}": F.countDistinct(quoted(entity), quoted(c)) for c in rest}, **{f"n:{c}": F.count(quoted(c)) for c in rest}})
    return next((c for c in rest if got[f"k:{c}"] == got["n"] == got[f"n:{c}"]), None)


def fallback_drops(df: DataFrame, ratio: float = 0.9, protected: Sequence[str] = ()) -> list[str]:
    """Columns whose null share is over ``ratio``."""
    got = wide(df, {"n": F.count("*"), **{f"c:{c}": F.count(quoted(c)) for c in df.columns}})
    return [c for c in df.columns if c not in protected and got["n"] and 1 - got[f"c:{c}"] / got["n"] > ratio]


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: group (numerical, binary, categorical), missing and zero rate, n_unique, min, max."""
    numeric = [c for c in columns if is_numeric(df, c)]
    d = lambda c: quoted(c).cast("double")
    want = {"n": F.count("*"), **{f"c:{c}": F.count(quoted(c)) for c in columns}}
    want |= {f"{k}:{c}": g for c in numeric for k, g in (("z", F.count(F.when(d(c) == 0, 1))), ("lo", F.min(d(c))), ("hi", F.max(d(c))))}
    got, unique = wide(df, want), distinct_counts(df, columns)
    rows = []
    for c in columns:
        have = got[f"c:{c}"]
        group = "categorical" if c not in numeric else "binary" if unique[c] <= 2 else "numerical"
        rows.append((c, group, share(got["n"] - have, got["n"], 6, 1.0), unique[c], share(got[f"z:{c}"], have, 6, 1.0) if c in numeric else 0.0, got.get(f"lo:{c}"), got.get(f"hi:{c}")))
    return as_table(df, rows, "column string, group string, missing_rate double, n_unique long, zero_rate double, min double, max double")


def class_weights(df: DataFrame, label: str, mode: str | float = "auto") -> DataFrame:
    """Weights by class of a binary label: none under a ratio of 3; auto is sqrt from 10 on, else balanced."""
    y = quoted(label).cast("double")
    n = df.agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("neg"))
    ratio = F.try_divide(F.col("neg").cast("double"), F.col("pos").cast("double"))
    sqrt, half = F.sqrt(ratio), ratio / 2
    pick = {"balanced": ratio, "sqrt": sqrt, "half": half, "auto": F.when(ratio >= 10, sqrt).otherwise(ratio)}
    weight = F.lit(float(mode)) if isinstance(mode, int | float) else pick[mode]
    weight = weight if isinstance(mode, int | float) else F.when(F.greatest(ratio, 1 / ratio) >= 3, weight).otherwise(1.0)
    return n.select("pos", "neg", F.round(ratio, 6).alias("ratio"), F.round(weight, 6).alias("pos_weight"))
