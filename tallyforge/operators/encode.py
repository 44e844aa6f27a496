"""Label and one-hot encoding, fitted once and replayed batch-independently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.scalars import NUMERIC, is_numeric
from tallyforge.operators.profile import melt, quoted, wide

MISSING = "__NA__"
#: Level maps up to this size are literals in the plan; longer ones are joined.
LITERAL = 2000
#: A column of more levels has no place in a frozen spec.
MOST_LEVELS = 100_000


def token(c: Column, dtype: T.DataType) -> Column:
    """The text of a value, the same from every reader; null is ``__NA__``."""
    text = c.cast("string")
    if isinstance(dtype, T.BooleanType):
        text = F.initcap(text)
    elif isinstance(dtype, T.FloatType | T.DoubleType):
        text = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.concat(c.cast("long").cast("string"), F.lit(".0"))).otherwise(text)
    return F.coalesce(text, F.lit(MISSING))


def levels_of(df: DataFrame, columns: Sequence[str], most: int = MOST_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct tokens by column. Levels belong to a frozen spec, so they fit on the driver: columns that a sketch
    puts over ``most`` levels are refused before any is collected."""
    tokens = df.select(*[token(quoted(c), df.schema[c].dataType).alias(c) for c in columns])
    if columns:
        about = wide(tokens, {c: F.approx_count_distinct(quoted(c), 0.02) for c in columns})
        if wrong := [f"{c} (about {n})" for c, n in about.items() if n > 1.1 * most]:
            raise ValueError(f"more than {most} levels: {', '.join(wrong)}; bin, hash or drop them first")
    rows = melt(tokens, columns, cast="string").distinct().collect() if columns else []
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r.feature].append(r.value)
    return {c: sorted(v) for c, v in out.items()}


def fit_labels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted tokens with ``__NA__``; a token's code is its place."""
    return {c: sorted({*v, MISSING}) for c, v in levels_of(df, columns).items()}


def codes(df: DataFrame, name: str, tokens: Sequence[str]) -> Column:
    table = F.create_map(*[x for k, t in enumerate(tokens) for x in (F.lit(t), F.lit(k))])
    t = token(quoted(name), df.schema[name].dataType)
    return F.coalesce(F.try_element_at(table, t), F.lit(list(tokens).index(MISSING)))


def apply_labels(df: DataFrame, encoders: dict[str, Sequence[str]]) -> DataFrame:
    """Codes in place; unseen tokens get the code of ``__NA__``."""
    short = {c: t for c, t in encoders.items() if len(t) <= LITERAL and c in df.columns}
    out = df.withColumns({c: codes(df, c, t) for c, t in short.items()}) if short else df
    for c, t in encoders.items():
        if c in df.columns and c not in short:
            table = df.sparkSession.createDataFrame([(x, k) for k, x in enumerate(t)], "__t string, __c int")
            out = out.withColumn("__t", token(quoted(c), df.schema[c].dataType)).join(table, "__t", "left").withColumn(c, F.coalesce("__c", F.lit(list(t).index(MISSING)))).drop("__t", "__c")
    return out


def unseen_rates(df: DataFrame, encoders: dict[str, Sequence[str]]) -> DataFrame:
    """(column, unseen_rate): the share of rows whose token the encoder has not seen. Tokens are counted, then joined."""
    cols = [c for c in encoders if c in df.columns]
    tokens = df.select(*[token(quoted(c), df.schema[c].dataType).alias(c) for c in cols])
    counts = melt(tokens, cols, cast="string").groupBy("feature", "value").agg(F.count("*").alias("n"))
    known = df.sparkSession.createDataFrame([(c, v, True) for c in cols for v in encoders[c]], "feature string, value string, known boolean")
    rate = F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n")
    got = counts.join(known, ["feature", "value"], "left").groupBy("feature").agg(rate.alias("r"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return every.join(got, every["column"] == got["feature"], "left").select("column", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("unseen_rate"))


def fit_onehot(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted categories without the first and without nulls: one indicator each."""
    return {c: [x for x in v if x != MISSING][1:] for c, v in levels_of(df, columns).items()}


def apply_onehot(df: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """{column}_{value} indicators instead of the columns; nulls and unseen values are all zeros."""
    out = {f"{c}_{v}": (token(quoted(c), df.schema[c].dataType) == v).cast("int") for c, vs in levels.items() if c in df.columns for v in vs}
    return df.withColumns(out).drop(*levels) if out else df.drop(*levels)


def fit_all(df: DataFrame, protected: Sequence[str] = (), method: str = "label", most: int = 5) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(label encoders, one-hot levels) of every non-numeric column; one-hot only up to ``most`` categories."""
    columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC) and f.name not in protected]
    if not columns:
        return {}, {}
    levels = levels_of(df, columns)
    hot = {c: [x for x in v if x != MISSING][1:] for c, v in levels.items() if method == "onehot" and len([x for x in v if x != MISSING]) <= most}
    return {c: sorted({*v, MISSING}) for c, v in levels.items() if c not in hot}, hot


def fill_for_model(df: DataFrame, columns: Sequence[str], value: float = -999.0) -> DataFrame:
    """Doubles with nulls and NaN as ``value``."""
    d = lambda c: quoted(c).cast("double")
    return df.withColumns({c: F.when(d(c).isNull() | F.isnan(d(c)), F.lit(value)).otherwise(d(c)) for c in columns if is_numeric(df, c)})
