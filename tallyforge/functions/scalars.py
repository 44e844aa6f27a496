"""Scalar building blocks: coercing casts, whitespace, null forms, IEEE division."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a lenient numeric parser accepts.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
#: Date formats tried in order, with the shape each one needs.
DATE_FORMATS = (
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$"), ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"), ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("yyyyMMdd", r"^\d{8}$"),
)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def numeric_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    skip = set(but)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def to_number(c: Column) -> Column:
    """Text as a double; what a lenient parser would refuse is null."""
    text = c.cast("string")
    sign = F.when(F.ltrim(text).startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double")).when(text.rlike(INFINITE), sign * F.lit(float("inf")))


def date_format_of(samples: Iterable[str | None]) -> str | None:
    """The first format whose shape the first non-null sample has."""
    import re

    first = next((x for x in samples if x), None)
    return next((f for f, shape in DATE_FORMATS if first and re.match(shape, first)), None)


def to_timestamp(c: Column, fmt: str | None = None) -> Column:
    """Text as a timestamp by one format, or by the first of all that fits; else null."""
    text = c.cast("string")
    tries = [fmt] if fmt else [f for f, _ in DATE_FORMATS]
    shapes = dict(DATE_FORMATS)
    one = lambda f: F.when(text.rlike(shapes[f]), F.try_to_timestamp(text, F.lit(f))) if f in shapes else F.try_to_timestamp(text, F.lit(f))
    return F.coalesce(*[one(f) for f in tries])


def strip_space(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def finite(c: Column) -> Column:
    """Null where the value is NaN or infinite."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names}) if names else df


def ieee_divide(a: Column, b: Column) -> Column:
    """Floating division where x/0 is signed infinity and 0/0 is NaN, with nulls kept."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def clip(c: Column, low: float | Column | None, high: float | Column | None) -> Column:
    """``c`` within bounds; nulls stay null."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = c
    if low is not None:
        out = F.when(out < col(low), col(low)).otherwise(out)
    if high is not None:
        out = F.when(out > col(high), col(high)).otherwise(out)
    return F.when(c.isNotNull(), out)
