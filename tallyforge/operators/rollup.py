"""Hierarchical roll-ups: child rows to parent features, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.profile import quoted
from tallyforge.functions.scalars import is_numeric


def aggregate(df: DataFrame, key: str, prefix: str, drop: Sequence[str] = ()) -> DataFrame:
    """By key: mean, sum, max, min, std and count of numeric columns, nunique of the rest; {prefix}_{column}_{fn}."""
    exprs = []
    for c in df.columns:
        if c == key or c in drop:
            continue
        v = quoted(c)
        if is_numeric(df, c):
            d = v.cast("double")
            exprs += [f.alias(f"{prefix}_{c}_{n}") for n, f in (("mean", F.avg(d)), ("sum", F.sum(d)), ("max", F.max(d)), ("min", F.min(d)), ("std", F.stddev_samp(d)), ("count", F.count(d)))]
        else:
            exprs.append(F.countDistinct(v).alias(f"{prefix}_{c}_nunique"))
    return df.groupBy(key).agg(*exprs)


def roll_up(parent: DataFrame, key: str, children: Sequence[tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Parent rows with each child's aggregates joined on: children are (rows, prefix, columns to leave out)."""
    out = parent
    for rows, prefix, drop in children:
        out = out.join(aggregate(rows, key, prefix, drop), key, "left")
    return out


def two_levels(parent: DataFrame, key: str, child: DataFrame, child_key: str, grandchild: DataFrame, prefixes: tuple[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Grandchildren to children on ``child_key``, children to parents on ``key``."""
    inner = child.join(aggregate(grandchild, child_key, prefixes[1], drop), child_key, "left").drop(child_key)
    return parent.join(aggregate(inner, key, prefixes[0], drop), key, "left")
