"""Keys, joins that may not fan out, dedup, row operations, unions and split assignments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.ordered import grouped_row_numbers, order_prefix
from tallyforge.operators.profile import quoted

OCCURRENCE, SPLIT, POSITION, ROW = "_key_occ_", "_split_", "_split_pos_", "_replay_row_idx_"


def with_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = OCCURRENCE) -> DataFrame:
    """The rank of each row among those with its key (null keys are keys), from 0, in a stated order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def left_join(parent: DataFrame, child: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parent.join(child, list(keys), "left")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_assignment(raw: DataFrame, assignment: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Raw rows with their split, nulls matching nulls; and how many rows had none (they are left out).

    The assignment must be unique by key: the join may not make rows.
    """
    twice = assignment.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if twice.head(1):
        raise ValueError(f"the split assignment repeats keys of {list(keys)}: the join would fan out")
    marked = assignment.withColumn("__hit", F.lit(True))
    both = raw.join(marked, null_safe(raw, marked, keys), "left")
    for k in keys:
        both = both.drop(marked[k])
    missing = both.where(F.col("__hit").isNull()).count()
    return both.where("__hit").drop("__hit"), missing


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: str = "first") -> DataFrame:
    """The first or last row of each key in a stated order. Absent keys are ignored; none left is an error."""
    have = [k for k in keys if k in df.columns]
    if not have:
        raise ValueError(f"none of {list(keys)} is a column")
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    w = W.partitionBy(*have).orderBy(*[c.asc() if keep == "first" else c.desc() for c in cols])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def union_marked(parts: dict[str, DataFrame], name: str = SPLIT) -> DataFrame:
    """All partitions under one another, each row marked with its own."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def column_sets(left: Sequence[str], right: Sequence[str]) -> dict[str, list[str]]:
    return {"missing": [c for c in left if c not in set(right)], "extra": [c for c in right if c not in set(left)], "common": [c for c in left if c in set(right)]}


def split_key(keys: Sequence[str] | None, entity: str | None) -> list[str]:
    """What identifies a row for a replay: the composite key, else the entity, else its position."""
    return list(keys) if keys else [entity] if entity else [ROW]


def freeze_assignment(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keys, occurrence, split and position in the split: what a replay needs to find each row again."""
    out = with_occurrence(df, keys, order)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    out = grouped_row_numbers(out, [SPLIT], cols, order_prefix(out, cols[0]), POSITION).withColumn(POSITION, F.col(POSITION) - 1)
    return out.select(*keys, OCCURRENCE, SPLIT, POSITION)


def restore_order(df: DataFrame) -> DataFrame:
    return df.orderBy(POSITION)


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *tie).limit(k)


def members_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(quoted(column).isin(*values))
