"""Cleaning: a frozen spec of drops, type fixes, clip bounds and row operations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.scalars import clip, date_format_of, is_numeric, strip_space, to_number, to_timestamp
from tallyforge.operators.keys import dedup_by_key
from tallyforge.operators.profile import quartiles, quoted
from tallyforge.operators.split import stratified_sample


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.drop(name)


def fix_expr(df: DataFrame, name: str, kind: str, fmt: str | None = None):
    """One type fix as an expression; text fixes leave other types alone."""
    c = quoted(name)
    text = isinstance(df.schema[name].dataType, T.StringType)
    if kind == "to_numeric":
        return c.cast("double") if is_numeric(df, name) else to_number(c)
    if kind == "to_datetime":
        return to_timestamp(c, fmt) if text else c
    if kind == "strip_whitespace":
        return strip_space(c) if text else c
    if kind == "standardize_case":
        return F.lower(c) if text else c
    raise ValueError(f"unknown fix {kind}")


def fit_clip(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> dict[str, list[float]]:
    """Bounds of the columns with an IQR over zero; the others are refused."""
    out = {}
    for c, q in quartiles(df, columns).items():
        if q and q[1] - q[0] > 0:
            out[c] = [q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0])]
    return out


@dataclass(frozen=True)
class CleaningSpec:
    drops: tuple[str, ...] = ()
    dtype_fixes: tuple[tuple[str, str, str | None], ...] = ()
    clip_bounds: dict[str, list[float]] = field(default_factory=dict)
    row_ops: tuple[dict, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        """Drops, then type fixes, then clips, each as one projection; no job runs."""
        df = df.drop(*self.drops)
        for name, kind, fmt in self.dtype_fixes:
            if name in df.columns:
                df = df.withColumn(name, fix_expr(df, name, kind, fmt))
        bounds = {c: clip(quoted(c), *b) for c, b in self.clip_bounds.items() if c in df.columns and is_numeric(df, c)}
        return df.withColumns(bounds) if bounds else df

    def apply_rows(self, df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
        """Training rows only: the row operations in recorded order, and warnings for unknown ones."""
        warnings = []
        for op in self.row_ops:
            kind = op.get("op")
            if kind == "stratified_sample":
                df = stratified_sample(df, op["ratio"], op.get("label"), order, op.get("seed", 42))
            elif kind == "drop_duplicates":
                df = df.dropDuplicates()
            elif kind == "deduplicate_by_key":
                df = dedup_by_key(df, op["keys"], order, op.get("keep", "first"))
            else:
                warnings.append(f"unknown row operation {kind}")
        return df, warnings

    def to_dict(self) -> dict:
        return {"drops": list(self.drops), "dtype_fixes": [list(x) for x in self.dtype_fixes], "clip_bounds": self.clip_bounds, "row_ops": list(self.row_ops)}

    @classmethod
    def from_dict(cls, d: dict) -> CleaningSpec:
        return cls(tuple(d["drops"]), tuple((x[0], x[1], x[2] if len(x) > 2 else None) for x in d["dtype_fixes"]), dict(d["clip_bounds"]), tuple(d["row_ops"]))


def date_fix(df: DataFrame, name: str) -> tuple[str, str, str | None]:
    """A to_datetime fix whose format follows the first value."""
    first = df.where(quoted(name).isNotNull()).select(quoted(name).cast("string")).first()
    return (name, "to_datetime", date_format_of([first[0]]) if first else None)
