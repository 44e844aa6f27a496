"""Population stability, drift reports and schema comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import roles
from tallyforge.functions.scalars import numeric_columns
from tallyforge.operators.binning import every_bin, quantile_edges, right_closed
from tallyforge.operators.profile import quoted, wide

EPS = 1e-8


def psi(train: DataFrame, other: DataFrame, columns: Sequence[str], bins: int = 10, edges: dict[str, list[float]] | None = None, on_error: float = 0.0, exact: bool = True) -> DataFrame:
    """(feature, psi) of many columns: train quantile bins (a, b], shares plus a small constant, one pass over both sides.

    Duplicate edges collapse, so constant and binary columns score 0; a column without train values gets ``on_error``.
    """
    edges = edges or quantile_edges(train, columns, bins, exact)
    use = [c for c in columns if len(edges[c]) > 1]
    spark = train.sparkSession
    rest = spark.createDataFrame([(c, 0.0 if edges[c] else float(on_error)) for c in columns if c not in use], "feature string, psi double")
    if not use:
        return rest
    binned = F.array(*[F.struct(F.lit(c).alias("feature"), right_closed(quoted(c).cast("double"), edges[c][1:-1]).alias("bin")) for c in use])
    both = train.select(F.explode(binned).alias("x"), F.lit(1).alias("e")).unionAll(other.select(F.explode(binned).alias("x"), F.lit(0).alias("e")))
    n = both.select("x.*", "e").where("bin is not null").groupBy("feature", "bin").agg(F.sum("e").alias("e"), F.sum(1 - F.col("e")).alias("a"))
    every = every_bin(train, {c: len(edges[c]) - 1 for c in use})
    full = every.join(n, ["feature", "bin"], "left").fillna(0, ["e", "a"])
    total = full.groupBy("feature").agg(F.sum("e").alias("n_train"), F.sum("a").alias("n_other"))
    full = full.join(F.broadcast(total), "feature")  # a row a column
    share = lambda x, t: F.coalesce(F.try_divide(F.col(x), F.col(t)), F.lit(0.0)) + EPS
    part = (share("a", "n_other") - share("e", "n_train")) * F.log(share("a", "n_other") / share("e", "n_train"))
    out = full.groupBy("feature").agg(F.sum(part).alias("psi"))
    return out.unionByName(rest) if len(use) < len(columns) else out


def drift_report(train: DataFrame, other: DataFrame, skip: Sequence[str] = (), bins: int = 10, warn: float = 0.25, least_rows: int = 100, top: int | None = None) -> DataFrame:
    """(feature, psi, warn) of the numeric columns both sides have, without the skipped and date-named ones.

    Columns with fewer than ``least_rows`` values on a side, or one value, are left out.
    """
    columns = [c for c in numeric_columns(train, skip) if c in other.columns and not roles.has_date_part(c)]
    if not columns:
        return train.sparkSession.createDataFrame([], "feature string, psi double, warn boolean")
    a = wide(train, {k: e for c in columns for k, e in ((f"n:{c}", F.count(quoted(c))), (f"lo:{c}", F.min(quoted(c))), (f"hi:{c}", F.max(quoted(c))))})
    b = wide(other, {c: F.count(quoted(c)) for c in columns})
    use = [c for c in columns if min(a[f"n:{c}"], b[c]) >= least_rows and a[f"lo:{c}"] != a[f"hi:{c}"]]
    if not use:
        return train.sparkSession.createDataFrame([], "feature string, psi double, warn boolean")
    out = psi(train, other, use, bins).select("feature", F.round("psi", 9).alias("psi"), (F.col("psi") > warn).alias("warn"))
    return out.orderBy(F.desc("psi"), "feature").limit(top) if top else out


def psi_filter(train: DataFrame, other: DataFrame, columns: Sequence[str], bins: int = 100, most: float = 0.35) -> DataFrame:
    """(feature, psi, decision): KEEP or DROP for numeric columns, SKIPPED (and kept) for others."""
    numeric = [c for c in columns if c in set(numeric_columns(train))]
    spark = train.sparkSession
    rest = spark.createDataFrame([(c, None, "SKIPPED") for c in columns if c not in numeric], "feature string, psi double, decision string")
    if not numeric:
        return rest
    out = psi(train, other, numeric, bins, on_error=999.0)
    return out.select("feature", F.round("psi", 9).alias("psi"), F.when(F.col("psi") > most, "DROP").otherwise("KEEP").alias("decision")).unionByName(rest)


def kind_of(dtype: str) -> str:
    """numeric, datetime, bool, object or other."""
    if dtype.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) and not dtype.startswith("interval"):
        return "numeric"
    if dtype.startswith(("timestamp", "date")):
        return "datetime"
    return {"boolean": "bool", "string": "object"}.get(dtype, "other")


def compare_schemas(base: DataFrame, other: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Issues between two schemas: (column, issue, severity): missing, extra and type_mismatch; required ones are errors."""
    a, b = dict(base.dtypes), dict(other.dtypes)
    rows = [(c, "missing", "error" if c in required else "warning") for c in a if c not in b]
    rows += [(c, "extra", "warning") for c in b if c not in a]
    rows += [(c, "type_mismatch", "error" if c in required else "warning") for c in a if c in b and kind_of(a[c]) != kind_of(b[c])]
    return base.sparkSession.createDataFrame(rows, "column string, issue string, severity string")


def validate_schemas(parts: dict[str, DataFrame], required: Sequence[str]) -> list[dict]:
    """Compare every part with the first; a missing or mistyped required column raises, the rest are warnings."""
    (name, base), *others = parts.items()
    if lost := [c for c in required if c not in base.columns]:
        raise ValueError(f"{name} lacks required columns {lost}")
    issues = [{"part": k, **r.asDict()} for k, df in others for r in compare_schemas(base, df, required).collect()]
    if hard := [i for i in issues if i["severity"] == "error"]:
        raise ValueError(f"required columns differ: {hard}")
    return issues
