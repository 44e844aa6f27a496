"""Bins, weight of evidence, information value and its stability under frozen bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import numeric_columns
from tallyforge.operators.ordered import bin_tree, quantiles
from tallyforge.operators.profile import melt, quoted, wide

#: Information value bands, the leak threshold and the smallest usable value.
BANDS = ((0.02, "useless"), (0.1, "weak"), (0.3, "medium"), (0.5, "strong"))
LEAK, USABLE = 0.5, 0.02


def left_closed(value: Column, inner: Sequence[float], nan_bin: int | None = None) -> Column:
    """The bin [a, b) of a value: how many inner edges are at most the value. Nulls: ``nan_bin``."""
    return F.when(value.isNotNull() & ~F.isnan(value), bin_tree(value, inner, "left")).otherwise(F.lit(nan_bin))


def right_closed(value: Column, inner: Sequence[float]) -> Column:
    """The bin (a, b] of a value: how many inner edges are under the value. Nulls stay null."""
    return F.when(value.isNotNull(), bin_tree(value, inner, "right"))


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int, exact: bool = True) -> dict[str, list[float]]:
    """Distinct quantile edges of many columns in a few jobs (empty for an all-null column)."""
    got = quantiles({c: quoted(c) for c in columns}, df, [k / bins for k in range(bins + 1)], exact)
    return {c: sorted(set(v)) if v else [] for c, v in got.items()}


def iv_edges(df: DataFrame, columns: Sequence[str], bins: int = 10, method: str = "quantile") -> dict[str, list[float]]:
    """Inner edges by column: midpoints of the values where there are ``bins`` or fewer, else quantiles or a grid."""
    facts = wide(df, {k: e for c in columns for k, e in ((f"u:{c}", F.approx_count_distinct(quoted(c))), (f"lo:{c}", F.min(quoted(c).cast("double"))), (f"hi:{c}", F.max(quoted(c).cast("double"))))})
    few = [c for c in columns if facts[f"u:{c}"] <= 2 * bins]
    values: dict[str, list[float]] = {}
    if few:
        rows = melt(df, few).where("value is not null and not isnan(value)").distinct().collect()  # about 2 * bins a column
        for r in rows:
            values.setdefault(r.feature, []).append(r.value)
    edges = quantile_edges(df, [c for c in columns if len(values.get(c, ())) > bins or c not in values], bins) if method == "quantile" else {}
    out = {}
    for c in columns:
        v = sorted(values.get(c, ()))
        if v and len(v) <= bins:
            out[c] = [(a + b) / 2 for a, b in zip(v, v[1:])]
        elif method == "quantile":
            out[c] = edges[c][1:-1]
        else:
            lo, hi = facts[f"lo:{c}"], facts[f"hi:{c}"]
            out[c] = [lo + (hi - lo) * k / bins for k in range(1, bins)] if lo is not None else []
    return out


def every_bin(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(feature, bin) for 0 to size-1 of each feature, from literals."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(n).alias("n")) for c, n in sizes.items()])
    return df.sparkSession.range(1).select(F.explode(pairs).alias("x")).select("x.feature", F.explode(F.sequence(F.lit(0), F.col("x.n") - 1)).alias("bin"))


def bin_counts(df: DataFrame, edges: dict[str, Sequence[float]], label: str) -> DataFrame:
    """(feature, bin, pos, neg) for every bin of every column, the last one for nulls; bins without rows count zero."""
    columns = list(edges)
    y = quoted(label).cast("double")
    binned = F.array(*[F.struct(F.lit(c).alias("feature"), left_closed(quoted(c).cast("double"), edges[c], len(edges[c]) + 1).alias("bin")) for c in columns])
    rows = df.where(y.isNotNull()).select(F.explode(binned).alias("x"), y.alias("y")).select("x.*", "y")
    seen = rows.groupBy("feature", "bin").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg"))
    every = every_bin(df, {c: len(edges[c]) + 2 for c in columns})
    zero = F.lit(0).cast("long")
    return every.join(seen, ["feature", "bin"], "left").select("feature", "bin", F.coalesce("pos", zero).alias("pos"), F.coalesce("neg", zero).alias("neg"))


def woe_table(counts: DataFrame) -> DataFrame:
    """(feature, bin, pos, neg, woe, iv) with half a row of smoothing a bin; zeros where the label has one class."""
    total = counts.groupBy("feature").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count("*").alias("B"))
    t = counts.join(F.broadcast(total), "feature")  # a row a column
    p = (F.col("pos") + 0.5) / (F.col("P") + 0.5 * F.col("B"))
    n = (F.col("neg") + 0.5) / (F.col("N") + 0.5 * F.col("B"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    woe = F.when(both, F.log(n / p)).otherwise(0.0)
    return t.select("feature", "bin", "pos", "neg", woe.alias("woe"), F.when(both, (n - p) * F.log(n / p)).otherwise(0.0).alias("iv"))


def band_of(iv: Column) -> Column:
    out = F.lit("suspicious")
    for limit, name in reversed(BANDS):
        out = F.when(iv < limit, name).otherwise(out)
    return out


def compute_iv(df: DataFrame, label: str, columns: Sequence[str] | None = None, bins: int = 10, top: int | None = None, max_null: float = 0.5, method: str = "quantile") -> DataFrame:
    """(feature, iv, band, leak): zero for constants, for columns over ``max_null`` nulls, and without two classes."""
    columns = list(columns or numeric_columns(df, [label]))
    nulls = wide(df, {"": F.count("*"), **{c: F.count(quoted(c)) for c in columns}})
    use = [c for c in columns if nulls[""] and 1 - nulls[c] / nulls[""] <= max_null]
    edges = {c: e for c, e in iv_edges(df, use, bins, method).items() if e} if use else {}
    spark = df.sparkSession
    zeros = spark.createDataFrame([(c, 0.0) for c in columns if c not in edges], "feature string, iv double")
    out = zeros
    if edges:
        out = woe_table(bin_counts(df, edges, label)).groupBy("feature").agg(F.sum("iv").alias("iv")).unionByName(zeros)
    out = out.select("feature", F.round("iv", 6).alias("iv"), band_of(F.col("iv")).alias("band"), (F.col("iv") >= LEAK).alias("leak"))
    return out.orderBy(F.desc("iv"), "feature").limit(top) if top else out


@dataclass(frozen=True)
class WoeMap:
    """A column's frozen bins: inner edges, a weight a bin (the last for nulls) and the information value."""

    edges: tuple[float, ...]
    woe: tuple[float, ...]
    iv: float

    def apply(self, c: Column) -> Column:
        table = F.array(*[F.lit(float(w)) for w in self.woe])
        return F.element_at(table, left_closed(c.cast("double"), self.edges, len(self.edges) + 1) + 1)


def fit_woe(df: DataFrame, label: str, columns: Sequence[str], bins: int = 10, min_iv: float = USABLE) -> dict[str, WoeMap]:
    """Maps of the columns whose information value is ``min_iv`` or more."""
    edges = {c: e for c, e in iv_edges(df, columns, bins).items() if e}
    if not edges:
        return {}
    rows: dict[str, list] = {}
    for r in woe_table(bin_counts(df, edges, label)).collect():  # a row a bin
        rows.setdefault(r.feature, []).append(r)
    out = {}
    for c in columns:
        got = sorted(rows.get(c, ()), key=lambda r: r.bin)
        iv = sum(r.iv for r in got)
        if got and iv >= min_iv:
            out[c] = WoeMap(tuple(edges[c]), tuple(r.woe for r in got), iv)
    return out


def apply_woe(df: DataFrame, maps: dict[str, WoeMap]) -> DataFrame:
    return df.withColumns({c: m.apply(quoted(c)) for c, m in maps.items()}) if maps else df


def iv_stability(train: DataFrame, hold: DataFrame, label: str, columns: Sequence[str], bins: int = 10, drop: float = 0.3, least_corr: float = 0.5, least_rows: int = 30, edges: dict[str, list[float]] | None = None) -> DataFrame:
    """By usable column, under the train bins: both values, the relative fall, woe correlation, sign flips, unstable."""
    edges = edges or {c: e for c, e in iv_edges(train, columns, bins).items() if e}
    a, b = (woe_table(bin_counts(x, edges, label)) for x in (train, hold))
    a = a.select("feature", "bin", F.col("woe").alias("w1"), F.col("iv").alias("i1"), (F.col("pos") + F.col("neg")).alias("n1"))
    b = b.select("feature", "bin", F.col("woe").alias("w2"), F.col("iv").alias("i2"), (F.col("pos") + F.col("neg")).alias("n2"))
    j = a.join(b, ["feature", "bin"])
    ok = (F.col("n1") >= least_rows) & (F.col("n2") >= least_rows)
    x, y = F.when(ok, F.col("w1")), F.when(ok, F.col("w2"))
    n = F.count(x)
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    var = (F.avg(x * x) - F.avg(x) ** 2) * (F.avg(y * y) - F.avg(y) ** 2)
    corr = F.when((n >= 2) & (var > 1e-18), cov / F.sqrt(var))
    out = j.groupBy("feature").agg(F.sum("i1").alias("iv_train"), F.sum("i2").alias("iv_hold"), corr.alias("woe_corr"), F.count(F.when(ok & (F.col("w1") * F.col("w2") < 0), 1)).alias("sign_flips"))
    out = out.where(F.col("iv_train") >= USABLE).withColumn("iv_drop", (F.col("iv_train") - F.col("iv_hold")) / F.col("iv_train"))
    bad = (F.col("iv_drop") > drop) | (F.col("iv_hold") < USABLE) | F.coalesce(F.col("woe_corr") < least_corr, F.lit(False))
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("iv_train", "iv_hold", "iv_drop", "woe_corr")], "sign_flips", bad.alias("unstable"))
