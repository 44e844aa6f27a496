"""Ranking and calibration metrics from scores grouped first, so that ties count alike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.binning import right_closed
from tallyforge.operators.ordered import quantiles, running_sums
from tallyforge.operators.profile import quoted


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """(s, pos, neg): rows by distinct score."""
    s, y = quoted(score).cast("double"), quoted(label).cast("double")
    return df.where(s.isNotNull() & y.isNotNull()).groupBy(s.alias("s")).agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 1, 0).otherwise(1)).alias("neg"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, auc: the chance that a positive outranks a negative, ties half; null with one class."""
    g = running_sums(by_score(df, score, label), "s", {"n_upto": "neg"})
    total = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("pos") * (F.col("n_upto") - F.col("neg") / 2)).alias("u"))
    return total.select(F.try_divide(F.col("u"), F.col("P") * F.col("N")).alias("auc"))


def auc_by_group(long: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """AUC within each group: a window over the group's distinct scores. Groups are few columns or periods wide."""
    g = long.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    before = W.partitionBy(*group).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    u = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return g.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), u.alias("u")).withColumn("auc", F.try_divide(F.col("u"), F.col("P") * F.col("N"))).drop("u")


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(s, pos, neg, tp, fp, P, N) by falling score."""
    g = running_sums(by_score(df, score, label), "s", {"tp": "pos", "fp": "neg"}, descending=True)
    total = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.crossJoin(F.broadcast(total))  # one row


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    return curve(df, score, label).select(F.col("s").alias("threshold"), F.round(F.col("tp") / F.col("P"), 9).alias("tpr"), F.round(F.col("fp") / F.col("N"), 9).alias("fpr"))


def ks(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the largest gap of cumulative shares and the score at it."""
    gap = F.abs(F.col("tp") / F.col("P") - F.col("fp") / F.col("N"))
    best = curve(df, score, label).select(F.col("s"), F.round(gap, 12).alias("gap")).agg(F.max(F.struct("gap", "s")).alias("x"))
    return best.select(F.round("x.gap", 9).alias("ks"), F.col("x.s").alias("threshold"))


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    return curve(df, score, label).select(F.col("s").alias("threshold"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.col("tp") / F.col("P"), 9).alias("recall"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    part = F.col("pos") / F.col("P") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve(df, score, label).agg(F.round(F.sum(part), 9).alias("average_precision"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    d = quoted(score).cast("double") - quoted(label).cast("double")
    return df.agg(F.round(F.avg(d * d), 9).alias("brier"))


def metrics_by_part(df: DataFrame, part: str, score: str, label: str) -> DataFrame:
    """AUC and Brier score of each part, to four digits."""
    rows = df.select(quoted(part).alias("part"), quoted(score).cast("double").alias("s"), quoted(label).cast("long").alias("y"))
    a = auc_by_group(rows, ["part"], "s", "y").select("part", F.round("auc", 4).alias("auc"))
    b = rows.groupBy("part").agg(F.round(F.avg((F.col("s") - F.col("y")) ** 2), 4).alias("brier"), F.count("*").alias("n"))
    return a.join(b, "part")


def score_edges(df: DataFrame, score: Column, bins: int) -> list[float]:
    got = quantiles({"s": score}, df, [k / bins for k in range(bins + 1)])["s"]
    return sorted(set(got)) if got else []


def deciles(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """By decile of falling score: rows, bads, rate, mean score, lift, and cumulative gain."""
    s, y = quoted(score).cast("double"), quoted(label).cast("double")
    edges = score_edges(df, -s, bins)
    d = right_closed(-s, edges[1:-1]) + 1
    g = df.where(s.isNotNull()).groupBy(d.alias("decile")).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("bads"), F.avg(s).alias("avg_score"))
    whole, upto = W.partitionBy(), W.orderBy("decile").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row a decile
    rate = F.col("bads") / F.col("n")
    base = F.sum("bads").over(whole) / F.sum("n").over(whole)
    return g.select("decile", "n", "bads", F.round("avg_score", 9).alias("avg_score"), F.round(rate, 9).alias("bad_rate"), F.round(F.try_divide(rate, base), 9).alias("lift"), F.round(F.try_divide(F.sum("bads").over(upto), F.sum("bads").over(whole)), 9).alias("gain"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """By quantile bin of the score: mean score, bad rate and rows."""
    s, y = quoted(score).cast("double"), quoted(label).cast("double")
    edges = score_edges(df, s, bins)
    return df.where(s.isNotNull()).groupBy(right_closed(s, edges[1:-1]).alias("bin")).agg(F.round(F.avg(s), 9).alias("mean_score"), F.round(F.avg(y), 9).alias("bad_rate"), F.count("*").alias("n"))


def histogram(df: DataFrame, score: str, bins: int = 50) -> DataFrame:
    """(bin, n) of equal-width bins between the least and the greatest score; the greatest is in the last bin."""
    s = quoted(score).cast("double")
    low, high = df.agg(F.min(s), F.max(s)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    width = (high - low) / bins or 1.0
    return df.where(s.isNotNull()).groupBy(F.least(F.floor((s - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def auc_se(auc: float, pos: int, neg: int) -> float:
    """Hanley and McNeil's standard error."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return math.sqrt(max(auc * (1 - auc) + (pos - 1) * (q1 - auc * auc) + (neg - 1) * (q2 - auc * auc), 0) / (pos * neg)) if pos and neg else 0.0


def auc_se_column(a: Column, pos: Column, neg: Column) -> Column:
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return F.sqrt((a * (1 - a) + (pos - 1) * (q1 - a * a) + (neg - 1) * (q2 - a * a)) / (pos * neg))


def smoothed(df: DataFrame, step: str, value: str, window: int = 3) -> DataFrame:
    """A centred moving average that shrinks at the ends. Steps are pruning rounds: few."""
    half = window // 2
    return df.withColumn("smooth", F.avg(value).over(W.orderBy(step).rowsBetween(-half, half)))
