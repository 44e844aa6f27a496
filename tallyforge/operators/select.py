"""Feature scoring and selection: correlation, F tests, collinearity, top-k, stability, pruning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import is_numeric
from tallyforge.operators.binning import compute_iv
from tallyforge.operators.metrics import auc, auc_by_group, auc_se
from tallyforge.operators.ordered import quantiles
from tallyforge.operators.profile import melt, quoted, wide
from tallyforge.operators.split import hash_order

# Thresholds.
HIGH_CORR, LOW_CORR, COLLINEAR, NEAR_COPY = 0.8, 0.04, 0.85, 0.90
GINI_STD, GINI_MEAN, GINI_PERIODS = 0.20, 0.01, 6


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete correlation as an aggregate; 0 where a side is constant."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def target_correlation(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(feature, corr, unreliable, band): high over 0.8, low under 0.04; unreliable over 30% nulls."""
    y = quoted(target).cast("double")
    of = lambda c: F.struct(F.lit(c).alias("feature"), F.round(pearson(quoted(c).cast("double"), y), 4).alias("corr"), (F.count(F.when(quoted(c).isNull(), 1)) > 0.3 * F.count("*")).alias("unreliable"))
    out = df.agg(F.array(*[of(c) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    size = F.abs("corr")
    return out.withColumn("band", F.when(size > HIGH_CORR, "high").when(size < LOW_CORR, "low").otherwise("medium"))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] if q else None for c, q in quantiles({c: quoted(c) for c in columns}, df, [0.5]).items()}


def anova_f(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(feature, f): one-way ANOVA of each column by class; nulls are the column's median."""
    mid = medians(df, columns)
    filled = df.where(quoted(target).isNotNull()).select(quoted(target).cast("string").alias("y"), *[F.coalesce(quoted(c).cast("double"), F.lit(mid[c]).cast("double")).alias(c) for c in columns])
    by = filled.groupBy("y").agg(F.count("*").alias("n"), *[x for k, c in enumerate(columns) for x in (F.sum(quoted(c)).alias(f"s{k}"), F.var_pop(quoted(c)).alias(f"v{k}"))])
    n, g = F.sum("n"), F.count("*")

    def of(k: int, c: str) -> Column:
        within = F.sum(F.col(f"v{k}") * F.col("n"))
        between = F.sum(F.col(f"s{k}") * F.col(f"s{k}") / F.col("n")) - F.sum(f"s{k}") * F.sum(f"s{k}") / n
        return F.struct(F.lit(c).alias("feature"), F.try_divide(between / (g - 1), within / (n - g)).alias("f"))

    return by.agg(F.array(*[of(k, c) for k, c in enumerate(columns)]).alias("x")).select(F.explode("x").alias("x")).select("x.feature", F.round("x.f", 6).alias("f"))


def regression_f(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(feature, f) of a simple regression on each column; nulls are the column's median."""
    mid = medians(df, columns)
    rows = df.where(quoted(target).isNotNull())
    y = quoted(target).cast("double")

    def of(c: str) -> Column:
        r = pearson(F.coalesce(quoted(c).cast("double"), F.lit(mid[c]).cast("double")), y)
        return F.struct(F.lit(c).alias("feature"), (F.try_divide(r * r, 1 - r * r) * (F.count("*") - 2)).alias("f"))

    return rows.agg(F.array(*[of(c) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.feature", F.round("x.f", 6).alias("f"))


def f_scores(df: DataFrame, target: str, columns: Sequence[str], few: int = 10) -> DataFrame:
    """ANOVA for a target of fewer than ``few`` values, else regression F."""
    n = df.select(quoted(target)).where(quoted(target).isNotNull()).distinct().limit(few).count()
    return anova_f(df, target, columns) if n < few else regression_f(df, target, columns)


def gram(rows: DataFrame, columns: Sequence[str], centre: Sequence[float], pairwise: bool) -> DataFrame:
    """(i, sums): by column, its products with all columns summed over all rows, one matrix a task, then added up.

    ``pairwise``: four such vectors (products, own values, own squares, counts) of the rows where both columns have a value.
    """
    import numpy as np
    import pyarrow as pa

    width, mid = len(columns), list(centre)

    def run(batches):
        total = np.zeros((4 if pairwise else 1, width, width))
        for batch in batches:
            x = np.stack([np.asarray(c.fill_null(float("nan")), float) for c in batch.columns], axis=1) - np.array(mid)
            have = ~np.isnan(x)
            x = np.where(have, x, 0.0)
            total[0] += x.T @ x
            if pairwise:
                y = have.astype(float)
                total[1] += x.T @ y
                total[2] += (x * x).T @ y
                total[3] += y.T @ y
        for k in range(width):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[:, k].ravel().tolist()], pa.list_(pa.float64()))], names=["i", "sums"])

    def add(table):
        rows = table.column("sums").to_pylist()
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([np.sum(np.array(rows), axis=0).tolist()], pa.list_(pa.float64()))})

    return rows.mapInArrow(run, "i int, sums array<double>").groupBy("i").applyInArrow(add, "i int, sums array<double>")


def correlations(df: DataFrame, columns: Sequence[str], fill: str = "mean", least: float | None = None) -> DataFrame:
    """(a, b, corr) of all pairs, or of those over ``least``; nulls are the column's mean (or left out pairwise).

    One pass: every task adds up the matrix of products of its rows. Columns without spread correlate 0 with all.
    """
    columns = list(columns)
    schema = "a string, b string, corr double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    centre = [x or 0.0 for x in wide(df, {c: F.avg(quoted(c).cast("double")) for c in columns}).values()]
    pairwise = fill != "mean"
    sums = gram(df.select(*[quoted(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]), columns, centre, pairwise)
    width = len(columns)
    spread = {} if pairwise else {r.i: r.v for r in sums.select("i", F.col("sums")[F.col("i")].alias("v")).collect()}  # a number a column
    mirror = [] if not pairwise else [(r.i, r.s) for r in sums.select("i", F.slice("sums", width + 1, 2 * width).alias("s")).collect()]
    others = {i: (s[:width], s[width:]) for i, s in mirror}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for j in range(i + 1, width):
                    if pairwise:
                        n = v[3 * width + j]
                        xy, x, y, xx, yy = v[j], v[width + j], others[j][0][i], v[2 * width + j], others[j][1][i]
                        top, low = (xy - x * y / n, (xx - x * x / n) * (yy - y * y / n)) if n else (0.0, 0.0)
                    else:
                        top, low = v[j], spread[i] * spread[j]
                    r = round(top / low**0.5, 9) if low > 0 else 0.0
                    if least is None or abs(r) > least:
                        out.append({"a": columns[i], "b": columns[j], "corr": r})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("a", pa.string()), ("b", pa.string()), ("corr", pa.float64())]))

    return sums.mapInArrow(run, schema)


def greedy_prune(scores: dict[str, float], corr: dict[tuple[str, str], float], most: float = COLLINEAR) -> tuple[list[str], list[str]]:
    """(kept, dropped): by falling score, a column goes if it correlates over ``most`` with one kept."""
    size = lambda a, b: abs(corr.get((a, b), corr.get((b, a), 0.0)))
    kept, dropped = [], []
    for c in sorted(scores, key=lambda c: (-scores[c], c)):
        (dropped if any(size(c, k) > most for k in kept) else kept).append(c)
    return kept, dropped


def prune_collinear(df: DataFrame, scores: dict[str, float], most: float = COLLINEAR) -> tuple[list[str], list[str]]:
    corr = {(r.a, r.b): r.corr for r in correlations(df, list(scores), least=most).collect()}  # the pairs over the limit
    return greedy_prune(scores, corr, most)


def suggested_k(n: int) -> int:
    return max(10, min(int(0.7 * n), 800))


def select_top(df: DataFrame, target: str, k: int, criterion: str = "iv", protected: Sequence[str] = ()) -> list[str]:
    """The ``k`` best numeric columns with a positive score; non-numeric ones, the target and protected ones stay."""
    numeric = [c for c in df.columns if is_numeric(df, c) and c != target and c not in protected]
    if criterion == "iv":
        scores = {r.feature: r.iv for r in compute_iv(df, target, numeric).collect()}
    elif criterion == "correlation":
        scores = {r.feature: abs(r["corr"]) for r in target_correlation(df, target, numeric).collect()}
    elif criterion == "f_score":
        scores = {r.feature: r.f or 0.0 for r in f_scores(df, target, numeric).collect()}
    else:
        raise ValueError(f"unknown criterion {criterion}")
    best = sorted((c for c in scores if scores[c] > 0), key=lambda c: (-scores[c], c))[:k]
    stay = set(best) | {c for c in df.columns if not is_numeric(df, c)} | {target, *protected}
    return [c for c in df.columns if c in stay]


def gini(df: DataFrame, feature: str, label: str) -> DataFrame:
    """One row: |2 AUC - 1| of a column as a score, 0 where there is one class."""
    return auc(df, feature, label).select(F.coalesce(F.abs(2 * F.col("auc") - 1), F.lit(0.0)).alias("gini"))


def gini_by_period(df: DataFrame, columns: Sequence[str], label: str, period: Column) -> DataFrame:
    """(feature, period, gini)."""
    rows = df.withColumns({"__p": period, "__y": quoted(label).cast("long")}).where("__y is not null and __p is not null")
    long = melt(rows, columns, keep=["__p", "__y"]).where("value is not null")
    g = auc_by_group(long, ["feature", "__p"], "value", "__y")
    return g.select("feature", F.col("__p").alias("period"), F.coalesce(F.abs(2 * F.col("auc") - 1), F.lit(0.0)).alias("gini"))


def stability(df: DataFrame, columns: Sequence[str], label: str, period: Column, most_std: float = GINI_STD, least_mean: float = GINI_MEAN, least_periods: int = GINI_PERIODS) -> DataFrame:
    """(feature, n_periods, mean, std, decision): unstable or weak columns go; under ``least_periods`` all are kept."""
    g = gini_by_period(df, columns, label, period).groupBy("feature").agg(F.count("*").alias("n_periods"), F.avg("gini").alias("m"), F.stddev_pop("gini").alias("s"))
    verdict = F.when(F.col("n_periods") < least_periods, "SKIPPED").when(F.col("s") > most_std, "DROP_UNSTABLE").when(F.col("m") < least_mean, "DROP_WEAK").otherwise("KEEP")
    return g.select("feature", "n_periods", F.round("m", 9).alias("mean_gini"), F.round("s", 9).alias("std_gini"), verdict.alias("decision"))


def hash_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows for ranking and explanations."""
    return df.orderBy(hash_order(keys, seed), *[quoted(k) for k in keys]).limit(n)


def rank_and_dedupe(importance: dict[str, float], corr: dict[tuple[str, str], float], n: int, most: float = NEAR_COPY) -> list[str]:
    """Columns by importance without near copies; if fewer than ``n`` are left, the best of the copies come back."""
    kept, dropped = greedy_prune(importance, corr, most)
    return (kept + dropped)[: max(n, 0)] if len(kept) < n else kept[:n]


def scaled(values: dict[str, float]) -> dict[str, float]:
    low, high = min(values.values()), max(values.values())
    return {k: (v - low) / (high - low) if high > low else 0.0 for k, v in values.items()}


def smallest_within(curve: Sequence[tuple[int, float]], tolerance: float, se: float = 0.0, k: float = 1.0, cap: int | None = None) -> int:
    """The fewest features whose smoothed score is within max(tolerance, k * se) of the best; ``cap`` bounds it first."""
    half = 1
    smooth = [(n, sum(v for _, v in curve[max(0, i - half) : i + half + 1]) / len(curve[max(0, i - half) : i + half + 1])) for i, (n, _) in enumerate(curve)]
    pool = [x for x in smooth if cap is None or x[0] <= cap] or smooth
    best = max(v for _, v in pool)
    return min(n for n, v in pool if v >= best - max(tolerance, k * se))


def batch_prune(columns: Sequence[str], fit: Callable[[list[str]], tuple[float, dict[str, float]]], psi: dict[str, float], share: float = 0.1, tolerance: float = 0.001, rows: tuple[int, int] | None = None, k_se: float = 1.0, cap: int | None = None, least: int = 1) -> tuple[list[str], list[dict]]:
    """Remove the worst ``share`` each round by half importance, half drift; keep the smallest set that scores as well.

    ``fit`` gives (score, importance by column) of a set. Returns the set and the log of rounds.
    """
    now, log = list(columns), []
    while True:
        score, imp = fit(now)
        log.append({"n": len(now), "score": score, "features": list(now)})
        if len(now) <= least:
            break
        i, p = scaled({c: imp.get(c, 0.0) for c in now}), scaled({c: psi.get(c, 0.0) for c in now})
        worst = sorted(now, key=lambda c: (-(0.5 * (1 - i[c]) + 0.5 * p[c]), c))[: max(1, int(len(now) * share))]
        now = [c for c in now if c not in set(worst)][: max(len(now), least)]
        if len(now) < least:
            break
    best = max(r["score"] for r in log)
    se = auc_se(best, *rows) if rows else 0.0
    n = smallest_within([(r["n"], r["score"]) for r in log], tolerance, se, k_se, cap)
    return next(r["features"] for r in log if r["n"] == n), log


def one_by_one(columns: Sequence[str], fit: Callable[[list[str]], tuple[float, dict[str, float]]], patience: int = 3, floor: int = 10) -> list[str]:
    """Remove the least important column while the score holds; stop after ``patience`` losses or at the floor."""
    now, floor = list(columns), max(5, floor)
    best, imp = fit(now)
    keep, bad = list(now), 0
    while len(now) > floor and bad < patience:
        now = [c for c in now if c != min(now, key=lambda c: (imp.get(c, 0.0), c))]
        score, imp = fit(now)
        if score >= best:
            best, keep, bad = score, list(now), 0
        else:
            bad += 1
    return keep


def eliminate(columns: Sequence[str], fit: Callable[[list[str]], tuple[float, dict[str, float]]], n: int | None = None, step: int = 1) -> list[str]:
    """Recursive elimination to ``n`` columns; without ``n``, to the best scoring size."""
    now, best = list(columns), (float("-inf"), list(columns))
    while True:
        score, imp = fit(now)
        if n is None and score >= best[0]:
            best = (score, list(now))
        if len(now) <= (n or 1):
            return now if n else best[1]
        worst = set(sorted(now, key=lambda c: (imp.get(c, 0.0), c))[: min(step, len(now) - (n or 1))])
        now = [c for c in now if c not in worst]
