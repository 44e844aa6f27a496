"""Temporal and stratified splits: periods, cadence, holdout sizing, hash-ordered samples and folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ordered import grouped_row_numbers
from tallyforge.operators.keys import SPLIT
from tallyforge.operators.profile import quoted

DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def hash_order(keys: Sequence[str], seed: int = 42) -> Column:
    """A fixed pseudo-random order of rows: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(quoted(k).cast("string"), F.lit("")) for k in keys]))


def hash_ranks(df: DataFrame, group: Sequence[str], keys: Sequence[str], seed: int, name: str) -> DataFrame:
    """Ranks from 1 in hash order within each group; windows hold a 4096th of a group."""
    df = df.withColumn("__h", hash_order(keys, seed))
    return grouped_row_numbers(df, group, ["__h", *[quoted(k) for k in keys]], F.substring("__h", 1, 3), name).drop("__h")


def period_of(c: Column, unit: str = "M", anchor: str = "SUN") -> Column:
    """The month, or the last day of the week that ends on ``anchor``."""
    return F.date_trunc("MONTH", c).cast("date") if unit == "M" else F.next_day(F.date_sub(c.cast("date"), 1), anchor)


def modal_weekday(df: DataFrame, column: str) -> str:
    """The most frequent weekday, ties by name."""
    n = df.where(quoted(column).isNotNull()).groupBy(F.upper(F.date_format(quoted(column), "E")).alias("d")).agg(F.count("*").alias("n"))
    first = n.orderBy(F.desc("n"), "d").first()
    return first.d if first else "SUN"


def period_counts(df: DataFrame, column: str, unit: str = "M", anchor: str = "SUN") -> DataFrame:
    return df.where(quoted(column).isNotNull()).groupBy(period_of(quoted(column), unit, anchor).alias("period")).agg(F.count("*").alias("n"))


def cadence(df: DataFrame, column: str, unit: str = "M", anchor: str = "SUN") -> DataFrame:
    """One row: n_dates, n_periods and whether each period has one date (a snapshot) or several."""
    t = quoted(column)
    out = df.agg(F.countDistinct(t).alias("n_dates"), F.countDistinct(period_of(t, unit, anchor)).alias("n_periods"))
    one, many = ("monthly_snapshot", "intra_month") if unit == "M" else ("weekly_snapshot", "weekly")
    return out.withColumn("cadence", F.when(F.col("n_dates") == F.col("n_periods"), one).otherwise(many))


def size_holdout(counts: Sequence[tuple[object, int]], least: float = 0.15, most: float = 0.20, floor: int = 2) -> list:
    """The trailing periods of the holdout, from (period, rows) in order.

    The fewest that reach ``least`` of all rows, at least ``floor`` and one less than all; if they pass ``most`` they
    shrink, down to one.
    """
    total, n = sum(c for _, c in counts), len(counts)
    share = lambda k: sum(c for _, c in counts[n - k :]) / total if total else 0
    k = next((k for k in range(1, n + 1) if share(k) >= least), n)
    k = max(1, min(max(k, floor), n - 1))
    while k > 1 and share(k) > most:
        k -= 1
    return [p for p, _ in counts[n - k :]] if n > 1 else []


def size_valid(counts: Sequence[tuple[object, int]], rows: int) -> list:
    """The fewest trailing periods of the pool that cover ``rows``, leaving one for training where there are two."""
    if len(counts) == 1:
        return [counts[0][0]]
    out, have = [], 0
    for p, c in reversed(counts):
        if have >= rows or len(out) >= len(counts) - 1:
            break
        out.append(p)
        have += c
    return out[::-1]


def stratified_sample(df: DataFrame, ratio: float, label: str | None, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """max(1, int(n * ratio)) rows of each class in hash order; one pool with fewer than two classes."""
    group = quoted(label).cast("string") if label else F.lit("")
    if label and df.select(group.alias("g")).where("g is not null").distinct().limit(2).count() < 2:
        group = F.lit("")
    df = df.withColumn("__g", F.coalesce(group, F.lit("\0")))
    sizes = df.groupBy("__g").agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio))).alias("__k"))
    return hash_ranks(df, ["__g"], keys, seed, "__r").join(sizes, "__g").where("__r <= __k").drop("__g", "__r", "__k")


def stratified_split(df: DataFrame, share: float, label: str | None, keys: Sequence[str], seed: int = 42, names: tuple[str, str] = ("train", "valid")) -> DataFrame:
    """Rows marked in ``_split_``: round(n * share) of each class in hash order are the second part."""
    df = df.withColumn("__g", F.coalesce(quoted(label).cast("string"), F.lit("\0")) if label else F.lit(""))
    sizes = df.groupBy("__g").agg(F.round(F.count("*") * F.lit(share)).alias("__k"))
    out = hash_ranks(df, ["__g"], keys, seed, "__r").join(sizes, "__g")
    return out.withColumn(SPLIT, F.when(F.col("__r") <= F.col("__k"), names[1]).otherwise(names[0])).drop("__g", "__r", "__k")


def k_folds(df: DataFrame, k: int, label: str | None, keys: Sequence[str], seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds 0 to k-1 dealt in hash order within each class."""
    df = df.withColumn("__g", F.coalesce(quoted(label).cast("string"), F.lit("\0")) if label else F.lit(""))
    return hash_ranks(df, ["__g"], keys, seed, name).withColumn(name, F.pmod(name, F.lit(k)).cast("int")).drop("__g")


@dataclass(frozen=True)
class SplitPlan:
    """A temporal split, frozen: every date belongs to a part by its period alone."""

    cadence: str
    period_unit: str
    period_anchor: str
    date_col: str | None
    n_periods_total: int = 0
    n_distinct_dates: int = 0
    first_period: str | None = None
    last_period: str | None = None
    oot_periods: tuple[str, ...] = field(default=())
    valid_temporal_periods: tuple[str, ...] = field(default=())
    train_periods: tuple[str, ...] = field(default=())
    random_share: float = 0.0

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, d: dict) -> SplitPlan:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


def fit_split(df: DataFrame, date_col: str | None, unit: str = "M", anchor: str | None = None, valid_share: float = 0.2, temporal_share: float = 0.2, oot: tuple[float, float, int] = (0.15, 0.20, 2)) -> SplitPlan:
    """One count by period decides the parts; without dates, or with under two periods, the plan is the 60/20/20 fallback."""
    if date_col is None:
        return SplitPlan("none", unit, "", None)
    anchor = anchor or (modal_weekday(df, date_col) if unit != "M" else "SUN")
    counts = [(str(r.period), r.n) for r in period_counts(df, date_col, unit, anchor).orderBy("period").collect()]
    facts = cadence(df, date_col, unit, anchor).first()
    if len(counts) < 2:
        return SplitPlan("none", unit, anchor, None, len(counts), facts.n_dates)
    hold = size_holdout(counts, *oot)
    pool = [c for c in counts if c[0] not in set(hold)]
    n = sum(c for _, c in pool)
    want = round(round(n * valid_share) * temporal_share)
    valid = size_valid(pool, want) if pool else []
    sizes = dict(pool)
    rest = [p for p, _ in pool if p not in set(valid)]
    left = sum(sizes[p] for p in rest)
    share = (round(n * valid_share) - sum(sizes[p] for p in valid)) / left if left else 0.0
    return SplitPlan(facts.cadence, unit, anchor, date_col, len(counts), facts.n_dates, counts[0][0], counts[-1][0], tuple(hold), tuple(valid), tuple(rest), share if 0 < share < 1 else 0.0)


def apply_split(df: DataFrame, plan: SplitPlan, label: str | None, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows marked train, valid_temporal, valid_random or oot (fallback: train, valid, test). Null dates are training rows."""
    if plan.date_col is None:
        first = stratified_split(df, 0.2, label, keys, seed, ("pool", "test"))
        rest = stratified_split(first.where(f"{SPLIT} = 'pool'").drop(SPLIT), 0.25, label, keys, seed + 1)
        return rest.unionByName(first.where(f"{SPLIT} = 'test'"))
    period = period_of(quoted(plan.date_col), plan.period_unit, plan.period_anchor).cast("string")
    tag = F.when(period.isin(*plan.oot_periods), "oot").when(period.isin(*plan.valid_temporal_periods), "valid_temporal").otherwise("train")
    df = df.withColumn(SPLIT, tag)
    if not plan.random_share:
        return df
    group = ["__g", SPLIT]
    df = df.withColumn("__g", F.coalesce(quoted(label).cast("string"), F.lit("\0")) if label else F.lit(""))
    sizes = df.groupBy(*group).agg(F.round(F.count("*") * F.lit(plan.random_share)).alias("__k"))
    out = hash_ranks(df, group, keys, seed, "__r").join(sizes, group)
    return out.withColumn(SPLIT, F.when((F.col(SPLIT) == "train") & (F.col("__r") <= F.col("__k")), "valid_random").otherwise(F.col(SPLIT))).drop("__g", "__r", "__k")


def degenerate(df: DataFrame, label: str, least: int = 10) -> DataFrame:
    """Parts with one class or fewer than ``least`` rows."""
    out = df.groupBy(SPLIT).agg(F.count("*").alias("n_rows"), F.countDistinct(quoted(label)).alias("n_classes"))
    return out.where((F.col("n_rows") < least) | (F.col("n_classes") < 2))


def ensure_valid(df: DataFrame, label: str | None, keys: Sequence[str], share: float = 0.2) -> DataFrame:
    """Marked rows as they are; where no part is a valid one, 80/20 of train is split off."""
    if df.where(F.col(SPLIT).startswith("valid")).head(1):
        return df
    train = stratified_split(df.where(f"{SPLIT} = 'train'").drop(SPLIT), share, label, keys)
    return train.unionByName(df.where(f"{SPLIT} <> 'train'"))
