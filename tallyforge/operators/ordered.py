"""Order over a whole table without a window in one task.

A table is cut into buckets of its order column at approximate quantiles. Windows run inside the buckets; what lies before
a bucket is a sum over the few bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Accuracy of the sketches that only place the buckets.
SKETCH = 1000


def bucket_of(df: DataFrame, order: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each value; equal values have one bucket, nulls the first."""
    edges = df.select(order.cast("double").alias("o")).agg(F.percentile_approx("o", [k / buckets for k in range(1, buckets)], 2000)).first()[0] or []
    cuts = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    return F.size(F.filter(cuts, lambda e: e < order.cast("double")))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with, for each name: column of ``sums``, the sum over all rows up to and with the row's order value."""
    sign = -1 if descending else 1
    key = (F.col(order).cast("double") * sign).alias("__o")
    df = df.withColumn("__o", key)
    df = df.withColumn("__b", bucket_of(df, F.col("__o"), buckets))
    totals = df.groupBy("__b").agg(*[F.sum(c).alias(f"__t{k}") for k, c in enumerate(sums.values())])
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__b", *[F.coalesce(F.sum(f"__t{k}").over(before), F.lit(0)).alias(f"__p{k}") for k in range(len(sums))])
    inside = W.partitionBy("__b").orderBy("__o").rangeBetween(W.unboundedPreceding, W.currentRow)
    out = df.join(F.broadcast(totals), "__b")  # one row a bucket
    out = out.withColumns({n: F.sum(c).over(inside) + F.col(f"__p{k}") for k, (n, c) in enumerate(sums.items())})
    return out.drop("__b", "__o", *[f"__p{k}" for k in range(len(sums))])


def row_numbers(df: DataFrame, order: list[Column | str], lead: str, name: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """A global row number from 1 by ``lead`` (numeric or time) and then ``order``."""
    df = df.withColumn("__l", F.col(lead).cast("timestamp").cast("double") if dict(df.dtypes)[lead].startswith(("timestamp", "date")) else F.col(lead).cast("double"))
    df = df.withColumn("__b", bucket_of(df, F.col("__l"), buckets))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__p"))
    inside = W.partitionBy("__b").orderBy("__l", *order)
    out = df.join(F.broadcast(totals), "__b").withColumn(name, F.row_number().over(inside) + F.col("__p"))
    return out.drop("__b", "__l", "__p")


def is_sorted(df: DataFrame, column: str, order: str, buckets: int = BUCKETS) -> DataFrame:
    """One row, is_sorted: whether ``column`` never falls along ``order``."""
    rows = df.select(F.col(column).alias("v"), F.col(order).alias("o"))
    rows = rows.withColumn("b", bucket_of(rows, F.col("o"), buckets))
    inside = W.partitionBy("b").orderBy("o", "v")
    flag = rows.withColumn("ok", F.coalesce(F.col("v") >= F.lag("v").over(inside), F.lit(True)))
    each = flag.groupBy("b").agg(F.bool_and("ok").alias("ok"), F.min("v").alias("low"), F.max("v").alias("high"))
    joint = each.withColumn("joint", F.coalesce(F.col("low") >= F.max("high").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(True)))
    return joint.agg(F.coalesce(F.bool_and(F.col("ok") & F.col("joint")), F.lit(True)).alias("is_sorted"))


def bin_tree(value: Column, inner: Sequence[float], closed: str) -> Column:
    """How many sorted inner edges are at most (``left``) or under (``right``) the value: a generated binary search."""
    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        e = F.lit(float(inner[mid]))
        return F.when(value >= e if closed == "left" else value > e, search(mid + 1, b)).otherwise(search(a, mid))

    return search(0, len(inner))


def grouped_row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], prefix: Column, name: str) -> DataFrame:
    """A row number from 1 within each group, without a window over a whole group.

    ``prefix`` is a coarse value that never falls along ``order``: a window numbers the rows of a group and prefix, and the
    rows of the prefixes before it come from counts, one a group and prefix. Group columns have no nulls.
    """
    df = df.withColumn("__b", prefix)
    part = [*group, "__b"]
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*part).agg(F.count("*").alias("__n")).select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__p"))
    out = df.join(counts, part).withColumn(name, F.row_number().over(W.partitionBy(*part).orderBy(*order)) + F.col("__p"))
    return out.drop("__b", "__p")


def order_prefix(df: DataFrame, lead: Column) -> Column:
    """A coarse value along ``lead``: buckets of numbers and times, the first two characters of all else; nulls come first."""
    kind = df.select(lead.alias("x")).schema["x"].dataType
    if isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        number = lead.cast("timestamp").cast("double") if not isinstance(kind, T.NumericType) else lead.cast("double")
        return F.coalesce(bucket_of(df, number), F.lit(0))
    return F.coalesce(F.substring(lead.cast("string"), 1, 2), F.lit(""))


def quantiles(values: dict[str, Column], df: DataFrame, probs: Sequence[float], exact: bool = True, buckets: int = BUCKETS) -> dict[str, list[float] | None]:
    """Quantiles (linear interpolation) of many expressions; None where there are no values. Sketches if not ``exact``.

    Sketches give edges close around the wanted places (or even ones, where many are wanted). Rows are counted by the buckets
    between them, then values are counted in the buckets that hold a wanted rank: no task holds all values of a column,
    and the driver gets counts by bucket and the wanted values.
    """
    out: dict[str, list[float] | None] = {}
    names = list(values)
    for k in range(0, len(names), 50):  # generated code has its limits
        some = {c: f"q{j}" for j, c in enumerate(names[k : k + 50])}
        once = df.select(*[values[c].cast("double").alias(q) for c, q in some.items()])  # each expression is computed once
        once = once.select(*[F.when(~F.isnan(q), F.col(q)).alias(q) for q in some.values()])
        out |= some_quantiles({c: F.col(q) for c, q in some.items()}, once, probs, exact, buckets)
    return out


def some_quantiles(d: dict[str, Column], df: DataFrame, probs: Sequence[float], exact: bool, buckets: int) -> dict[str, list[float] | None]:
    near = 2.0 / SKETCH
    if not exact:
        at = list(probs)
    elif 2 * len(probs) < buckets:
        at = sorted({min(max(p + e, 0.0), 1.0) for p in probs for e in (-near, near)})
    else:
        at = [k / buckets for k in range(1, buckets)]
    rough = df.agg(*[F.percentile_approx(v, at, 10_000 if not exact else SKETCH).alias(f"x{k}") for k, v in enumerate(d.values())]).first()
    if not exact:
        return dict(zip(d, rough, strict=True))
    names = list(d)
    edges = [sorted(set(r)) if r else [] for r in rough]
    few = all(len(e) <= 8 for e in edges)
    counts: dict[int, list[tuple[int, int]]] = {k: [] for k in range(len(names))}
    if few:  # how many values lie under each edge, in one aggregate
        under = [[F.count(F.when(d[c] < e, 1)) for e in edges[k]] + [F.count(d[c])] for k, c in enumerate(names)]
        got = df.agg(*[x.alias(f"x{k}_{j}") for k, xs in enumerate(under) for j, x in enumerate(xs)]).first().asDict()
        for k in range(len(names)):
            upto = [0, *[got[f"x{k}_{j}"] for j in range(len(edges[k]) + 1)]]
            counts[k] = [(j, y - x) for j, (x, y) in enumerate(zip(upto[:-1], upto[1:], strict=True)) if y > x]
    else:
        cells = [F.struct(F.lit(k).alias("f"), d[c].alias("v"), bin_tree(d[c], edges[k], "left").alias("b")) for k, c in enumerate(names)]
        long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("v is not null")
        for r in long.groupBy("f", "b").agg(F.count("*").alias("n")).collect():  # a row a bucket
            counts[r.f].append((r.b, r.n))
    wanted: dict[tuple[int, int], set[int]] = {}
    ranks: dict[str, list[tuple[int, int, float]]] = {}
    place: dict[tuple[int, int], tuple[int, int]] = {}
    for k, c in enumerate(names):
        total = sum(n for _, n in counts[k])
        ranks[c] = [(int((total - 1) * p), min(int((total - 1) * p) + 1, total - 1), (total - 1) * p - int((total - 1) * p)) for p in probs] if total else []
        start = 0
        need = sorted({x for lo, hi, _ in ranks[c] for x in (lo, hi)})
        for b, n in sorted(counts[k]):
            for x in need:
                if start <= x < start + n:
                    place[(k, x)] = (b, x - start)
                    wanted.setdefault((k, b), set()).add(x - start)
            start += n
    if not wanted:
        return dict.fromkeys(names)
    if few:
        inside = lambda v, e, b: (F.lit(True) if b == 0 else v >= e[b - 1]) & (F.lit(True) if b == len(e) else v < e[b])
        cells = [F.when(inside(d[names[f]], edges[f], b) & d[names[f]].isNotNull(), F.struct(F.lit(f).alias("f"), F.lit(b).alias("b"), d[names[f]].alias("v"))) for f, b in wanted]
        long = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
    asked = df.sparkSession.createDataFrame([(f, b, sorted(o)) for (f, b), o in wanted.items()], "f int, b int, off array<long>")
    asked = F.broadcast(asked)  # a row a bucket that holds a wanted rank
    each = long.join(asked, ["f", "b"], "left_semi").groupBy("f", "b", "v").agg(F.count("*").alias("n")).join(asked, ["f", "b"])
    upto = F.sum("n").over(W.partitionBy("f", "b").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    hit = each.withColumn("upto", upto).withColumn("off", F.filter("off", lambda o: (o < F.col("upto")) & (o >= F.col("upto") - F.col("n")))).where(F.size("off") > 0)
    found = {(r.f, r.b, o): r.v for r in hit.select("f", "b", "v", "off").collect() for o in r.off}
    value = lambda k, x: found[(k, *place[(k, x)])]
    mix = lambda a, b, w: a if w == 0 or a == b else a + (b - a) * w
    return {c: [mix(value(k, lo), value(k, hi), w) for lo, hi, w in ranks[c]] if ranks[c] else None for k, c in enumerate(names)}
