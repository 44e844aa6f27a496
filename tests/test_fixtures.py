"""Golden values: null policy, scale guard, encoders, replay order, expressions, PSI edges, splits, metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import roles
from tallyforge.functions import expr, scalars
from tallyforge.operators import binning, clean, drift, encode, keys, metrics, nulls, ordered, profile, select, split, train
from tallyforge.plans import spec
from tallyforge.sources import readers


def col(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def frame(spark, schema, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + schema)


@pytest.fixture
def b1(spark):
    inf = math.inf
    return frame(spark, "income double, txn_count_3m double, ratio double, segment string, has_card double", [(10.0, 3.0, 0.1, "a", 1.0), (20.0, None, inf, None, 0.0), (None, 5.0, 0.3, "b", None), (30.0, 0.0, None, "a", 1.0), (40.0, 2.0, 0.5, "b", 0.0)])


RULES = {
    "income": nulls.Rule("median", True), "txn_count_3m": nulls.Rule("zero"), "ratio": nulls.Rule("median", True),
    "segment": nulls.Rule("explicit_category", group="categorical"), "has_card": nulls.Rule("missing_indicator_only", True, group="binary"),
}


def test_null_policy(spark, b1):
    p = nulls.fit_nulls(b1, RULES)
    assert p.fills["income"] == 25.0
    assert p.stats["ratio"]["missing_rate"] == 0.4 and p.stats["txn_count_3m"]["zero_rate"] == pytest.approx(0.25)
    assert col(p.apply(b1), "ratio_missing") == [0, 1, 0, 1, 0]
    batch = frame(spark, "income double, txn_count_3m double, ratio double, segment string, has_card double", [(None, None, 0.1, None, None), (1000.0, 1.0, 0.1, "zz", 1.0)])
    out = p.apply(batch)
    assert col(out, "income") == [25.0, 1000.0] and col(out, "income_missing") == [1, 0]
    assert col(out, "txn_count_3m") == [0.0, 1.0] and col(out, "segment") == ["__MISSING__", "zz"]
    assert col(out, "has_card") == [None, 1.0] and col(out, "has_card_missing") == [1, 0]
    d = p.to_dict()
    assert nulls.NullPolicy.from_dict(d) == nulls.NullPolicy.from_dict(p.to_dict())
    d["features"]["income"]["imputation_value"] = 26.0
    with pytest.raises(ValueError, match="changed"):
        nulls.NullPolicy.from_dict(d)
    with pytest.raises(ValueError, match="missing"):
        p.apply(batch.drop("income"))


def test_scale_guard(spark):
    base = spark.range(500).select((F.exp(10 + 0.6 * F.randn(1))).alias("amt"), F.floor(F.rand(2) * 7).cast("double").alias("cnt")).cache()
    verdict = lambda f, df=base: {r.column: r.verdict for r in nulls.scale_guard(base, df.withColumn("amt", F.col("amt") * f), ["amt", "cnt"]).collect()}
    for f, want in ((1.0, "pass"), (1.4, "pass"), (5.0, "warn"), (0.05, "fail"), (0.001, "fail"), (1000.0, "fail")):
        assert verdict(f) == {"amt": want, "cnt": "pass"}
    assert verdict(1000.0, base.limit(20))["amt"] == "not_judged"


def test_null_guardrails():
    facts = [dict(column="bal", group="numerical", missing_rate=0.25, min=-5.0, zero_rate=0.0), dict(column="cnt", group="numerical", missing_rate=0.25, min=0.0, zero_rate=0.33), dict(column="gone", group="numerical", missing_rate=1.0, min=None, zero_rate=0.0)]
    got = nulls.guard_rules({c: nulls.Rule("zero") for c in ("bal", "cnt", "gone")}, facts)
    assert (got["bal"].strategy, got["bal"].indicator) == ("median", True)
    assert got["cnt"].strategy == "zero" and got["gone"].strategy == "none"
    rules, notes = nulls.valid_suggestions(nulls.read_suggestions('junk {"column": "a", "strategy": "median"} and {"column": "b", "strategy": "nope"} {broken'), {"a": "numerical", "b": "numerical"})
    assert list(rules) == ["a"] and len(notes) == 1
    with pytest.raises(ValueError, match="families"):
        nulls.resolve_rules({"a": "numerical"}, {}, {"x": (["a"], RULES["income"]), "y": (["a"], RULES["income"])})


def test_onehot_is_batch_independent(spark):
    levels = encode.fit_onehot(frame(spark, "c string", [("A",), ("B",), ("C",)]), ["c"])
    for batch, want in (("ABC", [[0, 0], [1, 0], [0, 1]]), ("BCB", [[1, 0], [0, 1], [1, 0]]), ("B", [[1, 0]])):
        out = encode.apply_onehot(frame(spark, "c string", [(x,) for x in batch]), levels)
        assert [[r.c_B, r.c_C] for r in out.orderBy("i").collect()] == want


def test_replay_order_and_fallback(spark):
    df = frame(spark, "seg string, amt double", [("A", 10.0), ("B", 10.0), ("C", 10.0)])
    s = spec.FeatureSpec(("label:seg", "interaction:x"), (spec.Interaction("x", "df['seg'] * df['amt']", 0.0),), encode.fit_labels(df, ["seg"]))
    assert col(s.apply(df)[0], "x") == [0.0, 10.0, 20.0]
    s = spec.FeatureSpec(("interaction:r",), (spec.Interaction("r", "df['a'] / (df['b'] + 1)", 0.5),))
    out, notes = s.apply(frame(spark, "a double", [(1.0,), (2.0,)]))
    assert col(out, "r") == [0.5, 0.5] and notes
    with pytest.raises(KeyError):
        s.apply(frame(spark, "a double", [(1.0,)]), strict=True)
    assert col(s.apply(frame(spark, "a double, b double", [(1.0, 1.0)]))[0], "r") == [0.5]


def test_unseen_guard(spark):
    enc = encode.fit_labels(frame(spark, "c string", [("A",), ("B",)]), ["c"])
    batch = frame(spark, "c string", [(x,) for x in "WXYZ"])
    assert len(set(col(encode.apply_labels(batch, enc), "c"))) == 1
    assert encode.unseen_rates(batch, enc).first().unseen_rate == 1.0
    s = spec.FeatureSpec(("label:c",), (), enc)
    with pytest.raises(ValueError, match="unseen"):
        s.apply(batch, strict=True, max_unseen=0.5)


GOOD = ["df['a'] / (df['b'] + 1)", "np.log1p(df['a'])", "np.where(df['a'] > 1, df['a'], 0)", "df[['a', 'b']].mean(axis=1)", "df['a'].fillna(df['a'].median())", "(df['a'] > 1).astype(int)", "df['a'].clip(lower=0, upper=10)", "df['a'] ** 2", "np.select([df['a'] > 1], [1], default=0)"]
BAD = ["__import__('os')", "df.a", "open('x')", "df['a'].__class__", "np.load('x')", "np.fromfile('x')", "df['a'].to_csv('x')", "df['a'].apply(len)", "lambda: 1", "[x for x in df]", "'a' * 1000", "df['a'] ** df['b']", "2 ** 100", "1e300 * df['a']", "eval('1')", "df.eval('a')", "a + 1", "df['a'].groupby(df['b'])", "x := 1", "df['a']" + " + 1" * 200]


@pytest.mark.parametrize("text", GOOD)
def test_good_expressions(spark, text):
    df = frame(spark, "a double, b double", [(1.0, 1.0), (4.0, 3.0)])
    expr.interaction(df, expr.fit_expression(df, text))


@pytest.mark.parametrize("text", BAD)
def test_bad_expressions(text):
    with pytest.raises(expr.Unsafe):
        expr.validate(text)


def test_expression_values(spark):
    df = frame(spark, "a double, b double", [(1.0, 1.0), (4.0, 3.0), (None, 2.0), (-7.0, 3.0), (5.0, 0.0)])
    value = lambda t: col(df.withColumn("v", expr.fit_expression(df, t).column(df)), "v")
    assert value("df['a'] / (df['b'] + 1)")[:2] == [0.5, 1.0]
    assert value("df['a'] % df['b']")[3] == 2.0 and value("df['a'] // df['b']")[3] == -3.0
    assert value("df['a'] / df['b']")[4] == math.inf
    assert value("df['a'].fillna(0)")[2] == 0.0 and value("df['a'].isna()")[2] is True
    assert value("df[['a', 'b']].mean(axis=1)") == [1.0, 3.5, 2.0, -2.0, 2.5]
    assert value("df['a'] > 0")[2] is False and value("~(df['a'] > 0)")[2] is True
    frozen = expr.fit_expression(df, "df['a'] - df['a'].max()")
    assert col(frame(spark, "a double", [(9.0,)]).transform(lambda x: x.withColumn("v", frozen.column(x))), "v") == [4.0]


def test_numbers_and_dates(spark):
    got = col(frame(spark, "s string", [(x,) for x in (" 1 ", "inf", "-INF", "1e3", "1d", "1,000", "0x10", "", None, ".5", "1.")]).withColumn("v", scalars.to_number(F.col("s"))), "v")
    assert got == [1.0, math.inf, -math.inf, 1000.0, None, None, None, None, None, 0.5, 1.0]
    assert scalars.date_format_of([None, "2024-01-31"]) == "yyyy-MM-dd"
    days = col(frame(spark, "s string", [("2024-01-31",), ("2024-13-01",), ("x",)]).withColumn("v", scalars.to_timestamp(F.col("s"))), "v")
    assert [d is None for d in days] == [False, True, True]


def test_clip_refuses_zero_inflated(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 12 == 0, F.exp(F.randn(1))).otherwise(0.0).alias("x"))
    assert clean.fit_clip(df, ["x"]) == {}
    r = profile.detect_outliers(df, ["x"]).first()
    assert r.zero_inflated and r.low is None and r.n_outliers == 84


def test_psi_edges(spark):
    one = lambda xs: frame(spark, "x double", [(float(x),) for x in xs])
    psi = lambda a, b: drift.psi(one(a), one(b), ["x"]).first().psi
    assert psi([1] * 20, [1] * 20) == 0.0 and psi([1] * 20, [2] * 20) == 0.0
    assert psi([0] * 15 + [1] * 5, [0] * 5 + [1] * 15) == 0.0
    assert psi([0] * 50 + [1] * 30 + [2] * 20, [0] * 20 + [1] * 30 + [2] * 50) == pytest.approx(0.5497744211244938)
    assert psi(range(100), []) > 10
    assert [drift.kind_of(x) for x in ("int", "timestamp_ntz", "boolean", "string", "array<int>", "interval day")] == ["numeric", "datetime", "bool", "object", "other", "other"]


def test_bin_sides(spark):
    df = frame(spark, "x double", [(1.0,), (2.0,), (3.0,), (None,)])
    assert col(df.withColumn("b", binning.left_closed(F.col("x"), [2.0], 2)), "b") == [0, 1, 1, 2]
    assert col(df.withColumn("b", binning.right_closed(F.col("x"), [2.0])), "b") == [0, 0, 1, None]


def test_holdout_sizing():
    months = [(k, 100) for k in range(10)]
    assert split.size_holdout(months) == [8, 9]
    assert split.size_holdout([(0, 10), (1, 90)]) == [1]
    assert split.size_holdout([(0, 70), (1, 15), (2, 15)]) == [2]
    assert split.size_valid(months[:8], 150) == [6, 7] and split.size_valid(months[:1], 5) == [0] and split.size_valid(months[:2], 500) == [1]


def test_split_assignment(spark):
    df = frame(spark, "k string, x int", [("a", 1), (None, 2), ("a", 3), (None, 4)])
    marked = keys.with_occurrence(df, ["k"], ["i"]).withColumn(keys.SPLIT, F.lit("train"))
    got, missing = keys.join_assignment(keys.with_occurrence(df, ["k"], ["i"]), marked.where("x < 4").select("k", keys.OCCURRENCE, keys.SPLIT), ["k", keys.OCCURRENCE])
    assert got.count() == 3 and missing == 1
    with pytest.raises(ValueError, match="fan out"):
        keys.join_assignment(df, marked.select("k", keys.SPLIT), ["k"])
    assert [r.x for r in keys.dedup_by_key(df, ["k", "absent"], ["i"], "last").orderBy("i").collect()] == [3, 4]


def test_scalar_rules():
    assert [train.adopt(*x) for x in ((0.7764, 0.7721), (0.77, 0.7703), (0.77, None), (None, 0.7))] == [True, False, True, False]
    se = metrics.auc_se(0.77, 5000, 55000)
    assert 0.002 < se < 0.006 and metrics.auc_se(0.77, 300, 3700) > 2 * se
    assert select.greedy_prune({"a": 3, "b": 2, "c": 1}, {("a", "b"): 0.9, ("b", "c"): 0.99}) == (["a", "c"], ["b"])
    assert select.smallest_within([(40, 0.80), (30, 0.80), (20, 0.799), (10, 0.6)], 0.005) in (20, 30)
    assert select.suggested_k(5) == 10 and select.suggested_k(5000) == 800
    assert roles.find_target(["x", "Label"]) == "Label" and roles.is_date_name("snap_dt") and not roles.is_date_name("candidate")


def test_ordered(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 37).alias("v"), F.lit(1).alias("one"))
    got = ordered.running_sums(rows, "v", {"upto": "one"}, buckets=5).groupBy("v").agg(F.max("upto").alias("u"), F.min("upto").alias("l")).orderBy("v").collect()
    want, n = [], 0
    for v in range(37):
        n += len(range(v, 1000, 37))
        want.append(n)
    assert [r.u for r in got] == want == [r.l for r in got]
    assert sorted(r.row_number for r in ordered.row_numbers(rows, ["id"], "v", buckets=7).collect()) == list(range(1, 1001))
    assert ordered.is_sorted(rows, "id", "id").first()[0] and not ordered.is_sorted(rows, "v", "id").first()[0]


def test_quantiles_by_bucket(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.when(F.col("id") % 2 == 0, F.exp(F.randn(4))).alias("c"), F.lit(None).cast("double").alias("d"))
    values, probs = {c: F.col(c) for c in "abcd"}, [0, 0.01, 0.25, 0.5, 0.777, 1]
    one = {c: df.agg(F.percentile(F.when(~F.isnan(v.cast("double")), v.cast("double")), F.array(*[F.lit(float(p)) for p in probs]))).first()[0] for c, v in values.items()}
    many = ordered.quantiles(values, df, probs, buckets=9)
    assert many["d"] is None and one["d"] is None
    for c in "abc":
        assert many[c] == pytest.approx(one[c], rel=1e-12)


def test_pruning_loops():
    worth = {f"f{k}": 1.0 / (k + 1) for k in range(20)}
    fit = lambda cols: (sum(worth[c] for c in cols[:5]) and min(0.8, sum(worth[c] for c in cols)), worth)
    kept, log = select.batch_prune(list(worth), fit, {}, least=2)
    assert set(kept) <= set(worth) and len(log) > 3
    assert select.eliminate(list(worth), fit, 3) == ["f0", "f1", "f2"]
    assert len(select.one_by_one(list(worth), fit, floor=10)) >= 10


def test_roles():
    got = roles.resolve(["sk_id_curr", "year_built", "amt_credit", "fraud"])
    assert (got.target, got.entity, got.date) == ("fraud", "sk_id_curr", None)
    assert roles.find_target(["x", "TARGET"], "target") == "TARGET" and roles.find_target(["x", "churn", "y"], "nope") == "y" and roles.find_target(["x"], "nope") is None
    assert [roles.is_entity_name(c) for c in ("customer_id", "sk_id_curr", "id_number", "id_card", "rapid", "hidden_x", "id")] == [True, True, False, False, False, False, True]
    assert [roles.is_date_name(c) for c in ("as_of", "REPORT_DATE", "app_dt", "amt_dti", "days_birth", "months_balance", "month", "year_built")] == [True, True, True, False, False, False, True, False]
    assert roles.find_entity(["a_id", "MA_KH", "user_id"]) == "MA_KH" and roles.find_entity(["x", "loan_id"], "x") == "x" and roles.find_entity(["x"]) is None
    both = roles.resolve(["cif", "so_dt", "device_id", "cccd", "label", "snap_dt"])
    assert (both.entity, both.identities, both.date) == ("cif", ("so_dt", "device_id", "cccd"), "snap_dt")
    assert roles.leaks_by_name(["next_month", "amount", "is_ahead", "future_x"]) == ["next_month", "is_ahead", "future_x"]


def test_the_whole_file_decides_the_encoding(tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n" + b"1,2\n" * 400_000 + "é,3\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(b"x,y\n" + b"1,2\n" * 300_000 + "é,3\n".encode())
    assert [readers.encoding_of(str(tmp_path / f"{k}.csv"), size=1000) for k in "ab"] == ["cp1252", "utf-8"]


def test_correlations_equal_pairwise_aggregates(spark):
    r = random.Random(3)
    rows = [tuple(None if r.random() < 0.2 else r.gauss(0, 1) + 5 * k for k in range(3)) + (7.0, None) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, none double").repartition(5)
    for fill in ("mean", "pairwise"):
        got = {(x.a, x.b): x["corr"] for x in select.correlations(df, df.columns, fill).collect()}
        assert len(got) == 10 and all(v == 0 for k, v in got.items() if set(k) & {"flat", "none"})
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            x, y = np.array([[v if v is not None else np.nan for v in (row["abc".index(a)], row["abc".index(b)])] for row in rows]).T
            if fill == "mean":
                x, y = np.where(np.isnan(x), np.nanmean(x), x), np.where(np.isnan(y), np.nanmean(y), y)
            ok = ~np.isnan(x) & ~np.isnan(y)
            assert got[a, b] == pytest.approx(np.corrcoef(x[ok], y[ok])[0, 1], abs=1e-8)
    assert select.correlations(df.select("a"), ["a"]).count() == 0


def test_ranks_in_groups_and_levels(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = ordered.grouped_row_numbers(df, ["g"], ["h"], F.substring("h", 1, 1), "n").collect()
    for g in "012":
        own = sorted((x for x in got if x.g == g), key=lambda x: x.h)
        assert [x.n for x in own] == list(range(1, len(own) + 1))
    with pytest.raises(ValueError, match="h .about"):
        encode.levels_of(df, ["g", "h"], most=100)
    assert profile.distinct_counts(spark.createDataFrame([(0.0, "a"), (-0.0, None), (None, "b")], "x double, y string"), ["x", "y"]) == {"x": 1, "y": 2}
