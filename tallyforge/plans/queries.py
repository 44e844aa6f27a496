"""One query for each operator over the driver's tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import expr, scalars
from tallyforge.operators import binning, clean, drift, encode, keys, metrics, nulls, profile, rollup, select, split
from tallyforge.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


# ---- profiling

ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(union([f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_unique, 0.0::DOUBLE AS null_pct, count(DISTINCT {c}) <= 1 AS is_constant FROM orders" for c in ORDERS]))
def profile_metadata(spark, d):
    return profile.column_metadata(t(spark, d, "orders"), ORDERS)


def sparse_lineitem(spark, d):
    zero = lambda c: F.when(F.col(c) != 0, F.col(c))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", zero("l_discount").alias("l_discount"), zero("l_tax").alias("l_tax"), "l_returnflag", "l_shipdate")


SPARSE = "(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag, l_shipdate FROM lineitem)"
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(union([f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_unique, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM {SPARSE}" for c in MEASURES]))
def profile_numeric_stats(spark, d):
    out = profile.numeric_stats(sparse_lineitem(spark, d), MEASURES)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_counts_top(spark, d):
    return profile.value_counts(t(spark, d, "part"), "p_brand")


@query(union([f"SELECT '{c}' AS \"column\", round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_pct, count(DISTINCT {c}) AS n_unique, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(skewness({c}), 5) AS skew FROM {SPARSE}" for c in MEASURES]))
def skewness_stats(spark, d):
    out = profile.skew_stats(sparse_lineitem(spark, d), MEASURES)
    return out.withColumns({c: F.round(c, 6) for c in ("null_pct", "mean", "std")}).withColumn("skew", F.round("skew", 5))


OUTLIERS = """
SELECT '{c}' AS "column", round(q[1], 6) AS q1, round(q[2], 6) AS q3, round(q[2] - q[1], 6) AS iqr, round(q[1] - 3 * (q[2] - q[1]), 6) AS low, round(q[2] + 3 * (q[2] - q[1]), 6) AS high, false AS zero_inflated,
       count(*) FILTER ({c} < q[1] - 3 * (q[2] - q[1]) OR {c} > q[2] + 3 * (q[2] - q[1])) AS n_outliers,
       round(100.0 * count(*) FILTER ({c} < q[1] - 3 * (q[2] - q[1]) OR {c} > q[2] + 3 * (q[2] - q[1])) / count(*), 4) AS outlier_pct
FROM {t}, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM {t}) GROUP BY q"""
ZERO_INFLATED = """
UNION ALL SELECT 'rare', 0.0, 0.0, 0.0, NULL, NULL, true, count(*) FILTER (value > 200), round(100.0 * count(*) FILTER (value > 200) / count(*), 4) FROM events"""


@query(OUTLIERS.format(c="value", t="events") + ZERO_INFLATED)
def outlier_iqr(spark, d):
    rows = t(spark, d, "events").withColumn("rare", F.when(F.col("value") > 200, F.col("value")).otherwise(0.0))
    out = profile.detect_outliers(rows, ["value", "rare"])
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "q3", "iqr", "low", "high")})


@query("""
SELECT event_id, round(greatest(least(value, q[2] + 3 * (q[2] - q[1])), q[1] - 3 * (q[2] - q[1])), 6) AS value
FROM events, (SELECT quantile_cont(value, [0.25, 0.75]) AS q FROM events)""")
def clip_iqr(spark, d):
    rows = t(spark, d, "events").select("event_id", "value")
    return clean.CleaningSpec(clip_bounds=clean.fit_clip(rows, ["value"])).apply(rows).withColumn("value", F.round("value", 6))


@query("""
SELECT quality::VARCHAR AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(max(count(*)) OVER () / min(count(*)) OVER (), 6) AS imbalance
FROM labels GROUP BY quality""")
def label_quality(spark, d):
    return profile.label_quality(t(spark, d, "labels"), "quality")


@query("""
SELECT pos, neg, round(neg / pos, 6) AS ratio, round(CASE WHEN greatest(neg / pos, pos / neg) < 3 THEN 1.0 WHEN neg / pos >= 10 THEN sqrt(neg / pos) ELSE neg / pos END, 6) AS pos_weight
FROM (SELECT count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM labels)""")
def class_weights(spark, d):
    return profile.class_weights(t(spark, d, "labels"), "toxic")


@query("""
SELECT min(ts) AS first, max(ts) AS last, date_diff('day', min(ts), max(ts)) AS range_days, count(DISTINCT ts) AS n_unique, count(*) FILTER (ts IS NULL) AS nulls,
       count(*) FILTER (ts > TIMESTAMP '2024-01-20 00:00:00') AS n_future, (SELECT bool_and(ts >= b) FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL) AS is_sorted
FROM events""")
def temporal_profile(spark, d):
    return profile.temporal_profile(t(spark, d, "events"), "ts", "2024-01-20 00:00:00", "event_id").withColumn("range_days", F.col("range_days").cast("long"))


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_duplicates, round(100.0 * (count(*) - count(DISTINCT text)) / count(*), 4) AS duplicate_pct FROM documents")
def exact_dups(spark, d):
    return profile.n_duplicates(t(spark, d, "documents").select("text"))


KEYS = ["l_orderkey", "l_linenumber"]


@query("""
SELECT count(*) FILTER (n > 1) AS n_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_rows, sum(n)::BIGINT AS total, round(100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 4) AS pct
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def soft_dups(spark, d):
    return profile.soft_duplicates(t(spark, d, "lineitem").select(*KEYS), KEYS)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, 1, 2 LIMIT 5")
def soft_dups_top(spark, d):
    return profile.top_soft_duplicates(t(spark, d, "lineitem"), KEYS)


@query("""
SELECT count(*) AS n_entities, count(*) FILTER (n > 5) AS n_over, count(*) FILTER (n = 2) AS rows_2, count(*) FILTER (n BETWEEN 3 AND 5) AS rows_3_5, count(*) FILTER (n BETWEEN 6 AND 10) AS rows_6_10, count(*) FILTER (n > 10) AS rows_over_10,
       round(100.0 * count(*) FILTER (n > 5) / count(*), 4) AS over_pct
FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""")
def entity_dup_histogram(spark, d):
    return profile.rows_per_entity(t(spark, d, "orders"), "o_custkey", 5)


@query("""
SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS violations, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS affected_rows, max(n) AS max_rows, round(avg(n), 6) AS avg_rows, count(*) FILTER (u > 1) AS contaminated
FROM (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS u FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def key_violations_label_contamination(spark, d):
    return profile.key_violations(t(spark, d, "lineitem"), KEYS, "l_returnflag")


def identity_events(spark, d):
    return t(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))


IDENTITY = "(SELECT user_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events)"


@query(union([f"""SELECT '{c}' AS "column", (SELECT round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) FROM {IDENTITY}) AS null_pct,
  (SELECT count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT {c}) AS n FROM {IDENTITY} WHERE {c} IS NOT NULL GROUP BY user_id)) AS entities_with_many,
  (SELECT count(DISTINCT {c}) FROM {IDENTITY}) AS n_values, (SELECT count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT user_id) AS n FROM {IDENTITY} WHERE {c} IS NOT NULL GROUP BY {c})) AS ambiguous_values""" for c in ("k", "kind")]))
def entity_resolution(spark, d):
    return profile.entity_resolution(identity_events(spark, d), "user_id", ["k", "kind"])


@query(f"SELECT n_values, count(*) AS n_entities FROM (SELECT count(DISTINCT kind) AS n_values FROM {IDENTITY} WHERE kind IS NOT NULL GROUP BY user_id) GROUP BY 1 ORDER BY 1 LIMIT 6")
def identity_histogram(spark, d):
    return profile.identity_histogram(identity_events(spark, d), "user_id", "kind")


@query(f"SELECT count(DISTINCT user_id) FILTER (kind IS NULL) AS n_orphans, count(DISTINCT user_id) AS n_entities FROM {IDENTITY}")
def orphans(spark, d):
    return profile.orphans(identity_events(spark, d), "user_id", ["kind"])


@query("""
WITH p AS (SELECT p_size::VARCHAR AS size_text, ' ' || p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END AS kind, p_retailprice - 1000 AS price FROM part), o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT 'size_text' AS "column", 'numeric_as_string' AS issue, count(*) AS n FROM p UNION ALL SELECT 'brand', 'whitespace', count(*) FROM p
UNION ALL SELECT 'kind', 'mixed_case', count(DISTINCT kind) - count(DISTINCT lower(kind)) FROM p HAVING count(DISTINCT kind) < 50 AND count(DISTINCT kind) > count(DISTINCT lower(kind))
UNION ALL SELECT 'price', 'unexpected_negative', count(*) FROM p WHERE price < 0 HAVING count(*) > 0
UNION ALL SELECT 'day', 'date_as_string', count(*) FROM o""")
def format_scan(spark, d):
    p = t(spark, d, "part").select(F.col("p_size").cast("string").alias("size_text"), F.concat(F.lit(" "), "p_brand").alias("brand"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("kind"), (F.col("p_retailprice") - 1000).alias("price"))
    o = t(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return profile.column_formats(p).unionByName(profile.column_formats(o))


FLAWED = "(SELECT l_quantity, CASE WHEN l_orderkey % 50 = 0 THEN 1 END AS mostly_null, 7.0 AS fixed, CASE WHEN l_orderkey % 200 = 0 THEN l_quantity ELSE 0.0 END AS flat FROM lineitem)"


@query("SELECT \"column\", reason FROM (" + union([f"""
SELECT '{c}' AS "column", CASE WHEN count(*) FILTER ({c} IS NULL) / count(*) > 0.95 THEN 'null' WHEN min({c}) = max({c}) THEN 'constant'
  WHEN count(DISTINCT {c}) <= 1000 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM {FLAWED} WHERE {c} IS NOT NULL GROUP BY {c})) / count(*) > 0.99 THEN 'dominant' END AS reason FROM {FLAWED}""" for c in ("l_quantity", "mostly_null", "fixed", "flat")]) + ") WHERE reason IS NOT NULL")
def prefilter_scan(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.when(F.col("l_orderkey") % 50 == 0, 1).alias("mostly_null"), F.lit(7.0).alias("fixed"), F.when(F.col("l_orderkey") % 200 == 0, F.col("l_quantity")).otherwise(0.0).alias("flat"))
    return profile.prefilter(rows, ["l_orderkey"])


PAIRED = ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderkey")


@query("SELECT name AS key_column FROM (" + union([f"SELECT {k} AS k, '{c}' AS name, count(DISTINCT (o_custkey, {c})) = count(*) AND count({c}) = count(*) AS ok FROM orders" for k, c in enumerate(PAIRED)]) + ") WHERE ok ORDER BY k LIMIT 1")
def detect_composite_key(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", *PAIRED)
    return spark.createDataFrame([(profile.detect_key(rows, "o_custkey"),)], "key_column string")


@query("SELECT 'fix' AS \"column\" WHERE (SELECT count(*) FILTER (l_orderkey % 20 = 0) / count(*) FROM lineitem) < 0.1")
def fallback_clean(spark, d):
    rows = t(spark, d, "lineitem").select("l_quantity", F.when(F.col("l_orderkey") % 20 == 0, 1).alias("fix"))
    return spark.createDataFrame([(c,) for c in profile.fallback_drops(rows)], "column string")


@query("""
SELECT CASE WHEN p > 90 THEN '>90' WHEN p > 20 THEN '20-90' WHEN p > 0 THEN '0-20' ELSE '0' END AS band, count(*) AS n_columns FROM (""" + union([f"SELECT 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS p FROM {SPARSE}" for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")]) + ") GROUP BY 1")
def metadata_bands(spark, d):
    return profile.metadata_bands(sparse_lineitem(spark, d))


@query(union([f"SELECT '{c}' AS \"column\", '{g}' AS \"group\", round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_rate, count(DISTINCT {c}) AS n_unique, {z} AS zero_rate, {lo} AS min, {hi} AS max FROM {SPARSE}" for c, g, z, lo, hi in (
    ("l_discount", "numerical", "0.0::DOUBLE", "min(l_discount)", "max(l_discount)"), ("l_quantity", "numerical", "round(count(*) FILTER (l_quantity = 0) / count(l_quantity), 6)", "min(l_quantity)", "max(l_quantity)"), ("l_returnflag", "categorical", "0.0::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE"))]))
def null_profile(spark, d):
    return profile.null_profile(sparse_lineitem(spark, d), ["l_discount", "l_quantity", "l_returnflag"])


# ---- roll-ups and joins

@query("""
WITH l AS (SELECT l_orderkey AS o_orderkey, avg(l_quantity) AS li_q_mean, sum(l_quantity) AS li_q_sum, max(l_quantity) AS li_q_max, min(l_quantity) AS li_q_min, stddev_samp(l_quantity) AS li_q_std, count(l_quantity) AS li_q_count, count(DISTINCT l_returnflag) AS li_f_nunique FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS c_custkey, li_q_sum, li_f_nunique FROM orders LEFT JOIN l USING (o_orderkey)),
a AS (SELECT c_custkey, round(avg(li_q_sum), 6) AS ord_sum_mean, round(sum(li_q_sum), 6) AS ord_sum_sum, max(li_q_sum) AS ord_sum_max, min(li_q_sum) AS ord_sum_min, round(stddev_samp(li_q_sum), 6) AS ord_sum_std, count(li_q_sum) AS ord_sum_count, round(avg(li_f_nunique), 6) AS ord_flags_mean FROM o GROUP BY 1)
SELECT c.c_custkey, ord_sum_mean, ord_sum_sum, ord_sum_max, ord_sum_min, ord_sum_std, ord_sum_count, ord_flags_mean FROM customer c LEFT JOIN a USING (c_custkey)""")
def rollup_lineitem_orders_customer(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"))
    orders = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = rollup.two_levels(t(spark, d, "customer").select("c_custkey"), "c_custkey", orders, "o_orderkey", lines, ("ord", "li"))
    fns = ("mean", "sum", "max", "min", "std", "count")
    shaped = {f"ord_sum_{f}": F.round(f"ord_li_q_sum_{f}", 6) if f in ("mean", "sum", "std") else F.col(f"ord_li_q_sum_{f}") for f in fns}
    return out.select("c_custkey", *[c.alias(n) for n, c in shaped.items()], F.round("ord_li_f_nunique_mean", 6).alias("ord_flags_mean"))


ROW_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_SQL = ", ".join(ROW_ORDER)


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER_SQL}) - 1 AS occurrence FROM lineitem")
def key_occurrence(spark, d):
    out = keys.with_occurrence(t(spark, d, "lineitem"), KEYS, ROW_ORDER, "occurrence")
    return out.select(*KEYS, "l_shipdate", "l_partkey", F.col("occurrence").cast("long").alias("occurrence"))


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER_SQL}) = 1")
def dedup_first(spark, d):
    return keys.dedup_by_key(t(spark, d, "lineitem"), KEYS, ROW_ORDER).select(*KEYS, "l_shipdate", "l_extendedprice")


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in ROW_ORDER)}) = 1")
def dedup_last(spark, d):
    return keys.dedup_by_key(t(spark, d, "lineitem"), KEYS, ROW_ORDER, "last").select(*KEYS, "l_shipdate", "l_extendedprice")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def drop_duplicates(spark, d):
    return keys.drop_duplicates(t(spark, d, "orders").select("o_custkey", "o_orderstatus"))


@query(f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER_SQL}) - 1 AS occ FROM lineitem)
SELECT CASE WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'oot' END AS split, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM s WHERE occ < 3 GROUP BY 1""")
def split_assignment_join(spark, d):
    raw = keys.with_occurrence(t(spark, d, "lineitem"), KEYS, ROW_ORDER)
    marked = raw.where(f"{keys.OCCURRENCE} < 3").withColumn(keys.SPLIT, F.when(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("oot"))
    both, _ = keys.join_assignment(raw, marked.select(*KEYS, keys.OCCURRENCE, keys.SPLIT), [*KEYS, keys.OCCURRENCE])
    return both.groupBy(F.col(keys.SPLIT).alias("split")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT o_orderkey, 0 AS occurrence, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'oot' END AS split,
       row_number() OVER (PARTITION BY o_orderdate < TIMESTAMP '2000-01-01' ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders""")
def split_freeze(spark, d):
    rows = t(spark, d, "orders").withColumn(keys.SPLIT, F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("oot"))
    out = keys.freeze_assignment(rows, ["o_orderkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", F.col(keys.OCCURRENCE).alias("occurrence"), F.col(keys.SPLIT).alias("split"), F.col(keys.POSITION).cast("long").alias("position"))


@query("SELECT doc_id, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)")
def scores_with_labels(spark, d):
    return t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


@query("""
SELECT part, count(*) AS n, count(extra) AS extras FROM (SELECT 'train' AS part, NULL::DOUBLE AS extra FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' UNION ALL SELECT 'valid', l_tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01') GROUP BY 1""")
def union_marked(spark, d):
    rows = t(spark, d, "lineitem").select("l_quantity", "l_shipdate", "l_tax")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    both = keys.union_marked({"train": rows.where(F.col("l_shipdate") < cut).drop("l_tax"), "valid": rows.where(F.col("l_shipdate") >= cut).withColumnRenamed("l_tax", "extra")}, "part")
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count("extra").alias("extras"))


# ---- sampling and splitting

LABELLED = "(SELECT doc_id, quality FROM labels)"


@query(f"""
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS r, greatest(1, floor(count(*) OVER (PARTITION BY quality) * 0.3)) AS k FROM {LABELLED}) WHERE r <= k""")
def stratified_sample(spark, d):
    return split.stratified_sample(t(spark, d, "labels").select("doc_id", "quality"), 0.3, "quality", ["doc_id"])


@query(f"""
SELECT doc_id, quality, CASE WHEN r <= k THEN 'valid' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS r, round(count(*) OVER (PARTITION BY quality) * 0.2) AS k FROM {LABELLED})""")
def stratified_split(spark, d):
    out = split.stratified_split(t(spark, d, "labels").select("doc_id", "quality"), 0.2, "quality", ["doc_id"])
    return out.withColumnRenamed(split.SPLIT, "split")


@query(f"SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) % 5 AS fold FROM {LABELLED}")
def stratified_folds(spark, d):
    return split.k_folds(t(spark, d, "labels").select("doc_id", "quality"), 5, "quality", ["doc_id"]).withColumn("fold", F.col("fold").cast("long"))


@query("SELECT (ts::DATE + (7 - CASE WHEN isodow(ts) > 5 THEN isodow(ts) - 5 ELSE isodow(ts) + 2 END)::INTEGER)::DATE AS period, count(*) AS n FROM events GROUP BY 1")
def weekly_periods(spark, d):
    return split.period_counts(t(spark, d, "events"), "ts", "W", "FRI")


@query("SELECT upper(strftime(ts, '%a')) AS day FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def modal_weekday(spark, d):
    return spark.createDataFrame([(split.modal_weekday(t(spark, d, "events"), "ts"),)], "day string")


@query("SELECT count(DISTINCT o_orderdate) AS n_dates, count(DISTINCT date_trunc('month', o_orderdate)) AS n_periods, 'intra_month' AS cadence FROM orders")
def period_cadence(spark, d):
    return split.cadence(t(spark, d, "orders"), "o_orderdate")


OOT = """
WITH p AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY period DESC) / sum(n) OVER () AS share, row_number() OVER (ORDER BY period DESC) AS k, count(*) OVER () AS total FROM p),
k0 AS (SELECT least(greatest(min(k) FILTER (share >= 0.15), 2), max(total) - 1) AS k FROM c),
k1 AS (SELECT greatest(1, least(k0.k, coalesce((SELECT max(c.k) FROM c WHERE c.share <= 0.20), 1))) AS k FROM k0)
"""


@query(OOT + "SELECT period::VARCHAR AS period, n FROM c, k1 WHERE c.k <= k1.k")
def oot_sizing(spark, d):
    counts = split.period_counts(t(spark, d, "orders"), "o_orderdate")
    rows = [(str(r.period), r.n) for r in counts.orderBy("period").collect()]
    hold = set(split.size_holdout(rows))
    return counts.select(F.col("period").cast("string").alias("period"), "n").where(F.col("period").isin(*hold))


@query(OOT + """, hold AS (SELECT period FROM c, k1 WHERE c.k <= k1.k), pool AS (SELECT period, n, sum(n) OVER (ORDER BY period DESC) - n AS later, sum(n) OVER () AS total, row_number() OVER (ORDER BY period) AS first FROM p WHERE period NOT IN (SELECT period FROM hold)),
v AS (SELECT period FROM pool WHERE later < round_even(round_even(total * 0.2, 0) * 0.2, 0) AND first > 1),
s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN date_trunc('month', o_orderdate)::DATE IN (SELECT period FROM hold) THEN 'oot' WHEN date_trunc('month', o_orderdate)::DATE IN (SELECT period FROM v) THEN 'valid_temporal' ELSE 'train' END AS tag FROM orders),
q AS (SELECT (round_even((SELECT max(total) FROM pool) * 0.2, 0) - count(*) FILTER (tag = 'valid_temporal')) / count(*) FILTER (tag = 'train') AS share FROM s),
r AS (SELECT s.*, row_number() OVER (PARTITION BY tag, o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS i, round(count(*) OVER (PARTITION BY tag, o_orderstatus) * share) AS k FROM s, q)
SELECT CASE WHEN tag = 'train' AND i <= k THEN 'valid_random' ELSE tag END AS split, o_orderstatus, count(*) AS n FROM r GROUP BY 1, 2""")
def temporal_split_counts(spark, d):
    rows = t(spark, d, "orders")
    plan = split.fit_split(rows, "o_orderdate")
    out = split.apply_split(rows, split.SplitPlan.from_dict(plan.to_dict()), "o_orderstatus", ["o_orderkey"])
    return out.groupBy(F.col(split.SPLIT).alias("split"), "o_orderstatus").agg(F.count("*").alias("n"))


@query(f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS r, round(count(*) OVER (PARTITION BY quality) * 0.2) AS k FROM {LABELLED}),
b AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('43|' || doc_id), doc_id) AS r, round(count(*) OVER (PARTITION BY quality) * 0.25) AS k FROM a WHERE r > k)
SELECT doc_id, 'test' AS split FROM a WHERE r <= k UNION ALL SELECT doc_id, CASE WHEN r <= k THEN 'valid' ELSE 'train' END FROM b""")
def fallback_split(spark, d):
    out = split.apply_split(t(spark, d, "labels").select("doc_id", "quality"), split.fit_split(t(spark, d, "labels"), None), "quality", ["doc_id"])
    return out.select("doc_id", F.col(split.SPLIT).alias("split"))


@query("SELECT event_id, ts FROM events ORDER BY event_id LIMIT 100")
def head_sample(spark, d):
    return readers.head(t(spark, d, "events").select("event_id", "ts"), 100, "event_id")


# ---- types, text, expressions

@query("SELECT p_partkey, replace(p_brand, 'Brand#', '')::DOUBLE AS brand_no, NULL::DOUBLE AS bad, p_size::DOUBLE AS size FROM part")
def to_numeric_coerce(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", scalars.to_number(F.regexp_replace("p_brand", "Brand#", "")).alias("brand_no"), scalars.to_number(F.col("p_brand")).alias("bad"), scalars.to_number(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).alias("size"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS day, NULL::TIMESTAMP AS bad FROM orders")
def to_datetime_coerce(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", scalars.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("timestamp_ntz").alias("day"), scalars.to_timestamp(F.col("o_orderpriority")).cast("timestamp_ntz").alias("bad"))


@query("SELECT p_partkey, lower(p_type) AS kind FROM part")
def strip_lower(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.lit(" \t "), "p_type", F.lit("\n ")).alias("kind"))
    return clean.CleaningSpec(dtype_fixes=(("kind", "strip_whitespace", None), ("kind", "standardize_case", None))).apply(rows)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders")
def normalise_dates(spark, d):
    return readers.normalise(t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), True)


EXPRESSIONS = {
    "ratio": ("df['l_extendedprice'] / (df['l_quantity'] + 1)", "l_extendedprice / (l_quantity + 1)"),
    "over_zero": ("df['l_extendedprice'] / df['l_discount']", "CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END"),
    "log_price": ("np.log1p(df['l_extendedprice']) - np.log(df['l_quantity'])", "ln(1 + l_extendedprice) - ln(l_quantity)"),
    "branch": ("np.where((df['l_quantity'] > 25) & (df['l_tax'] < 0.05), df['l_discount'], -1)", "CASE WHEN l_quantity > 25 AND l_tax < 0.05 THEN l_discount ELSE -1 END"),
    "choose": ("np.select([df['l_quantity'] < 10, df['l_quantity'] < 30], [1, 2], default=3)", "CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 30 THEN 2 ELSE 3 END"),
    "row_mean": ("df[['l_discount', 'l_tax']].mean(axis=1)", "(l_discount + l_tax) / 2"),
    "clipped": ("df['l_quantity'].clip(5, 40) % 7", "(greatest(5, least(40, l_quantity)) % 7)"),
    "flag": ("df['l_returnflag'].isin(['A', 'R']).astype(int) * 2", "(CASE WHEN l_returnflag IN ('A', 'R') THEN 2 ELSE 0 END)"),
    "power": ("df['l_discount'] ** 2 + np.sqrt(df['l_tax'])", "power(l_discount, 2) + sqrt(l_tax)"),
    "centred": ("df['l_quantity'] - df['l_quantity'].median()", "l_quantity - (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem)"),
    "scaled": ("(df['l_tax'] - df['l_tax'].mean()) / df['l_tax'].std()", "(l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_samp(l_tax) FROM lineitem)"),
}


@query("WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, " + ", ".join(f"({s})::DOUBLE AS {n}" for n, (_, s) in EXPRESSIONS.items()) + " FROM lineitem), m AS (SELECT " + ", ".join(f"quantile_cont({n}, 0.5) AS m_{n}" for n in EXPRESSIONS) + " FROM e) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, " + ", ".join(f"round(coalesce({n}, m_{n}), 8) AS {n}" for n in EXPRESSIONS) + " FROM e, m")
def interactions(spark, d):
    rows = t(spark, d, "lineitem")
    fitted = expr.fit_interactions(rows, {n: text for n, (text, _) in EXPRESSIONS.items()})
    out = {n: F.round(expr.interaction(rows, c, fill), 8) for n, (c, fill, _) in fitted.items()}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *[c.alias(n) for n, c in out.items()])


# ---- drift, binning, selection

CUT = "TIMESTAMP '2000-01-01'"


def sides(spark, d, df=None):
    rows = df if df is not None else t(spark, d, "lineitem")
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    return rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut)


def psi_sql(column: str, bins: int, table: str = "lineitem") -> str:
    ps = ", ".join(repr(k / bins) for k in range(bins + 1))
    return f"""(WITH q AS (SELECT list_sort(list_distinct(quantile_cont({column}, [{ps}]))) AS e FROM {table} WHERE l_shipdate < {CUT}),
b AS (SELECT l_shipdate < {CUT} AS tr, len(list_filter(e[2:len(e) - 1], lambda k: k < {column})) AS bin FROM {table}, q WHERE {column} IS NOT NULL),
g AS (SELECT bin, count(*) FILTER (tr) AS e, count(*) FILTER (NOT tr) AS a FROM b GROUP BY bin),
s AS (SELECT e / sum(e) OVER () + 1e-8 AS e, a / sum(a) OVER () + 1e-8 AS a FROM g)
SELECT '{column}' AS feature, round(sum((a - e) * ln(a / e)), 9) AS psi FROM s)"""


@query("SELECT feature, psi, psi > 0.25 AS warn FROM (" + union([f"SELECT * FROM {psi_sql(c, 10)}" for c in MEASURES]) + ")")
def psi_report(spark, d):
    train, hold = sides(spark, d)
    return drift.drift_report(train.select(*MEASURES), hold.select(*MEASURES))


@query(union([f"SELECT feature, round(psi, 9) AS psi FROM {psi_sql('l_linenumber', 10)}"]) + "\nUNION ALL SELECT 'flag', 0.0")
def psi_low_cardinality(spark, d):
    train, hold = sides(spark, d, t(spark, d, "lineitem").withColumn("flag", (F.col("l_returnflag") == "R").cast("int")))
    return drift.psi(train, hold, ["l_linenumber", "flag"]).withColumn("psi", F.round("psi", 9))


@query("SELECT feature, psi, CASE WHEN psi > 0.35 THEN 'DROP' ELSE 'KEEP' END AS decision FROM (" + union([f"SELECT * FROM {psi_sql(c, 100)}" for c in MEASURES]) + ") UNION ALL SELECT 'l_returnflag', NULL, 'SKIPPED'")
def psi_filter(spark, d):
    train, hold = sides(spark, d)
    return drift.psi_filter(train, hold, [*MEASURES, "l_returnflag"])


def woe_sql(column: str, table: str, edges: str | None = None) -> str:
    """Bins of ten train quantiles (or stated edges), half a row of smoothing, the last bin for nulls."""
    ps = ", ".join(repr(k / 10) for k in range(11))
    e = edges or f"list_sort(list_distinct(quantile_cont({column}, [{ps}])))"
    inner = "e" if edges else "e[2:len(e) - 1]"
    source = "" if edges else f" FROM {table}"
    return f"""(WITH q AS (SELECT {inner} AS e FROM (SELECT {e} AS e{source})), r AS (SELECT unnest(range(0, len(e) + 2)) AS bin FROM q),
b AS (SELECT CASE WHEN {column} IS NULL THEN len(e) + 1 ELSE len(list_filter(e, lambda k: k <= {column})) END AS bin, y FROM {table}, q),
g AS (SELECT r.bin, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM r LEFT JOIN b USING (bin) GROUP BY r.bin),
w AS (SELECT bin, pos, neg, (pos + 0.5) / (sum(pos) OVER () + 0.5 * count(*) OVER ()) AS p, (neg + 0.5) / (sum(neg) OVER () + 0.5 * count(*) OVER ()) AS n FROM g)
SELECT '{column}' AS feature, bin, pos, neg, ln(n / p) AS woe, (n - p) * ln(n / p) AS iv FROM w)"""


RETURNED = "(SELECT nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_quantity, l_extendedprice, (l_returnflag = 'R')::INTEGER AS y FROM lineitem)"
BAND = "CASE WHEN iv < 0.02 THEN 'useless' WHEN iv < 0.1 THEN 'weak' WHEN iv < 0.3 THEN 'medium' WHEN iv < 0.5 THEN 'strong' ELSE 'suspicious' END"
FEW_EDGES = "(SELECT list((a + b) / 2 ORDER BY a) FROM (SELECT v AS a, lead(v) OVER (ORDER BY v) AS b FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL)) WHERE b IS NOT NULL)"


def returned(spark, d):
    return sparse_lineitem(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def iv_source(c: str) -> str:
    return woe_sql(c, RETURNED, FEW_EDGES.format(c=c, t=RETURNED)) if c in ("l_discount", "l_tax") else woe_sql(c, RETURNED)


@query(f"SELECT feature, round(iv, 6) AS iv, {BAND} AS band, iv >= 0.5 AS leak FROM (SELECT feature, sum(iv) AS iv FROM (" + union([f"SELECT * FROM {iv_source(c)}" for c in MEASURES]) + ") GROUP BY feature)")
def iv_table(spark, d):
    return binning.compute_iv(returned(spark, d), "y", MEASURES)


@query("SELECT feature, bin, pos, neg, round(woe, 6) AS woe, round(iv, 9) AS iv FROM (" + union([f"SELECT * FROM {iv_source(c)}" for c in ("l_discount", "l_quantity")]) + ")")
def woe_bins(spark, d):
    rows = returned(spark, d)
    out = binning.woe_table(binning.bin_counts(rows, binning.iv_edges(rows, ["l_discount", "l_quantity"]), "y"))
    return out.withColumns({"bin": F.col("bin").cast("long"), "woe": F.round("woe", 6), "iv": F.round("iv", 9)})


@query(f"""WITH w AS (SELECT * FROM {iv_source('l_discount')}), e AS (SELECT {FEW_EDGES.format(c='l_discount', t=RETURNED)} AS e)
SELECT s.l_orderkey, s.l_linenumber, s.l_shipdate, s.l_extendedprice, round(w.woe, 6) AS l_discount FROM {SPARSE} s, e JOIN w ON w.bin = CASE WHEN s.l_discount IS NULL THEN len(e) + 1 ELSE len(list_filter(e, lambda k: k <= s.l_discount)) END""")
def woe_transform(spark, d):
    rows = returned(spark, d)
    out = binning.apply_woe(rows, binning.fit_woe(rows, "y", ["l_discount"], min_iv=0.0))
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.round("l_discount", 6).alias("l_discount"))


@query(f"SELECT feature, round(iv, 6) AS iv, {BAND} AS band, iv >= 0.5 AS leak FROM (SELECT feature, sum(iv) AS iv FROM " + woe_sql("lines", "(SELECT len(string_split(text, chr(10))) AS lines, (quality = 0)::INTEGER AS y FROM documents JOIN labels USING (doc_id))") + " GROUP BY feature)")
def iv_documents(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines")).join(t(spark, d, "labels"), "doc_id").withColumn("y", (F.col("quality") == 0).cast("int"))
    return binning.compute_iv(rows.select("lines", "y"), "y", ["lines"])


SIGNAL = "(SELECT l_shipdate, l_quantity + CASE WHEN l_returnflag = 'R' THEN 15 ELSE 0 END AS s, (l_returnflag = 'R')::INTEGER AS y FROM lineitem)"
TRAIN_SIGNAL = f"(SELECT * FROM {SIGNAL} WHERE l_shipdate < {CUT})"
S_EDGES = "list_sort(list_distinct(quantile_cont(s, [" + ", ".join(repr(k / 10) for k in range(11)) + "])))"


def signal(spark, d):
    r = F.col("l_returnflag") == "R"
    return t(spark, d, "lineitem").select("l_shipdate", (F.col("l_quantity") + F.when(r, 15).otherwise(0)).alias("s"), r.cast("int").alias("y"))


@query(f"""
WITH a AS (SELECT * FROM {woe_sql('s', TRAIN_SIGNAL, f"(SELECT x[2:len(x) - 1] FROM (SELECT {S_EDGES} AS x FROM {TRAIN_SIGNAL}))")}),
b AS (SELECT * FROM {woe_sql('s', f"(SELECT * FROM {SIGNAL} WHERE l_shipdate >= {CUT})", f"(SELECT x[2:len(x) - 1] FROM (SELECT {S_EDGES} AS x FROM {TRAIN_SIGNAL}))")}),
j AS (SELECT a.woe AS w1, b.woe AS w2, a.iv AS i1, b.iv AS i2, a.pos + a.neg >= 30 AND b.pos + b.neg >= 30 AS ok FROM a JOIN b USING (bin)),
o AS (SELECT sum(i1) AS t, sum(i2) AS h, corr(w1, w2) FILTER (ok) AS c, count(*) FILTER (ok AND w1 * w2 < 0) AS flips FROM j)
SELECT 's' AS feature, round(t, 6) AS iv_train, round(h, 6) AS iv_hold, round((t - h) / t, 6) AS iv_drop, round(c, 6) AS woe_corr, flips AS sign_flips, (t - h) / t > 0.3 OR h < 0.02 OR coalesce(c < 0.5, false) AS unstable FROM o""")
def iv_stability(spark, d):
    train, hold = sides(spark, d, signal(spark, d))
    return binning.iv_stability(train, hold, "y", ["s"])


@query(union([f"SELECT '{c}' AS feature, round(corr({c}, y), 4) AS corr, count(*) FILTER ({c} IS NULL) > 0.3 * count(*) AS unreliable, CASE WHEN abs(round(corr({c}, y), 4)) > 0.8 THEN 'high' WHEN abs(round(corr({c}, y), 4)) < 0.04 THEN 'low' ELSE 'medium' END AS band FROM {RETURNED}" for c in MEASURES]) + "\nUNION ALL SELECT 'fixed', 0.0, false, 'low'")
def target_correlation(spark, d):
    return select.target_correlation(returned(spark, d).withColumn("fixed", F.lit(1.0)), "y", [*MEASURES, "fixed"])


def anova_sql(c: str) -> str:
    return f"""(WITH f AS (SELECT coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {SPARSE})) AS x, l_returnflag AS y FROM {SPARSE}), g AS (SELECT y, count(*) AS n, sum(x) AS s, var_pop(x) AS v FROM f GROUP BY y)
SELECT '{c}' AS feature, round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / (sum(v * n) / (sum(n) - count(*))), 4) AS f FROM g)"""


@query(union([f"SELECT * FROM {anova_sql(c)}" for c in MEASURES]))
def anova_f(spark, d):
    return select.f_scores(sparse_lineitem(spark, d), "l_returnflag", MEASURES).withColumn("f", F.round("f", 4))


@query(union([f"SELECT '{c}' AS feature, round(r * r / (1 - r * r) * (n - 2), 3) AS f FROM (SELECT corr(x, l_extendedprice) AS r, count(*) AS n FROM (SELECT coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {SPARSE})) AS x, l_extendedprice FROM {SPARSE}))" for c in ("l_quantity", "l_discount", "l_tax")]))
def regression_f(spark, d):
    return select.f_scores(sparse_lineitem(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).withColumn("f", F.round("f", 3))


@query(union([f"SELECT '{a}' AS a, '{b}' AS b, round(corr(coalesce({a}, (SELECT avg({a}) FROM {SPARSE})), coalesce({b}, (SELECT avg({b}) FROM {SPARSE}))), 6) AS corr FROM {SPARSE}" for k, a in enumerate(MEASURES) for b in MEASURES[k + 1 :]]))
def correlation_pairs(spark, d):
    return select.correlations(sparse_lineitem(spark, d), MEASURES).withColumn("corr", F.round("corr", 6))


@query(f"""
WITH r AS (SELECT l_extendedprice AS e, l_extendedprice * 2 + 1 AS p, l_quantity AS q, l_tax AS t FROM lineitem),
c AS (SELECT abs(corr(e, p)) > {select.COLLINEAR} AS ep, abs(corr(e, q)) > {select.COLLINEAR} AS eq, abs(corr(p, q)) > {select.COLLINEAR} AS pq, abs(corr(e, t)) > {select.COLLINEAR} AS et, abs(corr(p, t)) > {select.COLLINEAR} AS pt, abs(corr(q, t)) > {select.COLLINEAR} AS qt FROM r),
k AS (SELECT *, NOT ep AS kp, NOT (eq OR (NOT ep AND pq)) AS kq FROM c)
SELECT 'l_extendedprice' AS feature, true AS kept UNION ALL SELECT 'price_copy', kp FROM k UNION ALL SELECT 'l_quantity', kq FROM k UNION ALL SELECT 'l_tax', NOT (et OR (kp AND pt) OR (kq AND qt)) FROM k""")
def collinearity_prune(spark, d):
    rows = t(spark, d, "lineitem").withColumn("price_copy", F.col("l_extendedprice") * 2 + 1)
    kept, dropped = select.prune_collinear(rows, {"l_extendedprice": 0.9, "price_copy": 0.8, "l_quantity": 0.7, "l_tax": 0.6})
    return spark.createDataFrame([(c, True) for c in kept] + [(c, False) for c in dropped], "feature string, kept boolean")


GINI = "(SELECT {g} AS g, x, sum(y) AS pos, sum(1 - y) AS neg FROM {t} GROUP BY {g}, x)"


def auc_sql(source: str, group: str) -> str:
    return f"(SELECT g, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {GINI.format(g=group, t=source)}) GROUP BY g)"


MONTHLY = "(SELECT date_trunc('month', o_orderdate)::DATE AS m, o_totalprice AS x, (o_orderstatus = 'F')::INTEGER AS y FROM orders)"


@query(f"SELECT 'o_totalprice' AS feature, g AS period, round(coalesce(abs(2 * auc - 1), 0), 9) AS gini FROM {auc_sql(MONTHLY, 'm')}")
def gini_by_period(spark, d):
    rows = t(spark, d, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return select.gini_by_period(rows, ["o_totalprice"], "y", split.period_of(F.col("o_orderdate"))).withColumn("gini", F.round("gini", 9))


@query(f"""SELECT 'o_totalprice' AS feature, count(*) AS n_periods, round(avg(gini), 9) AS mean_gini, round(stddev_pop(gini), 9) AS std_gini,
CASE WHEN stddev_pop(gini) > 0.2 THEN 'DROP_UNSTABLE' WHEN avg(gini) < 0.01 THEN 'DROP_WEAK' ELSE 'KEEP' END AS decision FROM (SELECT coalesce(abs(2 * auc - 1), 0) AS gini FROM {auc_sql(MONTHLY, 'm')})""")
def stability_check(spark, d):
    rows = t(spark, d, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return select.stability(rows, ["o_totalprice"], "y", split.period_of(F.col("o_orderdate")))


RETURNED = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"


@query("SELECT 'y' AS feature UNION ALL SELECT feature FROM (SELECT * FROM (" + union([f"SELECT '{c}' AS feature, abs(round(corr({c}, y), 4)) AS c FROM {RETURNED}" for c in MEASURES]) + ") WHERE c > 0 ORDER BY c DESC, feature LIMIT 2)")
def select_top_features(spark, d):
    rows = t(spark, d, "lineitem").select(*MEASURES, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return spark.createDataFrame([(c,) for c in select.select_top(rows, "y", 2, "correlation")], "feature string")


# ---- nulls and encoding

STATS = ("mean", "median", "p95", "abs_median", "abs_p95", "nz_median", "nz_p95")


@query(union([f"""SELECT '{c}' AS "column", round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_rate, round(count(*) FILTER ({c} = 0) / count({c}), 6) AS zero_rate, min({c})::DOUBLE AS min, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.95), 6) AS p95, max({c})::DOUBLE AS max,
round(quantile_cont(abs({c}), 0.5), 6) AS abs_median, round(quantile_cont(abs({c}), 0.95), 6) AS abs_p95, round(quantile_cont(abs(nullif({c}, 0)), 0.5), 6) AS nz_median, round(quantile_cont(abs(nullif({c}, 0)), 0.95), 6) AS nz_p95, count(nullif({c}, 0)) AS nz_count FROM {SPARSE}""" for c in MEASURES]))
def null_stats(spark, d):
    out = nulls.statistics(sparse_lineitem(spark, d), MEASURES)
    return out.withColumns({c: F.round(c, 6) for c in ("missing_rate", "zero_rate", *STATS)})


@query(f"""
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, (l_discount IS NULL)::TINYINT AS l_discount_missing, coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {SPARSE})) AS l_discount,
       round(coalesce(l_tax, (SELECT avg(l_tax) FROM {SPARSE})), 9) AS l_tax, coalesce(CASE WHEN l_returnflag <> 'A' THEN l_returnflag END, '__MISSING__') AS l_returnflag FROM {SPARSE}""")
def null_impute(spark, d):
    rows = sparse_lineitem(spark, d).withColumn("l_returnflag", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")))
    rules = {"l_discount": nulls.Rule("median", True), "l_tax": nulls.Rule("mean"), "l_returnflag": nulls.Rule("explicit_category", group="categorical")}
    policy = nulls.NullPolicy.from_dict(nulls.fit_nulls(rows, rules).to_dict())
    out = policy.apply(rows).withColumn("l_tax", F.round("l_tax", 9))
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_discount_missing", "l_discount", "l_tax", "l_returnflag")


@query(union([f"SELECT '{c}' AS \"column\", '{s}' AS strategy, {i} AS indicator FROM (SELECT count(*) FILTER ({c} IS NULL) / count(*) AS m FROM {SPARSE})" for c, s, i in (("l_discount", "median", "m > 0.02"), ("l_quantity", "median", "m > 0.02"), ("l_returnflag", "explicit_category", "false"))]))
def null_rules(spark, d):
    p = [r.asDict() for r in profile.null_profile(sparse_lineitem(spark, d), ["l_discount", "l_quantity", "l_returnflag"]).collect()]
    return spark.createDataFrame([(c, r.strategy, r.indicator) for c, r in nulls.heuristic_rules(p).items()], "column string, strategy string, indicator boolean")


@query(f"""SELECT 'l_discount' AS "column", round(avg((l_discount IS NULL)::INTEGER) FILTER (l_shipdate < {CUT}), 6) AS train_rate, round(avg((l_discount IS NULL OR l_quantity > 20)::INTEGER) FILTER (l_shipdate >= {CUT}), 6) AS other_rate,
abs(round(avg((l_discount IS NULL OR l_quantity > 20)::INTEGER) FILTER (l_shipdate >= {CUT}), 6) - round(avg((l_discount IS NULL)::INTEGER) FILTER (l_shipdate < {CUT}), 6)) > 0.1 AS drifted FROM {SPARSE}""")
def missing_drift(spark, d):
    train, hold = sides(spark, d, sparse_lineitem(spark, d))
    return nulls.missing_drift(train, hold.withColumn("l_discount", F.when(F.col("l_quantity") <= 20, F.col("l_discount"))), ["l_discount"])


@query(union([f"""SELECT '{c}' AS "column", round(k * m2 / m1, 6) AS median_ratio, round(k * p2 / p1, 6) AS p95_ratio, '{v}' AS verdict FROM (SELECT {k} AS k, quantile_cont(abs(nullif({c}, 0)), 0.5) FILTER (l_shipdate < {CUT}) AS m1, quantile_cont(abs(nullif({c}, 0)), 0.95) FILTER (l_shipdate < {CUT}) AS p1,
quantile_cont(abs(nullif({c}, 0)), 0.5) FILTER (l_shipdate >= {CUT}) AS m2, quantile_cont(abs(nullif({c}, 0)), 0.95) FILTER (l_shipdate >= {CUT}) AS p2 FROM lineitem)""" for c, k, v in (("l_extendedprice", 100, "fail"), ("l_quantity", 5, "warn"), ("l_tax", 1, "pass"))]))
def scale_guard(spark, d):
    train, hold = sides(spark, d)
    hold = hold.withColumns({"l_extendedprice": F.col("l_extendedprice") * 100, "l_quantity": F.col("l_quantity") * 5})
    return nulls.scale_guard(train, hold, ["l_extendedprice", "l_quantity", "l_tax"])


GAPPED = "(SELECT CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END AS a, CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity * 2 END AS a_twin, l_tax AS \"full\", NULL::DOUBLE AS empty FROM lineitem)"
GAPS = ("a", "a_twin", '"full"', "empty")


@query("SELECT indicator FROM (" + union([f"""SELECT '{c.strip(chr(34))}' AS indicator, count({c}) BETWEEN 1 AND count(*) - 1{"".join(f" AND count(*) FILTER (({c} IS NULL) <> ({b} IS NULL)) > 0" for b in GAPS[:k])} AS ok FROM {GAPPED}""" for k, c in enumerate(GAPS)]) + ") WHERE ok")
def null_indicators(spark, d):
    r = t(spark, d, "lineitem")
    gap = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity"))
    rows = r.select(gap.alias("a"), (gap * 2).alias("a_twin"), F.col("l_tax").alias("full"), F.lit(None).cast("double").alias("empty"))
    rules = {c: nulls.Rule("median", True) for c in rows.columns}
    return spark.createDataFrame([(c,) for c in nulls.indicator_columns(rows, rules)], "indicator string")


CODES = "(SELECT list_sort(list_append(list(DISTINCT {c}), '__NA__')) AS v FROM {t})"


@query(f"SELECT c_custkey, list_position(v, c_mktsegment) - 1 AS c_mktsegment FROM customer, {CODES.format(c='c_mktsegment', t='customer')}")
def label_encode(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return encode.apply_labels(rows, encode.fit_labels(rows, ["c_mktsegment"])).withColumn("c_mktsegment", F.col("c_mktsegment").cast("long"))


@query(f"SELECT c_custkey, list_position(v, CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment < 'H') THEN c_mktsegment ELSE '__NA__' END) - 1 AS c_mktsegment FROM customer, {CODES.format(c='c_mktsegment', t='(SELECT * FROM customer WHERE c_mktsegment < $$H$$)')}")
def unseen_replay(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    encoders = encode.fit_labels(rows.where("c_mktsegment < 'H'"), ["c_mktsegment"])
    return encode.apply_labels(rows, encoders).withColumn("c_mktsegment", F.col("c_mktsegment").cast("long"))


@query("SELECT 'c_mktsegment' AS \"column\", round(count(*) FILTER (c_mktsegment >= 'H') / count(*), 6) AS unseen_rate FROM customer")
def unseen_rate(spark, d):
    rows = t(spark, d, "customer")
    return encode.unseen_rates(rows, encode.fit_labels(rows.where("c_mktsegment < 'H'"), ["c_mktsegment"]))


@query("SELECT o_orderkey, (o_orderstatus = 'O')::INTEGER AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INTEGER AS \"o_orderstatus_P\" FROM orders")
def onehot(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return encode.apply_onehot(rows, encode.fit_onehot(rows, ["o_orderstatus"]))


# ---- evaluation

SCORED = "(SELECT l_discount * 10 AS s, (l_returnflag = 'R')::INTEGER AS y, CASE WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'oot' END AS part FROM lineitem)"
GROUPED = f"(SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM {SCORED} GROUP BY s)"
CURVE = f"(SELECT s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM {GROUPED} WINDOW w AS (ORDER BY s DESC))"


def scored(spark, d):
    part = F.when(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("oot")
    return t(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"), part.alias("part"), F.col("l_extendedprice").alias("price"))


@query(f"SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {GROUPED})")
def auc(spark, d):
    return metrics.auc(scored(spark, d), "s", "y").withColumn("auc", F.round("auc", 9))


@query("SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT l_extendedprice AS s, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1))")
def auc_continuous(spark, d):
    return metrics.auc(scored(spark, d), "price", "y").withColumn("auc", F.round("auc", 9))


@query(f"SELECT round(max(x.gap), 9) AS ks, arg_max(s, (gap, s)) AS threshold FROM (SELECT s, round(abs(tp / p - fp / n), 12) AS gap FROM {CURVE}) x")
def ks(spark, d):
    return metrics.ks(scored(spark, d), "s", "y")


@query(f"SELECT s AS threshold, round(tp / p, 9) AS tpr, round(fp / n, 9) AS fpr FROM {CURVE}")
def roc_points(spark, d):
    return metrics.roc_points(scored(spark, d), "s", "y")


@query(f"SELECT s AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM {CURVE}")
def pr_points(spark, d):
    return metrics.pr_points(scored(spark, d), "s", "y")


@query(f"SELECT round(sum(pos / p * (tp / (tp + fp))), 9) AS average_precision FROM {CURVE}")
def average_precision(spark, d):
    return metrics.average_precision(scored(spark, d), "s", "y")


@query(f"SELECT round(avg((s - y) * (s - y)), 9) AS brier FROM {SCORED}")
def brier(spark, d):
    return metrics.brier(scored(spark, d), "s", "y")


@query(f"SELECT g AS part, round(auc, 4) AS auc, brier, n FROM {auc_sql('(SELECT part, s AS x, y FROM ' + SCORED + ')', 'part')} JOIN (SELECT part AS g, round(avg((s - y) * (s - y)), 4) AS brier, count(*) AS n FROM {SCORED} GROUP BY part) USING (g)")
def metrics_by_part(spark, d):
    return metrics.metrics_by_part(scored(spark, d), "part", "s", "y")


def edges_sql(x: str, table: str) -> str:
    ps = ", ".join(repr(k / 10) for k in range(11))
    return f"(SELECT e[2:len(e) - 1] AS e FROM (SELECT list_sort(list_distinct(quantile_cont({x}, [{ps}]))) AS e FROM {table}))"


@query(f"""WITH b AS (SELECT len(list_filter(e, lambda k: k < -s)) + 1 AS decile, s, y FROM {SCORED}, {edges_sql('-s', SCORED)}), g AS (SELECT decile, count(*) AS n, sum(y)::BIGINT AS bads, round(avg(s), 9) AS avg_score FROM b GROUP BY 1)
SELECT decile, n, bads, avg_score, round(bads / n, 9) AS bad_rate, round((bads / n) / (sum(bads) OVER () / sum(n) OVER ()), 9) AS lift, round(sum(bads) OVER (ORDER BY decile) / sum(bads) OVER (), 9) AS gain FROM g""")
def decile_lift_gain(spark, d):
    return metrics.deciles(scored(spark, d), "s", "y").withColumn("decile", F.col("decile").cast("long"))


@query(f"SELECT len(list_filter(e, lambda k: k < s)) AS bin, round(avg(s), 9) AS mean_score, round(avg(y), 9) AS bad_rate, count(*) AS n FROM {SCORED}, {edges_sql('s', SCORED)} GROUP BY 1")
def calibration_curve(spark, d):
    return metrics.calibration(scored(spark, d), "s", "y").withColumn("bin", F.col("bin").cast("long"))


@query("SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def score_hist(spark, d):
    return metrics.histogram(scored(spark, d), "price").withColumn("bin", F.col("bin").cast("long"))


@query("SELECT a, p, n, round(sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n)), 9) AS se FROM (VALUES (0.77::DOUBLE, 5000::BIGINT, 55000::BIGINT), (0.77, 300, 3700)) AS v(a, p, n)")
def auc_standard_error(spark, d):
    rows = spark.createDataFrame([(0.77, 5000, 55000), (0.77, 300, 3700)], "a double, p long, n long")
    return rows.withColumn("se", F.round(metrics.auc_se_column(F.col("a"), F.col("p"), F.col("n")), 9))


@query("SELECT period, n, round(avg(n) OVER (ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n FROM orders GROUP BY 1)")
def smoothed_curve(spark, d):
    return metrics.smoothed(split.period_counts(t(spark, d, "orders"), "o_orderdate"), "period", "n").withColumn("smooth", F.round("smooth", 6))


@query("""
WITH a AS (SELECT column_name AS c, column_type AS k FROM (DESCRIBE orders)), b AS (SELECT column_name AS c, column_type AS k FROM (DESCRIBE SELECT * EXCLUDE (o_orderdate) REPLACE (o_totalprice::VARCHAR AS o_totalprice), 1 AS more FROM orders))
SELECT coalesce(a.c, b.c) AS "column", CASE WHEN b.c IS NULL THEN 'missing' WHEN a.c IS NULL THEN 'extra' ELSE 'type_mismatch' END AS issue, CASE WHEN a.c = 'o_totalprice' THEN 'error' ELSE 'warning' END AS severity
FROM a FULL JOIN b ON a.c = b.c WHERE a.c IS NULL OR b.c IS NULL OR a.k <> b.k""")
def schema_compare(spark, d):
    o = t(spark, d, "orders")
    return drift.compare_schemas(o, o.drop("o_orderdate").withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("more", F.lit(1)), ["o_totalprice"])
