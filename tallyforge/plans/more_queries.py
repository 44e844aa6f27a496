"""Queries of row operations, encoders, sinks and sources, names and splits, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import roles
from tallyforge.functions import expr
from tallyforge.operators import clean, drift, encode, keys, nulls, ordered, profile, select, split
from tallyforge.plans.queries import MEASURES, OUTLIERS, QUERIES, SPARSE, SQL, query, sparse_lineitem, t, union  # noqa: F401
from tallyforge.session import scratch
from tallyforge.sources import readers, writers

PARTS = ("p_partkey", "p_size", "p_retailprice")


@query(union([OUTLIERS.format(c=c, t="part") for c in PARTS]))
def outlier_scan(spark: SparkSession, d: str) -> DataFrame:
    out = profile.scan_outliers(t(spark, d, "part").select("p_brand", *PARTS))
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "q3", "iqr", "low", "high")})


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, l_returnflag, l_quantity FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC) AS r FROM d)
SELECT l_orderkey, l_returnflag, l_quantity FROM k WHERE r = 1""")
def row_operations(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    ops = ({"op": "drop_duplicates"}, {"op": "no_such"}, {"op": "deduplicate_by_key", "keys": ["l_orderkey", "l_returnflag"], "keep": "last"})
    out, warnings = clean.CleaningSpec(row_ops=ops).apply_rows(rows, ["l_quantity"])
    assert warnings == ["unknown row operation no_such"]
    return out


@query("SELECT n_nationkey, n_name FROM nation")
def drop_columns(spark, d):
    rows = clean.drop_column(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey")
    return clean.CleaningSpec(drops=("absent",)).apply(rows)


@query(f"SELECT l_orderkey, l_linenumber, coalesce(l_discount, -999) AS l_discount, coalesce(l_tax, -999) AS l_tax, l_returnflag FROM {SPARSE}")
def model_fill(spark, d):
    rows = sparse_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag")
    return encode.fill_for_model(rows, ["l_discount", "l_tax"])


@query("""
WITH s AS (SELECT list_sort(list(DISTINCT o_orderstatus)) AS v FROM orders), p AS (SELECT list_sort(list_append(list(DISTINCT o_orderpriority), '__NA__')) AS v FROM orders)
SELECT o_orderkey, (o_orderstatus = s.v[2])::INTEGER AS second_status, (o_orderstatus = s.v[3])::INTEGER AS third_status, list_position(p.v, o_orderpriority) - 1 AS o_orderpriority
FROM orders, s, p""")
def encode_all(spark, d):
    """One-hot up to four levels, codes beyond."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    labels, hot = encode.fit_all(rows, ["o_orderkey"], "onehot", most=4)
    out = encode.apply_onehot(encode.apply_labels(rows, labels), hot)
    second, third = (f"o_orderstatus_{v}" for v in hot["o_orderstatus"])
    return out.select("o_orderkey", F.col(second).alias("second_status"), F.col(third).alias("third_status"), F.col("o_orderpriority").cast("long").alias("o_orderpriority"))


TAGGED = "(SELECT quality, CASE WHEN doc_id % 97 = 0 THEN 'oot' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'valid' ELSE 'train' END AS split FROM labels)"


def tagged(spark, d):
    tag = F.when(F.col("doc_id") % 97 == 0, "oot").when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "valid").otherwise("train")
    return t(spark, d, "labels").withColumn(split.SPLIT, tag)


@query(f"SELECT split, count(*) AS n_rows, count(DISTINCT quality) AS n_classes FROM {TAGGED} GROUP BY 1 HAVING count(*) < 10 OR count(DISTINCT quality) < 2")
def degenerate_parts(spark, d):
    return split.degenerate(tagged(spark, d), "quality").withColumnRenamed(split.SPLIT, "split")


@query("""
WITH o AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS day FROM orders),
p AS (SELECT date_trunc('month', day) AS m, count(*) AS n FROM o WHERE day IS NOT NULL GROUP BY 1)
SELECT (SELECT sum(n) FROM p)::BIGINT AS dated, (SELECT count(*) FROM o WHERE day IS NULL) AS undated, (SELECT count(*) FROM o WHERE day IS NULL) AS undated_in_training""")
def undated_rows_train(spark, d):
    """Rows without a date are training rows and count in no period."""
    rows = t(spark, d, "orders").withColumn("day", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))
    plan = split.fit_split(rows, "day")
    none = F.col("day").isNull()
    out = split.apply_split(rows, plan, None, ["o_orderkey"])
    pool = F.col(split.SPLIT).isin("train", "valid_random")
    return out.agg(F.count("day").alias("dated"), F.count(F.when(none, 1)).alias("undated"), F.count(F.when(none & pool, 1)).alias("undated_in_training"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS i, round(count(*) OVER (PARTITION BY quality) * 0.2) AS k FROM labels WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN i <= k THEN 'valid' ELSE 'train' END AS split FROM r UNION ALL SELECT doc_id, 'test' FROM labels WHERE doc_id % 5 = 0""")
def missing_valid_part(spark, d):
    rows = t(spark, d, "labels").select("doc_id", "quality").withColumn(split.SPLIT, F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    return split.ensure_valid(rows, "quality", ["doc_id"]).select("doc_id", F.col(split.SPLIT).alias("split"))


@query("""
SELECT o_orderkey, split, position FROM (SELECT o_orderkey, o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders) WHERE split = 'F' ORDER BY position LIMIT 40""")
def restored_order(spark, d):
    """The first rows of a part, in the order that a frozen assignment restores."""
    rows = t(spark, d, "orders").withColumn(keys.SPLIT, F.col("o_orderstatus"))
    frozen = keys.freeze_assignment(rows, ["o_orderkey"], ["o_orderdate", "o_orderkey"]).where(f"{keys.SPLIT} = 'F'")
    return keys.restore_order(frozen).limit(40).select("o_orderkey", F.col(keys.SPLIT).alias("split"), F.col(keys.POSITION).cast("long").alias("position"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 300")
def ranking_sample(spark, d):
    return select.hash_sample(t(spark, d, "orders").select("o_orderkey", "o_custkey"), 300, ["o_orderkey"])


@query("SELECT part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT 'valid_temporal' AS part, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' UNION ALL SELECT 'valid_random', o_orderkey FROM orders WHERE o_orderkey % 7 = 0) GROUP BY 1")
def union_of_valid_parts(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    late = o.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    both = keys.union_marked({"valid_temporal": late, "valid_random": o.where("o_orderkey % 7 = 0")}, "part")
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""
WITH a AS (SELECT column_name AS c FROM (DESCRIBE orders)), b AS (SELECT column_name AS c FROM (DESCRIBE SELECT o_orderkey, o_custkey, l_tax, l_quantity FROM orders, lineitem))
SELECT 'missing' AS kind, c AS name FROM a WHERE c NOT IN (FROM b) UNION ALL SELECT 'extra', c FROM b WHERE c NOT IN (FROM a) UNION ALL SELECT 'common', c FROM a WHERE c IN (FROM b)""")
def column_algebra(spark, d):
    sets = keys.column_sets(t(spark, d, "orders").columns, ["o_orderkey", "o_custkey", "l_tax", "l_quantity"])
    return spark.createDataFrame([(k, c) for k, cs in sets.items() for c in cs], "kind string, name string")


@query("SELECT 'empty' AS feature, CASE WHEN count(x) = 0 THEN 999.0 ELSE 0.0 END::DOUBLE AS psi FROM (SELECT CASE WHEN l_quantity < 0 THEN l_quantity END AS x FROM lineitem)")
def psi_without_values(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") < 0, F.col("l_quantity")).alias("empty"))
    return drift.psi(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), ["empty"], on_error=999.0).select("feature", "psi")


@query("SELECT greatest(10, least(floor(0.7 * count(*)), 800))::BIGINT AS k FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')")
def suggested_features(spark, d):
    n = len(profile.numeric_columns(t(spark, d, "lineitem")))
    return spark.createDataFrame([(select.suggested_k(n),)], "k long")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS x, CASE WHEN l_tax > 0 THEN l_tax END AS y FROM lineitem""")
def unusable_to_null(spark, d):
    """Infinities, NaN and text that is no number become null."""
    text = F.when(F.col("l_linenumber") == 1, "n/a").when(F.col("l_linenumber") == 2, "inf").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
    wild = F.when(F.col("l_tax") > 0, F.col("l_tax")).when(F.col("l_linenumber") % 2 == 0, float("nan")).otherwise(float("-inf"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("x"), wild.alias("y"))
    return rows.select("l_orderkey", "l_linenumber", *[nulls.clean_value(rows, c, nulls.Rule("median")).alias(c) for c in ("x", "y")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_discount - 0.05) * 3, 8) AS away, (l_quantity / (SELECT count(*) FROM lineitem))::DOUBLE AS part, floor(l_extendedprice / 7)::DOUBLE AS sevenths FROM lineitem")
def builtins_in_expressions(spark, d):
    rows = t(spark, d, "lineitem")
    texts = {"away": "abs(df['l_discount'] - 0.05) * 3", "part": "df['l_quantity'] / len(df)", "sevenths": "np.floor(df['l_extendedprice'] / 7)"}
    fitted = expr.fit_interactions(rows, texts)
    out = {n: expr.interaction(rows, c) for n, (c, _, _) in fitted.items()}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(out["away"], 8).alias("away"), out["part"].alias("part"), out["sevenths"].alias("sevenths"))


NAMES = (
    "customer_id", "sk_id_curr", "id_number", "rapid", "as_of", "REPORT_DATE", "app_dt", "amt_dti", "days_birth", "month", "year_built", "cif", "mobile", "device_id", "cccd",
    "next_payment", "look_ahead", "amount", "ts", "loan_ts", "idnum", "snap",
)


@query("""
WITH n AS (SELECT unnest([""" + ", ".join(f"'{n}'" for n in NAMES) + """]) AS name)
SELECT name, list_contains(string_split(lower(name), '_')[2:], 'id') OR lower(name) = 'id' AS entity,
  lower(name) IN ('date', 'dt', 'datetime', 'timestamp', 'ts', 'snap_dt', 'snapshot', 'observation_date', 'report_date', 'as_of', 'as_of_date', 'date_decision', 'process_date', 'month_id', 'year_month', 'period', 'month', 'cohort')
    OR regexp_matches(lower(name), '_(date|dt|ts|timestamp|snap_dt|snap|month_id|year_month)$') AS date_name,
  regexp_matches(lower(name), 'date|dt|time|snap|period|month|year|week|day') AS date_part,
  regexp_matches(lower(name), 'future|next|forward|ahead|leakage') AS leak
FROM n""")
def name_roles(spark, d):
    rows = [(c, roles.is_entity_name(c), roles.is_date_name(c), roles.has_date_part(c), bool(roles.leaks_by_name([c]))) for c in NAMES]
    return spark.createDataFrame(rows, "name string, entity boolean, date_name boolean, date_part boolean, leak boolean")


@query(union([f"SELECT '{k}' AS format, count(*) AS n, sum(p_partkey)::BIGINT AS keys, round(sum(p_retailprice), 2) AS prices, count(DISTINCT p_brand) AS brands FROM part" for k in ("csv", "csv.gz", "json", "orc", "parquet", "tsv")]))
def round_trips(spark, d):
    """A table through every sink and back by suffix and codec."""
    rows = t(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    place, out = f"{scratch(spark)}/{uuid.uuid4().hex}", None
    for kind in ("csv", "csv.gz", "json", "orc", "parquet", "tsv"):
        path = f"{place}/part.{kind}"
        writers.write(rows, path)
        back = readers.load(spark, path).agg(F.count("*").alias("n"), F.sum(F.col("p_partkey").cast("long")).alias("keys"), F.round(F.sum(F.col("p_retailprice").cast("double")), 2).alias("prices"), F.count_distinct("p_brand").alias("brands"))
        back = back.select(F.lit(kind).alias("format"), "*")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT event_id, rank() OVER (ORDER BY value) AS place, round(sum(value) OVER (ORDER BY value RANGE UNBOUNDED PRECEDING), 4) AS upto FROM events")
def ranks_and_running_sums(spark, d):
    rows = t(spark, d, "events").select("event_id", "value").withColumn("one", F.lit(1))
    out = ordered.running_sums(rows, "value", {"upto": "value", "within": "one"})
    same = out.groupBy("value").agg(F.count("*").alias("same"))
    return out.join(same, "value").select("event_id", (F.col("within") - F.col("same") + 1).alias("place"), F.round("upto", 4).alias("upto"))


@query(union([f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM {SPARSE} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for k, a in enumerate(MEASURES) for b in MEASURES[k + 1 :]]))
def pairwise_correlations(spark, d):
    return select.correlations(sparse_lineitem(spark, d), MEASURES, fill="pairwise").withColumn("corr", F.round("corr", 6))
