"""All queries of the library and their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import expr
from tallyforge.operators import clean, drift, encode, nulls, split, train
from tallyforge.plans import more_queries, queries, spec



def replay_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted replay (clip, null policy, codes, an interaction) after a round trip through JSON, on all rows."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("double")).alias("gap"))
    cleaning = clean.CleaningSpec(clip_bounds=clean.fit_clip(rows, ["o_totalprice"], 0.1))
    cleaned = cleaning.apply(rows)
    policy = nulls.fit_nulls(cleaned, {"gap": nulls.Rule("median", True)})
    filled = policy.apply(cleaned)
    compiled, fill, _ = expr.fit_interaction(filled, "df['o_totalprice'] / (df['gap'] + 1)")
    features = spec.FeatureSpec(("label:o_orderpriority", "interaction:ratio"), (spec.Interaction("ratio", compiled.text, fill, compiled.stats),), encode.fit_labels(filled, ["o_orderpriority"]))
    body = json.loads(json.dumps(spec.Replay(cleaning, policy, features).to_dict()))
    out, _ = spec.Replay.from_dict(body).apply(rows)
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), F.col("o_orderpriority").cast("long").alias("o_orderpriority"), "gap", "gap_missing", F.round("ratio", 6).alias("ratio"))


REPLAY_SQL = """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders), g AS (SELECT quantile_cont(o_custkey::DOUBLE, 0.5) AS m FROM orders WHERE o_custkey % 3 <> 0), v AS (SELECT list_sort(list_append(list(DISTINCT o_orderpriority), '__NA__')) AS v FROM orders),
f AS (SELECT o_orderkey, greatest(least(o_totalprice, q[2] + 0.1 * (q[2] - q[1])), q[1] - 0.1 * (q[2] - q[1])) AS o_totalprice, list_position(v, o_orderpriority) - 1 AS o_orderpriority, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey::DOUBLE ELSE m END AS gap, (o_custkey % 3 = 0)::TINYINT AS gap_missing FROM orders, q, g, v)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority, gap, gap_missing, round(o_totalprice / (gap + 1), 6) AS ratio FROM f"""


def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold calibrated models on labelled documents; every labelled document's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("lines"), F.size(F.split("text", " ")).alias("words"))
    rows = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").withColumn("bad", (F.col("quality") == 0).cast("int"))
    scorer, _ = train.fit_final(rows, ["n_chars", "lines", "words"], "bad", ["doc_id"], "lr", folds=3, seeds=1)
    return scorer.score(rows, ["doc_id", "bad"])


QUERIES = {**more_queries.QUERIES, "replay_spec": replay_spec, "train_and_score": train_and_score}
SQL = {**more_queries.SQL, "replay_spec": REPLAY_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet scan, month periods, holdout cut, then the drift of four measures between train and holdout."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = split.fit_split(rows, "l_shipdate")
    period = split.period_of(F.col("l_shipdate")).cast("string")
    train, hold = rows.where(~period.isin(*plan.oot_periods)), rows.where(period.isin(*plan.oot_periods))
    return drift.drift_report(train.select(*queries.MEASURES), hold.select(*queries.MEASURES), top=10)
