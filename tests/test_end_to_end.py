"""Readers agree, the pipeline runs, its bundle replays, streams replay."""

import bz2
import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import encode
from tallyforge.plans import pipeline, policy, spec
from tallyforge.sources import readers, writers
from tallyforge.streaming import replay as streams


def generated(spark, n=1500, seed=3):
    z = F.randn(seed)
    df = spark.range(n).select(F.col("id").alias("customer_id"), z.alias("num_signal_1"), (5 + 2 * F.randn(seed + 1)).alias("num_signal_2"), F.randn(seed + 2).alias("num_noise"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("id") % 4 + 1).cast("int")).alias("cat_signal"), F.add_months(F.lit("2023-01-01").cast("date"), (F.col("id") % 8).cast("int")).alias("snap_dt"), F.lit(7.0).alias("junk_constant"))
    return df.withColumn("num_gap", F.when(F.col("customer_id") % 5 != 0, F.col("num_signal_2"))).withColumn("label", (F.rand(seed + 3) < 1 / (1 + F.exp(1 - 1.5 * F.col("num_signal_1")))).cast("int"))


def test_pipeline_single_table(spark, tmp_path):
    df = generated(spark).cache()
    got = pipeline.run(df, "label", "customer_id", interactions=[("ratio", "df['num_signal_1'] / (df['num_signal_2'] + 10)")], model="lr", max_psi=1e9)
    assert set(got.parts) == {"train", "valid_temporal", "valid_random", "oot"}
    assert "junk_constant" in got.replay.cleaning.drops
    assert sum(p.count() for p in got.parts.values()) == 1500
    assert got.metrics["oot"]["auc"] > 0.6
    pipeline.write_bundle(got, str(tmp_path))
    again = pipeline.load_replay(str(tmp_path))
    a, b = (x.apply(df)[0].agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0] for x in (got.replay, again))
    assert a == b
    (tmp_path / "report.md").write_text("changed")
    with pytest.raises(ValueError, match="changed"):
        pipeline.load_replay(str(tmp_path))


def test_pipeline_supplied_parts(spark):
    df = generated(spark, 900)
    shifted = df.withColumn("num_signal_1", F.col("num_signal_1") + 5)
    got = pipeline.run({"train": df, "valid": shifted, "oot": df.drop("num_noise")}, "label", "customer_id", model=None)
    found = {(i["check"], i["severity"]) for i in got.ledger.issues}
    assert ("drift", "warning") in found and ("schema", "warning") in found
    assert got.parts["valid"].count() == 900
    with pytest.raises(ValueError, match="required"):
        pipeline.run({"train": df, "valid": df.drop("label")}, "label", model=None)
    with pytest.raises(ValueError, match="target"):
        pipeline.run(df.drop("label"), "absent", model=None)  # a table with a known alias falls back to it


def test_policy_is_guarded(spark):
    df = generated(spark, 400)
    answer = '<think>{"actions": []}</think> ```json {"reasoning": "x", "actions": [{"action": "drop_column", "column": "label"}, {"action": "drop_column", "column": "cat_signal"}, {"action": "note"}, {"action": "fly"}, {"action": "drop_column", "column": "junk_constant"}]} ```'
    s, report = policy.fit_cleaning(df, policy.role_names.resolve(df.columns, "label", "customer_id"), lambda _: answer)
    assert s.drops == ("junk_constant",)
    assert len(report["warnings"]) == 3
    s, report = policy.fit_features(df.drop("snap_dt"), "label", ["customer_id"], lambda _: {"actions": [{"action": "create_interaction", "new_col": "z", "expression": "df['label'] * 2"}, {"action": "create_interaction", "new_col": "w", "expression": "open('x')"}, {"action": "encode_all"}, {"action": "apply_woe_transform"}]})
    assert len(report["warnings"]) == 2 and "label:cat_signal" in s.step_order
    assert spec.FeatureSpec.from_dict(s.to_dict()) == s
    assert policy.run_operator("check_label_quality", df, label="label").count() == 2


def test_readers_agree(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5, 10, 1), ("B", 2.25, 20, None), (None, 3.0, 30, 3)], "s string, x double, k int, n int").coalesce(1)
    pdf = df.toPandas()
    pdf.to_csv(tmp_path / "a.csv", index=False)
    text = (tmp_path / "a.csv").read_bytes()
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(text))
    (tmp_path / "a.csv.b2").write_bytes(bz2.compress(text))
    (tmp_path / "a.csv.xz").write_bytes(lzma.compress(text))
    (tmp_path / "a.tsv").write_bytes(text.replace(b",", b"\t"))
    pdf.to_feather(tmp_path / "a.feather")
    (tmp_path / "latin.csv").write_bytes("s,x\ncafé,1\n".encode("latin-1"))
    for kind in ("parquet", "orc", "jsonl"):
        writers.write(df, f"{tmp_path}/out.{kind}")
    want = encode.levels_of(df, ["s"])
    for name in ("a.csv", "a.csv.gz", "a.csv.b2", "a.csv.xz", "a.tsv", "a.feather", "out.parquet", "out.orc", "out.jsonl"):
        got = readers.load(spark, f"file://{tmp_path}/{name}")
        assert encode.levels_of(got, ["s"]) == want, name
        assert sorted(r.x for r in got.collect()) == [1.5, 2.25, 3.0]
    assert readers.load(spark, f"file://{tmp_path}/latin.csv").first().s == "café"
    (tmp_path / "bad.xlsx").write_bytes(b"nope")
    with pytest.raises(ValueError, match="not an Excel"):
        readers.load(spark, f"{tmp_path}/bad.xlsx")
    (tmp_path / "d.json").write_text('{"g": {"a": "first", "b": {"description": "second"}}, "c": "third"}')
    assert readers.load_descriptions(str(tmp_path / "d.json")) == {"a": "[g] first", "b": "[g] second", "c": "third"}


def test_replay_on_a_stream(spark, tmp_path):
    df = generated(spark, 300)
    got = pipeline.run({"train": df, "oot": df}, "label", "customer_id", model=None)
    df.write.parquet(f"{tmp_path}/in")
    rows = []
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    streams.guarded_stream(stream, got.replay, df, lambda b, _: rows.append(b.count()), f"{tmp_path}/cp").awaitTermination()
    assert sum(rows) == 300
