"""URL filters: longest-match host/path rules, then a logistic regression on hashed character n-grams.

``fit_url_model`` trains on a small labelled URL table (columns url, label 0/1), such as ``url_labels.labelled_urls``;
``max_train`` bounds the rows it takes, the ones with the smallest URL hash. ``apply_url_filter`` gives every row host, path, rule, score and verdict. All of it
is DataFrame functions and Spark ML's JVM transformers; the html of a page is never read.

A null url or one without ``://`` has an empty host and path and no rule; the model then judges the empty n-grams.
Repeated rows are judged alike, each on its own. Texts of any length are judged whole. With no labels, or one class only, the verdict
without a rule is the labels' majority (allow if there are none). Empty tables give empty results; columns named like
an output are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed values: (verdict, host with its path prefix).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
OUTPUTS = ("host", "path", "rule", "score", "verdict")


@dataclass(frozen=True)
class UrlModel:
    """A fitted pipeline, or None and the one verdict that the labels allow."""

    pipeline: PipelineModel | None
    constant: str = "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def grams(text: Column, mark: str, n: int) -> Column:
    """The character n-grams of ``text``, each behind ``mark``; shorter texts are one gram, empty ones none."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def features(host: Column, path: Column) -> Column:
    padded = lambda c: F.when(c == "", c).otherwise(F.concat(F.lit("^"), c, F.lit("$")))
    return F.concat(*[grams(padded(c), f"{m}{n}:", n) for c, m in ((host, "h"), (path, "p")) for n in (3, 4)])


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_features(df: DataFrame, url: str) -> DataFrame:
    host, path = host_path(F.col(url))
    return df.withColumns({"host": host, "path": path}).withColumn("__grams", features(F.col("host"), F.col("path")))


def fit_url_model(labelled: DataFrame, url: str = "url", label: str = "label", bins: int = 1 << 16, max_train: int = 4000, reg: float = 0.1, iterations: int = 40) -> UrlModel:
    """Train on at most ``max_train`` rows with a url and a label; label 1 means block."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_train)
    blocked, total = rows.agg(F.sum("label"), F.count("*")).first()
    if not total or blocked in (0, total):
        return UrlModel(None, "block" if total and blocked else "allow")
    tf = HashingTF(inputCol="__grams", outputCol="__tf", numFeatures=bins, binary=True)
    lr = LogisticRegression(featuresCol="__tf", labelCol="label", predictionCol="__class", rawPredictionCol="__raw", probabilityCol="__p", regParam=reg, maxIter=iterations)
    return UrlModel(Pipeline(stages=[tf, lr]).fit(with_features(rows, "url")))


def apply_url_filter(df: DataFrame, model: UrlModel, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, score (the model's chance of block) and verdict to every row."""
    df = with_features(df.drop(*OUTPUTS), url)
    if model.pipeline is None:
        df = df.withColumn("score", F.lit(1.0 if model.constant == "block" else 0.0))
    else:
        df = model.pipeline.transform(df).withColumn("score", vector_to_array("__p")[1])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return df.withColumns({"rule": rule, "verdict": F.coalesce(verdict, judged)}).drop("__grams", "__tf", "__raw", "__p", "__class")
