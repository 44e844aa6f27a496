"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC; ``conf`` overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir; where it is unset, a local one in local mode, else the warehouse's."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return f"{place.rstrip('/')}/tallyforge"
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        import tempfile

        return "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tallyforge-scratch"
