"""Shared helpers: table access, shared scratch space and lambda-bound values."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[ \x09-\x0D]"
#: Bytes of a row group in the shared folder: a task holds one as it writes and one as it reads (Parquet's own 128 MB, by the cores).
GROUP_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a local one in local mode, else the warehouse's."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            import tempfile

            place = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        else:
            place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tallyforge-scratch"
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyforge/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """White-space separated words as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+"), lambda w: w != "")
