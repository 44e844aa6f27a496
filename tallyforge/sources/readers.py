"""Readers by suffix, and the normalisation that makes their results agree."""

from __future__ import annotations

import bz2
import codecs
import csv
import gzip
import io
import json
import lzma
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes by codec, and the encodings tried in order.
CODECS = {".gz": "gzip", ".bz2": "bz2", ".b2": "bz2", ".xz": "xz", ".zst": "zstd", ".zip": "zip"}
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
NATIVE_CODECS = ("gzip", "bz2", "zstd")
EXCEL_MAGIC = {b"PK\x03\x04": "openpyxl", b"\xd0\xcf\x11\xe0": "xlrd"}


def suffixes(path: str) -> tuple[str, str | None]:
    """The inner suffix and the codec: ``a.csv.gz`` is (.csv, gzip)."""
    p = Path(path.split("?")[0])
    codec = CODECS.get(p.suffix.lower())
    return (Path(p.stem).suffix.lower() if codec else p.suffix.lower()), codec


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def unpack(path: str, codec: str) -> str:
    """A local copy without a codec that Spark can't read (xz, zip) or names otherwise (.b2)."""
    raw = Path(path.removeprefix("file://")).read_bytes()
    if codec == "zip":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            raw = z.read(z.namelist()[0])
    else:
        raw = {"xz": lzma.decompress, "bz2": bz2.decompress, "gzip": gzip.decompress}[codec](raw)
    out = Path(tempfile.mkdtemp()) / ("data" + suffixes(path)[0])
    out.write_bytes(raw)
    return f"file://{out}"


def encoding_of(path: str, codec: str | None = None, size: int = 1 << 20) -> str:
    """The first encoding that decodes all of a local file, read in pieces; UTF-8 for what only Spark can read."""
    if is_remote(path):
        return "utf-8"
    p = Path(path.removeprefix("file://"))
    p = next((x for x in sorted(p.iterdir()) if x.is_file() and x.name[0] not in "._"), p) if p.is_dir() else p
    opened = lambda: {"gzip": gzip.open, "bz2": bz2.open}.get(codec, open)(p, "rb")

    def decodes(encoding: str) -> bool:
        decoder = codecs.getincrementaldecoder(encoding)()
        with opened() as f:
            try:
                while piece := f.read(size):
                    decoder.decode(piece)
                decoder.decode(b"", True)
            except UnicodeDecodeError:
                return False
        return True

    try:
        with opened() as f:
            if f.read(3) == b"\xef\xbb\xbf":
                return "utf-8-sig"
        return next((e for e in ENCODINGS if decodes(e)), "latin-1")
    except OSError:
        return "utf-8"


def read_csv(spark: SparkSession, path: str, sep: str = ",", codec: str | None = None, multi_line: bool = True) -> DataFrame:
    name = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}[encoding_of(path, codec)]
    if name == "windows-1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark's own list lacks it
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep, encoding=name, quote='"', escape='"', multiLine=multi_line and codec is None)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow.feather as feather

    return spark.createDataFrame(feather.read_table(path.removeprefix("file://")))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """By magic bytes; the engines are optional, and a missing one is named in the error."""
    with open(path.removeprefix("file://"), "rb") as f:
        engine = EXCEL_MAGIC.get(f.read(4))
    if engine is None:
        raise ValueError(f"{path} is not an Excel file: neither a zip nor an OLE2 container")
    import importlib.util

    if importlib.util.find_spec(engine) is None:
        raise ImportError(f"reading {path} needs the package {engine}")
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path.removeprefix("file://"), engine=engine))


def configure_s3(spark: SparkSession, key: str | None = None, secret: str | None = None, endpoint: str | None = None, region: str | None = None) -> None:
    """Hadoop settings for s3a:// paths."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in (("fs.s3a.access.key", key), ("fs.s3a.secret.key", secret), ("fs.s3a.endpoint", endpoint), ("fs.s3a.endpoint.region", region)):
        if value:
            conf.set(name, value)


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is a whole record, so that the file can be split by lines."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    line = first[0].strip() if first else ""
    return line.startswith("{") and line.endswith("}")


def load(spark: SparkSession, path: str, normalised: bool = True, multi_line: bool = True) -> DataFrame:
    """Read a table by its suffix; folders and paths without a known suffix are Parquet if they look so, else CSV.

    ``multi_line``: whether CSV values may hold line breaks. Turn it off for large files, which are then split over tasks.
    """
    for scheme in ("s3://", "s3n://"):
        path = path.replace(scheme, "s3a://", 1) if path.startswith(scheme) else path
    kind, codec = suffixes(path)
    if codec and (codec not in NATIVE_CODECS or path.lower().endswith(".b2")):
        path, codec = unpack(path, codec), None
    if kind in (".parquet", ".pq") or kind == "" and Path(path.removeprefix("file://")).is_dir():
        df = spark.read.parquet(path)
    elif kind == ".orc":
        df = spark.read.orc(path)
    elif kind in (".feather", ".ftr"):
        df = read_feather(spark, path)
    elif kind in (".xlsx", ".xls"):
        df = read_excel(spark, path)
    elif kind == ".json":
        df = spark.read.option("multiLine", not is_json_lines(spark, path)).json(path)
    elif kind in (".jsonl", ".ndjson"):
        df = spark.read.json(path)
    else:
        df = read_csv(spark, path, "\t" if kind in (".tsv", ".tab") else ",", codec, multi_line)
    return normalise(df) if normalised else df


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    """The schema alone: a Parquet or ORC footer, else a lazy read."""
    return load(spark, path, False).schema


def head(df: DataFrame, n: int = 100_000, by: str | None = None) -> DataFrame:
    """The first ``n`` rows, by the order of ``by`` where it is given."""
    return (df.orderBy(by) if by else df).limit(n)


def normalise(df: DataFrame, dates_as_text: bool = False) -> DataFrame:
    """Types that don't depend on the reader: decimals are doubles, NaN is null, and dates may become ISO text."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            out[f.name] = c.cast("double")
        elif isinstance(f.dataType, T.FloatType | T.DoubleType):
            out[f.name] = F.when(~F.isnan(c), c)
        elif dates_as_text and isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            midnight = df.agg(F.bool_and(F.date_trunc("DAY", c) == c)).first()[0]
            out[f.name] = F.date_format(c, "yyyy-MM-dd" if midnight is not False else "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(out) if out else df


def load_descriptions(path: str) -> dict[str, str]:
    """{column: "[group] text"} from flat or nested JSON (up to three levels), CSV or Parquet."""
    kind = Path(path).suffix.lower()
    if kind == ".json":
        out: dict[str, str] = {}

        def walk(node: dict, groups: list[str]) -> None:
            for k, v in node.items():
                if isinstance(v, dict):
                    text = v.get("description") or v.get("desc")
                    if isinstance(text, str):
                        out[k] = f"[{groups[-1]}] {text}" if groups else text
                    else:
                        walk(v, [*groups, k])
                else:
                    out[k] = f"[{groups[-1]}] {v}" if groups else str(v)

        walk(json.loads(Path(path).read_text()), [])
        return out
    if kind in (".parquet", ".pq"):
        import pyarrow.parquet as pq

        rows = pq.read_table(path).to_pylist()
    else:
        rows = list(csv.DictReader(io.StringIO(Path(path).read_text(encoding=encoding_of(path)))))
    if not rows:
        return {}
    names = {c.lower(): c for c in rows[0]}
    col = next((names[n] for n in ("column", "column_name", "name", "feature", "field") if n in names), list(rows[0])[0])
    text = next((names[n] for n in ("description", "desc", "text", "comment") if n in names), list(rows[0])[-1])
    group = next((names[n] for n in ("group", "category", "table", "source") if n in names), None)
    return {r[col]: f"[{r[group]}] {r[text]}" if group and r[group] else str(r[text]) for r in rows if r[col]}


def grouped_descriptions(found: dict[str, str], most: int = 50) -> dict[str, list[str]]:
    """Columns by their ``[group]``, ``most`` for each at most."""
    out: dict[str, list[str]] = {}
    for name, text in found.items():
        group = text[1 : text.index("]")] if text.startswith("[") and "]" in text else "other"
        if len(out.setdefault(group, [])) < most:
            out[group].append(name)
    return out
