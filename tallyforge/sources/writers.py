"""Sinks: tables by suffix, JSON reports, split assignments."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame

from tallyforge.sources.readers import suffixes


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet (snappy) unless the suffix says CSV, TSV, JSON (a record a line) or ORC; .gz and .bz2 compress text."""
    kind, codec = suffixes(path)
    out = df.write.mode(mode)
    out = out.option("compression", {"bz2": "bzip2"}.get(codec, codec)) if codec else out
    if kind in (".csv", ".tsv", ".tab"):
        out.option("header", True).option("sep", "," if kind == ".csv" else "\t").option("escape", '"').csv(path)
    elif kind in (".json", ".jsonl"):
        out.json(path)
    elif kind == ".orc":
        out.orc(path)
    else:
        out.option("compression", "snappy").parquet(path)


def write_stage(parts: dict[str, DataFrame], folder: str, stage: str) -> dict[str, str]:
    """One Parquet table for each partition of a stage: {partition: path}."""
    paths = {name: f"{folder.rstrip('/')}/{stage}_{name}.parquet" for name in parts}
    for name, df in parts.items():
        write(df, paths[name])
    return paths


def plain(value: object) -> object:
    """JSON-ready: infinities and NaN as text, sets and tuples as lists."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [plain(v) for v in (sorted(value, key=str) if isinstance(value, set | frozenset) else value)]
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if value is None or isinstance(value, bool | int | float | str):
        return value
    return str(value)


def write_json(report: dict, path: str) -> None:
    p = Path(path.removeprefix("file://"))
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(plain(report), indent=1, ensure_ascii=False))
