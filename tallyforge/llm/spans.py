"""Cutting byte spans out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import by_bytes


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the half-open ranges; touching ranges are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def whole_characters(x: bytes, start: int, end: int) -> tuple[int, int]:
    """The range without the parts of UTF-8 characters at its ends."""
    while start < end and x[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(x) and x[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def cut_spans(df: DataFrame, spans: DataFrame, doc_id: str, text: str, whole: bool = False, shortest: int = 1) -> DataFrame:
    """Cut byte ranges out of each text.

    ``spans`` has one row for each id: ``__id``, ``__starts`` and ``__ends`` (arrays). Every row of ``df`` gets n_bytes,
    n_removed, n_found (ranges as given), n_spans (maximal runs) and ``kept`` (binary: what is left). Runs of fewer than
    ``shortest`` bytes stay. With ``whole``, characters stay whole at the ends of a run. Ids without spans keep everything;
    nulls count as empty; ranges end where a text ends.
    """
    df = df.drop("n_bytes", "n_removed", "n_found", "n_spans", "kept", "__id", "__starts", "__ends")
    keep = df.schema.fields
    joined = df.join(spans, df[doc_id] == spans["__id"], "left").drop("__id")
    more = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_found", "n_spans")] + [T.StructField("kept", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        names = [f.name for f in keep]
        for batch in batches:
            for part in by_bytes(batch, text):
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                raw = get(text).cast(pa.binary()).to_pylist()
                n, cut, given, runs, left = [], [], [], [], []
                for x, s, e in zip(raw, get("__starts").to_pylist(), get("__ends").to_pylist(), strict=True):
                    x = x or b""
                    spans_ = [(a, min(b, len(x))) for a, b in (merged(s, e) if s else ()) if b - a >= shortest and a < len(x)]
                    if whole:
                        spans_ = [(a, b) for a, b in (whole_characters(x, a, b) for a, b in spans_) if a < b]
                    n.append(len(x))
                    given.append(len(s or ()))
                    cut.append(sum(b - a for a, b in spans_))
                    runs.append(len(spans_))
                    if spans_:
                        edges = [0, *(y for span in spans_ for y in span), len(x)]
                        x = b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    left.append(x)
                out = [get(c) for c in names] + [pa.array(v, pa.int64()) for v in (n, cut, given, runs)] + [pa.array(left, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=[*names, "n_bytes", "n_removed", "n_found", "n_spans", "kept"])

    return joined.mapInArrow(run, T.StructType([*keep, *more]))
