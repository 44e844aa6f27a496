"""Substring dedup by content-defined chunking.

A gear rolling hash over 16 bytes cuts a text where its five top bits are zero, between ``least`` and ``most`` bytes
apart, so an insertion moves boundaries only around itself. Chunks meet by 128-bit digest: all but the one in the
smallest doc_id (there, the first) are repeats. A lone repeated chunk is a phrase; a stretch of neighbouring repeats of
``stretch`` bytes or more is a passage and is removed. Chunks are cut once and stored. Counting is a partial aggregation by
digest and the verdict a join on it over ``SALTS`` salts, so a chunk that a third of all documents share is dealt over many tasks.

Nulls and empty texts have no chunks, and rows without an id keep everything. Rows that share an id count as one document:
neither removes the other's chunks, and a range that is removed in one is removed in all. Very long texts are chunked whole. Empty tables give empty results. Columns named like an output are replaced; the
others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_bytes
from .common import shared_dir, stored
from .spans import cut_spans

LEAST, MOST, TOP_BITS = 32, 256, 5
STRETCH, SALTS = 128, 8


def gear_table(seed: int = 11) -> np.ndarray:
    """256 fixed random 16-bit values."""
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([seed, k]), digest_size=2).digest() for k in range(256)), "<u2")


GEAR = gear_table()


def boundaries(data: bytes, least: int = LEAST, most: int = MOST, bits: int = TOP_BITS) -> list[int]:
    """Where the chunks of ``data`` end."""
    n = len(data)
    if not n:
        return []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        if n > step:
            h = h.copy()
            h[step:] += h[:-step].copy() << np.uint16(step)
    out, last = [], 0
    for at in (np.flatnonzero(h < (1 << (16 - bits))) + 1).tolist():
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least:
            out.append(at)
            last = at
    while n - last > most:
        last += most
        out.append(last)
    if n > last:
        out.append(n)
    return out


def chunks(df: DataFrame, doc_id: str, text: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """A row for each distinct chunk of a document (__id, h1, h2, at, size, n) and for each repeat in it (own true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in by_bytes(batch, "__t"):
                ids, digests, at, size, own = [], [], [], [], []
                for i, x in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    last, seen = 0, set()
                    for end in boundaries(x or b"", least, most):
                        d = hashlib.blake2b(x[last:end], digest_size=16).digest()
                        ids.append(i)
                        digests.append(d)
                        at.append(last)
                        size.append(end - last)
                        own.append(d in seen)
                        seen.add(d)
                        last = end
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(own, pa.bool_())], names=["__id", "h1", "h2", "at", "size", "own"])

    src = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where("__id is not null and __t is not null")
    kind = src.schema["__id"].dataType.simpleString()
    return src.mapInArrow(run, f"__id {kind}, h1 long, h2 long, at long, size int, own boolean")


def find_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """For each document with repeated chunks: __id, __starts, __ends (byte ranges to remove) and n_dup_chunks."""
    shared_dir(df.sparkSession)
    all_ = stored(chunks(df, doc_id, text, least, most), "chunks")
    first = all_.where("not own").groupBy("h1", "h2").agg(F.min("__id").alias("first"), F.count("*").alias("docs")).where("docs > 1").drop("docs")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = all_.where("not own").withColumn("salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)))
    again = own.join(first, ["h1", "h2", "salt"]).where("__id > first").select("__id", "at", "size")
    both = again.unionByName(all_.where("own").select("__id", "at", "size"))
    out = both.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("x"))
    return out.select("__id", F.col("x.at").alias("__starts"), F.transform("x", lambda x: x["at"] + x["size"]).alias("__ends"))


def dedup_chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, most: int = MOST, stretch: int = STRETCH) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, n_dup_chunks (repeats, lone ones too) and ``kept`` (the bytes left) to every row of ``df``."""
    found = find_repeats(df, doc_id, text, least, most)
    return cut_spans(df.drop("n_dup_chunks"), found, doc_id, text, shortest=stretch).withColumnRenamed("n_found", "n_dup_chunks")
