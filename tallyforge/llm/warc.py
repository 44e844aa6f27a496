"""WARC records and a Merkle fixity audit of replicas, in DataFrame functions only (the file reader aside).

Records lie in files in a stated order. A leaf hashes a record's offset, length and bytes; a node hashes its up to
``FANOUT`` children in order, so the root of a file covers every ordered offset range of it, and nodes over the files end in
one root of the replica. An audit compares the two roots, then the children of mismatching nodes alone, level by level,
and ends at the damaged, missing or moved records. The leaves and every level are written once, for both replicas
together; a node gathers ``FANOUT`` digests at most, and a leaf carries no payload.

Null payloads are empty and null urls are empty urls. Rows without a key are in file -1, in the order of their hashes; rows
of one key lie next to each other in that order, in parts that are numbered on their own, so that neither makes one
task. Records that are equal but for their place are different leaves. Very long payloads are hashed whole. Empty tables
have no roots and no damage. ``warc_records`` replaces columns named like its outputs; the others pass through.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

FANOUT, PER_FILE, PARTS, LOST_PARTS = 16, 256, 64, 4096


def record_bytes(key: Column, url: Column, payload: Column) -> Column:
    """One WARC/1.1 resource record."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def warc_records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """Add file, seq, offset, length and sha256 of each row's record. Files hold ``per_file`` consecutive keys."""
    df = df.drop("file", "seq", "offset", "length", "sha256")
    body = record_bytes(F.col(key), F.col(url), F.col(payload))
    slim = df.withColumn("__r", body).withColumns({"length": F.octet_length("__r").cast("long"), "sha256": F.sha2("__r", 256)}).drop("__r", payload)
    at = F.floor(F.col(key) / per_file).cast("long")
    slim = slim.withColumns({
        "file": F.when(F.col(key).isNull(), -1).when(F.col(key) < 0, at - 1).otherwise(at).cast("long"),
        "__k": F.coalesce(F.col(key), F.lit(0)),
        "__p": F.pmod(F.xxhash64("sha256"), F.when(F.col(key).isNull(), LOST_PARTS).otherwise(PARTS)),
    })
    part = ["file", "__k", "__p"]
    order = W.partitionBy(*part).orderBy("sha256")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    slim = slim.withColumns({"seq": F.row_number().over(order).cast("long") - 1, "offset": F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))})
    sums = slim.groupBy(*part).agg(F.count("*").alias("__n"), F.sum("length").alias("__b"))
    earlier = W.partitionBy("file").orderBy("__k", "__p").rowsBetween(W.unboundedPreceding, -1)  # a row a key and part: bounded for a file
    sums = sums.select(*part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long")).alias(c) for c in ("__n", "__b")])
    out = slim.join(sums, part)
    out = out.withColumns({"seq": F.col("seq") + F.col("__n"), "offset": F.col("offset") + F.col("__b")})
    return out.select(*[c for c in df.columns if c != payload], "file", "seq", "offset", "length", "sha256")


def leaf(offset: Column, length: Column, digest: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", offset.cast("string"), length.cast("string"), digest), 256))


def parents(level: DataFrame, file: Column, node: Column) -> DataFrame:
    """The next level: nodes (``file``, ``node``) over the children of a level, in the order of their own file and node."""
    up = level.groupBy("side", file.alias("f"), node.alias("u")).agg(F.sort_array(F.collect_list(F.struct("file", "node", "digest"))).alias("x"))
    return up.select("side", F.col("f").alias("file"), F.col("u").alias("node"), F.unhex(F.sha2(F.aggregate("x.digest", F.lit(b""), lambda a, d: F.concat(a, d)), 256)).alias("digest"))


def merkle_levels(replicas: list[DataFrame], fanout: int = FANOUT) -> list[tuple[DataFrame, Column, Column]]:
    """The levels of the trees of all replicas, leaves first: (side, file, node, digest), and the parent of each node.

    ``replicas``: file, seq, offset, length, sha256 each. Above the files' roots file is 0 and node counts files; the last
    level has one node a side.
    """
    leaves = None
    for side, r in enumerate(replicas):
        own = r.select(F.lit(side).alias("side"), "file", F.col("seq").alias("node"), leaf(F.col("offset"), F.col("length"), F.col("sha256")).alias("digest"))
        leaves = own if leaves is None else leaves.unionByName(own)
    level = stored(leaves, "leaves")
    seqs, files = level.agg(F.max("node"), F.max(F.abs("file"))).first()
    zero, up = F.lit(0).cast("long"), lambda c: F.floor(F.col(c) / fanout).cast("long")
    steps, span = [], 1
    while span <= (seqs or 0):  # inside the files
        steps.append((F.col("file"), up("node")))
        span *= fanout
    steps.append((zero, up("file")))  # from a file's root to nodes over files
    span = fanout
    while span <= (files or 0) + 1:
        steps.append((zero, up("node")))
        span *= fanout
    steps.append((zero, zero))
    out = []
    for file, node in steps:
        out.append((level, file, node))
        level = stored(parents(level, file, node), "level")
    return [*out, (level, zero, zero)]


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records at which two replicas differ: file, seq. Both sides: file, seq, offset, length, sha256."""
    bad = None
    for level, file, node in reversed(merkle_levels([left, right], fanout)):
        if bad is not None:
            level = level.withColumns({"__f": file, "__u": node}).join(bad.select(F.col("file").alias("__f"), F.col("node").alias("__u")), ["__f", "__u"], "left_semi")
        of = lambda side: F.max(F.when(F.col("side") == side, F.col("digest")))
        pair = level.groupBy("file", "node").agg(of(0).alias("a"), of(1).alias("b"))
        bad = pair.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")
    return bad.withColumnRenamed("node", "seq")


def parse_warc(data: bytes | BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """Offset, length, headers, payload and all bytes of each record of a WARC file, compressed by record or as a whole or not at all.

    Reads one record at a time; offsets are those of the uncompressed file. Ends at the first broken record.
    """
    source = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data)
    if source.peek(2)[:2] == b"\x1f\x8b":
        source = io.BufferedReader(gzip.GzipFile(fileobj=source))
    at = 0
    while True:
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            line = source.readline()
            if not line:
                return
            head += line
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields.get("content-length", 0))
        body = source.read(size)
        tail = source.read(4)
        if len(body) < size:
            return
        length = len(head) + size + len(tail)
        yield at, length, fields, body, head + body + tail
        at += length


RECORD = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("sha256", pa.string())])


def read_warc(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Records of the .warc and .warc.gz files under ``path``: file, seq, offset, length, url, payload, sha256 of the whole record.

    A task reads its files record by record through Arrow's file systems; with ``stream`` off Spark's own reader fetches each
    file whole, for stores that Arrow cannot open.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                if stream:
                    store, name = fs.FileSystem.from_uri(row["path"])
                    source = store.open_input_file(name)
                else:
                    source = row["content"]
                for k, (at, n, head, body, whole) in enumerate(parse_warc(source)):
                    yield pa.RecordBatch.from_pylist([{"file": row["path"], "seq": k, "offset": at, "length": n, "url": head.get("warc-target-uri"), "payload": body, "sha256": hashlib.sha256(whole).hexdigest()}], RECORD)

    files = spark.read.format("binaryFile").load(path).select("path", *([] if stream else ["content"]))
    return files.mapInArrow(run, "file string, seq long, offset long, length long, url string, payload binary, sha256 string")
