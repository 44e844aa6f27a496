"""Byte-level BPE encoding and decoding with a segment tree.

Each match of the split pattern is merged on its own. A segment tree over the byte positions of the piece holds the
rank of the pair that starts at each live token; its root is the leftmost pair of least rank. A merge
sets three leaves (the pair itself, its left neighbour, its right neighbour), each a logarithmic walk to the root, so a
piece of n bytes takes O(n log n) however long it is. Each Python worker keeps the encodings of recent space-separated
segments in two bounded generations.

Nulls and empty texts have no ids and decode to nothing. Very long texts are encoded whole; batches are cut by bytes.
Repeated rows are encoded alike. Empty tables give empty results. Columns named like an output are replaced; the others
pass through.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = 1 << 60
#: A fixed value: the split pattern for which space-separated segments can be encoded on their own.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text bytes that go through Python at once, and segments in one generation of the cache.
SLICE_BYTES, KEPT = 4 << 20, 400_000


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    get = ranks.get
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) < NONE:
        i = best & (width - 1)
        j = after[i]
        end = after[j]
        after[i] = end
        tree[width + j] = NONE
        changed = [width + j, width + i]
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            tree[width + i] = NONE if r is None else r * width + i
        else:
            tree[width + i] = NONE
        if i:
            p = before[i]
            r = get(piece[p:end])
            tree[width + p] = NONE if r is None else r * width + p
            changed.append(width + p)
        for k in changed:
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Ranks, their inverse, the split pattern and a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.vocabulary = ranks, {v: k for k, v in ranks.items()}
        self.split, self.spaced = regex.compile(pattern).findall, pattern == SPACED
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.piece = lru_cache(maxsize=KEPT // 2)(lambda x: merge_piece(x.encode("utf-8"), self.ranks))

    #: A space that white space or the end follows: the pieces around it can't be told from the segments alone.
    odd = re.compile(r" (?:\s|\Z)")

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches; Latin words, with one mark at the end or none, need no regular expression."""
        body = text[1:] if text[0] == " " else text
        if body.isalpha():
            if max(body) < "\u0250":
                return [text]
        elif body[-1:] in ".,;:!?" and body[:-1].isalpha() and max(body) < "\u0250":
            return [text[:-1], body[-1]]
        return self.split(text)

    def segment(self, text: str) -> bytes:
        if (out := self.old.get(text)) is None:
            ids = array("I")
            for piece in self.pieces(text):
                ids.extend(self.piece(piece) if len(piece) < 64 else merge_piece(piece.encode("utf-8"), self.ranks))
            out = ids.tobytes()
        if len(text) < 64:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[text] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.spaced:
            return b"".join([array("I", merge_piece(x.encode("utf-8"), self.ranks)).tobytes() for x in self.split(text)])
        if self.odd.search(text):
            parts = self.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [" " + x for x in rest]
            if first:
                parts.insert(0, first)
        find, make = self.young.get, self.segment
        return b"".join([find(x) or make(x) for x in parts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes in ``column`` each, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = [0 if x is None else x for x in pa.compute.binary_length(col).to_pylist()] if len(col) else []
    start = total = 0
    for k, x in enumerate(sizes):
        if total and total + x > most:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += x
    if start < len(sizes):
        yield batch.slice(start)


def encode_bpe(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) and, unless it is None, ``decoded`` (binary)."""
    df = df.drop(*(c for c in (ids, decoded) if c))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.BinaryType()) for c in (ids, decoded) if c)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        own = codec(ranks_path, pattern)
        for batch in batches:
            for part in by_bytes(batch, text):
                made = [own.encode(x) for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                part = part.append_column(ids, pa.array(made, pa.binary()))
                if decoded:
                    part = part.append_column(decoded, pa.array([own.decode(x) for x in made], pa.binary()))
                yield part

    return df.mapInArrow(run, schema)


def decode_bpe(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary) from packed ``ids``; null ids decode to nothing."""
    df = df.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield batch.append_column(decoded, pa.array([own.decode(x or b"") for x in col], pa.binary()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())]))


def id_array(ids: str = "ids"):
    """Packed ids as an array column of longs."""
    whole = F.hex(F.col(ids))
    flip = lambda i: F.conv(F.concat(*[F.substring(whole, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    none = F.array().cast("array<bigint>")
    return F.when(F.length(ids) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1), flip))
