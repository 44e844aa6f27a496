"""N-gram Jaccard join: MinHash bands for candidates, full n-gram sets for the verdict.

``choose_bands`` takes rows a band and bands for a target recall at the threshold. Texts with the same n-gram set are one
class, joined by its 128-bit hash, and only its least id goes on. Band hashes that two classes or more share form
buckets. The bytes of a text travel once to its buckets, which are dealt in blocks of at most ``block`` members a side, so
a bucket of any size is compared block pair by block pair and no pair becomes a row. A pair counts in the first band it
shares. Each block pair gives its members' link counts and a spanning forest of their links; the forests' connected
components are the groups.

Ids are integers. Every row gives one row: rows that repeat an id and a text are documents that link with each other; rows
of one id with different texts each have their own class and links, and share a group. A row with a null id takes no part:
its class and group are null and it has no links. Null texts and texts without words have no n-grams, link with
nothing and are their own group. A text of fewer words than ``n`` is one n-gram. Ties break to the least id. Texts of any
length are read whole. Empty tables give empty results. Other columns are not carried.

What joins rows with their class is dealt over ``SALTS`` salts, so a class that a third of all rows share is no one task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import one_thread
from .bpe import by_bytes
from .common import shared_dir, stored
from .components import connected_components
from .shingles import U, mix, shingle_sets

N, THRESHOLD, RECALL = 5, 0.8, 0.999
BLOCK, SALTS = 512, 4


def choose_bands(threshold: float, recall: float, most: int = 12) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which ``most`` bands or fewer reach ``recall`` at ``threshold``.

    Where no row count does, as many bands of one row as the recall needs.
    """
    best = None
    for rows in range(1, 9):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands <= most or best is None:
            best = (bands, rows)
    return best


def minhashes(sets: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHashes of each non-empty set, as a row each."""
    rng = np.random.Generator(np.random.PCG64(23))
    a = rng.integers(0, 1 << 64, count, dtype=np.uint64) | U(1)
    b = rng.integers(0, 1 << 64, count, dtype=np.uint64)
    full = sizes[sizes > 0]
    begin = np.concatenate(([0], np.cumsum(full)[:-1]))
    out = np.empty((len(full), count), np.uint64)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(mix_short(sets * a[k] + b[k]), begin)
    return out


def mix_short(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> U(31))) * U(0xD6E8FEB86659FD93)


def band_hashes(sets: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m = minhashes(sets, sizes, bands * rows)
    out = np.empty((len(m), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands):
            h = np.full(len(m), k, np.uint64)
            for r in range(rows):
                h = mix(h * U(0x9E3779B97F4A7C15) + m[:, k * rows + r])
            out[:, k] = h
    return out.view(np.int64)


def set_hashes(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each non-empty set."""
    begin = np.concatenate(([0], np.cumsum(sizes[sizes > 0])[:-1]))
    sums = np.add.reduceat(sets, begin), np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), begin)
    return sums[0].view(np.int64), sums[1].view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """For each row: id, two set hashes, the set's size and its band hashes; zeros and no hashes where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in by_bytes(batch, "__t", 1 << 20):
                sets, sizes = shingle_sets([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()], n)
                keep = sizes > 0
                k1, k2 = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                flat = np.zeros(0, np.int64)
                if keep.any():
                    k1[keep], k2[keep] = set_hashes(sets, sizes)
                    flat = band_hashes(sets, sizes, bands, rows).ravel()
                ends = np.concatenate(([0], np.cumsum(keep) * bands))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k1), pa.array(k2), pa.array(sizes), lists], names=["id", "k1", "k2", "size", "bands"])

    return docs.mapInArrow(run, "id long, k1 long, k2 long, size long, bands array<long>")


MEMBER = "key long, pair long, block long, band int, id long, k1 long, copies long, bands binary, grams binary"


def members(n: int, block: int):
    """Each candidate text's n-gram set, once for every block pair of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in by_bytes(batch, "__t", 1 << 20):
                col = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
                sets, sizes = shingle_sets(part.column(part.schema.get_field_index("__t")).cast(pa.binary()).to_pylist(), n)
                ends = np.cumsum(sizes)
                out: list[list] = [[] for _ in range(9)]
                for i, k1, own, copies, hashes, buckets, end, size in zip(col("id"), col("k1"), col("__h"), col("copies"), col("bands"), col("buckets"), ends, sizes, strict=True):
                    mine = sets[end - size : end]
                    if not size or set_hashes(mine, np.array([size]))[0][0] != k1:
                        continue  # another text of the same id
                    grams = mine.tobytes()
                    packed = np.array(hashes, np.int64).tobytes()
                    for b in buckets:
                        blocks = -(-b["g"] // block)
                        here = own % blocks
                        for other in range(blocks):
                            low, high = min(here, other), max(here, other)
                            for k, v in enumerate((b["key"], low * blocks + high, here if low != high else -1, b["band"], i, k1, copies, packed, grams)):
                                out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["key", "pair", "block", "band", "id", "k1", "copies", "bands", "grams"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; elements of one set alone are left out first."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    total = np.zeros((n, n), np.int64)
    width = max(64, (1 << 22) // max(n, 1))
    for at in range(0, int(common.sum()), width):
        here = slice(*np.searchsorted(column, (at, at + width)))
        grid = np.zeros((n, width if n > 1 else 1), np.float32)
        grid[owner[here], column[here] - at] = 1
        total += np.rint(grid @ grid.T).astype(np.int64)
    return total


def compare(rows: list[tuple], threshold: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, k1, links, root) for the members of one block pair that link; ``threshold`` in thousandths."""
    rows = list({(r[4], r[5]): r for r in rows}.values())
    band = rows[0][3]
    cross = rows[0][2] >= 0
    block, ids, k1, copies = (np.array([r[k] for r in rows]) for k in (2, 4, 5, 6))
    sets = [np.frombuffer(r[8], np.uint64) for r in rows]
    hashes = np.frombuffer(b"".join(r[7] for r in rows), np.int64).reshape(len(rows), -1)
    size = np.array([len(s) for s in sets])
    link = ~np.eye(len(rows), dtype=bool)
    if cross:
        link &= block[:, None] != block[None, :]
    for k in range(band):
        link &= hashes[:, None, k] != hashes[None, :, k]
    if not link.any():
        return
    shared = shared_counts(sets)
    link &= 1000 * shared >= threshold * (size[:, None] + size[None, :] - shared)
    links = link @ copies
    root = ids.copy()
    while True:
        low = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(root, low)
        if (new == root).all():
            break
        root = new
    for k in np.flatnonzero(links):
        yield int(ids[k]), int(k1[k]), int(links[k]), int(root[k])


def verify(threshold: int):
    """Compare sorted (key, pair) groups, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        out: list[tuple[int, int, int, int]] = []
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            a = np.array(out, np.int64).reshape(-1, 4)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, k])) for k in range(4)], names=["id", "k1", "links", "root"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    if len(held) > 1:
                        out.extend(compare(held, threshold))
                    held = []
                held.append(row)
                if len(out) > 20_000:
                    yield batch()
        if len(held) > 1:
            out.extend(compare(held, threshold))
        yield batch()

    return run


def join_ngrams(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each id: class_id (least id of its n-gram set), group_id (least id linked, over any steps), n_links.

    n_links counts the other documents whose Jaccard similarity with it is ``threshold`` or more.
    """
    shared_dir(df.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    docs = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__t"))
    signed = stored(signatures(docs, n, bands, rows), "signatures")
    full = signed.where("size > 0 and id is not null")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    classes = full.groupBy("k1", "k2", "size").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1")
    classes = stored(classes, "classes")  # so that the join below deals both sides itself
    member = full.select("*", salt).join(classes.select("*", salts), ["k1", "k2", "size", "salt"], "left")
    member = member.select("id", "k1", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "bands")
    member = stored(member, "members")
    heads = member.where("id = class_id").select("id", "k1", "copies", "bands")
    spread = heads.select("id", "k1", F.posexplode("bands").alias("band", "hash")).select("id", "k1", "band", F.xxhash64("band", "hash").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("g")).where("g > 1")
    buckets = spread.join(shared, "key").groupBy("id", "k1").agg(F.collect_set(F.struct("key", "band", "g")).alias("buckets"))
    asked = heads.join(buckets, ["id", "k1"]).withColumn("__h", F.pmod(F.xxhash64("id", "k1"), F.lit(1 << 30)))
    sent = docs.where("__t is not null").join(asked, docs["__id"] == asked["id"]).select("__t", "id", "k1", "__h", "copies", "bands", "buckets")
    sent = sent.mapInArrow(members(n, block), MEMBER)
    found = sent.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(verify(round(threshold * 1000)), "id long, k1 long, links long, root long")
    found = stored(found, "links")
    group = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id", "k1").agg(F.sum("links").alias("links"))
    head = heads.groupBy("id", "k1").agg(F.max("copies").alias("copies")).join(links, ["id", "k1"], "left").join(group, "id", "left")
    head = head.select(F.col("id").alias("class_id"), "k1", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("group_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("copies") > 1, SALTS - 1).otherwise(0).cast("long"))).alias("salt"))
    dealt = member.select("id", "class_id", "k1", "copies", F.when(F.col("copies") > 1, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")).alias("salt"))
    done = dealt.join(head, ["class_id", "k1", "salt"]).select("id", "class_id", "group_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    rest = signed.where("size = 0 or id is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return done.unionByName(rest).withColumnRenamed("id", doc_id)
