"""Suffix-array dedup: every byte covered by a ``WIDTH``-byte string that also starts earlier is removed.

1. Each text is cut into runs of consecutive windows (``WIDTH`` bytes) that have the same least ``GRAM``-byte hash at
   the same place, so equal windows lie in runs with the same hash. A run is described by that hash, a hash of its
   bytes, and its place. Of runs with equal bytes in one text all but the first are removed at once, before anything is
   shuffled; the rest meet by the first hash, and again all but the first of equal bytes are removed whole.
   Runs whose hash no other bytes share need nothing more.
2. The bytes of the remaining runs (boundaries of repeats) go to their hash's task. There the runs of one batch are split
   into shards; each shard's Burrows-Wheeler transform over 8-byte symbols is built, and the shards are merged by
   refining their interleave: each step stably sorts the interleaved rows by the symbol before them, and a step's new
   block borders are the common prefixes of its depth. After 100 bytes, the blocks are the repeated intervals; in
   each, all but the earliest place are removed. No suffix is sorted again for the merge.
3. A hash with more than ``HOT_ROWS`` runs (found on a random sample, which only steers the work) is not gathered: equal
   runs meet by their bytes over several salts first, and what is left meets window by window on 128-bit hashes with a
   partial aggregation.

A task gets the hashes of about ``TASK_BYTES`` of text. Where that would take more than ``MOST_TASKS`` tasks (over 400 GB), rows
are sorted within a task, which then holds a few whole hashes at a time.

Ids are integers. Null texts are empty, rows with a null id keep everything, and rows that repeat an id and a text are
one document twice: neither removes the other. Rows of one id with different texts share their removals: a range that is
found in one is cut from all of them, as far as they reach. Texts under ``WIDTH`` bytes keep everything. Very long texts are cut into
overlapping pieces. Ties do not occur, as places are unique. Empty tables give empty results. Columns named like an
output are replaced; the others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_bytes
from .common import shared_dir, stored
from .spans import cut_spans

WIDTH, GRAM, SYMBOL = 100, 32, 8
HOT_ROWS, SALTS, SAMPLE = 40_000, 8, 0.02
PIECE = 1 << 19
BATCH_SYMBOLS, SHARD_SYMBOLS = 120_000, 30_000
SETTLE_ROWS, COMPARE_ROWS = 300_000, 50_000
TASK_BYTES, MOST_TASKS = 8 << 20, 50_000

U = np.uint64
BASE = 0x9E3779B97F4A7C15


def byte_values(seed: int) -> np.ndarray:
    """256 fixed random odd 64-bit values."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64) | U(1)


VALUES = (byte_values(17), byte_values(29))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(32))) * U(0xCA5A826395121157)


class Rolling:
    """Polynomial hashes of every substring of a given length, by doubling."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.n, self.by = len(data), {1: VALUES[seed][data]}

    def block(self, size: int) -> np.ndarray:
        if size not in self.by:
            half = size // 2
            a = self.block(half)
            self.by[size] = a[:-half] * U(pow(BASE, half, 1 << 64)) + a[half:]
        return self.by[size]

    def of(self, size: int) -> np.ndarray:
        out, done = None, 0
        count = self.n - size + 1
        for bit in range(size.bit_length() - 1, -1, -1):
            if size >> bit & 1:
                part = self.block(1 << bit)[done : done + count]
                out = part if out is None else out * U(pow(BASE, 1 << bit, 1 << 64)) + part
                done += 1 << bit
        return out


def runs_of(data: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The window runs of a text, by piece: hash they meet by, hash of their bytes, first window, number of windows."""
    out = []
    for begin in range(0, max(len(data) - WIDTH + 1, 0), PIECE):
        x = np.frombuffer(data, np.uint8, min(len(data) - begin, PIECE + WIDTH - 1), begin)
        roll = Rolling(x)
        grams = mix(roll.of(GRAM))
        span = WIDTH - GRAM + 1
        least = (grams >> U(20) << U(20)) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if span > size:
            least = np.minimum(least[: len(least) - span + size], least[span - size :])
        place = (least & U((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        end = np.append(first[1:], len(place))
        whole = roll.of(WIDTH)
        content = mix(whole[first] * U(3) + mix(whole[end - 1] + (end - first).astype(np.uint64)))
        out.append((grams[place[first]].view(np.int64), content.view(np.int64), first + begin, end - first))
    return out


def borders(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the sorted columns differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def window_runs(docs: DataFrame) -> DataFrame:
    """Rows (m, c, id, s, n, own) for all runs of ``docs`` (__id, __t).

    Runs that repeat one of their own text are not among them; ``own`` rows give their bytes instead, as maximal ranges
    from s of n bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in by_bytes(batch, "__t"):
                got: list[list[np.ndarray]] = [[], [], [], [], []]
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for k, x in enumerate(texts):
                    for m, c, s, n in runs_of(x):
                        for j, v in enumerate((m, c, np.full(len(m), k), s, n)):
                            got[j].append(v)
                if not got[0]:
                    continue
                m, c, row, s, n = (np.concatenate(v) for v in got)
                ids = np.array(part.column(0).to_pylist(), np.int64)
                order = np.lexsort((s, c, m, row))
                again = np.zeros(len(m), bool)
                again[order] = ~borders(row[order], m[order], c[order])
                a, b = s[again], s[again] + n[again] + WIDTH - 1
                first = np.ones(len(a), bool)
                first[1:] = (a[1:] > b[:-1]) | (row[again][1:] != row[again][:-1])
                at = np.flatnonzero(first)
                size = b[np.append(at[1:], len(a)) - 1] - a[at] if len(a) else a
                none, keep = np.zeros(len(at), np.int64), ~again
                cols = [(m[keep], none), (c[keep], none), (ids[row[keep]], ids[row[again][at]]), (s[keep], a[at]), (n[keep], size)]
                own = np.concatenate((np.zeros(int(keep.sum()), bool), np.ones(len(at), bool)))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).astype(t)) for x, t in zip(cols, ("i8", "i8", "i8", "i8", "i4"), strict=True)), pa.array(own)], names=["m", "c", "id", "s", "n", "own"])

    return docs.mapInArrow(run, "m long, c long, id long, s long, n int, own boolean")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int, in_order: bool) -> Iterator[pa.Table]:
    """Tables that hold every row of the keys in them: all at once, or where the rows are in order of ``least`` rows or more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if in_order and size >= least:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            other = np.flatnonzero(keys != held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py())
            if len(other):
                cut = int(other[0])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def tasks_for(size: int, least: int) -> tuple[int, bool]:
    """How many tasks to deal ``size`` bytes of text over, and whether a task would get so many that it has to sort its rows."""
    tasks = max(-(-size // TASK_BYTES), least)
    return min(tasks, MOST_TASKS), tasks > MOST_TASKS


SPAN, COLD, HOT = 0, 1, 2


def settle(in_order: bool):
    """From all runs of some hashes: byte ranges to remove (SPAN), and the runs that need their bytes compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "key", SETTLE_ROWS, in_order):
            yield from settle_groups(rows)

    return run


def settle_groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    m, c, i, s, n = (rows.column(k).to_numpy() for k in ("m", "c", "id", "s", "n"))
    hot, own = (rows.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in ("hot", "own"))
    done = np.flatnonzero(own)
    order = np.lexsort((s, i, c, m))
    order = order[~own[order]]
    yield from asks(np.full(len(done), SPAN), m[done], i[done], s[done], n[done])
    m, c, i, s, n, hot = m[order], c[order], i[order], s[order], n[order], hot[order]
    if not len(m):
        return
    group, same = borders(m), borders(m, c)
    first = np.flatnonzero(same)[np.cumsum(same) - 1]
    again = ~same & ((i != i[first]) | (s != s[first]))
    kinds = np.add.reduceat(same.astype(np.int64), np.flatnonzero(group))[np.cumsum(group) - 1]
    ask = same & (hot | (kinds > 1))
    kind = np.where(again, SPAN, np.where(hot, HOT, COLD))
    n = np.where(again, n + WIDTH - 1, n)
    pick = again | ask
    yield from asks(kind[pick], m[pick], i[pick], s[pick], n[pick])


def asks(kind: np.ndarray, m: np.ndarray, i: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """In batches: ranges to remove (n bytes from s), and runs to compare (n windows from s)."""
    for at in range(0, len(m), 100_000):
        k = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(kind[k].astype(np.int8)), pa.array(m[k]), pa.array(i[k]), pa.array(s[k]), pa.array(n[k].astype(np.int32))], names=["kind", "m", "id", "s", "n"])


def run_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for."""
    for batch in batches:
        for part in by_bytes(batch, "__t"):
            m, i, s, x = [], [], [], []
            for own, text, asked in zip(part.column("id").to_pylist(), part.column("__t").cast(pa.binary()).to_pylist(), part.column("asked").to_pylist(), strict=True):
                for a in asked:
                    m.append(a["m"])
                    i.append(own)
                    s.append(a["s"])
                    x.append(text[a["s"] : a["s"] + a["n"] + WIDTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.binary())], names=["m", "id", "s", "x"])


def run_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each window of the runs asked for; ``own``: it repeats one of its document."""
    for batch in batches:
        for part in by_bytes(batch, "__t"):
            for own, text, asked in zip(part.column("id").to_pylist(), part.column("__t").cast(pa.binary()).to_pylist(), part.column("asked").to_pylist(), strict=True):
                a, b, at = [], [], []
                for q in sorted(asked, key=lambda q: q["s"]):
                    x = np.frombuffer(text, np.uint8, q["n"] + WIDTH - 1, q["s"])
                    a.append(mix(Rolling(x, 0).of(WIDTH)))
                    b.append(mix(Rolling(x, 1).of(WIDTH)))
                    at.append(np.arange(q["s"], q["s"] + q["n"]))
                h1, h2, p = np.concatenate(a), np.concatenate(b), np.concatenate(at)
                order = np.lexsort((p, h2, h1))
                h1, h2, p = h1[order].view(np.int64), h2[order].view(np.int64), p[order]
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(p), own, np.int64)), pa.array(p), pa.array(~borders(h1, h2))], names=["h1", "h2", "id", "s", "own"])


def stable_order(key: np.ndarray) -> np.ndarray:
    """A stable argsort of small non-negative integers by radix."""
    if not len(key) or key.max() < 1 << 16:
        return np.argsort(key.astype(np.uint16), kind="stable")
    low = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((key[low] >> 16).astype(np.uint16), kind="stable")]


class Symbols:
    """Byte strings end to end, with dense ranks of the 4 and 8 bytes at each place and how far its string reaches."""

    def __init__(self, strings: list[bytes]):
        size = np.array([len(x) for x in strings], np.int64)
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), size)
        begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int32)
        self.offset = np.arange(len(self.string), dtype=np.int32) - begin[self.string]
        self.left = size.astype(np.int32)[self.string] - self.offset
        data = np.concatenate((np.frombuffer(b"".join(strings), np.uint8), np.zeros(SYMBOL, np.uint8))).astype(np.uint64)
        n = len(self.string)
        two = data[:-1] << U(8) | data[1:]
        four = two[:-2] << U(16) | two[2:]
        eight = four[:n] << U(32) | four[4 : n + 4]
        eight &= ~U(0) << (U(8) * (U(8) - np.minimum(self.left, 8).astype(np.uint64)))
        self.eight = np.unique(eight, return_inverse=True)[1].astype(np.int32)
        self.four = np.unique(four[:n].astype(np.uint32), return_inverse=True)[1].astype(np.int32)


def shard_transform(text: Symbols, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffix order over 8-byte symbols: the places by row, and each row's last-to-first row (-1: none).

    The transform of the shard is the symbol at the last-to-first row of each row.
    """
    key, offset, left = text.eight[begin:end], text.offset[begin:end], text.left[begin:end]
    short = np.flatnonzero(left <= SYMBOL)
    order = np.arange(end - begin)
    for _ in range(-(-WIDTH // SYMBOL)):
        moved = order[offset[order] >= SYMBOL] - SYMBOL
        order = np.concatenate((short, moved))
        order = order[stable_order(key[order])]
    row = np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    inside = offset[order] >= SYMBOL
    return order, np.where(inside, row[order - SYMBOL * inside], -1)


def merge_transforms(text: Symbols, shards: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms by interleave refinement.

    Starts from the shards one after the other and refines: depth 4, then 8 more with each step, up to ``WIDTH``. Gives
    the places with ``WIDTH`` bytes left in merged order, and the block (equal first ``WIDTH`` bytes) of each.
    """
    place = np.concatenate([order + begin for begin, order, _ in shards])
    base = np.cumsum([0, *(len(order) for _, order, _ in shards)])
    jump = np.concatenate([np.where(lf >= 0, lf + b, -1) for (_, _, lf), b in zip(shards, base[:-1], strict=True)])
    symbol = text.eight[place]
    head = WIDTH % SYMBOL
    rows = np.flatnonzero(text.left[place] >= head)
    key = text.four[place[rows]]
    order = stable_order(key)
    rows, block = rows[order], np.cumsum(borders(key[order]))
    for _ in range(WIDTH // SYMBOL):
        before = jump[rows]
        keep = before >= 0
        rows, block = before[keep], block[keep]
        key = symbol[rows]
        order = stable_order(key)
        rows, block = rows[order], block[order]
        block = np.cumsum(borders(key[order], block))
    return place[rows], block


def repeated(ids: np.ndarray, starts: np.ndarray, strings: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) for maximal runs of windows that occur earlier; the strings lie at ``starts`` of documents ``ids``."""
    order = np.lexsort((starts, ids))
    ids, starts, strings = ids[order], starts[order], [strings[k] for k in order]
    rank = np.cumsum(borders(ids, starts))
    text = Symbols(strings)
    ends = np.cumsum([len(x) for x in strings])
    shards, begin = [], 0
    for k in range(len(strings)):
        if ends[k] - begin >= SHARD_SYMBOLS or k == len(strings) - 1:
            shards.append((begin, *shard_transform(text, begin, int(ends[k]))))
            begin = int(ends[k])
    place, block = merge_transforms(text, shards)
    if not len(place):
        return
    when = rank[text.string[place]].astype(np.int64) * (1 << 20) + text.offset[place]
    new = np.flatnonzero(borders(block))
    least = np.minimum.reduceat(when, new)[np.cumsum(borders(block)) - 1]
    hit = np.sort(place[when != least])
    if not len(hit):
        return
    string = text.string[hit]
    cut = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (string[1:] != string[:-1]))))
    last = np.append(cut[1:], len(hit)) - 1
    for a, b in zip(hit[cut], hit[last], strict=True):
        k = text.string[a]
        yield int(ids[k]), int(starts[k] + text.offset[a]), int(starts[k] + text.offset[b]) + WIDTH


def compare_runs(in_order: bool):
    """Compare the bytes of all runs of some hashes, whole hashes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "m", COMPARE_ROWS, in_order):
            yield from compare_groups(rows)

    return run


def compare_groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    m, i, s = (rows.column(k).to_numpy() for k in ("m", "id", "s"))
    x = rows.column("x").combine_chunks()
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    order = np.argsort(m, kind="stable")
    size = np.diff(np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4))[order].cumsum()
    edges = np.append(np.flatnonzero(borders(m[order])), len(m))
    start, out = 0, []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if size[b - 1] - (size[start - 1] if start else 0) >= BATCH_SYMBOLS or b == len(m):
            k = order[start:b]
            out.extend(repeated(i[k], s[k], x.take(pa.array(k)).to_pylist()))
            start = b
        if len(out) > 50_000:
            yield spans_batch(out)
            out = []
    if out:
        yield spans_batch(out)


def spans_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a = np.array(rows, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, k])) for k in range(3)], names=["id", "a", "b"])


def find_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS, sample: float = SAMPLE) -> DataFrame:
    """For each document with repeated bytes: __id, __starts and __ends (byte ranges to remove)."""
    shared_dir(df.sparkSession)
    all_docs = df.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__t"))
    docs = all_docs.where(F.octet_length("__t") >= WIDTH).where("__id is not null")
    size = docs.agg(F.sum(F.octet_length("__t"))).first()[0] or 0
    tasks, in_order = tasks_for(size, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt_by = lambda rows, key: rows.repartition(tasks, key).sortWithinPartitions(key) if in_order else rows.repartition(tasks, key)
    few = window_runs(docs.sample(sample, 5) if sample < 1 else docs).where("not own").groupBy("m").agg(F.count("*").alias("k"))
    hot = stored(few.where(F.col("k") >= max(2, int(hot_rows * sample))).select("m", F.lit(True).alias("is_hot")), "hot")
    runs = window_runs(docs).join(hot, "m", "left").withColumn("hot", F.coalesce("is_hot", F.lit(False)))
    key = F.when(F.col("own"), F.xxhash64("id", "s")).when(F.col("hot"), F.xxhash64("m", "c", F.pmod(F.xxhash64("id"), F.lit(SALTS)))).otherwise(F.col("m"))
    dealt = dealt_by(runs.select("m", "c", "id", "s", "n", "hot", "own", key.alias("key")), "key")
    settled = stored(dealt.mapInArrow(settle(in_order), "kind byte, m long, id long, s long, n int"), "settled")

    whole = settled.where(F.col("kind") == SPAN).select("id", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))

    def asked(kind: int) -> DataFrame:
        ask = settled.where(F.col("kind") == kind).groupBy("id").agg(F.collect_list(F.struct("m", "s", "n")).alias("asked"))
        return docs.join(ask, docs["__id"] == ask["id"]).select("id", "__t", "asked")

    cold = dealt_by(asked(COLD).mapInArrow(run_bytes, "m long, id long, s long, x binary"), "m").mapInArrow(compare_runs(in_order), "id long, a long, b long")
    spans = whole.unionByName(cold)
    if hot.head(1):
        windows = asked(HOT).mapInArrow(run_windows, "h1 long, h2 long, id long, s long, own boolean")
        first = windows.where("not own").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
        later = windows.where("not own").join(first, ["h1", "h2"]).where("id > first").select("id", "s").unionByName(windows.where("own").select("id", "s"))
        spans = spans.unionByName(later.select("id", F.col("s").alias("a"), (F.col("s") + WIDTH).alias("b")))
    out = spans.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("x"))
    return out.select(F.col("id").alias("__id"), F.col("x.a").alias("__starts"), F.col("x.b").alias("__ends"))


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False, hot_rows: int = HOT_ROWS, sample: float = SAMPLE) -> DataFrame:
    """Add n_bytes, n_removed, n_spans and ``kept`` (the bytes left) to every row; ``whole`` keeps characters whole."""
    return cut_spans(df, find_spans(df, doc_id, text, hot_rows, sample), doc_id, text, whole).drop("n_found")
