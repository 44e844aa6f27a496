"""LM scoring: a causal self-attention model over subword classes, with corpus counts for the words of a class.

P(word | context) = P(class | context) * P(word | class). The class of a word follows from a subword id: the longest
vocabulary entry that starts the word; frequent ids have a class of their own, the rest share hashed ones. The attention
model gives the first factor, the counts of all training texts the second: each known word's count less a discount d, where
d = (n1 + 1) / (n1 + 2 n2 + 2) from the class's words of count one and two; what is taken off goes to as many unknown
words as the class has known ones, d each.

1. The subword ids of all training texts are counted (a row an id, 50,000 at most) and the most frequent get the own classes. A
   sample of pieces of training texts, long ones included, trains the model's start on the driver: about ``sample_docs`` pieces
   of ``PIECE`` characters at most, growing with the fourth root of the input (31 times as many for 100 TB as for 0.1 GB).
2. Texts are dealt into blocks of about ``BLOCK_BYTES``; a task reads its blocks one after the other. Each block counts its
   distinct words and goes on training on every chunk of its training texts, once, so counts and training follow the input.
3. Counts meet by ranges of 64-bit word hashes (0.0003 expected collisions among 10^8 distinct words), one range at a time;
   every block gets back the counts and classes of its own words, 5 bytes a word. Models are averaged by their training
   tokens, in up to 64 partial sums.
4. Each block scores its texts in overlapping windows.

Null and empty texts have one token, the end. A null id is training data. Rows that share an id are scored one by one.
Long texts are scored whole. An empty table gives an empty result. Columns named like an output are replaced; the other
columns are joined back by the caller: the result has the id and the scores.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as at
from .common import shared_dir, stored
from .shingles import U, word_hashes

BLOCK_BYTES, BATCH, MOST_TASKS = 12 << 20, 128, 100_000
SAMPLE_DOCS, SAMPLE_OF, PIECE = 600, 100 << 20, 20_000
STATS = 4  # by class: tokens, known words, words of count one and two
OWN, HASHED = 95, 32
CLASSES = 1 + OWN + HASHED
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END = U(0x243F6A8885A308D3)
LOG10 = np.log10(np.e)
SPACE = re.compile(rb"[ \t-\r]")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[bytes, int], dict[bytes, int]]:
    """Ids of the entries of 12 bytes at most that begin with a space, without it; the most bytes of those by their first four; ids of single bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    spaced = {x[1:]: n for x, n in ranks.items() if x[:1] == b" " and 2 <= len(x) <= 12}
    longest: dict[bytes, int] = {}
    for x in spaced:
        longest[x[:4]] = max(longest.get(x[:4], 3), len(x))
    return spaced, longest, {x: n for x, n in ranks.items() if len(x) == 1}


def subword(word: bytes, entries: tuple[dict[bytes, int], dict[bytes, int], dict[bytes, int]]) -> int:
    """The id of the longest vocabulary entry, of 12 bytes at most, that starts the word behind a space."""
    spaced, longest, single = entries
    for n in range(min(len(word), longest.get(word[:4], 3)), 0, -1):
        if (r := spaced.get(word[:n])) is not None:
            return r
    return single.get(word[:1], 0)


class Words:
    """The words of many texts: each text's tokens as indices into the sorted distinct words, ends included."""

    def __init__(self, texts: list[bytes]):
        parts, counts, size = [], [], 0
        hold: list[bytes] = []

        def flush() -> None:
            h, n = word_hashes(hold)
            parts.append(h)
            counts.append(n)
            hold.clear()

        for x in texts:
            hold.append(x.translate(LOWER))
            size += len(x)
            if size > 1 << 20:
                flush()
                size = 0
        flush()
        h = np.concatenate(parts)
        n = np.concatenate(counts)
        self.lengths = n + 1
        ends = np.cumsum(self.lengths) - 1
        tokens = np.empty(int(self.lengths.sum()), np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner], tokens[ends] = h, END
        self.h1, self.first, self.tokens = np.unique(tokens, return_index=True, return_inverse=True)
        self.text = np.searchsorted(ends, self.first)
        self.within = self.first - np.concatenate(([0], ends[:-1] + 1))[self.text]

    def strings(self, texts: list[bytes]) -> list[bytes | None]:
        """Each distinct word; None for the end."""
        out: list[bytes | None] = [None] * len(self.h1)
        order = np.lexsort((self.within, self.text))
        last, split = -1, []
        for k in order.tolist():
            t = int(self.text[k])
            if t != last:
                last, split = t, texts[t].translate(LOWER).split()
            w = int(self.within[k])
            if w < len(split):
                out[k] = split[w]
        return out


def classes_of(strings: list[bytes | None], entries: tuple, own: dict[int, int]) -> np.ndarray:
    """Class 0 is the end, then the frequent ids' own classes, then the hashed ones."""
    find = own.get
    out = np.empty(len(strings), np.uint8)
    for k, w in enumerate(strings):
        if w is None:
            out[k] = 0
        else:
            s = subword(w, entries)
            out[k] = find(s) or 1 + OWN + s % HASHED
    return out


def count_subwords(path: str):
    """Subword ids of the words of all texts, with their counts in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = vocabulary(path)
        words: Counter[bytes] = Counter()
        count: Counter[int] = Counter()

        def fold() -> None:
            for w, n in words.items():
                count[subword(w, entries)] += n
            words.clear()

        for batch in batches:
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                begin = 0
                while begin < len(x):
                    gap = SPACE.search(x, begin + (1 << 20))
                    end = gap.start() if gap else len(x)
                    words.update(x[begin:end].translate(LOWER).split())
                    begin = end
                if len(words) > 200_000:
                    fold()
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64())], names=["s", "n"])

    return run


def fit_classes(texts: DataFrame, path: str) -> dict[int, int]:
    """Own classes of the most frequent subword ids of all ``texts``; ties go to the lower id."""
    count = texts.mapInArrow(count_subwords(path), "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {r.s: k + 1 for k, r in enumerate(sorted(count, key=lambda r: (-r.n, r.s))[:OWN])}


def sample_pieces(docs: DataFrame, sample_docs: int, size: int, pieces: int) -> list[bytes]:
    """Pieces of the texts, chosen by hash, each as likely as any other.

    The least hashes are taken, in their order: twice as many as wanted at most, where rows repeat an id and a length.
    """
    wanted = sample_docs * max(size / SAMPLE_OF, 1) ** 0.25
    one_in = max(int(-(-pieces // wanted)), 1)
    hashed = F.transform(F.sequence(F.lit(0), pieces_of("__t") - 1), lambda k: F.struct(F.xxhash64("id", F.octet_length("__t"), k).alias("h"), k.alias("k")))
    mine = F.filter(hashed, lambda x: F.pmod(x["h"], F.lit(one_in)) == 0)
    cut = docs.where(pieces_of("__t") > 0).select(F.explode(F.transform(mine, lambda x: F.struct(x["h"].alias("h"), F.substr("__t", x["k"] * PIECE + 1, F.lit(PIECE)).alias("t")))).alias("x"))
    return [r.t.encode() for r in cut.select("x.h", "x.t").orderBy("h", "t").limit(int(2 * wanted) + 1).collect()]


def pieces_of(text: str) -> Column:
    return F.ceil(F.length(text) / PIECE).cast("int")


def fit_start(texts: list[bytes], path: str, own: dict[int, int], steps: int) -> dict[str, np.ndarray]:
    """A model trained on the sample: ``steps`` steps, or one for each batch of its chunks where they are more."""
    start = at.init(CLASSES)
    if not texts:
        return start
    at.one_thread()
    words = Words(texts)
    inputs, targets, first, flat = at.layout(classes_of(words.strings(texts), vocabulary(path), own)[words.tokens], words.lengths)
    used = np.zeros(targets.size, bool)
    used[flat] = True
    return at.train(start, inputs, targets, first, used.reshape(targets.shape), max(steps, -(-len(inputs) // BATCH)), 0.02, BATCH)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key, one key at a time; the batches are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def count_words(path: str, own: dict[int, int], start: dict[str, np.ndarray], buckets: int):
    """For each block: its words by bucket (hashes, training counts, classes), and its model."""

    def block_rows(block: int, texts: list[bytes], train: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        words = Words(texts)
        kind = classes_of(words.strings(texts), vocabulary(path), own)
        teach = np.repeat(train, words.lengths)
        n = np.bincount(words.tokens[teach], minlength=len(words.h1)).astype(np.uint64)
        bucket = (words.h1 >> U(32)) * U(buckets) >> U(32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            a, b = edges[k], edges[k + 1]
            yield k, block, b"".join((words.h1[a:b].tobytes(), n[a:b].tobytes(), kind[a:b].tobytes()))
        if train.any():
            inputs, targets, first, flat = at.layout(kind[words.tokens[teach]], words.lengths[train])
            used = np.zeros(targets.size, bool)
            used[flat] = True
            got = at.train(start, inputs, targets, first, used.reshape(targets.shape), -(-len(inputs) // BATCH), 0.004, BATCH, seed=block)
            yield -1 - block % 64, block, np.int64(len(flat)).tobytes() + at.pack(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at.one_thread()
        for b, rows in by_key(batches, "block"):
            texts = [x or b"" for x in rows.column("__t").cast(pa.binary()).to_pylist()]
            out = list(block_rows(b, texts, ~rows.column("held").to_numpy().astype(bool)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["bucket", "block", "data"])

    return run


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket: each block's counts (summed over all blocks) and classes back, and totals by class; models summed, weighted by their tokens."""

    def row(*x) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["block", "bucket", "n", "data"])

    for bucket, rows in by_key(batches, "bucket"):
        parts = sorted(zip(rows.column("block").to_pylist(), rows.column("data").to_pylist(), strict=True))
        if bucket < 0:
            tokens = [int(np.frombuffer(d[:8], np.int64)[0]) for _, d in parts]
            total = sum(n * np.frombuffer(d[8:], np.float32).astype(np.float64) for n, (_, d) in zip(tokens, parts, strict=True))
            yield row(-2, bucket, sum(tokens), total.tobytes())
            continue
        sizes = [len(d) // 17 for _, d in parts]
        cut = lambda a, b, t: np.concatenate([np.frombuffer(d[a * n : b * n], t) for (_, d), n in zip(parts, sizes, strict=True)])  # noqa: E731, B023
        h1, n, kind = cut(0, 8, np.uint64), cut(8, 16, np.uint64), cut(16, 17, np.uint8)
        order = np.argsort(h1, kind="stable")
        a = h1[order]
        new = np.concatenate(([True], a[1:] != a[:-1]))
        word = np.cumsum(new) - 1
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        c = np.empty(len(n), np.uint64)
        c[order] = total[word]
        of = kind[order][new]
        by_class = np.concatenate((np.bincount(of, weights=total, minlength=CLASSES), *(np.bincount(of[x], minlength=CLASSES) for x in (total > 0, total == 1, total == 2))))
        yield row(-1, bucket, 0, by_class.astype(np.float64).tobytes())
        end = 0
        for (block, _), k in zip(parts, sizes, strict=True):
            own = c[end : end + k]
            wide = own.max() >= 1 << 32
            yield row(block, bucket, int(wide), own.astype(np.uint64 if wide else np.uint32).tobytes() + kind[end : end + k].tobytes())
            end += k


def within_class(c: np.ndarray, kind: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """log10 P(word | class) of words by count and class; ``stats``: tokens, known words, words of count one and two by class."""
    n, _, once, twice = stats
    off = (once + 1) / (once + 2 * twice + 2)
    return np.log10(np.where(c > 0, c - off[kind], off[kind]) / np.maximum(n, 1)[kind])


def score_block(total: int, distinct: int, stats: np.ndarray, model: dict[str, np.ndarray]):
    """Score the texts of one block with the counts of its words."""
    scorer = at.Scorer(model)

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        at.one_thread()
        if not docs.num_rows:
            return docs.slice(0, 0).select(["id"]).append_column("n_tokens", pa.array([], pa.int64())).append_column("n_known", pa.array([], pa.int64())).append_column("base_score", pa.array([], pa.float64())).append_column("score", pa.array([], pa.float64())).append_column("held_out", pa.array([], pa.bool_()))
        texts = [x or b"" for x in docs.column("__t").cast(pa.binary()).to_pylist()]
        words = Words(texts)
        c, kind = [], []
        for _, wide, data in sorted(zip(counts.column("bucket").to_pylist(), counts.column("n").to_pylist(), counts.column("data").to_pylist(), strict=True)):
            size = 8 if wide else 4
            n = len(data) // (size + 1)
            c.append(np.frombuffer(data[: n * size], np.uint64 if wide else np.uint32).astype(np.float64))
            kind.append(np.frombuffer(data[n * size :], np.uint8))
        c, kind = np.concatenate(c), np.concatenate(kind)
        begin = np.concatenate(([0], np.cumsum(words.lengths)[:-1]))
        base = np.log10((c + 1) / (total + distinct + 1))[words.tokens]
        inside = within_class(c, kind, stats)
        inside[kind == 0] = 0.0
        score = inside[words.tokens]
        # texts in groups of about a million tokens
        group = np.cumsum(words.lengths) // 1_000_000
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            a, b = begin[rows[0]], begin[rows[-1]] + words.lengths[rows[-1]]
            inputs, targets, first, flat = at.layout(kind[words.tokens[a:b]], words.lengths[rows])
            score[a:b] += scorer.log_probs(inputs, targets, first).ravel()[flat] * LOG10
        sums = lambda x: np.add.reduceat(x, begin)
        return pa.table({"id": docs.column("id"), "n_tokens": pa.array(words.lengths), "n_known": pa.array(sums((c > 0)[words.tokens].astype(np.int64))), "base_score": pa.array(sums(base)), "score": pa.array(sums(score)), "held_out": docs.column("held")})

    return run


def score_texts(df: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, steps: int = 400, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of probabilities)."""
    spark = df.sparkSession
    shared_dir(spark)
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("__t"), is_held_out(F.col(doc_id)).alias("held"))
    taught = docs.where(~F.col("held") & F.col("__t").isNotNull())
    size, pieces = (x or 0 for x in docs.agg(F.sum(F.octet_length("__t")), F.sum(F.when(~F.col("held"), pieces_of("__t").cast("long")))).first())
    blocks = max(-(-size // block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = fit_classes(taught.select("__t"), vocabulary_path)
    start = fit_start(sample_pieces(taught, sample_docs, size, pieces), vocabulary_path, own, steps)
    tasks, buckets = min(blocks, MOST_TASKS), min(blocks, int(16 * blocks**0.5))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("__t")), F.lit(blocks)).cast("int")).repartition(tasks, "block")
    sent = dealt.sortWithinPartitions("block").mapInArrow(count_words(vocabulary_path, own, start, buckets), "bucket int, block int, data binary")
    met = sent.repartition(max(min(buckets, MOST_TASKS), 64), "bucket").sortWithinPartitions("bucket")
    back = stored(met.mapInArrow(add_counts, "block int, bucket int, n long, data binary"), "counts")
    facts = back.where("block = -1").select("data")
    by_class = facts.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(STATS * CLASSES - 1)), lambda k: F.substring("data", k * 8 + 1, F.lit(8)))).alias("k", "x"))
    by_class = by_class.mapInArrow(as_doubles, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    stats = np.zeros(STATS * CLASSES)
    for r in by_class:
        stats[r.k] = r.x
    stats = stats.reshape(STATS, CLASSES)
    parts = back.where("block = -2").select("n", "data").collect()  # 64 at most
    weights = sum((np.frombuffer(r.data, np.float64) for r in parts), np.zeros(1)) / max(sum(r.n for r in parts), 1)
    model = at.unpack(weights, CLASSES) if parts else start
    total, distinct = int(stats[0].sum()), int(stats[1].sum())
    scored = dealt.groupBy("block").cogroup(back.where("block >= 0").groupBy("block")).applyInArrow(
        score_block(total, distinct, stats, model), f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, held_out boolean"
    )
    return scored.select(F.col("id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def as_doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x)], names=["k", "x"])
