import random

import pytest

from tallyforge.llm import suffix_dedup as sd
from tallyforge.llm.spans import merged


def brute(docs):
    first, out = {}, {}
    for i, t in sorted(docs):
        x = (t or "").encode()
        a, b = [], []
        for p in range(len(x) - sd.WIDTH + 1):
            if first.setdefault(x[p : p + sd.WIDTH], (i, p)) != (i, p):
                a.append(p)
                b.append(p + sd.WIDTH)
        runs = merged(a, b)
        keep, at = [], 0
        for s, e in runs:
            keep.append(x[at:s])
            at = e
        out[i] = (len(x), sum(e - s for s, e in runs), len(runs), b"".join([*keep, x[at:]]))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "é", "on", "ti", "ß", "er"]) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    line, passage = text(9), text(60)
    docs = []
    for i in range(n):
        t = text(r.randint(0, 120))
        if r.random() < 0.4:
            t = line + "\n" + t
        if r.random() < 0.3:
            t += passage + text(20)
        if docs and r.random() < 0.2:
            t = r.choice(docs)[1] or ""
        if docs and r.random() < 0.3:
            w = (r.choice(docs)[1] or "").split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        docs.append((i * 3 - 20, t))
    docs += [(1000, None), (1001, ""), (1002, "ab" * 300), (1003, "ab" * 300), (1004, "x" * 99), (1005, "x" * 100), (1006, "x" * 101), (1007, "\0" * 250)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "hot", "most"), [(1, 10**9, 9), (2, 4, 9), (3, 2, 9), (4, 10**9, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, most):
    if not most:  # tasks that sort their rows and hold few hashes at a time
        monkeypatch.setattr(sd, "tasks_for", lambda size, least: (2, True))
        monkeypatch.setattr(sd, "SETTLE_ROWS", 5)
        monkeypatch.setattr(sd, "COMPARE_ROWS", 5)
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "extra", 5) for d in docs], "doc_id long, text string, kept string, n_spans int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_substrings(df, hot_rows=hot, sample=1.0).collect()}
    assert got == brute(docs)


def test_empty_table_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.dedup_substrings(df).count() == 0
    t = " ".join(map(str, range(100)))
    rows = sd.dedup_substrings(spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in rows) == [(False, 1, 0), (False, 1, 0), (False, 2, len(t)), (True, 0, 0)]


def test_pieces_and_radix(monkeypatch):
    r = random.Random(4)
    data = bytes(r.randrange(4) for _ in range(3000))
    at = lambda runs: {(m, s + k) for ms, cs, ss, ns in runs for m, s, n in zip(ms.tolist(), ss.tolist(), ns.tolist()) for k in range(n)}
    whole = at(sd.runs_of(data))
    monkeypatch.setattr(sd, "PIECE", 700)
    assert at(sd.runs_of(data)) == whole
    import numpy as np

    key = np.array([r.randrange(1 << 20) for _ in range(5000)])
    assert (sd.stable_order(key) == np.argsort(key, kind="stable")).all()


def test_whole_characters(spark):
    t = "é" * 120
    df = spark.createDataFrame([(1, t), (2, "a" + t)], "doc_id long, text string")
    for r in sd.dedup_substrings(df, whole=True).collect():
        bytes(r.kept).decode()


def test_whole_groups_and_tasks():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 2, 3, 4, 4])], names=["key"])
    parts = [rows.slice(0, 1), rows.slice(1, 3), rows.slice(4, 0), rows.slice(4, 4)]
    assert [t.column("key").to_pylist() for t in sd.whole_groups(iter(parts), "key", 2, True)] == [[1, 1, 2, 2, 2], [3, 4, 4]]
    assert [t.num_rows for t in sd.whole_groups(iter(parts), "key", 2, False)] == [8]
    assert sd.tasks_for(0, 8) == (8, False) and sd.tasks_for(1 << 37, 8) == (1 << 14, False) and sd.tasks_for(1 << 50, 8) == (50_000, True)


def test_shards_merge_to_one_order():
    """Transforms of separate shards, merged by interleave refinement, give the blocks of a plain sort of all 100-byte windows."""
    import numpy as np

    r = random.Random(6)
    base = bytes(r.randrange(97, 101) for _ in range(900))
    strings = [base[a : a + r.randrange(100, 260)] for a in (0, 50, 50, 300, 410, 0, 640, 300)] + [bytes(r.randrange(97, 101) for _ in range(150)) for _ in range(4)]
    text = sd.Symbols(strings)
    ends = np.cumsum([len(x) for x in strings])
    cuts = [0, *ends[2::3].tolist()]
    cuts += [] if cuts[-1] == ends[-1] else [int(ends[-1])]
    shards = [(a, *sd.shard_transform(text, a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert len(shards) >= 4
    place, block = sd.merge_transforms(text, shards)
    data = b"".join(strings)
    whole = {p for p in range(len(data)) if text.left[p] >= sd.WIDTH}
    assert set(place.tolist()) == whole and len(place) == len(whole)
    windows = [data[p : p + sd.WIDTH] for p in place.tolist()]
    assert windows == sorted(windows)
    assert [b == c for b, c in zip(block[1:].tolist(), block[:-1].tolist(), strict=True)] == [x == y for x, y in zip(windows[1:], windows[:-1], strict=True)]
