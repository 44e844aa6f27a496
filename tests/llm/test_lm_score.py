import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from tallyforge.llm import attention as at
from tallyforge.llm import lm_score as lm

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(r"[ \x09-\x0D]+", low) if w] + [None]


def corpus(seed=1, n=120):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        k = r.choice(["the of And", "un la éTé", "der die"]).split(" ")
        docs.append((i, " ".join(r.choice([*k, "w" + str(r.randrange(200))]) for _ in range(r.randint(0, 150)))))
    return docs + [(900, None), (901, ""), (902, " \n "), (903, "A\x0bB  c d")]


def test_counts_and_base_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in lm.score_texts(df, PATH, sample_docs=50, steps=30, block_bytes=4000).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in tokens(t))
    total, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    for i, t in docs:
        w = tokens(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (total + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_held_out_texts_score_better_than_the_base(spark):
    df = spark.createDataFrame(corpus(2, 400), "doc_id long, text string")
    rows = [r for r in lm.score_texts(df, PATH, sample_docs=200, steps=200).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_gradient_and_scorer():
    rng = np.random.Generator(np.random.PCG64(1))
    p = {k: v.astype(np.float64) for k, v in at.init(9).items()}
    tok = rng.integers(0, 9, 70)
    inputs, targets, first, flat = at.layout(tok, np.array([37, 1, 32]))
    assert (targets.ravel()[flat] == tok).all() and first.tolist() == [True, False, False, True, True, False]
    used = np.zeros(targets.size, bool)
    used[flat] = True
    used = used.reshape(targets.shape)
    _, g = at.step(p, inputs, targets, first, used)
    for n in at.NAMES:
        k = tuple(rng.integers(0, s) for s in p[n].shape)
        up, down = ({m: v.copy() for m, v in p.items()} for _ in range(2))
        up[n][k] += 1e-3
        down[n][k] -= 1e-3
        slope = (at.step(up, inputs, targets, first, used)[0] - at.step(down, inputs, targets, first, used)[0]) / 2e-3
        assert abs(slope - g[n][k]) < 2e-3
    loss = -at.Scorer({k: v.astype(np.float32) for k, v in p.items()}).log_probs(inputs, targets, first)[used].mean()
    assert abs(loss - at.step(p, inputs, targets, first, used)[0]) < 1e-4


def test_probabilities_sum_to_one():
    s = at.Scorer(at.init(9))
    inputs = np.tile(np.arange(32, dtype=np.int16) % 9, (9, 1))
    targets = np.repeat(np.arange(9, dtype=np.int16)[:, None], 16, axis=1)
    assert np.allclose(np.exp(s.log_probs(inputs, targets, np.zeros(9, bool))).sum(axis=0), 1, atol=1e-4)


def test_empty(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def train_batch(block, texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([block] * len(texts), pa.int32()), pa.array(texts), pa.array([False] * len(texts))], names=["block", "__t", "held"])


def test_a_block_trains_on_every_chunk(monkeypatch):
    seen = []
    step = at.step
    monkeypatch.setattr(at, "step", lambda p, i, t, f, u: seen.append(int(u.sum())) or step(p, i, t, f, u))
    for k in (20, 5000):  # fewer chunks than one in 48 finds, and more than 24 batches of 128 hold
        seen.clear()
        texts = [" ".join(f"w{j % 7}" for j in range(16)) for _ in range(k)]
        list(lm.count_words(PATH, {}, at.init(lm.CLASSES), 3)(iter([train_batch(47, texts)])))
        assert sum(seen) == 17 * k


def test_models_weigh_by_their_tokens():
    import pyarrow as pa

    start = at.init(lm.CLASSES)
    rows = []
    for n in (1, 9):
        for b in lm.count_words(PATH, {}, start, 3)(iter([train_batch(64 * n, ["a b c"] * n)])):
            rows += [r for r in b.to_pylist() if r["bucket"] < 0]
    got = [r for b in lm.add_counts(iter([pa.RecordBatch.from_pylist(rows, b.schema)])) for r in b.to_pylist()]
    models = [np.frombuffer(r["data"][-4 * sum(v.size for v in start.values()) :], np.float32).astype(np.float64) for r in rows]
    assert [r["n"] for r in got] == [4 + 36]
    assert np.allclose(np.frombuffer(got[0]["data"], np.float64), 4 * models[0] + 36 * models[1])


def test_classes_and_start_see_all_training_texts(spark, monkeypatch):
    seen = {}
    count, fit = lm.count_words, lm.fit_start
    monkeypatch.setattr(lm, "count_words", lambda path, own, *x: seen.update(own=own) or count(path, own, *x))
    monkeypatch.setattr(lm, "fit_start", lambda texts, *x: seen.update(texts=texts) or fit(texts, *x))
    rare = ["water", "\u0432\u043e\u0434\u0430", "agua"]
    docs = [(i, "house " * 20) for i in range(300)] + [(1000 + i, f"{w} " * 9) for i, w in enumerate(rare)]
    docs = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 7 != 2] + [(k, "forest " * 9000) for k in (5000, 5001, 5002)]
    lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), PATH, sample_docs=20, steps=2).count()
    ranks = lm.vocabulary(PATH)
    want = Counter()
    for i, x in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            want.update(lm.subword(w.encode(), ranks) for w in x.split())
    assert list(seen["own"]) == sorted(want, key=lambda k: (-want[k], k))
    lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), PATH, sample_docs=1000, steps=2).count()
    assert sum(x.count(b"forest") for x in seen["texts"]) > 8000


def naive_log10(p, classes, lengths):
    """Each token's log10 probability by loops: softmax attention over the chunk before it and its own, up to itself."""
    out, begin = [], 0
    for n in lengths:
        own = classes[begin : begin + n]
        begin += n
        inputs = [0, *own[:-1]]
        for i, target in enumerate(own):
            first = max(0, (i // at.CHUNK - 1) * at.CHUNK)
            h = [p["embed"][inputs[j]] for j in range(first, i + 1)]
            q = h[-1] @ p["q"]
            s = np.array([q @ (x @ p["k"]) * at.WIDTH**-0.5 + p["near"][i - j] for x, j in zip(h, range(first, i + 1), strict=True)])
            a = np.exp(s - s.max())
            c = (a / a.sum()) @ np.array([x @ p["v"] for x in h])
            z = (h[-1] + c @ p["o"]) @ p["out"] + p["bias"]
            out.append((z[target] - z.max() - np.log(np.exp(z - z.max()).sum())) / np.log(10))
    return np.array(out)


def test_scores_equal_brute_force(spark, monkeypatch):
    docs = corpus(5, 40)
    seen = {}
    score, fit = lm.score_block, lm.fit_classes
    monkeypatch.setattr(lm, "score_block", lambda total, distinct, stats, model: seen.update(model=model) or score(total, distinct, stats, model))
    monkeypatch.setattr(lm, "fit_classes", lambda *x: seen.update(own=fit(*x)) or seen["own"])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score_texts(df, PATH, sample_docs=20, steps=20, block_bytes=3000).collect()}
    p = {k: v.astype(np.float64) for k, v in seen["model"].items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in tokens(t))
    entries = lm.vocabulary(PATH)
    kind = lambda w: 0 if w is None else seen["own"].get(lm.subword(w.encode(), entries)) or 1 + lm.OWN + lm.subword(w.encode(), entries) % lm.HASHED
    once, twice, n = Counter(), Counter(), Counter()
    for w, k in c.items():
        n[kind(w)] += k
        once[kind(w)] += k == 1
        twice[kind(w)] += k == 2
    for i, t in docs:
        w = tokens(t)
        want = naive_log10(p, [kind(x) for x in w], [len(w)]).sum()
        for x in w[:-1]:
            k = kind(x)
            d = (once[k] + 1) / (once[k] + 2 * twice[k] + 2)
            want += math.log10((c[x] - d if c[x] else d) / max(n[k], 1))
        assert math.isclose(got[i], want, rel_tol=1e-3, abs_tol=1e-3), (i, got[i], want)


def test_repeated_rows_and_extra_columns(spark):
    docs = [(1, "a b c"), (1, "a b c"), (1, "d"), (None, "e f"), (None, "e f"), (2, None)]
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, id string, held double")
    got = sorted((r.doc_id or 0, r.n_tokens, r.held_out) for r in lm.score_texts(df, PATH, sample_docs=5, steps=2).collect())
    assert [x[:2] for x in got] == [(0, 3), (0, 3), (1, 2), (1, 4), (1, 4), (2, 1)]


def test_a_task_reads_one_block_at_a_time():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 5, 5, 5], pa.int32())], names=["k"])
    got = [(k, t.num_rows) for k, t in lm.by_key(iter([rows.slice(0, 1), rows.slice(1, 3), rows.slice(4, 0), rows.slice(4, 2)]), "k")]
    assert got == [(1, 2), (2, 1), (5, 3)]
