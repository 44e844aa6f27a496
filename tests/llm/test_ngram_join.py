import random

import numpy as np

from tallyforge.llm import ngram_join as nj
from tallyforge.llm.shingles import shingle_sets, word_hashes


def grams(t, n=5):
    w = [x for x in __import__("re").split(r"[ \x09-\x0D]+", t or "") if x]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, t=0.8):
    sets = {i: grams(x) for i, x in docs}
    links = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])] for i in sets}
    group = {i: i for i in sets}
    while True:
        new = {i: min([group[i], *(group[j] for j in links[i])]) for i in sets}
        if new == group:
            break
        group = new
    klass = {i: min([i, *(j for j in sets if sets[i] and sets[j] == sets[i])]) for i in sets}
    return {i: (klass[i], group[i], len(links[i])) for i in sets}


def corpus(seed, n, copies):
    r = random.Random(seed)
    text = lambda k: " ".join("".join(r.choice(["the", "é", "on", "ti"]) for _ in range(r.randint(1, 3))) for _ in range(k))
    docs = [(i * 7 - 50, text(r.randint(0, 90))) for i in range(n)]
    base = text(120).split(" ")
    for i in range(copies):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"edit{r.randrange(3)}"
        docs.append((5000 + i, " ".join(w)))
    docs += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "a b"), (9004, "a  b"), (9005, "b a"), (9006, docs[0][1] + "\n")]
    r.shuffle(docs)
    return docs


def run(spark, docs, **more):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, class_id int").repartition(4)
    return {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in nj.join_ngrams(df, recall=0.999999, **more).collect()}


def test_equals_brute_force(spark):
    docs = corpus(1, 40, 25)
    assert run(spark, docs) == brute(docs)


def test_blocks_of_a_large_group(spark, monkeypatch):
    docs = corpus(2, 5, 60)
    one = run(spark, docs)
    assert one == brute(docs)
    rows = [(1, 0, -1, 0, i, i, 1, np.arange(3).tobytes(), np.arange(i, i + 50, dtype=np.uint64).tobytes()) for i in range(30)]
    whole = sorted(nj.compare(rows, 800))
    want = {i: sum(0 < abs(i - j) <= 5 for j in range(30)) for i in range(30)}
    assert {i: n for i, _, n, _ in whole} == want
    assert {r for *_, r in whole} == {0}


def test_small_blocks(spark):
    docs = corpus(3, 4, 40)
    assert run(spark, docs, block=7) == brute(docs)


def test_empty(spark):
    assert nj.join_ngrams(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_and_hashes():
    b, r = nj.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999
    words, counts = word_hashes([b"a bc", b"", b" bc\ta ", b"a b c"])
    assert counts.tolist() == [2, 0, 2, 3]
    assert words[0] == words[3] == words[4] and words[1] == words[2]
    sets, sizes = shingle_sets([b"a b c d e f", b"x", b"", b"a b c d e a b c d e"])
    assert sizes.tolist() == [2, 1, 0, 5]


def test_bands_reach_every_recall():
    assert nj.choose_bands(0.8, 0.999) == (10, 3)
    for t, recall in ((0.3, 0.999), (0.4, 0.999), (0.8, 1 - 1e-9), (0.1, 0.99), (1.0, 0.999)):
        b, r = nj.choose_bands(t, recall)
        assert 1 - (1 - t**r) ** b >= recall - 1e-12


def test_production_recall_and_low_threshold_equal_brute_force(spark):
    docs = corpus(1, 40, 25)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for t in (0.8, 0.4):
        got = {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in nj.join_ngrams(df, threshold=t).collect()}
        assert got == brute(docs, t)


def test_repeated_and_null_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = [(1, a), (1, a), (2, a), (1, b), (3, b), (None, a), (None, None), (4, None), (4, ""), (5, "else " * 9)]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.group_id or 0, r.n_links) for r in nj.join_ngrams(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (1, 1, 1, 1), (3, 1, 1, 1), (0, 0, 0, 0), (0, 0, 0, 0), (4, 4, 4, 0), (4, 4, 4, 0), (5, 5, 5, 0)])


def test_repeats_with_near_copies(spark):
    docs = corpus(4, 10, 20)
    want = brute(docs)
    twice = docs + [d for d in docs if d[0] == 5003]
    got = {r.doc_id: r.n_links for r in nj.join_ngrams(spark.createDataFrame(twice, "doc_id long, text string"), recall=0.999999).collect()}
    near = {i for i, x in docs if len(grams(x) & grams(dict(docs)[5003])) >= 0.8 * len(grams(x) | grams(dict(docs)[5003])) and grams(x)}
    assert got == {i: n + (i in near) for i, (_, _, n) in want.items()}
