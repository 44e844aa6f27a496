"""Decontamination of texts that are winnowed in pieces."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from tallyforge.llm import decontaminate as dc

SMALL_HEAP = """
import random
from pyspark.sql import SparkSession
from tallyforge.llm.decontaminate import apply_decontamination
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
r = random.Random(2)
words = [f"w{r.randrange(99999)}" for _ in range(800_000)]
docs = spark.createDataFrame([(1, " ".join(words[:400_000]))], "doc_id long, text string").selectExpr("doc_id", "concat(text, ' Odd, ', text) as text")
items = spark.createDataFrame([(1, " ".join(words[399_990:400_000]) + " odd " + " ".join(words[:10]))], "item_id long, text string")
print("found", [tuple(x) for x in apply_decontamination(docs, items).select("n_words", "n_hit", "n_items").collect()])
spark.stop()
"""


def test_a_long_text_in_a_small_heap(tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 700m pyspark-shell", "PYTHONPATH": str(Path(__file__).resolve().parents[2]), "SPARK_LOCAL_DIRS": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", SMALL_HEAP], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "found [(800001, 21, 1)]" in run.stdout, run.stderr[-2000:]


@pytest.mark.parametrize("limit", [dc.BROADCAST_ROWS, 0])
def test_windows_across_pieces(spark, limit):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgé\U0001f600") for _ in range(r.randint(4, 12)))
    words = [word() for _ in range(3 * dc.PIECE + 50)]
    gaps = ["; ", " ", "\n\n", " A ", "-"]
    text = "".join(w + r.choice(gaps) for w in words)
    flat = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()]
    items = [(k, " ".join(flat[at : at + n])) for k, (at, n) in enumerate([(p * dc.PIECE + d, n) for p in (1, 2, 3) for d in (-13, -12, -7, -1, 0, 1) for n in (13, 20)])]
    items += [(100, " ".join(flat[dc.PIECE - 2 : dc.PIECE + 1])), (101, " ".join(flat[-13:])), (102, "no such words")]
    long_gap, long_word = flat[0] + ";" * 70_000 + " ".join(flat[1:20]), "x" * 70_000 + " " + " ".join(flat[-20:])
    docs = [(1, text), (2, ";" * 70_000), (3, long_gap), (4, long_word), (5, None), (6, " ".join(flat[:30]))]
    assert len(text.encode()) > dc.LONG
    out = dc.apply_decontamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit)
    got = {x.doc_id: (x.n_words, x.n_hit, x.item_ids, [tuple(s) for s in x.spans]) for x in out.collect()}
    at = lambda ws, w: [i for i in range(len(ws) - len(w) + 1) if ws[i : i + len(w)] == w]
    for i, t in docs:
        ws = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
        hit, found = set(), set()
        for k, x in items:
            x = x.split()
            for w in [x[j : j + 13] for j in range(max(1, len(x) - 12))]:
                for p in at(ws, w):
                    hit |= {*range(p, p + len(w))}
                    found.add(str(k))
        assert got[i][:3] == (len(ws), len(hit), sorted(found)), i
        assert sum(n for _, n in got[i][3]) == len(hit)
        assert {p for s, n in got[i][3] for p in range(s, s + n)} == hit


def test_repeated_ids_of_unlike_lengths_by_shuffle(spark):
    leak = " ".join(f"w{k}" for k in range(13))
    docs = spark.createDataFrame([(1, "a b c " * 30 + leak), (1, "a b")], "doc_id long, text string")
    out = dc.apply_decontamination(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"), broadcast_rows=0)
    assert sorted((x.n_words, x.n_hit) for x in out.collect()) == [(2, 13), (103, 13)]
