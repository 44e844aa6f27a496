import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from tallyforge.llm import bpe
from tallyforge.llm.common import GROUP_BYTES, stored

from .test_native import base_by_hand, leaks_by_hand
from .test_ngram_join import brute as links_by_hand
from .test_suffix_dedup import brute as cuts_by_hand


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice(["the", "on", "ti", "er", "a"]) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k)) + "."
    passage, items = text(60), [(k, text(25)) for k in range(4)]
    docs = [(k, text(r.randint(5, 150))) for k in range(40)]
    docs += [(50 + k, text(40) + "\n" + passage + "\n" + text(40)) for k in range(6)]
    docs += [(60 + k, text(30) + "\n" + items[k][1]) for k in range(4)]
    docs += [(70 + k, docs[k][1]) for k in range(5)] + [(80 + k, docs[40 + k][1] + " tail") for k in range(6)]
    docs += [(100 + k, text(400) + "\n" + items[k % 2][1] + "\n" + text(500)) for k in range(3)]  # leaks in long texts, one passage twice
    docs += [(90, None), (91, ""), (92, "w " * 100), (93, "%%% " * 50)]
    return docs, items


def test_run_equals_brute_force(spark, tmp_path):
    docs, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in docs if not base_by_hand(t)[5]]
    groups = links_by_hand(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    before, cuts = leaks_by_hand(left, items), cuts_by_hand(left)
    left = [(i, cuts[i][3].decode()) for i, _ in left]
    after = leaks_by_hand(left, items)
    left = [(i, t) for i, t in left if not (before[i][1] or after[i][1])]
    assert any(before[i][1] and not after[i][1] for i in before)
    assert not {i for i, _ in left} & {*range(60, 64), *range(100, 103)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(cp.TOKENIZER)), special_tokens={})
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in left}
    assert 0 < len(got) < len(docs)


def test_stages_keep_the_columns_of_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns, name
        assert out.count() == 0
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_columns_repeated_and_null_ids(spark, tmp_path):
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) + "."
    a, b, c = text(), text(), text()
    docs = [(1, a, "x", 7), (1, a, "y", 8), (2, b, None, None), (None, c, "z", 9), (3, a, "w", 1), (None, None, "n", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string, n_words long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = df
    for _, stage in cp.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == df.columns
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, a, "x", 7), (1, a, "y", 8), (2, b, None, None), (None, c, "z", 9)], key=str)
    assert cp.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_the_winnowing_scans_the_changed_texts_alone(spark, tmp_path, monkeypatch):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, winnow = [], cp.apply_decontamination
    monkeypatch.setattr(cp, "apply_decontamination", lambda df, *a, **b: seen.append(df) or winnow(df, *a, **b))
    now = table.where("doc_id <> 1").selectExpr("doc_id", "if(doc_id % 2 = 0, text, substring(text, 5)) as text")
    out = cp.benchmark_leaks(spark, now, str(tmp_path))
    assert not {60, 61, 62, 63, 100, 101, 102} & {x.doc_id for x in out.collect()}
    assert not [x for x in seen[0].inputFiles() if "documents.parquet" in x]
    then, after = ({x[0][0]: x[1] for x in seen[0].where(f"key.old = {old}").collect()} for old in ("true", "false"))
    assert then == {i: t for i, t in docs if t and i % 2 and i != 1}
    assert after.keys() == {i for i, _ in docs} - {1}


def test_small_row_groups_between_stages(spark, tmp_path):
    import pyarrow.parquet as pq

    text = "array_join(transform(sequence(1, 10), k -> sha2(concat(id, '-', k), 512)), '')"
    rows = spark.range(0, 60_000, 1, 1).selectExpr("id as doc_id", f"{text} as text")  # 77 MB that do not compress, in one task
    back = stored(rows, "groups")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in back.inputFiles()]
    sizes = [m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)]
    assert max(sizes) < 1.5 * GROUP_BYTES < sum(sizes) / 2
    assert back.count() == 60_000
