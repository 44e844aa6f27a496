"""BPE, HTML extraction, WARC audit and chunk dedup."""

import gzip
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from tallyforge.llm import bpe, cdc, warc
from tallyforge.llm.html_extract import extract_html, main_text

RANKS = path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'sabé1!中\u00a0\u2003\x1c", max_size=40)))
def test_bpe_equals_library(library, text):
    codec = bpe.codec(RANKS, PATTERN)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_bpe_with_another_pattern():
    assert bpe.SPACED == PATTERN
    other = r"\p{L}+|[^\p{L}]+"
    encoding = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    text = "two words, and  33 numbers\n"
    assert np.frombuffer(bpe.codec(RANKS, other).encode(text), "<u4").tolist() == encoding.encode_ordinary(text)


def test_bpe_table(spark, library):
    texts = [None, "", "a" * 30000, "The quick  brown\n\n fox", "x y " * 500, "<|endoftext|>"]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = bpe.encode_bpe(df, RANKS, PATTERN)
    for r in out.withColumn("list", bpe.id_array()).collect():
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert list(r.list) == want and np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    again = bpe.decode_bpe(out.select("doc_id", "ids"), RANKS, PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in again.collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode_bpe(df.where("false"), RANKS, PATTERN).count() == 0


PROSE = "The tide came in over the flats, and the boats that had lain on their sides all morning began to lift, one after another."
PAGES = [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain &amp; simple", "plain & simple"), ("<script>var x = '<p>no</p>'", ""),
    (f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}<p>Second,&nbsp;with <b>bold</b>\n text.</article><footer>&copy; x</footer>", f"Title\n{PROSE}\nSecond, with bold text."),
    (f"<div id=top class='site-header'>Logo</div><div class='content'><p>{PROSE}</p><p>More<br>here.</p><div class=ad>Buy</div></div><div class=sidebar><p>{PROSE}</p></div><div id=comments><p>{PROSE} {PROSE}</p></div>", f"{PROSE}\nMore here."),
    (f"<article><p>{PROSE}</p><aside>Note</aside><form><p>{PROSE}</p></form><section class='reader-comments'><p>nice</p></section><div class='cookie-notice'>ok?</div><p>End &lt;tag&gt; &#233;.</p></article>", f"{PROSE}\nEnd <tag> é."),
    (f"<ul><li><a href=a>one</a><li><a href=b>two</a></ul><div><p>{PROSE}</p><ul><li>first<li>second</ul></div>", f"{PROSE}\nfirst\nsecond"),
    (f"<!-- <p>x</p> --><body class='has-sidebar'><main><p title=\"a > b\">{PROSE}</p></main></body>", PROSE),
    (f"<article><p>{PROSE}</p><p style='display: none'>hidden</p><p hidden>gone</p><p", PROSE),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert main_text(page) == want


def test_html_table_and_broken_markup(spark):
    df = spark.createDataFrame([(k, p, 1) for k, (p, _) in enumerate(PAGES)], "page_id long, html string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_html(df).collect()}
    assert got == {k: (w, len(w)) for k, (_, w) in enumerate(PAGES)}
    assert extract_html(df.where("false")).count() == 0
    r = random.Random(5)
    parts = ["<p>", "</p>", "<div>", "</div>", "<a href='", '"', "'", ">", "<", "text, ", "<li>", "</article>", "<script>", "<!--", "&amp", "<table><tr><td>", "<br/>", "<svg>"]
    for _ in range(300):
        main_text("".join(r.choice(parts) for _ in range(r.randint(1, 60))))
    assert main_text("<div>" * 20000 + PROSE) == PROSE
    assert main_text('<a x="' * 3000).count("\n") == 0


def test_warc_audit(spark):
    rows = [(k, f"http://x/{k}", None if k % 7 == 0 else "é" * k) for k in range(700)] + [(None, None, "lost key")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, seq int")
    here = warc.warc_records(df)
    assert warc.audit(here, here).count() == 0
    other = [(k, u, ("à" + t[1:]) if k in (3, 300, 302, 699) and t else t) for k, u, t in rows if k != 650]
    there = warc.warc_records(spark.createDataFrame(other, "page_id long, url string, html string"))
    bad = {(r.file, r.seq) for r in warc.audit(here, there).collect()}
    place = {r.page_id: (r.file, r.seq) for r in here.collect()}
    moved = {place[k] for k in range(650, 700)}
    assert bad == {place[3], place[300], place[302]} | moved
    data = b""
    for r in sorted((r for r in here.collect() if r.file == 0), key=lambda r: r.seq):
        body = (rows[r.page_id][2] or "").encode()
        one = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{r.page_id}>\r\nWARC-Target-URI: http://x/{r.page_id}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        assert (r.offset, r.length, r.sha256) == (len(data), len(one), hashlib.sha256(one).hexdigest())
        data += one
    assert [(a, n) for a, n, *_ in warc.parse_warc(data)] == [(r.offset, r.length) for r in sorted((r for r in here.collect() if r.file == 0), key=lambda r: r.seq)]
    assert warc.audit(here.where("false"), here.where("false")).count() == 0
    assert warc.audit(here.where("file = 1"), here.where("false")).count() == 256


def test_read_warc(spark, tmp_path):
    one = b"WARC/1.1\r\nWARC-Target-URI: http://u\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one * 2 + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) * 2)
    for stream in (True, False):
        rows = warc.read_warc(spark, f"file://{tmp_path}", stream).orderBy("file", "seq").collect()
        assert [(r.seq, r.offset, r.length, bytes(r.payload), r.url, r.sha256) for r in rows] == [(k, k * len(one), len(one), b"abc", "http://u", hashlib.sha256(one).hexdigest()) for k in (0, 1)] * 2


def test_warc_records_of_repeated_negative_and_null_keys(spark):
    rows = [(None, f"x{k % 30}") for k in range(60)] + [(7, "same")] * 20 + [(7, f"other {k}") for k in range(40)] + [(-1, "a"), (-256, "b"), (-257, "c"), (8, None)]
    df = spark.createDataFrame([(k, "u", t) for k, t in rows], "page_id long, url string, html string")
    got = warc.warc_records(df).collect()
    assert len(got) == len(rows) and {r.file for r in got if r.page_id is None} == {-1}
    assert {r.page_id: r.file for r in got if r.page_id is not None} == {7: 0, 8: 0, -1: -2, -256: -2, -257: -3}
    for file in {r.file for r in got}:
        own = sorted((r for r in got if r.file == file), key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(len(own)))
        assert [r.offset for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert [r.page_id for r in own] == sorted((r.page_id for r in own), key=lambda k: k or 0)
    assert warc.audit(warc.warc_records(df), warc.warc_records(df.repartition(5))).count() == 0
    other = df.withColumn("html", F.when(F.col("page_id") == -257, "d").otherwise(F.col("html")))
    assert [(r.file, r.seq) for r in warc.audit(warc.warc_records(df), warc.warc_records(other)).collect()] == [(-3, 0)]


def test_one_root_covers_all_files(spark):
    rows = spark.range(0, 5000, 7).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    other = rows.withColumn("html", F.when(F.col("page_id") == 4998, "x").otherwise(F.col("html")))
    levels = warc.merkle_levels([warc.warc_records(rows, per_file=64), warc.warc_records(other, per_file=64)], fanout=4)
    sizes = [(n := x.groupBy("side").count().collect()) and [r["count"] for r in n] for x, *_ in levels]
    assert sizes[0] == [715, 715] and sizes[-1] == [1, 1] and all(a[0] >= b[0] for a, b in zip(sizes, sizes[1:], strict=False))
    top = {r.side: bytes(r.digest) for r in levels[-1][0].collect()}
    assert top[0] != top[1]
    assert len([r for x, *_ in levels for r in x.groupBy("file", "node").agg(F.count_distinct("digest").alias("n")).where("n > 1").collect()]) == len(levels)


def chunks_by_hand(x):
    h, last, out = 0, 0, []
    for k, b in enumerate(x):
        h = sum(int(cdc.GEAR[x[k - j]]) << j for j in range(min(16, k + 1))) & 0xFFFF
        if k + 1 - last >= cdc.MOST or k + 1 - last >= cdc.LEAST and h < 1 << 11:
            out.append(k + 1)
            last = k + 1
    return out + ([len(x)] if last < len(x) else [])


def test_boundaries():
    r = random.Random(6)
    for n in (0, 1, 15, 16, 17, 40, 3000):
        x = bytes(r.randrange(256) for _ in range(n))
        assert cdc.boundaries(x) == chunks_by_hand(x)
    assert cdc.boundaries(b"a" * 1000) == chunks_by_hand(b"a" * 1000)
    x, y = bytes(r.randrange(97, 123) for _ in range(4000)), b"inserted"
    cut = lambda d: {d[a:b] for a, b in zip([0, *cdc.boundaries(d)], cdc.boundaries(d), strict=False)}
    assert len(cut(x) - cut(x[:2000] + y + x[2000:])) <= 4


def dedup_by_hand(docs):
    """Chunks in order of id and place; stretches of repeats of STRETCH bytes or more go."""
    seen, want = {}, {}
    cut = lambda x: list(zip([0, *cdc.boundaries(x)], cdc.boundaries(x), strict=False))
    for i, t in sorted(docs, key=lambda d: d[0]):
        x = (t or "").encode()
        for a, b in cut(x):
            seen.setdefault(x[a:b], (i, a))
    for i, t in docs:
        x = (t or "").encode()
        out, hold = b"", b""
        for a, b in [*cut(x), (len(x), len(x))]:
            if a < b and seen[x[a:b]] != (i, a):
                hold += x[a:b]
            else:
                out += (hold if len(hold) < cdc.STRETCH else b"") + x[a:b]
                hold = b""
        want[i] = (len(x), len(x) - len(out), out)
    return want


def test_chunk_dedup(spark):
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared, phrase = text(500), text(70)
    docs = [(k, text(300) + (shared if k % 3 == 0 else phrase) + text(100)) for k in range(30)] + [(99, None), (98, ""), (97, shared * 3), (96, shared[:100]), (200, "long " + text(200_000))]
    want = dedup_by_hand(docs)
    out = cdc.dedup_chunks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept int").repartition(3))
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.collect()} == want
    assert all(r.n_removed > 0 for r in out.collect() if r.doc_id % 3 == 0 and 0 < r.doc_id < 30)
    assert all(r.n_removed == 0 for r in out.collect() if r.doc_id % 3 and r.doc_id < 30)
    assert cdc.dedup_chunks(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunk_dedup_of_repeated_and_null_ids(spark):
    r = random.Random(8)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(600)) for _ in range(2))
    docs = [(1, a), (1, a), (1, b), (2, a + b), (None, a), (None, None)]
    out = cdc.dedup_chunks(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed > 0) for x in out.collect())
    assert got == [(0, 0, False), (0, 600, False), (1, 600, False), (1, 600, False), (1, 600, False), (2, 1200, True)]
