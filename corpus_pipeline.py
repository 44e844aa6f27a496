"""The corpus pipeline: quality rules, near-duplicate removal, repeated bytes, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of ``documents``, others that a table has
beside them, whatever their names, included; of the columns doc_id and text alone are needed. Empty inputs, null and
empty texts pass through the stages as the operators define them (the quality rules reject both). Ids are integers. Rows
that share an id stay or go together in the stages that compare documents; rows without an id are judged by the quality
rules alone, take no part in a comparison, and are encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bpe import encode_bpe
from tallyforge.llm.common import stored, table
from tallyforge.llm.decontaminate import WINDOW, apply_decontamination
from tallyforge.llm.ngram_join import join_ngrams
from tallyforge.llm.quality_rules import apply_quality_rules
from tallyforge.llm.suffix_dedup import dedup_substrings

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in one struct, so that no name among them meets an operator's output."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("__"), *rest).alias("__rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``rows`` of ``packed``; n_chars follows the text."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[own.get(c, F.col(f"__rest.`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others stay as they are.

    The row mark keeps the optimizer from moving the filter below the rules, where it would compute them several times.
    """
    judged = apply_quality_rules(packed(docs)).withColumn("__mark", F.monotonically_increasing_id())
    return unpacked(judged.where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard similarity, the one with the least id stays."""
    groups = join_ngrams(docs.select("doc_id", "text"))
    gone = stored(groups.where("group_id <> doc_id").select("doc_id"), "near")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier are cut out, whole characters at a time."""
    cut = dedup_substrings(packed(docs), whole=True)
    return unpacked(cut.withColumn("text", F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8"))), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark window, or of which one word in twenty lies in shorter items, go.

    The stage before cuts later copies of a leaked passage out of their texts, so a text that it changed is judged as it
    was in ``documents`` too: what is left of it still comes from a leaked source. Those texts are stored, as the winnowing
    and the word counts would each scan ``documents`` for them at once.
    """
    whole = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda df, name: df.select("doc_id", F.xxhash64("text").alias(name))
    changed = digest(docs, "now").join(digest(whole, "then"), "doc_id").where("now <> then").select("doc_id").distinct()
    before = stored(whole.join(stored(changed, "changed"), "doc_id", "left_semi"), "before")
    key = lambda df, old: df.select(F.struct("doc_id", F.lit(old).alias("old")).alias("key"), "text")
    hits = apply_decontamination(key(docs, False).unionByName(key(before, True)), table(spark, sf_dir, "benchmark"), doc_id="key")
    leaked = F.col("contaminated") | F.exists("spans", lambda x: x["length"] >= WINDOW)
    bad = stored(hits.where(leaked).select("key.doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's byte-level BPE ids, packed, with the digest of what they decode to."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    out = encode_bpe(docs.select(*keep, "text"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select(*keep, n.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("suffix_dedup", repeated_bytes), ("decontamination", benchmark_leaks), ("bpe", tokens)]
#: The n-gram join and the tokenizer have no SQL form; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
