"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .sql import SQL  # noqa: F401


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join_ngrams

    return join_ngrams(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import apply_url_filter, fit_url_model
    from .url_labels import labelled_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return apply_url_filter(pages, fit_url_model(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import apply_decontamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_decontamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lm_score import score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_html

    return extract_html(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages against a replica in which two in a hundred records have another first byte."""
    from .warc import audit, warc_records

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lost = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2).isin("07", "2a", "a3", "c5", "e1")
    damaged = pages.withColumn("html", F.when(lost, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    here, there = stored(warc_records(pages), "records"), warc_records(damaged)
    bad = audit(here, there).withColumn("damaged", F.lit(True))
    out = here.join(bad, ["file", "seq"], "left").withColumn("intact", F.col("damaged").isNull())
    return out.select("page_id", "file", "seq", "offset", "length", "sha256", "intact")


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cdc import dedup_chunks

    out = dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_dup_chunks", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_ngram_join, op3_url_filter, op4_bpe, op5_decontaminate, op6_lm_score, op7_html_extract, op8_quality_rules, op9_warc_fixity, op10_chunk_dedup)}
