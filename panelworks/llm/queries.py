"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import bpe, decontaminate, language_id, line_dedup, oracles, order_minhash, packing, parity_join, prefix_trie, quality, seekable, token_counts, url_rules, whitening
from panelworks.session import fresh_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_crf_language(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(_read(spark, sf, "documents"))


def op2_parity_join(spark: SparkSession, sf: str) -> DataFrame:
    return parity_join.jaccard_components(_read(spark, sf, "documents"))


def op3_seekable_frames(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    seekable.write_token_files(_read(spark, sf, "documents"), folder, BYTE_BPE)
    return seekable.token_starts(spark, folder)


def op4_repeated_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_dedup.delete_repeated_runs(_read(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_deleted", "text")


def op5_speculative_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf, "documents"), WORD_BPE)


#: Stated host and path rules.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block")]


def op6_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A page shows the document numbered in its path; a toxic or poor document marks its url."""
    pages, labels = _read(spark, sf, "pages"), _read(spark, sf, "labels")
    bad = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    number = F.regexp_extract(url_rules.url_path("url"), r"(\d+)[^/]*/?$", 1)
    shown = pages.select("url", number.try_cast("bigint").alias("doc_id")).join(bad, "doc_id")
    return url_rules.judge_urls(pages, shown.select("url", "blocked"), URL_RULES)


def op7_containment_search(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_items(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


def op8_fourier_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(_read(spark, sf, "documents"), BYTE_BPE)
    return token_counts.length_histogram(lengths)


def op10_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.neighbour_fingerprints(_read(spark, sf, "documents"))


def op11_bit_sliced_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf, "embeddings"))


def op12_dominance_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf, "documents"), WORD_BPE)


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_crf_language, op2_parity_join, op3_seekable_frames, op4_repeated_line_runs, op5_speculative_bpe, op6_url_rules, op7_containment_search, op8_fourier_quality, op9_token_counts, op10_order_minhash,
                            op11_bit_sliced_whitening, op12_dominance_packing, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {
    "op2_parity_join": oracles.PARITY_JOIN,
    "op4_repeated_line_runs": oracles.LINE_DEDUP,
    "op7_containment_search": oracles.CONTAINMENT,
    "op13_prefix_trie": oracles.PREFIX_TRIE,
}
