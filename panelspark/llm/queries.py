"""The operators of this package as queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunk_dedup import repeated_spans
from .cube import mix_sources
from .decision_list import judge, learn_from
from .decontam import find_contamination
from .fuzzy_lines import fuzzy_lines
from .icws import near_duplicates
from .ngram_trie import score_documents
from .orc_tokens import token_digests
from .semicrf import find_personal_data
from .storage import short_batches
from .url_lr import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """A public byte-level tokenizer file, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "first_doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, learn_from(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return judged.selectExpr("doc_id", "_stats.n_words", "_stats.word_chars", "_stats.n_symbols", "_stats.n_dup_lines", "_stats.n_repeat_words", "_base_failed AS base_failed", "_kept AS kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.selectExpr("doc_id", "_mix_size AS size", "_mix_source_size AS source_size", "_mix_target AS target", "_mix_size * _mix_copies AS taken", "_mix_copies AS copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_score, op2_decontaminate, op3_repeated_passages, op4_quality_rules, op5_url_filter, op6_near_duplicates, op7_personal_data, op8_fuzzy_lines, op9_orc_tokens, op10_mix)
}

#: Only what SQL can express on whole tables; the others are tested against brute force.
SQL: dict[str, str] = {}
