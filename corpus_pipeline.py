"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again.

Quality rules reject, of each group of near duplicates one document stays,
documents with benchmark items go, sources are mixed to target weights (a
document that is taken more than once becomes as many rows), and the mix is
written as token ids in ORC and digested from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.cube import take_mix
from panelspark.llm.decision_list import judge, learn_from
from panelspark.llm.decontam import drop_contaminated
from panelspark.llm.icws import drop_near_duplicates
from panelspark.llm.orc_tokens import token_digests
from panelspark.llm.queries import table, tokenizer_path
from panelspark.llm.storage import short_batches, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules, keep=COLUMNS).where("_kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return drop_near_duplicates(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return take_mix(docs.select(*COLUMNS))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read from the ORC files."""
    short_batches(spark)
    return token_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Learned rules, near duplicates and sampling aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
