"""The corpus pipeline: language, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes every stage's rows before the next one reads them. Every stage gives no rows for an
empty table, keeps columns of any name as they are, and treats equal rows alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorusmill.llm import hyperminhash, language_id, packing, suffix_dedup, surrogates
from chorusmill.llm.common import documents, materialize, tune
from chorusmill.llm.tokens import vocabulary_path

#: SQL cannot express language models, byte-level removal or token packing; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars (where it is a column) following its text."""
    out = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return out.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go (no letters, or no language at least as likely as all others together);
    lang becomes the predicted language, so null and wrong labels are mended."""
    tune(spark)
    return language_id.keep_identified(docs, vocabulary_path("piece_bpe_32k.model"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least doc_id."""
    tune(spark)
    return hyperminhash.keep_first(docs, num=80, den=100, words=5)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 100-byte string that also starts earlier goes."""
    tune(spark)
    return _with_text(suffix_dedup.clean(docs, length=100), docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities become surrogates; other texts stay as they are."""
    tune(spark)
    return _with_text(surrogates.replace_entities(docs), docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    tune(spark)
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), window=1024, end_id=0, last_use=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("surrogates", replace_personal_data),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
