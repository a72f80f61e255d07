"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cap_filters, collocations, gif, html_text, hyperminhash, language_id, licences, oracle, packing, pieces, simple8b, spelling, suffix_dedup, surrogates
from .common import documents, tune
from .tokens import vocabulary_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), window=1024, end_id=0)


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.store_documents(documents(spark, sf_dir)))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(documents(spark, sf_dir).select("doc_id", "text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(documents(spark, sf_dir), num=85, den=100, words=3)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), limit=0.93)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir), length=100)


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.read_token_files(simple8b.write_token_files(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), end_id=2))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_gif": op2_gif,
    "op3_pieces": op3_pieces,
    "op4_surrogates": op4_surrogates,
    "op5_html_text": op5_html_text,
    "op6_hyperminhash": op6_hyperminhash,
    "op7_language_id": op7_language_id,
    "op8_cap_filters": op8_cap_filters,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simple8b": op10_simple8b,
    "op11_spelling": op11_spelling,
    "op12_collocations": op12_collocations,
    "op13_licences": op13_licences,
}

ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
