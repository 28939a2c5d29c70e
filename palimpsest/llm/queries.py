"""The queries of this subpackage, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm._common import read_table
from palimpsest.llm.decontaminate import ORACLE_SQL as LEAKS_SQL
from palimpsest.llm.decontaminate import find_leaks
from palimpsest.llm.embedding_dedup import embedding_groups
from palimpsest.llm.html_extract import extract_pages
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.quality import classify_quality
from palimpsest.llm.secret_scan import scan_secrets
from palimpsest.llm.sharding import shard_documents
from palimpsest.llm.simhash import simhash_groups
from palimpsest.llm.token_counts import count_tokens
from palimpsest.llm.toxicity import classify_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), 40)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return find_leaks(docs, bench).drop("hit_words")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents")).drop("clean_text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Query]:
    found = (
        op1_simhash_dedup, op2_sharding, op3_decontamination, op4_toxicity, op5_token_counts,
        op6_embedding_dedup, op7_html_extraction, op8_quality, op9_secret_scan, op10_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": LEAKS_SQL}
