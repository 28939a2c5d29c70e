"""A corpus pipeline of five stages: quality, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``. Null texts count as empty, null ids and repeated rows
are taken as the operators say, and empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import free_prefix, read_table, shared_folder
from palimpsest.llm.decontaminate import drop_leaks
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.quality import held_out, score_quality, train_quality
from palimpsest.llm.queries import tokenizer_path
from palimpsest.llm.secret_scan import redact_secrets
from palimpsest.llm.simhash import keep_one_of_each_group

LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = train_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    score = free_prefix(docs.columns, "_quality")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars made to agree."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(clean.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark has for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with Parquet in the shared folder between them; the last stage's stays."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{place}")
        docs = spark.read.parquet(f"{base}/{place}")
        if place:
            _remove(spark, f"{base}/{place - 1}")
    return docs
