"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialize, shared_folder  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory; only Spark touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def binary_text(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))


def free_prefix(columns: list[str], base: str) -> str:
    """A prefix for inner columns with which none of the given columns begins, whatever their case."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base = f"_{base}"
    return base


def utf8(value: bytes | None) -> str:
    """Decoded text; bytes that are no UTF-8 become U+FFFD instead of an error."""
    return (value or b"").decode("utf-8", "replace")


def slices_by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows of about ``limit`` text bytes each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start, held = 0, 0
    for row, length in enumerate(lengths):
        if row > start and held + length > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(length)
    yield batch.slice(start)


def numbered(df: DataFrame, group: str, spread: Column, number: str, buckets: int = 1024) -> DataFrame:
    """Add ``number``: gapless from 0 within each value of ``group``.

    Rows of a group are dealt into ``buckets`` by a hash of ``spread`` and of
    their place in the table, so that equal rows part too, and are
    numbered in each bucket; a table of one count for each group and bucket,
    whose size does not follow the data, gives every bucket its first number.
    So no group ever meets in one task. ``df`` must be materialised, as it is
    read twice in the same order.
    """
    from pyspark.sql import Window

    placed = df.withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.withColumn("_bucket", F.pmod(F.xxhash64(spread, "_place"), F.lit(buckets)).cast("int")).drop("_place")
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    first = counts.withColumn(
        "_first",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), "_first")
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(spread))
    return (
        dealt.withColumn("_inside", inside)
        .join(first, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(number, F.col("_first") + F.col("_inside") - 1)
        .drop("_bucket", "_inside", "_g", "_b", "_first")
    )
