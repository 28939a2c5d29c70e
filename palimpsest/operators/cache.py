"""Region images that are known to hold what a commit holds, so that their files need no decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coords import REGION


def prove_unchanged(committed: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """Regions whose committed hash has a cached image with the very digest of the live file.

    ``committed`` is (region, region_hash), ``cache`` (region_hash, image_hash),
    ``files`` (region, image_hash). A region without such a proof is just not in
    the result.
    """
    known = committed.join(cache.select("region_hash", "image_hash"), "region_hash")
    return known.join(files.select(*REGION, "image_hash"), [*REGION, "image_hash"]).select(*REGION, "region_hash").distinct()


def split_by_proof(files: DataFrame, proven: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that may be skipped and files that must be decoded."""
    return files.join(proven, list(REGION), "left_semi"), files.join(proven, list(REGION), "left_anti")


def new_images(images: DataFrame, cache: DataFrame) -> DataFrame:
    """Images to append: one for each region hash, the first by image digest, and none that is known."""
    one = images.groupBy("region_hash").agg(F.min("image_hash").alias("image_hash"))
    return one.join(cache.select("region_hash"), "region_hash", "left_anti")


def update_counts(images: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: files, chunks, new and existing entries, and files without chunks."""
    known = cache.select("region_hash", F.lit(True).alias("_known")).distinct()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    full = F.col("chunks") > 0
    fresh = F.countDistinct(F.when(full & F.col("_known").isNull(), F.col("region_hash")))
    return images.join(known, "region_hash", "left").agg(
        F.count("*").alias("files"), n(F.col("chunks")).alias("chunks"), fresh.alias("entries"),
        (n(full) - fresh).alias("existing"), n(~full).alias("empty"),
    )
