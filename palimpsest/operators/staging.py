"""What a commit would record: changes, tombstones, and the counters of status and commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coords import KEY, REGION, with_region
from palimpsest.plans.scope import WORLD, Scope


def changed_chunks(current: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of ``current`` that are new or differ from ``base``."""
    before = base.select(*KEY, F.col("hash").alias("_before"))
    return current.join(before, list(KEY), "left").where(~F.col("hash").eqNullSafe(F.col("_before"))).drop("_before")


def tombstones(current: DataFrame, base: DataFrame, scope: Scope = WORLD) -> DataFrame:
    """Keys of ``base`` inside the scope that ``current`` lacks."""
    return base.where(scope.contains()).join(current, list(KEY), "left_anti").select(*KEY)


def regions(entries: DataFrame) -> DataFrame:
    return with_region(entries).select(*REGION).distinct()


def removed_regions(current_regions: DataFrame, base: DataFrame, scope: Scope = WORLD) -> DataFrame:
    """Regions of ``base`` that the scope touches and that are gone; whole files, whatever the scope holds of them."""
    return regions(base).where(scope.matches_region()).join(current_regions, list(REGION), "left_anti")


def new_files(changed: DataFrame, base: DataFrame) -> DataFrame:
    """Regions of changed chunks that ``base`` lacks."""
    return regions(changed).join(regions(base), list(REGION), "left_anti")


def changes(current: DataFrame, base: DataFrame, scope: Scope = WORLD) -> DataFrame:
    """All changes as (key, hash), with a null hash for a tombstone, by one join of both sides."""
    now = current.where(scope.contains()).select(*KEY, F.col("hash").alias("_now"), F.lit(True).alias("_here"))
    before = base.where(scope.contains()).select(*KEY, F.col("hash").alias("_before"))
    both = now.join(before, list(KEY), "full")
    changed = F.col("_here").isNull() | ~F.col("_now").eqNullSafe(F.col("_before"))
    return both.where(changed).select(*KEY, F.col("_now").alias("hash"))


def _n(column: Column) -> Column:
    return F.coalesce(F.sum(column.cast("long")), F.lit(0)).cast("long")


def change_report(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row: chunks and tombstones of (key, hash) changes, and different payloads that are new to the store."""
    known = blobs.select(F.col("hash").alias("_known")).distinct()
    joined = changes.join(known, F.col("hash") == F.col("_known"), "left")
    fresh = F.when(F.col("_known").isNull(), F.col("hash"))
    return joined.agg(
        _n(F.col("hash").isNotNull()).alias("chunks"),
        F.countDistinct(fresh).alias("new_blobs"),
        _n(F.col("hash").isNull()).alias("tombstones"),
    )


def commit_report(current: DataFrame, base: DataFrame, blobs: DataFrame, scope: Scope = WORLD) -> DataFrame:
    """One row: chunks and tombstones recorded, and different payloads that are new to the store."""
    return change_report(changes(current, base, scope), blobs)


def status_report(current: DataFrame, base: DataFrame, blobs: DataFrame, scope: Scope = WORLD, current_regions: DataFrame | None = None) -> DataFrame:
    """One row of what a commit would do.

    ``new_blobs`` counts changed chunks whose payload the store lacks, so two
    that share a payload are two here and one for a commit. ``deleted_files``
    counts whole regions that the scope touches.
    """
    if current_regions is None:
        current_regions = regions(current)
    found = with_region(changes(current, base, scope))
    known = blobs.select(F.col("hash").alias("_known")).distinct()
    here = regions(base).withColumn("_old", F.lit(True))
    joined = found.join(known, F.col("hash") == F.col("_known"), "left").join(here, list(REGION), "left")
    place, present = F.struct(*REGION), F.col("hash").isNotNull()
    counted = joined.agg(
        F.countDistinct(place).alias("changed_regions"),
        F.countDistinct(F.when(present & F.col("_old").isNull(), place)).alias("new_files"),
        _n(present).alias("new_chunks"),
        _n(~present).alias("tombstones"),
        _n(present & F.col("_known").isNull()).alias("new_blobs"),
    )
    gone = removed_regions(current_regions, base, scope).agg(F.count("*").alias("deleted_files"))
    clean = (F.col("new_chunks") == 0) & (F.col("tombstones") == 0) & (F.col("deleted_files") == 0)
    # one row with one row
    return counted.crossJoin(gone).select(
        clean.alias("clean"), "changed_regions", "new_files", "deleted_files", "new_chunks", "tombstones", "new_blobs"
    )


def first_payloads(entries: DataFrame, payload: str = "payload") -> DataFrame:
    """One payload for each digest, that of the first chunk in key order."""
    return entries.groupBy("hash").agg(F.min_by(payload, F.struct(*KEY)).alias(payload))


def new_blobs(entries: DataFrame, blobs: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads to append to the store: insert if absent, the first payload of a digest wins.

    Known digests go first, so that both steps share one shuffle by digest.
    """
    return first_payloads(entries.join(blobs.select("hash"), "hash", "left_anti"), payload)


def missing_blobs(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Chunks whose payload the store lacks."""
    return entries.join(blobs.select("hash"), "hash", "left_anti").select(*KEY, "hash")


def fetch_blobs(entries: DataFrame, blobs: DataFrame, strict: bool = True) -> DataFrame:
    """Chunks with their payloads; a missing payload is an error, or else left out."""
    joined = entries.join(blobs, "hash", "left" if strict else "inner")
    if strict:
        told = F.raise_error(F.concat(F.lit("blob missing from the store: "), F.col("hash")))
        joined = joined.withColumn("payload", F.when(F.col("payload").isNull(), told.cast("binary")).otherwise(F.col("payload")))
    return joined
