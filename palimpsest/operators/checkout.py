"""What a checkout does to each region file, and what a rebuilt file holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coords import KEY, REGION, with_region
from palimpsest.plans.scope import WORLD, Scope


@dataclass(frozen=True)
class Policy:
    """What a checkout keeps, and what it does about missing payloads and files."""

    keep_post_commit_files: bool = False
    keep_post_commit_chunks: bool = False
    keep_tombstoned_chunks: bool = False
    on_missing_blob: str = "abort"  # or "skip"
    on_missing_file: str = "sibling"  # or "derived" or "error"

    @property
    def keeps_files(self) -> bool:
        return self.keep_post_commit_files or self.keep_tombstoned_chunks

    @property
    def keeps_chunks(self) -> bool:
        return self.keep_post_commit_chunks or self.keep_tombstoned_chunks


def restore_groups(commit: DataFrame, scope: Scope = WORLD) -> DataFrame:
    """Chunks of each region to restore; a region that the scope touches is restored whole."""
    groups = with_region(commit).where(scope.matches_region())
    return groups.groupBy(*REGION).agg(F.count("*").alias("chunks"), F.sort_array(F.collect_list(F.struct("cz", "cx", "hash"))).alias("entries"))


def file_plan(commit: DataFrame, found: DataFrame, policy: Policy = Policy(), scope: Scope = WORLD) -> DataFrame:
    """(region, chunks, action) for all files of either side; files left alone have the action keep."""
    wanted = with_region(commit).where(scope.matches_region()).groupBy(*REGION).agg(F.count("*").alias("chunks"))
    here = found.where(scope.matches_region()).select(*REGION, F.lit(True).alias("_here")).distinct()
    action = (
        F.when(F.col("chunks").isNotNull() & F.col("_here").isNotNull(), "rebuild")
        .when(F.col("chunks").isNotNull(), "error" if policy.on_missing_file == "error" else "create")
        .when(F.lit(policy.keeps_files), "keep")
        .otherwise("delete")
    )
    both = wanted.join(here, list(REGION), "full")
    return both.select(*REGION, F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), action.alias("action"))


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: files rebuilt, created, deleted and kept, and chunks restored."""
    of = lambda *names: F.coalesce(F.sum(F.col("action").isin(*names).cast("long")), F.lit(0)).cast("long")
    return plan.agg(
        of("rebuild", "create").alias("rebuilt_files"), of("delete").alias("deleted_files"), of("keep").alias("kept_files"),
        F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("restored_chunks"),
    )


def with_live_chunks(restored: DataFrame, live: DataFrame, policy: Policy) -> DataFrame:
    """The chunks of rebuilt files: those restored and, where kept, live ones that the commit lacks."""
    if not policy.keeps_chunks:
        return restored
    touched = with_region(restored).select(*REGION).distinct()
    extra = with_region(live).join(touched, list(REGION), "left_semi").join(restored, list(KEY), "left_anti")
    return restored.unionByName(extra.select(*restored.columns))
