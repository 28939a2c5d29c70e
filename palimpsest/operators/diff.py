"""Differences of snapshots, chunk by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coords import KEY, REGION, with_region
from palimpsest.plans.scope import WORLD, Scope


def diff_commits(old: DataFrame, new: DataFrame, scope: Scope = WORLD) -> DataFrame:
    """(key, old, new) for each chunk of either side that differs."""
    a = old.where(scope.contains()).select(*KEY, F.col("hash").alias("old"))
    b = new.where(scope.contains()).select(*KEY, F.col("hash").alias("new"))
    return a.join(b, list(KEY), "full").where(~F.col("old").eqNullSafe(F.col("new")))


def diff_world(world: DataFrame, commit: DataFrame, scope: Scope = WORLD, include_removed: bool = False) -> DataFrame:
    """(key, old, new) for each chunk of the world that differs from a commit.

    A broad comparison goes over the world's chunks, so chunks that only the
    commit has are not told unless ``include_removed``.
    """
    both = diff_commits(commit, world, scope)
    return both if include_removed else both.where(F.col("new").isNotNull())


def diff_keys(keys: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, old, new) for named keys, whether they are on either side or not, where the sides differ."""
    a, b = (t.select(*KEY, F.col("hash").alias(n)) for t, n in ((old, "old"), (new, "new")))
    joined = keys.select(*KEY).distinct().join(a, list(KEY), "left").join(b, list(KEY), "left")
    return joined.where(~F.col("old").eqNullSafe(F.col("new")))


def by_region(differences: DataFrame) -> DataFrame:
    """Added, removed and modified chunks of each region."""
    count = lambda c: F.sum(c.cast("long")).alias
    return with_region(differences).groupBy(*REGION).agg(
        count(F.col("old").isNull())("added"),
        count(F.col("new").isNull())("removed"),
        count(F.col("old").isNotNull() & F.col("new").isNotNull())("modified"),
    )
