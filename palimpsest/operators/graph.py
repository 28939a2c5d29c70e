"""The graph of commits: (id, created_at_ms, root_hash, seq) and its edges (child_id, parent_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialize


class UnknownCommit(KeyError):
    """A commit that the graph lacks."""


def commit_list(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits in the order of recording with their sorted parents, none as an empty list."""
    parents = edges.groupBy(F.col("child_id").alias("id")).agg(F.array_sort(F.collect_set("parent_id")).alias("parents"))
    joined = commits.join(parents, "id", "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("parents", F.coalesce("parents", none)).orderBy("seq")


def parents_of(edges: DataFrame, commits: DataFrame, commit: str) -> DataFrame:
    """Parents of a commit in hash order; an unknown commit is an error."""
    require(commits, commit)
    return edges.where(F.col("child_id") == commit).select("parent_id").distinct().orderBy("parent_id")


def require(commits: DataFrame, commit: str) -> None:
    if not commits.where(F.col("id") == commit).limit(1).count():
        raise UnknownCommit(commit)


def ancestors(edges: DataFrame, start: DataFrame, together: int = 4) -> DataFrame:
    """(id, depth) of all ancestors of the ids in ``start``, the nearest depth of each, start itself left out.

    Jumps are doubled: from the ancestors of each commit after exactly n steps come
    those after 2n, and what was found within n steps finds, by one such jump,
    what is within 2n. So the rounds grow with the logarithm of the depth. A node
    on a shortest way is at its own nearest depth, so the nearest depth of each
    is enough, and paths are not enumerated: diamonds cost nothing. After so many
    rounds as ``together`` says, four at most, what was found is checkpointed.
    """
    jump = edges.select(F.col("child_id").alias("low"), F.col("parent_id").alias("high")).distinct()
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    far = 1
    while True:
        held = []
        for _ in range(min(together, 4)):
            jump = jump.persist()
            beyond = seen.join(jump, F.col("id") == F.col("low")).select(F.col("high").alias("id"), (F.col("depth") + far).alias("depth"))
            seen = seen.unionByName(beyond).groupBy("id").agg(F.min("depth").alias("depth")).persist()
            held += [jump, seen]
            middle = jump.select(F.col("high").alias("_middle"), F.col("low").alias("_low"))
            jump = middle.join(jump, F.col("_middle") == F.col("low")).select(F.col("_low").alias("low"), "high").distinct()
            far *= 2
        seen = materialize(seen)
        deepest = seen.agg(F.max("depth")).first()[0] or 0
        if deepest >= far // 2:  # else the last jump found nothing, so there is nothing deeper
            jump = materialize(jump)
        for frame in held:
            frame.unpersist()
        if deepest < far // 2:
            return seen.where("depth > 0")


def linear_ancestors(edges: DataFrame, start: str, most: int = 100_000) -> DataFrame:
    """``ancestors`` of one commit in a history without merges, as one recursive query."""
    edges.createOrReplaceTempView("_edges")
    start = start.replace("'", "''")
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE up(id, depth) MAX RECURSION LEVEL {most} AS (
              SELECT '{start}', 0 UNION ALL
              SELECT e.parent_id, depth + 1 FROM up JOIN _edges e ON e.child_id = up.id)
            SELECT id, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY id"""
    )


def history(commits: DataFrame, edges: DataFrame, commit: str) -> DataFrame:
    """A commit and its ancestors as records, nearest first and by hash within a depth; a missing one is an error."""
    require(commits, commit)
    start = commits.sparkSession.createDataFrame([(commit,)], "id string")
    found = ancestors(edges, start).unionByName(start.withColumn("depth", F.lit(0)))
    joined = found.join(commits, "id", "left")
    told = F.raise_error(F.concat(F.lit("commit missing from the graph: "), F.col("id")))
    return joined.withColumn("root_hash", F.when(F.col("root_hash").isNull(), told.cast("string")).otherwise(F.col("root_hash"))).orderBy("depth", "id")


def latest(commits: DataFrame) -> DataFrame:
    """The commit that was recorded last."""
    return commits.orderBy(F.col("seq").desc()).limit(1)
