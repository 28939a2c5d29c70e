"""Connected components of a table of links, by alternating large and small stars.

Every round replaces the links of each node by links to the smallest node that
it sees, until the links no longer change; then each node points at the smallest
node of its component. A round is two joins on the node with pre-aggregated
minima, and its result is checkpointed in the shared folder. The links of a node
meet in one task only up to ``HUB`` of them; nodes with more get their minima by
a broadcast instead, and their links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import materialize


def _signature(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
    ).first()
    return int(row["n"]), int(row["s"] or 0)


HUB = 1 << 20  # links of a node; pairs of longs, so some 20 MB


def _with_low(links: DataFrame, low: DataFrame, count: int, hub: int) -> DataFrame:
    """Links (u, v) with the minimum m of u; ``low`` is (u, m, n) with the number of links."""
    plain = low.select("u", "m")
    if count <= hub:  # no node can have more
        return links.join(plain, "u")
    hubs = materialize(low.where(F.col("n") > hub).select("u", "m"))  # at most count / hub rows
    if not hubs.take(1):
        return links.join(plain, "u")
    rest = links.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return rest.join(plain, "u").unionByName(links.join(F.broadcast(hubs), "u"))


def connected_components(links: DataFrame, a: str, b: str, hub: int = HUB) -> DataFrame:
    """Return (node, root) for every node with a link; root is the smallest node reachable.

    Links of a node with itself, and links with a null end, say nothing. Repeated
    links count once. No links give an empty table.
    """
    known = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    known = materialize(known.distinct())
    before = _signature(known)
    while before[0]:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        seen = _with_low(both, low, before[0], hub)
        large = seen.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if before[0] > hub:
            large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            _with_low(large, low, before[0], hub)
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        )
        known = materialize(small.distinct())
        after = _signature(known)
        if after == before:
            break
        before = after
    roots = known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
