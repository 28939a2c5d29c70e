"""The three-level hash tree of a snapshot, and statistics over it.

A region node lists its chunks as (cx, cz, hash), a dimension node its regions
as (kind, rx, rz, hash), the root its dimensions as (dim, hash). A region has at
most 1024 chunks. A dimension's node is one list of 44 bytes for each of its
regions, as the data model has it, and is gathered after the regions' hashes
were made in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialize
from palimpsest.functions.coords import KEY, LEAST_REGION, MOST_REGION, REGION, SIDE, with_region
from palimpsest.functions.digest import DIM_TAG, EMPTY_ROOT, REGION_TAG, ROOT_TAG, hex_int, tagged_digest


def _node(tag: str, order: list[str], widths: list[int], digest: str) -> Column:
    """Digest of a group's entries in order; numbers are hex of ``widths`` digits."""
    entries = F.array_sort(F.collect_list(F.struct(*order, digest)))
    shown = F.transform(
        entries, lambda e: F.concat(*(hex_int(e[c], w) for c, w in zip(order, widths, strict=True)), e[digest])
    )
    return tagged_digest(tag, F.array_join(shown, ""))


def region_nodes(entries: DataFrame) -> DataFrame:
    """(dim, kind, rx, rz, region_hash) of a snapshot."""
    return with_region(entries).groupBy(*REGION).agg(_node(REGION_TAG, ["cx", "cz"], [2, 2], "hash").alias("region_hash"))


def dim_nodes(regions: DataFrame) -> DataFrame:
    """(dim, dim_hash) of region nodes."""
    return regions.groupBy("dim").agg(_node(DIM_TAG, ["kind", "rx", "rz"], [8, 8, 8], "region_hash").alias("dim_hash"))


def root_node(dims: DataFrame) -> DataFrame:
    """One row with the root's hash; the hash of the tag alone for no dimension."""
    return dims.agg(_node(ROOT_TAG, ["dim"], [8], "dim_hash").alias("root_hash")).select(
        F.coalesce("root_hash", F.lit(EMPTY_ROOT)).alias("root_hash")
    )


def root_edges(dims: DataFrame, root_hash: str) -> DataFrame:
    return dims.select(F.lit(root_hash).alias("root_hash"), "dim", "dim_hash")


def dim_edges(regions: DataFrame, dims: DataFrame) -> DataFrame:
    return regions.join(dims, "dim").select("dim_hash", "kind", "rx", "rz", "region_hash")


def region_edges(entries: DataFrame, regions: DataFrame) -> DataFrame:
    return with_region(entries).join(regions, list(REGION)).select("region_hash", "cx", "cz", "hash")


def snapshot(roots: DataFrame, root_edge: DataFrame, dim_edge: DataFrame, region_edge: DataFrame) -> DataFrame:
    """Chunks of the snapshots under the hashes of ``roots``, by joins down the levels."""
    walk = roots.select("root_hash").join(root_edge, "root_hash").join(dim_edge, "dim_hash").join(region_edge, "region_hash")
    return walk.select(
        "root_hash", "dim", "kind", (F.col("rx") * SIDE + F.col("cx")).alias("x"), (F.col("rz") * SIDE + F.col("cz")).alias("z"), "hash"
    )


def read_nodes(wanted: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Entries of the nodes named in (place, key), a node as often as it is named; a node that is not stored is an error."""
    entries = [c for c in edges.columns if c != key]
    nodes = edges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*entries))).alias("entries"))
    told = F.raise_error(F.concat(F.lit("node missing from the store: "), F.col(key)))
    found = wanted.join(nodes, key, "left")
    return found.select("place", key, F.when(F.col("entries").isNull(), told.cast(nodes.schema["entries"].dataType)).otherwise(F.col("entries")).alias("entries"))


def lookup(root_hash: str, key: tuple[int, int, int, int], root_edge: DataFrame, dim_edge: DataFrame, region_edge: DataFrame) -> DataFrame:
    """The chunk at a key, or no row; each level is filtered before it is joined."""
    dim, kind, x, z = key
    top = root_edge.where((F.col("root_hash") == root_hash) & (F.col("dim") == dim))
    middle = dim_edge.where((F.col("kind") == kind) & (F.col("rx") == x >> 5) & (F.col("rz") == z >> 5))
    low = region_edge.where((F.col("cx") == x & 31) & (F.col("cz") == z & 31))
    return snapshot(top.select("root_hash").distinct(), top, middle, low)


def merged(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot with changes applied: present ones replace, null ones remove."""
    new = changes.select(*KEY, F.col("hash").alias("_new"), F.lit(True).alias("_set"))
    both = base.select(*KEY, "hash").join(new, list(KEY), "full")
    kept = F.when(F.col("_set").isNotNull(), F.col("_new")).otherwise(F.col("hash"))
    return both.select(*KEY, kept.alias("hash")).where(F.col("hash").isNotNull())


def _counters(before: str, after: str) -> list[Column]:
    old, new = F.col(before), F.col(after)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return [
        count(new.isNotNull() & ~new.eqNullSafe(old)).alias("fresh_chunks"),
        count(new.isNull() & old.isNotNull()).alias("fresh_tombstones"),
    ]


def diff_stats(current: DataFrame, base: DataFrame, by: list[str] | None = None) -> DataFrame:
    """fresh_chunks, fresh_tombstones, new_blobs and effective_chunks between snapshots, for each value of ``by``.

    ``new_blobs`` are different hashes of ``current`` that ``base`` has nowhere.
    """
    by = by or []
    keys = [*by, *KEY]
    a = current.select(*keys, F.col("hash").alias("_new"))
    b = base.select(*keys, F.col("hash").alias("_old"))
    joined = a.join(b, keys, "full")
    per_chunk = joined.groupBy(*by).agg(*_counters("_old", "_new"), F.count("_new").alias("effective_chunks"))
    hashes = a.groupBy(*by, F.col("_new").alias("_h")).agg(F.lit(1).alias("_one"))
    known = b.select(*by, F.col("_old").alias("_h")).distinct()
    fresh = hashes.join(known, [*by, "_h"], "left_anti").groupBy(*by).agg(F.count("*").alias("new_blobs"))
    out = per_chunk.join(fresh, by, "left") if by else per_chunk.crossJoin(fresh)  # one row each
    return out.select(*by, "fresh_chunks", "fresh_tombstones", F.coalesce("new_blobs", F.lit(0)).cast("long").alias("new_blobs"), "effective_chunks")


def pruned(current: DataFrame, base: DataFrame, nodes: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both snapshots without the regions whose hashes agree.

    ``nodes`` are the region nodes of both as a store has them; without them
    they are made once for each side. Equal dimensions have equal regions, so
    one anti-join by region is enough.
    """
    a, b = nodes or tuple(materialize(region_nodes(t)) for t in (current, base))
    same = a.join(b, [*REGION, "region_hash"]).select(*REGION)
    return tuple(with_region(t).join(same, list(REGION), "left_anti").select(*KEY, "hash") for t in (current, base))


def ordered(entries: DataFrame, most: int | None = None) -> DataFrame:
    """A snapshot in the order of its keys; with ``most`` only so many first rows, of which no full sort is made."""
    rows = entries.orderBy(*KEY)
    return rows if most is None else rows.limit(most)


def _faults(edges: DataFrame, key: str, digest: Column, outside: Column, place: list[str], child: str) -> DataFrame:
    """Faults of stored nodes of one level, the first of each node that is not well."""
    checked = edges.groupBy(key).agg(
        digest.alias("_digest"),
        F.max(outside.cast("int")).alias("_out"),
        (F.count("*") - F.countDistinct(*place)).alias("_twice"),
        F.max((~F.coalesce(F.col(child).rlike("^[0-9a-f]{64}$"), F.lit(False))).cast("int")).alias("_bad"),
    )
    fault = (
        F.when(F.col("_out") > 0, "place out of range")
        .when(F.col("_twice") > 0, "repeated place")
        .when(F.col("_bad") > 0, "malformed digest")
        .when(F.col("_digest") != F.col(key), "digest mismatch")
    )
    return checked.select(key, fault.alias("fault")).where(F.col("fault").isNotNull())


def verify_nodes(region_edge: DataFrame) -> DataFrame:
    """Faults of stored region nodes: places out of range, repeated places, wrong hashes; no row if all is well."""
    inside = F.col("cx").between(0, SIDE - 1) & F.col("cz").between(0, SIDE - 1)
    return _faults(region_edge, "region_hash", _node(REGION_TAG, ["cx", "cz"], [2, 2], "hash"), ~inside, ["cx", "cz"], "hash")


def verify_dims(dim_edge: DataFrame) -> DataFrame:
    """Faults of stored dimension nodes: kinds or regions out of range, repeated regions, wrong hashes."""
    inside = F.col("kind").between(0, 2) & F.col("rx").between(LEAST_REGION, MOST_REGION) & F.col("rz").between(LEAST_REGION, MOST_REGION)
    digest = _node(DIM_TAG, ["kind", "rx", "rz"], [8, 8, 8], "region_hash")
    return _faults(dim_edge, "dim_hash", digest, ~inside, ["kind", "rx", "rz"], "region_hash")


def verify_roots(root_edge: DataFrame) -> DataFrame:
    """Faults of stored root nodes: repeated dimensions, wrong hashes."""
    return _faults(root_edge, "root_hash", _node(ROOT_TAG, ["dim"], [8], "dim_hash"), F.lit(False), ["dim"], "dim_hash")
