"""One query for each operator over the driver's tables, with the SQL that checks it."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import coords, names
from palimpsest.functions.coords import KEY, REGION, with_region
from palimpsest.functions.digest import COMMIT_TAG, DIM_TAG, REGION_TAG, ROOT_TAG, dimension_code, hex_int, parse_hex, tagged_digest
from palimpsest.operators import cache, checkout, diff, graph, staging, tree
from palimpsest.plans.scope import Area, Rect, Scope, in_named_scopes, named_scope, selection
from palimpsest.sources import nbt, region_file, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORLDS = """
v0 AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS dim,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS kind,
         CAST(o_orderkey & 255 AS INT) - 128 AS x, CAST(o_orderkey >> 8 AS INT) - 32 AS z, o_orderkey AS k,
         o_custkey || '|' || o_orderstatus || '|' || o_orderpriority AS payload
  FROM orders),
v1 AS (SELECT dim, kind, x, z, sha256(payload) AS hash FROM v0 WHERE k % 10 <> 0),
v2 AS (SELECT dim, kind, x, z, sha256(CASE WHEN k % 10 = 2 THEN payload || '#2' ELSE payload END) AS hash FROM v0 WHERE k % 10 <> 1),
v3 AS (SELECT * FROM v2 WHERE dim <> 5)"""
CHANGES = """
ch AS (SELECT dim, kind, x, z, v2.hash AS hash FROM v2 LEFT JOIN v1 USING (dim, kind, x, z) WHERE v1.hash IS DISTINCT FROM v2.hash),
gone AS (SELECT dim, kind, x, z FROM v1 ANTI JOIN v2 USING (dim, kind, x, z))"""
REGIONS = """
r1 AS (SELECT DISTINCT dim, kind, x >> 5 AS rx, z >> 5 AS rz FROM v1),
r2 AS (SELECT DISTINCT dim, kind, x >> 5 AS rx, z >> 5 AS rz FROM v2),
r3 AS (SELECT DISTINCT dim, kind, x >> 5 AS rx, z >> 5 AS rz FROM v3)"""


def hex4(v: str) -> str:
    return f"lpad(lower(to_hex(CAST({v} AS BIGINT) & 4294967295)), 8, '0')"


def tree_sql(v: str, p: str) -> str:
    """Hashes of all levels of a snapshot, as CTEs whose names begin with ``p``."""
    return f"""
{p}r AS (SELECT dim, kind, x >> 5 AS rx, z >> 5 AS rz,
  sha256(unhex('{REGION_TAG}' || string_agg(lpad(lower(to_hex(x & 31)), 2, '0') || lpad(lower(to_hex(z & 31)), 2, '0') || hash, '' ORDER BY x & 31, z & 31))) AS region_hash
  FROM {v} GROUP BY ALL),
{p}d AS (SELECT dim, sha256(unhex('{DIM_TAG}' || string_agg({hex4("kind")} || {hex4("rx")} || {hex4("rz")} || region_hash, '' ORDER BY kind, rx, rz))) AS dim_hash FROM {p}r GROUP BY dim),
{p}top AS (SELECT sha256(unhex('{ROOT_TAG}' || coalesce(string_agg({hex4("dim")} || dim_hash, '' ORDER BY dim), ''))) AS root_hash FROM {p}d)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def world(spark: SparkSession, sf_dir: str, *numbers: int) -> list[DataFrame]:
    return [tables.version(spark, sf_dir, n).select(*KEY, "hash") for n in numbers]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_by_region(spark, sf_dir)


# --- projections, predicates and scopes ---------------------------------------------------------


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, x >> 5 AS rx, z >> 5 AS rz, x & 31 AS cx, z & 31 AS cz, (x >> 5) * 32 + (x & 31) AS gx FROM v1")
def region_of_chunk(spark, sf_dir):
    a = with_region(world(spark, sf_dir, 1)[0])
    return a.select(*KEY, "rx", "rz", "cx", "cz", coords.global_of(F.col("rx"), F.col("cx")).alias("gx"))


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, (x & 31) + 32 * (z & 31) AS slot, x & 31 AS cx, z & 31 AS cz FROM v1")
def slot_roundtrip(spark, sf_dir):
    a = with_region(world(spark, sf_dir, 1)[0]).withColumn("slot", coords.slot_of(F.col("cx"), F.col("cz")))
    cx, cz = coords.slot_place(F.col("slot"))
    return a.select(*KEY, "slot", cx.alias("cx"), cz.alias("cz"))


RECT = Rect.of(40, 10, -50, -20)


@query(f"WITH {WORLDS} SELECT dim, kind, x, z FROM v1 WHERE dim = 2 AND x BETWEEN -50 AND 40 AND z BETWEEN -20 AND 10")
def rect_scope(spark, sf_dir):
    scope = Scope(areas=(Area(2, RECT),))
    a = with_region(world(spark, sf_dir, 1)[0])
    return a.where(scope.matches_region() & scope.contains()).select(*KEY)


@query(f"WITH {WORLDS}, {REGIONS} SELECT dim, kind, rx, rz FROM r1 WHERE dim = 2 AND rx * 32 <= 40 AND rx * 32 + 31 >= -50 AND rz * 32 <= 10 AND rz * 32 + 31 >= -20")
def region_scope_prune(spark, sf_dir):
    return staging.regions(world(spark, sf_dir, 1)[0]).where(Scope(areas=(Area(2, RECT),)).matches_region())


@query(f"WITH {WORLDS}, {REGIONS} SELECT dim, kind, rx, rz FROM r1 WHERE dim = 2 AND rx * 32 >= -64 AND rx * 32 + 31 <= 40 AND rz * 32 >= -32 AND rz * 32 + 31 <= 31")
def covers_region(spark, sf_dir):
    scope = Scope(areas=(Area(2, Rect.of(-64, -32, 40, 31)), Area(3, chunks=frozenset([(1, 1)]))))
    return staging.regions(world(spark, sf_dir, 1)[0]).where(scope.covers_region())


AREAS = [(1, Rect.of(-20, -20, 20, 20)), (1, Rect.of(0, 0, 60, 25)), (4, Rect.of(-128, -32, -100, 100))]


@query(
    f"WITH {WORLDS} SELECT dim, kind, x, z FROM v1 WHERE (dim = 1 AND x BETWEEN -20 AND 20 AND z BETWEEN -20 AND 20) "
    "OR (dim = 1 AND x BETWEEN 0 AND 60 AND z BETWEEN 0 AND 25) OR (dim = 4 AND x BETWEEN -128 AND -100 AND z BETWEEN -32 AND 100)"
)
def named_scope_union(spark, sf_dir):
    rows = [(d, r.x0, r.z0, r.x1, r.z1) for d, r in AREAS]
    areas = spark.createDataFrame(rows, "dim int, x0 int, z0 int, x1 int, z1 int")
    return in_named_scopes(world(spark, sf_dir, 1)[0].select(*KEY), areas)


@query(SQL["named_scope_union"].replace(" FROM v1", ", hash FROM v1"))
def named_scope_column(spark, sf_dir):
    return world(spark, sf_dir, 1)[0].where(named_scope(AREAS).contains())


@query(f"WITH {WORLDS} SELECT dim, kind, x, z FROM v1 WHERE kind IN (0, 2) AND (dim = 3 OR (dim = 2 AND (x, z) IN ((-3, 5), (7, -9), (100, 3))))")
def kind_scope(spark, sf_dir):
    chunks = frozenset([(-3, 5), (7, -9), (100, 3)])
    scope = Scope(frozenset([0, 2]), (Area(3), Area(2, chunks=chunks)))
    return world(spark, sf_dir, 1)[0].where(scope.contains()).select(*KEY)


@query(
    "SELECT s_name AS name, s_name NOT LIKE '%//%' AND regexp_full_match(s_name, '[A-Za-z0-9._/-]+') AS name_ok, "
    "regexp_full_match(CAST(s_suppkey AS VARCHAR), '[A-Za-z0-9._/-]+') AND NOT regexp_full_match(CAST(s_suppkey AS VARCHAR), '[0-9]+') AS ref_ok FROM supplier"
)
def name_grammar(spark, sf_dir):
    s = tables.read(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("name"), names.is_name(F.col("s_name")).alias("name_ok"), names.is_ref_name(F.col("s_suppkey").cast("string")).alias("ref_ok"))


@query(
    "SELECT event_id, strftime(make_timestamp(event_id * 1000003 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS shown, "
    "least((event_id * 1000003) // 1000, 4294967295) AS stamp FROM events"
)
def time_rendering(spark, sf_dir):
    ms = F.col("event_id") * 1000003
    e = tables.read(spark, sf_dir, "events")
    return e.select("event_id", names.show_time(ms).alias("shown"), names.checkout_stamp(ms).alias("stamp"))


@query(
    "SELECT n_name AS name, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INT) AS dim FROM (SELECT n_name, CAST('0x' || "
    "substr(sha256(n_name), 7, 2) || substr(sha256(n_name), 5, 2) || substr(sha256(n_name), 3, 2) || substr(sha256(n_name), 1, 2) AS BIGINT) AS v FROM nation)"
)
def dimension_codes(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("name"), dimension_code(F.col("n_name")).alias("dim"))


@query(f"WITH {WORLDS} SELECT kind, CASE kind WHEN 0 THEN 'region' WHEN 1 THEN 'entities' ELSE 'poi' END AS name, count(*) AS chunks FROM v1 GROUP BY ALL")
def kind_names(spark, sf_dir):
    counts = world(spark, sf_dir, 1)[0].groupBy("kind").agg(F.count("*").alias("chunks"))
    return counts.select("kind", names.show_kind(F.col("kind")).alias("name"), "chunks")


@query("SELECT item_id, sha256(text) AS digest, CAST(NULL AS VARCHAR) AS short FROM benchmark")
def hex_digests(spark, sf_dir):
    b = tables.read(spark, sf_dir, "benchmark").withColumn("h", F.upper(F.sha2("text", 256)))
    return b.select("item_id", parse_hex(F.col("h")).alias("digest"), parse_hex(F.substring("h", 1, 63)).alias("short"))


# --- staging --------------------------------------------------------------------------------------


@query(f"WITH {WORLDS}, {CHANGES} SELECT * FROM ch")
def changed_chunks(spark, sf_dir):
    base, current = world(spark, sf_dir, 1, 2)
    return staging.changed_chunks(current, base)


@query(f"WITH {WORLDS}, {CHANGES} SELECT * FROM gone")
def tombstones(spark, sf_dir):
    base, current = world(spark, sf_dir, 1, 2)
    return staging.tombstones(current, base)


@query(f"WITH {WORLDS}, {REGIONS} SELECT * FROM r2 ANTI JOIN r3 USING (dim, kind, rx, rz)")
def removed_regions(spark, sf_dir):
    base, current = world(spark, sf_dir, 2, 3)
    return staging.removed_regions(staging.regions(current), base)


@query(f"WITH {WORLDS}, {REGIONS} SELECT * FROM r2 ANTI JOIN r3 USING (dim, kind, rx, rz)")
def new_files(spark, sf_dir):
    base, current = world(spark, sf_dir, 3, 2)
    return staging.new_files(staging.changed_chunks(current, base), base)


@query(
    f"WITH {WORLDS}, {CHANGES} SELECT (SELECT count(*) FROM ch) AS chunks, "
    "(SELECT count(DISTINCT hash) FROM ch ANTI JOIN v1 USING (hash)) AS new_blobs, (SELECT count(*) FROM gone) AS tombstones"
)
def commit_report(spark, sf_dir):
    base, current = world(spark, sf_dir, 1, 2)
    return staging.commit_report(current, base, base)


STATUS = """(SELECT count(*) FROM (SELECT dim, kind, x >> 5, z >> 5 FROM {c} UNION SELECT dim, kind, x >> 5, z >> 5 FROM {g})) AS changed_regions,
 (SELECT count(*) FROM (SELECT DISTINCT dim, kind, x >> 5 AS rx, z >> 5 AS rz FROM {c}) ANTI JOIN {r} USING (dim, kind, rx, rz)) AS new_files,
 (SELECT count(*) FROM {r} ANTI JOIN {n} USING (dim, kind, rx, rz)) AS deleted_files, (SELECT count(*) FROM {c}) AS new_chunks,
 (SELECT count(*) FROM {g}) AS tombstones, (SELECT count(*) FROM {c} ANTI JOIN {b} USING (hash)) AS new_blobs"""


@query(f"WITH {WORLDS}, {CHANGES}, {REGIONS} SELECT false AS clean, {STATUS.format(c='ch', g='gone', r='r1', n='r2', b='v1')}")
def status_report(spark, sf_dir):
    base, current = world(spark, sf_dir, 1, 2)
    return staging.status_report(current, base, base)


SAME = """ch AS (SELECT v2.* FROM v2 LEFT JOIN v2 o USING (dim, kind, x, z) WHERE o.hash IS DISTINCT FROM v2.hash),
gone AS (SELECT dim, kind, x, z FROM v2 ANTI JOIN v2 o USING (dim, kind, x, z))"""


@query(f"WITH {WORLDS}, {SAME}, {REGIONS} SELECT NOT EXISTS (FROM ch) AND NOT EXISTS (FROM gone) AS clean, {STATUS.format(c='ch', g='gone', r='r2', n='r2', b='v2')}")
def status_clean(spark, sf_dir):
    base, _ = world(spark, sf_dir, 2, 3)
    return staging.status_report(base, base, base)


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, hash FROM v2 WHERE dim = 2 UNION ALL SELECT dim, kind, x, z, hash FROM v1 WHERE dim <> 2")
def scoped_commit_merge(spark, sf_dir):
    base, current = world(spark, sf_dir, 1, 2)
    return tree.merged(base, staging.changes(current, base, Scope(areas=(Area(2),))))


@query("SELECT sha256(text) AS hash, count(*) AS chunks FROM documents GROUP BY ALL")
def blob_dedup(spark, sf_dir):
    return tables.documents_world(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("chunks"))


@query(f"WITH {WORLDS} SELECT sha256(payload) AS hash, arg_min(payload || '@' || k, (dim, kind, x, z)) AS payload FROM v0 GROUP BY ALL")
def first_wins(spark, sf_dir):
    a = tables.orders_world(spark, sf_dir).withColumn("hash", F.sha2("payload", 256))
    return staging.first_payloads(a.withColumn("payload", F.concat_ws("@", "payload", F.col("k").cast("string"))))


@query(f"WITH {WORLDS} SELECT hash, any_value(hash) AS payload FROM v2 ANTI JOIN v1 USING (hash) GROUP BY hash")
def new_blobs(spark, sf_dir):
    base, current = world(spark, sf_dir, 1, 2)
    return staging.new_blobs(current.withColumn("payload", F.col("hash")), base)


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, hash FROM v2 ANTI JOIN v1 USING (hash)")
def missing_blobs(spark, sf_dir):
    base, current = world(spark, sf_dir, 1, 2)
    return staging.missing_blobs(current, base.select("hash").distinct())


# --- the tree -------------------------------------------------------------------------------------


@query(f"WITH {WORLDS}, {tree_sql('v2', 'a')} SELECT * FROM ar")
def region_hashes(spark, sf_dir):
    return tree.region_nodes(world(spark, sf_dir, 2)[0])


@query(f"WITH {WORLDS}, {tree_sql('v2', 'a')} SELECT * FROM ad")
def dim_hashes(spark, sf_dir):
    return tree.dim_nodes(tree.region_nodes(world(spark, sf_dir, 2)[0]))


@query(f"WITH {WORLDS}, {tree_sql('v2', 'a')} SELECT * FROM atop")
def root_hash(spark, sf_dir):
    return tree.root_node(tree.dim_nodes(tree.region_nodes(world(spark, sf_dir, 2)[0])))


@query(f"WITH {WORLDS}, nothing AS (SELECT * FROM v2 WHERE false), {tree_sql('nothing', 'a')} SELECT * FROM atop")
def empty_root(spark, sf_dir):
    empty = world(spark, sf_dir, 2)[0].where("false")
    return tree.root_node(tree.dim_nodes(tree.region_nodes(empty)))


def _edges(spark, sf_dir):
    entries = world(spark, sf_dir, 2)[0]
    regions = tree.region_nodes(entries)
    dims = tree.dim_nodes(regions)
    return tree.root_edges(dims, "r"), tree.dim_edges(regions, dims), tree.region_edges(entries, regions)


@query(f"WITH {WORLDS} SELECT 'r' AS root_hash, dim, kind, x, z, hash FROM v2")
def snapshot_scan(spark, sf_dir):
    roots = spark.createDataFrame([("r",)], "root_hash string")
    return tree.snapshot(roots, *_edges(spark, sf_dir))


@query(f"WITH {WORLDS} SELECT 'r' AS root_hash, dim, kind, x, z, hash FROM v2 WHERE x = -3 AND z = -7")
def chunk_lookup(spark, sf_dir):
    # one chunk of the table has this place; its dimension and kind make it a key
    here = world(spark, sf_dir, 2)[0].where("x = -3 AND z = -7").first()
    return tree.lookup("r", (here["dim"], here["kind"], -3, -7), *_edges(spark, sf_dir))


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, hash FROM v2 ORDER BY dim, kind, x, z LIMIT 1000")
def ordered_scan(spark, sf_dir):
    return tree.ordered(world(spark, sf_dir, 2)[0], 1000)


@query(
    f"WITH {WORLDS}, {tree_sql('v2', 'a')}, n AS (SELECT region_hash, count(*) AS entries FROM ar JOIN (SELECT dim, kind, x >> 5 AS rx, z >> 5 AS rz FROM v2) USING (dim, kind, rx, rz) GROUP BY ALL) "
    "SELECT place, region_hash, entries FROM n, (SELECT unnest([0, 1]) AS place)"
)
def bulk_node_reads(spark, sf_dir):
    edges = _edges(spark, sf_dir)[2]
    wanted = edges.select("region_hash").distinct().select(F.explode(F.array(F.lit(0), F.lit(1))).alias("place"), "region_hash")
    found = tree.read_nodes(wanted, edges, "region_hash")
    return found.select("place", "region_hash", F.size("entries").cast("long").alias("entries"))


@query(
    f"WITH {WORLDS}, {tree_sql('v2', 'a')} SELECT region_hash, CASE substr(region_hash, 1, 1) WHEN '0' THEN 'place out of range' WHEN '1' THEN 'repeated place' "
    "WHEN '2' THEN 'malformed digest' ELSE 'digest mismatch' END AS fault FROM ar WHERE substr(region_hash, 1, 1) IN ('0', '1', '2', '3')"
)
def verify_nodes(spark, sf_dir):
    edges = _edges(spark, sf_dir)[2]
    first = F.substring("region_hash", 1, 1)
    broken = edges.withColumn("cx", F.when(first == "0", F.col("cx") + 32).otherwise(F.col("cx")))
    broken = broken.withColumn("hash", F.when(first == "2", "none").when(first == "3", F.reverse("hash")).otherwise(F.col("hash")))
    return tree.verify_nodes(broken.unionByName(edges.where(first == "1").withColumn("hash", F.sha2("hash", 256))))


@query(
    f"WITH {WORLDS}, {tree_sql('v2', 'a')} SELECT dim_hash, CASE dim WHEN 1 THEN 'place out of range' WHEN 2 THEN 'repeated place' WHEN 3 THEN 'malformed digest' "
    "ELSE 'digest mismatch' END AS fault FROM ad WHERE dim <= 4"
)
def verify_dims(spark, sf_dir):
    regions = tree.region_nodes(world(spark, sf_dir, 2)[0])
    dim = F.col("dim")
    edges = regions.join(tree.dim_nodes(regions), "dim")
    broken = edges.withColumn("kind", F.when(dim == 1, F.col("kind") + 3).otherwise(F.col("kind")))
    broken = broken.withColumn("region_hash", F.when(dim == 3, F.upper("region_hash")).when(dim == 4, F.sha2("region_hash", 256)).otherwise(F.col("region_hash")))
    return tree.verify_dims(broken.unionByName(edges.where(dim == 2)).select("dim_hash", "kind", "rx", "rz", "region_hash"))


@query(f"WITH {WORLDS}, {tree_sql('v2', 'a')} SELECT sha256(dim_hash) AS root_hash, CASE dim WHEN 2 THEN 'repeated place' ELSE 'digest mismatch' END AS fault FROM ad")
def verify_roots(spark, sf_dir):
    dims = tree.dim_nodes(tree.region_nodes(world(spark, sf_dir, 2)[0]))
    wrong = dims.select(F.sha2("dim_hash", 256).alias("root_hash"), "dim", "dim_hash")
    right = dims.select(tagged_digest(ROOT_TAG, F.concat(hex_int(F.col("dim"), 8), "dim_hash")).alias("root_hash"), "dim", "dim_hash")
    return tree.verify_roots(wrong.unionByName(wrong.where("dim = 2")).unionByName(right))


STATS = """SELECT (SELECT count(*) FROM {a} LEFT JOIN {b} USING (dim, kind, x, z) WHERE {a}.hash IS DISTINCT FROM {b}.hash) AS fresh_chunks,
 (SELECT count(*) FROM {b} ANTI JOIN {a} USING (dim, kind, x, z)) AS fresh_tombstones,
 (SELECT count(DISTINCT hash) FROM {a} ANTI JOIN {b} USING (hash)) AS new_blobs, (SELECT count(*) FROM {a}) AS effective_chunks"""


@query(f"WITH {WORLDS}, empty AS (SELECT * FROM v1 WHERE false), s AS ({' UNION ALL '.join(f'SELECT {n} AS commit_no, * FROM ({STATS.format(a=a, b=b)})' for n, a, b in ((1, 'v1', 'empty'), (2, 'v2', 'v1'), (3, 'v3', 'v2')))}) SELECT * FROM s")
def log_stats(spark, sf_dir):
    v = world(spark, sf_dir, 1, 2, 3)
    tag = lambda df, n: df.withColumn("commit_no", F.lit(n))
    after = tag(v[0], 1).unionByName(tag(v[1], 2)).unionByName(tag(v[2], 3))
    before = tag(v[0], 2).unionByName(tag(v[1], 3))
    return tree.diff_stats(after, before, ["commit_no"])


@query(f"WITH {WORLDS} {STATS.format(a='v3', b='v2')}")
def vanished_dim(spark, sf_dir):
    base, current = world(spark, sf_dir, 2, 3)
    return tree.diff_stats(current, base)


@query(f"WITH {WORLDS} SELECT count(*) AS changed FROM v3 JOIN v2 USING (dim, kind, x, z) WHERE v2.hash <> v3.hash")
def volatile_noop(spark, sf_dir):
    base, current = world(spark, sf_dir, 2, 3)
    return staging.changed_chunks(current, base).agg(F.count("*").alias("changed"))


# --- differences ----------------------------------------------------------------------------------

DIFF = "SELECT dim, kind, x, z, {a}.hash AS old, {b}.hash AS new FROM {a} FULL JOIN {b} USING (dim, kind, x, z) WHERE {a}.hash IS DISTINCT FROM {b}.hash"


@query(f"WITH {WORLDS}, d AS ({DIFF.format(a='v1', b='v2')}) SELECT dim, kind, x >> 5 AS rx, z >> 5 AS rz, count(*) FILTER (old IS NULL) AS added, count(*) FILTER (new IS NULL) AS removed, count(*) FILTER (old IS NOT NULL AND new IS NOT NULL) AS modified FROM d GROUP BY ALL")
def diff_by_region(spark, sf_dir):
    return diff.by_region(diff.diff_commits(*world(spark, sf_dir, 1, 2)))


@query(f"WITH {WORLDS} {DIFF.format(a='v1', b='v2')}")
def diff_commits(spark, sf_dir):
    return diff.diff_commits(*world(spark, sf_dir, 1, 2))


@query(f"WITH {WORLDS} SELECT * FROM ({DIFF.format(a='v1', b='v2')}) WHERE new IS NOT NULL")
def diff_world(spark, sf_dir):
    commit, live = world(spark, sf_dir, 1, 2)
    return diff.diff_world(live, commit)


@query(f"WITH {WORLDS} {DIFF.format(a='v1', b='v2')}")
def diff_world_with_removed(spark, sf_dir):
    commit, live = world(spark, sf_dir, 1, 2)
    return diff.diff_world(live, commit, include_removed=True)


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, CAST(NULL AS VARCHAR) AS old, hash AS new FROM v1")
def diff_unborn(spark, sf_dir):
    live = world(spark, sf_dir, 1)[0]
    return diff.diff_world(live, live.where("false"))


@query(f"WITH {WORLDS} {DIFF.format(a='v2', b='v3')}")
def diff_pruned(spark, sf_dir):
    base, current = world(spark, sf_dir, 2, 3)
    current, base = tree.pruned(current, base)
    return diff.diff_commits(base, current)


@query(f"WITH {WORLDS} SELECT * FROM ({DIFF.format(a='v1', b='v2')}) WHERE kind = 1 AND dim = 2 AND x BETWEEN -50 AND 40 AND z BETWEEN -20 AND 10")
def diff_scoped(spark, sf_dir):
    return diff.diff_commits(*world(spark, sf_dir, 1, 2), Scope(frozenset([1]), (Area(2, RECT),)))


@query(
    f"WITH {WORLDS}, k AS (SELECT dim, kind, x, z FROM v0 UNION SELECT dim, kind, x + 1000, z FROM v0) SELECT dim, kind, x, z, v1.hash AS old, v2.hash AS new "
    "FROM k LEFT JOIN v1 USING (dim, kind, x, z) LEFT JOIN v2 USING (dim, kind, x, z) WHERE v1.hash IS DISTINCT FROM v2.hash"
)
def diff_named_keys(spark, sf_dir):
    """All keys, and as many that neither side has."""
    keys = tables.orders_world(spark, sf_dir).select(*KEY)
    return diff.diff_keys(keys.unionByName(keys.withColumn("x", F.col("x") + 1000)), *world(spark, sf_dir, 1, 2))


@query(f"WITH {WORLDS} SELECT dim, kind, x, z FROM v1 UNION SELECT dim, kind, x, z FROM v2")
def all_places(spark, sf_dir):
    a, b = world(spark, sf_dir, 1, 2)
    return a.select(*KEY).unionByName(b.select(*KEY)).distinct()


@query(
    f"WITH {WORLDS}, all_v AS (SELECT 1 AS seq, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3), "
    "l AS (SELECT *, lag(hash) OVER (PARTITION BY dim, kind, x, z ORDER BY seq) AS before FROM all_v) "
    "SELECT seq, count(*) FILTER (before IS NULL) AS appeared, count(*) FILTER (before <> hash) AS edited FROM l GROUP BY seq"
)
def consecutive_versions(spark, sf_dir):
    from pyspark.sql import Window

    v = world(spark, sf_dir, 1, 2, 3)
    every = v[0].withColumn("seq", F.lit(1)).unionByName(v[1].withColumn("seq", F.lit(2))).unionByName(v[2].withColumn("seq", F.lit(3)))
    before = F.lag("hash").over(Window.partitionBy(*KEY).orderBy("seq"))
    counted = every.withColumn("before", before).groupBy("seq")
    n = lambda c: F.sum(c.cast("long"))
    return counted.agg(n(F.col("before").isNull()).alias("appeared"), F.coalesce(n(F.col("before") != F.col("hash")), F.lit(0)).alias("edited"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations")
def record_sequence(spark, sf_dir):
    from pyspark.sql import Window

    c = tables.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("seq"))


# --- the graph of commits -------------------------------------------------------------------------

GRAPH = """
ev AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
commits AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS id, event_id AS seq, event_id AS created_at_ms, sha256('root' || event_id) AS root_hash FROM ev),
edges AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS child_id, sha256(CAST(before AS VARCHAR)) AS parent_id FROM ev WHERE before IS NOT NULL),
leaf AS (SELECT arg_max(id, seq) AS id FROM commits)"""


def _leaf(spark, sf_dir):
    commits, edges = tables.events_graph(spark, sf_dir)
    return commits, edges, graph.latest(commits).first()["id"]


@query(f"WITH RECURSIVE {GRAPH}, up AS (SELECT id, 0 AS depth FROM leaf UNION ALL SELECT parent_id, depth + 1 FROM up JOIN edges ON child_id = id) SELECT id, depth FROM up WHERE depth > 0")
def ancestors(spark, sf_dir):
    commits, edges = tables.events_graph(spark, sf_dir)
    return graph.ancestors(edges, graph.latest(commits).select("id"))


@query(SQL["ancestors"])
def linear_ancestors(spark, sf_dir):
    _, edges, leaf = _leaf(spark, sf_dir)
    return graph.linear_ancestors(edges, leaf)


@query(f"WITH RECURSIVE {GRAPH}, up AS (SELECT id, 0 AS depth FROM leaf UNION ALL SELECT parent_id, depth + 1 FROM up JOIN edges ON child_id = id) SELECT id, depth, seq, created_at_ms, root_hash FROM up JOIN commits USING (id)")
def history(spark, sf_dir):
    commits, edges, leaf = _leaf(spark, sf_dir)
    return graph.history(commits, edges, leaf)


@query(f"WITH {GRAPH} SELECT parent_id FROM edges JOIN leaf ON child_id = id")
def parents(spark, sf_dir):
    commits, edges, leaf = _leaf(spark, sf_dir)
    return graph.parents_of(edges, commits, leaf)


@query(f"WITH {GRAPH} SELECT id, seq, created_at_ms, root_hash FROM commits JOIN leaf USING (id)")
def latest_commit(spark, sf_dir):
    return graph.latest(tables.events_graph(spark, sf_dir)[0])


@query(f"WITH {GRAPH} SELECT c.id, c.seq, coalesce(parent_id, '') AS parent FROM commits c LEFT JOIN edges ON child_id = c.id")
def commit_list(spark, sf_dir):
    listed = graph.commit_list(*tables.events_graph(spark, sf_dir))
    return listed.select("id", "seq", F.array_join("parents", ",").alias("parent"))


@query(
    f"WITH {GRAPH} SELECT c.id, sha256(unhex('{COMMIT_TAG}' || CASE WHEN parent_id IS NULL THEN '0000000000000000' ELSE '0000000000000001' || parent_id END "
    "|| lpad(lower(to_hex(created_at_ms)), 16, '0') || root_hash)) AS commit_id FROM commits c LEFT JOIN edges ON child_id = c.id"
)
def commit_ids(spark, sf_dir):
    return tables.with_commit_ids(*tables.events_graph(spark, sf_dir)).select("id", "commit_id")


@query(
    "SELECT n_name AS name, sha256(CAST(n_nationkey AS VARCHAR)) AS commit_id, n_nationkey = 3 AS active, "
    "row_number() OVER (ORDER BY n_name) AS place FROM nation"
)
def refs_by_name(spark, sf_dir):
    from pyspark.sql import Window

    refs = tables.read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.sha2(F.col("n_nationkey").cast("string"), 256).alias("commit_id"), (F.col("n_nationkey") == 3).alias("active")
    )
    return refs.withColumn("place", F.row_number().over(Window.orderBy("name")).cast("long"))  # as many rows as a store has refs


# --- cache and checkout ---------------------------------------------------------------------------

CACHED = f"""WITH {WORLDS}, {tree_sql('v1', 'a')}, {tree_sql('v2', 'b')},
cache AS (SELECT DISTINCT region_hash, sha256('img' || region_hash) AS image_hash FROM ar),
files AS (SELECT dim, kind, rx, rz, sha256('img' || region_hash) AS image_hash FROM br)"""


def _cached(spark, sf_dir):
    old, new = (tree.region_nodes(v) for v in world(spark, sf_dir, 1, 3))
    image = F.sha2(F.concat(F.lit("img"), F.col("region_hash")), 256).alias("image_hash")
    return old, old.select("region_hash", image).distinct(), new.select("dim", "kind", "rx", "rz", image)


@query(f"WITH {WORLDS}, {tree_sql('v2', 'a')}, {tree_sql('v3', 'b')} SELECT ar.dim, ar.kind, ar.rx, ar.rz, ar.region_hash FROM ar JOIN br USING (dim, kind, rx, rz, region_hash)")
def region_proof(spark, sf_dir):
    old, new = (tree.region_nodes(v) for v in world(spark, sf_dir, 2, 3))
    image = F.sha2(F.concat(F.lit("img"), F.col("region_hash")), 256).alias("image_hash")
    return cache.prove_unchanged(old, old.select("region_hash", image).distinct(), new.select("dim", "kind", "rx", "rz", image))


@query(f"{CACHED} SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS chunks, count(DISTINCT region_hash) FILTER (region_hash NOT IN (SELECT region_hash FROM cache)) AS entries, count(*) - count(DISTINCT region_hash) FILTER (region_hash NOT IN (SELECT region_hash FROM cache)) AS existing, 0::BIGINT AS empty FROM br JOIN (SELECT dim, kind, x >> 5 AS rx, z >> 5 AS rz, count(*) AS n FROM v2 GROUP BY ALL) USING (dim, kind, rx, rz)")
def cache_update_counts(spark, sf_dir):
    old, new = world(spark, sf_dir, 1, 2)
    chunks = with_region(new).groupBy("dim", "kind", "rx", "rz").agg(F.count("*").alias("chunks"))
    images = tree.region_nodes(new).join(chunks, ["dim", "kind", "rx", "rz"])
    return cache.update_counts(images, tree.region_nodes(old))


PLAN = f"""WITH {WORLDS}, {REGIONS},
want AS (SELECT dim, kind, x >> 5 AS rx, z >> 5 AS rz, count(*) AS n FROM v2 GROUP BY ALL),
live AS (SELECT * FROM r1 WHERE dim <> 2 UNION ALL SELECT 9, 0, 1, 1),
plan AS (SELECT dim, kind, rx, rz, coalesce(n, 0) AS chunks,
  CASE WHEN n IS NOT NULL AND l.here IS NOT NULL THEN 'rebuild' WHEN n IS NOT NULL THEN 'create' ELSE 'delete' END AS action
  FROM want FULL JOIN (SELECT *, true AS here FROM live) l USING (dim, kind, rx, rz))"""


def _plan(spark, sf_dir):
    old, new = world(spark, sf_dir, 1, 2)
    extra = spark.createDataFrame([(9, 0, 1, 1)], "dim int, kind int, rx int, rz int")
    return checkout.file_plan(new, staging.regions(old).where("dim <> 2").unionByName(extra))


@query(f"{PLAN} SELECT * FROM plan")
def checkout_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"{PLAN} SELECT count(*) FILTER (action IN ('rebuild', 'create')) AS rebuilt_files, count(*) FILTER (action = 'delete') AS deleted_files, 0::BIGINT AS kept_files, CAST(sum(chunks) AS BIGINT) AS restored_chunks FROM plan")
def checkout_counts(spark, sf_dir):
    return checkout.plan_counts(_plan(spark, sf_dir))


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, hash FROM v2 UNION ALL SELECT dim, kind, x, z, hash FROM v1 ANTI JOIN v2 USING (dim, kind, x, z) SEMI JOIN (SELECT DISTINCT dim, kind, x >> 5 AS rx, z >> 5 AS rz FROM v2) r ON v1.dim = r.dim AND v1.kind = r.kind AND v1.x >> 5 = r.rx AND v1.z >> 5 = r.rz")
def checkout_keep_live(spark, sf_dir):
    live, commit = world(spark, sf_dir, 1, 2)
    return checkout.with_live_chunks(commit, live, checkout.Policy(keep_post_commit_chunks=True))


@query(f"WITH {WORLDS} SELECT dim, kind, x >> 5 AS rx, z >> 5 AS rz, count(*) AS chunks, string_agg(hash, ',' ORDER BY z & 31, x & 31) AS entries FROM v1 WHERE dim = 2 AND (x >> 5) BETWEEN -2 AND 1 AND (z >> 5) BETWEEN -1 AND 0 GROUP BY ALL")
def restore_groups(spark, sf_dir):
    groups = checkout.restore_groups(world(spark, sf_dir, 1)[0], Scope(areas=(Area(2, RECT),)))
    return groups.select("dim", "kind", "rx", "rz", "chunks", F.array_join(F.transform("entries", lambda e: e["hash"]), ",").alias("entries"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, CASE WHEN (octet_length(encode(text)) + 4 + 4095) // 4096 <= 255 THEN (octet_length(encode(text)) + 4 + 4095) // 4096 END AS sectors FROM documents")
def sector_layout(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    length = F.octet_length("text").cast("long")
    return d.select("doc_id", length.alias("bytes"), coords.sectors(length).alias("sectors"))


# --- formats: region images, packings, documents ----------------------------------------------------


def _images(spark, sf_dir) -> DataFrame:
    """(region, image) of version 2, with payloads that are stored plainly."""
    rows = with_region(tables.version(spark, sf_dir, 2)).select(*REGION, "x", "z", F.concat(F.lit(b"\x03"), F.col("payload").cast("binary")).alias("payload"))

    def build(key, table):
        region = [k.as_py() for k in key]
        builder = region_file.RegionBuilder(region[2], region[3], 7)
        for x, z, payload in zip(*(table.column(c).to_pylist() for c in ("x", "z", "payload")), strict=True):
            builder.stage_chunk(x, z, payload)
        return pa.table([[r] for r in region] + [[builder.image()]], schema=pa.schema([*((c, pa.int32()) for c in REGION), ("image", pa.binary())]))

    return rows.groupBy(*REGION).applyInArrow(build, "dim int, kind int, rx int, rz int, image binary")


def _read_images(images: DataFrame, read: Callable[[bytes, int, int], list[tuple[int, bytes]]]) -> DataFrame:
    """(key, payload) of the slots that ``read`` gives of each image."""
    schema = pa.schema([*((c, pa.int32()) for c in KEY), ("payload", pa.binary())])

    def work(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = read(r["image"], r["rx"], r["rz"])
                rows += [(r["dim"], r["kind"], r["rx"] * 32 + (s & 31), r["rz"] * 32 + (s >> 5), p) for s, p in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return images.mapInArrow(work, "dim int, kind int, x int, z int, payload binary")


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, hash FROM v2")
def region_image_roundtrip(spark, sf_dir):
    found = _read_images(_images(spark, sf_dir), lambda image, rx, rz: [(s, region_file.unpack(p)) for s, p in region_file.chunks(image)])
    return found.select(*KEY, F.sha2("payload", 256).alias("hash"))


@query(f"WITH {WORLDS} SELECT dim, kind, x, z FROM v2")
def header_places(spark, sf_dir):
    return _read_images(_images(spark, sf_dir), lambda image, rx, rz: [(s, b"") for s in region_file.present_slots(image[: region_file.HEADER])]).select(*KEY)


@query(f"WITH {WORLDS} SELECT dim, kind, x, z, hash FROM v2 WHERE x & 31 = 5 AND z & 31 = 7")
def point_reads(spark, sf_dir):
    def read(image, rx, rz):
        payload = region_file.point(image, rx, rz, rx * 32 + 5, rz * 32 + 7)
        return [] if payload is None else [(5 + 32 * 7, region_file.unpack(payload))]

    return _read_images(_images(spark, sf_dir), read).select(*KEY, F.sha2("payload", 256).alias("hash"))


@query(
    f"WITH {WORLDS} SELECT dim, kind, x >> 5 AS rx, z >> 5 AS rz, count(*) AS chunks, 8192 + 4096 * count(*) AS bytes FROM v2 GROUP BY ALL"
)
def region_file_sizes(spark, sf_dir):
    """A file is its header and the sectors of its chunks, one each for such short payloads."""
    images = _images(spark, sf_dir)
    counts = with_region(world(spark, sf_dir, 2)[0]).groupBy(*REGION).agg(F.count("*").alias("chunks"))
    return images.join(counts, list(REGION)).select(*REGION, "chunks", F.octet_length("image").cast("long").alias("bytes"))


def _packed(text: bytes, how: int) -> bytes:
    if how == region_file.GZIP:
        return b"\x01" + gzip.compress(text)
    if how == region_file.ZLIB:
        return b"\x02" + zlib.compress(text)
    if how == region_file.PLAIN:
        return b"\x03" + text
    import xxhash

    check = xxhash.xxh32_intdigest(text, region_file.LZ4_SEED) & region_file.LZ4_MASK
    stored = region_file.LZ4_MAGIC + struct.pack("<BIII", 0x1F, len(text), len(text), check) + text if text else b""
    return b"\x04" + stored + region_file.LZ4_MAGIC + struct.pack("<BIII", 0x1F, 0, 0, 0)


@query("SELECT doc_id, 1 + doc_id % 4 AS how, sha256(text) AS hash FROM documents")
def packing_roundtrip(spark, sf_dir):
    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [region_file.unpack(_packed(t, 1 + i % 4)) for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([1 + i % 4 for i in ids], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "how", "data"])

    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(work, "doc_id long, how long, data binary").select("doc_id", "how", F.sha2("data", 256).alias("hash"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey - 5000 AS INT) END AS rx, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_custkey AS INT) END AS rz FROM orders"
)
def file_names(spark, sf_dir):
    """Names of region files, and those of other forms, by their coordinates."""

    def work(batches):
        for batch in batches:
            places = [region_file.parse_name(n) or (None, None) for n in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("o_orderkey"), *(pa.array([p[k] for p in places], pa.int32()) for k in (0, 1))], names=["o_orderkey", "rx", "rz"])

    o = tables.read(spark, sf_dir, "orders")
    k, z = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey"))
    good = F.concat(F.lit("r."), (F.col("o_orderkey") - 5000).cast("string"), F.lit("."), z, F.lit(".mca"))
    name = F.when(F.col("o_orderkey") % 4 < 2, good).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("r.0"), k, F.lit("."), z, F.lit(".mca"))).otherwise(F.concat(good, F.lit(".bak")))
    return o.select("o_orderkey", name.alias("name")).mapInArrow(work, "o_orderkey long, rx int, rz int")


def _document(x: int, z: int, status: str, updated: int) -> bytes:
    """The least document of a chunk."""
    tag = lambda kind, name, body: bytes([kind]) + nbt.name_bytes(name) + body
    number = lambda name, v: tag(nbt.INT, name, struct.pack(">i", v))
    fields = [number("DataVersion", 3465), number("xPos", x), number("zPos", z), number("yPos", -4), tag(nbt.STRING, "Status", nbt.name_bytes(status))]
    fields += [tag(nbt.LONG, n, struct.pack(">q", updated)) for n in ("LastUpdate", "InhabitedTime")]
    fields += [tag(nbt.LIST, n, bytes(5)) for n in ("sections", "block_entities", "fluid_ticks", "block_ticks")]
    return tag(nbt.COMPOUND, "", b"".join([*fields, tag(nbt.COMPOUND, "Heightmaps", b"\0"), b"\0"]))


@query("SELECT o_orderpriority, count(*) AS documents, count(DISTINCT (o_custkey % 100, o_orderstatus)) AS keys FROM orders GROUP BY ALL")
def document_keys(spark, sf_dir):
    """Keys of documents that differ in what is volatile, too: only place and status count."""

    def work(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("o_orderkey", "o_custkey", "o_orderstatus")), strict=True)
            found = [nbt.chunk_key(0, _document(c % 100, 0, s, k)) for k, c, s in rows]
            yield pa.RecordBatch.from_arrays([batch.column("o_orderpriority"), pa.array(found, pa.string())], names=["o_orderpriority", "key"])

    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    keyed = o.mapInArrow(work, "o_orderpriority string, key string")
    return keyed.groupBy("o_orderpriority").agg(F.count("*").alias("documents"), F.countDistinct("key").alias("keys"))


@query(f"WITH {WORLDS} SELECT dim, kind, x, z FROM v1 WHERE kind IN (0, 1) AND ((dim = 5 AND x BETWEEN -50 AND 40 AND z BETWEEN -20 AND 10) OR (dim = 3 AND x >> 5 = 1 AND z >> 5 = -1) OR dim = 4)")
def selection_of_options(spark, sf_dir):
    """The scope of command-line options over all chunks."""
    scope = selection(["5:40,10..-50,-20", "4"], ["3:1,-1"], ["region", "entities"])
    return world(spark, sf_dir, 1)[0].where(scope.contains()).select(*KEY)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
