"""Columns against plain Python: coordinates, digests, names, scopes, plans and proofs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import coords, digest, names
from palimpsest.operators import cache, checkout, staging, tree
from palimpsest.plans.scope import Area, Rect, Scope, in_named_scopes, named_scope

EDGE = [-(1 << 31), -(1 << 31) + 1, -1025, -1024, -33, -32, -31, -1, 0, 1, 31, 32, 33, 1023, (1 << 31) - 32, (1 << 31) - 1]


def test_coordinates(spark):
    df = spark.createDataFrame([(x,) for x in EDGE], "x int")
    rows = df.select("x", coords.region_of(F.col("x")).alias("r"), coords.local_of(F.col("x")).alias("l")).collect()
    assert [(r.r, r.l) for r in rows] == [divmod(x, 32) for x in EDGE]
    slots = spark.range(1024).select(F.col("id").cast("int").alias("slot"))
    cx, cz = coords.slot_place(F.col("slot"))
    assert slots.where(coords.slot_of(cx, cz) != F.col("slot")).count() == 0
    regions = spark.createDataFrame([(r,) for r in (-(1 << 31), -(1 << 26) - 1, -(1 << 26), -1, 0, (1 << 26) - 1, 1 << 26)], "r int")
    low = [r[0] for r in regions.select(coords.region_low(F.col("r"))).collect()]
    assert low == [-(1 << 31), -(1 << 31), -(1 << 31), -32, 0, (1 << 31) - 32, (1 << 31) - 32]
    sizes = [0, 1, 4092, 4093, 255 * 4096 - 4, 255 * 4096 - 3]
    found = spark.createDataFrame([(s,) for s in sizes], "s long").select(coords.sectors(F.col("s")))
    assert [r[0] for r in found.collect()] == [1, 1, 1, 2, 255, None]


def test_digests(spark):
    df = spark.createDataFrame([(["b" * 64, "a" * 64, "b" * 64], 5, "c" * 64), ([], 1 << 40, "d" * 64)], "p array<string>, t long, r string")
    got = [r[0] for r in df.select(digest.commit_digest(F.col("p"), F.col("t"), F.col("r"))).collect()]
    assert got == [digest.commit_id(r.p, r.t, r.r) for r in df.collect()]
    ints = spark.createDataFrame([(x,) for x in EDGE], "x int").select(digest.hex_int(F.col("x"))).collect()
    assert [r[0] for r in ints] == [f"{x & 0xFFFFFFFF:08x}" for x in EDGE]
    keys = [f"mod:{i}" for i in range(50)]
    codes = spark.createDataFrame([(k,) for k in keys], "k string").select(digest.dimension_code(F.col("k"))).collect()
    assert [r[0] for r in codes] == [digest.dimension_id(k.encode()) for k in keys]
    texts = spark.createDataFrame([("AB" * 32,), ("ab" * 31,), ("xy" * 32,), (None,)], "h string").select(digest.parse_hex(F.col("h"))).collect()
    assert [r[0] for r in texts] == ["ab" * 32, None, None, None]


def test_names_agree_with_the_grammar(spark):
    rng = random.Random(1)
    raw = ["".join(rng.choice("aB3./_-é ") for _ in range(rng.randrange(6))) for _ in range(600)] + ["x" * 255, "x" * 256, "HEAD", "12", "a\nb"]

    def ok(check, name):
        try:
            check(name)
            return True
        except names.BadName:
            return False

    rows = spark.createDataFrame([(n,) for n in raw], "n string").select("n", names.is_name(F.col("n")).alias("a"), names.is_ref_name(F.col("n")).alias("b")).collect()
    for r in rows:
        assert (r.a, r.b) == (ok(names.check_name, r.n), ok(names.check_ref_name, r.n)), r.n
    ms = [0, 999, 1_700_000_000_123, 253402300799999, 253402300800000]
    shown = spark.createDataFrame([(m,) for m in ms], "m long").select(names.show_time(F.col("m")), names.checkout_stamp(F.col("m"))).collect()
    assert [tuple(r) for r in shown[2:]] == [
        ("2023-11-14T22:13:20.123Z", 1_700_000_000), ("9999-12-31T23:59:59.999Z", (1 << 32) - 1), ("253402300800000ms", (1 << 32) - 1),
    ]
    with pytest.raises(Exception, match="unknown kind"):
        spark.range(1).select(names.show_kind(F.lit(7))).collect()
    assert names.parse_dimension("DIM-1") == names.NETHER and names.show_dimension(names.END) == "end"
    for bad in ("x", "99999999999", ""):
        with pytest.raises(ValueError):
            names.parse_dimension(bad)


def test_scopes_against_a_plain_model(spark):
    rng = random.Random(2)
    places = [(rng.randrange(3), rng.randrange(3), rng.randrange(-70, 70), rng.randrange(-70, 70)) for _ in range(400)]
    df = coords.with_region(spark.createDataFrame(places, "dim int, kind int, x int, z int")).persist()
    for _ in range(12):
        areas = []
        for _ in range(rng.randrange(1, 4)):
            shape = rng.randrange(3)
            corners = [rng.randrange(-70, 70) for _ in range(4)]
            chunks = frozenset(p[2:] for p in rng.sample(places, 5))
            areas.append(Area(rng.randrange(3), Rect.of(*corners) if shape == 1 else None, chunks if shape == 2 else None))
        kinds = rng.choice([None, frozenset([0, 2])])
        scope = Scope(kinds, tuple(areas))

        def inside(d, k, x, z, kinds=kinds, areas=areas):
            hit = lambda a: a.dim == d and ((x, z) in a.chunks if a.chunks is not None else a.rect is None or a.rect.x0 <= x <= a.rect.x1 and a.rect.z0 <= z <= a.rect.z1)
            return (kinds is None or k in kinds) and any(map(hit, areas))

        got = {(r.dim, r.kind, r.x, r.z) for r in df.where(scope.contains()).collect()}
        assert got == {p for p in places if inside(*p)}
        regions = df.select(*coords.REGION).distinct()
        matched = {tuple(r) for r in regions.where(scope.matches_region()).collect()}
        covered = {tuple(r) for r in regions.where(scope.covers_region()).collect()}
        for d, k, rx, rz in {tuple(r) for r in regions.collect()}:
            every = [inside(d, k, rx * 32 + cx, rz * 32 + cz) for cx in range(32) for cz in range(32)]
            assert ((d, k, rx, rz) in matched) == any(every)
            if (d, k, rx, rz) in covered:
                assert all(every)
    rects = [(1, Rect.of(-9, -9, 30, 30)), (2, Rect.of(0, 0, 60, 5))]
    table = spark.createDataFrame([(d, r.x0, r.z0, r.x1, r.z1) for d, r in rects], "dim int, x0 int, z0 int, x1 int, z1 int")
    assert sorted(map(tuple, in_named_scopes(df, table).collect())) == sorted(map(tuple, df.where(named_scope(rects).contains()).collect()))
    assert Scope().contains() is not None and df.where(Scope().contains()).count() == 400


def test_tree_by_hand_and_corruption(spark):
    h = ["1" * 64, "2" * 64]
    rows = [(4, 0, -1, 33, h[0]), (4, 0, -2, 34, h[1]), (4, 2, 0, 0, h[0])]
    entries = spark.createDataFrame(rows, "dim int, kind int, x int, z int, hash string")
    sha = lambda text: hashlib.sha256(bytes.fromhex(text)).hexdigest()
    first = sha(digest.REGION_TAG + "1e02" + h[1] + "1f01" + h[0])
    second = sha(digest.REGION_TAG + "0000" + h[0])
    regions = tree.region_nodes(entries)
    assert {tuple(r) for r in regions.collect()} == {(4, 0, -1, 1, first), (4, 2, 0, 0, second)}
    dim = sha(digest.DIM_TAG + "00000000" + "ffffffff" + "00000001" + first + "00000002" + "00000000" + "00000000" + second)
    dims = tree.dim_nodes(regions)
    assert [tuple(r) for r in dims.collect()] == [(4, dim)]
    assert tree.root_node(dims).first()[0] == sha(digest.ROOT_TAG + "00000004" + dim)
    assert tree.root_node(dims.limit(0)).first()[0] == digest.EMPTY_ROOT
    edges = tree.region_edges(entries, regions)
    assert tree.verify_nodes(edges).count() == 0
    bad = spark.createDataFrame([("f" * 64, 1, 1, h[0]), ("e" * 64, 32, 0, h[0]), ("d" * 64, 1, 1, h[0]), ("d" * 64, 1, 1, h[1]), ("c" * 64, 0, 0, "zz")], edges.schema)
    faults = {r.region_hash[0]: r.fault for r in tree.verify_nodes(edges.unionByName(bad)).collect()}
    assert faults == {"f": "digest mismatch", "e": "place out of range", "d": "repeated place", "c": "malformed digest"}
    wanted = spark.createDataFrame([(0, second), (1, first), (2, second)], "place int, region_hash string")
    assert [(r.place, len(r.entries)) for r in tree.read_nodes(wanted, edges, "region_hash").orderBy("place").collect()] == [(0, 1), (1, 2), (2, 1)]
    with pytest.raises(Exception, match="node missing"):
        tree.read_nodes(spark.createDataFrame([(0, "0" * 64)], wanted.schema), edges, "region_hash").collect()


def test_payloads_proofs_and_policies(spark):
    rows = [(0, 0, 5, 0, "h1", b"late"), (0, 0, 1, 0, "h1", b"early"), (0, 0, 2, 0, "h2", b"two")]
    entries = spark.createDataFrame(rows, "dim int, kind int, x int, z int, hash string, payload binary")
    blobs = spark.createDataFrame([("h2", b"other")], "hash string, payload binary")
    assert [(r.hash, bytes(r.payload)) for r in staging.new_blobs(entries, blobs).collect()] == [("h1", b"early")]
    with pytest.raises(Exception, match="blob missing"):
        staging.fetch_blobs(entries.drop("payload"), blobs).collect()
    assert staging.fetch_blobs(entries.drop("payload"), blobs, strict=False).count() == 1
    files = spark.createDataFrame([(0, 0, 0, 0, "i1"), (0, 0, 1, 0, "i2")], "dim int, kind int, rx int, rz int, image_hash string")
    committed = spark.createDataFrame([(0, 0, 0, 0, "r1"), (0, 0, 1, 0, "r2"), (0, 0, 2, 0, "r3")], "dim int, kind int, rx int, rz int, region_hash string")
    cached = spark.createDataFrame([("r1", "i1"), ("r2", "old"), ("r3", "i3")], "region_hash string, image_hash string")
    proven = cache.prove_unchanged(committed, cached, files)
    assert [tuple(r) for r in proven.collect()] == [(0, 0, 0, 0, "r1")]
    skip, rest = cache.split_by_proof(files, proven)
    assert (skip.count(), [r.rx for r in rest.collect()]) == (1, [1])
    found = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 9, 9)], "dim int, kind int, rx int, rz int")
    for policy, want in (
        (checkout.Policy(), {(0, "rebuild"), (9, "delete")}),
        (checkout.Policy(keep_tombstoned_chunks=True), {(0, "rebuild"), (9, "keep")}),
        (checkout.Policy(keep_post_commit_chunks=True), {(0, "rebuild"), (9, "delete")}),
    ):
        assert {(r.rx, r.action) for r in checkout.file_plan(entries, found, policy).collect()} == want
    assert {r.action for r in checkout.file_plan(entries, found.where("rx = 9"), checkout.Policy(on_missing_file="error")).collect()} == {"error", "delete"}
