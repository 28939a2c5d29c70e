"""Region files, NBT, layouts, the store and the operations, against plain models."""

import gzip
import hashlib
import io
import json
import random
import struct
import zlib

import pytest
import xxhash

from palimpsest import cli
from palimpsest.engine import Engine
from palimpsest.functions.names import NETHER, OVERWORLD, BadName, check_ref_name
from palimpsest.operators.checkout import Policy
from palimpsest.plans.scope import Area, Rect, Scope, parse_area, parse_region
from palimpsest.sources import nbt, region_file, world
from palimpsest.sources.region_file import RegionBuilder, RegionError
from palimpsest.store import Store, StoreError


def tag(kind, name, body):
    return bytes([kind]) + nbt.name_bytes(name) + body


def integer(v):
    return struct.pack(">i", v)


def chunk(x, z, status="full", last=0, extra=b"", light=b"\1\2"):
    section = tag(nbt.BYTE, "Y", b"\0") + tag(nbt.BYTES, "BlockLight", integer(len(light)) + light) + b"\0"
    fields = [
        tag(nbt.INT, "DataVersion", integer(3465)), tag(nbt.INT, "xPos", integer(x)), tag(nbt.INT, "zPos", integer(z)),
        tag(nbt.INT, "yPos", integer(-4)), tag(nbt.STRING, "Status", nbt.name_bytes(status)), tag(nbt.LONG, "LastUpdate", struct.pack(">q", last)),
        tag(nbt.LONG, "InhabitedTime", struct.pack(">q", last * 2)), tag(nbt.LIST, "sections", bytes([nbt.COMPOUND]) + integer(1) + section),
        tag(nbt.LIST, "block_entities", bytes(5)), tag(nbt.COMPOUND, "Heightmaps", b"\0"), tag(nbt.LIST, "fluid_ticks", bytes(5)),
        tag(nbt.LIST, "block_ticks", bytes(5)), extra,
    ]
    return tag(nbt.COMPOUND, "", b"".join(fields) + b"\0")


def packed(document, how=2):
    if how == 1:
        return b"\1" + gzip.compress(document)
    return b"\2" + zlib.compress(document) if how == 2 else b"\3" + document


def lz4_stream(data):
    literal = bytes([0xF0, len(data) - 15]) if 15 <= len(data) < 270 else bytes([len(data) << 4])
    block = literal + data
    check = xxhash.xxh32_intdigest(data, 0x9747B28C) & 0x0FFFFFFF
    head = b"LZ4Block" + struct.pack("<BIII", 0x25, len(block), len(data), check)
    return b"\4" + head + block + b"LZ4Block" + struct.pack("<BIII", 0x25, 0, 0, 0)


def write_file(path, chunks):
    rx, rz = region_file.parse_name(path.name)
    b = RegionBuilder(rx, rz, 5)
    for (x, z), payload in chunks.items():
        b.stage_chunk(x, z, payload)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b.image())


def test_region_image_bytes():
    b = RegionBuilder(-1, 0, 7)
    b.stage_chunk(-32, 0, b"\3old")
    b.stage_chunk(-31, 1, b"\3" + b"x" * 5000)
    b.stage_chunk(-32, 0, b"\3new")
    b.stage_chunk(-1, 31, b"\3gone")
    b.remove_chunk(-1, 31)
    image = b.image()
    assert len(image) == 4096 * 5
    assert image[:4] == integer(2 << 8 | 1) and image[4 * 33 : 4 * 34] == integer(3 << 8 | 2)
    assert image[4096:4100] == integer(7)
    assert image[8192:8200] == integer(4) + b"\3new" and not any(image[8200:12288])
    assert dict(region_file.chunks(image)) == {0: b"\3new", 33: b"\3" + b"x" * 5000}
    assert region_file.point(image, -1, 0, -32, 0) == b"\3new" and region_file.point(image, -1, 0, 5, 0) is None
    assert list(region_file.chunks(b"")) == [] and list(region_file.chunks(bytes(8192))) == []
    for bad in (image[:100], integer(1 << 8 | 1) + image[4:], integer(9 << 8 | 1) + image[4:], image[:8192] + integer(9999) + image[8196:], image[:-4000][:12288]):
        with pytest.raises(RegionError):
            list(region_file.chunks(bad))
    assert len(dict(region_file.chunks(image[:-3000]))) == 2  # a partial last sector
    with pytest.raises(RegionError):
        b.stage_chunk(0, 0, b"\3x")
    with pytest.raises(RegionError):
        b.stage_chunk(-32, 0, bytes(255 * 4096))


def test_packings():
    data = b"some document " * 10
    for payload in (packed(data, 1), packed(data, 2), packed(data, 3), lz4_stream(data)):
        assert region_file.unpack(payload) == data
    assert region_file.lz4_block(bytes([0x1F]) + b"a" + b"\1\0" + bytes([0]), 20) == b"a" * 20
    bad = bytearray(lz4_stream(data))
    bad[25] ^= 1
    for payload in (b"", b"\0x", b"\x7fx", b"\x80x", packed(data, 1)[:-4], packed(data, 1) + b"x", packed(data, 2)[:-3], bytes(bad)):
        with pytest.raises(RegionError):
            region_file.unpack(payload)


def test_normalised_view():
    key = lambda **k: nbt.chunk_key(0, chunk(1, 2, **k))
    assert key() == key(last=99)
    assert key() != key(status="empty") and key() != key(light=b"\1\3")
    assert key() == key(extra=tag(nbt.INT, "unknown", integer(1)))
    assert key() == key(extra=tag(nbt.BYTE, "isLightOn", b"\0")) != key(extra=tag(nbt.BYTE, "isLightOn", b"\1"))
    assert key() != key(extra=tag(nbt.COMPOUND, "structures", b"\0"))
    assert nbt.chunk_key(0, chunk(1, 2).replace(b"\6Status", b"\6status")) == key()
    level = tag(nbt.COMPOUND, "Level", tag(nbt.INT, "xPos", integer(3)) + tag(nbt.LONG, "LastUpdate", bytes(8)) + b"\0")
    legacy = tag(nbt.COMPOUND, "", level + b"\0")
    assert nbt.chunk_key(0, legacy) not in (key(), nbt.chunk_key(0, tag(nbt.COMPOUND, "", tag(nbt.INT, "DataVersion", integer(9)) + level + b"\0")))
    with pytest.raises(nbt.MissingField, match="Status"):
        nbt.chunk_key(0, chunk(1, 2).replace(b"\6Status", b"\6Statut"))
    for cut in (1, 5, 20, len(chunk(1, 2)) - 1):
        with pytest.raises(nbt.NbtError):
            nbt.chunk_key(1, chunk(1, 2)[:cut])
    assert nbt.chunk_key(1, chunk(1, 2)) == hashlib.sha256(chunk(1, 2)).hexdigest()


def test_layouts(tmp_path):
    def make(*paths):
        root = tmp_path / str(len(list(tmp_path.iterdir())))
        for p in paths:
            (root / p).mkdir(parents=True)
        return root

    assert world.detect(make("region")) == ("single-legacy", "")
    assert world.detect(make("dimensions/minecraft/overworld/region")) == ("single", "")
    assert world.detect(make("world/region", "world_nether/DIM-1/region")) == ("server-legacy", "world")
    assert world.detect(make("b/dimensions/minecraft/overworld/poi", "a_nether", "a")) == ("server", "b")
    assert world.detect(make("nothing")) is None
    root = make("x/region", "y/region", "y_nether")
    (root / "server.properties").write_text("#level-name=y\n level-name= x \n")
    assert world.detect(root) == ("server-legacy", "x")
    (root / "server.properties").write_text("level-name=../y\n")
    assert world.detect(root) == ("server-legacy", "y")
    single = make("dimensions/minecraft/the_nether/region", "dimensions/a:b/c/region")
    found = world.dimensions(single)
    assert NETHER in found and len(found) == 2
    assert world.canonical_key("a:b", "c\\") == b"a\\:b:c\\\\"


def test_files_and_places(spark, tmp_path):
    write_file(tmp_path / "region/r.0.-1.mca", {(3, -5): packed(chunk(3, -5)), (31, -1): packed(chunk(31, -1), 1)})
    (tmp_path / "region/r.01.0.mca").write_bytes(b"x")
    (tmp_path / "region/notes.txt").write_bytes(b"x")
    (tmp_path / "entities").mkdir()
    (tmp_path / "entities/r.2.2.mca").write_bytes(b"")
    files = world.list_files(tmp_path)
    assert [(f.kind, f.rx, f.rz) for f in files] == [(0, 0, -1), (1, 2, 2)]
    frame = world.files_frame(spark, files)
    assert [tuple(r) for r in world.present_places(frame).collect()] == [(OVERWORLD, 0, 3, -5), (OVERWORLD, 0, 31, -1)]
    got = {(r.x, r.z): (bytes(r.payload), r.hash) for r in world.read_chunks(frame).collect()}
    assert got[3, -5] == (packed(chunk(3, -5)), nbt.chunk_key(0, chunk(3, -5)))
    digests = {r.kind: r.image_hash for r in world.file_digests(frame).collect()}
    assert digests[1] == hashlib.sha256(b"").hexdigest()


def test_names_and_areas():
    for good in ("main", "a/b.c-d_e", "Spawn", "1a", "..."):
        assert check_ref_name(good) == good
    for bad in ("", "/a", "a/", "a//b", "a/../b", ".", "é", "x" * 256, "123", "HEAD", "head"):
        with pytest.raises(BadName):
            check_ref_name(bad)
    assert parse_area("nether:5,-3..1,9") == Area(NETHER, Rect(1, -3, 5, 9))
    assert parse_area("7") == Area(7) and parse_area("ow:1,2").chunks == {(1, 2)}
    assert parse_region("0:1,-1").rect == Rect(32, -32, 63, -1)
    for bad in ("x", "0:1", "0:1,2..3", "0:a,b"):
        with pytest.raises(ValueError):
            parse_area(bad)
    assert Rect.region(1 << 30, -(1 << 30)) == Rect((1 << 31) - 32, -(1 << 31), (1 << 31) - 1, -(1 << 31) + 31)


def test_refs_and_scopes(spark, tmp_path):
    store = Store.init(spark, tmp_path / "s")
    assert [r.name for r in store.refs()] == ["main"] and store.active().commit_id is None
    root = store.create_commit([], 5)
    assert store.create_commit([], 5) == root and store.commits().count() == 1
    child = store.create_commit([root, root], 6)
    assert store.parents(child) == [root] and store.resolve(child.upper()) == child
    with pytest.raises(StoreError):
        store.create_commit(["0" * 64], 7)
    store.create_ref("b", child)
    store.create_ref("B", root)
    assert [r.name for r in store.refs()] == ["B", "b", "main"]
    with pytest.raises(StoreError):
        store.create_ref("b", root)
    assert store.create_ref("b", root, force=True).commit_id == root and store.resolve("b") == root
    with pytest.raises(StoreError):
        store.delete_ref("main")
    assert store.activate_ref("b").name == "b" and store.delete_ref("main") and not store.delete_ref("main")
    store.create_scope("Spawn", [(0, Rect(0, 0, 3, 3)), (0, Rect(0, 0, 3, 3)), (1, Rect(5, 5, 6, 6))])
    created = store.scopes()[0][2]
    with pytest.raises(StoreError):
        store.create_scope("Spawn", [(0, Rect(0, 0, 1, 1))])
    store.create_scope("Spawn", [(0, Rect(0, 0, 1, 1))], force=True)
    assert store.scopes() == [("Spawn", [(0, Rect(0, 0, 1, 1))], created)]
    assert store.delete_scope("Spawn") and not store.delete_scope("Spawn")
    (tmp_path / "s/version").write_text("9")
    with pytest.raises(StoreError):
        Store(spark, tmp_path / "s")
    with store.lock(), pytest.raises(StoreError):
        store.create_commit([], 9)


def snapshot_of(store, commit):
    return {(r.dim, r.kind, r.x, r.z): r.hash for r in store.snapshot(commit).collect()}


def test_random_worlds_against_a_model(spark, tmp_path):
    """Random edits, commits, and every checkout in reverse, on tables and files alike."""
    rng = random.Random(11)
    root, store = tmp_path / "w", Store.init(spark, tmp_path / "s")
    engine = Engine(store)
    regions = [(0, 0), (-1, 0), (0, -1)]
    live = {}
    kept = []
    for step in range(4):
        for _ in range(12):
            rx, rz = rng.choice(regions)
            x, z = rx * 32 + rng.randrange(32), rz * 32 + rng.randrange(4)
            if rng.random() < 0.3 and live:
                live.pop(rng.choice(sorted(live)), None)
            else:
                live[x, z] = packed(chunk(x, z, status=rng.choice(["full", "noise"]), last=step), rng.choice([1, 2, 3]))
        for rx, rz in regions:
            own = {k: v for k, v in live.items() if (k[0] >> 5, k[1] >> 5) == (rx, rz)}
            path = root / f"region/r.{rx}.{rz}.mca"
            if own:
                write_file(path, own)
            else:
                path.unlink(missing_ok=True)
        want = {(OVERWORLD, 0, *k): nbt.chunk_key(0, region_file.unpack(v)) for k, v in live.items()}
        before = snapshot_of(store, store.active().commit_id)
        blobs = {r.hash for r in store.table("blobs").collect()}
        status = engine.status(root)
        engine.update_cache(root)
        report = engine.commit(root, created_at_ms=1000 + step)
        changed = [k for k, h in want.items() if before.get(k) != h]
        gone = [k for k in before if k not in want]
        assert (report["chunks"], report["tombstones"]) == (len(changed), len(gone))
        assert (status["new_chunks"], status["tombstones"]) == (len(changed), len(gone))
        assert report["new_blobs"] == len({want[k] for k in changed} - blobs)
        assert status["new_blobs"] == sum(want[k] not in blobs for k in changed)
        assert snapshot_of(store, report["id"]) == want
        again = engine.status(root)
        assert again["clean"] and again["new_chunks"] == 0
        kept.append((report["id"], want, before))
    stats = {r.id: r for r in engine.log(stats=True).collect()}
    for commit, want, before in kept:
        s = stats[commit]
        assert s.effective_chunks == len(want)
        assert s.fresh_chunks == sum(before.get(k) != h for k, h in want.items()) and s.fresh_tombstones == sum(k not in want for k in before)
    assert [r.id for r in engine.history(kept[-1][0]).collect()] == [k[0] for k in reversed(kept)]
    for commit, want, _ in reversed(kept):
        report = engine.checkout(root, commit)
        assert report["restored_chunks"] == len(want)
        got = {(r.dim, r.kind, r.x, r.z): r.hash for r in world.read_chunks(world.files_frame(spark, world.list_files(root))).collect()}
        assert got == want
    assert engine.clean_cache() > 0 and engine.clean_cache() == 0


def test_scoped_commit_diff_and_policies(spark, tmp_path):
    root, store = tmp_path / "w", Store.init(spark, tmp_path / "s")
    engine = Engine(store)
    a, b = {(0, 0): packed(chunk(0, 0)), (1, 0): packed(chunk(1, 0))}, {(40, 0): packed(chunk(40, 0))}
    write_file(root / "region/r.0.0.mca", a)
    write_file(root / "region/r.1.0.mca", b)
    first = engine.commit(root, created_at_ms=1)["id"]
    write_file(root / "region/r.0.0.mca", {(0, 0): packed(chunk(0, 0, status="new")), (5, 5): packed(chunk(5, 5))})
    (root / "region/r.1.0.mca").unlink()
    write_file(root / "region/r.2.0.mca", {(64, 0): packed(chunk(64, 0))})
    one = Scope(areas=(Area(OVERWORLD, Rect(0, 0, 0, 0)),))
    assert engine.status(root, one) == {"clean": False, "changed_regions": 1, "new_files": 0, "deleted_files": 0, "new_chunks": 1, "tombstones": 0, "new_blobs": 1}
    second = engine.commit(root, one, created_at_ms=2)["id"]
    assert {k[2:] for k in snapshot_of(store, second)} == {(0, 0), (1, 0), (40, 0)}
    changed = engine.diff_commits(None, second).collect()
    assert [(r.x, r.z) for r in changed] == [(0, 0)]
    assert {(r.x, r.z) for r in engine.diff_world(root, first).collect()} == {(0, 0), (5, 5), (64, 0)}
    assert {(r.x, r.z) for r in engine.diff_world(root, first, include_removed=True).collect()} == {(0, 0), (5, 5), (64, 0), (1, 0), (40, 0)}
    own = snapshot_of(store, first)[OVERWORLD, 0, 0, 0]
    assert engine.diff_blobs(own, own) == {"old": own, "new": own}
    report = engine.checkout(root, first, Policy(keep_post_commit_files=True, keep_post_commit_chunks=True))
    assert report["deleted_files"] == 0
    places = lambda: {(r.x, r.z) for r in world.present_places(world.files_frame(spark, world.list_files(root))).collect()}
    assert places() == {(0, 0), (1, 0), (5, 5), (40, 0), (64, 0)}
    with pytest.raises(world.WorldError), world.world_lock(root, False):
        engine.checkout(root, first)
    assert engine.checkout(root, first)["deleted_files"] == 1 and places() == {(0, 0), (1, 0), (40, 0)}
    (root / "region/r.1.0.mca").unlink()
    with pytest.raises(world.WorldError):
        engine.checkout(root, first, Policy(on_missing_file="error"))


def test_stream_of_changes(spark, tmp_path):
    from palimpsest.streaming.commits import commit_stream

    store = Store.init(spark, tmp_path / "s")
    schema = "seq long, dim int, kind int, x int, z int, payload binary, hash string"
    row = lambda seq, x, text: (seq, 0, 0, x, 0, text and text.encode(), text and hashlib.sha256(text.encode()).hexdigest())
    for n, rows in enumerate([[row(1, 1, "a"), row(2, 2, "b"), row(3, 1, "c")], [row(4, 2, None), row(5, 3, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        commit_stream(Engine(store), stream, str(tmp_path / "check")).awaitTermination()
        assert store.commits().count() == n + 1
    assert {k[2]: h for k, h in snapshot_of(store, store.active().commit_id).items()} == {x: row(0, x, t)[6] for x, t in ((1, "c"), (3, "d"))}


def test_command_line(spark, tmp_path, capsys):
    root, store = tmp_path / "w", str(tmp_path / "s")
    write_file(root / "region/r.0.0.mca", {(0, 0): packed(chunk(0, 0))})

    def call(*args, code=0):
        assert cli.main(["--store", store, "--json", *map(str, args)], spark) == code
        out = json.loads(capsys.readouterr().out)
        return out["data"] if code == 0 else out["error"]

    assert "no store" in call("log", code=1)
    call("init")
    assert call("status", root)["new_chunks"] == 1
    first = call("commit", root)["id"]
    write_file(root / "region/r.0.0.mca", {(0, 0): packed(chunk(0, 0, status="b")), (2, 0): packed(chunk(2, 0))})
    assert call("commit", root, "--in", "ow:2,0")["chunks"] == 1
    assert [(d["x"], d["kind"], d["old"]) for d in call("diff")] == [(2, "region", None)]
    assert len(call("diff", "--world", root, "--old", first)) == 2
    log = call("log", "--stat")
    assert [c["effective_chunks"] for c in log] == [1, 2] and log[1]["parents"] == [first]
    call("ref", "create", "old", first)
    assert [r["name"] for r in call("ref", "list")] == ["main", "old"]
    assert call("scope", "create", "spawn", "ow:0,0..1,1")[0]["name"] == "spawn"
    assert call("status", root, "--scope", "spawn")["new_chunks"] == 1
    assert call("checkout", root, "old")["restored_chunks"] == 1
    assert call("cache", "clean")["removed"] >= 1
    assert "unknown ref" in call("checkout", root, "nope", code=1)


def test_gzip_members_and_io():
    assert region_file.unpack(b"\1" + gzip.compress(b"a" * 100)) == b"a" * 100
    buffer = io.BytesIO()
    with gzip.GzipFile("name", "wb", fileobj=buffer) as f:
        f.write(b"named")
    assert region_file.unpack(b"\1" + buffer.getvalue()) == b"named"
