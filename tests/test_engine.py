"""Proofs, single chunks, verification, batches and the store's tables."""

import hashlib
import json

import pytest
from test_world import chunk, packed, snapshot_of, write_file

from palimpsest import cli
from palimpsest.engine import Engine
from palimpsest.functions.names import OVERWORLD as OW
from palimpsest.sources import world
from palimpsest.store import TABLES, Store


@pytest.fixture
def decoded(monkeypatch):
    """Names of the files that are decoded."""
    found = []
    plain = world.read_chunks

    def read(files, digest=True):
        found.extend(r.path.rsplit("/", 1)[1] for r in files.collect())
        return plain(files, digest)

    monkeypatch.setattr(world, "read_chunks", read)
    return found


def fill(root, number=3, status="full"):
    for rx in range(number):
        write_file(root / f"region/r.{rx}.0.mca", {(rx * 32 + k, k): packed(chunk(rx * 32 + k, k, status=status)) for k in range(4)})


def test_cached_files_are_committed_and_compared_without_decoding(spark, tmp_path, decoded):
    root, store = tmp_path / "w", Store.init(spark, tmp_path / "s")
    engine = Engine(store)
    fill(root)
    first = engine.commit(root)
    assert first["chunks"] == 12 and sorted(decoded) == [f"r.{k}.0.mca" for k in range(3)]
    engine.update_cache(root)
    decoded.clear()
    again = engine.commit(root)
    assert (again["chunks"], again["new_blobs"], again["tombstones"]) == (0, 0, 0) and not decoded
    assert list(again["seconds"]) == ["ingest", "payloads", "tree", "record"]
    assert engine.diff_world(root).count() == 0 and engine.status(root)["clean"] and not decoded
    assert engine.update_cache(root) == {"files": 3, "chunks": 12, "entries": 0, "existing": 3, "empty": 0} and not decoded
    # one changed file is the only one that is decoded, and its images are new
    write_file(root / "region/r.1.0.mca", {(32, 0): packed(chunk(32, 0, status="new"))})
    found = engine.diff_world(root, include_removed=True).collect()
    assert sorted((r.x, r.new is None) for r in found) == [(32, False), (33, True), (34, True), (35, True)] and decoded == ["r.1.0.mca"]
    decoded.clear()
    changed = engine.commit(root)
    assert (changed["chunks"], changed["tombstones"]) == (1, 3) and decoded == ["r.1.0.mca"]
    # an image without a proof for this commit is decoded
    decoded.clear()
    assert engine.diff_world(root).count() == 0 and decoded == ["r.1.0.mca"]
    store.clear_cache()
    decoded.clear()
    assert engine.diff_world(root).count() == 0 and len(decoded) == 3


def test_single_chunks_and_places(spark, tmp_path, decoded, capsys):
    root, store = tmp_path / "w", Store.init(spark, tmp_path / "s")
    engine = Engine(store)
    fill(root)
    first = engine.commit(root)["id"]
    fill(root, status="other")
    second = engine.commit(root)["id"]
    decoded.clear()
    a, b = (snapshot_of(store, c)[OW, 0, 33, 1] for c in (first, second))
    assert engine.diff_chunk((OW, 0, 33, 1)) == (a, b) and engine.diff_chunk((OW, 0, 33, 2)) is None
    assert engine.diff_chunk((OW, 0, 33, 1), first, of=root) == (a, b) and engine.diff_chunk((OW, 0, 33, 1), of=root) is None
    assert decoded == ["r.1.0.mca"] * 2
    assert engine.diff_chunk((OW, 0, 1000, 0), of=root) is None
    got = engine.read_chunk(root, (OW, 0, 34, 2)).collect()
    assert [tuple(r)[:4] for r in got] == [(OW, 0, 34, 2)] and bytes(got[0].payload) == packed(chunk(34, 2, status="other"))
    assert engine.read_chunk(root, (OW, 0, 31, 31)).count() == engine.read_chunk(root, (9, 0, 0, 0)).count() == 0
    places = [tuple(r) for r in engine.places(root).collect()]
    assert places == sorted(places) == [tuple(r)[:4] for r in engine.chunks(second).collect()]
    assert [(r.x, r.z) for r in engine.chunks(second, most=2).collect()] == [(0, 0), (1, 1)]
    assert cli.main(["--store", str(store.path), "--json", "diff", "--old", first, "--chunk", "ow:33,1", "--chunk", "ow:500,1"], spark) == 0
    assert [(d["x"], d["old"], d["new"]) for d in json.loads(capsys.readouterr().out)["data"]] == [(33, a, b)]


def test_faults_of_all_levels_are_found(spark, tmp_path):
    root, store = tmp_path / "w", Store.init(spark, tmp_path / "s")
    engine = Engine(store)
    fill(root)
    engine.commit(root)
    assert engine.verify().count() == 0
    good, bad = "a" * 64, "g" * 64
    rows = {
        "region_edges": [("1" * 64, 0, 0, good), ("2" * 64, 32, 0, good), ("3" * 64, 0, 0, good), ("3" * 64, 0, 0, "b" * 64), ("4" * 64, 0, 0, bad)],
        "dim_edges": [("1" * 64, 0, 0, 0, good), ("2" * 64, 3, 0, 0, good), ("3" * 64, 0, 1 << 26, 0, good), ("4" * 64, 0, 0, 0, None)],
        "root_edges": [("1" * 64, 0, good), ("2" * 64, 0, good), ("2" * 64, 0, "b" * 64)],
    }
    for name, own in rows.items():
        store.append(name, spark.createDataFrame(own, TABLES[name]))
    told = {(r.level, r.node[0]): r.fault for r in engine.verify().collect()}
    assert told == {
        ("region", "1"): "digest mismatch", ("region", "2"): "place out of range", ("region", "3"): "repeated place", ("region", "4"): "malformed digest",
        ("dimension", "1"): "digest mismatch", ("dimension", "2"): "place out of range", ("dimension", "3"): "place out of range", ("dimension", "4"): "malformed digest",
        ("root", "1"): "digest mismatch", ("root", "2"): "repeated place",
    }


def test_a_batch_that_is_run_again_is_recorded_once(spark, tmp_path):
    store = Store.init(spark, tmp_path / "s")
    engine = Engine(store)
    row = lambda x, text: (0, 0, x, 0, text and text.encode(), text and hashlib.sha256(text.encode()).hexdigest())
    batch = lambda *rows: spark.createDataFrame(list(rows), "dim int, kind int, x int, z int, payload binary, hash string")
    one = engine.commit_changes(batch(row(1, "a"), row(2, "b"), row(9, None)), 5, ("s", 0))
    assert (one["chunks"], one["tombstones"], one["new_blobs"]) == (2, 0, 2)
    assert engine.commit_changes(batch(row(1, "a"), row(2, "b")), 5, ("s", 0)) is None
    assert store.commits().count() == 1 and store.active().commit_id == one["id"]
    two = engine.commit_changes(batch(row(1, None), row(2, "b"), row(3, "a")), 6, ("s", 1))
    assert (two["chunks"], two["tombstones"], two["new_blobs"]) == (1, 1, 0)
    assert engine.commit_changes(batch(row(1, "z")), 5, ("s", 0)) is None
    assert engine.commit_changes(batch(row(1, "z")), 7, ("another", 0))["chunks"] == 1
    assert {k[2] for k in snapshot_of(store, store.active().commit_id)} == {1, 2, 3}


def test_tables_may_be_compacted(spark, tmp_path):
    root, store = tmp_path / "w", Store.init(spark, tmp_path / "s")
    engine = Engine(store)
    fill(root)
    commits = [engine.commit(root)["id"]]
    fill(root, 2, "x")
    commits.append(engine.commit(root)["id"])
    before = [snapshot_of(store, c) for c in commits]
    for name in TABLES:
        store.compact(name)
    assert [snapshot_of(store, c) for c in commits] == before and engine.verify().count() == 0
    assert engine.commit(root)["chunks"] == 0
