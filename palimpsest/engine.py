"""The operations: commit, status, checkout, diff, log and cache, over a store and a world."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.coords import KEY, REGION, with_region
from palimpsest.operators import cache, checkout, diff, graph, staging, tree
from palimpsest.plans.scope import WORLD, Scope
from palimpsest.sources import nbt, region_file, world
from palimpsest.store import Store, now_ms

ENTRY = "dim int, kind int, x int, z int, hash string"


class SnapshotSource(Protocol):
    """What can be committed: chunks with payloads, and the regions that are there."""

    def chunks(self, scope: Scope) -> DataFrame:
        """(key, payload, hash) of all chunks in the scope."""

    def regions(self) -> DataFrame:
        """(dim, kind, rx, rz) of all region files, empty ones too."""


class TableSource:
    """A table of (key, payload, hash) as a source."""

    def __init__(self, table: DataFrame):
        self.table = table

    def chunks(self, scope: Scope) -> DataFrame:
        return self.table.where(scope.contains()).select(*KEY, F.col("payload").cast("binary").alias("payload"), "hash")

    def regions(self) -> DataFrame:
        return staging.regions(self.table)


class WorldSource:
    """A directory of region files as a source; files outside of the scope are not opened."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, root
        self.files = world.list_files(root)

    def files_in(self, scope: Scope) -> DataFrame:
        return world.files_frame(self.spark, self.files).where(scope.matches_region())

    def chunks(self, scope: Scope) -> DataFrame:
        return world.read_chunks(self.files_in(scope)).where(scope.contains())

    def regions(self) -> DataFrame:
        return world.files_frame(self.spark, self.files).select(*REGION)


class Timings:
    """Seconds of the phases of an operation, by the order in which they end."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str, told: Callable[[str], None]) -> Iterator[None]:
        told(name)
        began = time.perf_counter()
        yield
        self.seconds[name] = round(self.seconds.get(name, 0) + time.perf_counter() - began, 3)


class Engine:
    """Operations on one store."""

    def __init__(self, store: Store, progress: Callable[[str], None] | None = None):
        self.store, self.spark = store, store.spark
        self.progress = progress or (lambda phase: None)
        self.timings = Timings()

    def source(self, of: DataFrame | str | Path | SnapshotSource) -> SnapshotSource:
        if isinstance(of, DataFrame):
            return TableSource(of)
        return WorldSource(self.spark, of) if isinstance(of, str | Path) else of

    def _held(self, of, exclusive: bool):
        return world.world_lock(of, exclusive) if isinstance(of, str | Path) else nullcontext()

    def commit(self, of, scope: Scope = WORLD, created_at_ms: int | None = None) -> dict:
        """Record the scope's present state on the active ref; returns the commit's id, counters and seconds.

        Files that are proven unchanged by the cache are not decoded.
        """
        with self._held(of, False), self.store.lock():
            head = self.store.active().commit_id
            base = self.store.snapshot(head).persist()
            with self._phase("ingest"):
                current = self._current(self.source(of), scope, base, head, payloads=True).persist()
                changes = staging.changes(current, base, scope).persist()
                changes.count()
            out = self._record(head, base, current, changes, created_at_ms)
            for frame in (changes, current, base):
                frame.unpersist()
        return out

    def commit_changes(self, changed: DataFrame, created_at_ms: int | None = None, batch: tuple[str, int] | None = None) -> dict | None:
        """Record changes (key, payload, hash), of which a null hash removes a chunk, on the active ref.

        ``batch`` names a stream and the number of its batch. It is kept with
        the ref when that moves, in one replacement of a file, so a batch that
        is run again after it was recorded changes nothing and gives None.
        """
        with self.store.lock():
            if batch is not None and self.store.last_batch(batch[0]) >= batch[1]:
                return None
            head = self.store.active().commit_id
            base = self.store.snapshot(head).persist()
            before = base.select(*KEY, F.col("hash").alias("_before"))
            # what changes nothing is no change
            joined = changed.join(before, list(KEY), "left").where(~F.col("hash").eqNullSafe(F.col("_before")))
            current = joined.select(*KEY, "payload", "hash").persist()
            out = self._record(head, base, current, current.select(*KEY, "hash"), created_at_ms, batch)
            for frame in (current, base):
                frame.unpersist()
        return out

    def _record(self, head: str | None, base: DataFrame, current: DataFrame, changes: DataFrame, created_at_ms: int | None, batch: tuple[str, int] | None = None) -> dict:
        """Store what changes, the nodes and the commit, and move the active ref."""
        store = self.store
        same = head is not None and not changes.take(1)  # then the snapshot is the head's, and all of it is stored
        with self._phase("payloads"):
            report = {"chunks": 0, "new_blobs": 0, "tombstones": 0}
            if not same:
                report = staging.change_report(changes, store.table("blobs")).first().asDict()
                changed = current.join(changes.where("hash is not null").select(*KEY), list(KEY), "left_semi")
                store.append("blobs", staging.new_blobs(changed, store.table("blobs")))
        with self._phase("tree"):
            root = store.root_of(head) if same else self._write_tree(head, base, changes)
        with self._phase("record"):
            created = now_ms() if created_at_ms is None else created_at_ms
            new = store.record([head] if head else [], created, root)
            store.move_active(head, new, batch)
        return {"id": new, **report, "seconds": self._seconds()}

    def _phase(self, name: str):
        return self.timings.phase(name, self.progress)

    def _seconds(self) -> dict[str, float]:
        """Seconds of the phases since the last call, in the order in which they ran."""
        out, self.timings = self.timings.seconds, Timings()
        return out

    def _write_tree(self, head: str | None, base: DataFrame, changes: DataFrame) -> str:
        """Store the nodes of a snapshot with changes applied; regions without a change keep their nodes."""
        store = self.store
        touched = with_region(changes).select(*REGION).distinct()
        in_touched = lambda df: with_region(df).join(touched, list(REGION), "left_semi").select(*KEY, "hash")
        entries = tree.merged(in_touched(base), changes).persist()
        fresh = tree.region_nodes(entries).persist()
        regions = store.regions(head).join(touched, list(REGION), "left_anti").unionByName(fresh)
        dims = tree.dim_nodes(regions).persist()
        root = tree.root_node(dims).first()["root_hash"]
        store.append_new("region_edges", tree.region_edges(entries, fresh).distinct(), "region_hash")
        store.append_new("dim_edges", tree.dim_edges(regions, dims).distinct(), "dim_hash")
        store.append_new("root_edges", tree.root_edges(dims, root), "root_hash")
        store.append_new("root_nodes", self.spark.createDataFrame([(root,)], "root_hash string"), "root_hash")
        for frame in (entries, fresh, dims):
            frame.unpersist()
        return root

    def status(self, of, scope: Scope = WORLD) -> dict:
        """What a commit would record; nothing is written."""
        store = self.store
        with self._held(of, False):
            source, head = self.source(of), store.active().commit_id
            base = store.snapshot(head)
            current = self._current(source, scope, base, head, payloads=False).persist()
            report = staging.status_report(current, base, store.table("blobs"), scope, source.regions()).first().asDict()
            current.unpersist()
            return report

    def _current(self, source: SnapshotSource, scope: Scope, base: DataFrame, head: str | None, payloads: bool) -> DataFrame:
        """Chunks of a source as (key, hash), with their payloads if asked for.

        Chunks of a world's files that are proven to hold what the commit ``head``
        holds are taken from there, without a payload, and the files are not decoded.
        """
        wanted = [*KEY, "payload", "hash"] if payloads else [*KEY, "hash"]
        if not isinstance(source, WorldSource):
            return source.chunks(scope).select(*wanted)
        files = source.files_in(scope)
        proven = cache.prove_unchanged(self.store.regions(head), self.store.table("region_cache"), world.file_digests(files)).persist()
        if not proven.take(1):
            return source.chunks(scope).select(*wanted)
        _, rest = cache.split_by_proof(files, proven)
        known = with_region(base).join(proven, list(REGION), "left_semi").where(scope.contains())
        known = known.select(*KEY, F.lit(None).cast("binary").alias("payload"), "hash").select(*wanted)
        return world.read_chunks(rest).where(scope.contains()).select(*wanted).unionByName(known)

    def checkout(self, root: str | Path, commit: str, policy: checkout.Policy = checkout.Policy(), scope: Scope = WORLD) -> dict:
        """Rebuild the files that the scope touches from a commit; each file is replaced as a whole or not at all."""
        store = self.store
        with self._held(root, True):
            source = WorldSource(self.spark, root)
            wanted = store.snapshot(commit).persist()
            plan = checkout.file_plan(wanted, source.regions(), policy, scope).persist()
            jobs = plan.where("action <> 'keep'").collect()  # one row for each region file of the world
            by_key = {(f.dim, f.kind, f.rx, f.rz): f.path for f in source.files}
            beside = {(f.dim, f.kind): f for f in reversed(source.files)}  # the first file of each folder
            paths = [
                (*(j[c] for c in REGION), by_key.get(key) or world.path_for(root, *key, [beside[key[:2]]] if key[:2] in beside else [], policy.on_missing_file))
                for j in jobs
                if j["action"] != "delete" and (key := tuple(j[c] for c in REGION))
            ]
            targets = self.spark.createDataFrame(paths, "dim int, kind int, rx int, rz int, path string")
            entries = with_region(wanted).join(targets, list(REGION), "left_semi").select(*KEY, "hash")
            chunks = staging.fetch_blobs(entries, store.table("blobs"), policy.on_missing_blob == "abort").select(*KEY, "payload")
            if policy.keeps_chunks:
                live = world.read_chunks(source.files_in(scope), digest=False).select(*KEY, "payload")
                chunks = checkout.with_live_chunks(chunks, live, policy)
            created = store.commits().where(F.col("id") == commit).first()["created_at_ms"]
            chunks = chunks.persist()
            chunks.count()  # all payloads are read before the first file is touched
            stamp = min(created // 1000, (1 << 32) - 1)
            done = world.write_regions(chunks, targets, stamp).agg(F.count("*").alias("n"), F.sum("written").alias("c")).first()
            doomed = [by_key[tuple(j[c] for c in REGION)] for j in jobs if j["action"] == "delete"]
            for path in doomed:
                Path(path).unlink()
            for frame in (chunks, plan, wanted):
                frame.unpersist()
        return {"rebuilt_files": done["n"], "deleted_files": len(doomed), "restored_chunks": done["c"] or 0}

    def diff_commits(self, old: str | None, new: str, scope: Scope = WORLD, keys: DataFrame | None = None) -> DataFrame:
        """(key, old, new) between two commits; by default the older is the lowest parent of the newer.

        With ``keys`` only those chunks are compared. Regions that both commits have with the same hash are left out before
        any of their chunks are read.
        """
        store = self.store
        if old is None:
            own = store.parents(new)
            old = own[0] if own else None
        before, after = (store.regions(c).where(scope.matches_region()) for c in (old, new))
        same = [*REGION, "region_hash"]
        only = [a.join(b.select(*same), same, "left_anti") for a, b in ((before, after), (after, before))]
        sides = [store.expand(r) for r in only]
        return diff.diff_commits(*sides, scope) if keys is None else diff.diff_keys(keys, *sides)

    def diff_world(self, of, commit: str | None = None, scope: Scope = WORLD, include_removed: bool = False, keys: DataFrame | None = None) -> DataFrame:
        """(key, old, new) between a commit, by default the active ref's, and a world.

        With ``keys`` only those chunks are compared, whether either side has
        them or not, and only their files are opened. Files that are proven unchanged are not decoded.
        """
        commit = commit or self.store.active().commit_id
        source, base = self.source(of), self.store.snapshot(commit)
        if keys is not None and isinstance(source, WorldSource):
            files = source.files_in(scope).join(staging.regions(keys), list(REGION), "left_semi")
            return diff.diff_keys(keys, base, world.read_chunks(files).select(*KEY, "hash"))
        live = self._current(source, scope, base, commit, payloads=False)
        return diff.diff_world(live, base, scope, include_removed) if keys is None else diff.diff_keys(keys, base, live)

    def diff_chunk(self, key: tuple[int, int, int, int], old: str | None = None, new: str | None = None, of=None) -> tuple[str | None, str | None] | None:
        """The digests of one chunk in two commits, or in a commit and a world; None where they agree."""
        keys = self.spark.createDataFrame([key], "dim int, kind int, x int, z int")
        if of is not None:
            found = self.diff_world(of, old, keys=keys)
        else:
            found = self.diff_commits(old, new or self.store.active().commit_id, keys=keys)
        rows = found.collect()  # one at most
        return (rows[0]["old"], rows[0]["new"]) if rows else None

    def read_chunk(self, of, key: tuple[int, int, int, int]) -> DataFrame:
        """(key, payload) of one chunk of a world, or no row; one file is opened and one place of it is read."""
        source = WorldSource(self.spark, of)
        dim, kind, x, z = key
        files = world.files_frame(self.spark, [f for f in source.files if (f.dim, f.kind, f.rx, f.rz) == (dim, kind, x >> 5, z >> 5)])
        return world.read_points(files.withColumn("points", F.array(F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")))))

    def places(self, of, scope: Scope = WORLD) -> DataFrame:
        """Keys of the chunks that a world's files have, in order, by their headers alone."""
        return world.present_places(WorldSource(self.spark, of).files_in(scope)).where(scope.contains()).orderBy(*KEY)

    def chunks(self, commit: str, scope: Scope = WORLD, most: int | None = None) -> DataFrame:
        """Chunks of a commit in the order of their keys, or only the first of them."""
        return tree.ordered(self.store.snapshot(commit).where(scope.contains()), most)

    def verify(self) -> DataFrame:
        """(level, node, fault) of all stored nodes that are not what their hashes say."""
        store = self.store
        checks = (("region", tree.verify_nodes, "region_edges"), ("dimension", tree.verify_dims, "dim_edges"), ("root", tree.verify_roots, "root_edges"))
        out = None
        for level, check, table in checks:
            found = check(store.table(table).distinct())
            found = found.select(F.lit(level).alias("level"), F.col(found.columns[0]).alias("node"), "fault")
            out = found if out is None else out.unionByName(found)
        return out

    def diff_blobs(self, first: str, second: str) -> dict:
        """Digests of two stored payloads, made again as those of region chunks."""
        rows = self.store.table("blobs").where(F.col("hash").isin(first, second)).collect()  # two at most
        found = {r["hash"]: nbt.chunk_key(0, region_file.unpack(bytes(r["payload"]))) for r in rows}
        return {"old": found.get(first), "new": found.get(second)}

    def log(self, stats: bool = False) -> DataFrame:
        """Commits in the order of recording, with the statistics of each against its lowest parent."""
        store = self.store
        listed = graph.commit_list(store.commits(), store.table("commit_parents"))
        if not stats:
            return listed
        base = listed.select("id", F.get("parents", F.lit(0)).alias("_parent"))
        roots = store.commits().select("id", "root_hash")
        edges = [store.table(n) for n in ("root_edges", "dim_edges", "region_edges")]
        trees = tree.snapshot(roots.select("root_hash").distinct(), *edges)
        after = roots.join(trees, "root_hash").select("id", *KEY, "hash")
        parents = base.join(roots.select(F.col("id").alias("_parent"), "root_hash"), "_parent")
        before = parents.join(trees, "root_hash").select("id", *KEY, "hash")
        counted = tree.diff_stats(after, before, ["id"])
        numbers = ["fresh_chunks", "fresh_tombstones", "new_blobs", "effective_chunks"]
        return listed.join(counted, "id", "left").fillna(0, numbers).orderBy("seq")

    def history(self, commit: str) -> DataFrame:
        return graph.history(self.store.commits(), self.store.table("commit_parents"), commit)

    def update_cache(self, root: str | Path) -> dict:
        """Keep the images of all region files under the hashes of what they hold."""
        store = self.store
        with self._held(root, False), store.lock():
            source = WorldSource(self.spark, root)
            files = source.files_in(WORLD)
            digests = world.file_digests(files).persist()
            # an image that the cache has needs no decoding: its header tells how many chunks it holds
            held = store.table("region_cache").select("image_hash", "region_hash").dropDuplicates(["image_hash"])
            known = digests.join(held, "image_hash")
            rest = files.join(known, list(REGION), "left_anti")
            chunks = world.read_chunks(rest).select(*KEY, "hash").persist()
            counts = with_region(chunks).groupBy(*REGION).agg(F.count("*").alias("chunks"))
            placed = with_region(world.present_places(files.join(known, list(REGION), "left_semi"))).groupBy(*REGION).agg(F.count("*").alias("chunks"))
            fresh = digests.join(known, list(REGION), "left_anti").join(tree.region_nodes(chunks), list(REGION), "left").join(counts, list(REGION), "left")
            images = fresh.unionByName(known.join(placed, list(REGION), "left")).fillna(0, ["chunks"]).persist()
            report = cache.update_counts(images, store.table("region_cache")).first().asDict()
            new = cache.new_images(images.where("chunks > 0"), store.table("region_cache"))
            content = files.join(images.select(*REGION, "image_hash", "region_hash"), list(REGION)).select("path", "region_hash", "image_hash")
            bytes_of = self.spark.read.format("binaryFile")
            chosen = [r["path"] for r in content.join(new, ["region_hash", "image_hash"], "left_semi").dropDuplicates(["region_hash"]).collect()]
            if chosen:  # one path for each new region of the world
                read = bytes_of.load([f"file:{p}" for p in chosen]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("content").alias("image"))
                store.append("region_cache", content.join(read, "path").dropDuplicates(["region_hash"]))
            for frame in (images, chunks, digests):
                frame.unpersist()
        return report

    def clean_cache(self) -> int:
        with self.store.lock():
            return self.store.clear_cache()
