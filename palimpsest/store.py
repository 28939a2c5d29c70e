"""A store: Parquet tables that only grow, and two small files that are replaced at once.

Order of writing: payloads, tree nodes, the commit's row, the ref. A reader
starts from refs and commit rows, so what an aborted run leaves is never seen.
One writer at a time holds the store's lock.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.coords import SIDE
from palimpsest.functions.digest import EMPTY_ROOT, commit_id
from palimpsest.functions.names import check_name, check_ref_name
from palimpsest.operators import graph, tree
from palimpsest.plans.scope import Rect, Scope, named_scope

VERSION = "1"
FEW_KEYS = 1000
TABLES = {
    "commits": "seq long, id string, created_at_ms long, root_hash string",
    "commit_parents": "child_id string, parent_id string",
    "root_nodes": "root_hash string",
    "root_edges": "root_hash string, dim int, dim_hash string",
    "dim_edges": "dim_hash string, kind int, rx int, rz int, region_hash string",
    "region_edges": "region_hash string, cx int, cz int, hash string",
    "blobs": "hash string, payload binary",
    "region_cache": "region_hash string, image_hash string, image binary",
}


class StoreError(RuntimeError):
    """A store that is missing, of another version, in use, or asked for what it lacks."""


@dataclass(frozen=True)
class Ref:
    name: str
    commit_id: str | None
    active: bool
    created_at_ms: int


def now_ms() -> int:
    return time.time_ns() // 1_000_000


class Store:
    """Tables, refs and scopes in one directory that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, Path(path)
        marker = self.path / "version"
        if not marker.exists():
            raise StoreError(f"no store in {path}")
        if (found := marker.read_text().strip()) != VERSION:
            raise StoreError(f"the store has version {found}, not {VERSION}")

    @staticmethod
    def init(spark: SparkSession, path: str | Path) -> Store:
        """Create a store, or open one that is there; a new one has the unborn ref main."""
        path = Path(path)
        path.mkdir(parents=True, exist_ok=True)
        if not (path / "version").exists():
            _replace(path / "refs.json", {"main": {"commit_id": None, "active": True, "created_at_ms": now_ms()}})
            _replace(path / "scopes.json", {})
            _replace_text(path / "version", VERSION)
        return Store(spark, path)

    @contextmanager
    def lock(self) -> Iterator[None]:
        with open(self.path / "lock", "a") as file:
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise StoreError("the store has another writer") from None
            yield

    # tables

    def table(self, name: str) -> DataFrame:
        folder = self.path / name
        if not folder.exists():
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(folder))

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        self._writer(rows.select(*columns).sortWithinPartitions(columns[0]), name).parquet(str(self.path / name))

    def _writer(self, rows: DataFrame, name: str):
        """Files sorted by the first column, with a Bloom filter where that is a hash."""
        key, kind = TABLES[name].split(", ")[0].split()
        writer = rows.write.mode("append")
        return writer.option(f"parquet.bloom.filter.enabled#{key}", "true") if kind == "string" else writer

    def append_new(self, name: str, rows: DataFrame, key: str) -> None:
        """Append rows of keys that the table lacks: nodes whose hash is stored are stored already.

        Which of the new keys are there is asked with these on the small side, so
        history is scanned for one column, never shuffled, and a few keys skip
        all files but those whose bounds or Bloom filters have them.
        """
        fresh = rows.select(key).distinct().persist()
        few = [r[0] for r in fresh.limit(FEW_KEYS + 1).collect()]
        stored = self.table(name).select(key)
        if len(few) <= FEW_KEYS:
            stored = stored.where(F.col(key).isin(few))
        known = stored.join(fresh, key, "left_semi").distinct()
        self.append(name, rows.join(known, key, "left_anti"))
        fresh.unpersist()

    def compact(self, name: str) -> None:
        """Write a table anew in few sorted files; readers of the old files must be done."""
        key = TABLES[name].split()[0]
        folder, fresh = self.path / name, self.path / f"{name}.new"
        if folder.exists():
            with self.lock():
                shutil.rmtree(fresh, ignore_errors=True)
                self._writer(self.table(name).distinct().repartitionByRange(key).sortWithinPartitions(key), name).parquet(str(fresh))
                old = self.path / f"{name}.old"
                folder.rename(old)
                fresh.rename(folder)
                shutil.rmtree(old)

    def clear_cache(self) -> int:
        count = self.table("region_cache").count()
        shutil.rmtree(self.path / "region_cache", ignore_errors=True)
        return count

    # commits

    def commits(self) -> DataFrame:
        return self.table("commits")

    def parents(self, commit: str) -> list[str]:
        return [r[0] for r in graph.parents_of(self.table("commit_parents"), self.commits(), commit).collect()]

    def root_of(self, commit: str | None) -> str:
        if commit is None:
            return EMPTY_ROOT
        rows = self.commits().where(F.col("id") == commit).select("root_hash").take(1)
        if not rows:
            raise StoreError(f"unknown commit {commit}")
        return rows[0][0]

    def snapshot(self, commit: str | None) -> DataFrame:
        """Chunks of a commit; an unborn one has none."""
        root = self.spark.createDataFrame([(self.root_of(commit),)], "root_hash string")
        edges = (self.table(n) for n in ("root_edges", "dim_edges", "region_edges"))
        return tree.snapshot(root, *edges).drop("root_hash")

    def regions(self, commit: str | None) -> DataFrame:
        """(region, region_hash) of a commit."""
        top = self.table("root_edges").where(F.col("root_hash") == self.root_of(commit))
        return top.join(self.table("dim_edges"), "dim_hash").select("dim", "kind", "rx", "rz", "region_hash")

    def expand(self, regions: DataFrame) -> DataFrame:
        """Chunks of (region, region_hash), read from the nodes of those regions only."""
        walk = regions.join(self.table("region_edges"), "region_hash")
        x, z = (F.col(r) * SIDE + F.col(c) for r, c in (("rx", "cx"), ("rz", "cz")))
        return walk.select("dim", "kind", x.alias("x"), z.alias("z"), "hash")

    def record(self, parents: list[str], created_at_ms: int, root_hash: str) -> str:
        """Add a commit's row; recording the same commit again changes nothing."""
        parents = sorted(set(parents))
        known = {r[0] for r in self.commits().where(F.col("id").isin(parents)).select("id").collect()}
        if missing := set(parents) - known:
            raise StoreError(f"unknown parent {min(missing)}")
        new = commit_id(parents, created_at_ms, root_hash)
        if not self.commits().where(F.col("id") == new).take(1):
            seq = (self.commits().agg(F.max("seq")).first()[0] or 0) + 1
            if parents:
                self.append("commit_parents", self.spark.createDataFrame([(new, p) for p in parents], TABLES["commit_parents"]))
            self.append("commits", self.spark.createDataFrame([(seq, new, created_at_ms, root_hash)], TABLES["commits"]))
        return new

    def create_commit(self, parents: list[str], created_at_ms: int) -> str:
        """A commit without changes, on the root of its lowest parent or the empty one; no ref moves."""
        with self.lock():
            return self.record(parents, created_at_ms, self.root_of(min(parents) if parents else None))

    def resolve(self, text: str) -> str:
        """A commit by its id in hex or by a ref's name."""
        if len(text) == 64 and not set(text.lower()) - set("0123456789abcdef"):
            if self.commits().where(F.col("id") == text.lower()).take(1):
                return text.lower()
            raise StoreError(f"unknown commit {text}")
        for ref in self.refs():
            if ref.name == text:
                if ref.commit_id is None:
                    raise StoreError(f"ref {text} has no commit yet")
                return ref.commit_id
        raise StoreError(f"unknown ref {text}")

    # refs

    def _refs(self) -> dict:
        return json.loads((self.path / "refs.json").read_text())

    def refs(self) -> list[Ref]:
        """Refs in byte order of their names."""
        return [Ref(n, r["commit_id"], r["active"], r["created_at_ms"]) for n, r in sorted(self._refs().items(), key=lambda x: x[0].encode())]

    def active(self) -> Ref:
        found = [r for r in self.refs() if r.active]
        if not found:
            raise StoreError("no ref is active")
        if found[0].commit_id is not None:
            self.root_of(found[0].commit_id)  # a ref to a lost commit is an error
        return found[0]

    def create_ref(self, name: str, commit: str | None = None, force: bool = False) -> Ref:
        check_ref_name(name)
        refs = self._refs()
        if name in refs and not force:
            raise StoreError(f"ref {name} exists")
        if commit is not None:
            self.root_of(commit)
        old = refs.get(name, {"active": False, "created_at_ms": now_ms()})
        refs[name] = old | {"commit_id": commit}
        _replace(self.path / "refs.json", refs)
        return next(r for r in self.refs() if r.name == name)

    def delete_ref(self, name: str) -> bool:
        refs = self._refs()
        if name not in refs:
            return False
        if refs[name]["active"]:
            raise StoreError(f"ref {name} is active")
        del refs[name]
        _replace(self.path / "refs.json", refs)
        return True

    def activate_ref(self, name: str) -> Ref:
        refs = self._refs()
        if name not in refs:
            raise StoreError(f"unknown ref {name}")
        _replace(self.path / "refs.json", {n: r | {"active": n == name} for n, r in refs.items()})
        return self.active()

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that the active ref has, or -1."""
        return next((r.get("batches", {}).get(stream, -1) for r in self._refs().values() if r["active"]), -1)

    def move_active(self, expected: str | None, commit: str, batch: tuple[str, int] | None = None) -> None:
        """Move the active ref, unless it is no longer where the caller saw it; a stream's batch is noted in the same step."""
        refs = self._refs()
        name = next(n for n, r in refs.items() if r["active"])
        if refs[name]["commit_id"] not in (expected, commit):
            raise StoreError(f"ref {name} moved meanwhile")
        refs[name]["commit_id"] = commit
        if batch is not None:
            refs[name].setdefault("batches", {})[batch[0]] = batch[1]
        _replace(self.path / "refs.json", refs)

    # scopes

    def _scopes(self) -> dict:
        return json.loads((self.path / "scopes.json").read_text())

    def scopes(self) -> list[tuple[str, list[tuple[int, Rect]], int]]:
        out = []
        for name, s in sorted(self._scopes().items(), key=lambda x: x[0].encode()):
            if not s["areas"]:
                raise StoreError(f"scope {name} has no areas")
            out.append((name, [(d, Rect(*r)) for d, r in s["areas"]], s["created_at_ms"]))
        return out

    def create_scope(self, name: str, areas: list[tuple[int, Rect]], force: bool = False) -> None:
        """Save a named scope; replacing one keeps the time at which it was created."""
        check_name(name)
        scopes = self._scopes()
        if name in scopes and not force:
            raise StoreError(f"scope {name} exists")
        if not areas:
            raise StoreError("a scope needs an area")
        own = sorted({(d, (r.x0, r.z0, r.x1, r.z1)) for d, r in areas})
        created = scopes.get(name, {}).get("created_at_ms", now_ms())
        scopes[name] = {"areas": [[d, list(r)] for d, r in own], "created_at_ms": created}
        _replace(self.path / "scopes.json", scopes)

    def delete_scope(self, name: str) -> bool:
        scopes = self._scopes()
        found = scopes.pop(name, None) is not None
        if found:
            _replace(self.path / "scopes.json", scopes)
        return found

    def resolve_scope(self, name: str) -> Scope:
        for found, areas, _ in self.scopes():
            if found == name:
                return named_scope(areas)
        raise StoreError(f"unknown scope {name}")


def _replace_text(path: Path, text: str) -> None:
    handle, temp = tempfile.mkstemp(prefix=".new-", dir=path.parent)
    with os.fdopen(handle, "w") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(temp, path)


def _replace(path: Path, value: dict) -> None:
    _replace_text(path, json.dumps(value, indent=1, sort_keys=True))
