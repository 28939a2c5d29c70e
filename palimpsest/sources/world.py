"""Worlds of region files in a directory: their layout, their files and their chunks.

The directory is one that the driver and all executors see under the same path.
The driver lists the files; reading, decoding and writing them is done by
executors, one file at a time.
"""

from __future__ import annotations

import fcntl
import hashlib
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.coords import KEY, REGION
from palimpsest.functions.digest import dimension_id
from palimpsest.functions.names import END, NETHER, OVERWORLD
from palimpsest.sources import nbt, region_file

# Directories of each kind, and of the three dimensions that every world may have.
KIND_DIRS = ("region", "entities", "poi")
TRIO = ("overworld", "the_nether", "the_end")


class WorldError(ValueError):
    """A directory that holds no world, or one that can be read in two ways."""


def _dirs(path: Path) -> list[Path]:
    try:
        return sorted(p for p in path.iterdir() if p.is_dir())
    except FileNotFoundError:
        return []


def is_world(path: Path) -> bool:
    return any((path / k).is_dir() for k in KIND_DIRS)


def level_name(root: Path) -> str | None:
    """``level-name`` of a server's properties, if it is one plain directory name."""
    try:
        text = (root / "server.properties").read_text()
    except (OSError, UnicodeDecodeError):
        return None
    for line in text.splitlines():
        key, _, value = line.strip().partition("=")
        value = value.strip()
        if key == "level-name" and value not in ("", ".", "..") and not set(value) & set("/\\"):
            return value
    return None


def server_bases(root: Path) -> list[str]:
    """Worlds that a server's directory may have: the one it names, or those with the look of one."""
    if named := level_name(root):
        return [named]
    found = []
    for p in _dirs(root):
        if p.name in ("dimensions", "DIM-1", "DIM1"):
            continue
        siblings = any((root / f"{p.name}_{x}").is_dir() for x in ("nether", "the_end"))
        if siblings or (p / "dimensions").is_dir():
            found.append(p.name)
    return sorted(found, key=lambda n: (n != "world", n))


def detect(root: Path) -> tuple[str, str] | None:
    """(layout, base): server, server-legacy, single or single-legacy; servers first."""
    for base in server_bases(root):
        if any(is_world(root / base / "dimensions" / "minecraft" / t) for t in TRIO):
            return "server", base
        if any(map(is_world, (root / base, root / f"{base}_nether" / "DIM-1", root / f"{base}_the_end" / "DIM1"))):
            return "server-legacy", base
    if any(is_world(root / "dimensions" / "minecraft" / t) for t in TRIO):
        return "single", ""
    if any(map(is_world, (root, root / "DIM-1", root / "DIM1"))):
        return "single-legacy", ""
    return None


def canonical_key(namespace: str, name: str) -> bytes:
    """``namespace:name`` with separators inside either escaped."""
    escape = lambda s: os.fsencode(s).replace(b"\\", b"\\\\").replace(b":", b"\\:")
    return escape(namespace) + b":" + escape(name)


def custom_dimensions(root: Path) -> dict[int, Path]:
    return {dimension_id(canonical_key(n.name, d.name)): d for n in _dirs(root) for d in _dirs(n)}


def dimensions(root: Path) -> dict[int, Path]:
    """Directory of each dimension, by its code."""
    layout = detect(root)
    if layout is None:
        raise WorldError(f"no world in {root}")
    kind, base = layout
    if kind == "single":
        return custom_dimensions(root / "dimensions")
    if kind == "server":
        found = custom_dimensions(root / base / "dimensions")
    elif kind == "single-legacy":
        fixed = {OVERWORLD: root, NETHER: root / "DIM-1", END: root / "DIM1"}
        return custom_dimensions(root / "dimensions") | fixed
    else:
        found = {OVERWORLD: root / base, NETHER: root / f"{base}_nether" / "DIM-1", END: root / f"{base}_the_end" / "DIM1"}
    for p in _dirs(root):
        if p.name.startswith(f"{base}_") and p.name[len(base) + 1 :] not in ("nether", "the_end"):
            found |= custom_dimensions(p / "dimensions")
    return found


@dataclass(frozen=True)
class RegionFile:
    """A file of one region."""

    dim: int
    kind: int
    rx: int
    rz: int
    path: str
    size: int = 0
    mtime_ms: int | None = None


FILES = "dim int, kind int, rx int, rz int, path string, size long, mtime_ms long"


def list_files(root: str | Path) -> list[RegionFile]:
    """All region files by key; files with other names are skipped, two of one key are an error."""
    found: dict[tuple[int, ...], RegionFile] = {}
    for dim, directory in sorted(dimensions(Path(root)).items()):
        for kind, name in enumerate(KIND_DIRS):
            folder = directory / name
            for entry in sorted(os.scandir(folder), key=lambda e: e.name) if folder.is_dir() else ():
                place = region_file.parse_name(entry.name)
                if place is None or not entry.is_file():
                    continue
                key = (dim, kind, *place)
                if key in found:
                    raise WorldError(f"{entry.path} and {found[key].path} are one region")
                stat = entry.stat()
                found[key] = RegionFile(*key, entry.path, stat.st_size, stat.st_mtime_ns // 1_000_000)
    return [found[k] for k in sorted(found)]


def path_for(root: str | Path, dim: int, kind: int, rx: int, rz: int, files: list[RegionFile], policy: str = "sibling") -> str:
    """Where to create a region's file: beside one of its dimension and kind, or where the layout has it."""
    if policy == "error":
        raise WorldError(f"no file for region {rx},{rz} of dimension {dim}")
    name = f"r.{rx}.{rz}.mca"
    if policy == "sibling":
        for f in files:
            if (f.dim, f.kind) == (dim, kind):
                return str(Path(f.path).with_name(name))
    known = dimensions(Path(root))
    if dim not in known:
        raise WorldError(f"dimension {dim} has no directory in this world")
    return str(known[dim] / KIND_DIRS[kind] / name)


def files_frame(spark: SparkSession, files: list[RegionFile]) -> DataFrame:
    """The files as a table, spread so that every task has a few."""
    rows = [(f.dim, f.kind, f.rx, f.rz, f.path, f.size, f.mtime_ms) for f in files]
    frame = spark.createDataFrame(rows, FILES)
    return frame.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "path")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


CHUNK_SCHEMA = pa.schema([("dim", pa.int32()), ("kind", pa.int32()), ("x", pa.int32()), ("z", pa.int32()), ("payload", pa.binary()), ("hash", pa.string())])


def read_chunks(files: DataFrame, digest: bool = True) -> DataFrame:
    """(key, payload, hash) of all chunks of the files; one file is in memory at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _rows(batches):
            with open(f["path"], "rb") as file:
                image = file.read()
            out = []
            for slot, payload in region_file.chunks(image):
                x, z = f["rx"] * 32 + (slot & 31), f["rz"] * 32 + (slot >> 5)
                try:
                    key = nbt.chunk_key(f["kind"], region_file.unpack(payload)) if digest else None
                except ValueError as e:
                    raise ValueError(f"chunk {x},{z} of {f['path']}: {e}") from e
                out.append((f["dim"], f["kind"], x, z, payload, key))
            yield _batch(out, CHUNK_SCHEMA)

    return files.mapInArrow(work, "dim int, kind int, x int, z int, payload binary, hash string")


PLACE_SCHEMA = pa.schema([(c, pa.int32()) for c in KEY])


def present_places(files: DataFrame) -> DataFrame:
    """Keys of chunks that the files' headers give a sector; only headers are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _rows(batches):
            region_file.check_length(os.path.getsize(f["path"]))
            with open(f["path"], "rb") as file:
                header = file.read(region_file.HEADER)
            places = [(f["dim"], f["kind"], f["rx"] * 32 + (s & 31), f["rz"] * 32 + (s >> 5)) for s in region_file.present_slots(header)]
            yield _batch(places, PLACE_SCHEMA)

    return files.mapInArrow(work, "dim int, kind int, x int, z int").distinct().orderBy(*KEY)


POINT_SCHEMA = pa.schema([*((c, pa.int32()) for c in KEY), ("payload", pa.binary())])


def read_points(files: DataFrame) -> DataFrame:
    """(key, payload) of the places that each file has in its column ``points`` of (x, z); only these are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _rows(batches):
            with open(f["path"], "rb") as file:
                image = file.read()
            found = [(p["x"], p["z"], region_file.point(image, f["rx"], f["rz"], p["x"], p["z"])) for p in f["points"]]
            yield _batch([(f["dim"], f["kind"], x, z, payload) for x, z, payload in found if payload is not None], POINT_SCHEMA)

    return files.mapInArrow(work, "dim int, kind int, x int, z int, payload binary")


def file_digests(files: DataFrame) -> DataFrame:
    """(region, image_hash) of the files' exact bytes."""
    schema = pa.schema([*((c, pa.int32()) for c in REGION), ("image_hash", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _rows(batches):
            with open(f["path"], "rb") as file:
                digest = hashlib.file_digest(file, "sha256").hexdigest()
            yield _batch([(*(f[c] for c in REGION), digest)], schema)

    return files.mapInArrow(work, "dim int, kind int, rx int, rz int, image_hash string")


def swap_file(path: str, data: bytes) -> None:
    """Write a file's new content beside it and put it in place at once; its mode stays."""
    folder = os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(prefix=".swap-", dir=folder)
    try:
        with os.fdopen(handle, "wb") as file:
            os.fchmod(file.fileno(), os.stat(path).st_mode & 0o7777 if os.path.exists(path) else 0o644)
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise
    place = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(place)
    finally:
        os.close(place)


def write_regions(chunks: DataFrame, paths: DataFrame, stamp: int) -> DataFrame:
    """Build each region's file from its chunks and put it in place; returns (region, path, chunks written).

    A region has at most 1024 chunks, so a group is one file. A task that is run
    again writes the same file again.
    """
    schema = pa.schema([*((c, pa.int32()) for c in REGION), ("path", pa.string()), ("written", pa.int64())])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        region = [k.as_py() for k in key]
        builder = region_file.RegionBuilder(region[2], region[3], stamp)
        rows = table.select(["x", "z", "payload", "path"]).to_pylist()
        for r in rows:
            builder.stage_chunk(r["x"], r["z"], r["payload"])
        swap_file(rows[0]["path"], builder.image())
        return pa.Table.from_batches([_batch([(*region, rows[0]["path"], len(builder.staged))], schema)])

    joined = chunks.withColumns({"rx": F.shiftright("x", 5), "rz": F.shiftright("z", 5)}).join(paths, list(REGION))
    return joined.select(*REGION, "x", "z", "payload", "path").groupBy(*REGION).applyInArrow(
        build, "dim int, kind int, rx int, rz int, path string, written long"
    )


@contextmanager
def world_lock(root: str | Path, exclusive: bool) -> Iterator[None]:
    """Hold a world's lock file while the block runs; a held lock is an error at once."""
    with open(Path(root) / ".palimpsest.lock", "a") as file:
        try:
            fcntl.flock(file, (fcntl.LOCK_EX if exclusive else fcntl.LOCK_SH) | fcntl.LOCK_NB)
        except BlockingIOError:
            raise WorldError(f"{root} is in use") from None
        yield
