"""Embedding near-dedup by sorted projection passes.

Each pass draws its own random hyperplanes, writes a vector's signs as one
64-bit key, sorts all vectors by it and compares each with the ``window``
vectors before it in that order; the last rows of each partition are compared
once more with the first of the next, so that no window ends at a border. The
number of passes grows with the number of different vectors. Pairs whose
cosine reaches the threshold are links; the links of all passes together give
the components. A pass emits, for
each vector, a link to one partner and a link for each two groups that prove to
be one, and so at most two rows for each vector, never the pairs of a group.

Vectors that are equal are one before the passes, with their number. After the
passes, the links inside each component are counted exactly, as windows hold a
bounded number of neighbours and a group may be larger. With the angle of each
vector to the component's mean, two vectors whose angles add up to no more than
the threshold's are linked without a product; a vector that is so linked to
all the others is counted at once. In a group of near copies that is
all of them. Only the others, far from the mean, are
multiplied with one another, in blocks of at most ``block`` vectors and each
pair of blocks in a task of its own that returns counts. What the windows may
miss are thus only links between vectors that no chain of found links joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import materialize
from palimpsest.llm.components import connected_components

KEY_BITS = 64
LEAST_PASSES, PASSES_UP_TO = 16, 100_000
MOST_SUMS = 50_000  # components whose sums a task holds before it hands them on


def passes_for(vectors: int) -> int:
    """So many passes that a pair at the threshold stays as likely to be found, as its chance in one pass falls with the fourth root."""
    return max(LEAST_PASSES, int(np.ceil(LEAST_PASSES * (vectors / PASSES_UP_TO) ** 0.25)))


def unit_vectors(column: pa.Array, size: int) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as unit vectors in double precision."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Borders of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    if not n:
        return []
    changed = np.zeros(n - 1, bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class WindowForest:
    """Links found along a sorted stream of vectors, one component counted once."""

    def __init__(self, window: int, least: float, size: int):
        self.window, self.least = window, least
        self.vectors, self.nodes, self.labels = np.zeros((0, size)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.count = 0

    def add(self, vectors: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
        links: list[tuple[int, int]] = []
        for at in range(0, len(nodes), 256):
            old = len(self.nodes)
            v = np.concatenate([self.vectors, vectors[at : at + 256]])
            n = np.concatenate([self.nodes, nodes[at : at + 256]])
            new = len(n) - old
            label = np.concatenate([self.labels, np.arange(self.count, self.count + new)])
            self.count += new
            near = v[old:] @ v.T >= self.least
            place = np.arange(len(n))
            behind = (place[None, :] < place[old:, None]) & (place[None, :] >= place[old:, None] - self.window)
            near &= behind
            for i in np.flatnonzero(near.any(axis=1)):
                partners = np.flatnonzero(near[i])
                for k in np.unique(label[partners], return_index=True)[1]:
                    links.append((int(n[old + i]), int(n[partners[k]])))
                known = np.unique(np.append(label[partners], label[old + i]))
                label[np.isin(label, known)] = known[0]
            keep = max(0, len(n) - self.window)
            self.vectors, self.nodes, self.labels = v[keep:], n[keep:], label[keep:]
        return links


def sorted_passes(vectors: DataFrame, numbers: range, seed: int, window: int, least: float) -> DataFrame:
    """Links (a, b) of some passes, sorted in one shuffle, over (node, size, embedding)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            size = batch.column("size").to_numpy()
            key = np.zeros((len(numbers), batch.num_rows), np.int64)
            for n in map(int, np.unique(size)):
                at = np.flatnonzero(size == n)
                units = unit_vectors(batch.column("embedding").take(pa.array(at)), n)
                for k, number in enumerate(numbers):
                    if (number, n) not in planes:
                        planes[number, n] = np.random.default_rng([seed, number, n]).standard_normal((n, KEY_BITS))
                    key[k, at] = np.packbits(units @ planes[number, n] > 0, axis=1).view(">i8")[:, 0]
            for k, number in enumerate(numbers):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(batch.num_rows, number, np.int32)),
                        batch.column("size"),
                        pa.array(key[k]),
                        batch.column("node"),
                        batch.column("embedding"),
                    ],
                    names=["pass", "size", "key", "node", "embedding"],
                )

    names = ["pass", "size", "key", "node", "embedding"]
    ends = ["place", "rows", "last"]  # of rows at borders: the partition, its number of rows up to the window, and at which end
    kind = vectors.schema["embedding"].dataType.simpleString()
    columns = f"pass int, size int, key long, node long, embedding {kind}"

    def links_of(batches: Iterator[pa.RecordBatch], groups: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Each batch with the links found by its rows; windows end where a group does."""
        last, forest = None, None
        for batch in batches:
            links: list[tuple[int, int]] = []
            own = [batch.column(c).to_numpy() for c in groups]
            size, node = batch.column("size").to_numpy(), batch.column("node").to_numpy()
            for a, b in runs(*own):
                if (group := tuple(c[a] for c in own)) != last:
                    last, forest = group, WindowForest(window, least, int(size[a]))
                links += forest.add(unit_vectors(batch.column("embedding").slice(a, b - a), int(size[a])), node[a:b])
            yield batch, np.array(links, np.int64).reshape(-1, 2)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = None  # the first and the last rows of the partition
        for batch, links in links_of(batches, ["pass", "size"]):
            rows = pa.Table.from_batches([batch])
            head = rows.slice(0, window) if head is None else pa.concat_tables([head, rows.slice(0, window - len(head))])
            tail = rows if tail is None else pa.concat_tables([tail, rows])
            tail = tail.slice(max(0, len(tail) - window)).combine_chunks()
            empty = [pa.nulls(len(links), batch.schema.field(c).type) for c in names]
            none = [pa.nulls(len(links), pa.int32())] * len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy()), *empty, *none], names=["a", "b", *names, *ends])
        place = TaskContext.get().partitionId()
        for end, rows in enumerate((head, tail)):
            # a partition within one window has the same rows at both ends
            for batch in rows.combine_chunks().to_batches() if rows is not None and (not end or len(head) == window) else ():
                none = pa.nulls(batch.num_rows, pa.int64())
                told = [pa.array(np.full(batch.num_rows, x, np.int32)) for x in (place, len(head), end)]
                yield pa.RecordBatch.from_arrays([none, none, *(batch.column(c) for c in names), *told], names=["a", "b", *names, *ends])

    def compare_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, links in links_of(batches, ["border", "pass", "size"]):
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])

    found = materialize(
        vectors.select("node", "size", "embedding")
        .mapInArrow(keys, columns)
        .repartitionByRange("pass", "size", "key", "node")
        .sortWithinPartitions("pass", "size", "key", "node")
        .mapInArrow(compare, f"a long, b long, {columns}, place int, rows int, last int")
    )
    at_ends = found.where(F.col("a").isNull())
    # the last rows of a partition meet the first of the next one; partitions within one window do not end a border
    full = at_ends.groupBy("place").agg(F.max((F.col("rows") == window).cast("long")).alias("_full"))  # one row for each partition
    before = F.coalesce(F.sum("_full").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = full.select(F.col("place").alias("_place"), before.alias("_before"))
    across = (
        at_ends.join(borders, F.col("place") == F.col("_place"))
        .withColumn("border", F.col("_before") + F.col("last"))
        .select("border", *names)
        .repartition("border", "pass", "size")
        .sortWithinPartitions("border", "pass", "size", "key", "node")
        .mapInArrow(compare_across, "a long, b long")
    )
    return found.where(F.col("a").isNotNull()).select("a", "b").unionByName(across)


def mean_directions(members: DataFrame) -> DataFrame:
    """(root, mean): the sum of the unit vectors of each component, over (root, size, embedding)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["root", "mean"])

        for batch in batches:
            root, size = batch.column("root").to_numpy(), batch.column("size").to_numpy()
            for n in map(int, np.unique(size)):
                at = np.flatnonzero(size == n)
                at = at[np.argsort(root[at], kind="stable")]
                units = unit_vectors(batch.column("embedding").take(pa.array(at)), n)
                roots, starts = np.unique(root[at], return_index=True)
                for r, total in zip(roots.tolist(), np.add.reduceat(units, starts, axis=0), strict=True):
                    held[r] = held[r] + total if r in held else total
            if len(held) > MOST_SUMS:
                yield hand_on()
                held.clear()
        if held:
            yield hand_on()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum(np.stack(table.column("mean").to_pylist()), axis=0)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["root", "mean"])

    found = members.select("root", "size", "embedding").mapInArrow(sums, "root long, mean array<double>")
    # the sums of one component from all partitions meet in two rounds
    for parts in (256, 1):
        part = F.pmod(F.xxhash64("mean"), F.lit(parts)).alias("_part")
        found = found.groupBy("root", part).applyInArrow(add, "root long, mean array<double>")
    return found


def angles(members: DataFrame) -> DataFrame:
    """Add ``angle`` to the mean direction, over (root, node, size, copies, embedding)."""
    columns = ["root", "node", "size", "copies", "embedding"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            out = np.zeros(batch.num_rows)
            for n in map(int, np.unique(size)):
                at = np.flatnonzero(size == n)
                units = unit_vectors(batch.column("embedding").take(pa.array(at)), n)
                mean = batch.column("mean").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                length = np.linalg.norm(mean, axis=1)
                cosine = np.einsum("ij,ij->i", units, mean) / np.where(length > 0, length, 1)
                out[at] = np.arccos(np.clip(cosine, -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out)], names=[*columns, "angle"])

    joined = members.select(*columns).join(mean_directions(members).withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"))
    kind = members.schema["embedding"].dataType.simpleString()
    return joined.select(*columns, "mean").mapInArrow(work, f"root long, node long, size int, copies long, embedding {kind}, angle double")


def count_links(members: DataFrame, least: float, block: int) -> DataFrame:
    """(node, links to rows of other nodes) from (root, node, size, copies, embedding), which is materialised."""
    held = materialize(angles(members))
    most = float(np.arccos(least)) - 1e-6  # less than what rounding can turn
    wide = held.groupBy("root").agg(F.max("angle").alias("_wide"), F.sum("copies").alias("_rows"))
    wide = wide.withColumnRenamed("root", "_root")
    judged = held.join(wide, F.col("root") == F.col("_root")).withColumn("_near", F.col("angle") + F.col("_wide") <= most)
    judged = materialize(judged.drop("_root", "_wide", "angle"))
    near = judged.where("_near").select("node", (F.col("_rows") - F.col("copies")).alias("links"))
    far = judged.where("not _near")
    # a far vector is linked to all near ones, and to the far ones that its products show
    inner = judged.where("_near").groupBy("root").agg(F.sum("copies").alias("_inner")).withColumnRenamed("root", "_root")
    sure = far.join(inner, F.col("root") == F.col("_root")).select("node", F.col("_inner").alias("links"))
    return near.unionByName(sure).unionByName(count_products(far, least, block)).groupBy("node").agg(F.sum("links").alias("links"))


def count_products(members: DataFrame, least: float, block: int) -> DataFrame:
    """(node, links to rows of other nodes) from (root, node, size, copies, embedding), by products of blocks."""
    blocks = members.groupBy("root").agg(F.count("*").alias("_members")).select(
        F.col("root").alias("_root"), F.ceil(F.col("_members") / block).cast("int").alias("_blocks")
    )
    dealt = members.join(blocks, F.col("root") == F.col("_root")).withColumn(
        "_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    )
    other = F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_other")
    # role 0: the vectors that a task holds; role 1: those that it runs past them
    held = dealt.select("root", F.col("_own").alias("_held"), other, F.lit(0).alias("_role"), "node", "size", "copies", "embedding")
    held = held.withColumnRenamed("_other", "_past")
    past = dealt.select("root", other, F.col("_own").alias("_past"), F.lit(1).alias("_role"), "node", "size", "copies", "embedding")
    past = past.withColumnRenamed("_other", "_held")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        nodes, copies, vectors = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0))
        for batch in batches:
            root, h, p, role, size = (batch.column(c).to_numpy() for c in ("root", "_held", "_past", "_role", "size"))
            node, weight = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            out_nodes, out_counts = [], []
            for a, b in runs(root, h, p, role):
                v = unit_vectors(batch.column("embedding").slice(a, b - a), int(size[a]))
                if (key := (root[a], h[a], p[a])) != last:
                    last, nodes, copies, vectors = key, node[:0], weight[:0], v[:0]
                if role[a] == 0:
                    nodes, copies = np.concatenate([nodes, node[a:b]]), np.concatenate([copies, weight[a:b]])
                    vectors = np.concatenate([vectors, v])
                else:
                    near = (v @ vectors.T >= least) & (node[a:b, None] != nodes[None, :])
                    out_nodes.append(node[a:b])
                    out_counts.append(near @ copies)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.int64), *out_nodes])),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *out_counts]).astype(np.int64)),
                ],
                names=["node", "links"],
            )

    return (
        held.select("root", "_held", "_past", "_role", "node", "size", "copies", "embedding")
        .unionByName(past)
        .repartition("root", "_held", "_past")
        .sortWithinPartitions("root", "_held", "_past", "_role")
        .mapInArrow(multiply, "node long, links long")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )


def embedding_groups(
    table: DataFrame,
    least: float = 0.9,
    passes: int | None = None,
    window: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 20,
    block: int = 512,
    together: int = 4,
) -> DataFrame:
    """Return id, ``n_links``, ``component_id`` (smallest id reachable) and ``kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and neither do vectors of different lengths. Repeated
    rows link with each other; a null id is never smallest, and it is not kept;
    an empty table gives an empty result. Other columns are not read. ``passes``
    follows the number of different vectors unless it is given. So many
    passes share a shuffle as ``together`` says; its disk is that many vectors
    for each row.
    """
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_v"))
    bad = "x is null or isnan(x) or abs(x) = double('infinity')"
    usable = F.expr(f"coalesce(size(_v) > 0 and not exists(_v, x -> coalesce({bad}, true)) and exists(_v, x -> x <> 0), false)")
    unique = (
        rows.where(usable)
        .groupBy("_v")
        .agg(F.min("vec_id").alias("_low"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
        .select("node", "_low", "copies", F.size("_v").alias("size"), F.col("_v").alias("embedding"))
    )
    unique = materialize(unique)
    if passes is None:
        passes = passes_for(unique.count())
    links = None
    for first in range(0, passes, together):
        numbers = range(first, min(passes, first + together))
        found = materialize(sorted_passes(unique, numbers, seed, window, least))
        links = found if links is None else links.unionByName(found)
    labels = materialize(connected_components(links, "a", "b"))
    members = materialize(unique.join(labels, "node"))
    lowest = members.groupBy("root").agg(F.min("_low").alias("_least"))
    counted = members.select("node", "root", "_low").join(lowest, "root").join(
        count_links(members.select("root", "node", "size", "copies", "embedding"), least, block), "node", "left"
    )
    known = (
        unique.select("node", "embedding", "copies", "_low")
        .join(counted.select("node", "_least", "links"), "node", "left")
        .select(
            F.col("embedding").alias("_e"),
            F.xxhash64("embedding").alias("_h"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_n"),
            F.coalesce("_least", "_low").alias("_component"),
        )
    )
    # the hash comes first, so that sorting seldom compares vectors
    same = (F.when(usable, F.xxhash64("_v")) == F.col("_h")) & (F.when(usable, F.col("_v")) == F.col("_e"))
    return rows.join(known, same, "left").select(
        F.col("vec_id").alias(id_col),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_component", "vec_id"), F.lit(False)).alias("kept"),
    )
