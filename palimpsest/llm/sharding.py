"""Sharding by a minimax contiguous partition.

Equal texts are one atomic group, known by the 64-bit hash of the text, and the
groups are ordered by that hash. Binary search finds the smallest capacity for
which a greedy pass, filling one shard after the other, needs no more shards
than there are; the cuts of that pass are the shards' borders in hash order. A
group larger than the fair share of what is left is ordered first and has a
shard of its own, as it would set the capacity of all others.

The groups themselves never come to the driver. It holds sums over hash ranges:
ranges that hold several groups give a lower and an upper bound of every cut,
and only ranges in which a cut may lie are split further, about ``CELLS`` sums
at a time, until each cut is known exactly. A row then finds its shard by
comparing its hash with the cuts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm._common import binary_text, materialize, numbered

CELLS = 1 << 14


class Ranges:
    """Sums of sizes over consecutive hash ranges; a range is whole if it holds one group."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, largest: int):
        order = np.argsort(low, kind="stable")
        self.low, self.high, self.size = low[order], high[order], size[order]
        self.whole = self.low == self.high
        self.before = np.concatenate([[0], np.cumsum(self.size)])
        self.total = int(self.before[-1])
        self.largest = largest

    def cuts(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """Bounds of the greedy cuts: where each shard ends at the latest, or at the earliest."""
        at, out = 0, []
        for _ in range(shards):
            goal = at + capacity
            if goal >= self.total:
                out.append(self.total)
                break
            k = int(np.searchsorted(self.before, goal, "right")) - 1
            end = int(self.before[k])
            if not self.whole[k] and end < goal:
                end = goal if upper else max(end, goal - self.largest + 1)
            if end <= at:
                break
            at = end
            out.append(at)
        return out

    def smallest(self, shards: int, upper: bool) -> int:
        """The smallest capacity that the bounds call enough."""
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, upper)[-1:] == [self.total]:
                high = middle
            else:
                low = middle + 1
        return low

    def open_ranges(self, shards: int) -> np.ndarray:
        """Places of ranges of several groups in which a cut may lie."""
        least, most = self.smallest(shards, True), self.smallest(shards, False)
        first, last = self.cuts(least, shards, False), self.cuts(most, shards, True)
        first += [first[-1] if first else 0] * (len(last) - len(first))
        found = np.zeros(len(self.size), bool)
        for a, b in zip(first, last, strict=False):
            i = int(np.searchsorted(self.before, a, "right")) - 1
            j = int(np.searchsorted(self.before, b, "left"))
            found[max(i, 0) : j] = True
        return np.flatnonzero(found & ~self.whole)


def _sums(groups: DataFrame, bits: int, inside: list[int] | None, depth: int) -> list:
    """Sums over the hash ranges of ``bits`` leading bits, of all rows or inside ranges of ``depth`` bits."""
    if inside is not None:
        schema = T.StructType([T.StructField("_range", T.LongType())])
        wanted = groups.sparkSession.createDataFrame([(int(x),) for x in inside], schema)
        groups = groups.join(F.broadcast(wanted), F.shiftright("h", 64 - depth) == F.col("_range"), "left_semi")
    cell = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
    return (
        groups.groupBy(cell.alias("c"))
        .agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("size").alias("size"))
        .collect()  # at most CELLS ranges, or 2 for each one that is split
    )


def find_cuts(sizes: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Hashes of the groups with a shard of their own, and the first hash of each further shard but the first."""
    groups = sizes.groupBy("h").agg(F.sum("size").alias("size"))
    top = groups.orderBy(F.col("size").desc(), "h").limit(shards).collect()
    left = int(sizes.agg(F.sum("size")).first()[0] or 0)
    alone: list[int] = []
    for row in top:
        if shards - len(alone) < 2 or row["size"] * (shards - len(alone)) <= left:
            break
        alone.append(row["h"])
        left -= row["size"]
    if len(top) == len(alone):
        return alone, []
    rest, shards, largest = sizes.where(~F.col("h").isin(alone)), shards - len(alone), top[len(alone)]["size"]
    depth = CELLS.bit_length() - 1
    rows = _sums(rest, depth, None, 0)
    while True:
        low, high, size = (np.array([r[k] for r in rows], np.int64) for k in ("low", "high", "size"))
        ranges = Ranges(low, high, size, largest)
        split = ranges.open_ranges(shards)
        if not len(split):
            break
        cells = sorted({int(x) >> (64 - depth) for x in ranges.low[split]})
        taken = set(cells)
        more = max(1, (CELLS // len(cells)).bit_length() - 1)
        # a range that no cut can lie in any more is never split, so those to be split have the same depth
        rows = [r for r in rows if r["low"] == r["high"] or r["low"] >> (64 - depth) not in taken]
        rows += _sums(rest, min(64, depth + more), cells, depth)
        depth = min(64, depth + more)
    capacity = ranges.smallest(shards, True)
    ends = ranges.cuts(capacity, shards, True)
    return alone, [int(ranges.low[np.searchsorted(ranges.before, end)]) for end in ends[:-1] if end < ranges.total]


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, size, CRC-32 of the text, law, shard, slot and (null) grown_shard for every row.

    A size is the text's UTF-8 bytes plus 16. A null text has no bytes and is
    grouped with empty ones; repeated rows have slots of their own, and null ids
    are dealt like any other; an empty table gives an empty result. Other
    columns are not read. Fewer groups than shards leave shards empty.
    """
    text = binary_text(F.col(text_col))
    own = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    alone, cuts = find_cuts(own.select("h", "size"), shards)
    shard = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (F.col("h") >= F.lit(cut)).cast("int")
    for place, h in enumerate(alone):
        shard = F.when(F.col("h") == F.lit(h), F.lit(place)).otherwise(shard)
    placed = own.withColumn("shard", shard.cast("int"))
    return numbered(placed, "shard", F.struct(F.coalesce("doc_id", F.lit(-1)), "h"), "slot").select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
