"""SimHash near-dedup by anchor-point covering.

The 64 bits of a fingerprint are cut into three blocks of 23, 23 and 18 bits.
Two fingerprints that differ in at most ``3 * t + 2`` bits differ in at most
``t`` bits of one block (4 bits in all: 1 bit). For each block a covering code
gives the anchors: the perfect binary Golay code [23, 12] of covering radius 3,
and the direct sum of the perfect Hamming codes [15, 11] and [3, 1], an
[18, 12] code of covering radius 2. Each fingerprint has a home anchor, within
the covering radius, in every block, and is copied to every anchor within
covering radius plus t. If x and y differ in at most t bits of a block, y has a
copy at x's home there. So each linked pair meets at an anchor, and it is
enough to compare, per anchor, those at home with all copies; all 64 bits
decide.

Equal fingerprints are one before all this. A comparison emits no pairs within
a group but a link to one partner at home for each copy, and a link wherever
two groups at home prove to be one, so links never outgrow the copies. Anchors
with many at home are split into parts of at most ``part`` of them, and copies
are streamed against these, which bounds memory.

Anchors are those of two blocks together (``joint=2``): two of the three blocks
hold at most two thirds of the bits that differ, and there are 2^24 anchors for
each pair of blocks, so that two fingerprints seldom meet without being near:
0.0024 % of all pairs, at 411 copies each. Which anchors are a home at all is
one bit each, 6 MB whatever the number of fingerprints; copies at other anchors
meet nobody and are left out before anything is shuffled. With ``joint=1``
blocks stand alone, with 26 copies and 0.64 % of all pairs. The result is the
same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import binary_text, free_prefix, materialize
from palimpsest.llm.components import connected_components

BITS = 64
SHINGLE = 4
SEED = 42
LINK = 4
TILE = 1 << 21


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        starts, ends = [0], [len(line)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths + 1) - 1
        starts = (stops - lengths)[: 1 - SHINGLE].tolist()
        ends = stops[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 14):
        some = zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)
        h = np.array([digest(line[a:b], SEED) for a, b in some], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


class CoveringCode:
    """A linear code on some bits of the fingerprint, given by the syndrome of each bit."""

    def __init__(self, shift: int, syndromes: list[int], radius: int, threshold: int):
        self.shift, self.length = shift, len(syndromes)
        size = 1 << max(s.bit_length() for s in syndromes)
        self.checks = [
            sum(1 << i for i, s in enumerate(syndromes) if s >> k & 1) for k in range(size.bit_length() - 1)
        ]
        found: list[list[int]] = [[] for _ in range(size)]
        for weight in range(radius + threshold + 1):
            for bits in combinations(range(self.length), weight):
                syndrome = 0
                for i in bits:
                    syndrome ^= syndromes[i]
                found[syndrome].append(sum(1 << i for i in bits))
        if any(not x or x[0].bit_count() > radius for x in found):
            raise ValueError("the code does not cover at this radius")
        self.counts = np.array([len(x) for x in found], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.patterns = np.array([p for x in found for p in x], np.uint64)
        #: bits of a word that are no check bits, and their number for every word where they are not the highest
        free = [i for i, s in enumerate(syndromes) if s.bit_count() > 1]
        self.bits, self.low = len(free), free[0]
        self.table = None
        if free != list(range(self.low, self.length)):
            words = np.arange(1 << self.length)
            self.table = sum((words >> i & 1) << k for k, i in enumerate(free))
        #: by how many bits a pattern goes beyond the covering radius
        self.beyond = np.maximum(np.bitwise_count(self.patterns).astype(np.int64) - radius, 0)

    def word(self, prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(self.shift)) & np.uint64((1 << self.length) - 1)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for k, check in enumerate(self.checks):
            out |= (np.bitwise_count(words & np.uint64(check)).astype(np.int64) & 1) << k
        return out

    def home(self, prints: np.ndarray) -> np.ndarray:
        """The nearest anchor of each fingerprint."""
        words = self.word(prints)
        return words ^ self.patterns[self.first[self.syndrome(words)]]

    def number(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors as numbers without gaps."""
        return anchors >> self.low if self.table is None else self.table[anchors]

    def anchors(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchors within radius plus threshold, and bits beyond the radius; the first of each row is its home."""
        words = self.word(prints)
        syndromes = self.syndrome(words)
        counts = self.counts[syndromes]
        rows = np.repeat(np.arange(len(words)), counts)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = self.first[syndromes[rows]] + inside
        return rows, words[rows] ^ self.patterns[place], self.beyond[place]


def golay_syndromes() -> list[int]:
    """Powers of x modulo the Golay code's generator x^11+x^10+x^6+x^5+x^4+x^2+1."""
    out, power = [], 1
    for _ in range(23):
        out.append(power)
        power <<= 1
        if power >> 11:
            power ^= 0b110001110101
    return out


class AnchorFamily:
    """Anchors that are made of an anchor in each of some blocks, within a threshold for all of these together."""

    def __init__(self, number: int, codes: list[CoveringCode], threshold: int):
        self.number, self.codes, self.threshold = number << 56, codes, threshold

    def home(self, prints: np.ndarray) -> np.ndarray:
        key = np.full(len(prints), self.number, np.int64)
        for k, code in enumerate(self.codes):
            key |= code.home(prints).astype(np.int64) << 23 * k
        return key

    def copies(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and keys of all anchors within reach; the first of each row is its home."""
        rows, keys = np.arange(len(prints)), np.full(len(prints), self.number, np.int64)
        beyond = np.zeros(len(prints), np.int64)
        for k, code in enumerate(self.codes):
            own, anchors, more = code.anchors(prints)
            counts = np.bincount(own, minlength=len(prints))
            starts = np.cumsum(counts) - counts
            again = np.repeat(np.arange(len(rows)), counts[rows])
            inside = np.arange(len(again)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
            place = starts[rows[again]] + inside
            held = beyond[again] + more[place]
            near = held <= self.threshold
            again, place, beyond = again[near], place[near], held[near]
            rows, keys = rows[again], keys[again] | anchors[place].astype(np.int64) << 23 * k
        return rows, keys

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each anchor among those of this family."""
        out, shift = np.zeros(len(keys), np.int64), 0
        for k, code in enumerate(self.codes):
            out |= code.number(keys >> 23 * k & ((1 << 23) - 1)) << shift
            shift += code.bits
        return out

    @property
    def size(self) -> int:
        return 1 << sum(code.bits for code in self.codes)


def anchor_families(most: int = LINK, joint: int = 2) -> list[AnchorFamily]:
    """The anchors for pairs that differ in ``most`` bits at most, of single blocks or of any two."""
    hamming = [i + 1 for i in range(15)] + [i << 4 for i in (1, 2, 3)]
    t = most * joint // 3
    codes = [
        CoveringCode(0, golay_syndromes(), 3, t),
        CoveringCode(23, golay_syndromes(), 3, t),
        CoveringCode(46, hamming, 2, t),
    ]
    return [AnchorFamily(k, list(some), t) for k, some in enumerate(combinations(codes, joint))]


class AnchorGroup:
    """Those at home at one anchor, and the links found there so far."""

    def __init__(self, most: int):
        self.most = most
        self.home = np.zeros(0, np.uint64)
        self.label = np.zeros(0, np.int64)

    def add(self, prints: np.ndarray, at_home: np.ndarray) -> list[tuple[int, int]]:
        """Compare further copies, those at home among them first; returns links."""
        n = len(self.home)
        self.home = np.concatenate([self.home, prints[at_home]])
        self.label = np.concatenate([self.label, np.arange(n, len(self.home))])
        links: list[tuple[int, int]] = []
        if not len(self.home):
            return links
        step = max(1, TILE // len(self.home))
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            apart = np.bitwise_count(some[:, None] ^ self.home[None, :])
            near = (apart <= self.most) & (apart > 0)
            for row in np.flatnonzero(near.any(axis=1)):
                partners = np.flatnonzero(near[row])
                links.append((int(some[row]), int(self.home[partners[0]])))
                labels = self.label[partners]
                if (labels != labels[0]).any():
                    for k in np.unique(labels, return_index=True)[1]:
                        if labels[k] != labels[0]:
                            links.append((int(self.home[partners[k]]), int(self.home[partners[0]])))
                    self.label[np.isin(self.label, labels)] = labels.min()
        return links


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and fingerprint (as a signed long) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), binary_text(F.col(text_col)).alias("text")).mapInArrow(
        work, f"doc_id {id_type}, print long"
    )


SEGMENT = 1 << 15  # anchors in a row of the bitmap
IN_A_TASK, AT_ONCE = 20_000, 256  # fingerprints, with 411 copies each


def home_anchors(prints: DataFrame, families: list[AnchorFamily]) -> list[np.ndarray]:
    """For each family one bit for each anchor, set if it is the home of a fingerprint."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate([np.zeros(0, np.int64), *(batch.column("print").to_numpy() for batch in batches)]).view(np.uint64)
        for number, f in enumerate(families):  # one after the other, as each has a byte for every anchor
            own = np.zeros(f.size, bool)
            own[f.places(f.home(values))] = True
            rows = own.reshape(-1, min(SEGMENT, len(own)))
            at = np.flatnonzero(rows.any(axis=1))
            packed = [np.packbits(rows[i]).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), number, np.int32)), pa.array(at.astype(np.int32)), pa.array(packed, pa.binary())], names=["family", "segment", "bits"]
            )

    def join(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(0, np.uint8)
        for bits in table.column("bits"):
            own = np.frombuffer(bits.as_py(), np.uint8)
            total = own if not len(total) else total | own
        return pa.table([[key[0].as_py()], [key[1].as_py()], [total.tobytes()]], schema=schema)

    schema = pa.schema([("family", pa.int32()), ("segment", pa.int32()), ("bits", pa.binary())])
    found = prints.mapInArrow(segments, "family int, segment int, bits binary")
    found = found.groupBy("family", "segment").applyInArrow(join, "family int, segment int, bits binary")
    out = [np.zeros(f.size // 8, np.uint8) for f in families]
    for r in found.collect():  # at most one for each segment of the anchors
        own = np.frombuffer(r["bits"], np.uint8)
        out[r["family"]][r["segment"] * len(own) : (r["segment"] + 1) * len(own)] = own
    return out


def fingerprint_links(prints: DataFrame, most: int = LINK, part: int = 1 << 16, joint: int = 2) -> DataFrame:
    """Links (a, b) that join all fingerprints of the column ``print`` with at most ``most`` bits between them.

    ``prints`` has different fingerprints. The links give the components of the
    graph of all such pairs without holding all pairs.
    """
    families = anchor_families(most, joint)
    # making copies is most of the work, so every task gets a like share of it
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // IN_A_TASK))
    prints = materialize(prints.select("print").repartition(tasks))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("print").to_numpy().view(np.uint64)
            keys = np.concatenate([f.home(values) for f in families])
            yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["anchor"])

    crowded = prints.mapInArrow(homes, "anchor long").groupBy("anchor").count().where(F.col("count") > part)
    # of anchors with more than ``part`` at home, so of few
    parts = {r["anchor"]: -(-r["count"] // part) for r in crowded.collect()}
    known = home_anchors(prints, families)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                values = batch.column("print").slice(at, AT_ONCE).to_numpy().view(np.uint64)
                for family, bits in zip(families, known, strict=True):
                    rows, keys = family.copies(values)
                    home = np.diff(rows, prepend=-1) > 0
                    place = family.places(keys)
                    met = bits[place >> 3] >> (7 - (place & 7)) & 1 > 0
                    rows, keys, home = rows[met], keys[met], home[met]
                    own = values[rows]
                    numbers = np.zeros(len(rows), np.int32)
                    if parts:
                        many = np.array([parts.get(x, 1) for x in keys.tolist()], np.int64)
                        mine = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % many
                        again = np.repeat(np.arange(len(rows)), many)
                        numbers = (np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
                        keys, own, home = keys[again], own[again], home[again] & (numbers == mine[again])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(numbers), pa.array(home), pa.array(own.view(np.int64))],
                        names=["anchor", "part", "home", "print"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "part", "home", "print")
        held = [np.zeros(0, t) for t in (np.int64, np.int32, bool, np.int64)]  # the group that may go on in the next batch
        last, group = None, AnchorGroup(most)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names, strict=True)]
            anchor, number, home, own = held
            if not len(anchor):
                continue
            values = own.view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(anchor) != 0) | (np.diff(number) != 0)) + 1, [len(anchor)]])
            if batch is not None and len(cuts) > 1 and len(anchor) - cuts[-2] < HELD:
                held = [h[cuts[-2] :] for h in held]
                cuts = cuts[:-1]
            else:
                held = [h[:0] for h in held]
            starts, sizes = cuts[:-1], np.diff(cuts)
            if not len(starts):
                continue
            at_home = np.add.reduceat(home, starts, dtype=np.int64)
            large = at_home > FEW
            # a group that goes on, or that began in an earlier batch
            large[0] |= (anchor[0], number[0]) == last
            large[-1] |= sizes[-1] >= HELD
            found = [few_links(values, starts[~large], sizes[~large], at_home[~large], most)]
            for a, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
                if (key := (anchor[a], number[a])) != last:
                    last, group = key, AnchorGroup(most)
                found.append(np.array(group.add(values[a : a + n], home[a : a + n]), np.uint64).reshape(-1, 2))
            ends = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    return (
        prints.mapInArrow(copies, "anchor long, part int, home boolean, print long")
        .repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part", F.col("home").desc())
        .mapInArrow(compare, "a long, b long")
    )


FEW, HELD = 8, 1 << 15  # at home at an anchor for which all are compared at once; rows of a group that wait for the next batch


def few_links(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at_home: np.ndarray, most: int) -> np.ndarray:
    """Links between those at home, at most ``FEW`` and first in each group, and all of their group."""
    out = [np.zeros((0, 2), np.uint64)]
    for k in range(FEW):
        some = (at_home > k) & (sizes > k + 1)
        first, n = starts[some], sizes[some] - k - 1  # each one at home with those behind it
        left = np.repeat(first + k, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first + k + 1, n)
        a, b = values[left], values[right]
        apart = np.bitwise_count(a ^ b)
        near = (apart <= most) & (apart > 0)
        out.append(np.stack([a[near], b[near]], axis=1))
    return np.concatenate(out)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LINK, joint: int = 2
) -> DataFrame:
    """Return id, ``fingerprint`` (16 hex digits) and ``component_id`` for every row.

    ``component_id`` is the smallest id that is reachable by links, the row's own
    included. Null and empty texts have fingerprint zero and link like any
    other; repeated rows stay; a null id is never smallest, and the component
    of null ids only is null; an empty table gives an empty result. Other
    columns are not read.
    """
    own = materialize(fingerprints(docs, id_col, text_col))
    first = materialize(own.groupBy("print").agg(F.min("doc_id").alias("_rep")))
    labels = connected_components(fingerprint_links(first.select("print"), most, joint=joint), "a", "b")
    labels = materialize(labels.join(first, labels["node"] == first["print"]).select("node", "root", "_rep"))
    lowest = labels.groupBy("root").agg(F.min("_rep").alias("_low"))
    linked = labels.join(lowest, "root").select(F.col("node").alias("print"), "_low")
    component = first.join(linked, "print", "left").select("print", F.coalesce("_low", "_rep").alias("component_id"))
    # materialised, so that both sides of the last join are dealt out for it and a print with many rows can be split
    component = materialize(component)
    return own.join(component, "print").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LINK) -> DataFrame:
    """The rows, with all their columns, that are the smallest of their group by id and a hash of the text.

    Of rows that repeat an id and a text one stays; rows that share an id but have
    texts in different groups do not stand for one another. A row without an id
    cannot be told from another and stays.
    """
    columns, own = docs.columns, free_prefix(docs.columns, "_own_")
    kept, hashed, row = f"{own}kept", f"{own}hash", f"{own}row"
    text_hash = F.xxhash64(binary_text(F.col(text_col)))
    key = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), text_hash.alias("hash")))
    groups = simhash_groups(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", most)
    least = groups.where(F.col("key") == F.col("component_id")).select(F.col("key.id").alias(kept), F.col("key.hash").alias(f"{kept}_hash")).distinct()
    # rows without an id are spread by their place, so that they do not meet
    spread = docs.withColumn(hashed, text_hash).withColumn(row, F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
    return (
        spread.join(least, (F.col(id_col) == F.col(kept)) & (F.col(hashed) == F.col(f"{kept}_hash")), "left")
        .where(F.col(kept).isNotNull() | F.col(id_col).isNull())
        .withColumn(f"{row}_place", F.row_number().over(Window.partitionBy(id_col, hashed, row).orderBy(id_col)))
        .where(F.col(f"{row}_place") == 1)
        .select(*columns)
    )
