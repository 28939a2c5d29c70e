"""Scopes: which part of a world an operation is about.

A scope is a small tree of objects on the driver that becomes one boolean column
over chunks (``contains``) or over regions (``matches_region`` for pruning whole
files, ``covers_region`` for files that lie wholly inside). Catalyst cannot
infer bounds through the shift that gives a chunk's region, so filters over
chunks should be given with their region filter next to them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coords import LEAST_REGION, MOST_REGION, SIDE, region_high, region_low
from palimpsest.functions.names import parse_dimension, parse_kind


@dataclass(frozen=True)
class Rect:
    """An inclusive rectangle of chunks."""

    x0: int
    z0: int
    x1: int
    z1: int

    @staticmethod
    def of(xa: int, za: int, xb: int, zb: int) -> Rect:
        """From any two opposite corners."""
        return Rect(min(xa, xb), min(za, zb), max(xa, xb), max(za, zb))

    @staticmethod
    def region(rx: int, rz: int) -> Rect:
        """The chunks of a region, saturated at the 32-bit range."""
        x, z = (max(min(r, MOST_REGION), LEAST_REGION) * SIDE for r in (rx, rz))
        return Rect(x, z, x + SIDE - 1, z + SIDE - 1)

    def contains(self) -> Column:
        return F.col("x").between(self.x0, self.x1) & F.col("z").between(self.z0, self.z1)

    def overlaps_region(self) -> Column:
        x, z = F.col("rx"), F.col("rz")
        across = (region_low(x) <= self.x1) & (region_high(x) >= self.x0)
        return across & (region_low(z) <= self.z1) & (region_high(z) >= self.z0)

    def covers_region(self) -> Column:
        x, z = F.col("rx"), F.col("rz")
        across = (region_low(x) >= self.x0) & (region_high(x) <= self.x1)
        return across & (region_low(z) >= self.z0) & (region_high(z) <= self.z1)


@dataclass(frozen=True)
class Area:
    """A part of one dimension: all of it, a rectangle, or listed chunks."""

    dim: int
    rect: Rect | None = None
    chunks: frozenset[tuple[int, int]] | None = None

    def _here(self, inside: Column) -> Column:
        return (F.col("dim") == self.dim) & inside

    def _listed(self, names: tuple[str, str], places: set[tuple[int, int]]) -> Column:
        if not places:
            return F.lit(False)
        x, z = map(F.col, names)
        # both places in one number: a list of any length is one hash lookup; the bounds let files be skipped
        packed = F.shiftleft(x.cast("long"), 32).bitwiseOR(z.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        bounds = [c.between(min(p[k] for p in places), max(p[k] for p in places)) for k, c in enumerate((x, z))]
        return bounds[0] & bounds[1] & packed.isin(sorted((x << 32) | (z & 0xFFFFFFFF) for x, z in places))

    def contains(self) -> Column:
        if self.chunks is not None:
            return self._here(self._listed(("x", "z"), set(self.chunks)))
        return self._here(self.rect.contains() if self.rect else F.lit(True))

    def matches_region(self) -> Column:
        if self.chunks is not None:
            return self._here(self._listed(("rx", "rz"), {(x >> 5, z >> 5) for x, z in self.chunks}))
        return self._here(self.rect.overlaps_region() if self.rect else F.lit(True))

    def covers_region(self) -> Column:
        if self.chunks is not None:  # listed chunks never count as a whole region
            return F.lit(False)
        return self._here(self.rect.covers_region() if self.rect else F.lit(True))


def any_of(columns: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


@dataclass(frozen=True)
class Scope:
    """Kinds and areas, either of which may be left open; a chunk must meet both."""

    kinds: frozenset[int] | None = None
    areas: tuple[Area, ...] | None = None

    def _kind(self) -> Column:
        return F.lit(True) if self.kinds is None else F.col("kind").isin(sorted(self.kinds))

    def contains(self) -> Column:
        return self._kind() & (F.lit(True) if self.areas is None else any_of(a.contains() for a in self.areas))

    def matches_region(self) -> Column:
        return self._kind() & (F.lit(True) if self.areas is None else any_of(a.matches_region() for a in self.areas))

    def covers_region(self) -> Column:
        """Whether one area alone covers a region; a union of areas counts as partial."""
        return self._kind() & (F.lit(True) if self.areas is None else any_of(a.covers_region() for a in self.areas))


WORLD = Scope()


def named_scope(areas: Iterable[tuple[int, Rect]]) -> Scope:
    """All kinds of the rectangles of a named scope."""
    return Scope(areas=tuple(Area(d, r) for d, r in sorted(set(areas), key=lambda a: (a[0], a[1].x0, a[1].z0, a[1].x1, a[1].z1))))


def in_named_scopes(chunks: DataFrame, scope_areas: DataFrame) -> DataFrame:
    """Chunks in any rectangle of a table (dim, x0, z0, x1, z1): a range semi-join for long lists.

    The table is that of named scopes, which people write by hand; Spark picks
    the side to send by its size.
    """
    a, c = scope_areas.alias("a"), chunks.alias("c")
    inside = F.col("c.x").between(F.col("a.x0"), F.col("a.x1")) & F.col("c.z").between(F.col("a.z0"), F.col("a.z1"))
    return c.join(a, (F.col("c.dim") == F.col("a.dim")) & inside, "left_semi")


def _pair(text: str, whole: str) -> tuple[int, int]:
    try:
        x, z = (int(v) for v in text.split(","))
    except ValueError:
        raise ValueError(f"expected X,Z in {whole!r}") from None
    return x, z


def parse_area(text: str) -> Area:
    """``DIM``, ``DIM:X,Z`` or ``DIM:X0,Z0..X1,Z1``."""
    dim, _, rest = text.partition(":")
    code = parse_dimension(dim)
    if not rest:
        return Area(code)
    first, dots, second = rest.partition("..")
    if dots:
        return Area(code, Rect.of(*_pair(first, text), *_pair(second, text)))
    return Area(code, chunks=frozenset([_pair(rest, text)]))


def parse_region(text: str) -> Area:
    """``DIM:RX,RZ``."""
    dim, colon, rest = text.partition(":")
    if not colon:
        raise ValueError(f"expected DIM:RX,RZ, got {text!r}")
    return Area(parse_dimension(dim), Rect.region(*_pair(rest, text)))


def selection(areas: Iterable[str] = (), regions: Iterable[str] = (), kinds: Iterable[str] = (), named: Iterable[Scope] = ()) -> Scope:
    """The scope of command-line options: the union of areas, regions and named scopes, and the kinds; none is the world."""
    found = [*(parse_area(a) for a in areas), *(parse_region(r) for r in regions)]
    found += [a for s in named for a in s.areas or ()]
    own = frozenset(parse_kind(k) for k in kinds)
    return Scope(own or None, tuple(found) or None)
