"""Coordinates: chunks, the regions of 32 by 32 chunks that hold them, and places inside a region."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ("dim", "kind", "x", "z")
REGION = ("dim", "kind", "rx", "rz")
SIDE = 32
# The regions whose chunks all fit a 32-bit coordinate.
LEAST_REGION, MOST_REGION = -(1 << 26), (1 << 26) - 1


def region_of(coordinate: Column) -> Column:
    """Region of a chunk; a shift, so that negative coordinates round down."""
    return F.shiftright(coordinate, 5)


def local_of(coordinate: Column) -> Column:
    """Place of a chunk in its region, 0 to 31."""
    return coordinate.bitwiseAND(F.lit(31))


def global_of(region: Column, local: Column) -> Column:
    return region * SIDE + local


def slot_of(cx: Column, cz: Column) -> Column:
    """Place in a region file's table, z-major."""
    return cx + cz * SIDE


def slot_place(slot: Column) -> tuple[Column, Column]:
    """(cx, cz) of a table slot."""
    return slot.bitwiseAND(F.lit(31)), F.shiftright(slot, 5)


def with_region(df):
    """Add rx, rz, cx and cz to chunks."""
    return df.withColumns(
        {
            "rx": region_of(F.col("x")), "rz": region_of(F.col("z")),
            "cx": local_of(F.col("x")), "cz": local_of(F.col("z")),
        }
    )


def region_low(region: Column) -> Column:
    """First chunk coordinate of a region, saturated at the 32-bit range."""
    return F.greatest(F.least(region, F.lit(MOST_REGION)), F.lit(LEAST_REGION)) * SIDE


def region_high(region: Column) -> Column:
    return region_low(region) + (SIDE - 1)


def sectors(length: Column) -> Column:
    """4 KiB sectors of a payload with its length field; null where over 255."""
    n = F.ceil((length + 4) / 4096).cast("long")
    return F.when(n <= 255, n)
