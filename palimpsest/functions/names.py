"""Names of refs and scopes, names of dimensions and kinds, and times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.digest import dimension_id

MOST_NAME = 255
PATTERN = r"^(?!.*//)(?!/)(?!.*/$)(?!(.*/)?\.{1,2}(/|$))[A-Za-z0-9._/-]+$"
# Dimensions and kinds with names of their own.
OVERWORLD, NETHER, END = (dimension_id(k) for k in (b"minecraft:overworld", b"minecraft:the_nether", b"minecraft:the_end"))
DIMENSIONS = {
    "ow": OVERWORLD, "overworld": OVERWORLD, "0": OVERWORLD,
    "ne": NETHER, "nether": NETHER, "the_nether": NETHER, "dim-1": NETHER, "1": NETHER,
    "end": END, "the_end": END, "dim1": END, "2": END,
}
DIMENSION_NAMES = {OVERWORLD: "overworld", NETHER: "nether", END: "end"}
KINDS = {"region": 0, "entities": 1, "poi": 2}


class BadName(ValueError):
    """A name that the grammar does not allow."""


def check_name(raw: str) -> str:
    """A path-like ASCII name, or an error that says why not."""
    if not raw:
        raise BadName("a name is empty")
    if len(raw.encode()) > MOST_NAME:
        raise BadName(f"a name is longer than {MOST_NAME} bytes")
    if bad := re.search(r"[^A-Za-z0-9._/-]", raw):
        raise BadName(f"a name holds {bad[0]!r}")
    if "" in raw.split("/"):
        raise BadName("a name has an empty component")
    if {".", ".."} & set(raw.split("/")):
        raise BadName("a name has a '.' or '..' component")
    return raw


def check_ref_name(raw: str) -> str:
    """A name that is neither all digits nor HEAD, which stand for commits."""
    check_name(raw)
    if raw.isdigit() or raw.lower() == "head":
        raise BadName(f"{raw!r} is reserved")
    return raw


def is_name(name: Column) -> Column:
    return F.coalesce((F.octet_length(name) <= MOST_NAME) & name.rlike(PATTERN), F.lit(False))


def is_ref_name(name: Column) -> Column:
    return is_name(name) & ~name.rlike("^[0-9]+$") & (F.lower(name) != "head")


def parse_dimension(raw: str) -> int:
    known = DIMENSIONS.get(raw.lower())
    if known is not None:
        return known
    value = int(raw) if re.fullmatch(r"[+-]?\d+", raw) else 1 << 40
    if not -(1 << 31) <= value < 1 << 31:
        raise ValueError(f"{raw!r} is no dimension")
    return value


def show_dimension(dim: int) -> str:
    return DIMENSION_NAMES.get(dim, str(dim))


def parse_kind(raw: str) -> int:
    if raw.lower() not in KINDS:
        raise ValueError(f"{raw!r} is no kind")
    return KINDS[raw.lower()]


def show_kind(kind: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown kind "), kind.cast("string")))
    for name, code in KINDS.items():
        out = F.when(kind == code, F.lit(name)).otherwise(out)
    return out


def show_time(ms: Column) -> Column:
    """RFC 3339 in UTC to the millisecond, or ``<n>ms`` beyond year 9999."""
    shown = F.date_format(F.timestamp_millis(F.least(ms, F.lit(253402300799999))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(ms <= 253402300799999, shown).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def checkout_stamp(ms: Column) -> Column:
    """Seconds for a region file's timestamps, saturated at 32 bits."""
    return F.least(F.floor(ms / 1000), F.lit((1 << 32) - 1)).cast("long")
