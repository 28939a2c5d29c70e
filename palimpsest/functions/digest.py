"""Content digests as columns.

All digests are SHA-256 in lowercase hex. Preimages of tree nodes and commits are
built as hex text, with fixed-width big-endian integers, and turned into bytes
before they are hashed, so that the order of hex text is the order of bytes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each level of the tree, and commits, hash under a tag of their own.
ROOT_TAG = b"palimpsest-root-v1\0".hex()
DIM_TAG = b"palimpsest-dim-v1\0".hex()
REGION_TAG = b"palimpsest-region-v1\0".hex()
COMMIT_TAG = b"palimpsest-commit-v1\0".hex()
EMPTY_ROOT = hashlib.sha256(bytes.fromhex(ROOT_TAG)).hexdigest()


def content_digest(payload: Column) -> Column:
    """Digest of a payload, text as UTF-8."""
    return F.sha2(payload.cast("binary"), 256)


def tagged_digest(tag: str, body: Column) -> Column:
    """Digest of a tag and a body, both in hex."""
    return F.sha2(F.unhex(F.concat(F.lit(tag), body)), 256)


def hex_int(value: Column, digits: int = 8) -> Column:
    """Big-endian hex of an integer, two's complement."""
    wide = value.cast("long")
    if digits < 16:
        wide = wide.bitwiseAND(F.lit((1 << 4 * digits) - 1).cast("long"))
    return F.lpad(F.lower(F.hex(wide)), digits, "0")


def parse_hex(text: Column) -> Column:
    """A digest in lowercase, null unless it is 64 hex digits in either case."""
    return F.when(text.rlike("^[0-9A-Fa-f]{64}$"), F.lower(text))


def dimension_code(key: Column) -> Column:
    """Signed integer of a dimension's name: the first four digest bytes, little-endian."""
    h = content_digest(key)
    swapped = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    wide = F.conv(swapped, 16, 10).cast("long")
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide).cast("int")


def dimension_id(key: bytes) -> int:
    """``dimension_code`` for one key on the driver."""
    return int.from_bytes(hashlib.sha256(key).digest()[:4], "little", signed=True)


def commit_digest(parents: Column, created_at_ms: Column, root: Column) -> Column:
    """Id of a commit; neither the order of parents nor repeats among them matter."""
    own = F.array_sort(F.array_distinct(parents))
    body = F.concat(hex_int(F.size(own), 16), F.array_join(own, ""), hex_int(created_at_ms, 16), root)
    return tagged_digest(COMMIT_TAG, body)


def commit_id(parents: list[str], created_at_ms: int, root: str) -> str:
    """``commit_digest`` for one commit on the driver."""
    own = sorted(set(parents))
    body = f"{len(own):016x}{''.join(own)}{created_at_ms:016x}{root}"
    return hashlib.sha256(bytes.fromhex(COMMIT_TAG + body)).hexdigest()
