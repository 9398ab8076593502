"""Codecs for hashes and integers, as columns.

Hex is strict: Spark's ``unhex`` takes odd lengths, so a pattern guards it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH = "^[0-9a-fA-F]{64}$"
UINT32_MAX = 4294967295


def hex_to_bytes(x: Column) -> Column:
    """Bytes of a hex string with an optional leading 0x; null for odd lengths and other characters."""
    bare = F.regexp_replace(x, "^0x", "")
    return F.when(bare.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(bare))


def bytes_to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def is_hash(x: Column) -> Column:
    """Exactly 64 hex characters, no prefix."""
    return F.coalesce(x.rlike(HASH), F.lit(False))


def normal_hash(x: Column) -> Column:
    """Lower-case 64-character hash of a query text (spaces around it and 0x are allowed); null if it is none."""
    bare = F.regexp_replace(F.trim(x), "^0x", "")
    return F.when(bare.rlike(HASH), F.lower(bare))


def uint32_to_bytes(n: Column) -> Column:
    """Four bytes, big-endian; null outside the range."""
    return F.when(n.between(0, UINT32_MAX), F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")))


def bytes_to_uint32(b: Column) -> Column:
    """0 unless there are exactly four bytes."""
    return F.when(F.octet_length(b) == 4, F.conv(F.hex(b), 16, 10).cast("long")).otherwise(0)


def uint64_to_bytes(n: Column) -> Column:
    """Eight bytes, big-endian, of a decimal(20,0) or long that is not negative."""
    exact, half = n.cast("decimal(20,0)"), F.lit(4294967296).cast("decimal(10,0)")  # a long divided by a number would become a double
    high, low = F.floor(exact / half).cast("long"), F.pmod(exact, half).cast("long")
    return F.when(n >= 0, F.unhex(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0"))))


def bytes_to_uint64(b: Column) -> Column:
    """decimal(20,0); 0 unless there are exactly eight bytes."""
    return F.when(F.octet_length(b) == 8, F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def little_endian(n: Column, width: int) -> Column:
    """``width`` (4 or 8) bytes, least significant first."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]))


def from_little_endian(b: Column) -> Column:
    digits = F.hex(b)
    flipped = lambda w: F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(w))])
    return F.when(F.octet_length(b) == 8, F.conv(flipped(8), 16, 10).cast("long")).when(F.octet_length(b) == 4, F.conv(flipped(4), 16, 10).cast("long"))


def base64_line(b: Column) -> Column:
    """Standard base64 without line breaks."""
    return F.regexp_replace(F.base64(b), "[\r\n]", "")
