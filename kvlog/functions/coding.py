"""Byte codings of keys and values, as plain expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _turned(digits: Column, n: int) -> Column:
    """2 n hex digits with the bytes in opposite order."""
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])


def _unsigned(x: Column, n: int) -> Column:
    return F.lpad(F.hex(x), 16, "0") if n == 8 else F.substring(F.lpad(F.hex(x), 16, "0"), 17 - 2 * n, 2 * n)


def to_fixed64(x: Column) -> Column:
    """8 bytes, the lowest first."""
    return F.unhex(_turned(_unsigned(x, 8), 8))


def fixed64(b: Column) -> Column:
    """The first 8 bytes as a 64-bit integer; null where there are fewer."""
    return F.when(F.octet_length(b) >= 8, F.conv(_turned(F.hex(F.substring(b, 1, 8)), 8), 16, -10).cast("long"))


def to_fixed32(x: Column) -> Column:
    return F.unhex(_turned(_unsigned(x, 4), 4))


def fixed32(b: Column) -> Column:
    """The first 4 bytes as an unsigned integer; null where there are fewer."""
    return F.when(F.octet_length(b) >= 4, F.conv(_turned(F.hex(F.substring(b, 1, 4)), 4), 16, 10).cast("long"))


def to_varint(x: Column) -> Column:
    """Seven bits a byte, the lowest first, the high bit set on all but the last; negative numbers take ten bytes."""
    digits = [F.when((F.shiftrightunsigned(x, 7 * i) != 0) if i else F.lit(True), F.lpad(F.hex(F.shiftrightunsigned(x, 7 * i).bitwiseAND(127).bitwiseOR(F.when(F.shiftrightunsigned(x, 7 * i + 7) != 0, 128).otherwise(0) if i < 9 else F.lit(0))), 2, "0")).otherwise("") for i in range(10)]
    return F.unhex(F.concat(*digits))


def _byte(b: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("long")


def varint_length(b: Column) -> Column:
    """Bytes of the varint that b begins with; null where it doesn't end."""
    ends = F.filter(F.sequence(F.lit(1), F.least(F.octet_length(b), F.lit(10))), lambda i: _byte(b, i) < 128)
    return F.when(F.octet_length(b) > 0, F.get(ends, F.lit(0)))


def varint(b: Column) -> Column:
    """The varint that b begins with; null where it doesn't end."""
    places = F.sequence(F.lit(1), varint_length(b))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", _byte(b, i).bitwiseAND(127), (i - 1) * 7)))


def to_zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def zigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(1))


def length_prefixed(b: Column) -> Column:
    return F.concat(to_varint(F.octet_length(b).cast("long")), b)


def get_length_prefixed(b: Column) -> Column:
    """The slice that b begins with; null where it is cut off."""
    n, skip = varint(b), varint_length(b)
    return F.when(F.octet_length(b) >= skip + n, F.substr(b, skip + 1, n.cast("int")))


def hex_key(key: Column) -> Column:
    """A key as upper-case hex digits of its bytes."""
    return F.hex(key.cast("binary"))


def from_hex_key(digits: Column) -> Column:
    """The key's text; null where the digits are no hex."""
    return F.unhex(digits).cast("string")
