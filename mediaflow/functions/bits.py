"""Big-endian fields of binary columns as numbers, and numbers as big-endian bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(raw, offset, n) -> Column:
    """`n` bytes from byte `offset` (from 0); both may be columns."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    return F.substring(_col(raw), start.cast("int"), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def unsigned(raw, offset, n: int) -> Column:
    """The n-byte unsigned number at byte `offset`, as a long; null where the bytes end before it does."""
    end = (offset if isinstance(offset, Column) else F.lit(offset)) + n
    return F.when(F.octet_length(_col(raw)) >= end, F.conv(F.hex(part(raw, offset, n)), 16, 10).cast("long"))


def u8(raw, offset) -> Column:
    return unsigned(raw, offset, 1)


def u16(raw, offset) -> Column:
    return unsigned(raw, offset, 2)


def u24(raw, offset) -> Column:
    return unsigned(raw, offset, 3)


def u32(raw, offset) -> Column:
    return unsigned(raw, offset, 4)


def s24(raw, offset) -> Column:
    """A signed 24-bit number."""
    x = u24(raw, offset)
    return F.when(x >= 1 << 23, x - (1 << 24)).otherwise(x)


def bits(value: Column, shift: int, width: int) -> Column:
    """`width` bits of a number, the lowest of them at `shift`."""
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def be(value, n: int) -> Column:
    """A non-negative number as n bytes."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))
