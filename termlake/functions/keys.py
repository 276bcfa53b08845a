"""16-byte keys as BINARY columns; Spark compares them bytewise, unsigned, as the keys' order asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 16


def bytes_key(raw: Column) -> Column:
    """The first 16 bytes, filled up with zeros on the right."""
    return F.unhex(F.rpad(F.substring(F.hex(raw), 1, 2 * SIZE), 2 * SIZE, "0"))


def uint64_key(v: Column) -> Column:
    """Eight zero bytes, then the number, greatest byte first."""
    return F.unhex(F.lpad(F.hex(v.cast("bigint")), 2 * SIZE, "0"))


def high_low_key(high: Column, low: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(high.cast("bigint")), SIZE, "0"), F.lpad(F.hex(low.cast("bigint")), SIZE, "0")))


def object_id_key(text: Column) -> Column:
    """The 12 bytes of a 24-digit hexadecimal id, then zeros; any other text gives the zero key."""
    return F.when(text.rlike("^[0-9a-fA-F]{24}$"), F.unhex(F.rpad(text, 2 * SIZE, "0"))).otherwise(F.unhex(F.lit("0" * 2 * SIZE)))


def high_uint64(key: Column) -> Column:
    """Bits of the first eight bytes as BIGINT."""
    return F.conv(F.substring(F.hex(key), 1, SIZE), 16, -10).cast("bigint")


def low_uint64(key: Column) -> Column:
    return F.conv(F.substring(F.hex(key), SIZE + 1, SIZE), 16, -10).cast("bigint")


def hex_key(key: Column) -> Column:
    return F.lower(F.hex(key))


def increment(key: Column) -> Column:
    """The key plus one as a 128-bit number, wrapping around."""
    high, low = high_uint64(key), low_uint64(key)
    wraps = low == -1
    greatest = (1 << 63) - 1

    def plus_one(x: Column) -> Column:
        return F.when(x == greatest, F.lit(-(1 << 63))).otherwise(F.when(x == greatest, F.lit(0)).otherwise(x) + 1)

    return high_low_key(F.when(wraps, plus_one(high)).otherwise(high), F.when(wraps, F.lit(0)).otherwise(plus_one(low)))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(F.when(a == b, 0))
