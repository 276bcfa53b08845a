"""Sortable ids, base-62 text, channel timestamps and a 32-bit block cipher."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Digits of base-62 text in order; the second from which id times count.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
EPOCH = 1666666666


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


@dataclass(frozen=True)
class IdLayout:
    """An id is seconds since EPOCH, then `low_bits` of server and counter; as text it has `width` digits."""

    width: int = 10
    counter_bits: int = 13

    def __post_init__(self):
        if self.counter_bits > self.low_bits:
            raise ValueError(f"{self.counter_bits} bits of counter do not fit {self.low_bits} low bits")

    @property
    def low_bits(self) -> int:
        return int(math.log2(62**self.width)) - 33


def base62(number: Column, width: int = 10) -> Column:
    """Text of fixed width, greatest digit first."""
    digits = [F.pmod(_div(number, 62**k), F.lit(62)).cast("int") for k in range(width - 1, -1, -1)]
    return F.concat(*[F.substring(F.lit(DIGITS), d + 1, F.lit(1)) for d in digits])


def base62_number(text: Column, width: int = 10) -> Column:
    """Inverse of base62(); null where the width differs, a character is no digit or the number takes over 63 bits."""
    total = F.lit(0).cast("decimal(38,0)")
    for i in range(1, width + 1):
        place = F.call_function("locate", F.substring(text, i, 1), F.lit(DIGITS))
        total = total * 62 + (place - 1)
    good = (F.length(text) == width) & text.rlike("^[0-9A-Za-z]*$")
    return F.when(good & (total <= F.lit((1 << 63) - 1)), total.cast("bigint"))


def make_id(second: Column, server: Column | int, counter: Column, layout: IdLayout = IdLayout()) -> Column:
    """The id of the counter-th event of a second (unix time) on a server."""
    low = F.shiftleft(F.lit(server) if isinstance(server, int) else server, layout.counter_bits)
    return F.shiftleft((second - EPOCH).cast("bigint"), layout.low_bits).bitwiseOR(low.cast("bigint")).bitwiseOR(counter.cast("bigint"))


def assign_ids(df: DataFrame, second: str, order: list[str], server: int = 0, layout: IdLayout = IdLayout(), out: str = "id") -> DataFrame:
    """df with ids that are unique in each second of one server; raises where a second has more events than counters."""
    n = F.row_number().over(Window.partitionBy(second).orderBy(*order))
    counter = F.when(n < (1 << layout.counter_bits), n).otherwise(F.raise_error(F.lit("more events in a second than the counter holds")).cast("int"))
    return df.withColumn(out, make_id(F.col(second), server, counter, layout))


def id_second(number: Column, layout: IdLayout = IdLayout()) -> Column:
    """Unix time of an id."""
    return F.shiftrightunsigned(number, layout.low_bits) + EPOCH


def text_id_second(text: Column, layout: IdLayout = IdLayout()) -> Column:
    return id_second(base62_number(text, layout.width), layout)


def second_floor_id(second: Column, layout: IdLayout = IdLayout()) -> Column:
    """Text of the least id of a second: a bound for range scans."""
    return base62(F.shiftleft((second - EPOCH).cast("bigint"), layout.low_bits), layout.width)


# Fixed values of channel timestamps, in nanoseconds: block, channel, start of what is pushed forward; channels; events of one
# channel and block; nanoseconds at a block's end that carry cookies.
BLOCK_NS, CHANNEL_NS = 100_000_000, 8_320_000
CHANNELS, PER_BLOCK = 12, 60_000
COOKIE_NS = 160_000


def future_stamp(block: Column, channel: Column, counter: Column, late: Column | None = None) -> Column:
    """Nanosecond stamp of the counter-th event of a channel in a block; `late` events lie in the upper half of the channel."""
    upper = F.when(late, F.lit(PER_BLOCK)).otherwise(F.lit(0)) if late is not None else F.lit(0)
    good = (channel >= 0) & (channel < CHANNELS) & (counter >= 0) & (counter < PER_BLOCK)
    return F.when(good, block.cast("bigint") * BLOCK_NS + channel.cast("bigint") * CHANNEL_NS + counter.cast("bigint") + upper)


def assign_futures(df: DataFrame, ns: str, channel: str, order: list[str], out: str = "future") -> DataFrame:
    """df with a unique stamp for each event, in the block after its time; events of a channel and block are numbered in `order`.

    The lower half of a channel's part of a block holds the first PER_BLOCK events. Those beyond wait in the channel's line for the
    upper halves of the blocks behind, first come first served: whatever the overflow of a block and its neighbours, no two events meet.
    """
    own = Window.partitionBy("_block", channel).orderBy(*order)
    numbered = df.withColumn("_block", _div(F.col(ns), BLOCK_NS) + 1).withColumn("_n", F.row_number().over(own) - 1)
    # a row for each block that overflows: how many wait, and at which place of the line (block x PER_BLOCK) the first of them is served
    waiting = numbered.groupBy(F.col("_block").alias("_b"), F.col(channel).alias("_c")).agg((F.count("*") - PER_BLOCK).alias("_w")).where("_w > 0")
    line = Window.partitionBy("_c").orderBy("_b")
    before = F.sum("_w").over(line) - F.col("_w")
    waiting = waiting.withColumn("_before", before).withColumn("_idle", F.max((F.col("_b") + 1) * PER_BLOCK - F.col("_before")).over(line))
    waiting = waiting.select("_b", "_c", (F.col("_before") + F.col("_idle")).alias("_first"))
    joined = numbered.join(waiting, (F.col("_block") == F.col("_b")) & (F.col(channel) == F.col("_c")), "left")
    late = F.col("_n") >= PER_BLOCK
    place = F.when(late, F.col("_first") + F.col("_n") - PER_BLOCK).otherwise(F.col("_block") * PER_BLOCK + F.col("_n"))
    stamp = future_stamp(_div(place, PER_BLOCK), F.col(channel), place % PER_BLOCK, late)
    return joined.withColumn(out, stamp).drop("_block", "_n", "_b", "_c", "_first")


def future_channel(stamp: Column) -> Column:
    """Channel of a stamp, from its whole milliseconds."""
    return _div((_div(stamp, 1_000_000) % 1000) % 100, 8)


def future_cookie(stamp: Column) -> Column:
    """The 16-bit cookie of a stamp that carries one, else null."""
    following = (_div(stamp, BLOCK_NS) + 1) * BLOCK_NS
    return F.when(stamp >= following - COOKIE_NS, (following - stamp - 1).bitwiseAND(0xFFFF).cast("int"))


def with_cookie(stamp: Column, cookie: Column) -> Column:
    """The stamp at the end of the same block that carries a cookie."""
    return _div(stamp, BLOCK_NS) * BLOCK_NS + (BLOCK_NS - 1) - cookie


# The F-table of the published SKIPJACK algorithm, a permutation of all bytes in order.
F_TABLE = bytes.fromhex("""
    a3 d7 09 83 f8 48 f6 f4 b3 21 15 78 99 b1 af f9
    e7 2d 4d 8a ce 4c ca 2e 52 95 d9 1e 4e 38 44 28
    0a df 02 a0 17 f1 60 68 12 b7 7a c3 e9 fa 3d 53
    96 84 6b ba f2 63 9a 19 7c ae e5 f5 f7 16 6a a2
    39 b6 7b 0f c1 93 81 1b ee b4 1a ea d0 91 2f b8
    55 b9 da 85 3f 41 bf e0 5a 58 80 5f 66 0b d8 90
    35 d5 c0 a7 33 06 65 69 45 00 94 56 6d 98 9b 76
    97 fc b2 c2 b0 fe db 20 e1 eb d6 e4 dd 47 4a 1d
    42 ed 9e 6e 49 3c cd 43 27 d2 07 d4 de c7 67 18
    89 cb 30 1f 8d c6 8f aa c8 74 dc c9 5d 5c 31 a4
    70 88 61 2c 9f 0d 2b 87 50 82 54 64 26 7d 03 40
    34 4b 1c 73 d1 c4 fd 3b cc fb 7f ab e6 3e 5b a5
    ad 04 23 9c 14 51 22 f0 29 79 71 7e ff 8c 0e e2
    0c ef bc 72 75 6f 37 a1 ec d3 8e 62 8b 86 10 e8
    08 77 11 be 92 4f 24 c5 32 36 9d cf f3 a6 bb ac
    5e 6c a9 13 57 25 b5 e3 bd a8 3a 01 05 59 2a 46
""")


def skip32(key: bytes, decrypt: bool = False, table: bytes = F_TABLE) -> Callable[[Column], Column]:
    """A 24-round Feistel cipher on 32-bit numbers in built-in functions.

    `key` counts with its first 10 bytes, filled up with zeros. `table` is the round function's byte table.
    """
    key = key[:10].ljust(10, b"\0")
    if len(table) != 256:
        raise ValueError("the byte table has 256 entries")
    lookup, keys = F.array(*[F.lit(int(b)) for b in table]), F.array(*[F.lit(int(b)) for b in key])

    def g(k: Column, w: Column) -> Column:
        high, low = F.shiftright(w, 8).bitwiseAND(0xFF), w.bitwiseAND(0xFF)
        for i in range(4):
            at = low.bitwiseXOR(F.element_at(keys, (k * 4 + i) % 10 + 1))
            high, low = low, F.element_at(lookup, at + 1).bitwiseXOR(high)
        return F.shiftleft(high, 8).bitwiseOR(low)

    def one_round(state: Column, k: Column) -> Column:
        mixed = state["b"].bitwiseXOR(g(k, state["a"])).bitwiseXOR(k)
        return F.struct(mixed.alias("a"), state["a"].alias("b"))

    rounds = F.sequence(F.lit(23), F.lit(0), F.lit(-1)) if decrypt else F.sequence(F.lit(0), F.lit(23))

    def cipher(x: Column) -> Column:
        x = x.cast("bigint")
        halves = F.struct(F.shiftright(x, 16).bitwiseAND(0xFFFF).cast("int").alias("a"), x.bitwiseAND(0xFFFF).cast("int").alias("b"))
        return F.aggregate(rounds, halves, one_round, lambda s: F.shiftleft(s["b"].cast("bigint"), 16).bitwiseOR(s["a"].cast("bigint")))

    return cipher


def skip32_bytes(key: bytes, decrypt: bool = False) -> Callable[[Column], Column]:
    """The same on BINARY of four bytes, the least byte first; null for any other length."""
    cipher = skip32(key, decrypt)

    def turned(raw: Column) -> Column:
        digits = F.hex(raw)
        return F.concat(*[F.substring(digits, 7 - 2 * i, 2) for i in range(4)])

    def run(raw: Column) -> Column:
        number = cipher(F.conv(turned(raw), 16, 10).cast("bigint"))
        return F.when(F.octet_length(raw) == 4, turned_back(number))

    def turned_back(number: Column) -> Column:
        return F.unhex(turned(F.unhex(F.lpad(F.hex(number), 8, "0"))))

    return run
