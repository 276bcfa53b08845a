"""64- and 32-bit hashes in built-in functions. All arithmetic stays below the 64-bit limit, as ANSI mode raises on overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF
#: Offset basis of the 64-bit FNV hashes as a signed number; the prime is 2**40 + 435.
FNV_BASIS = -3750763034362895579
FNV_LOW = 435


def signed(value: int) -> int:
    """An unsigned 64-bit number as the BIGINT of the same bits."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def multiply_fnv_prime(h: Column) -> Column:
    """h * (2**40 + 435) modulo 2**64."""
    low, high = h.bitwiseAND(M32), F.shiftrightunsigned(h, 32)
    product = low * FNV_LOW
    top = (high * FNV_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low.bitwiseAND(0xFFFFFF), 8)).bitwiseAND(M32)
    return F.shiftleft(top, 32).bitwiseOR(product.bitwiseAND(M32))


def _bytes(value: Column) -> Column:
    digits = F.hex(value)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(value), F.lit(1))), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))


def _folded(text: Column, step) -> Column:
    raw = text.cast("binary")
    some = F.aggregate(_bytes(raw), F.lit(FNV_BASIS).cast("bigint"), step)
    return F.when(F.octet_length(raw) > 0, some).otherwise(F.when(raw.isNotNull(), F.lit(FNV_BASIS).cast("bigint")))


def fnv1(text: Column) -> Column:
    """64-bit FNV-1 of a string's UTF-8 bytes: multiply, then xor. Null for null."""
    return _folded(text, lambda h, b: multiply_fnv_prime(h).bitwiseXOR(b))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes: xor, then multiply. Null for null."""
    return _folded(text, lambda h, b: multiply_fnv_prime(h.bitwiseXOR(b)))


def multiply32(a: Column, k: int) -> Column:
    """a * k modulo 2**32 for 0 <= a, k < 2**32."""
    return (a * (k & 0xFFFF) + F.shiftleft((a * (k >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(M32)


def rotate32(a: Column, n: int) -> Column:
    return F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 32 - n)).bitwiseAND(M32)


# Fixed values of 32-bit murmur3: block constants, the step after a block and the constants of the last mix.
MURMUR_C1, MURMUR_C2 = 0xCC9E2D51, 0x1B873593
MURMUR_ADD = 0xE6546B64
MURMUR_F1, MURMUR_F2 = 0x85EBCA6B, 0xC2B2AE35


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _finished(h: Column) -> Column:
    h = multiply32(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), MURMUR_F1)
    h = multiply32(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), MURMUR_F2)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def _block(value: Column) -> Column:
    return multiply32(rotate32(multiply32(value.cast("bigint"), MURMUR_C1), 15), MURMUR_C2)


def _joined(seed: Column, block: Column) -> Column:
    h = rotate32(seed.bitwiseXOR(block), 13)
    return (h * 5 + MURMUR_ADD).bitwiseAND(M32).bitwiseXOR(F.lit(4).cast("bigint"))


def mix32(value: Column, seed: Column | int) -> Column:
    """32-bit murmur3 of one 4-byte block with a seed, both given as numbers from 0 to 2**32 - 1."""
    seed = F.lit(seed).cast("bigint") if isinstance(seed, int) else seed.cast("bigint")
    return _finished(_joined(seed, _block(value)))


def block_hashes(term: Column, segment_start: Column) -> Column:
    """Four chained mixes of a term's low 32 bits, seeded by the low 32 bits of the segment's start."""

    def chained(block: Column) -> Column:
        first = F.array(segment_start.cast("bigint").bitwiseAND(M32))

        def step(done: Column, _: Column) -> Column:
            return F.concat(done, F.array(bound(_joined(F.element_at(done, -1), block), _finished)))

        return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(4)), first, step), 2, 4)

    return bound(_block(term.cast("bigint").bitwiseAND(M32)), chained)


def byte_swap(h: Column) -> Column:
    """The 64-bit number with its bytes in reverse order."""
    return F.conv(F.concat(*[F.substring(F.lpad(F.hex(h), 16, "0"), 15 - 2 * i, 2) for i in range(8)]), 16, -10).cast("bigint")


def expand(h: Column) -> Column:
    """Three numbers for approximate sets: h, its complement, its bytes in reverse order."""
    return F.array(h, F.bitwise_not(h), byte_swap(h))


def pair_hash(a: Column, b: Column) -> Column:
    """FNV-1a over two 64-bit numbers instead of bytes."""
    return multiply_fnv_prime(multiply_fnv_prime(F.lit(FNV_BASIS).cast("bigint").bitwiseXOR(a)).bitwiseXOR(b))


def key_hash(key: Column) -> Column:
    """pair_hash of the two halves of a 16-byte key, each read with its least byte first."""
    digits = F.hex(key)
    half = [F.conv(F.concat(*[F.substring(digits, off + 15 - 2 * i, 2) for i in range(8)]), 16, -10).cast("bigint") for off in (0, 16)]
    return pair_hash(*half)


def row_hash(index: Column, h: Column) -> Column:
    """32 bits: a row's index above the low 17 bits of a hash."""
    return F.shiftleft(index.cast("bigint"), 17).bitwiseOR(h.cast("bigint").bitwiseAND(0x1FFFF)).bitwiseAND(M32)
