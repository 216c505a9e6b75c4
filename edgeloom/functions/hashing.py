"""Arithmetic hash families on BIGINT columns.

ANSI mode raises on overflow, so products that wrap are put together from 16-bit parts that cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M16, M32 = (1 << 16) - 1, (1 << 32) - 1


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(M32))


def multiply_mod_2_32(a: int, x: Column) -> Column:
    """``a * x mod 2**32`` for a below 2**32 and x from 0 to below 2**32."""
    low, high = a & M16, a >> 16
    return _low32(F.lit(low) * x + F.shiftleft((F.lit(high) * x).bitwiseAND(F.lit(M16)), 16))


def arithmetic_hash_32(x: Column, a: int, b: int, mask: int = M32) -> Column:
    """``(a * x + b mod 2**32) & mask`` of the low 32 bits of x."""
    return _low32(multiply_mod_2_32(a & M32, _low32(x)) + F.lit(b & M32)).bitwiseAND(F.lit(mask))


def mixed_hash_32(seed: int, *keys: Column) -> Column:
    """A well-mixed 32-bit hash of BIGINT keys: products modulo 2**32 and shifts, so that any engine can compute it."""
    h: Column = F.lit(seed & M32).cast("long")
    for key in keys:
        key = key.cast("long")
        h = h.bitwiseXOR(_low32(key)).bitwiseXOR(multiply_mod_2_32(0x9E3779B1, F.shiftrightunsigned(key, 32)))
        for multiplier, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
            h = multiply_mod_2_32(multiplier, h)
            h = h.bitwiseXOR(F.shiftright(h, shift))
    return h


def quick_hash_32(seed: int, *keys: Column) -> Column:
    """32 bits of Spark's own hash: for draws that no SQL repeats. Its expression has one node, where ``mixed_hash_32`` names
    the hash of the keys before 16 times for each further key: thousands of nodes for two keys, which are slow to plan and run."""
    return _low32(F.xxhash64(F.lit(seed), *keys))


def mixed_hash_sql(name: str, seed: int, *keys: str) -> str:
    """``mixed_hash_32`` as a list of SQL select items that use one another by name; the last is called ``name``."""
    items, h = [], str(seed & M32)
    for i, key in enumerate(keys):
        items.append(f"xor(xor({h}::BIGINT, {key} & {M32}), CAST(({0x9E3779B1}::HUGEINT * ({key} >> 32)) % 4294967296 AS BIGINT)) AS {name}_{i}x")
        h = f"{name}_{i}x"
        for multiplier, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
            items.append(f"CAST(({multiplier}::HUGEINT * {h}) % 4294967296 AS BIGINT) AS {name}_{i}m{shift}")
            h = f"{name}_{i}m{shift}"
            last = i + 1 == len(keys) and shift == 16
            items.append(f"xor({h}, {h} >> {shift}) AS {name if last else f'{name}_{i}s{shift}'}")
            h = f"{name}_{i}s{shift}"
    return ", ".join(items)


def _wide(a: int, x: Column, b: int) -> tuple[Column, Column]:
    """High and low 32 bits of ``a * x + b mod 2**64`` for 64-bit a and b and x below 2**32."""
    a_low, a_high, b_low, b_high = a & M32, (a >> 32) & M32, b & M32, (b >> 32) & M32
    p_low = F.lit(a_low) * x.bitwiseAND(F.lit(M16))
    p_high = F.lit(a_low) * F.shiftright(x, 16)
    low = _low32(p_low) + F.shiftleft(p_high.bitwiseAND(F.lit(M16)), 16) + F.lit(b_low)
    high = F.shiftright(p_low, 32) + F.shiftright(p_high, 16) + multiply_mod_2_32(a_high, x) + F.lit(b_high) + F.shiftright(low, 32)
    return _low32(high), _low32(low)


def multiply_shift_32(x: Column, a: int, b: int, bits: int = 32) -> Column:
    """The top ``bits`` (1 to 32) of ``a * x + b mod 2**64``, x cut to 32 bits."""
    return F.shiftright(_wide(a, _low32(x), b)[0], 32 - bits)


def pair_multiply_shift_64(x: Column, params: tuple[int, int, int, int, int, int], max_value: int) -> Column:
    """A hash of up to 64 bits put together from two halves, as BIGINT (the top bit is its sign).

    params: ``(a, b, c)`` of either half. A half hashes both 32-bit words of x: the top bits of
    ``(a + high(x)) * (b + low(x)) + c mod 2**64``. With ``max_value`` up to 2**32 the high half has no bits and is 0.
    """
    bits = max(1, (max_value - 1).bit_length())
    low_bits, high_bits = min(bits, 32), max(0, min(bits, 64) - 32)
    low_word, high_word = _low32(x), F.shiftrightunsigned(x, 32)

    def half(a: int, b: int, c: int, take: int) -> Column:
        left, right = high_word + F.lit(a & (M32 >> 1)), low_word + F.lit(b & (M32 >> 1))
        r0, r1, r2 = right.bitwiseAND(F.lit(M16)), F.shiftright(right, 16).bitwiseAND(F.lit(M16)), F.shiftright(right, 32)
        p0, p1 = left * r0, left * r1
        low = _low32(p0) + F.shiftleft(p1.bitwiseAND(F.lit(M16)), 16) + F.lit(c & M32)
        high = F.shiftright(p0, 32) + F.shiftright(p1, 16) + _low32(left * r2) + F.lit((c >> 32) & M32) + F.shiftright(low, 32)
        return F.shiftright(_low32(high), 32 - take)

    low = half(*params[:3], low_bits)
    return low if not high_bits else F.shiftleft(half(*params[3:], high_bits), 32).bitwiseOR(low)
