"""Distinct-count sketches as plain aggregates: every sketch is a min, max or top-k, so it merges and combines map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import arithmetic_hash_32, mixed_hash_32

MAX_32 = (1 << 32) - 1


def parameters(copies: int, seed: int) -> list[tuple[int, int]]:
    """``(a, b)`` pairs with odd a, from a fixed generator (splitmix64)."""
    state, out = seed & ((1 << 64) - 1), []
    for _ in range(copies):
        pair = []
        for _ in range(2):
            state = (state + 0x9E3779B97F4A7C15) % (1 << 64)
            z = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % (1 << 64)
            pair.append((z ^ (z >> 31)) & MAX_32)
        out.append((pair[0] | 1, pair[1]))
    return out


def min_sketch_estimate(min_hash: Column) -> Column:
    """``floor((2**32 - 1) / min - 1)``; null where the minimum is 0 or null."""
    return F.when(min_hash > 0, F.floor(F.lit(MAX_32) / min_hash - 1)).cast("long")


def min_sketch(column: Column, a: int, b: int) -> Column:
    """Aggregate: the estimate from the smallest hash."""
    return min_sketch_estimate(F.min(arithmetic_hash_32(column, a, b)))


def ratio_sketch(column: Column, a: int, b: int, hash_max: int = MAX_32) -> Column:
    """Aggregate: ``floor(hash_max / smallest hash)``; null where the smallest is 0."""
    low = F.min(arithmetic_hash_32(column, a, b))
    return F.when(low > 0, F.floor(F.lit(hash_max) / low)).cast("long")


def trailing_zeros(x: Column, bits: int = 32) -> Column:
    """Trailing zero bits; ``bits`` for 0."""
    return F.when(x == 0, F.lit(bits)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def tidemark(column: Column, a: int, b: int) -> Column:
    """Aggregate: ``floor(2**z * sqrt(2))`` with z the most trailing zeros of any hash."""
    z = F.max(trailing_zeros(arithmetic_hash_32(column, a, b)))
    return F.floor(F.pow(F.lit(2.0), z) * F.sqrt(F.lit(2.0))).cast("long")


def mean_of(estimates: list[Column]) -> Column:
    """Integer mean of several estimates."""
    total = estimates[0]
    for e in estimates[1:]:
        total = total + e
    return F.floor(total / len(estimates)).cast("long")


def median_of(estimates: list[Column]) -> Column:
    """Element ``n // 2`` of the sorted estimates."""
    return F.element_at(F.array_sort(F.array(*estimates)), len(estimates) // 2 + 1)


def median_of_means(column: Column, groups: int = 5, copies: int = 5, seed: int = 1) -> Column:
    """Aggregate: the median of ``groups`` means of ``copies`` estimates each; one pass, ``groups * copies`` minima."""
    params = parameters(groups * copies, seed)
    each = [min_sketch(column, a, b) for a, b in params]
    return median_of([mean_of(each[g * copies : (g + 1) * copies]) for g in range(groups)])


def k_minimum_values(df: DataFrame, column: str, k: int, seed: int = 1) -> DataFrame:
    """One row ``estimate``: ``(k - 1) / kth smallest hash`` on the unit interval; the exact count below k values."""
    high, low = (mixed_hash_32(seed + i, F.col(column)) for i in (0, 1))
    unit = (F.shiftleft(high, 21) + F.shiftright(low, 11) + 1) / F.lit(float(1 << 53))
    lowest = df.where(F.col(column).isNotNull()).select(unit.alias("h")).distinct().orderBy("h").limit(k)
    return lowest.agg(
        F.when(F.count("h") < k, F.count("h")).otherwise(F.floor((k - 1) / F.max("h"))).cast("long").alias("estimate")
    )


def both_sides(column_left: Column, column_right: Column, a: int, b: int) -> list[Column]:
    """Three aggregates from one pass: estimates for the left column, the right column, and their union."""
    left, right = (F.min(arithmetic_hash_32(c, a, b)) for c in (column_left, column_right))
    return [
        min_sketch_estimate(left).alias("left_nodes"),
        min_sketch_estimate(right).alias("right_nodes"),
        min_sketch_estimate(F.least(left, right)).alias("all_nodes"),
    ]
