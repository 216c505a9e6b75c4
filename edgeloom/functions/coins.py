"""Deterministic coins: the same seed and key always fall the same way. Keys are BIGINT columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.functions.hashing import mixed_hash_32


def power_of_two_coin(power: int, seed: int, *key: Column, hashed: Callable[..., Column] = mixed_hash_32) -> Column:
    """True with probability ``2**-power``, for powers up to 32."""
    mask = (1 << power) - 1
    return hashed(seed, *key).bitwiseAND(F.lit(mask)) == F.lit(mask)


def weighted_coin(probability: float, seed: int, *key: Column, hashed: Callable[..., Column] = mixed_hash_32) -> Column:
    """True with the given probability: 32 bits of hash as a number in [0, 1)."""
    return hashed(seed, *key) / F.lit(float(1 << 32)) < F.lit(probability)
