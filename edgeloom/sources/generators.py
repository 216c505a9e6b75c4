"""Graph generators as table-valued sources: ``spark.range`` plus narrow expressions, so they scale out and are replayable.

All emit ``u < v`` with ids from 1, except ``uniform_edges``, which is not oriented.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import mixed_hash_32


def path(spark: SparkSession, n: int) -> DataFrame:
    """``(i, i + 1)`` for i from 1 to n - 1."""
    return spark.range(1, max(1, n)).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))


def grid(spark: SparkSession, n: int, m: int) -> DataFrame:
    """n columns, m rows, ids row by row; right and lower neighbours."""
    i = F.col("id")
    right = F.when(i % n < n - 1, i + 2)
    down = F.when(F.floor(i / n) < m - 1, i + 1 + n)
    return spark.range(n * m).select((i + 1).alias("u"), F.explode(F.array(right, down)).alias("v")).where("v is not null")


def cube(spark: SparkSession, width: int, height: int, layers: int, distance: int = 1) -> DataFrame:
    """Disjoint layers of a grid whose cells join all cells within ``distance`` in rows and columns alike."""
    steps = [(0, dx) for dx in range(1, distance + 1)]
    steps += [(dy, dx) for dy in range(1, distance + 1) for dx in range(-distance, distance + 1)]
    if not steps:
        return spark.createDataFrame([], "u long, v long")
    offsets = F.array(*[F.struct(F.lit(y).cast("long").alias("y"), F.lit(x).cast("long").alias("x")) for y, x in steps])
    i = F.col("id")
    cells = spark.range(width * height * layers).select(
        i, (i % width).alias("x"), (F.floor(i / width) % height).alias("y"), F.explode(offsets).alias("d")
    )
    x, y = F.col("x") + F.col("d.x"), F.col("y") + F.col("d.y")
    inside = cells.where((x >= 0) & (x < width) & (y < height))
    return inside.select((i + 1).alias("u"), (i + 1 + F.col("d.y") * width + F.col("d.x")).alias("v"))


def cliques(spark: SparkSession, size: int, k: int) -> DataFrame:
    """k complete graphs on consecutive id blocks: each node is joined to the later ones of its block."""
    i = F.col("id")
    last = (F.floor(i / size) + 1) * size
    nodes = spark.range(size * k).where(i + 1 < last)
    return nodes.select((i + 1).alias("u"), F.explode(F.sequence(i + 2, last)).alias("v"))


def gilbert(spark: SparkSession, n: int, density: float, seed: int, block_edges: int = 4096) -> DataFrame:
    """G(n, p) with ``p = 2 * density / (n - 1)``: every pair ``u < v`` of 1..n is an edge with probability p, independently.

    Pairs are numbered and cut into blocks; within a block, the gaps between edges are geometric draws from hashes of the
    seed, so no pair without an edge is looked at. ``density * n`` edges on average.
    """
    pairs, p = n * (n - 1) // 2, min(1.0, 2 * density / max(1, n - 1))
    if pairs <= 0 or p <= 0:
        return spark.createDataFrame([], "u long, v long")
    blocks, size, draws = gilbert_blocks(n, density, block_edges)
    k = spark.range(blocks).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<long>")).alias("k"))
    unit = (mixed_hash_32(seed, F.col("block"), F.col("k")) + 0.5) / F.lit(float(1 << 32))
    gap = F.lit(1) if p >= 1 else F.least(F.floor(F.ln(unit) / F.lit(math.log1p(-p))) + 1, F.lit(size))
    place = F.sum(gap.cast("long")).over(Window.partitionBy("block").orderBy("k")) - 1
    at = k.select("block", place.alias("place")).where(F.col("place") < size)
    number = at.select((F.col("block") * size + F.col("place")).alias("i")).where(F.col("i") < pairs)
    # pair i: v is the largest number with (v - 1) * (v - 2) / 2 <= i; the root may be off by one
    root = F.floor((F.sqrt(8.0 * F.col("i") + 1) + 1) / 2).cast("long")
    below = lambda r: F.expr(f"{r} * ({r} - 1) div 2")
    found = number.withColumn("r", root)
    found = found.withColumn("r", F.when(below("r") > F.col("i"), F.col("r") - 1).when(below("(r + 1)") <= F.col("i"), F.col("r") + 1).otherwise(F.col("r")))
    return found.select((F.col("i") - below("r") + 1).alias("u"), (F.col("r") + 1).alias("v"))


def gilbert_blocks(n: int, density: float, block_edges: int = 4096) -> tuple[int, int, int]:
    """Blocks of pairs, pairs of a block, and draws of a block: ten standard deviations more than its mean of edges."""
    pairs, p = n * (n - 1) // 2, min(1.0, 2 * density / max(1, n - 1))
    size = min(pairs, max(1, math.ceil(block_edges / p)))
    return -(-pairs // size), size, min(size, math.ceil(size * p + 10 * math.sqrt(size * p) + 20))


def uniform_edges(spark: SparkSession, n: int, m: int, seed: int) -> DataFrame:
    """m edges with both ends uniform in 1..n (n up to 2**32); loops and repeats may occur."""
    end = lambda s: F.pmod(mixed_hash_32(seed + s, F.col("id")), F.lit(n)) + 1
    return spark.range(m).select(end(1).alias("u"), end(2).alias("v"))
