"""Sampling by hashes of a seed and the row's own key: a retried or repeated evaluation gives the same sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.coins import power_of_two_coin, weighted_coin
from edgeloom.functions.hashing import mixed_hash_32
from edgeloom.operators.joins import relabel_edges
from edgeloom.operators.ordering import with_position
from edgeloom.operators.transforms import endpoints, orient_small_to_large


def random_out_edge(edges: DataFrame, seed: int, hashed: Callable[..., Column] = mixed_hash_32) -> DataFrame:
    """One uniform out-edge for every source."""
    return edges.groupBy("u").agg(F.min_by("v", F.struct(hashed(seed, F.col("u"), F.col("v")), F.col("v"))).alias("v"))


def random_neighbour(edges: DataFrame, probability: float, seed: int, hashed: Callable[..., Column] = mixed_hash_32) -> DataFrame:
    """Each source kept with the given probability, with one uniform out-edge. The coin is tossed before the shuffle."""
    return random_out_edge(edges.where(weighted_coin(probability, seed + 1, F.col("u"), hashed=hashed)), seed, hashed)


def sampled_sources(edges: DataFrame, probability: float, seed: int) -> DataFrame:
    """One row: sources that the coin keeps and drops."""
    kept = weighted_coin(probability, seed + 1, F.col("u"))
    return edges.select("u").distinct().agg(F.count_if(kept).alias("sampled"), F.count_if(~kept).alias("unsampled"))


def split_edges(edges: DataFrame, power: int, seed: int, hashed: Callable[..., Column] = mixed_hash_32) -> tuple[DataFrame, DataFrame]:
    """Every edge to one side: the left with probability ``2**-power``."""
    coin: Column = power_of_two_coin(power, seed, F.col("u"), F.col("v"), hashed=hashed)
    return edges.where(coin), edges.where(~coin)


def random_relabelling(edges: DataFrame, seed: int) -> DataFrame:
    """A bijection ``(node, component)`` from the n distinct ids to a random permutation of 1..n."""
    keyed = endpoints(edges).distinct().withColumn("key", mixed_hash_32(seed, F.col("node")))
    return with_position(keyed, ["key", "node"], "component", start=1).select("node", "component")


def relabel_randomly(edges: DataFrame, seed: int) -> DataFrame:
    """Edges under ``random_relabelling``, oriented small to large."""
    return orient_small_to_large(relabel_edges(edges, random_relabelling(edges, seed)))


def sample_per_key(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` uniform rows for each key."""
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__r") <= n).drop("__r")
