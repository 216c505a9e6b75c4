"""Per-row transforms of edge lists. All are narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.ordering import with_position
from edgeloom.session import stable


def orient_small_to_large(edges: DataFrame) -> DataFrame:
    """``(min, max)`` of each edge."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def orient_large_to_small(edges: DataFrame) -> DataFrame:
    """``(max, min)`` of each edge."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, from one scan."""
    both = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(both).alias("e")).select("e.u", "e.v")


def project_target(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("node"))


def endpoints(edges: DataFrame) -> DataFrame:
    """One row per edge end, from one scan."""
    return edges.select(F.explode(F.array("u", "v")).alias("node"))


def index_edges(edges: DataFrame) -> DataFrame:
    """Adds ``rank``, the position from 0 in ``(u, v)`` order, without a one-task window."""
    return with_position(edges, ["u", "v"], "rank")


def flag_origin(edges: DataFrame, name: str, value: object) -> DataFrame:
    return edges.withColumn(name, F.lit(value))


def tee(df: DataFrame, *selections: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Several outputs over one pass of the input: it is computed and written down once, and every output reads that."""
    shared = stable(df)
    return [select(shared) for select in selections]


def shift_ids(edges: DataFrame, add: int = 0, subtract: int = 0) -> DataFrame:
    return edges.select((F.col("u") + add - subtract).alias("u"), (F.col("v") + add - subtract).alias("v"))


def push(df: DataFrame, mapping: dict[str, Column] | None = None) -> DataFrame:
    """Hands rows on, each mapped by column expressions if any are given."""
    return df if mapping is None else df.select(*[c.alias(k) for k, c in mapping.items()])


def push_until(df: DataFrame, stop: Column, order: list[str]) -> DataFrame:
    """The rows before the first one, in ``order``, that fulfils ``stop`` (which is left out too).

    The first stopping row is found by an aggregate, so no window over all rows is needed. Rows that tie with it on
    ``order`` are left out.
    """
    key = F.struct(*order)
    cut = df.where(stop).agg(F.min(key).alias("cut"))
    return df.join(F.broadcast(cut), F.col("cut").isNull() | (key < F.col("cut")), "inner").drop("cut")


def normalize(edges: DataFrame) -> DataFrame:
    """Oriented, without self-loops, distinct."""
    return orient_small_to_large(edges).where("u <> v").distinct()
