"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.transforms import orient_small_to_large


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v")


def clean(edges: DataFrame) -> DataFrame:
    """Without self-loops and duplicates; order of the input is irrelevant, so no row is lost for being out of order."""
    return edges.where("u <> v").distinct()


def clean_report(edges: DataFrame) -> DataFrame:
    """One row: how many edges came in, are loops, are duplicates of another edge, and remain."""
    counted = edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    loops = F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("n"))), F.lit(0))
    kept = F.count(F.when(F.col("u") != F.col("v"), 1))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counted.agg(
        total.alias("edges_in"), loops.alias("self_loops"), (total - loops - kept).alias("duplicates"), kept.alias("edges_out")
    )


def without_hits(df: DataFrame, key: str, hits: DataFrame, hit_key: str = "node") -> DataFrame:
    """The rows whose key is not among the hits: an anti join."""
    return df.join(hits.select(F.col(hit_key).alias(key)).distinct(), key, "left_anti").select(*df.columns)


def consecutive_filter(df: DataFrame, order: list[str], probe: Column, partition: list[str]) -> DataFrame:
    """Drops a row if ``probe`` holds between it and the row before it in ``order``.

    ``probe`` refers to the earlier row as ``prev.<column>``. Rows are compared within ``partition``; a probe of
    equality on some columns should name these as the partition, which spreads the work.
    """
    before = F.lag(F.struct(*[F.col(c) for c in df.columns])).over(Window.partitionBy(*partition).orderBy(*order))
    marked = df.withColumn("prev", before)
    return marked.where(F.col("prev").isNull() | ~F.coalesce(probe, F.lit(False))).drop("prev")


def dedup_equal(edges: DataFrame) -> DataFrame:
    return edges.distinct()


def dedup_undirected(edges: DataFrame) -> DataFrame:
    """One row ``(min, max)`` for each unordered pair."""
    return orient_small_to_large(edges).distinct()


def sources_up_to(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("u") <= node)


def source_is(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("u") == node)


def first_k_sources(edges: DataFrame, k: int) -> DataFrame:
    """The edges whose source is among the ``k`` smallest distinct sources (all edges if k exceeds their number).

    The cut is found by a top-k of the distinct sources, then applied as a range filter on the source.
    """
    if k <= 0:
        return edges.where(F.lit(False))
    cut = edges.select("u").distinct().orderBy("u").limit(k).agg(F.max("u").alias("cut"))
    return edges.join(F.broadcast(cut), F.col("u") <= F.col("cut")).select(*edges.columns)
