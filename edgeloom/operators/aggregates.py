"""Counts, degrees, histograms and per-node extremes. All aggregate partially before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.transforms import endpoints, symmetrize


def unique_nodes(edges: DataFrame) -> DataFrame:
    return endpoints(edges).distinct()


def count_nodes(edges: DataFrame) -> DataFrame:
    """One row: distinct ids at either end, and the largest (null without edges)."""
    return unique_nodes(edges).agg(F.count("node").alias("nodes"), F.max("node").alias("max_node"))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row ``nodes, edges, max_node`` from one pass: each edge counts as half at each of its ends."""
    per_node = endpoints(edges).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return per_node.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.coalesce((F.sum("n") / 2).cast("long"), F.lit(0)).alias("edges"),
        F.max("node").alias("max_node"),
    )


def approx_count_nodes(edges: DataFrame, rsd: float = 0.02) -> DataFrame:
    return endpoints(edges).agg(F.approx_count_distinct("node", rsd).alias("nodes"))


def hll_count_nodes(edges: DataFrame, lg_k: int = 12) -> DataFrame:
    """Node count by a mergeable sketch."""
    return endpoints(edges).agg(F.hll_sketch_estimate(F.hll_sketch_agg("node", F.lit(lg_k))).alias("nodes"))


def max_node_id(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("u", "v")).alias("max_node"))


def degrees(edges: DataFrame) -> DataFrame:
    """Rows each node has an end in; a self-loop counts twice."""
    return endpoints(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("count"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """Per representative: rows, and whether it has a row of its own."""
    return labels.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.col("node") == F.col("component")).alias("has_root_row")
    )


def component_size_histogram(labels: DataFrame) -> DataFrame:
    """Components per size; a representative without a row of its own counts as one more member."""
    size = F.col("size") + F.when(F.col("has_root_row"), 0).otherwise(1)
    return component_sizes(labels).select(size.alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("count"))


def min_neighbour(edges: DataFrame) -> DataFrame:
    return symmetrize(edges).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("neighbour"))


def max_neighbour(edges: DataFrame) -> DataFrame:
    return symmetrize(edges).groupBy(F.col("u").alias("node")).agg(F.max("v").alias("neighbour"))


def max_per_component(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.max("node").alias("max_node"))


def node_upper_bound(edges: DataFrame) -> DataFrame:
    """One row: distinct sources plus distinct targets, a bound on the nodes; both in one aggregate."""
    return edges.agg((F.countDistinct("u") + F.countDistinct("v")).alias("bound"))


def common_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sources that occur in both."""
    both = a.select("u").distinct().join(b.select("u").distinct(), "u", "left_semi")
    return both.agg(F.count(F.lit(1)).alias("common_sources"))


def union_find_stats(labels: DataFrame) -> DataFrame:
    """One row: nodes, successful unions, components."""
    return component_sizes(labels).agg(
        F.sum("size").alias("nodes"), (F.sum("size") - F.count(F.lit(1))).alias("unions"), F.count(F.lit(1)).alias("components")
    )


def multi_edges(edges: DataFrame) -> DataFrame:
    """One row: self-loops, and rows beyond the first of each distinct edge."""
    per = edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("n"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("multi_edges"),
    )


def range_bundles(edges: DataFrame, num_bundles: int, max_id: int) -> DataFrame:
    """Edges with the id-range bundle of either end and whether both ends share it. Widths are at least 1."""
    width = max(1, max_id // num_bundles)
    at = lambda c: F.least(F.floor((F.col(c) - 1) / width), F.lit(num_bundles - 1)).cast("long")
    out = edges.withColumn("bundle", at("u")).withColumn("target_bundle", at("v"))
    return out.withColumn("intra", F.col("bundle") == F.col("target_bundle"))
