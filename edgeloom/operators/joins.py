"""Relabelling, contraction and composition: equi-joins with a label map ``(node, component)``.

The planner picks the join: a small map is broadcast by its measured size, a large one is shuffled, and adaptive
execution splits skewed keys. No side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.transforms import orient_small_to_large


def _relabel(edges: DataFrame, labels: DataFrame, end: str) -> DataFrame:
    other = "v" if end == "u" else "u"
    m = labels.select(F.col("node").alias("__node"), F.col("component").alias("__to"))
    joined = edges.join(m, edges[end] == m["__node"], "left")
    return joined.select(F.coalesce("__to", end).alias(end), F.col(other)).select("u", "v")


def relabel_sources(edges: DataFrame, labels: DataFrame, drop_loops: bool = False) -> DataFrame:
    """``u`` replaced by its label where it has one."""
    out = _relabel(edges, labels, "u")
    return out.where("u <> v") if drop_loops else out


def relabel_targets_oriented(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``v`` replaced by its label, oriented small to large, without self-loops."""
    return orient_small_to_large(_relabel(edges, labels, "v")).where("u <> v")


def contract_stars(edges: DataFrame, labels: DataFrame, distinct: bool = True) -> DataFrame:
    """Both ends relabelled, oriented, loops dropped, and duplicates too unless the consumer bears them."""
    out = relabel_targets_oriented(relabel_sources(edges, labels), labels)
    return out.distinct() if distinct else out


def relabel_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Both ends relabelled; neither orientation nor loops nor duplicates change."""
    return _relabel(_relabel(edges, labels, "u"), labels, "v")


def relabel_labels(labels: DataFrame, onto: DataFrame) -> DataFrame:
    """Each component replaced by its own label in ``onto``."""
    o = onto.select(F.col("node").alias("__node"), F.col("component").alias("__to"))
    return labels.join(o, labels["component"] == o["__node"], "left").select(
        "node", F.coalesce("__to", "component").alias("component")
    )


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """The map that first applies ``left``, then ``right``; nodes that only ``right`` knows keep its label."""
    through = relabel_labels(left, right)
    rest = right.join(left.select("node"), "node", "left_anti").select("node", "component")
    return through.unionByName(rest).distinct()


def contract_with_bound(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``contract_stars`` and a one-row frame with the exact number of nodes left."""
    out = contract_stars(edges, labels)
    nodes = out.select(F.explode(F.array("u", "v")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    return out, nodes


def break_paths(sample: DataFrame) -> DataFrame:
    """The sampled edges whose source is no sampled target, so that what remains are stars."""
    return sample.join(sample.select(F.col("v").alias("u")).distinct(), "u", "left_anti").select("u", "v")


def incident_positions(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """For each ranked edge, the edges that leave its target: ``(rank, u, v)``."""
    at = ranked.select(F.col("v").alias("__at"), "rank")
    return at.join(edges, at["__at"] == edges["u"]).select("rank", "u", "v")


def sources_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``disjoint``: whether no source of ``a`` is one of ``b``."""
    common = a.select("u").join(b.select("u").distinct(), "u", "left_semi")
    return common.agg((F.count(F.lit(1)) == 0).alias("disjoint"))


def compare_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer comparison of two label maps: ``(node, left_component, right_component, status)``.

    ``status`` is ``same``, ``differs``, ``left_only`` or ``right_only``.
    """
    x = a.select("node", F.col("component").alias("left_component"))
    y = b.select("node", F.col("component").alias("right_component"))
    status = (
        F.when(F.col("right_component").isNull(), "left_only")
        .when(F.col("left_component").isNull(), "right_only")
        .when(F.col("left_component") == F.col("right_component"), "same")
        .otherwise("differs")
    )
    return x.join(y, "node", "full_outer").withColumn("status", status)
