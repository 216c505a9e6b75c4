"""Result checkers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stars_only(labels: DataFrame) -> DataFrame:
    """One row ``stars_only``: sources are unique, and no node that has another label is used as a label."""
    per = labels.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") != F.col("component")).alias("inner"))
    used = labels.where("node <> component").select(F.col("component").alias("node")).distinct().withColumn("used", F.lit(True))
    bad = (F.col("n") > 1) | (F.col("inner") & F.coalesce("used", F.lit(False)))
    return per.join(used, "node", "left").agg((F.count(F.when(bad, 1)) == 0).alias("stars_only"))


def invalid_edges(edges: DataFrame) -> DataFrame:
    """Edges with an end below 1."""
    return edges.where(F.least("u", "v") < 1)


def canonical(labels: DataFrame, representative: str = "min") -> DataFrame:
    """The same partition, each component named by its smallest or largest node."""
    pick = F.min if representative == "min" else F.max
    names = labels.groupBy("component").agg(pick("node").alias("__name"))
    return labels.join(names, "component").select("node", F.col("__name").alias("component"))


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``same``: whether two label maps cover the same nodes with the same partition, whatever the names."""
    x = canonical(a).select("node", F.col("component").alias("x"))
    y = canonical(b).select("node", F.col("component").alias("y"))
    differ = ~F.col("x").eqNullSafe(F.col("y"))
    return x.join(y, "node", "full_outer").agg((F.count(F.when(differ, 1)) == 0).alias("same"))


def compare_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row about two label files: rows, repeated nodes, nodes on one side only, labels that differ, largest ids."""

    def one(df: DataFrame, p: str) -> DataFrame:
        per = df.groupBy("node").agg(F.count(F.lit(1)).alias(f"{p}n"), F.min("component").alias(f"{p}c"))
        return per

    both = one(a, "l").join(one(b, "r"), "node", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.agg(
        zero(F.sum("ln")).alias("left_rows"),
        zero(F.sum("rn")).alias("right_rows"),
        zero(F.sum(F.col("ln") - 1)).alias("left_repeats"),
        zero(F.sum(F.col("rn") - 1)).alias("right_repeats"),
        F.count_if(F.col("rn").isNull()).alias("left_only"),
        F.count_if(F.col("ln").isNull()).alias("right_only"),
        F.count_if(F.col("lc") != F.col("rc")).alias("labels_differ"),
        F.max(F.when(F.col("ln").isNotNull(), F.col("node"))).alias("left_max"),
        F.max(F.when(F.col("rn").isNotNull(), F.col("node"))).alias("right_max"),
    )


def id_gaps(labels: DataFrame) -> DataFrame:
    """One row: how many ids between the smallest and largest node have no row."""
    return labels.agg((F.max("node") - F.min("node") + 1 - F.countDistinct("node")).alias("gaps"))
