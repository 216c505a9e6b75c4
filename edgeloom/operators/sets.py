"""Unions and merges of edge lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.transforms import orient_small_to_large


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; order them at a sink if order is wanted."""
    return a.unionByName(b)


def merge_unique(a: DataFrame, b: DataFrame) -> DataFrame:
    """The set union of two row sets."""
    return a.unionByName(b).distinct()


def merge_with(a: DataFrame, b: DataFrame, extract_a: dict[str, Column], extract_b: dict[str, Column]) -> DataFrame:
    """Rows of two inputs of different shape, each built by its own expressions."""
    pick = lambda df, x: df.select(*[c.alias(k) for k, c in x.items()])
    return pick(a, extract_a).unionByName(pick(b, extract_b))


def merge_edges(*inputs: DataFrame) -> DataFrame:
    """Many edge lists as one: oriented small to large and distinct. Self-loops stay."""
    return reduce(DataFrame.unionByName, [orient_small_to_large(e) for e in inputs]).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of ``a`` that are not in ``b``."""
    return a.select("u", "v").distinct().join(b.select("u", "v").distinct(), ["u", "v"], "left_anti")


def disjoint_union(*inputs: DataFrame) -> DataFrame:
    """Rows tagged with the number of the input they came from."""
    return reduce(DataFrame.unionByName, [e.withColumn("input", F.lit(i)) for i, e in enumerate(inputs)])
