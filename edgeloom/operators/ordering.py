"""Orders, positions, shuffles and sortedness tests.

Order is never part of a result in Spark, so nothing here is used between operators; these serve sinks and explicit
requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import mixed_hash_32
from edgeloom.session import stable

#: Named ascending orders of nodes, edges, labels and ranked edges; ``_columns`` adds those that are not plain columns.
ORDERS: dict[str, list[str]] = {
    "node": ["node"],
    "edge": ["u", "v"],
    "target": ["v", "u"],
    "component": ["component", "node"],
    "label": ["node", "component"],
    "rank": ["rank", "u", "v"],
}


def order_by(df: DataFrame, name: str) -> DataFrame:
    """``df`` in a named order (``ORDERS``, or edge_desc, source_max_target, undirected): an external sort with spill."""
    return df.orderBy(*_columns(name))


def _columns(name: str) -> list[Column]:
    if name == "edge_desc":
        return [F.desc("u"), F.desc("v")]
    if name == "source_max_target":
        return [F.asc("u"), F.desc("v")]
    if name == "undirected":
        return [F.least("u", "v"), F.greatest("u", "v")]
    return [F.col(c) for c in ORDERS[name]]


def shuffle_rows(edges: DataFrame, seed: int) -> DataFrame:
    """A random order that depends on ``seed`` and the rows (integer columns) only, so a retried task gives the same order."""
    return edges.orderBy(*shuffle_order(seed, edges.columns))


def shuffle_order(seed: int, columns: list[str]) -> list[Column]:
    """What ``shuffle_rows`` sorts by: a hash of the row, and the row where hashes tie."""
    return [mixed_hash_32(seed, *[F.col(c) for c in columns]), *[F.col(c) for c in columns]]


def with_position(df: DataFrame, order: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """Adds the running position in ``order`` from ``start``.

    Rows are sorted into range partitions by all order columns, as many as Spark's shuffle asks for, and written down; each
    partition numbers its own rows, and their starts come from a prefix sum over one row a partition. So no task ever sees
    all rows, however few values a column has, and the input is computed once for its sample and once for the sort.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id()  # the partition above, the row's place in it below
    cut = stable(ranged.withColumn("__id", within).withColumn("__part", F.shiftright("__id", 33)).withColumn("__local", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"))
    starts = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    # one row for each partition of the shuffle
    out = cut.join(F.broadcast(starts), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__local") + F.lit(start)).drop("__part", "__local", "__start")


def is_sorted(df: DataFrame, order: list[str], position: str, strict: bool = True) -> DataFrame:
    """One row ``is_sorted``: whether ``order`` rises along the ``position`` column (strictly by default).

    Compares each row with the next by joining on the position, so no window over all rows is needed; positions must
    be consecutive integers, as ``with_position`` gives them.
    """
    key = F.struct(*order)
    here = df.select(F.col(position).alias("p"), key.alias("k"))
    after = df.select((F.col(position) - 1).alias("p"), key.alias("next"))
    bad = F.col("next") <= F.col("k") if strict else F.col("next") < F.col("k")
    return here.join(after, "p").agg((F.count(F.when(bad, 1)) == 0).alias("is_sorted"))
