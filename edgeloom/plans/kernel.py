"""Union-find over Arrow batches: the base case, and the partition-local reduction to a spanning star forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task's forest is handed on and started anew beyond this many nodes, which bounds the kernel's memory.
FOREST_NODES = 4_000_000


def components_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(nodes, smallest node of each one's component)``: hooking onto smaller roots and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        keep = ra != rb
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``(u, v)`` to rows ``(node, component)``; a task without overflow gives one row for each of its nodes.

    If the nodes exceed ``FOREST_NODES`` the forest so far is emitted and a new one begun: the rows are then edges of
    the same graph, still far fewer than the input, but no longer final labels.
    """
    nodes = roots = np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> None:
        nonlocal nodes, roots, size
        u = np.concatenate([nodes, *[x for x, _ in held]])
        v = np.concatenate([roots, *[x for _, x in held]])
        nodes, roots = components_of(u, v)
        held.clear()
        size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_pydict({"node": nodes[i : i + 100_000], "component": roots[i : i + 100_000]})

    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
        size += b.num_rows
        if size >= 1_000_000:
            fold()
            if len(nodes) > FOREST_NODES:
                yield from out()
                nodes = roots = np.empty(0, np.int64)
    if held:
        fold()
    yield from out()


def forest(edges: DataFrame) -> DataFrame:
    """A spanning star forest of each partition, as edges ``(u, v)``; ``u = v`` rows are roots."""
    return edges.select("u", "v").mapInArrow(local_forest, "node long, component long").toDF("u", "v")


def solve_locally(edges: DataFrame) -> DataFrame:
    """Labels ``(node, smallest node)`` by one task. For edge lists of a checked size only."""
    # a repartition, not a coalesce: what comes before keeps its own parallelism
    labels = edges.select("u", "v").repartition(1).mapInArrow(local_forest, "node long, component long")
    return labels.groupBy("node").agg(F.min("component").alias("component"))
