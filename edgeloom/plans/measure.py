"""Priority-queue work of sequential forward contraction, by the neighbour it contracts to.

The order of operations is part of what is measured, so this runs in one task over an edge list of a checked size.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from edgeloom.operators.transforms import normalize

RULES = ("first", "random", "last")
MAX_EDGES = 2_000_000


def contract_in_order(edges: list[tuple[int, int]], rule: str, seed: int = 0, limit: int | None = None) -> tuple:
    """``(node, neighbours, duplicates, target)`` of every source in ascending order, and the queue's operations.

    With a limit: of the sources up to it, and as a third the edges left over.
    """
    rng, rows, operations = random.Random(seed), [], 0
    heap = list(edges)
    heapq.heapify(heap)
    while heap and (limit is None or heap[0][0] <= limit):
        node, around, duplicates = heap[0][0], [], 0
        while heap and heap[0][0] == node:
            to = heapq.heappop(heap)[1]
            operations += 1
            if around and around[-1] == to:
                duplicates += 1
            else:
                around.append(to)
        target = around[{"first": 0, "last": -1}.get(rule, rng.randrange(len(around)))]
        for other in around:
            if other != target:
                heapq.heappush(heap, (min(other, target), max(other, target)))
        rows.append((node, len(around), duplicates, target))
    return (rows, operations) if limit is None else (rows, operations, heap)


def measure_forward(edges: DataFrame, rule: str = "last", seed: int = 0, max_edges: int = MAX_EDGES) -> DataFrame:
    """Rows ``(node, neighbours, duplicates, target)``; the queue's operations are ``sum(neighbours + duplicates)``.

    Fails beyond ``max_edges``: the measurement is sequential by definition.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    tidy = normalize(edges)
    if (m := tidy.count()) > max_edges:
        raise ValueError(f"{m} edges; the sequential measurement takes {max_edges} at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows, *_ = contract_in_order(pairs, rule, seed)
        names = ("node", "neighbours", "duplicates", "target")
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

    return tidy.repartition(1).mapInArrow(run, "node long, neighbours long, duplicates long, target long")
