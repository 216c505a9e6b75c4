"""Connected components: shrink the graph until one task can solve it, solve it, and carry the labels back.

Nothing recurses over data: a driver loop looks at counts of checkpointed tables, every step is a DataFrame program, and
the base case runs only on an edge list whose size has been checked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import quick_hash_32
from edgeloom.operators import joins, sampling
from edgeloom.operators.aggregates import unique_nodes
from edgeloom.operators.checks import canonical
from edgeloom.operators.transforms import normalize
from edgeloom.plans.contraction import STRATEGIES, forward_first, large_star, small_star, tree_to_stars
from edgeloom.plans.kernel import forest, solve_locally
from edgeloom.plans.policies import POLICIES
from edgeloom.session import stable_in_loop as stable

#: Edges that one task solves in memory: about 50 bytes each in the kernel.
BASE_CASE_EDGES = 2_000_000
MAX_ROUNDS = 200

ALGORITHMS = ("auto", "local", "boruvka", "kkt", "star", "forward", "bundles", "functional")


def connected_components(
    edges: DataFrame,
    algorithm: str = "auto",
    representative: str = "max",
    policy: int = 0,
    contraction: str = "forward",
    seed: int = 0,
    base_case_edges: int = BASE_CASE_EDGES,
    **options: int,
) -> DataFrame:
    """One row ``(node, component)`` for every node of an edge, named by its component's largest or smallest node.

    algorithm: ``local`` reduces every partition to a spanning forest until one task can finish; ``forward`` alternates
    large and small stars; ``boruvka``, ``kkt``, ``star`` and ``bundles`` loop over their contraction; ``functional``
    contracts, samples, solves the two halves and composes the maps, steered by ``policy`` and ``contraction``;
    ``auto`` is ``local`` for what fits one task and ``forward`` beyond. All give the same result.

    Edges may come in any orientation and order, with repeats. A self-loop makes its node a component by itself if nothing
    else does. Rows with a null end are no edges. No edges give no rows.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {', '.join(ALGORITHMS)}")
    if representative not in ("min", "max"):
        raise ValueError("representative must be min or max")
    source = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna()
    tidy = stable(normalize(source))
    m = tidy.count()
    if algorithm == "auto":
        algorithm = "local" if m <= base_case_edges else "forward"
    if algorithm == "local" or m <= base_case_edges:
        labels = _local(tidy, m, base_case_edges)
    elif algorithm == "forward":
        labels = _alternate(tidy, base_case_edges)
    elif algorithm == "functional":
        labels = _functional(tidy, m, contraction, policy, seed, 0, base_case_edges, options)
    else:
        labels = _loop(tidy, algorithm, seed, base_case_edges, options)
    loops = source.where("u = v").select(F.col("u").alias("node")).distinct()
    alone = loops.join(unique_nodes(tidy), "node", "left_anti").select("node", F.col("node").alias("component"))
    return canonical(labels, representative).unionByName(alone)


def star_components(edges: DataFrame, representative: str = "min") -> DataFrame:
    """``connected_components`` by DataFrame operations alone: large and small stars to the end, without the local kernel."""
    source = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna()
    labels = _alternate(stable(normalize(source)), base=-1)
    alone = source.where("u = v").select(F.col("u").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    return canonical(labels, representative).unionByName(alone.select("node", F.col("node").alias("component")))


def _local(edges: DataFrame, m: int, base: int) -> DataFrame:
    """Partition-local forests until the rest fits one task; falls back to stars if they stop shrinking."""
    while m > base:
        fewer = stable(normalize(forest(edges)))
        left = fewer.count()
        if left > 0.7 * m:
            return _alternate(fewer, base)
        edges, m = fewer, left
    return solve_locally(edges)


def _alternate(edges: DataFrame, base: int) -> DataFrame:
    """Large and small stars in turn: every round keeps all nodes and their connectivity; ends as stars on the maximum."""
    nodes = unique_nodes(edges)
    for _ in range(MAX_ROUNDS):
        m = edges.count()
        if m <= base:
            solved = solve_locally(edges)
            return nodes.join(solved, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        after = stable(small_star(large_star(edges)))
        if after.count() == m and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            stars = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        edges = after
    raise RuntimeError("stars did not settle")


def _loop(edges: DataFrame, name: str, seed: int, base: int, options: dict) -> DataFrame:
    maps: list[DataFrame] = []
    for round_ in range(MAX_ROUNDS):
        m = edges.count()
        if m <= base:
            break
        step = "boruvka" if name == "bundles" and round_ else name
        edges, labels = STRATEGIES[step](edges, seed=seed + round_, **(options if step == name else {}))
        maps.append(labels)
    else:
        raise RuntimeError("contraction did not settle")
    labels = solve_locally(edges)
    # a strategy's map holds every node of its round, so none is known to the later maps alone
    for m in reversed(maps):
        labels = stable(joins.relabel_labels(m, labels))
    return labels


def _fold(maps: list[DataFrame], last: DataFrame) -> DataFrame:
    """The maps and the last labels composed. Each composition reads the next twice, so it is written down: plans stay small."""
    labels = last
    for m in reversed(maps):
        labels = joins.compose(m, stable(labels))
    return labels


def _functional(edges: DataFrame, m: int, contraction: str, policy: int, seed: int, level: int, base: int, options: dict) -> DataFrame:
    """CC(G) = contraction, then CC(left sample), then CC(the rest contracted by it), composed."""
    if m <= base or level >= 40:
        return _local(edges, m, base)
    rules = POLICIES[policy]
    memory = max(1, base // 2)
    n = unique_nodes(edges).count()
    maps: list[DataFrame] = []
    if rules.contract(n, m, level, memory):
        goal = n - rules.nodes_to_contract(n, m, level, memory)
        if contraction == "forward" and n > goal:
            # exactly so many nodes as the policy asks for
            tree, edges = forward_first(edges, n - goal)
            maps.append(stable(tree_to_stars(tree)))
            m, n = edges.count(), goal
            if not m:
                return _fold(maps[:-1], maps[-1])
        for round_ in range(MAX_ROUNDS if n > goal and m > base else 0):
            edges, labels = STRATEGIES[contraction](edges, seed=seed + 31 * level + round_, **options)
            maps.append(labels)
            m = edges.count()
            if not m:
                return _fold(maps[:-1], maps[-1])
            n = unique_nodes(edges).count()
            if m <= base or n <= goal:
                break
        if m <= base:
            return _fold(maps, solve_locally(edges))
    power = rules.sample_power(n, m, level, memory)
    left, right = sampling.split_edges(edges, power, seed + 1009 * (level + 1), quick_hash_32)
    left, right = stable(left), stable(right)
    of_left = stable(_functional(left, left.count(), contraction, policy, seed + 1, level + 1, base, options))
    rest = stable(joins.contract_stars(right, of_left))
    of_right = stable(_functional(rest, rest.count(), contraction, policy, seed + 2, level + 1, base, options))
    # an edge may join nodes that neither half labels any more (it became a loop), so all nodes start as themselves
    merged = joins.compose(of_left, of_right)
    whole = unique_nodes(edges).join(merged, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return _fold(maps, whole)


def base_case_limit(memory_bytes: int, overhead: int = 50) -> int:
    """Edges that fit the base case within so much memory."""
    return max(1, math.floor(memory_bytes / overhead))
