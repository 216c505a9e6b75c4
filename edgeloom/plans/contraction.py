"""Contraction strategies: each turns normalized edges into fewer edges and a map of the nodes it merged.

Contract of a strategy: ``contract(edges, seed) -> (contracted edges, labels)``. The labels hold one row for every node of
``edges``; the contracted edges are normalized and use representatives only. Results are checkpointed, so each round's
plan starts from a written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import quick_hash_32
from edgeloom.operators import joins, sampling
from edgeloom.operators.aggregates import min_neighbour, range_bundles, unique_nodes
from edgeloom.operators.ordering import with_position
from edgeloom.operators.transforms import normalize, symmetrize
from edgeloom.plans.kernel import local_forest
from edgeloom.plans.measure import contract_in_order
from edgeloom.session import stable_in_loop as stable

Contracted = tuple[DataFrame, DataFrame]

#: Rounds of pointer jumping; a forest of n nodes needs at most log2(n).
MAX_JUMPS = 64


def resolve_forest(parents: DataFrame) -> DataFrame:
    """Tree rows ``(node, component=parent)`` with roots as their own parents, to rows that name the root.

    Pointer jumping: the depth halves each round, so a path of a billion nodes takes 30 joins.
    """
    labels = stable(parents)
    for _ in range(MAX_JUMPS):
        up = labels.select(F.col("node").alias("__node"), F.col("component").alias("__up"))
        jumped = labels.join(up, F.col("component") == F.col("__node"), "left")
        both = stable(jumped.select("node", F.coalesce("__up", "component").alias("component"), F.col("component").alias("was")))
        labels = both.select("node", "component")
        if both.where("component <> was").isEmpty():
            return labels
    raise RuntimeError("pointer jumping did not settle")


def tree_to_stars(tree: DataFrame, seed_labels: DataFrame | None = None) -> DataFrame:
    """Tree edges ``(u -> v)`` with unique sources, to one row per node naming the root.

    seed_labels: labels of roots that were merged elsewhere; they apply on top. Roots always get a row.
    """
    parents = tree.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = parents.select(F.col("component").alias("node")).distinct().join(parents.select("node"), "node", "left_anti")
    labels = resolve_forest(parents.unionByName(roots.select("node", F.col("node").alias("component"))))
    return labels if seed_labels is None else joins.compose(labels, seed_labels)


def _finish(edges: DataFrame, labels: DataFrame) -> Contracted:
    labels = stable(labels)
    return stable(joins.contract_stars(edges, labels)), labels


def boruvka(edges: DataFrame, seed: int = 0) -> Contracted:
    """Every node picks its smallest neighbour; each resulting tree becomes one node. At least halves the nodes."""
    picked = stable(min_neighbour(edges))
    back = picked.select(F.col("node").alias("__n"), F.col("neighbour").alias("__back"))
    mutual = (F.col("__back") == F.col("node")) & (F.col("node") < F.col("neighbour"))
    parents = picked.join(back, F.col("neighbour") == F.col("__n")).select(
        "node", F.when(mutual, F.col("node")).otherwise(F.col("neighbour")).alias("component")
    )
    return _finish(edges, resolve_forest(parents))


def kkt(edges: DataFrame, seed: int = 0) -> Contracted:
    """Three rounds of the above, ended early when no edge is left."""
    edges, labels = boruvka(edges, seed)
    for _ in range(2):
        if edges.isEmpty():
            break
        edges, more = boruvka(edges, seed)
        labels = joins.compose(labels, more)
    return edges, stable(labels)


def star(edges: DataFrame, seed: int = 0, probability: float = 0.5) -> Contracted:
    """Sources drawn by a coin pick a random neighbour; picks that would form paths are dropped; stars merge."""
    picks = stable(joins.break_paths(sampling.random_neighbour(edges, probability, seed, quick_hash_32)))
    moved = picks.select(F.col("u").alias("node"), F.col("v").alias("component"))
    rest = unique_nodes(edges).join(moved.select("node"), "node", "left_anti")
    return _finish(edges, moved.unionByName(rest.select("node", F.col("node").alias("component"))))


def large_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node to its largest neighbour (itself included): forward contraction's step."""
    sym = symmetrize(edges)
    top = sym.groupBy("u").agg(F.max(F.greatest("u", "v")).alias("top"))
    return sym.where("v < u").join(top, "u").select(F.col("v").alias("u"), F.col("top").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its larger neighbours to the largest of these."""
    low = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    top = low.groupBy("u").agg(F.max("v").alias("top"))
    moved = low.join(top, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("top").alias("v"))
    return moved.where("u <> v").distinct()


def forward(edges: DataFrame, seed: int = 0) -> Contracted:
    """Every node with a larger neighbour merges into its largest: one parallel round of forward contraction."""
    top = edges.groupBy("u").agg(F.max("v").alias("v"))
    return _finish(edges, tree_to_stars(top))


#: Edges below the limit that one task contracts in order; more are contracted in rounds first.
IN_ORDER_EDGES = 2_000_000


def forward_first(edges: DataFrame, k: int, in_order_edges: int = IN_ORDER_EDGES) -> tuple[DataFrame, DataFrame]:
    """Contracts the k smallest sources, in ascending order, each into its largest neighbour; ``k = 0`` contracts all.

    Returns the tree ``(u, v)`` of the contracted sources and the edges left over among the other nodes, both normalized.
    A node is a source if it has a larger neighbour when its turn comes: the neighbours it had, and those that contracted
    ones have sent it (the other neighbours of a contracted node go on to its target).

    Nodes that no smaller one is joined to have all their edges, so they are contracted together, round by round. Once few
    edges below the limit are left, one task contracts the rest in order. Long ascending paths take a round a node until then.
    """
    edges, tree, done = stable(normalize(edges)), None, 0
    while not edges.isEmpty():
        if k:
            # of all nodes left, the smallest that may still be sources; those that turn out to be none are made up for
            limit = with_position(unique_nodes(edges), ["node"]).where(F.col("pos") < k - done).agg(F.max("node")).head()[0]
        else:
            limit = edges.agg(F.max("u")).head()[0]
        low = edges.where(F.col("u") <= limit)
        while (m := low.count()) > in_order_edges:
            first = edges.where(F.col("u") <= limit).select("u").distinct().join(edges.select(F.col("v").alias("u")), "u", "left_anti")
            top = stable(edges.join(first, "u", "left_semi").groupBy("u").agg(F.max("v").alias("top")))
            sent = edges.join(top, "u").where("v <> top").select(F.least("v", "top").alias("u"), F.greatest("v", "top").alias("v"))
            tree = top.toDF("u", "v") if tree is None else stable(tree.unionByName(top.toDF("u", "v")))
            edges = stable(edges.join(top, "u", "left_anti").unionByName(sent).distinct())
            low = edges.where(F.col("u") <= limit)
        if m:
            both = stable(low.repartition(1).mapInArrow(partial(_contract_up_to, limit=limit), "u long, v long, tree boolean"))
            mine = both.where("tree").select("u", "v")
            tree = mine if tree is None else stable(tree.unionByName(mine))
            edges = stable(edges.where(F.col("u") > limit).unionByName(both.where("not tree").select("u", "v")).distinct())
        done = tree.count()
        if k and done >= k:
            break
    return (edges.limit(0) if tree is None else tree), edges


def _contract_up_to(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    rows, _, left = contract_in_order(pairs, "last", limit=limit)
    out = [(r[0], r[3], True) for r in rows] + [(u, v, False) for u, v in left]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["u", "v", "tree"])


def bundles(edges: DataFrame, seed: int = 0, num_bundles: int = 64) -> Contracted:
    """Merges what is connected inside id ranges, all ranges at once: one shuffle by range, then a streamed kernel."""
    top = edges.agg(F.max(F.greatest("u", "v"))).head()[0]
    if top is None:
        return edges, unique_nodes(edges).select("node", F.col("node").alias("component"))
    ranged = range_bundles(edges, num_bundles, top).where("intra")
    local = ranged.repartition("bundle").select("u", "v").mapInArrow(local_forest, "node long, component long")
    # a task that emitted several forests leaves a node several labels; the smallest is still in its component
    merged = local.groupBy("node").agg(F.min("component").alias("component")).where("node <> component")
    tree = merged.select(F.col("node").alias("u"), F.col("component").alias("v"))
    inner = tree_to_stars(tree)
    rest = unique_nodes(edges).join(inner.select("node"), "node", "left_anti")
    return _finish(edges, inner.unionByName(rest.select("node", F.col("node").alias("component"))))


def minimized_inter_edges(edges: DataFrame, num_bundles: int, max_id: int) -> DataFrame:
    """Edges from several nodes of one bundle to one target, replaced by a path through these nodes and one such edge.

    Keeps connectivity and leaves a single edge between the bundle and each target. Needs ``u < v``.
    """
    inter = range_bundles(edges, num_bundles, max_id)
    before = F.lag("u").over(Window.partitionBy("bundle", "v").orderBy("u"))
    after = F.lead("u").over(Window.partitionBy("bundle", "v").orderBy("u"))
    linked = inter.where(~F.col("intra")).select("u", "v", before.alias("before"), after.alias("after"))
    # all but the last node point at the next one; the last keeps the edge
    path = linked.select(F.col("u"), F.coalesce("after", "v").alias("v"))
    return inter.where("intra").select("u", "v").unionByName(path).distinct()


STRATEGIES: dict[str, Callable[..., Contracted]] = {
    "boruvka": boruvka,
    "kkt": kkt,
    "star": star,
    "forward": forward,
    "bundles": bundles,
}
