"""Every algorithm on every generator, against union-find; and the properties of components."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeloom import connected_components
from edgeloom.operators import checks
from edgeloom.plans import components, contraction, measure
from edgeloom.plans.components import ALGORITHMS, star_components
from edgeloom.plans.kernel import components_of
from edgeloom.sources import generators


def union_find(edges, pick=max):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return sorted((x, pick(g)) for g in groups.values() for x in g)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def graphs(spark):
    return {
        "path": (generators.path(spark, 65), 1),
        "grid": (generators.grid(spark, 7, 6), 1),
        "cube": (generators.cube(spark, 5, 4, 3, 1), 3),
        "cliques": (generators.cliques(spark, 6, 9), 9),
        "gilbert": (generators.gilbert(spark, 120, 0.7, 3), None),
    }


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_algorithms_agree(spark, algorithm):
    for name, (e, expected) in graphs(spark).items():
        if algorithm == "star" and name != "cliques":
            continue
        got = rows(connected_components(e, algorithm, base_case_edges=20, seed=4))
        assert got == union_find(rows(e)), (algorithm, name)
        if expected:
            assert len({c for _, c in got}) == expected


@pytest.mark.parametrize("policy", [0, 3, 6, 9])
def test_policies_agree(spark, policy):
    e = generators.gilbert(spark, 150, 1.5, 5)
    got = connected_components(e, "functional", contraction="boruvka", policy=policy, base_case_edges=40, representative="min")
    assert rows(got) == union_find(rows(e), min)


def test_generator_sizes(spark):
    assert generators.path(spark, 10).count() == 9 and generators.path(spark, 0).count() == 0
    assert generators.grid(spark, 5, 4).count() == 4 * 4 + 5 * 3
    w, h, layers = 5, 4, 3
    assert generators.cube(spark, w, h, layers).count() == layers * (h * (w - 1) + w * (h - 1) + 2 * (w - 1) * (h - 1))
    assert generators.cliques(spark, 5, 7).count() == 7 * 10
    a, b, c = (rows(generators.gilbert(spark, 100, 2.0, s)) for s in (1, 1, 2))
    assert a == b != c and all(1 <= u < v <= 100 for u, v in a)


def test_edge_cases(spark):
    make = lambda r: spark.createDataFrame(r, "u long, v long")
    assert rows(connected_components(make([]))) == []
    assert rows(connected_components(make([(5, 5)]))) == [(5, 5)]
    assert rows(connected_components(make([(None, 1), (1, None), (2, 1), (1, 2), (2, 1), (2, 2), (9, 9)]))) == [(1, 2), (2, 2), (9, 9)]
    top = (1 << 63) - 1
    assert rows(connected_components(make([(top, 1)]))) == [(1, top), (top, top)]
    with pytest.raises(ValueError):
        connected_components(make([]), "other")


edge_lists = st.lists(st.tuples(st.integers(1, 12), st.integers(1, 12)), max_size=25)


@settings(max_examples=60, deadline=None)
@given(edge_lists)
def test_kernel_property(pairs):
    import numpy as np

    u = np.array([p[0] for p in pairs], np.int64)
    v = np.array([p[1] for p in pairs], np.int64)
    nodes, roots = components_of(u, v)
    assert list(zip(nodes.tolist(), roots.tolist(), strict=True)) == union_find(pairs, min)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=edge_lists.filter(len))
def test_property(spark, pairs):
    e = spark.createDataFrame(pairs, "u long, v long")
    want = union_find(pairs)
    assert rows(connected_components(e.union(e.select(F.col("v"), F.col("u"))), "boruvka", base_case_edges=3)) == want


@pytest.mark.parametrize("k", [8, 1024])
def test_one_boruvka_round(spark, k):
    odd = spark.range(k).select((2 * F.col("id") + 1).alias("u"), (2 * F.col("id") + 2).alias("v"))
    left, labels = contraction.boruvka(odd)
    assert left.isEmpty() and labels.select("component").distinct().count() == k
    left, labels = contraction.boruvka(generators.path(spark, k + 1))
    assert left.isEmpty() and {r[0] for r in labels.select("component").distinct().collect()} <= {1, 2}
    assert labels.count() == k + 1


def test_boruvka_round_by_hand(spark):
    e = spark.createDataFrame([(1, 4), (2, 3), (3, 4)], "u long, v long")
    left, labels = contraction.boruvka(e)
    assert rows(checks.canonical(labels)) == [(1, 1), (2, 2), (3, 2), (4, 1)] and left.count() == 1


def test_forward_measure():
    rows_, operations = measure.contract_in_order([(1, 2), (1, 3), (2, 4), (3, 4)], "last")
    assert [(n, t) for n, _, _, t in rows_] == [(1, 3), (2, 4), (3, 4)]
    assert operations == sum(a + d for _, a, d, _ in rows_)


def test_tree_to_stars(spark):
    tree = spark.createDataFrame([(1, 3), (2, 4), (3, 4)], "u long, v long")
    assert rows(contraction.tree_to_stars(tree)) == [(i, 4) for i in range(1, 5)]


def test_minimized_edges_keep_components(spark):
    e = generators.gilbert(spark, 200, 1.2, 9)
    less = contraction.minimized_inter_edges(e, 8, 200)
    assert rows(connected_components(less)) == union_find(rows(e))


def test_stars_alone(spark):
    for e, _ in graphs(spark).values():
        assert rows(star_components(e, "max")) == union_find(rows(e))
    make = lambda r: spark.createDataFrame(r, "u long, v long")
    assert rows(star_components(make([]))) == []
    assert rows(star_components(make([(-5, 3), (3, 3), (8, 8), (None, 1)]))) == [(-5, -5), (3, -5), (8, 8)]


def test_plans_of_many_rounds_stay_small(spark, monkeypatch):
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    e = generators.path(spark, 65)
    labels = connected_components(e, "boruvka", base_case_edges=1)
    assert rows(labels) == union_find(rows(e)) and leaves(labels) < 12
    maps = [spark.createDataFrame([(i, i + 1), (i + 1, i + 1)], "node long, component long") for i in range(9)]
    folded = components._fold(maps, spark.createDataFrame([(9, 9)], "node long, component long"))
    assert rows(folded) == [(i, 9) for i in range(10)] and leaves(folded) < 12
    # a draw is one hash, not a tree of thousands of products
    picks = []
    monkeypatch.setattr(contraction.joins, "break_paths", lambda s: picks.append(s) or s.where("false"))
    contraction.star(e)
    assert len(picks[0]._jdf.queryExecution().optimizedPlan().toString()) < 3000


def test_size_estimates_do_not_grow_over_rounds(spark):
    from edgeloom.session import stable_in_loop

    e = stable_in_loop(spark.range(20).selectExpr("id as u", "id + 1 as v"))
    for _ in range(6):
        e = stable_in_loop(e.join(e.toDF("v", "w"), "v", "left").selectExpr("u", "coalesce(w, v) as v"))
    assert len(str(e._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 40
