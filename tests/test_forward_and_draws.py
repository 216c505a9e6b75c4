"""First-k forward contraction against the sequential one; draws, positions and generators against what defines them."""

import random

import pytest
from pyspark.sql import functions as F

from edgeloom.functions.hashing import M32, mixed_hash_32
from edgeloom.operators import ordering, transforms
from edgeloom.plans.contraction import forward_first, tree_to_stars
from edgeloom.plans.measure import contract_in_order
from edgeloom.sources import generators
from edgeloom.sources.edges import from_values, scan_report


def mixed(seed, *keys):
    h = seed
    for k in keys:
        k %= 1 << 64
        h ^= (k & M32) ^ (0x9E3779B1 * (k >> 32) & M32)
        for multiplier, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
            h = multiplier * h & M32
            h ^= h >> shift
    return h


def test_mixed_hash(spark):
    rows = [(0, 0), (1, 2), (-1, 5), (2**62 + 7, -(2**63)), (123456789012, 3)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", mixed_hash_32(7, F.col("a"), F.col("b"))).collect()]
    assert got == [(a, b, mixed(7, a, b)) for a, b in rows]


def graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(1, n + 1), 2))) for _ in range(m)})


@pytest.mark.parametrize(("edges", "in_order"), [([(1, 2), (1, 3), (2, 4), (3, 4)], 100), (graph(1, 60, 50), 10), (graph(2, 40, 90), 20), ([(i, i + 1) for i in range(1, 20)], 15)])
def test_forward_first(spark, edges, in_order):
    """Tree and leftover of the k smallest sources are those of one contraction after the other."""
    whole, *_ = contract_in_order(edges, "last")
    for k in (1, 2, 9, 0):
        taken = whole[:k] if k else whole
        limit = taken[-1][0]
        _, _, left = contract_in_order(edges, "last", limit=limit)
        tree, rest = forward_first(from_values(spark, edges), k, in_order)
        assert sorted(tuple(r) for r in tree.collect()) == sorted((r[0], r[3]) for r in taken)
        assert sorted(tuple(r) for r in rest.collect()) == sorted(set(left))
    labels = {r[0]: r[1] for r in tree_to_stars(forward_first(from_values(spark, edges), 0)[0]).collect()}
    assert all(labels[u] == labels[v] >= max(u, v) for u, v in edges)


def test_forward_first_of_nothing(spark):
    tree, rest = forward_first(from_values(spark, []), 5)
    assert tree.count() == rest.count() == 0


def test_positions_of_few_values(spark):
    """One value in most rows: positions still follow the other columns."""
    rng = random.Random(8)
    rows = [(5 if rng.random() < 0.8 else rng.randrange(10), i) for i in rng.sample(range(5000), 3000)]
    got = sorted(tuple(r) for r in ordering.with_position(from_values(spark, rows).repartition(7), ["u", "v"], "p", start=2).collect())
    assert got == [(u, v, i + 2) for i, (u, v) in enumerate(sorted(rows))]


def test_gilbert(spark):
    """Every pair is drawn alike: edges follow the binomial law, over all rows and columns; each pair once."""
    n, density = 400, 10.0
    counts, seen = [], {}
    for seed in range(20):
        edges = [tuple(r) for r in generators.gilbert(spark, n, density, seed, block_edges=100).collect()]
        assert len(set(edges)) == len(edges) and all(1 <= u < v <= n for u, v in edges)
        counts.append(len(edges))
        for u, v in edges:
            seen[u] = seen.get(u, 0) + 1
            seen[v] = seen.get(v, 0) + 1
    mean, p = density * n, 2 * density / (n - 1)
    assert abs(sum(counts) / 20 - mean) < 4 * (mean * (1 - p) / 20) ** 0.5
    var = sum((c - mean) ** 2 for c in counts) / 20
    assert 0.3 * mean < var < 2.5 * mean
    assert min(seen.values()) > 250 and max(seen.values()) < 560
    full = generators.gilbert(spark, 9, 4.0, 1)
    assert sorted(tuple(r) for r in full.collect()) == [(u, v) for u in range(1, 10) for v in range(u + 1, 10)]
    assert generators.gilbert(spark, 1, 1.0, 1).count() == 0


def test_scan_report(spark):
    assert tuple(scan_report(from_values(spark, [(1, 2), (1, 2), (2, 1), (1, 2)])).head()) == (4, 2, 2)
    assert tuple(scan_report(from_values(spark, [])).head()) == (0, 0, 0)


def test_tee_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = spark.range(50).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).mapInArrow(count, "u long, v long")
    a, b = transforms.tee(e, lambda x: x.where("u < 10"), lambda x: x.agg(F.sum("v").alias("s")))
    assert a.count() == 10 and b.head()[0] == 1275 and seen.value == 50
