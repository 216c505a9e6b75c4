"""Operators on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import sketches
from edgeloom.functions.coins import power_of_two_coin
from edgeloom.operators import aggregates, checks, filters, joins, ordering, sampling, sets, transforms
from edgeloom.plans.policies import POLICIES, bundle_count


def E(spark, *rows):
    return spark.createDataFrame(list(rows), "u long, v long")


def M(spark, *rows):
    return spark.createDataFrame(list(rows), "node long, component long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_anti_join_hits(spark):
    hits = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6)], "node long")
    assert rows(filters.without_hits(E(spark, (0, 2), (1, 4), (2, 5), (7, 8)), "u", hits)) == [(0, 2), (7, 8)]


def test_dedup(spark):
    assert rows(filters.dedup_equal(E(spark, (1, 2), (1, 2), (1, 2), (2, 3), (2, 3), (3, 4)))) == [(1, 2), (2, 3), (3, 4)]
    pairs = E(spark, (1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 5))
    assert rows(filters.dedup_undirected(pairs)) == [(1, 2), (3, 4), (5, 6)]


def test_merge(spark):
    a, b = E(spark, (1, 2), (3, 4)), E(spark, (1, 2), (5, 6))
    assert rows(sets.merge_unique(a, b)) == [(1, 2), (3, 4), (5, 6)]
    assert rows(sets.merge(a, b)) == [(1, 2), (1, 2), (3, 4), (5, 6)]
    assert rows(sets.merge_edges(E(spark, (2, 1), (4, 4)), E(spark, (1, 2)))) == [(1, 2), (4, 4)]


def test_clean_and_report(spark):
    e = E(spark, (3, 1), (2, 2), (1, 2), (1, 2), (2, 2))
    assert rows(filters.clean(e)) == [(1, 2), (3, 1)]
    assert rows(filters.clean_report(e)) == [(5, 2, 1, 2)]
    assert rows(filters.clean_report(E(spark))) == [(0, 0, 0, 0)]


def test_break_paths_and_star_contraction(spark):
    sample = E(spark, (1, 3), (3, 5), (4, 5))
    kept = joins.break_paths(sample)
    assert rows(kept) == [(1, 3), (4, 5)]
    stars = kept.toDF("node", "component")
    assert rows(joins.contract_stars(E(spark, (1, 2), (1, 3), (3, 5), (4, 5)), stars)) == [(2, 3), (3, 5)]


def test_compose(spark):
    left = M(spark, (1, 3), (3, 3), (4, 5), (5, 5))
    right = M(spark, (2, 2), (3, 2), (5, 2))
    assert rows(joins.compose(left, right)) == [(i, 2) for i in range(1, 6)]


def test_histograms(spark):
    for labels in (M(spark, (1, 3), (2, 3)), M(spark, (1, 3), (2, 3), (3, 3))):
        assert rows(aggregates.component_size_histogram(labels)) == [(3, 1)]
    assert rows(aggregates.degree_distribution(E(spark, (1, 2), (1, 3)))) == [(1, 2), (2, 1)]


def test_checks(spark):
    assert checks.stars_only(M(spark, (1, 3), (3, 3), (2, 3))).head()[0]
    assert not checks.stars_only(M(spark, (1, 3), (3, 4))).head()[0]
    assert not checks.stars_only(M(spark, (1, 3), (1, 4))).head()[0]
    assert rows(checks.invalid_edges(E(spark, (0, 1), (1, 2)))) == [(0, 1)]
    assert checks.same_partition(M(spark, (1, 2), (2, 2), (3, 3)), M(spark, (1, 1), (2, 1), (3, 3))).head()[0]
    assert not checks.same_partition(M(spark, (1, 2), (2, 2)), M(spark, (1, 1), (2, 2))).head()[0]
    assert checks.id_gaps(M(spark, (1, 1), (4, 4))).head()[0] == 2


def test_positions(spark):
    e = E(spark, *[(i % 7, i) for i in range(200)])
    got = [tuple(r) for r in ordering.with_position(e, ["u", "v"], "p").orderBy("p").collect()]
    assert [r[2] for r in got] == list(range(200))
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)
    assert ordering.is_sorted(ordering.with_position(e, ["u", "v"], "p"), ["u", "v"], "p").head()[0]
    assert not ordering.is_sorted(ordering.with_position(e, ["v"], "p"), ["u"], "p").head()[0]
    assert ordering.with_position(E(spark), ["u", "v"]).count() == 0


def test_orders_and_cuts(spark):
    e = E(spark, (2, 1), (1, 5), (1, 3))
    assert [tuple(r) for r in ordering.order_by(e, "source_max_target").collect()] == [(1, 5), (1, 3), (2, 1)]
    assert [tuple(r) for r in ordering.order_by(e, "undirected").collect()] == [(2, 1), (1, 3), (1, 5)]
    assert [tuple(r) for r in ordering.order_by(e, "edge_desc").collect()] == [(2, 1), (1, 5), (1, 3)]
    assert rows(filters.first_k_sources(e, 1)) == [(1, 3), (1, 5)]
    assert rows(filters.first_k_sources(e, 9)) == rows(e)
    assert rows(transforms.push_until(e, F.col("v") == 5, ["u", "v"])) == [(1, 3)]
    assert rows(transforms.push_until(e, F.col("v") == 77, ["u", "v"])) == rows(e)


STAR = [(0, 1), (0, 3), (0, 5), (0, 6)]


def test_random_neighbour_is_uniform(spark):
    runs = 400
    pick = [F.min_by("v", F.xxhash64(F.lit(s), "u", "v")).alias(str(s)) for s in range(runs)]
    got = list(E(spark, *STAR).agg(*pick).head())
    for v in (1, 3, 5, 6):
        assert abs(got.count(v) - runs / 4) <= 3 * (runs * 3 / 16) ** 0.5
    e = E(spark, *STAR, (1, 2), (1, 7), (2, 8))
    once, again = (rows(sampling.random_neighbour(e, 1.0, 3)) for _ in range(2))
    assert once == again and [u for u, _ in once] == [0, 1, 2] and set(once) <= set(rows(e))


def test_source_coin(spark):
    n = 4096
    path = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    kept = sampling.random_neighbour(path, 0.4, 5).count()
    assert abs(kept - 0.4 * n) <= 3 * (n * 0.24) ** 0.5
    s = sampling.sampled_sources(path, 0.4, 5).head()
    assert tuple(s) == (kept, n - kept)


@pytest.mark.parametrize("power", range(1, 7))
def test_power_of_two_coin(spark, power):
    n, p = 1 << 18, 2.0**-power
    heads = spark.range(n).where(power_of_two_coin(power, 17, F.col("id"))).count()
    assert abs(heads - n * p) <= 3 * (n * p * (1 - p)) ** 0.5


def test_split_is_a_partition(spark):
    e = spark.range(1000).select(F.col("id").alias("u"), (F.col("id") * 3).alias("v"))
    left, right = sampling.split_edges(e, 2, 8)
    assert left.intersect(right).count() == 0 and left.union(right).distinct().count() == 1000


def test_random_relabelling_is_a_bijection(spark):
    e = E(spark, *[(10 * i, 10 * i + 10) for i in range(1, 300)])
    labels = rows(sampling.random_relabelling(e, 3))
    assert sorted(c for _, c in labels) == list(range(1, 301)) and [c for _, c in labels] != list(range(1, 301))
    assert rows(aggregates.degree_distribution(sampling.relabel_randomly(e, 3))) == rows(aggregates.degree_distribution(e))


def test_sketches(spark):
    one = spark.range(1)
    assert one.select(sketches.min_sketch_estimate(F.lit(42_949_672)).alias("e")).head()[0] == 99
    assert one.select(sketches.min_sketch_estimate(F.lit(0)).alias("e")).head()[0] is None
    zeros = spark.createDataFrame([(0,), (1,), (8,), (12,)], "x long").select(sketches.trailing_zeros(F.col("x")))
    assert [r[0] for r in zeros.collect()] == [32, 0, 3, 2]
    n = 20_000
    ids = spark.range(1, n + 1).toDF("node")
    kmv = sketches.k_minimum_values(ids, "node", 1024).head()[0]
    assert abs(kmv / n - 1) < 0.15
    assert sketches.k_minimum_values(ids.where("node < 50"), "node", 1024).head()[0] == 49
    mom = ids.agg(sketches.median_of_means(F.col("node")).alias("e")).head()[0]
    assert n / 8 < mom < n * 8


def test_policies():
    six, eight = POLICIES[6], POLICIES[8]
    assert (six.contract(10, 25, 0, 5), six.nodes_to_contract(10, 25, 0, 5), six.sample_power(10, 25, 0, 5)) == (True, 4, 1)
    assert (eight.contract(10, 25, 0, 5), eight.nodes_to_contract(10, 25, 0, 5)) == (True, 4)
    assert not POLICIES[3].contract(10, 25, 0, 5) and POLICIES[3].contract(10, 25, 1, 5)
    assert bundle_count(100, 1 << 30, 0) <= bundle_count(100, 1 << 30, 3)
