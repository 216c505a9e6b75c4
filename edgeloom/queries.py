"""The registered queries of the graph operators, each beside the SQL that gives the same rows.

Graphs come from whole tables: even ids ``2k + 2`` for one side, odd ids ``2k + 3`` for the other.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import hashing, sketches
from edgeloom.operators import aggregates, checks, filters, joins, ordering, sampling, sets, transforms
from edgeloom.plans import contraction, measure
from edgeloom.plans.components import connected_components
from edgeloom.plans.policies import POLICIES
from edgeloom.session import ensure_checkpoint_dir
from edgeloom.sources import edges as files
from edgeloom.sources import generators
from edgeloom.sources.edges import from_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Edges left to the base case in the queries of contraction strategies, so that these do some rounds at any scale.
ROUNDS_BASE = 5_000

OP = "op AS (SELECT 2 * l_orderkey + 2 AS u, 2 * l_partkey + 3 AS v FROM lineitem)"
EDGES = f"{OP}, edges AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM op WHERE u <> v)"
OC = "oc AS (SELECT 2 * o_orderkey + 2 AS u, 2 * o_custkey + 3 AS v FROM orders)"
PS = "ps AS (SELECT DISTINCT 2 * l_partkey + 2 AS u, 2 * l_suppkey + 3 AS v FROM lineitem)"
CN = "cn AS (SELECT 2 * c_custkey + 2 AS u, 2 * CAST(c_nationkey AS BIGINT) + 3 AS v FROM customer)"
LABELS = "m AS (SELECT 2 * o_orderkey + 2 AS node, 2 * o_custkey + 3 AS component FROM orders)"
BOTH = "SELECT u, v FROM {0} UNION ALL SELECT v, u FROM {0}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_part(spark: SparkSession, sf: str) -> DataFrame:
    return from_columns(table(spark, sf, "lineitem"), 2 * F.col("l_orderkey") + 2, 2 * F.col("l_partkey") + 3)


def order_customer(spark: SparkSession, sf: str) -> DataFrame:
    return from_columns(table(spark, sf, "orders"), 2 * F.col("o_orderkey") + 2, 2 * F.col("o_custkey") + 3)


def part_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return from_columns(table(spark, sf, "lineitem"), 2 * F.col("l_partkey") + 2, 2 * F.col("l_suppkey") + 3).distinct()


def customer_nation(spark: SparkSession, sf: str) -> DataFrame:
    return from_columns(table(spark, sf, "customer"), 2 * F.col("c_custkey") + 2, 2 * F.col("c_nationkey").cast("long") + 3)


def order_labels(spark: SparkSession, sf: str) -> DataFrame:
    return order_customer(spark, sf).toDF("node", "component")


def customer_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Customer ids as order_customer names them, labelled by nation."""
    c = table(spark, sf, "customer")
    return c.select((2 * F.col("c_custkey") + 3).alias("node"), (2 * F.col("c_nationkey").cast("long") + 2).alias("component"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def on(source: Callable, operator: Callable, *args, **kw) -> Query:
    return lambda spark, sf: operator(source(spark, sf), *args, **kw)


def both(name: str, sql: str | None, f: Query) -> None:
    query(name, sql)(f)


def cc_sql(ctes: str, graph: str, pick: str = "max", tail: str = "SELECT node, label AS component FROM cc") -> str:
    worse = ">" if pick == "max" else "<"
    return f"""WITH RECURSIVE {ctes}, e AS MATERIALIZED (SELECT u, v FROM {graph} UNION SELECT v, u FROM {graph}),
    cc(node, label) USING KEY (node) AS (SELECT u, {pick}({'greatest' if pick == 'max' else 'least'}(u, v)) FROM e GROUP BY u
      UNION SELECT e.v, {pick}(cc.label) FROM cc JOIN e ON e.u = cc.node JOIN recurring.cc AS old ON old.node = e.v
      WHERE cc.label {worse} old.label GROUP BY e.v) {tail}"""


# --- sources, transforms, filters -----------------------------------------------------------------------------------
both("scan_edges", f"WITH {OP} SELECT u, v FROM op", order_part)
both("orient_edges", f"WITH {OP} SELECT least(u, v) AS u, greatest(u, v) AS v FROM op", on(order_part, transforms.orient_small_to_large))
both("orient_edges_desc", f"WITH {OP} SELECT greatest(u, v) AS u, least(u, v) AS v FROM op", on(order_part, transforms.orient_large_to_small))
both("symmetrize", f"WITH {OP} {BOTH.format('op')}", on(order_part, transforms.symmetrize))
both("project_target", f"WITH {OP} SELECT v AS node FROM op", on(order_part, transforms.project_target))
both("edge_endpoints", f"WITH {OP} SELECT u AS node FROM op UNION ALL SELECT v FROM op", on(order_part, transforms.endpoints))
both("normalize_edges", f"WITH {EDGES} SELECT u, v FROM edges", on(order_part, transforms.normalize))
both("shift_ids", f"WITH {OP} SELECT u + 7 - 3 AS u, v + 7 - 3 AS v FROM op", on(order_part, transforms.shift_ids, add=7, subtract=3))
both("push_mapped", f"WITH {OP} SELECT u + v AS total FROM op", lambda s, d: transforms.push(order_part(s, d), {"total": F.col("u") + F.col("v")}))
both("index_edges", f"WITH {EDGES} SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS rank FROM edges",
     lambda s, d: transforms.index_edges(transforms.normalize(order_part(s, d))))
both("push_until", f"WITH {EDGES} SELECT u, v FROM edges WHERE (u, v) < (SELECT min((u, v)) FROM edges WHERE v - u > 2000)",
     lambda s, d: transforms.push_until(transforms.normalize(order_part(s, d)), F.col("v") - F.col("u") > 2000, ["u", "v"]))
both("flag_origin", f"WITH {OP}, {OC} SELECT u, v, FALSE AS is_successor FROM op UNION ALL SELECT u, v, TRUE FROM oc",
     lambda s, d: transforms.flag_origin(order_part(s, d), "is_successor", False).unionByName(transforms.flag_origin(order_customer(s, d), "is_successor", True)))


@query("tee_split", f"WITH {OP}, a AS (SELECT count(*) AS edges FROM op), b AS (SELECT count(DISTINCT u) AS sources FROM op) SELECT edges, sources FROM a, b")
def _tee(spark: SparkSession, sf: str) -> DataFrame:
    a, b = transforms.tee(
        order_part(spark, sf), lambda e: e.agg(F.count("u").alias("edges")), lambda e: e.agg(F.countDistinct("u").alias("sources"))
    )
    return a.withColumn("k", F.lit(0)).join(b.withColumn("k", F.lit(0)), "k").drop("k")


def loopy(spark: SparkSession, sf: str) -> DataFrame:
    """Customer ids joined to the odd number at the square below: repeats and some self-loops."""
    root = F.floor(F.sqrt("v"))
    return order_customer(spark, sf).select(F.col("v").alias("u"), (2 * (F.floor(root * root / 2)) + 1).alias("v"))


LOOPY = f"{OC}, loopy AS (SELECT v AS u, 2 * CAST(floor(floor(sqrt(v)) * floor(sqrt(v)) / 2) AS BIGINT) + 1 AS v FROM oc)"
both("drop_self_loops", f"WITH {LOOPY} SELECT u, v FROM loopy WHERE u <> v", on(loopy, filters.drop_self_loops))
both("clean_edges", f"WITH {LOOPY} SELECT DISTINCT u, v FROM loopy WHERE u <> v", on(loopy, filters.clean))
both("clean_report", f"WITH {LOOPY} SELECT count(*) AS edges_in, count(*) FILTER (u = v) AS self_loops, count(*) FILTER (u <> v) - (SELECT count(*) FROM (SELECT DISTINCT u, v FROM loopy WHERE u <> v)) AS duplicates, (SELECT count(*) FROM (SELECT DISTINCT u, v FROM loopy WHERE u <> v)) AS edges_out FROM loopy", on(loopy, filters.clean_report))
both("anti_join_hits", f"WITH {OP}, {OC} SELECT u, v FROM op WHERE u NOT IN (SELECT u FROM oc WHERE v < 1000)",
     lambda s, d: filters.without_hits(order_part(s, d), "u", order_customer(s, d).where("v < 1000").select(F.col("u").alias("node"))))
both("consecutive_filter", f"WITH {EDGES}, x AS (SELECT u, v, lag(v) OVER (PARTITION BY u ORDER BY v) AS p FROM edges) SELECT u, v FROM x WHERE p IS NULL OR v - p >= 100",
     lambda s, d: filters.consecutive_filter(transforms.normalize(order_part(s, d)), ["v"], F.col("v") - F.col("prev.v") < 100, ["u"]))
both("dedup_edges", f"WITH {OP} SELECT DISTINCT u, v FROM op", on(order_part, filters.dedup_equal))
both("dedup_undirected", f"WITH {LOOPY} SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM loopy", on(loopy, filters.dedup_undirected))
both("sources_up_to", f"WITH {OP} SELECT u, v FROM op WHERE u <= 1000", on(order_part, filters.sources_up_to, 1000))
both("source_is", f"WITH {OP} SELECT u, v FROM op WHERE u = 1000", on(order_part, filters.source_is, 1000))
both("first_k_sources", f"WITH {OP} SELECT u, v FROM op WHERE u IN (SELECT DISTINCT u FROM op ORDER BY u LIMIT 500)", on(order_part, filters.first_k_sources, 500))

# --- joins -----------------------------------------------------------------------------------------------------------
RL = f"{OP}, {LABELS}"
US = "us AS (SELECT coalesce(component, u) AS u, v FROM op LEFT JOIN m ON u = node)"
UV = "uv AS (SELECT least(u, coalesce(component, v)) AS u, greatest(u, coalesce(component, v)) AS v FROM us LEFT JOIN m ON v = node)"
both("relabel_sources", f"WITH {RL}, {US} SELECT u, v FROM us", lambda s, d: joins.relabel_sources(order_part(s, d), order_labels(s, d)))
both("relabel_sources_no_loops", f"WITH {RL}, {US} SELECT u, v FROM us WHERE u <> v", lambda s, d: joins.relabel_sources(order_part(s, d), order_labels(s, d), drop_loops=True))
both("relabel_targets", f"WITH {OC}, n AS (SELECT 2 * c_custkey + 3 AS node, 2 * CAST(c_nationkey AS BIGINT) + 2 AS component FROM customer), x AS (SELECT least(u, coalesce(component, v)) AS u, greatest(u, coalesce(component, v)) AS v FROM oc LEFT JOIN n ON v = node) SELECT u, v FROM x WHERE u <> v",
     lambda s, d: joins.relabel_targets_oriented(order_customer(s, d), customer_labels(s, d)))
both("contract_stars", f"WITH {RL}, {US}, {UV} SELECT DISTINCT u, v FROM uv WHERE u <> v", lambda s, d: joins.contract_stars(order_part(s, d), order_labels(s, d)))
both("contract_stars_multi", f"WITH {RL}, {US}, {UV} SELECT u, v FROM uv WHERE u <> v", lambda s, d: joins.contract_stars(order_part(s, d), order_labels(s, d), distinct=False))
both("relabel_edges", f"WITH {RL}, {US} SELECT u, coalesce(component, v) AS v FROM us LEFT JOIN m ON v = node", lambda s, d: joins.relabel_edges(order_part(s, d), order_labels(s, d)))
NL = "n AS (SELECT 2 * c_custkey + 3 AS node, 2 * CAST(c_nationkey AS BIGINT) + 2 AS component FROM customer)"
both("relabel_labels", f"WITH {LABELS}, {NL} SELECT m.node, coalesce(n.component, m.component) AS component FROM m LEFT JOIN n ON m.component = n.node",
     lambda s, d: joins.relabel_labels(order_labels(s, d), customer_labels(s, d)))
both("compose_maps", f"WITH {LABELS}, {NL} SELECT m.node, coalesce(n.component, m.component) AS component FROM m LEFT JOIN n ON m.component = n.node UNION SELECT node, component FROM n WHERE node NOT IN (SELECT node FROM m)",
     lambda s, d: joins.compose(order_labels(s, d), customer_labels(s, d)))
both("contracted_node_count", f"WITH {RL}, {US}, {UV}, w AS (SELECT u AS node FROM uv WHERE u <> v UNION SELECT v FROM uv WHERE u <> v) SELECT count(*) AS nodes FROM w",
     lambda s, d: joins.contract_with_bound(order_part(s, d), order_labels(s, d))[1])
both("break_paths", f"WITH {LOOPY} SELECT u, v FROM loopy WHERE u NOT IN (SELECT v FROM loopy)", on(loopy, joins.break_paths))
both("incident_positions", f"WITH {OC}, {CN}, r AS (SELECT v - 1 AS v, row_number() OVER (ORDER BY u, v) - 1 AS rank FROM oc) SELECT rank, cn.u, cn.v FROM r JOIN cn ON r.v = cn.u",
     lambda s, d: joins.incident_positions(transforms.index_edges(order_customer(s, d)).withColumn("v", F.col("v") - 1), customer_nation(s, d)))
both("sources_disjoint", f"WITH {OP}, {PS} SELECT NOT EXISTS (SELECT 1 FROM op JOIN ps USING (u)) AS disjoint", lambda s, d: joins.sources_disjoint(order_part(s, d), part_supplier(s, d)))
both("compare_labels", f"WITH {LABELS}, x AS (SELECT u AS node, max(v) AS component FROM (SELECT 2 * l_orderkey + 2 AS u, 2 * l_partkey + 3 AS v FROM lineitem) GROUP BY u) SELECT node, coalesce(m.component, -1) AS left_component, coalesce(x.component, -1) AS right_component, CASE WHEN x.component IS NULL THEN 'left_only' WHEN m.component IS NULL THEN 'right_only' WHEN m.component = x.component THEN 'same' ELSE 'differs' END AS status FROM m FULL OUTER JOIN x USING (node)",
     lambda s, d: joins.compare_labels(order_labels(s, d), order_part(s, d).groupBy(F.col("u").alias("node")).agg(F.max("v").alias("component"))).fillna(-1, ["left_component", "right_component"]))

# --- aggregates, sets, order -----------------------------------------------------------------------------------------
NODES = "nodes AS (SELECT u AS node FROM op UNION SELECT v FROM op)"
both("unique_nodes", f"WITH {OP}, {NODES} SELECT node FROM nodes", on(order_part, aggregates.unique_nodes))
both("count_nodes", f"WITH {OP}, {NODES} SELECT count(*) AS nodes, max(node) AS max_node FROM nodes", on(order_part, aggregates.count_nodes))
both("graph_size", f"WITH {OP}, {NODES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM op) AS edges, (SELECT max(node) FROM nodes) AS max_node", on(order_part, aggregates.graph_size))
both("max_node_id", f"WITH {OP} SELECT max(greatest(u, v)) AS max_node FROM op", on(order_part, aggregates.max_node_id))
DEG = f"WITH {OP}, deg AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM op UNION ALL SELECT v FROM op) GROUP BY node)"
both("degrees", f"{DEG} SELECT node, degree FROM deg", on(order_part, aggregates.degrees))
both("degree_distribution", f"{DEG} SELECT degree, count(*) AS count FROM deg GROUP BY degree", on(order_part, aggregates.degree_distribution))
SIZES = f"WITH {LABELS}, s AS (SELECT component, count(*) AS size, bool_or(node = component) AS has_root_row FROM m GROUP BY component)"
both("component_sizes", f"{SIZES} SELECT component, size, has_root_row FROM s", on(order_labels, aggregates.component_sizes))
both("component_size_histogram", f"{SIZES} SELECT size, count(*) AS count FROM (SELECT size + CASE WHEN has_root_row THEN 0 ELSE 1 END AS size FROM s) GROUP BY size", on(order_labels, aggregates.component_size_histogram))
both("min_neighbour", f"WITH {OP} SELECT u AS node, min(v) AS neighbour FROM ({BOTH.format('op')}) GROUP BY u", on(order_part, aggregates.min_neighbour))
both("max_neighbour", f"WITH {OP} SELECT u AS node, max(v) AS neighbour FROM ({BOTH.format('op')}) GROUP BY u", on(order_part, aggregates.max_neighbour))
both("max_per_component", f"WITH {LABELS} SELECT component, max(node) AS max_node FROM m GROUP BY component", on(order_labels, aggregates.max_per_component))
both("node_upper_bound", f"WITH {OP} SELECT count(DISTINCT u) + count(DISTINCT v) AS bound FROM op", on(order_part, aggregates.node_upper_bound))
both("common_sources", f"WITH {OP}, {OC} SELECT count(*) AS common_sources FROM (SELECT u FROM op INTERSECT SELECT u FROM oc)", lambda s, d: aggregates.common_sources(order_part(s, d), order_customer(s, d)))
both("multi_edges", f"WITH {LOOPY} SELECT count(*) FILTER (u = v) AS self_loops, count(*) - count(DISTINCT (u, v)) AS multi_edges FROM loopy", on(loopy, aggregates.multi_edges))
both("range_bundles", f"WITH {PS}, w AS (SELECT greatest(1, max(greatest(u, v)) // 16) AS w FROM ps) SELECT u, v, least((u - 1) // w, 15) AS bundle, least((v - 1) // w, 15) AS target_bundle, least((u - 1) // w, 15) = least((v - 1) // w, 15) AS intra FROM ps, w",
     lambda s, d: aggregates.range_bundles(part_supplier(s, d), 16, aggregates.max_node_id(part_supplier(s, d)).head()[0]))
both("merge_streams", f"WITH {OP}, {OC} SELECT u, v FROM op UNION ALL SELECT u, v FROM oc", lambda s, d: sets.merge(order_part(s, d), order_customer(s, d)))
both("merge_unique", f"WITH {OP}, {OC} SELECT u, v FROM op UNION SELECT u, v FROM oc", lambda s, d: sets.merge_unique(order_part(s, d), order_customer(s, d)))
both("merge_with", f"WITH {OP}, {LABELS} SELECT u AS id, v - u AS gap FROM op UNION ALL SELECT node, component FROM m",
     lambda s, d: sets.merge_with(order_part(s, d), order_labels(s, d), {"id": F.col("u"), "gap": F.col("v") - F.col("u")}, {"id": F.col("node"), "gap": F.col("component")}))
both("merge_edges", f"WITH {OP}, {OC}, {PS} SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM (SELECT * FROM op UNION ALL SELECT * FROM oc UNION ALL SELECT * FROM ps)",
     lambda s, d: sets.merge_edges(order_part(s, d), order_customer(s, d), part_supplier(s, d)))
both("minus_edges", f"WITH {OP}, {OC} SELECT u, v FROM op EXCEPT SELECT u, v FROM oc", lambda s, d: sets.minus(order_part(s, d), order_customer(s, d)))
both("disjoint_union", f"WITH {OC}, {CN} SELECT u, v, 0 AS input FROM oc UNION ALL SELECT u, v, 1 FROM cn", lambda s, d: sets.disjoint_union(order_customer(s, d), customer_nation(s, d)))
both("sorted_edges", f"WITH {EDGES} SELECT u, v FROM edges ORDER BY u, v", lambda s, d: ordering.order_by(transforms.normalize(order_part(s, d)), "edge"))
both("is_sorted", "SELECT TRUE AS is_sorted", lambda s, d: ordering.is_sorted(transforms.index_edges(transforms.normalize(order_part(s, d))), ["u", "v"], "rank"))
both("is_sorted_fails", "SELECT FALSE AS is_sorted", lambda s, d: ordering.is_sorted(transforms.index_edges(transforms.normalize(order_part(s, d))), ["v"], "rank"))
both("shuffle_rows", f"WITH {EDGES}, h AS (SELECT u, v, {hashing.mixed_hash_sql('h', 5, 'u', 'v')} FROM edges) SELECT u, v, row_number() OVER (ORDER BY h, u, v) - 1 AS place FROM h",
     lambda s, d: ordering.with_position(transforms.normalize(order_part(s, d)).withColumn("h", ordering.shuffle_order(5, ["u", "v"])[0]), ["h", "u", "v"], "place").drop("h"))

# --- checks ----------------------------------------------------------------------------------------------------------
both("stars_only", f"WITH {LABELS} SELECT count(*) = count(DISTINCT node) AND NOT EXISTS (SELECT 1 FROM m a JOIN m b ON a.component = b.node WHERE b.node <> b.component) AS stars_only FROM m", on(order_labels, checks.stars_only))
both("stars_only_fails", "SELECT FALSE AS stars_only", lambda s, d: checks.stars_only(order_labels(s, d).unionByName(customer_labels(s, d))))
both("invalid_edges", f"WITH {OP} SELECT u - 10 AS u, v FROM op WHERE u - 10 < 1", lambda s, d: checks.invalid_edges(order_part(s, d).select((F.col("u") - 10).alias("u"), "v")))
both("compare_report", f"WITH {LABELS}, x AS (SELECT u AS node, max(v) AS component FROM (SELECT 2 * l_orderkey + 2 AS u, 2 * l_partkey + 3 AS v FROM lineitem) GROUP BY u) SELECT count(m.node) AS left_rows, count(x.node) AS right_rows, 0::BIGINT AS left_repeats, 0::BIGINT AS right_repeats, count(*) FILTER (x.node IS NULL) AS left_only, count(*) FILTER (m.node IS NULL) AS right_only, count(*) FILTER (m.component <> x.component) AS labels_differ, max(m.node) AS left_max, max(x.node) AS right_max FROM m FULL OUTER JOIN x ON m.node = x.node",
     lambda s, d: checks.compare_report(order_labels(s, d), order_part(s, d).groupBy(F.col("u").alias("node")).agg(F.max("v").alias("component"))))
both("id_gaps", f"WITH {LABELS} SELECT max(node) - min(node) + 1 - count(DISTINCT node) AS gaps FROM m", on(order_labels, checks.id_gaps))

# --- sampling ------------------------------------------------------------------------------------------------------------
UV_HASH = f"h AS (SELECT u, v, {hashing.mixed_hash_sql('h', 3, 'u', 'v')} FROM (SELECT DISTINCT u, v FROM op))"
both("random_out_edge", f"WITH {OP}, {UV_HASH} SELECT u, arg_min(v, (h, v)) AS v FROM h GROUP BY u", lambda s, d: sampling.random_out_edge(order_part(s, d), 3))
both("random_neighbour", f"WITH {OP}, {UV_HASH}, c AS (SELECT u, v, h, {hashing.mixed_hash_sql('coin', 4, 'u')} FROM h) SELECT u, arg_min(v, (h, v)) AS v FROM c WHERE coin / 4294967296.0 < 0.5 GROUP BY u",
     lambda s, d: sampling.random_neighbour(order_part(s, d), 0.5, 3))
both("coin_split", f"WITH {OP}, c AS (SELECT u, v, {hashing.mixed_hash_sql('coin', 9, 'u', 'v')} FROM (SELECT DISTINCT u, v FROM op)) SELECT u, v, CASE WHEN coin & 3 = 3 THEN 0 ELSE 1 END AS input FROM c",
     lambda s, d: sets.disjoint_union(*sampling.split_edges(filters.dedup_equal(order_part(s, d)), 2, seed=9)))
PERMUTED = f"p AS (SELECT node, row_number() OVER (ORDER BY h, node) AS component FROM (SELECT node, {hashing.mixed_hash_sql('h', 4, 'node')} FROM nodes))"
ALL_NODES = "nodes AS (SELECT u AS node FROM op UNION SELECT v FROM op)"
both("random_relabelling", f"WITH {OP}, {ALL_NODES}, {PERMUTED} SELECT node, component FROM p", lambda s, d: sampling.random_relabelling(order_part(s, d), 4))
both("relabel_randomly", f"WITH {OP}, {ALL_NODES}, {PERMUTED} SELECT least(a.component, b.component) AS u, greatest(a.component, b.component) AS v FROM op JOIN p a ON op.u = a.node JOIN p b ON op.v = b.node",
     lambda s, d: sampling.relabel_randomly(order_part(s, d), 4))
both("sampled_sources", f"WITH {OP}, c AS (SELECT u, {hashing.mixed_hash_sql('coin', 8, 'u')} FROM (SELECT DISTINCT u FROM op)) SELECT count(*) FILTER (coin / 4294967296.0 < 0.4) AS sampled, count(*) FILTER (coin / 4294967296.0 >= 0.4) AS unsampled FROM c",
     lambda s, d: sampling.sampled_sources(order_part(s, d), 0.4, 7))
both("sample_per_key", f"WITH {OP} SELECT u, least(count(*), 2) AS n FROM op GROUP BY u", lambda s, d: sampling.sample_per_key(order_part(s, d), "u", 2, 1).groupBy("u").agg(F.count("v").alias("n")))

# --- hashes and sketches -------------------------------------------------------------------------------------------------
A32, B32, A64, B64 = 2654435761, 40503, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
H32 = "CAST(({0}::HUGEINT * {1} + {2}) % 4294967296 AS BIGINT)"
both("hash_arith32", f"WITH {OP}, {NODES} SELECT node, {H32.format(A32, 'node', B32)} & 65535 AS hash FROM nodes",
     lambda s, d: aggregates.unique_nodes(order_part(s, d)).select("node", hashing.arithmetic_hash_32(F.col("node"), A32, B32, 65535).alias("hash")))
both("hash_multiply_shift32", f"WITH {OP}, {NODES} SELECT node, CAST((({A64}::HUGEINT * node + {B64}::HUGEINT) % 18446744073709551616::HUGEINT) >> 44 AS BIGINT) AS hash FROM nodes",
     lambda s, d: aggregates.unique_nodes(order_part(s, d)).select("node", hashing.multiply_shift_32(F.col("node"), A64, B64, 20).alias("hash")))
PAIR = (123456789, 362436069, 0x5851F42D4C957F2D, 521288629, 88675123, 0x14057B7EF767814F)
both("hash_pair_shift64", f"WITH {OP}, {NODES} SELECT node, (CAST(((({PAIR[3]} + (node >> 32))::HUGEINT * ({PAIR[4]} + (node & 4294967295)) + {PAIR[5]}) % 18446744073709551616::HUGEINT) >> 56 AS BIGINT) << 32) | CAST(((({PAIR[0]} + (node >> 32))::HUGEINT * ({PAIR[1]} + (node & 4294967295)) + {PAIR[2]}) % 18446744073709551616::HUGEINT) >> 32 AS BIGINT) AS hash FROM nodes",
     lambda s, d: aggregates.unique_nodes(order_part(s, d)).select("node", hashing.pair_multiply_shift_64(F.col("node"), PAIR, 1 << 40).alias("hash")))
both("min_sketch_estimate", f"WITH {OP}, {NODES}, h AS (SELECT min({H32.format(A32, 'node', B32)}) AS h FROM nodes) SELECT CAST(floor(4294967295 / h - 1) AS BIGINT) AS estimate FROM h",
     lambda s, d: transforms.endpoints(order_part(s, d)).agg(sketches.min_sketch(F.col("node"), A32, B32).alias("estimate")))
both("ratio_sketch_estimate", f"WITH {OP}, {NODES}, h AS (SELECT min({H32.format(A32, 'node', B32)}) AS h FROM nodes) SELECT CAST(floor(4294967295 / h) AS BIGINT) AS estimate FROM h",
     lambda s, d: transforms.endpoints(order_part(s, d)).agg(sketches.ratio_sketch(F.col("node"), A32, B32).alias("estimate")))
both("tidemark_estimate", f"WITH {OP}, {NODES}, h AS (SELECT {H32.format(A32, 'node', B32)} AS h FROM nodes), z AS (SELECT max(CASE WHEN h = 0 THEN 32 ELSE bit_count((h & -h) - 1) END) AS z FROM h) SELECT CAST(floor(pow(2.0, z) * sqrt(2.0)) AS BIGINT) AS estimate FROM z",
     lambda s, d: transforms.endpoints(order_part(s, d)).agg(sketches.tidemark(F.col("node"), A32, B32).alias("estimate")))


def _mom_sql() -> str:
    params = sketches.parameters(25, 1)
    mins = ", ".join(f"CAST(floor(4294967295 / min({H32.format(a, 'node', b)}) - 1) AS BIGINT) AS e{i}" for i, (a, b) in enumerate(params))
    means = ", ".join("(" + " + ".join(f"e{5 * g + i}" for i in range(5)) + ") // 5" for g in range(5))
    return f"WITH {OP}, {NODES}, e AS (SELECT {mins} FROM nodes) SELECT list_sort([{means}])[3] AS estimate FROM e"


both("median_of_means_estimate", _mom_sql(), lambda s, d: transforms.endpoints(order_part(s, d)).agg(sketches.median_of_means(F.col("node")).alias("estimate")))
both("sketch_both_sides", f"WITH {OP}, h AS (SELECT min({H32.format(A32, 'u', B32)}) AS l, min({H32.format(A32, 'v', B32)}) AS r FROM op) SELECT CAST(floor(4294967295 / l - 1) AS BIGINT) AS left_nodes, CAST(floor(4294967295 / r - 1) AS BIGINT) AS right_nodes, CAST(floor(4294967295 / least(l, r) - 1) AS BIGINT) AS all_nodes FROM h",
     lambda s, d: order_part(s, d).agg(*sketches.both_sides(F.col("u"), F.col("v"), A32, B32)))
both("kmv_estimate", f"WITH {OP}, {NODES}, h AS (SELECT {hashing.mixed_hash_sql('a', 1, 'node')}, {hashing.mixed_hash_sql('b', 2, 'node')} FROM nodes), w AS (SELECT DISTINCT (a * 2097152 + (b >> 11) + 1) / 9007199254740992.0 AS w FROM h ORDER BY w LIMIT 256) SELECT CASE WHEN count(*) < 256 THEN count(*) ELSE CAST(floor(255 / max(w)) AS BIGINT) END AS estimate FROM w", lambda s, d: sketches.k_minimum_values(transforms.endpoints(order_part(s, d)), "node", 256))
both("approx_count_nodes", None, on(order_part, aggregates.approx_count_nodes))
both("hll_count_nodes", None, on(order_part, aggregates.hll_count_nodes))

# --- generators ------------------------------------------------------------------------------------------------------------
both("gen_path", "SELECT i AS u, i + 1 AS v FROM range(1, 5000) t(i)", lambda s, d: generators.path(s, 5000))
both("gen_grid", "WITH c AS (SELECT i, i % 70 AS x, i // 70 AS y FROM range(4200) t(i)) SELECT i + 1 AS u, i + 2 AS v FROM c WHERE x < 69 UNION ALL SELECT i + 1, i + 71 FROM c WHERE y < 59", lambda s, d: generators.grid(s, 70, 60))
both("gen_cube", "WITH c AS (SELECT i, i % 20 AS x, (i // 20) % 15 AS y, i // 300 AS l FROM range(1800) t(i)) SELECT a.i + 1 AS u, b.i + 1 AS v FROM c a JOIN c b ON a.l = b.l AND a.i < b.i AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2", lambda s, d: generators.cube(s, 20, 15, 6, 2))
both("gen_cliques", "SELECT a.i + 1 AS u, b.i + 1 AS v FROM range(1200) a(i) JOIN range(1200) b(i) ON a.i // 12 = b.i // 12 AND a.i < b.i", lambda s, d: generators.cliques(s, 12, 100))
GN, GD, GS = 20_000, 2.0, 11
G_BLOCKS, G_SIZE, G_DRAWS = generators.gilbert_blocks(GN, GD)
G_KEEP = math.log1p(-2 * GD / (GN - 1))
both("gen_gilbert", f"""WITH k AS (SELECT block, k FROM range({G_BLOCKS}) a(block), range({G_DRAWS}) b(k)), h AS (SELECT block, k, {hashing.mixed_hash_sql('h', GS, 'block', 'k')} FROM k),
    p AS (SELECT block, sum(least(CAST(floor(ln((h + 0.5) / 4294967296.0) / ({G_KEEP!r}::DOUBLE)) AS BIGINT) + 1, {G_SIZE})) OVER (PARTITION BY block ORDER BY k) - 1 AS place FROM h),
    n AS (SELECT CAST(block * {G_SIZE} + place AS BIGINT) AS i FROM p WHERE place < {G_SIZE}), v AS (SELECT r, r * (r - 1) // 2 AS first FROM range(1, {GN}) t(r))
    SELECT i - first + 1 AS u, r + 1 AS v FROM n ASOF JOIN v ON n.i >= v.first WHERE i < {GN * (GN - 1) // 2}""",
     lambda s, d: generators.gilbert(s, GN, GD, GS))
both("gen_uniform", f"SELECT a % 1000000 + 1 AS u, b % 1000000 + 1 AS v FROM (SELECT {hashing.mixed_hash_sql('a', 4, 'i')}, {hashing.mixed_hash_sql('b', 5, 'i')} FROM range(50000) t(i))",
     lambda s, d: generators.uniform_edges(s, 1_000_000, 50_000, 3))

# --- files ---------------------------------------------------------------------------------------------------------------


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(name: str, sql: str, back: Callable[[SparkSession, DataFrame, str], DataFrame], source: Callable = order_part) -> None:
    """A query that writes a graph to files and returns what a scan of them gives."""
    both(name, sql, lambda spark, sf: back(spark, source(spark, sf), folder(spark, name)))


def _binary(spark: SparkSession, e: DataFrame, path: str) -> DataFrame:
    files.write_binary(e, path)
    return files.from_binary(spark, path)


def _text(spark: SparkSession, e: DataFrame, path: str) -> DataFrame:
    files.write_text(e, path)
    return files.from_text(spark, path, add=5, subtract=2)


def _csv(spark: SparkSession, e: DataFrame, path: str) -> DataFrame:
    files.write_csv(aggregates.degree_distribution(e), path)
    return spark.read.csv(path, header=True, schema="degree long, count long")


def _parquet(spark: SparkSession, e: DataFrame, path: str) -> DataFrame:
    files.write_parquet(e, path)
    return spark.read.parquet(path)


def _replaced(spark: SparkSession, e: DataFrame, path: str) -> DataFrame:
    files.write_parquet(e, path)
    files.replace_parquet(spark, path, transforms.normalize)
    return spark.read.parquet(path)


stored("binary_round_trip", f"WITH {OP} SELECT u, v FROM op", _binary)
stored("read_graph", f"WITH {OP} SELECT DISTINCT u, v FROM op", lambda s, e, p: files.write_binary(e, p) and files.read_graph(s, p))
stored("read_graph_report", f"WITH {LOOPY} SELECT count(*) AS edges_in, count(DISTINCT (u, v)) AS kept, count(*) - count(DISTINCT (u, v)) AS dropped FROM loopy", lambda s, e, p: files.scan_report(_binary(s, e, p)), loopy)
stored("text_round_trip", f"WITH {OP} SELECT u + 5 - 2 AS u, v + 5 - 2 AS v FROM op", _text)
stored("csv_round_trip", f"{DEG} SELECT degree, count(*) AS count FROM deg GROUP BY degree", _csv)
stored("parquet_round_trip", f"WITH {OP} SELECT u, v FROM op", _parquet)
stored("replace_in_place", f"WITH {EDGES} SELECT u, v FROM edges", _replaced)
both("edges_from_values", "SELECT i AS u, i * i + 1 AS v FROM range(1, 200) t(i)", lambda s, d: files.from_values(s, [(i, i * i + 1) for i in range(1, 200)]))

# --- contraction and components ------------------------------------------------------------------------------------------
both("cc_local", cc_sql(OC, "oc"), on(order_customer, connected_components, "local"))
both("cc_order_part", cc_sql(OP, "op"), on(order_part, connected_components))
both("cc_part_supplier_min", cc_sql(PS, "ps", "min"), on(part_supplier, connected_components, representative="min"))
both("cc_customer_nation", cc_sql(CN, "cn"), on(customer_nation, connected_components))
for _name in ("boruvka", "kkt", "star", "forward", "bundles"):
    both(f"cc_{_name}", cc_sql(OC, "oc"), on(order_customer, connected_components, _name, base_case_edges=ROUNDS_BASE, seed=2))
    both(f"cc_order_part_{_name}", cc_sql(OP, "op"), on(order_part, connected_components, _name, base_case_edges=ROUNDS_BASE, seed=3))
    both(f"cc_path_{_name}", "SELECT i AS node, 200::BIGINT AS component FROM range(1, 201) t(i)", lambda s, d, n=_name: connected_components(generators.path(s, 200), n, base_case_edges=60, seed=1))
for _name in ("forward", "kkt", "star"):
    both(f"cc_functional_{_name}", cc_sql(OC, "oc"), on(order_customer, connected_components, "functional", contraction=_name, policy=2 if _name == "forward" else 0, base_case_edges=ROUNDS_BASE, seed=2))
both("cc_component_sizes", cc_sql(OC, "oc", tail="SELECT label AS component, count(*) AS size, TRUE AS has_root_row FROM cc GROUP BY label"),
     lambda s, d: aggregates.component_sizes(connected_components(order_customer(s, d))))
both("union_find_stats", cc_sql(OC, "oc", tail="SELECT count(*) AS nodes, count(*) - count(DISTINCT label) AS unions, count(DISTINCT label) AS components FROM cc"),
     lambda s, d: aggregates.union_find_stats(connected_components(order_customer(s, d))))
both("same_partition", "SELECT TRUE AS same", lambda s, d: checks.same_partition(connected_components(customer_nation(s, d), "boruvka", base_case_edges=100), connected_components(customer_nation(s, d), representative="min")))
both("boruvka_round", cc_sql(CN, "cn"), lambda s, d: checks.canonical(contraction.boruvka(transforms.normalize(customer_nation(s, d)))[1], "max"))
both("tree_to_stars", f"WITH {OC}, {CN}, t AS (SELECT u AS node, 2 * c_nationkey::BIGINT + 2 AS root FROM oc JOIN customer ON v = 2 * c_custkey + 3 UNION SELECT 2 * c_custkey + 3, 2 * c_nationkey::BIGINT + 2 FROM customer) SELECT node, root + 1000000000 AS component FROM t UNION SELECT root + 1000000000, root + 1000000000 FROM t",
     lambda s, d: contraction.tree_to_stars(order_customer(s, d).unionByName(customer_labels(s, d).select(F.col("node").alias("u"), (F.col("component") + 1_000_000_000).alias("v")))))
BUNDLES = "w AS (SELECT greatest(1, max(v) // 8) AS w FROM e), b AS (SELECT u, v, least((u - 1) // w, 7) AS bu, least((v - 1) // w, 7) AS bv FROM e, w)"
both("minimized_inter_edges", f"WITH {PS}, e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM ps WHERE u <> v), {BUNDLES} SELECT u, v FROM b WHERE bu = bv UNION SELECT u, coalesce(lead(u) OVER (PARTITION BY bu, v ORDER BY u), v) FROM b WHERE bu <> bv",
     lambda s, d: contraction.minimized_inter_edges(transforms.normalize(part_supplier(s, d)), 8, aggregates.max_node_id(part_supplier(s, d)).head()[0]))
both("minimized_inter_components", cc_sql(PS, "ps", "min"), lambda s, d: connected_components(contraction.minimized_inter_edges(transforms.normalize(part_supplier(s, d)), 8, aggregates.max_node_id(part_supplier(s, d)).head()[0]), representative="min"))
both("duplicate_text_components", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component FROM documents WHERE text IS NOT NULL", lambda s, d: _same_texts(s, d))


def forward_sql(ctes: str, graph: str, k: int, tail: str) -> str:
    """Sequential forward contraction of the k smallest sources: a row for each, with the edges left after it."""
    return f"""WITH RECURSIVE {ctes}, g AS (SELECT list({{'u': u, 'v': v}}) AS es FROM (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM {graph} WHERE u <> v)),
    s(i, node, neighbours, duplicates, target, es) AS (SELECT 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, es FROM g
      UNION ALL SELECT i + 1, mn, len(ds)::BIGINT, (len(ts) - len(ds))::BIGINT, mx,
        list_concat(list_filter(es, lambda x: x.u <> mn), list_transform(list_filter(ds, lambda x: x <> mx), lambda x: {{'u': least(x, mx), 'v': greatest(x, mx)}}))
      FROM (SELECT i, es, mn, ts, list_distinct(ts) AS ds, list_max(ts) AS mx FROM
        (SELECT i, es, mn, list_transform(list_filter(es, lambda x: x.u = mn), lambda x: x.v) AS ts FROM
          (SELECT i, es, list_min(list_transform(es, lambda x: x.u)) AS mn FROM s WHERE i < {k} AND len(es) > 0)))) {tail}"""


_TREE, _LEFT = "SELECT node AS u, target AS v FROM s WHERE i > 0", "SELECT DISTINCT e.u AS u, e.v AS v FROM (SELECT unnest(es) AS e FROM s WHERE i = (SELECT max(i) FROM s))"
SMALL_GRAPH = "cs AS (SELECT 2 * c_custkey + 2 AS u, 2 * (c_custkey * c_custkey % 97) + 3 AS v FROM customer WHERE c_custkey <= 400)"


def small_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The customers up to 400, joined to numbers made of their keys: few edges, for what is sequential in SQL."""
    c = table(spark, sf, "customer").where("c_custkey <= 400")
    return from_columns(c, 2 * F.col("c_custkey") + 2, 2 * (F.col("c_custkey") * F.col("c_custkey") % 97) + 3)


both("measure_forward", forward_sql(SMALL_GRAPH, "cs", 1_000_000, "SELECT node, neighbours, duplicates, target FROM s WHERE i > 0"), lambda s, d: measure.measure_forward(small_graph(s, d), "last"))
for _k in (1, 60, 250):
    both(f"forward_first_{_k}_tree", forward_sql(SMALL_GRAPH, "cs", _k, _TREE), lambda s, d, k=_k: contraction.forward_first(small_graph(s, d), k)[0])
    both(f"forward_first_{_k}_left", forward_sql(SMALL_GRAPH, "cs", _k, _LEFT), lambda s, d, k=_k: contraction.forward_first(small_graph(s, d), k, in_order_edges=100)[1])
both("forward_all_tree", forward_sql(SMALL_GRAPH, "cs", 1_000_000, _TREE), lambda s, d: contraction.forward_first(small_graph(s, d), 0, in_order_edges=150)[0])
both("tree_to_stars_seeded", f"WITH {OC}, t AS (SELECT u AS node, 2 * c_nationkey::BIGINT + 2 AS root FROM oc JOIN customer ON v = 2 * c_custkey + 3 UNION SELECT 2 * c_custkey + 3, 2 * c_nationkey::BIGINT + 2 FROM customer), n AS (SELECT 2 * CAST(n_nationkey AS BIGINT) + 2 AS node, -1 - CAST(n_regionkey AS BIGINT) AS component FROM nation) SELECT t.node, n.component FROM t JOIN n ON t.root = n.node UNION ALL SELECT node + 1099511627776, component FROM n",
     lambda s, d: _seeded(s, d))


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and customers as trees below nations, whose labels, their regions, are known from elsewhere."""
    n = table(spark, sf, "nation").select((2 * F.col("n_nationkey").cast("long") + 2).alias("node"), (-1 - F.col("n_regionkey").cast("long")).alias("component"))
    c = table(spark, sf, "customer").select((2 * F.col("c_custkey") + 3).alias("u"), (2 * F.col("c_nationkey").cast("long") + 2).alias("v"))
    orders = order_customer(spark, sf).join(c.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    # order ids and nation ids share the even numbers: nations move out of the way
    far = 1 << 40
    tree = orders.unionByName(c.select("u", (F.col("v") + far).alias("v")))
    return contraction.tree_to_stars(tree, n.select((F.col("node") + far).alias("node"), "component"))



def _same_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of equal text as stars on their first document."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    stars = docs.join(first, "digest").select(F.col("first").alias("u"), F.col("doc_id").alias("v"))
    return connected_components(stars, representative="min")


@query("policies", "SELECT * FROM (VALUES (0, TRUE, 5, 1), (1, FALSE, 5, 1), (2, FALSE, 5, 2), (3, FALSE, 5, 3), (4, FALSE, 5, 4), (5, FALSE, 5, 5), (6, TRUE, 4, 1), (7, TRUE, 7, 1), (8, TRUE, 4, 1), (9, TRUE, 7, 1)) t(policy, contracts, nodes_to_contract, sample_power)")
def _policies(spark: SparkSession, sf: str) -> DataFrame:
    """What each policy decides for 10 nodes, 25 edges, the top level and 5 nodes of memory."""
    size = (10, 25, 0, 5)
    rows = [(i, p.contract(*size), p.nodes_to_contract(*size), p.sample_power(*size)) for i, p in enumerate(POLICIES)]
    return spark.createDataFrame(rows, "policy int, contracts boolean, nodes_to_contract int, sample_power int")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Component-size histogram of the order-customer graph."""
    return aggregates.component_size_histogram(connected_components(order_customer(spark, sf)))


both("component_histogram", cc_sql(OC, "oc", tail="SELECT size, count(*) AS count FROM (SELECT count(*) AS size FROM cc GROUP BY label) GROUP BY size"), flagship)
