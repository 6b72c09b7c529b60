"""The library's queries over the driver's tables, each on whole tables. SQL for them is in ``graphlake.sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.operators import centrality, community, components, cycles, features, matching, mining, paths, spanning, structure, traverse
from graphlake.sources import projections as P

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[P.Tables], DataFrame]) -> Callable[[P.Tables], DataFrame]:
    _QUERIES[f.__name__] = lambda spark, sf_dir: f(P.Tables(spark, sf_dir))
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


@query
def degree(t):
    return structure.degrees(P.trade(t))


@query
def degree_supply(t):
    return structure.degrees(P.supply(t))


@query
def in_degree_of(t):
    return structure.in_degree(P.trade(t), 3).withColumn("id", F.col("id").cast("long"))


@query
def out_degree_of(t):
    return structure.out_degree(P.trade(t), 3).withColumn("id", F.col("id").cast("long"))


@query
def neighbors_all(t):
    return structure.neighbors(P.chain(t), 7).select("neighbor")


@query
def neighbors_source(t):
    return structure.neighbors(P.chain(t), 7, "source").select("neighbor")


@query
def neighbors_target(t):
    return structure.neighbors(P.chain(t), 7, "target").select("neighbor")


@query
def incident_edges(t):
    return structure.incident_edges(P.chain(t), 7).select("src", "dst", "weight")


@query
def out_edges(t):
    return structure.out_edges(P.chain(t), 7).select("src", "dst", "weight")


@query
def adjacency_undirected(t):
    return structure.adjacency(P.trade(t))


@query
def adjacency_directed(t):
    return structure.adjacency(P.trade(t), directed=True)


@query
def bfs_directed(t):
    return traverse.bfs(P.geo(t), [1]).select("id", "depth")


@query
def bfs_undirected(t):
    return traverse.bfs(P.geo(t), [1_000_001], directed=False).select("id", "depth")


@query
def bfs_filtered(t):
    """Nations below 1,012 are not entered."""
    return traverse.bfs(P.geo(t), [1], allow=lambda cur, nxt: (nxt < 1000) | (nxt >= 1012)).select("id", "depth")


@query
def bfs_visits(t):
    return traverse.bfs_visits(P.geo(t), 1)


@query
def dfs_events(t):
    return traverse.dfs(P.trade(t), 0)


@query
def weak_components(t):
    return components.weak_components(P.supply(t))


@query
def weak_components_geo(t):
    return components.weak_components(P.geo(t))


@query
def strong_components(t):
    return components.strong_components(P.chain(t))


@query
def strong_components_geo(t):
    return components.strong_components(P.geo(t))


@query
def has_directed_cycle(t):
    return cycles.has_directed_cycle(P.chain(t))


@query
def has_directed_cycle_geo(t):
    return cycles.has_directed_cycle(P.geo(t))


@query
def directed_cycle_witness(t):
    return cycles.directed_cycle_witness(P.chain(t).without_loops())


@query
def simple_cycles(t):
    return cycles.simple_cycles(P.flows(t))


@query
def simple_cycles_include(t):
    return cycles.simple_cycles(P.flows(t), ["click"])


@query
def simple_cycles_exclude(t):
    return cycles.simple_cycles(P.flows(t), ["click"], include=False)


@query
def simple_cycles_short(t):
    return cycles.simple_cycles(P.trade(t), max_length=3)


@query
def cycle_basis(t):
    return cycles.cycle_basis(P.trade(t)).select("path")


@query
def cycle_rank(t):
    return cycles.cycle_rank(P.supply(t))


@query
def shortest_lengths(t):
    return paths.shortest_lengths(P.geo(t), 1_000_001)


@query
def shortest_weighted(t):
    return paths.shortest_lengths(P.chain(t), 0, directed=True, weight="weight")


@query
def shortest_all_paths(t):
    return paths.shortest_paths(P.trade(t), 0, directed=True, weight="weight").select("id", "length", "path")


@query
def shortest_path_pair(t):
    return paths.shortest_path(P.chain(t), 0, 5, directed=True, weight="weight").select("length", "path")


@query
def all_simple_paths(t):
    return paths.simple_paths(P.flows(t), "view", "click", directed=True)


@query
def all_simple_paths_bounded(t):
    return paths.simple_paths(P.trade(t), 0, 7, directed=True, max_hops=3)


@query
def all_pairs_hops(t):
    return paths.all_pairs_hops(P.trade(t), directed=True)


@query
def all_pairs_hops_chain(t):
    return paths.all_pairs_hops(P.chain(t), directed=True)


@query
def all_pairs_hops_undirected(t):
    return paths.all_pairs_hops(P.chain(t))


@query
def sssp_predecessor(t):
    return paths.sssp(P.chain(t), 0, weight="weight")


@query
def mst_kruskal(t):
    return spanning.minimum_spanning_forest(P.trade(t), "weight").select("src", "dst", "weight")


@query
def mst_kruskal_chain(t):
    return spanning.minimum_spanning_forest(P.chain(t), "weight").select("src", "dst", "weight")


@query
def mst_prim(t):
    return spanning.minimum_spanning_forest(P.trade(t), "weight", "prim").select("src", "dst", "weight")


@query
def pagerank(t):
    return centrality.pagerank(P.trade(t), epsilon=0.0, max_rounds=20).select("id", F.round("rank", 9).alias("rank"))


@query
def pagerank_converged(t):
    """Until no rank changes by more than a millionth of a millionth."""
    return centrality.pagerank(P.trade(t), epsilon=1e-12, max_rounds=1000).select("id", F.round("rank", 9).alias("rank"))


@query
def pagerank_supply(t):
    return centrality.pagerank(P.supply(t), epsilon=0.0, max_rounds=8).select("id", F.round("rank", 9).alias("rank"))


@query
def pagerank_column_normalised(t):
    return centrality.pagerank(P.trade(t), epsilon=0.0, max_rounds=20, variant="column_normalised").select("id", F.round("rank", 9).alias("rank"))


@query
def k_core(t):
    return community.k_core(P.supply(t), 24).edges.select("src", "dst")


@query
def label_propagation(t):
    return community.label_propagation(P.chain(t), max_rounds=3)


@query
def label_propagation_converged(t):
    """To a fixpoint or the swap of two labellings, as after 1,000 rounds; ``label_propagation`` is the three rounds that SQL spells out."""
    return community.label_propagation(P.chain(t), max_rounds=1000)


@query
def louvain(t):
    return community.louvain(P.chain(t))


@query
def i_louvain(t):
    g = P.trade(t)
    named = g.vertices.withColumn("properties", F.struct(F.col("label").alias("region")))
    return community.i_louvain(Graph(named, g.edges), "properties")


def _by_label(g: Graph) -> DataFrame:
    return g.vertices.select("id", "cluster")


@query
def modularity_of_partition(t):
    g = P.chain(t)
    return community.modularity(g, _by_label(g)).select(F.round("value", 9).alias("value"))


@query
def inertial_modularity(t):
    v = P.vectors(t)
    return community.inertial_modularity(v, v.select("id", "cluster"))


@query
def cluster_edges(t):
    g = P.trade(t)
    return community.cluster_edges(g, _by_label(g))


@query
def boundary_weights(t):
    g = P.trade(t)
    return community.boundary_weights(g, _by_label(g))


@query
def kmeans(t):
    return features.kmeans(P.vectors(t), k=4)


@query
def kmeans_lloyd(t):
    return features.kmeans(P.vectors(t), k=4, max_iter=5)


def _pairs(t) -> DataFrame:
    """Each vector and the next by identifier (which are consecutive numbers)."""
    v = P.vectors(t)
    return v.select(F.col("id").alias("a"), F.col("vector").alias("x")).join(v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("vector").alias("y")), "a")


@query
def cosine_pairs(t):
    return _pairs(t).select("a", "b", F.round(features.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query
def nodes_cosine(t):
    return features.nodes_cosine(P.parts(t), 0).select("id", "pos", F.round("cosine", 6).alias("cosine"))


@query
def key_values(t):
    return features.key_values(P.parts(t))


@query
def one_hot(t):
    return features.one_hot(P.parts(t)).select("id", "vector")


@query
def property_keys(t):
    return features.property_keys(P.parts(t))


@query
def property_weights(t):
    return features.property_weights(P.parts(t)).select("id", "weights")


@query
def vector_ops(t):
    x, y = F.col("x"), F.col("y")
    r = lambda c: F.round(c, 6)
    return _pairs(t).select(
        "a", r(features.norm(features.add(x, y))).alias("norm_add"), r(features.norm(features.subtract(x, y))).alias("norm_subtract"), r(features.norm(features.average(x, 4))).alias("norm_average"),
        r(features.dot(features.negate(x), y)).alias("dot_negated"), r(features.distance(x, y)).alias("distance"), r(features.norm(features.normalize(x))).alias("norm_scaled"), (x == y).alias("equal"),
    )


@query
def frequent_labels(t):
    return mining.frequent_labels(P.baskets(t)[0], 10)


@query
def frequent_edges(t):
    return mining.frequent_edges(*P.baskets(t), min_support=10)


@query
def frequent_subgraphs(t):
    v, e = P.baskets(t)
    return mining.frequent_subgraphs(v, e, min_support=100, min_nodes=2, max_nodes=3, max_edges=2)


@query
def k_neighbour_units(t):
    return matching.k_neighbour_units(P.trade(t), 1).select("id", "label", "count")


@query
def nds_counts(t):
    g = P.trade(t)
    pairs = g.edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return matching.nds_counts(g, pairs, 1, ("0", None, "1"))


def _triangle(t) -> Graph:
    v = t.spark.createDataFrame([(0, 0, "0"), (1, 1, "1"), (2, 2, "2")], "id long, pos long, label string")
    e = t.spark.createDataFrame([(0, 1, 0), (1, 2, 1), (2, 0, 2)], "src long, dst long, pos long").select("src", "dst", "pos", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("label"))
    return Graph(v, e)


@query
def pattern_match(t):
    return matching.match(P.trade(t), _triangle(t), directed=True).select("candidate", "nodes")


@query
def pattern_match_exact(t):
    return matching.match_exact(P.chain(t), _triangle(t), directed=True)
