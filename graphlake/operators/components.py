"""Weak components by large-star / small-star contraction, and the dispatcher over both kinds of components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.plans.staging import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def star_contract(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge to another: root is the least node of its component, roots excluded.

    Each round joins every node to the least node it sees, so rounds grow with the logarithm of the longest chain.
    State is staged each round; what is staged is at most one row per edge.
    """
    a, b = F.col(src), F.col(dst)
    state = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state = stage(state, "star")
    before = None
    for _ in range(max_rounds):
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        last, state = state, stage(_small_star(_large_star(state)), "star")
        discard(last)
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def weak_components(graph) -> DataFrame:
    """(id, component): the component is named by its vertex of least position. Edges with an end that is no vertex are skipped."""
    place = graph.vertices.select("id", "pos")
    ends = graph.edges.select("src", "dst").distinct()
    ends = ends.join(place.withColumnsRenamed({"id": "src", "pos": "u"}), "src").join(place.withColumnsRenamed({"id": "dst", "pos": "v"}), "dst")
    roots = star_contract(ends.select("u", "v"), "u", "v")
    named = place.join(roots, F.col("pos") == F.col("node"), "left").select("id", F.coalesce("root", "pos").alias("root"))
    return named.join(place.select(F.col("pos").alias("root"), F.col("id").alias("component")), "root").select("id", "component")


def strong_components(graph, max_rounds: int = 10_000) -> DataFrame:
    """(id, component), named by the vertex of least position.

    Vertices without an edge in or out among those left are components by themselves and are trimmed first. Then every vertex takes the least
    position that reaches it; where that is a vertex's own, the vertices that reach it back within the same colour
    are its component. What is left goes around again.
    """
    place = graph.vertices.select("id", "pos")
    ends = graph.edges.select("src", "dst").where("src <> dst").distinct()
    arcs = ends.join(place.withColumnsRenamed({"id": "src", "pos": "u"}), "src").join(place.withColumnsRenamed({"id": "dst", "pos": "v"}), "dst").select("u", "v")
    arcs, done = stage(arcs, "scc"), None
    for _ in range(max_rounds):
        if arcs.isEmpty():
            break
        arcs, size = trim(arcs), -1
        if arcs.isEmpty():
            break
        colour = stage(arcs.select(F.col("u").alias("n")).union(arcs.select("v")).distinct().withColumn("c", F.col("n")), "scc-colour")
        while True:  # forward: the least position that reaches a vertex
            met = arcs.join(colour.select(F.col("n").alias("u"), "c"), "u").groupBy(F.col("v").alias("n")).agg(F.min("c").alias("m"))
            last, colour = colour, stage(colour.join(met, "n", "left").select("n", F.least("c", "m").alias("c")), "scc-colour")
            discard(last)
            now = colour.agg(F.sum("c")).first()[0]
            if now == size:
                break
            size = now
        found = stage(colour.where("n = c"), "scc-back")
        same = arcs.join(colour.select(F.col("n").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("n").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select("u", "v")
        same = stage(same, "scc-same")
        frontier = found
        while True:  # backward, within a colour
            frontier = frontier.select(F.col("n").alias("v"), "c").join(same, "v").select(F.col("u").alias("n"), "c").distinct().join(found.select("n"), "n", "left_anti")
            frontier = stage(frontier, "scc-back")
            if frontier.isEmpty():
                break
            found = stage(found.unionByName(frontier), "scc-found")
        done = found if done is None else done.unionByName(found)
        gone = found.select("n")
        arcs = stage(arcs.join(gone.withColumnRenamed("n", "u"), "u", "left_anti").join(gone.withColumnRenamed("n", "v"), "v", "left_anti"), "scc")
    else:
        raise RuntimeError(f"components left after {max_rounds} rounds")
    if done is None:
        return place.select("id", F.col("id").alias("component"))
    named = place.join(done, F.col("pos") == F.col("n"), "left").select("id", F.coalesce("c", "pos").alias("root"))
    return named.join(place.select(F.col("pos").alias("root"), F.col("id").alias("component")), "root").select("id", "component")


def trim(arcs: DataFrame) -> DataFrame:
    """(u, v) without those at vertices that lack an edge in or out, repeatedly: empty if and only if there is no cycle."""
    size, before = -1, None
    while True:
        arcs = arcs.join(arcs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(arcs.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        last, arcs = before, stage(arcs.select("u", "v"), "trim")
        before = arcs
        if last is not None:
            discard(last)
        now = arcs.count()
        if now == size or not now:
            return arcs
        size = now


def components(graph, directed: bool = False) -> DataFrame:
    return strong_components(graph) if directed else weak_components(graph)
