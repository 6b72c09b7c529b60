"""Cycles: existence, a witness, all simple directed cycles, and a basis of the undirected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.operators.components import strong_components, trim, weak_components
from graphlake.plans.iterate import grow
from graphlake.plans.staging import stage


def has_directed_cycle(graph: Graph) -> DataFrame:
    """(has_cycle) in one row."""
    core = trim(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    return core.agg((F.count(F.lit(1)) > 0).alias("has_cycle"))


def directed_cycle_witness(graph: Graph) -> DataFrame:
    """(node, predecessor) along one cycle, empty if there is none.

    A self-loop at the least position wins; otherwise a shortest cycle through the least vertex of the strong component of least position.
    """
    place = graph.vertices.select("id", "pos")
    loops = graph.edges.where("src = dst").select(F.col("src").alias("id")).join(place, "id").orderBy("pos").limit(1)
    loop = loops.first()
    if loop is not None:
        return graph.edges.where((F.col("src") == loop["id"]) & (F.col("dst") == loop["id"])).select(F.col("src").alias("node"), F.col("dst").alias("predecessor")).distinct()
    parts = strong_components(graph)
    big = parts.groupBy("component").count().where("count > 1").join(place.withColumnRenamed("id", "component"), "component").orderBy("pos").limit(1).first()
    if big is None:
        return graph.edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("predecessor"))
    root = big["component"]
    inside = parts.where(F.col("component") == root).select("id")
    arcs = graph.edges.join(inside, F.col("src") == F.col("id"), "left_semi").join(inside, F.col("dst") == F.col("id"), "left_semi").select("src", "dst").distinct()
    first = inside.where(F.col("id") == root).select("id", F.array("id").alias("path"))

    def level(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        met = frontier.withColumnRenamed("id", "src").join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("way"))
        return met.join(seen.select("id"), "id", "left_anti").select("id", F.concat("way", F.array("id")).alias("path"))

    ways = grow(level, first)
    back = ways.join(arcs.where(F.col("dst") == root), F.col("id") == F.col("src")).orderBy(F.size("path"), "path").limit(1)
    steps = back.select(F.explode(F.arrays_zip(F.concat(F.slice("path", 2, 1 << 30), F.array(F.lit(root))).alias("node"), F.col("path").alias("predecessor"))).alias("s"))
    return steps.select("s.node", "s.predecessor")


def simple_cycles(graph: Graph, nodes: list | None = None, include: bool = True, max_length: int | None = None) -> DataFrame:
    """(path): every simple directed cycle once, from its vertex of least position; parallel edges count once.

    ``nodes`` keeps the cycles with at least one of them, or with ``include=False`` those with none. Paths grow only
    within strong components and through positions above their start; ``max_length`` bounds the number of edges.
    """
    place = graph.vertices.select("id", "pos")
    if nodes and not include:
        place = place.where(~F.col("id").isin(nodes))
    arcs = graph.edges.select("src", "dst").distinct()
    arcs = arcs.join(place.withColumnsRenamed({"id": "src", "pos": "u"}), "src").join(place.withColumnsRenamed({"id": "dst", "pos": "v"}), "dst")
    loops = arcs.where("u = v").select(F.array("src").alias("path"))
    part = strong_components(Graph(place, graph.edges.join(place.select(F.col("id").alias("src")), "src", "left_semi").join(place.select(F.col("id").alias("dst")), "dst", "left_semi")))
    both = arcs.where("u <> v").join(part.withColumnsRenamed({"id": "src", "component": "cs"}), "src").join(part.withColumnsRenamed({"id": "dst", "component": "cd"}), "dst")
    arcs = stage(both.where("cs = cd").select("src", "dst", "u", "v"), "cycle-arcs")
    first = arcs.where("v > u").select(F.col("u").alias("start"), F.col("v").alias("last"), F.array("src", "dst").alias("path"))

    def longer(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        step = frontier.join(arcs.select(F.col("u").alias("last"), F.col("v").alias("to"), F.col("dst").alias("next")), "last")
        return step.where((F.col("to") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select("start", F.col("to").alias("last"), F.concat("path", F.array("next")).alias("path"))

    ways = grow(longer, first, (max_length - 2) if max_length else None, "cycle") if max_length is None or max_length > 2 else first
    closed = ways.join(arcs.select(F.col("u").alias("last"), F.col("v").alias("start")), ["last", "start"], "left_semi").select("path").unionByName(loops)
    if max_length:
        closed = closed.where(F.size("path") <= max_length)
    if nodes and include:
        closed = closed.where(F.arrays_overlap("path", F.array(*[F.lit(n) for n in nodes])))
    return closed


def cycle_basis(graph: Graph, nodes: list | None = None, include: bool = True) -> DataFrame:
    """(cycle, path): a basis of the undirected cycles, one for each edge outside a breadth-first spanning forest; a self-loop
    is a cycle of one. Parallel edges count once. ``nodes`` filters as in ``simple_cycles``."""
    place = graph.vertices.select("id", "pos")
    ends = graph.edges.select("src", "dst").join(place.withColumnsRenamed({"id": "src", "pos": "a"}), "src").join(place.withColumnsRenamed({"id": "dst", "pos": "b"}), "dst")
    pairs = stage(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "basis")
    loops = pairs.where("u = v").select(F.array("u").alias("way"))
    pairs = pairs.where("u <> v")
    arcs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = weak_components(graph).where("id = component").join(place, "id").select(F.col("pos").alias("n"), F.array("pos").alias("way"))

    def level(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        met = frontier.withColumnRenamed("n", "u").join(arcs, "u").groupBy(F.col("v").alias("n")).agg(F.min("way").alias("way"))
        return met.join(seen.select("n"), "n", "left_anti").select("n", F.concat("way", F.array("n")).alias("way"))

    ways = grow(level, roots, label="basis")
    tree = ways.where("size(way) > 1").select(F.element_at("way", -2).alias("p"), "n").select(F.least("p", "n").alias("u"), F.greatest("p", "n").alias("v"))
    rest = pairs.join(tree, ["u", "v"], "left_anti")
    rest = rest.join(ways.select(F.col("n").alias("u"), F.col("way").alias("wu")), "u").join(ways.select(F.col("n").alias("v"), F.col("way").alias("wv")), "v")
    shared = F.size(F.filter(F.arrays_zip(F.col("wu").alias("x"), F.col("wv").alias("y")), lambda z: z["x"] == z["y"]))
    rest = rest.withColumn("k", shared)
    far = 1 << 30
    way = F.concat(F.reverse(F.slice("wu", F.col("k"), F.lit(far))), F.slice("wv", F.col("k") + 1, F.lit(far)))
    cycles = rest.select(way.alias("way")).unionByName(loops)
    cycles = cycles.select(F.xxhash64("way").alias("cycle"), F.posexplode("way").alias("i", "pos")).join(place, "pos")
    cycles = cycles.groupBy("cycle").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("path"))
    if nodes:
        hit = F.arrays_overlap("path", F.array(*[F.lit(n) for n in nodes]))
        cycles = cycles.where(hit if include else ~hit)
    return cycles


def cycle_rank(graph: Graph) -> DataFrame:
    """(rank) = edges - vertices + components, parallel edges once: the size of every basis."""
    e = graph.edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().agg(F.count(F.lit(1)).alias("e"))
    c = weak_components(graph).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("c"))
    return e.join(c).select((F.col("e") - F.col("n") + F.col("c")).alias("rank"))


def all_cycles(graph: Graph, directed: bool = False, nodes: list | None = None, include: bool = True) -> DataFrame:
    """(path) of all simple directed cycles, or of a basis of the undirected ones."""
    return simple_cycles(graph, nodes, include) if directed else cycle_basis(graph, nodes, include).select("path")
