"""k-cores, label propagation, modularity, and communities by local moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph, cost
from graphlake.operators.features import one_hot, property_table
from graphlake.plans.numbering import dense_index
from graphlake.plans.staging import discard, stage

SETTLED = 4  # rounds, in which every vertex has its turn twice, that together must raise the quality of moves


def k_core(graph: Graph, k: int = 1) -> Graph:
    """What is left when vertices of degree under k go, repeatedly. Self-loops count twice, parallel edges each."""
    edges, size = stage(graph.edges, "core"), -1
    while True:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
        deep = ends.groupBy("id").count().where(F.col("count") >= k).select("id")
        last, edges = edges, stage(edges.join(deep.withColumnRenamed("id", "src"), "src", "left_semi").join(deep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(graph.edges.columns), "core")
        discard(last)
        now = edges.count()
        if now == size:
            break
        size = now
    if k <= 0:
        return Graph(graph.vertices, edges)
    return Graph(graph.vertices.join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi"), edges)


def _votes(graph: Graph, directed: bool) -> DataFrame:
    """(id, other): the 0/1 adjacency; a self-loop is a neighbour."""
    return graph.arcs(directed).select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()


def label_propagation(graph: Graph, directed: bool = False, max_rounds: int = 1000) -> DataFrame:
    """(id, label): every vertex takes its neighbours' most frequent label, all at once; of equally frequent ones its own, else the least.

    Labels start as positions. It stops when nothing changes or all labels are those of two rounds before, since two sides may swap
    labels for ever; the labels are then those that ``max_rounds`` rounds would give.
    """
    near = stage(_votes(graph, directed), "labels-near")
    state = table = stage(graph.vertices.select("id", F.col("pos").alias("label"), F.lit(None).cast("long").alias("own")), "labels")
    for r in range(1, max_rounds + 1):
        votes = near.join(state.select(F.col("id").alias("other"), "label"), "other").groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
        own = state.select("id", F.col("label").alias("own"), F.col("own").alias("older"))
        best = votes.join(own, "id").groupBy("id").agg(F.max(F.struct("n", (F.col("label") == F.col("own")).alias("same"), (-F.col("label")).alias("low"))).alias("b"))
        nxt = stage(own.join(best, "id", "left").select("id", F.coalesce(-F.col("b.low"), "own").alias("label"), "own", "older"), "labels")
        discard(table)
        table = nxt
        moved, other = nxt.agg(F.max(F.col("label") != F.col("own")), F.max(~F.col("label").eqNullSafe(F.col("older")))).first()
        state = nxt.select("id", "label", "own")
        if not moved:
            break
        if not other:  # two rounds repeat from here on
            return state.select("id", "label") if (max_rounds - r) % 2 == 0 else state.select("id", F.col("own").alias("label"))
    return state.select("id", "label")


def cluster_edges(graph: Graph, assigned: DataFrame) -> DataFrame:
    """(source, target, weight, count) of edges between (and within) clusters of ``assigned`` (id, cluster), directions kept."""
    e = graph.edges.select("src", "dst", cost("weight").alias("w"))
    e = e.join(assigned.withColumnsRenamed({"id": "src", "cluster": "source"}), "src").join(assigned.withColumnsRenamed({"id": "dst", "cluster": "target"}), "dst")
    return e.groupBy("source", "target").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("count"))


def boundary_weights(graph: Graph, assigned: DataFrame) -> DataFrame:
    """(cluster, sum_tot): the weight of edges that cross each cluster's boundary."""
    crossing = cluster_edges(graph, assigned).where("source <> target").select(F.explode(F.array("source", "target")).alias("cluster"), "weight")
    sums = crossing.groupBy("cluster").agg(F.sum("weight").alias("sum_tot"))
    return assigned.select("cluster").distinct().join(sums, "cluster", "left").select("cluster", F.coalesce("sum_tot", F.lit(0.0)).alias("sum_tot"))


def modularity(graph: Graph, assigned: DataFrame, directed: bool = False) -> DataFrame:
    """(value) of the 0/1 adjacency under (id, cluster)."""
    near = _votes(graph, directed)
    rows = near.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    both = near.join(assigned.withColumnRenamed("cluster", "a"), "id").join(assigned.withColumnsRenamed({"id": "other", "cluster": "b"}), "other")
    inside = both.where("a = b").agg(F.count(F.lit(1)).alias("inside"))
    sums = rows.join(assigned, "id").groupBy("cluster").agg(F.sum("k").alias("k"))
    total = sums.agg(F.sum("k").alias("m2"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    m2 = F.nullif(F.col("m2").cast("double"), F.lit(0.0))
    return inside.join(total).select(F.coalesce((F.col("inside") - F.col("squares") / m2) / m2, F.lit(0.0)).alias("value"))


def inertial_modularity(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """(value), rounded to 4 places, of (id, vector) under (id, cluster): likeness of properties within clusters.

    With I_i the sum of i's squared distances to all and V their scatter about the mean, it sums I_i I_j / (2nV)^2 - d_ij^2 / (2nV)
    over ordered pairs of a cluster, from sums of vectors and squares alone. 0 where nothing varies.
    """
    v = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("x"))
    total = lambda df, by: df.select(*by, F.posexplode("x").alias("i", "y")).groupBy(*by, "i").agg(F.sum("y").alias("y"))
    square = F.aggregate("x", F.lit(0.0), lambda s, y: s + y * y)
    whole = total(v, []).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("s")).join(v.agg(F.sum(square).alias("q"), F.count(F.lit(1)).alias("n")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    whole = whole.withColumn("v", F.col("q") - dot(F.col("s"), F.col("s")) / F.col("n"))
    each = v.join(F.broadcast(whole)).select("id", "x", "n", "v", square.alias("xx"), (F.col("n") * square - 2 * dot(F.col("x"), F.col("s")) + F.col("q")).alias("own")).join(assigned, "id")
    scale = F.first(2 * F.col("n") * F.col("v"))
    sums = each.groupBy("cluster").agg(F.sum("own").alias("o"), F.sum(F.col("own") * F.col("own")).alias("oo"), F.sum("xx").alias("q"), F.count(F.lit(1)).alias("m"), scale.alias("p"))
    parts = total(each, ["cluster"]).groupBy("cluster").agg(F.sum(F.col("y") * F.col("y")).alias("ss"))
    p = F.nullif(F.col("p"), F.lit(0.0))
    value = (F.col("o") * F.col("o") - F.col("oo")) / (p * p) - 2 * (F.col("m") * F.col("q") - F.col("ss")) / p
    return sums.join(parts, "cluster").agg(F.round(F.coalesce(F.sum(value), F.lit(0.0)), 4).alias("value"))


def _cluster_sums(state: DataFrame, alike: bool) -> DataFrame:
    """(root, total, size) of (id, root, k), and with ``alike`` the sums of the members' vectors x, squares xx and inertias own."""
    sums = [F.sum("k").alias("total"), F.count(F.lit(1)).alias("size")]
    if not alike:
        return state.groupBy("root").agg(*sums)
    sums += [F.sum("own").alias("o"), F.sum(F.col("own") * F.col("own")).alias("oo"), F.sum("xx").alias("q")]
    each = state.select("root", F.posexplode("x").alias("i", "y")).groupBy("root", "i").agg(F.sum("y").alias("y"))
    vectors = each.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y"))), lambda v: v["y"]).alias("s"))
    return state.groupBy("root").agg(*sums).join(vectors, "root", "left")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _inertias(vectors: DataFrame) -> tuple[DataFrame, float]:
    """(id, x, xx, own) with own the sum of squared distances to all, and 2nV with V the scatter about the mean."""
    v = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("x")).withColumn("xx", _dot("x", "x"))
    total = v.select(F.posexplode("x").alias("i", "y")).groupBy("i").agg(F.sum("y").alias("y")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("s"))
    whole = v.agg(F.sum("xx").alias("q"), F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    row = whole.select("q", "n", (F.col("q") - _dot("s", "s") / F.col("n")).alias("v")).first()
    own = v.join(F.broadcast(whole)).select("id", "x", "xx", (F.col("n") * F.col("xx") - 2 * _dot("x", "s") + F.col("q")).alias("own"))
    return own, 2.0 * (row["n"] or 0) * max(row["v"] or 0.0, 0.0)


def louvain(graph: Graph, directed: bool = False, threshold: float = 1e-4, max_rounds: int = 1000, inertial_weight: float = 0.0, key: str | None = None, involved: list[str] | None = None, uninvolved: list[str] | None = None) -> DataFrame:
    """(id, cluster): one level of modularity moves over the 0/1 adjacency. Clusters are numbered from 1 by their least position.

    It moves in rounds over the whole cluster, the same at every size. In a round every vertex works out what the best neighbouring community would
    gain, from sums per community; of those that would gain, half, by hash, move, and the other half may in the next round. Of two communities of one vertex,
    only the later joins the earlier, so they don't swap. It ends when no vertex would gain, or when ``SETTLED`` rounds together raise the quality by less
    than ``threshold``; the partition of highest quality is the result. With ``inertial_weight`` the likeness of properties counts as well.
    """
    place = graph.vertices.select("id", "pos")
    near = _votes(graph, directed)
    near = near.join(place.withColumnsRenamed({"id": "id", "pos": "u"}), "id").join(place.withColumnsRenamed({"id": "other", "pos": "v"}), "other")
    near = stage(near.select("u", "v"), "moves-near")
    nodes = place.join(near.groupBy(F.col("u").alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("k")), "pos", "left").select(F.col("pos").alias("id"), F.coalesce("k", F.lit(0.0)).alias("k"), F.col("id").alias("name"))
    alike, scale = False, 0.0
    if inertial_weight:
        encoded = one_hot(property_table(graph.vertices, key), involved, uninvolved).select("id", "vector")
        own, scale = _inertias(encoded)
        alike = scale > 0
        if alike:
            nodes = nodes.join(own.withColumnRenamed("id", "name"), "name")
    nodes = stage(nodes, "moves-nodes")
    m2 = nodes.agg(F.sum("k")).first()[0] or 0.0
    state = stage(nodes.select("id", F.col("id").alias("root")), "moves")
    if m2:
        state = _settle_moves(near.where("u <> v"), nodes, state, m2, threshold, max_rounds, inertial_weight if alike else 0.0, scale, near.where("u = v").count())
    first = state.groupBy("root").agg(F.min("id").alias("first"))
    named = dense_index(first, ["first"], "n").select("root", (F.col("n") + 1).alias("cluster"))
    return state.join(named, "root").select("id", "cluster").withColumnRenamed("id", "pos").join(place, "pos").select("id", "cluster")


def _settle_moves(near: DataFrame, nodes: DataFrame, state: DataFrame, m2: float, threshold: float, max_rounds: int, weight: float, scale: float, loops: int) -> DataFrame:
    """(id, root) of highest quality that rounds of moves reach."""
    best, kept, history = None, state, []
    likeness = lambda o, m, q, s: 2 * (F.col("own") * o / scale**2 - (m * F.col("xx") - 2 * _dot(F.col("x"), s) + q) / scale)  # noqa: E731  of a vertex to a cluster with these sums
    for r in range(max_rounds):
        full = state.join(nodes, "id")
        sums = stage(_cluster_sums(full, bool(weight)), "moves-sums")
        links = near.join(state.withColumnsRenamed({"id": "v", "root": "to"}), "v").groupBy(F.col("u").alias("id"), "to").agg(F.count(F.lit(1)).alias("n"))
        here = full.join(sums, "root").withColumnsRenamed({c: f"h_{c}" for c in sums.columns if c != "root"})
        scored = here.join(links, "id", "left").join(sums.withColumnRenamed("root", "to"), "to", "left")
        stays = F.col("to") == F.col("root")
        gain = F.col("n") - F.col("total") * F.col("k") / m2
        home = -(F.col("h_total") - F.col("k")) * F.col("k") / m2
        if weight:
            gain = gain + weight * m2 / 2 * likeness(F.col("o"), F.col("size"), F.col("q"), F.col("s"))
            left = F.zip_with("h_s", "x", lambda a, b: a - b)
            home = home + weight * m2 / 2 * likeness(F.col("h_o") - F.col("own"), F.col("h_size") - 1, F.col("h_q") - F.col("xx"), left)
        fine = ~stays & ((F.col("h_size") > 1) | (F.col("size") > 1) | (F.col("to") < F.col("root")))
        scored = scored.select("id", "root", home.alias("home"), F.when(stays, F.col("n")).alias("inside"), F.when(fine, F.struct(gain.alias("gain"), (-F.col("to")).alias("low"))).alias("move"))
        pick = scored.groupBy("id", "root").agg(F.first("home").alias("home"), F.max("inside").alias("inside"), F.max("move").alias("move"))
        wants = F.coalesce(F.col("move.gain") > F.col("home") + F.coalesce("inside", F.lit(0)) + 1e-9, F.lit(False))
        turn = F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2
        table = stage(pick.select("id", "root", F.coalesce("inside", F.lit(0)).alias("inside"), wants.alias("wants"), F.when(wants & turn, -F.col("move.low")).otherwise(F.col("root")).alias("to")), "moves-picked")
        found = table.agg(F.sum("inside").alias("inside"), F.sum(F.col("wants").cast("int")).alias("wants")).first()
        squares = sums.agg(F.sum(F.col("total") * F.col("total"))).first()[0]
        quality = ((found["inside"] + loops) - squares / m2) / m2
        if weight:
            value = (F.col("o") * F.col("o") - F.col("oo")) / scale**2 - 2 * (F.col("size") * F.col("q") - _dot("s", "s")) / scale
            quality += weight * sums.agg(F.sum(value)).first()[0]
        if best is None or quality > best:
            best, kept = quality, state
        history.append(best)
        done = not found["wants"] or (len(history) > SETTLED and best - history[-1 - SETTLED] < threshold)
        discard(sums)
        if done:
            return kept
        state = table.select("id", F.col("to").alias("root"))
    raise RuntimeError(f"moves do not settle in {max_rounds} rounds")


def i_louvain(graph: Graph, key: str, directed: bool = False, threshold: float = 1e-4, involved: list[str] | None = None, uninvolved: list[str] | None = None, inertial_weight: float = 1.0) -> DataFrame:
    """``louvain`` with the likeness of the vertices' properties in what a move gains."""
    return louvain(graph, directed, threshold, inertial_weight=inertial_weight, key=key, involved=involved, uninvolved=uninvolved)
