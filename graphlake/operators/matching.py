"""Pattern matching: exact embeddings by joins, and pruned neighbourhoods of candidates.

A pattern is a small Graph with labels on vertices (and on edges, if those are to agree); the driver reads it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.plans.iterate import grow
from graphlake.plans.staging import stage

MAX_PATTERN = 64


@dataclass(frozen=True)
class Pattern:
    nodes: list  # (id, label) by position
    edges: list  # (src, dst, label)
    directed: bool

    @staticmethod
    def read(pattern: Graph, directed: bool, label: str) -> Pattern:
        nodes = [(r["id"], r["l"]) for r in pattern.vertices.select("id", "pos", F.col(label).alias("l")).orderBy("pos").limit(MAX_PATTERN + 1).collect()]
        edges = [(r["src"], r["dst"], r["label"]) for r in pattern.edges.orderBy("pos").limit(MAX_PATTERN**2 + 1).collect()]
        if len(nodes) > MAX_PATTERN or len(edges) > MAX_PATTERN**2:
            raise ValueError(f"a pattern has at most {MAX_PATTERN} vertices")
        return Pattern(nodes, edges, directed)

    def hops(self, start) -> dict:
        near: dict = {}
        for s, d, _ in self.edges:
            near.setdefault(s, set()).add(d)
            if not self.directed:
                near.setdefault(d, set()).add(s)
        seen, rim = {start: 0}, [start]
        while rim:
            rim = [y for x in rim for y in near.get(x, ()) if y not in seen and not seen.update({y: seen[x] + 1})]
        return seen


def hops_from(graph: Graph, sources: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """(src, dst, dist) within ``k`` hops of each source (id)."""
    arcs = stage(graph.arcs(directed).where("src <> dst").select(F.col("src").alias("mid"), "dst").distinct(), "near-arcs")
    first = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("dist"))

    def level(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        met = frontier.select("src", F.col("dst").alias("mid")).join(arcs, "mid").select("src", "dst").distinct()
        return met.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("dist", F.lit(i))

    return grow(level, first, k, "near")


def k_neighbour_units(graph: Graph, k: int = 1, directed: bool = False, label: str = "label") -> DataFrame:
    """(id, label, count, distances in order) of the vertices within ``k`` hops of each vertex, itself left out."""
    near = hops_from(graph, graph.vertices.select("id"), k, directed).where("dist > 0")
    labels = graph.vertices.select(F.col("id").alias("dst"), F.col(label).alias("label"))
    return near.join(labels, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("dist")).alias("distances"))


def nds_counts(graph: Graph, pairs: DataFrame, k: int, structure: tuple, directed: bool = False, label: str = "label") -> DataFrame:
    """(a, b, count): edges like ``structure`` (label, edge label or None, label), either way round, in the graph that the vertices within ``k`` hops of both
    a and b induce, for each pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    near = stage(hops_from(graph, ends, k, directed).select("src", "dst"), "nds-near")
    both = pairs.select("a", "b").distinct().join(near.withColumnsRenamed({"src": "a", "dst": "n"}), "a").join(near.withColumnsRenamed({"src": "b", "dst": "n"}), ["b", "n"], "left_semi")
    labels = graph.vertices.select("id", F.col(label).alias("l"))
    e = graph.edges.select("src", "dst", "pos", "label").join(labels.withColumnsRenamed({"id": "src", "l": "l1"}), "src").join(labels.withColumnsRenamed({"id": "dst", "l": "l2"}), "dst")
    one, line, two = structure
    fits = ((F.col("l1") == one) & (F.col("l2") == two)) | ((F.col("l1") == two) & (F.col("l2") == one))
    e = e.where(fits if line is None else fits & (F.col("label") == line)).select("src", "dst", "pos")
    inside = both.withColumnRenamed("n", "src").join(e, "src").join(both.withColumnRenamed("n", "dst"), ["a", "b", "dst"], "left_semi")
    return pairs.select("a", "b").distinct().join(inside.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")), ["a", "b"], "left").select("a", "b", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def match_exact(graph: Graph, pattern: Graph, directed: bool = False, label: str = "label") -> DataFrame:
    """One column per pattern vertex, n0, n1, ... by position: every embedding that keeps vertex labels and, where the pattern has them, edge labels.

    Pattern vertices are joined one after the other along edges; extra edges of the graph don't matter.
    """
    p = Pattern.read(pattern, directed, label)
    order, known = [p.nodes[0][0]], {p.nodes[0][0]}
    while len(order) < len(p.nodes):
        nxt = next((n for n, _ in p.nodes if n not in known and any((s == n and d in known) or (d == n and s in known) for s, d, _ in p.edges)), None)
        if nxt is None:
            raise ValueError("the pattern is not connected")
        order.append(nxt)
        known.add(nxt)
    column = {n: f"n{i}" for i, (n, _) in enumerate(p.nodes)}
    tag = dict(p.nodes)
    labels = graph.vertices.select("id", F.col(label).alias("l"))
    arcs = stage(graph.arcs(directed).select("src", "dst", "label").distinct(), "match-arcs")

    def lines(s, d, x) -> DataFrame:
        return (arcs if x is None else arcs.where(F.col("label") == x)).select(F.col("src").alias(column[s]), F.col("dst").alias(column[d])).distinct()

    found = labels.where(F.col("l") == tag[order[0]]).select(F.col("id").alias(column[order[0]]))
    for i, n in enumerate(order[1:], 1):
        first = True
        for s, d, x in p.edges:
            if n not in (s, d) or (s if d == n else d) not in order[:i] or s == d:
                continue
            other = column[s if d == n else d]
            if first:
                found = found.join(lines(s, d, x), other)
                found = found.join(labels.where(F.col("l") == tag[n]).select(F.col("id").alias(column[n])), column[n], "left_semi")
                for before in order[:i]:
                    found = found.where(F.col(column[n]) != F.col(column[before]))
                first = False
            else:
                found = found.join(lines(s, d, x), [other, column[n]], "left_semi")
    for s, d, x in p.edges:
        if s == d:
            found = found.join((arcs if x is None else arcs.where(F.col("label") == x)).where("src = dst").select(F.col("src").alias(column[s])).distinct(), column[s], "left_semi")
    return found.select(*[column[n] for n, _ in p.nodes])


def match(graph: Graph, pattern: Graph, directed: bool = False, k: int | None = None, length: int | None = None, label: str = "label") -> DataFrame:
    """(candidate, nodes, edges): neighbourhoods that meet the pattern's necessary conditions, one per distinct set of edges.

    The pattern's label most frequent in the graph is where candidates begin. A candidate stays if within ``k`` hops each label is as frequent and, place by
    place, as near as around the pattern's vertex. Its neighbours within ``length`` hops stay if the pattern has their label, not farther
    than there, and their degree is enough; edges stay if the pattern has their labels. What a candidate no longer
    reaches, or what has too few edges left, goes, until nothing changes; then labels and edge labels must still suffice.
    All candidates go through each step together, keyed by candidate.
    """
    p = Pattern.read(pattern, directed, label)
    hops = {n: p.hops(n) for n, _ in p.nodes}
    tag = dict(p.nodes)
    length = length or max(2, *(d for x in hops.values() for d in x.values()))
    k = k or length
    labels = graph.vertices.select("id", F.col(label).alias("l"))
    often = {r["l"]: r["count"] for r in labels.where(F.col("l").isin(sorted(set(tag.values())))).groupBy("l").count().collect()}
    begin = max(p.nodes, key=lambda n: (often.get(n[1], 0), -p.nodes.index(n)))
    away: dict = {}
    for n, d in hops[begin[0]].items():
        if d and d <= k:
            away.setdefault(tag[n], []).append(d)
    candidates = labels.where(F.col("l") == begin[1]).select("id")
    near = stage(hops_from(graph, candidates, max(k, length), directed).join(labels.withColumnRenamed("id", "dst"), "dst"), "match-near")
    for x, far in away.items():
        far = sorted(far)
        units = near.where((F.col("l") == x) & (F.col("dist") > 0) & (F.col("dist") <= k)).groupBy("src").agg(F.sort_array(F.collect_list("dist")).alias("ds"))
        fits = F.size("ds") >= len(far)
        for i, d in enumerate(far):
            fits = fits & (F.get("ds", F.lit(i)) <= d)
        candidates = candidates.join(units.where(fits).select(F.col("src").alias("id")), "id", "left_semi")
    degree: dict = {}
    for n, x in p.nodes:
        own = (sum(n == s for s, _, _ in p.edges), sum(n == d for _, d, _ in p.edges))
        degree[x] = min(degree.get(x, own), own) if directed else min(degree.get(x, (99, 99)), own, key=sum)
    farthest: dict = {}
    for n, x in p.nodes:
        farthest[x] = max([farthest.get(x, 0), *(hops[m].get(n, 0) for m, y in p.nodes if y == begin[1])])
    limit = F.create_map(*[F.lit(y) for x, d in farthest.items() for y in (x, d)])
    members = near.join(candidates.withColumnRenamed("id", "src"), "src", "left_semi").where((F.col("dist") <= length) & F.col("l").isin(sorted(farthest)))
    members = members.where((F.col("src") == F.col("dst")) | (F.col("dist") <= F.try_element_at(limit, F.col("l")))).select(F.col("src").alias("c"), F.col("dst").alias("n"), "l")
    triples = {(tag[s], tag[d], x) for s, d, x in p.edges} | (set() if directed else {(tag[d], tag[s], x) for s, d, x in p.edges})
    fits = F.lit(False)
    for a, b, x in sorted(triples, key=str):
        fits = fits | ((F.col("l1") == a) & (F.col("l2") == b) & (F.lit(True) if x is None else F.col("label") == x))
    e = graph.edges.select("src", "dst", "pos", "label").join(labels.withColumnsRenamed({"id": "src", "l": "l1"}), "src").join(labels.withColumnsRenamed({"id": "dst", "l": "l2"}), "dst").where(fits)
    inside = members.select("c", F.col("n").alias("src")).join(e, "src").join(members.select("c", F.col("n").alias("dst")), ["c", "dst"], "left_semi").select("c", "src", "dst", "pos", "label")
    inside, size = stage(inside, "match-edges"), -1
    need_all = F.create_map(*[F.lit(y) for x, d in degree.items() for y in (x, sum(d))])
    need_out = F.create_map(*[F.lit(y) for x, d in degree.items() for y in (x, d[0])])
    need_in = F.create_map(*[F.lit(y) for x, d in degree.items() for y in (x, d[1])])
    while True:
        ends = inside.select("c", F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("n"), F.lit(0).alias("o")))).alias("x")).select("c", "x.*")
        sums = ends.groupBy("c", "n").agg(F.count(F.lit(1)).alias("all"), F.sum("o").alias("out")).join(labels.withColumnRenamed("id", "n"), "n")
        enough = F.col("all") >= F.try_element_at(need_all, F.col("l"))
        if directed:
            enough = enough & (F.col("out") >= F.try_element_at(need_out, F.col("l"))) & (F.col("all") - F.col("out") >= F.try_element_at(need_in, F.col("l")))
        deep = sums.where(enough).select("c", "n")
        inside = inside.join(deep.withColumnRenamed("n", "src"), ["c", "src"], "left_semi").join(deep.withColumnRenamed("n", "dst"), ["c", "dst"], "left_semi").select("c", "src", "dst", "pos", "label")
        inside = stage(inside, "match-edges")
        arcs = inside.select("c", "src", "dst")
        arcs = stage(arcs.unionByName(inside.select("c", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "match-arcs")
        first = arcs.select("c", F.col("c").alias("n")).distinct().join(arcs.select("c", F.col("src").alias("n")), ["c", "n"], "left_semi")
        reach = grow(lambda f, seen, i, arcs=arcs: f.withColumnRenamed("n", "src").join(arcs, ["c", "src"]).select("c", F.col("dst").alias("n")).distinct().join(seen, ["c", "n"], "left_anti"), first, length, "match-reach")
        inside = stage(inside.join(reach.withColumnRenamed("n", "src"), ["c", "src"], "left_semi").join(reach.withColumnRenamed("n", "dst"), ["c", "dst"], "left_semi").select("c", "src", "dst", "pos", "label"), "match-edges")
        now = inside.count()
        if now == size or not now:
            break
        size = now
    nodes = inside.select("c", F.explode(F.array("src", "dst")).alias("n")).distinct().join(labels.withColumnRenamed("id", "n"), "n")
    fine = inside.select("c").distinct()
    for x, n in Counter(tag.values()).items():
        fine = fine.join(nodes.where(F.col("l") == x).groupBy("c").count().where(F.col("count") >= n).select("c"), "c", "left_semi")
    for x, n in Counter(y for _, _, y in p.edges).items():
        fine = fine.join(inside.where(F.lit(True) if x is None else F.col("label") == x).groupBy("c").count().where(F.col("count") >= n).select("c"), "c", "left_semi")
    lists = inside.join(fine, "c", "left_semi").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "pos", "label"))).alias("edges"))
    lists = lists.groupBy("edges").agg(F.min("c").alias("candidate"))
    rest = F.array_sort(F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["src"], e["dst"])))))
    return lists.select("candidate", F.concat(F.array("candidate"), F.array_remove(rest, F.col("candidate"))).alias("nodes"), F.transform("edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["label"].alias("label"))).alias("edges"))
