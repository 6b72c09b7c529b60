"""Frequent labels, edges and connected subgraphs in a set of graphs.

A set of graphs is a vertex table (graph_id, id, label) and an edge table (graph_id, src, dst, label). Support is the number of graphs that
hold a pattern.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.plans.staging import stage


def frequent_labels(vertices: DataFrame, min_support: int = 2) -> DataFrame:
    """(label, support)."""
    return vertices.groupBy("label").agg(F.count_distinct("graph_id").alias("support")).where(F.col("support") >= min_support)


def _labelled(vertices: DataFrame, edges: DataFrame, directed: bool) -> DataFrame:
    v = vertices.select("graph_id", "id", F.coalesce("label", F.lit("")).alias("l"))
    e = edges.select("graph_id", "src", "dst", F.coalesce("label", F.lit("")).alias("el")).distinct()
    e = e.join(v.withColumnsRenamed({"id": "src", "l": "l1"}), ["graph_id", "src"]).join(v.withColumnsRenamed({"id": "dst", "l": "l2"}), ["graph_id", "dst"])
    if not directed:  # written from the lesser end, so that both directions are one edge
        turn = F.col("dst") < F.col("src")
        flip = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
        e = e.select("graph_id", "el", flip("src", "dst").alias("src"), flip("dst", "src").alias("dst"), flip("l1", "l2").alias("l1"), flip("l2", "l1").alias("l2")).distinct()
    return e


def frequent_edges(vertices: DataFrame, edges: DataFrame, min_support: int = 2, directed: bool = False) -> DataFrame:
    """(label1, edge_label, label2, support); undirected, label1 is not above label2."""
    e = _labelled(vertices, edges, directed)
    one, two = (F.col("l1"), F.col("l2")) if directed else (F.least("l1", "l2"), F.greatest("l1", "l2"))
    return e.groupBy(one.alias("label1"), F.col("el").alias("edge_label"), two.alias("label2")).agg(F.count_distinct("graph_id").alias("support")).where(F.col("support") >= min_support)


def _code(labels: tuple, edges: tuple, directed: bool) -> str:
    """The least way to write a pattern: labels by number, then edges (from, to, label)."""
    best = None
    for order in permutations(range(len(labels))):
        place = {n: i for i, n in enumerate(order)}
        way = [(place[a], place[b], x) for a, b, x in edges]
        if not directed:
            way = [(min(a, b), max(a, b), x) for a, b, x in way]
        key = (tuple(labels[n] for n in order), tuple(sorted(way)))
        if best is None or key < best:
            best = key
    return ",".join(best[0]) + ";" + ",".join(f"{a}-{x}-{b}" for a, b, x in best[1])


def _codes(directed: bool):
    @F.pandas_udf("string")
    def code(found: pd.Series) -> pd.Series:
        out, known = [], {}
        for edges in found:
            at, labels, lines = {}, [], []
            for e in edges:
                for n, x in ((e["src"], e["l1"]), (e["dst"], e["l2"])):
                    if n not in at:
                        at[n] = len(at)
                        labels.append(x)
                lines.append((at[e["src"]], at[e["dst"]], e["el"]))
            key = (tuple(labels), tuple(sorted(lines)))
            if key not in known:
                known[key] = _code(*key, directed)
            out.append(known[key])
        return pd.Series(out)

    return code


def frequent_subgraphs(vertices: DataFrame, edges: DataFrame, min_support: int = 2, min_nodes: int = 1, max_nodes: int = 4, max_edges: int | None = None, directed: bool = False, top: int | None = None) -> DataFrame:
    """(pattern, nodes, edges, support) of connected subgraphs with at least one edge; with ``top`` only those of highest support.

    A level adds one edge to each place of a frequent pattern; places are sets of edges, each found once, and patterns
    that are the same up to names have the same code. A pattern's support never exceeds its parts', so levels shrink.
    """
    if max_nodes > 6:
        raise ValueError("at most 6 nodes")
    lines = stage(_labelled(vertices, edges, directed).withColumn("e", F.struct("src", "dst", "el", "l1", "l2")).select("graph_id", "src", "dst", "e"), "mine-edges")
    code = _codes(directed)
    ends = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda e: F.array(e["src"], e["dst"]))))
    level = lines.select("graph_id", F.array("e").alias("place")).where(F.size(ends(F.col("place"))) <= max_nodes)
    results = []
    most = max_edges or max_nodes * (max_nodes - 1) * 4
    for n in range(1, most + 1):
        level = stage(level.withColumn("pattern", code("place")).withColumn("nodes", F.size(ends(F.col("place")))), "mine-level")
        frequent = stage(level.groupBy("pattern", "nodes").agg(F.count_distinct("graph_id").alias("support")).where(F.col("support") >= min_support), "mine-frequent")
        if frequent.isEmpty():
            break
        results.append(frequent.where(F.col("nodes") >= min_nodes).select("pattern", "nodes", F.lit(n).alias("edges"), "support"))
        if n == most:
            break
        kept = level.join(frequent.select("pattern"), "pattern", "left_semi").select("graph_id", "place", F.explode(ends(F.col("place"))).alias("n"))
        touching = lines.select("graph_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("n"), "e")
        more = kept.join(touching, ["graph_id", "n"]).where(~F.array_contains("place", F.col("e")))
        level = more.select("graph_id", F.sort_array(F.concat("place", F.array("e"))).alias("place")).distinct()
        level = level.where(F.size(ends(F.col("place"))) <= max_nodes)
    out = results[0] if results else vertices.sparkSession.createDataFrame([], "pattern string, nodes int, edges int, support long")
    for r in results[1:]:
        out = out.unionByName(r)
    return out if top is None else out.orderBy(F.desc("support"), "pattern").limit(top)


def pattern_graphs(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graphs that ``pattern`` strings write down: (pattern, id, label) and (pattern, src, dst, label)."""
    part = F.split("pattern", ";")
    vertices = patterns.select("pattern", F.posexplode(F.split(part[0], ",")).alias("id", "label"))
    edge = F.regexp_extract_all(part[1], F.lit(r"[0-9]+-[^,]*-[0-9]+"), F.lit(0))
    lines = patterns.select("pattern", F.explode(edge).alias("e"))
    take = lambda n: F.regexp_extract("e", r"^([0-9]+)-(.*)-([0-9]+)$", n)
    return vertices, lines.select("pattern", take(1).cast("int").alias("src"), take(3).cast("int").alias("dst"), take(2).alias("label"))
