"""Neighbours, degrees and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph


def neighbors(graph: Graph, node, kind: str | None = None) -> DataFrame:
    """(neighbor, pos) for each edge at ``node``, duplicates kept; kind "target" follows edges, "source" goes against them."""
    e = graph.edges
    if kind == "target":
        return e.where(F.col("src") == node).select(F.col("dst").alias("neighbor"), "pos")
    if kind == "source":
        return e.where(F.col("dst") == node).select(F.col("src").alias("neighbor"), "pos")
    if kind is not None:
        raise ValueError("kind is None, 'target' or 'source'")
    return incident_edges(graph, node).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("neighbor"), "pos")


def out_edges(graph: Graph, node) -> DataFrame:
    return graph.edges.where(F.col("src") == node)


def incident_edges(graph: Graph, node) -> DataFrame:
    return graph.edges.where((F.col("src") == node) | (F.col("dst") == node))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree, in_degree, out_degree) of every vertex; a self-loop counts twice in degree. Ends that are no vertex don't count."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    sums = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("long")
    found = graph.vertices.select("id").join(sums, "id", "left")
    return found.select("id", F.coalesce("degree", zero).alias("degree"), F.coalesce(F.col("degree") - F.col("out_degree"), zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def in_degree(graph: Graph, node) -> DataFrame:
    """(id, value); 0 for an unknown vertex."""
    return graph.edges.where(F.col("dst") == node).agg(F.lit(node).alias("id"), F.count(F.lit(1)).alias("value"))


def out_degree(graph: Graph, node) -> DataFrame:
    return graph.edges.where(F.col("src") == node).agg(F.lit(node).alias("id"), F.count(F.lit(1)).alias("value"))


def adjacency(graph: Graph, directed: bool = False) -> DataFrame:
    """(src_idx, dst_idx, value): the cells of the 0/1 matrix over positions that are set. Edges with an end that is no vertex are skipped."""
    place = graph.vertices.select("id", "pos")
    cells = graph.edges.select("src", "dst").distinct()
    cells = cells.join(place.withColumnsRenamed({"id": "src", "pos": "src_idx"}), "src").join(place.withColumnsRenamed({"id": "dst", "pos": "dst_idx"}), "dst").select("src_idx", "dst_idx")
    if not directed:
        cells = cells.unionByName(cells.select(F.col("dst_idx").alias("src_idx"), F.col("src_idx").alias("dst_idx"))).distinct()
    return cells.withColumn("value", F.lit(1))


def adjacency_rows(graph: Graph, directed: bool = False) -> DataFrame:
    """(src_idx, cells: array of (dst_idx, value) in order), one row per matrix row with a cell."""
    return adjacency(graph, directed).groupBy("src_idx").agg(F.sort_array(F.collect_list(F.struct("dst_idx", "value"))).alias("cells"))
