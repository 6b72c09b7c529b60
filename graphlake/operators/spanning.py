"""Minimum spanning forests by Boruvka's rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.operators.components import star_contract, weak_components
from graphlake.plans.staging import stage


def minimum_spanning_forest(graph: Graph, weight: str | None = None, method: str = "kruskal") -> DataFrame:
    """The edges (all their columns) of the minimum spanning forest; "prim" keeps the tree of the vertex of least position.

    Edges are ordered by (weight, position, ends), which makes the forest unique; without a weight by position. In each round every
    component takes its least edge to another, and components joined so become one.
    """
    if method not in ("kruskal", "prim"):
        raise ValueError("method is 'kruskal' or 'prim'")
    order = F.struct(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w") if weight else F.lit(0.0).alias("w"), F.col("pos").alias("p"), F.col("src").alias("s"), F.col("dst").alias("t"))
    place = graph.vertices.select("id", "pos")
    edges = graph.edges
    if method == "prim":
        parts = weak_components(graph)
        root = place.orderBy("pos").limit(1).first()
        mine = parts.join(parts.where(F.col("id") == (root["id"] if root else None)).select("component"), "component", "left_semi").select("id")
        edges = edges.join(mine.withColumnRenamed("id", "src"), "src", "left_semi").select(graph.edges.columns)
    ends = edges.where("src <> dst").select(order.alias("o"), "src", "dst").join(place.withColumnsRenamed({"id": "src", "pos": "a"}), "src").join(place.withColumnsRenamed({"id": "dst", "pos": "b"}), "dst")
    left = stage(ends.select("o", "a", "b"), "forest")
    chosen: DataFrame | None = None
    while not left.isEmpty():
        both = left.select(F.explode(F.array("a", "b")).alias("c"), "o", "a", "b")
        least = both.groupBy("c").agg(F.min(F.struct("o", "a", "b")).alias("e")).select("e.*").distinct()
        least = stage(least, "forest-least")
        chosen = least.select("o") if chosen is None else chosen.unionByName(least.select("o"))
        roots = stage(star_contract(least, "a", "b"), "forest-roots")
        for side in ("a", "b"):
            left = left.join(roots.withColumnsRenamed({"node": side, "root": "r"}), side, "left").withColumn(side, F.coalesce("r", side)).drop("r")
        left = stage(left.where("a <> b").select("o", "a", "b"), "forest")
    if chosen is None:
        return graph.edges.limit(0)
    return edges.join(chosen.select(F.col("o.p").alias("pos"), F.col("o.s").alias("src"), F.col("o.t").alias("dst")), ["pos", "src", "dst"], "left_semi").select(graph.edges.columns)
