"""Breadth-first and depth-first traversal."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.plans.iterate import grow
from graphlake.plans.numbering import dense_index


def bfs(graph: Graph, starts: list, directed: bool = True, allow: Callable[[Column, Column], Column] | None = None, max_depth: int | None = None) -> DataFrame:
    """(id, depth, parent): every vertex reached, by whole levels; ``parent`` is the one of least position at the level before.

    ``allow(current, next)`` is a predicate on an edge's ends; edges it refuses are not followed.
    """
    arcs = graph.arcs(directed).select("src", "dst").distinct()
    if allow is not None:
        arcs = arcs.where(allow(F.col("src"), F.col("dst")))
    place = graph.vertices.select("id", "pos")
    first = graph.vertices.where(F.col("id").isin(starts)).select("id", "pos", F.lit(0).alias("depth"), F.lit(None).cast(graph.vertices.schema["id"].dataType).alias("parent"))

    def level(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        met = frontier.select(F.col("id").alias("src"), "pos").join(arcs, "src").groupBy("dst").agg(F.min_by("src", "pos").alias("parent"))
        met = met.withColumnRenamed("dst", "id").join(seen.select("id"), "id", "left_anti")
        return met.join(place, "id").select("id", "pos", F.lit(i).alias("depth"), "parent")

    return grow(level, first, max_depth).select("id", "depth", "parent")


def bfs_visits(graph: Graph, start, directed: bool = True, allow: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(visit, id, previous, parent, depth): the order in which a queue visits, edges taken by position. ``previous`` is the vertex
    visited just before (null for the start)."""
    arcs = graph.arcs(directed)
    if allow is not None:
        arcs = arcs.where(allow(F.col("src"), F.col("dst")))
    arcs = arcs.select("src", "dst", "pos")
    first = graph.vertices.where(F.col("id") == start).select("id", F.lit(0).cast("long").alias("at"), F.lit(0).alias("depth"), F.lit(None).cast(graph.vertices.schema["id"].dataType).alias("parent"))

    def level(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        met = frontier.select(F.col("id").alias("src"), "at").join(arcs, "src").groupBy("dst").agg(F.min(F.struct("at", "pos", "src")).alias("by"))
        met = met.withColumnRenamed("dst", "id").join(seen.select("id"), "id", "left_anti")
        met = met.select("id", F.lit(i).alias("depth"), F.col("by.src").alias("parent"), F.col("by.at").alias("a"), F.col("by.pos").alias("p"))
        return dense_index(met, ["a", "p"], "at").select("id", "at", "depth", "parent")

    visits = dense_index(grow(level, first), ["depth", "at"], "visit")
    before = visits.select((F.col("visit") + 1).alias("visit"), F.col("id").alias("previous"))
    return visits.join(before, "visit", "left").select("visit", "id", "previous", "parent", "depth")


def dfs(graph: Graph, start, directed: bool = True, allow: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(step, event, current, previous): enter and leave events in depth-first order, edges taken by position.

    The order is sequential by nature: the part of the graph that ``start`` reaches, found level by level first, is walked in one task,
    which holds its edges. ``previous`` is null at the start.
    """
    arcs = graph.arcs(directed)
    if allow is not None:
        arcs = arcs.where(allow(F.col("src"), F.col("dst")))
    reached = bfs(graph, [start], directed, allow).select(F.col("id").alias("src"))
    kind = graph.vertices.schema["id"].dataType.simpleString()
    part = arcs.join(reached, "src", "left_semi").select("src", "dst", "pos")
    seed = graph.vertices.where(F.col("id") == start).select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(-1).cast("long").alias("pos"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        out: dict = {}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            if d is not None and d == d:
                out.setdefault(s, []).append(d)
        seen, log = {start}, [("enter", start, None)]
        stack = [(start, None, iter(out.get(start, ())))]
        while stack:
            node, before, rest = stack[-1]
            for nxt in rest:
                if nxt not in seen:
                    seen.add(nxt)
                    log.append(("enter", nxt, node))
                    stack.append((nxt, node, iter(out.get(nxt, ()))))
                    break
            else:
                log.append(("leave", node, before))
                stack.pop()
        frame = pd.DataFrame({"step": range(len(log)), "event": [x[0] for x in log]})
        for i, c in ((1, "current"), (2, "previous")):
            frame[c] = pd.Series([x[i] for x in log], dtype="object" if kind == "string" else "Int64")
        return frame

    return part.unionByName(seed).withColumn("all", F.lit(True)).groupBy("all").applyInPandas(walk, f"step long, event string, current {kind}, previous {kind}")
