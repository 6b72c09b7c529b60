"""PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.plans.staging import discard, stage


def pagerank(graph: Graph, epsilon: float = 1e-6, link_prob: float = 0.85, max_rounds: int = 1000, variant: str = "standard") -> DataFrame:
    """(id, rank), summing to 1. A round joins ranks to the arcs once and sums by head; parallel edges count.

    "standard" gives what no edge carries to all vertices alike, which covers jumps and dead ends. "column_normalised"
    is the power method on columns (1 - link_prob) / n + link_prob * count, each divided by its own sum. The loop ends
    when the ranks' total change is at most ``epsilon``, or after ``max_rounds``.
    """
    if variant not in ("standard", "column_normalised"):
        raise ValueError("variant is 'standard' or 'column_normalised'")
    n = graph.vertices.count()
    if not n:
        return graph.vertices.select("id", F.lit(0.0).alias("rank"))
    ids = graph.vertices.select("id")
    counts = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("c")).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = counts.groupBy("src").agg(F.sum("c").alias("out"))
    own = 1 - link_prob
    total = F.coalesce("out", F.lit(0.0))
    share = F.lit(link_prob) / total if variant == "standard" else F.lit(link_prob) / (own + link_prob * total)
    arcs = stage(counts.join(out, "src").select(F.col("src").alias("id"), "dst", (F.col("c") * share).alias("part")), "rank-arcs")
    state = ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.lit(1.0 / n).alias("rank"), total.alias("out"))
    state = stage(state, "rank")
    for _ in range(max_rounds):
        given = arcs.join(state.select("id", "rank"), "id").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("part") * F.col("rank")).alias("got"))
        moved = state.select("id", "rank", "out").join(given, "id", "left").select("id", "out", F.col("rank").alias("old"), F.coalesce("got", F.lit(0.0)).alias("got"))
        # one row: what every vertex gets besides
        if variant == "standard":
            rest = state.agg(((1 - link_prob * F.sum(F.when(F.col("out") > 0, F.col("rank")).otherwise(0.0))) / n).alias("rest"))
        else:
            rest = state.agg((F.sum(F.col("rank") / (own + link_prob * F.col("out"))) * own / n).alias("rest"))
        last, state = state, stage(moved.join(F.broadcast(rest)).select("id", (F.col("got") + F.col("rest")).alias("rank"), "out", "old"), "rank")
        discard(last)
        if state.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] <= epsilon:
            break
    return state.select("id", "rank")
