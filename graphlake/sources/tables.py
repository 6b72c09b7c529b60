"""Graphs from and to files. Formats are Spark's: parquet, json, csv, orc."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.plans.numbering import dense_index


def read_graph(spark: SparkSession, vertices: str, edges: str, format: str = "parquet", options: dict | None = None, **columns) -> Graph:
    """A graph from two tables; ``columns`` are the names that ``Graph.from_tables`` takes."""
    load = lambda path: spark.read.format(format).options(**(options or {})).load(path)
    return Graph.from_tables(load(vertices), load(edges), **columns)


def write_graph(graph: Graph, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """``path``/vertices and ``path``/edges; edges clustered by their tail, so that scans by it skip files."""
    graph.vertices.write.format(format).mode(mode).save(f"{path}/vertices")
    graph.edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.format(format).mode(mode).save(f"{path}/edges")


def compressed(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Edges compressed by their tail: (index, id, offset, degree) of the vertices in order of position, and (place, src_index, dst_index,
    weight) of the edges. A vertex's edges have the places from its offset on, as many as its degree; edges without both ends are left out."""
    numbered = dense_index(graph.vertices.select("id", "pos"), ["pos"], "index").select("id", "index")
    ends = graph.edges.join(numbered.withColumnsRenamed({"id": "src", "index": "src_index"}), "src").join(numbered.withColumnsRenamed({"id": "dst", "index": "dst_index"}), "dst")
    edges = dense_index(ends.select("src_index", "dst_index", "pos", "weight"), ["src_index", "pos"], "place").select("place", "src_index", "dst_index", "weight")
    counted = numbered.join(edges.groupBy(F.col("src_index").alias("index")).agg(F.count(F.lit(1)).alias("degree")), "index", "left")
    counted = counted.select("index", "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.shiftright("index", 16).alias("block"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("block").agg(F.sum("degree").alias("n"))  # a row for each 65,536 vertices
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before(Window.orderBy("block"))), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("degree").over(before(Window.partitionBy("block").orderBy("index"))), F.lit(0))
    vertices = counted.withColumn("inside", inside).join(F.broadcast(blocks), "block")
    return vertices.select("index", "id", (F.col("first") + F.col("inside")).alias("offset"), "degree"), edges
