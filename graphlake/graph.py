"""A property graph as two DataFrames.

Vertices are (id, pos, ...properties) and edges (src, dst, pos, weight, label): ``pos`` is the place in the input, by which
results that depend on order break ties. Identifiers are all strings or all longs. Parallel edges and self-loops are
legal; a missing weight is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.plans.numbering import dense_index


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_tables(vertices: DataFrame, edges: DataFrame, id: str = "id", src: str = "src", dst: str = "dst", weight: str | None = None, label: str | None = None, pos: str | None = None, edge_pos: str | None = None) -> Graph:
        """A graph from two tables with columns of any name. Without a position column, vertices are placed by
        identifier and edges by their ends."""
        v = vertices.withColumnRenamed(id, "id")
        v = v.withColumnRenamed(pos, "pos") if pos else dense_index(v, ["id"], "pos")
        e = edges.select(
            F.col(src).alias("src"),
            F.col(dst).alias("dst"),
            (F.col(edge_pos) if edge_pos else F.lit(None)).cast("long").alias("pos"),
            (F.col(weight) if weight else F.lit(None)).cast("double").alias("weight"),
            (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
        )
        if not edge_pos:
            e = dense_index(e.drop("pos"), ["src", "dst", "weight", "label"], "pos").select("src", "dst", "pos", "weight", "label")
        return Graph(v, e)

    @staticmethod
    def from_json(spark: SparkSession, nodes: list[dict], edges: list[dict], label: str = "label") -> Graph:
        """A graph of literal records; each place in the lists is the position. For small graphs, which the driver holds."""
        keys = sorted({k for n in nodes for k in n} - {"id", "properties"})
        inner = sorted({k for n in nodes for k in n.get("properties", {})})
        kind = lambda values: "double" if all(isinstance(x, (int, float)) for x in values if x is not None) and any(x is not None for x in values) else "string"
        text = lambda x, k: None if x is None else float(x) if k == "double" else str(x)
        kinds = {k: "string" for k in keys}
        own = {k: kind([n.get("properties", {}).get(k) for n in nodes]) for k in inner}
        fields = "id string, pos long" + "".join(f", `{k}` {t}" for k, t in kinds.items())
        if inner:
            fields += ", properties struct<" + ", ".join(f"`{k}`:{t}" for k, t in own.items()) + ">"
        rows = []
        for i, n in enumerate(nodes):
            row = [str(n["id"]), i, *[text(n.get(k), "string") for k in keys]]
            if inner:
                row.append(tuple(text(n.get("properties", {}).get(k), own[k]) for k in inner) if "properties" in n else None)
            rows.append(tuple(row))
        lines = [(str(e["source"]), str(e["target"]), i, float(e["weight"]) if e.get("weight") is not None else None, e.get(label)) for i, e in enumerate(edges)]
        return Graph(spark.createDataFrame(rows, fields), spark.createDataFrame(lines, "src string, dst string, pos long, weight double, label string"))

    def validate(self, dangling: str = "error") -> Graph:
        """This graph, if every edge has both ends; otherwise an error, or with "drop" the graph without such edges."""
        ids = self.vertices.select("id")
        whole = self.edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
        if dangling == "drop":
            return Graph(self.vertices, whole)
        if self.edges.count() != whole.count():
            raise ValueError("edges with an end that is no vertex")
        return self

    def arcs(self, directed: bool = True) -> DataFrame:
        """(src, dst, pos, weight, label); of an undirected graph every edge in both directions, a self-loop once."""
        if directed:
            return self.edges
        swap = {"src": "dst", "dst": "src"}
        back = self.edges.where("src <> dst").select(*[F.col(swap.get(c, c)).alias(c) for c in self.edges.columns])
        return self.edges.unionByName(back)

    def without_loops(self) -> Graph:
        return Graph(self.vertices, self.edges.where("src <> dst"))


def cost(column: str | None, zero_weight: str = "one"):
    """An edge's length: 1 without a weight column, and for a missing or zero weight unless ``zero_weight`` is "keep"."""
    if column is None:
        return F.lit(1.0)
    w = F.col(column).cast("double")
    return F.coalesce(w, F.lit(1.0)) if zero_weight == "keep" else F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(1.0))
