"""Graphs of the TPC-H-like tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.graph import Graph


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _graph(vertices: DataFrame, edges: DataFrame, place: bool = True) -> Graph:
    """Long identifiers are their own positions; an edge's position is made of its ends, in their order below 2**31, else by hash."""
    v = vertices.withColumn("pos", F.col("id")) if place else vertices
    small = F.col("src").between(0, (1 << 31) - 1) & F.col("dst").between(0, (1 << 31) - 1)
    pos = F.when(small, F.col("src") * F.lit(1 << 31) + F.col("dst")).otherwise(F.xxhash64("src", "dst"))
    e = edges.select("src", "dst", pos.alias("pos"), F.col("weight").cast("double").alias("weight"), F.lit(None).cast("string").alias("label"))
    return Graph(v, e)


def trade(t: Tables) -> Graph:
    """Nations: customers' to suppliers', weighted by line items. Vertices carry their region as label."""
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))  # before the nations come in: half as many rows
    lines = lines.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = lines.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("n").alias("weight"))
    nations = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("string").alias("label"), F.col("n_regionkey").cast("long").alias("cluster"))
    return _graph(nations, edges)


def supply(t: Tables) -> Graph:
    """Suppliers (2 * key) and parts (2 * key + 1) that a line item joins."""
    edges = t.lineitem.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct().withColumn("weight", F.lit(None))
    return _graph(t.supplier.select((F.col("s_suppkey") * 2).alias("id")).unionByName(t.part.select((F.col("p_partkey") * 2 + 1).alias("id"))), edges)


def _steps(t: Tables) -> DataFrame:
    """(l_orderkey, src, dst, flag): each supplier of an order and the next one."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_returnflag")
    steps = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("flag"), F.lead("l_suppkey").over(order).alias("dst"))
    return steps.where("dst is not null")


def chain(t: Tables) -> Graph:
    """Suppliers: from each one in an order to the next, weighted by how often. The label is the nation."""
    edges = _steps(t).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return _graph(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("label"), F.col("s_nationkey").cast("long").alias("cluster")), edges)


def geo(t: Tables) -> Graph:
    """The tree of regions (1..), nations (1000..), suppliers and customers (from a million)."""
    region = t.region.select((F.col("r_regionkey") + 1).cast("long").alias("id"))
    nation = t.nation.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("up"))
    customer = t.customer.select((F.col("c_custkey") * 2 + 1_000_000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("up"))
    supplier = t.supplier.select((F.col("s_suppkey") * 2 + 1_000_001).alias("id"), (F.col("s_nationkey") + 1000).cast("long").alias("up"))
    below = nation.unionByName(customer).unionByName(supplier)
    return _graph(region.unionByName(below.select("id")), below.select(F.col("up").alias("src"), F.col("id").alias("dst"), F.lit(None).alias("weight")))


def flows(t: Tables) -> Graph:
    """Event types: from each event of a user to the next, weighted by how often. Strings, placed by name."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = t.events.select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst is not null")
    edges = steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    types = t.events.select(F.col("event_type").alias("id")).distinct()
    return Graph.from_tables(types, edges, weight="weight")


def baskets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A graph for each order: its suppliers, labelled by region, and its steps, labelled by return flag."""
    region = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").cast("string").alias("label"))
    vertices = t.lineitem.select(F.col("l_orderkey").alias("graph_id"), F.col("l_suppkey").alias("id")).distinct().join(region, "id").select("graph_id", "id", "label")
    edges = _steps(t).where("src <> dst").select(F.col("l_orderkey").alias("graph_id"), "src", "dst", F.col("flag").alias("label"))
    return vertices, edges


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label").cast("long").alias("cluster"))


def parts(t: Tables) -> DataFrame:
    """Properties of parts: brand, type and size."""
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
