"""Vectors, similarity, encoding of properties, and k-means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.graph import Graph
from graphlake.plans.staging import stage

#: What counts as a date in a string, with one kind of separator, and a time after one space.
DATE = r"^\d{1,4}(-|/)\d{1,2}\1\d{1,2}( \d{1,2}:\d{1,2}:\d{1,2})?$"


def _both(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def add(a: Column, b: Column) -> Column:
    """Element-wise; an empty operand changes nothing, unequal lengths give null. So for ``subtract``."""
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).when(F.size(a) == F.size(b), _both(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).when(F.size(a) == F.size(b), _both(a, b, lambda x, y: x - y))


def average(a: Column, n) -> Column:
    """The vector over n; empty for n = 0."""
    n = F.lit(n) if not isinstance(n, Column) else n
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(a, lambda x: x / F.nullif(n.cast("double"), F.lit(0.0))))


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def dot(a: Column, b: Column) -> Column:
    """0 if either is empty, null for unequal lengths."""
    total = F.aggregate(_both(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).when(F.size(a) == F.size(b), total)


def square_distance(a: Column, b: Column) -> Column:
    """0 if either is empty, null for unequal lengths."""
    total = F.aggregate(_both(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).when(F.size(a) == F.size(b), total)


def distance(a: Column, b: Column, kind: str = "euclidean") -> Column:
    return F.sqrt(square_distance(a, b)) if kind == "euclidean" else F.lit(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Scaled to 0..1 by its own least and greatest element; nulls for a constant vector."""
    span = F.nullif(F.array_max(a) - F.array_min(a), F.lit(0.0))
    return F.transform(a, lambda x: (x - F.array_min(a)) / span)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0, null for unequal lengths."""
    d = dot(a, b)
    return F.when(F.size(a) != F.size(b), F.lit(None)).otherwise(F.coalesce(d / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0)))


def property_table(vertices: DataFrame, key: str | None = None) -> DataFrame:
    """(id, pos, ...properties): the fields of the struct column ``key``, or all columns; vertices without it are left out."""
    if key is None:
        return vertices
    return vertices.where(F.col(key).isNotNull()).select("id", "pos", f"{key}.*")


def _keys(table: DataFrame, involved: list[str] | None, uninvolved: list[str] | None) -> list[str]:
    have = [c for c in table.columns if c not in ("id", "pos")]
    return [c for c in (involved or have) if c in have and c not in (uninvolved or ())]


def _present(key: str) -> Column:
    c = F.col(f"`{key}`").cast("string")
    return F.nullif(c, F.lit(""))


def key_values(table: DataFrame, involved: list[str] | None = None, uninvolved: list[str] | None = None) -> DataFrame:
    """(key, values): each key's distinct values as strings, by first appearance; null and empty are missing.

    The values of a key are its vocabulary and come together in one row; a key of unbounded values is not for this.
    """
    keys = _keys(table, involved, uninvolved)
    if not keys:
        return table.sparkSession.createDataFrame([], "key string, values array<string>")
    long = table.select("pos", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), _present(k).alias("value")) for k in keys])).alias("x")).select("pos", "x.*").where("value is not null")
    first = long.groupBy("key", "value").agg(F.min("pos").alias("pos"))
    return first.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


@dataclass(frozen=True)
class Encoder:
    """Vectors of properties: the numbers themselves if every key is numeric, one-hot over each key's vocabulary otherwise."""

    keys: tuple[str, ...]
    numeric: bool
    vocabulary: dict

    @staticmethod
    def fit(table: DataFrame, involved: list[str] | None = None, uninvolved: list[str] | None = None, max_values: int = 100_000) -> Encoder:
        """``max_values`` bounds what the driver holds, and is checked."""
        keys = _keys(table, involved, uninvolved)
        if all(isinstance(table.schema[k].dataType, T.NumericType) for k in keys):
            return Encoder(tuple(keys), True, {})
        got = key_values(table, list(keys)).withColumn("n", F.size("values"))
        if (got.agg(F.sum("n")).first()[0] or 0) > max_values:
            raise ValueError(f"more than {max_values} distinct values to encode")
        return Encoder(tuple(keys), False, {r["key"]: list(r["values"]) for r in got.collect()})

    def column(self) -> Column:
        if not self.keys:
            return F.array().cast("array<double>")
        if self.numeric:
            return F.array(*[F.coalesce(F.col(f"`{k}`").cast("double"), F.lit(0.0)) for k in self.keys])
        parts = []
        for k in self.keys:
            words = F.array(*[F.lit(x) for x in self.vocabulary.get(k, [])]).cast("array<string>")
            parts.append(_hot(words, _present(k)))
        return F.concat(*parts)


def _hot(words: Column, value: Column) -> Column:
    return F.transform(words, lambda v: F.coalesce((v == value).cast("double"), F.lit(0.0)))


def one_hot(table: DataFrame, involved: list[str] | None = None, uninvolved: list[str] | None = None) -> DataFrame:
    """(id, pos, vector)."""
    return table.select("id", "pos", Encoder.fit(table, involved, uninvolved).column().alias("vector"))


def property_keys(table: DataFrame, n: int = 100) -> DataFrame:
    """(key, count) of the n keys most often numeric or a date, most frequent first."""
    keys = _keys(table, None, None)
    if not keys:
        return table.sparkSession.createDataFrame([], "key string, count long")
    long = table.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), _present(k).alias("value")) for k in keys])).alias("x")).select("x.*")
    fits = F.expr("try_cast(value as double)").isNotNull() | F.col("value").rlike(DATE)
    return long.where(fits).groupBy("key").count().orderBy(F.desc("count"), "key").limit(n)


def property_weights(table: DataFrame, n: int = 100) -> DataFrame:
    """(id, pos, weights): the values of ``property_keys`` in their order, 0 where missing or no number."""
    keys = [r["key"] for r in property_keys(table, n).collect()]
    return table.select("id", "pos", F.array(*[F.coalesce(F.expr(f"try_cast(`{k}` as double)"), F.lit(0.0)) for k in keys]).cast("array<double>").alias("weights"))


def nodes_cosine(vertices: DataFrame, seed, key: str | None = None, involved: list[str] | None = None, uninvolved: list[str] | None = None, legacy_shift: bool = False) -> DataFrame:
    """(id, pos, cosine) of every vertex but the seed, to be read by cosine, highest first, then position.

    With ``legacy_shift`` vertices after the seed are compared by the vector of the one before them, as the tables of an old release have it.
    """
    table = property_table(vertices, key)
    vectors = stage(one_hot(table, involved, uninvolved), "cosine")
    mine = vectors.where(F.col("id") == seed).select(F.col("vector").alias("seed"), F.col("pos").alias("seed_pos"))
    others = vectors.join(F.broadcast(mine)).where(F.col("id") != seed)
    if legacy_shift:
        shifted = vectors.join(F.broadcast(mine.select("seed_pos"))).select((F.col("pos") + F.when(F.col("pos") >= F.col("seed_pos"), 1).otherwise(0)).alias("pos"), F.col("vector").alias("by"))
        others = others.join(shifted, "pos").drop("vector").withColumnRenamed("by", "vector")
    return others.select("id", "pos", cosine(F.col("vector"), F.col("seed")).alias("cosine"))


def kmeans(table: DataFrame, k: int = 3, seed_pos: int = 0, max_iter: int = 1) -> DataFrame:
    """(id, cluster) from (id, pos, vector).

    The first centroid is the vector at ``seed_pos``; each next one is the vector with the greatest average distance to those chosen
    that equals none of them, least position first. There are at most as many as distinct vectors. ``max_iter`` 1 assigns to these
    centroids; more passes move them to their clusters' means. Each choice is one aggregate over the table; k centroids are all the driver holds.
    """
    table = stage(table.select("id", "pos", F.transform("vector", lambda x: x.cast("double")).alias("vector")), "kmeans")
    first = table.where(F.col("pos") >= seed_pos).orderBy("pos").select("vector").limit(1).first()
    if first is None:
        return table.select("id", F.lit(0).alias("cluster"))
    centroids = [list(first["vector"])]
    lit = lambda c: F.array(*[F.lit(float(x)) for x in c]).cast("array<double>")
    while len(centroids) < k:
        total, fresh = F.lit(0.0), F.lit(True)
        for c in centroids:
            total, fresh = total + distance(F.col("vector"), lit(c)), fresh & (F.col("vector") != lit(c))
        best = table.where(fresh).select("pos", "vector", (total / len(centroids)).alias("far")).agg(F.max_by("vector", F.struct("far", -F.col("pos"))).alias("v")).first()["v"]
        if best is None:
            break
        centroids.append(list(best))
    for i in range(max_iter):
        near = F.array(*[F.struct(distance(F.col("vector"), lit(c)).alias("d"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)])
        assigned = table.select("id", "pos", "vector", F.array_min(near)["cluster"].alias("cluster"))
        if i + 1 == max_iter:
            break
        means = assigned.select("cluster", F.posexplode("vector").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
        moved = {r["cluster"]: list(r["m"]) for r in means.collect()}
        now = [moved.get(j, c) for j, c in enumerate(centroids)]
        if now == centroids:
            break
        centroids = now
    return assigned.select("id", "cluster")


def kmeans_graph(graph: Graph, k: int = 3, key: str | None = None, involved: list[str] | None = None, uninvolved: list[str] | None = None, seed_pos: int = 0, max_iter: int = 1) -> DataFrame:
    """(id, cluster) of the vertices by their properties; all in cluster 0 unless every vertex has ``key``."""
    if key is None or key not in graph.vertices.columns or not graph.vertices.where(F.col(key).isNull()).isEmpty():
        return graph.vertices.select("id", F.lit(0).alias("cluster"))
    return kmeans(one_hot(property_table(graph.vertices, key), involved, uninvolved), k, seed_pos, max_iter)
