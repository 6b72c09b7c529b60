"""Running degrees of a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(edges: DataFrame, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(id, degree, in_degree, out_degree) of a streaming (src, dst): of all so far, or with ``time`` and ``window`` of each window, with edges
    up to ``late`` behind."""
    if time is not None:
        edges = edges.withWatermark(time, late)
    ends = edges.select(*([F.col(time)] if time else []), F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("x"))
    keys = [F.col("x.id").alias("id"), *([F.window(time, window)] if time and window else [])]
    return ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("degree"), F.sum(1 - F.col("x.o")).alias("in_degree"), F.sum("x.o").alias("out_degree"))
