"""Dense row numbers in a given order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.plans.staging import stage


def dense_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the given order.

    Rows are range-partitioned and sorted; each takes its place in its partition plus the number of rows in the
    partitions before, of which there is one row each.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = stage(ordered.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__m", 33).alias("__p"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = table.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    numbered = table.withColumn("__q", F.shiftright("__m", 33)).join(F.broadcast(starts), F.col("__q") == F.col("__p"))
    return numbered.withColumn(name, (F.col("__s") + place).cast("long")).drop("__m", "__q", "__p", "__s")
