"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are ordered by that key, range by range: keys are uniform, so
equal ranges of the key are known without sampling and a source of any share is spread over ``16 ** digits`` of them. A
prefix sum of sizes is made of the sums of whole ranges (one row per source and range) and a local running sum in
each. The source's target in words is met exactly: whole epochs first, then the prefix of the order up to the cut, where the
last document is taken in part.

Targets share the total of all sizes by weight, 1, 2, 3, repeating over the sources in code-point order, null last; a
target stops at ``most`` times its source's size and the excess is reshared by weight until none is above. That is a
common level: target = min(most * size, level * weight), found by ordering sources by most * size / weight.

Sources are aggregated to one row each; there may be at most ``MAX_SOURCES`` of them, which is checked, since targets are
computed over all sources together. Null and empty texts have size 0 and nothing is taken from them. Rows with one
identifier share a key; they are ordered by size and are otherwise alike. Columns other than these three don't matter, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm.text import NOT_SPACE, free_name
from graphlake.plans.staging import stage

DIGITS = 3  # hex digits of the key that tell its range: 4,096 equal ranges
MAX_SOURCES = 1_000_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, digits: int = DIGITS) -> DataFrame:
    """(id, source, size, key, range) of each document; size is its number of words."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"),
        F.substring(key, 1, 16).alias("key"),
        F.conv(F.substring(key, 1, digits), 16, 10).cast("int").alias("range"),
    )


def targets(sources: DataFrame, most: float = 3.0, cycle: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size)."""
    n = sources.count()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES}")
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn("weight", ((F.row_number().over(one) - 1) % cycle + 1).cast("double"))
    cap = F.col("source_size") * most
    up = Window.orderBy(F.col("full"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # sources in the order in which a rising level fills them; the level that spends the total with exactly the ones before filled
    levels = weighted.withColumn("full", cap / F.col("weight")).withColumns(
        {"spent": F.coalesce(F.sum(cap).over(before), F.lit(0.0)), "open": F.sum("weight").over(onward), "total": F.sum("source_size").over(Window.partitionBy())}
    )
    levels = levels.withColumn("level", (F.col("total") - F.col("spent")) / F.col("open"))
    # the first source that the level does not fill sets it for itself and all after it
    levels = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(Window.partitionBy())["level"])
    target = F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, cycle: int = 3, seed: int = 42, digits: int = DIGITS) -> DataFrame:
    """One row per document: id, source, size, source_size, target, epochs (whole copies), rest (words of one more), taken."""
    table = stage(sizes(docs, id_col, text_col, source_col, seed, digits), "mix-sizes")
    by_range = stage(table.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    plan = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), most, cycle)
    ordered = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("source", "range", F.coalesce(F.sum("range_size").over(ordered), F.lit(0)).alias("start"))
    plan = plan.withColumnRenamed("source", "of")
    starts = starts.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    starts = starts.withColumnsRenamed({"source": "of", "range": "of_range"})
    within = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = table.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = prefix.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("inner"))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left"))).cast("long")
    return joined.select("id", "source", "size", "source_size", "target", "epochs", rest.alias("rest"), (F.col("epochs") * F.col("size") + rest).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: a row for each copy taken, with ``epoch`` from 0 and ``taken``, its words; the document at a source's
    cut ends after its last word taken. Documents without words are not part of a mixture. Where ``docs`` has columns of these names, the
    new ones have an underscore after theirs.

    Rows that share identifier, source and size are interchangeable in the plan: of their whole sizes, the cut and nothing, each of them, in
    order of a hash of the text, takes one.
    """
    epoch, taken = free_name("epoch", docs.columns), free_name("taken", docs.columns)
    mixed = mix(docs, id_col, text_col, source_col, **options).where("taken > 0")
    whole = F.col("rest") == F.col("size")
    mixed = mixed.groupBy("id", "source", "size").agg(F.max("epochs").alias("__epochs"), F.sum(whole.cast("long")).alias("__whole"), F.max(F.when(~whole, F.col("rest"))).alias("__cut"))
    mixed = mixed.select(F.xxhash64("id", "source", "size").alias("__mix"), F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "__epochs", "__whole", "__cut")
    own = docs.withColumn("__words", F.coalesce(F.regexp_count(F.col(text_col), F.lit(NOT_SPACE)), F.lit(0)).cast("long"))
    own = own.withColumns({"__mix": F.xxhash64(F.col(id_col), F.col(source_col), F.col("__words")), "__order": F.xxhash64(text_col)})
    joined = own.join(mixed, "__mix")  # rows are numbered within the partitions of this exchange
    joined = joined.where(F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    alike = Window.partitionBy("__mix", "__id", "__source", "__size").orderBy("__order")
    joined = joined.withColumn("__nth", F.row_number().over(alike))
    rest = F.when(F.col("__nth") <= F.col("__whole"), F.col("__size")).when(F.col("__nth") == F.col("__whole") + 1, F.coalesce("__cut", F.lit(0))).otherwise(F.lit(0))
    joined = joined.withColumn("__rest", rest.cast("long"))
    copies = F.col("__epochs") + F.when(F.col("__rest") > 0, 1).otherwise(0)
    rows = joined.where(copies > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    cut = (F.col(epoch) == F.col("__epochs")) & (F.col("__rest") < F.col("__size"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("__rest"), F.lit(1)).cast("int")), "")
    rows = rows.withColumn(taken, F.when(cut, F.col("__rest")).otherwise(F.col("__size"))).withColumn(text_col, F.when(cut, head).otherwise(F.col(text_col)))
    return rows.select(*[F.col(f"`{c}`") for c in [*docs.columns, epoch, taken]])
