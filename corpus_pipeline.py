"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; ``run`` writes each as a Parquet
table in the folder the cluster shares and gives it to the next. All stages but the last return the columns of
``documents``; the last adds ``epoch`` (copies of a document are numbered from 0) and ``taken`` (words of the copy).

Nulls: a null text is not toxic, equals other null and empty texts, has no near-duplicate and no benchmark words, and
is not part of the mixture, since it has no words to take. Repeated rows are copies of each other, and one stays. Other columns pass through,
whatever their names; where ``epoch`` and ``taken`` are among them, the new columns have an underscore after theirs. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import decontaminate, exact_dedup, minhash, mixing, toxicity
from graphlake.plans.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic by a model of the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("label"))
    labelled = docs.select(F.col("doc_id").alias("id"), "text").join(labels, F.col("id") == F.col("of")).select("id", "text", "label")
    return toxicity.drop_toxic(docs, toxicity.fit(labelled))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keeps the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, keeps the document with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item's words."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source weights, a row for each copy taken."""
    return mixing.take(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity stage learns a model, which SQL does not express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
