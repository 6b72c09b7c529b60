"""The corpus queries over the driver's tables: each reads its rows through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import decontaminate, exact_dedup, katz, language, license_scan, minhash, mixing, pii, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex_of_list(items) -> F.Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(_table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = decontaminate.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return scored.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _hex_of_list(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["at"])
    base = F.sort_array(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.sort_array(F.array_union(base, F.transform("found", lambda s: s["label"])))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), "score",
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"), _remainder(7) == 2, order=3).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def _toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("toxic is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("label"))
    docs = _table(spark, sf_dir, "documents").where(_remainder(5) != 0).select(F.col("doc_id").alias("id"), "text")
    return docs.join(labels, F.col("id") == F.col("of")).select("id", "text", "label")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(_toxic_labels(spark, sf_dir))
    scored = toxicity.score(_table(spark, sf_dir, "documents"), model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages cut out, and how many sentences that were."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, counts=True).select("doc_id", "n_removed", "text")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(_remainder(4) != 2).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = language.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_katz, op3_decontamination, op4_pii, op5_mixing, op6_toxicity, op7_license_scan, op8_minhash, op9_substring_dedup, op10_language)}
