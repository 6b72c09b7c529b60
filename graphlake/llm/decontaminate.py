"""Benchmark decontamination: a broadcast hash set of the test items' normalised n-grams.

Every window of n words of a training document is looked up, first in a bitmap of the set's hashes (``text.Sieve``), which only lets
more by where it is full, then, if it passes, in the set itself, where its words are compared. So no row is made for other windows, and a
document is tokenised once. An item of fewer words than n, but not none, is one window. The set is broadcast
only while it has at most ``broadcast_windows`` windows (each some 200 bytes), which is counted first; a larger set is
joined by a shuffle on the window's words.

Null and empty texts have no words, and no items. Rows that share an identifier are told apart by their text; equal rows get
equal results. An item whose identifier is null marks words but is not counted. Other columns pass through
``remove`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.text import Sieve, gram_key, letter_words, places_of, row_key
from graphlake.plans.staging import stage

WINDOW = 10
BROADCAST_WINDOWS = 500_000


def item_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (size, hash, gram, item) of the test items."""
    items = benchmark.select(F.col(id_col).alias("item"), letter_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(n)))
    cut = lambda i: F.array_join(F.slice("words", i + 1, F.col("size")), " ")
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("size")), lambda i: F.struct(i.alias("at"), cut(i).alias("gram")))
    found = items.select("item", "words", "size", F.explode(grams).alias("g"))
    key = F.coalesce(*[F.when(F.col("size") == k, gram_key(F.col("words"), F.col("g.at"), k)) for k in range(1, n + 1)])
    return found.select("item", "size", key.alias("hash"), F.col("g.gram").alias("gram")).distinct()


def _candidates(docs: DataFrame, grams: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, key, n_words, seen: array of (at, size, gram)) of every document, staged, and the number of windows of the items."""
    sizes = {r["size"]: r["count"] for r in grams.groupBy("size").count().collect()}  # at most n rows
    total = sum(sizes.values())
    sieve = Sieve(grams.select("hash"), total)
    words = F.col("words")
    base = docs.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias("key"), letter_words(F.col(text_col)).alias("words"))
    window = lambda k: lambda i: F.struct(i.alias("at"), F.lit(k).alias("size"), F.array_join(F.slice(words, i + 1, F.lit(k)), " ").alias("gram"))
    passing = lambda k: lambda i: sieve.passes(gram_key(words, i, k))
    seen = [F.transform(places_of(words, k, passing(k)), window(k)) for k in sorted(sizes)]
    every = F.concat(*seen) if seen else F.array().cast("array<struct<at:int,size:int,gram:string>>")
    return stage(base.select("id", "key", F.size(words).alias("n_words"), every.alias("seen")), "decontaminate-windows-seen"), total


def _hits(seen: DataFrame, grams: DataFrame, small: bool) -> DataFrame:
    """(id, key, hits: array of (at, size) in words from 0 and in order, items: array of strings) of documents with a hit."""
    probe = seen.where(F.size("seen") > 0).select("id", "key", F.explode("seen").alias("w")).select("id", "key", "w.*")
    items = grams.select("size", "gram", F.col("item").cast("string").alias("item"))
    true = probe.join(F.broadcast(items) if small else items, ["gram", "size"])
    return true.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text: str, broadcast_windows: int) -> tuple[DataFrame, DataFrame]:
    grams = stage(item_windows(benchmark, n, item_col, item_text), "decontaminate-windows")
    seen, total = _candidates(docs, grams, n, id_col, text_col)
    return seen, _hits(seen, grams, total <= broadcast_windows)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, row_key, hits: array of (at, size) in words from 0 and in order, items: array of strings) of documents with a hit."""
    return _scan(docs, benchmark, n, id_col, text_col, item_col, item_text, broadcast_windows)[1]


def _covered(hits):
    """Number of words inside any hit, from hits in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda s, h: F.struct(
        (s["n"] + F.greatest(h["at"] + h["size"] - F.greatest(s["to"], h["at"]), F.lit(0))).alias("n"),
        F.greatest(s["to"], h["at"] + h["size"]).alias("to"),
    )
    return F.aggregate(hits, start, step, lambda s: s["n"])


def score(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (array), hits (array of (at, size)), contaminated."""
    own, hits = _scan(docs, benchmark, n, id_col, text_col, item_col, item_text, broadcast_windows)
    hits = hits.withColumnsRenamed({"id": "of", "key": "of_key"})
    joined = own.join(hits, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    n_hit = F.when(F.col("hits").isNull(), F.lit(0)).otherwise(_covered(F.col("hits")))
    return joined.select(
        "id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "hits",
        F.col("hits").isNotNull().alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or without the spans of words that are hit (and what stands between those)."""
    if what not in ("documents", "spans"):
        raise ValueError("what is 'documents' or 'spans'")
    hits = find_hits(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("__of"), F.col("key").alias("__key"), F.col("hits").alias("__hits"))
    same = F.col(id_col).eqNullSafe(F.col("__of")) & (row_key(F.col(text_col)) == F.col("__key"))
    if what == "documents":
        return docs.join(hits, same, "left_anti")
    joined = docs.join(hits, same, "left")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(0))
    lead = F.regexp_extract(F.col(text_col), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    stays = F.filter(pieces, lambda _, i: ~F.exists(F.col("__hits"), lambda h: (i >= h["at"]) & (i < h["at"] + h["size"])))
    cut = F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(stays, "")))
    return joined.withColumn(text_col, cut).drop("__of", "__key", "__hits")
