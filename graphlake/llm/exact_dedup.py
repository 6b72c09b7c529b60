"""Exact deduplication by a tree-merge of sorted digest runs.

A run is the digests of ``RUN_ROWS`` consecutive rows of an input partition, in order, each with the identifier to keep and a row count. Runs
meet in binomial rounds: a round exchanges the runs of ``2**fan_bits`` neighbouring nodes (first those of one partition, then
partitions), cut into ``SLICES`` ranges of the digest, so that each (node, slice) is one sorted run again: its rows are sorted
by digest and equal neighbours merged in one pass, which retains, for each verified digest, the best identifier. So a group
of a third of all rows is one row per run from the first level on, and no task holds more than slices of a node. When one node is left,
its decisions go back down to the runs, and from each run to its own rows.

A digest is SHA-256; it is verified by the text's length in bytes and an independent 64-bit hash, which are part of
what merges compare.

Nulls and empty texts are one text. Rows that repeat an identifier and a text are all counted, and one of them is
kept. A null identifier counts as worse than any other. Columns other than the identifier and the text pass through
``drop_copies`` untouched, whatever their names; of rows that share identifier and text it is not defined whose other columns stay. An
empty table has no runs and gives no rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm.text import ascii_lower
from graphlake.plans.staging import stage

KEY = ["digest", "check", "length"]
NODE = ["part", "run"]
RUN_ROWS = 256
FAN_BITS = 5
SLICES = 4096


def _digest(norm: Column) -> list[Column]:
    """The digest of a normalised text and what verifies it."""
    return [F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.xxhash64(norm).alias("check"), F.octet_length(norm).alias("length")]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower, run_rows: int = RUN_ROWS) -> DataFrame:
    """Per row: identifier, digest and its checks, its partition, its run there, and its number in the table."""
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    row = F.monotonically_increasing_id()  # the partition, and the row in it in the lower 33 bits
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm"), row.alias("row")).select(
        "id", *_digest(F.col("norm")), F.shiftright("row", 33).alias("part"), F.floor(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) / run_rows).alias("run"), "row"
    )


def _best(keep: str) -> Column:
    """Orders identifiers so that the least value of it is kept; then the first row."""
    wanted = F.col("id") if keep == "smallest" else F.bitwise_not("id")  # turns the order of integers, without overflow
    return F.struct(F.col("id").isNull().alias("none"), wanted.alias("rank"), F.col("row"))


def _merge(runs: DataFrame) -> DataFrame:
    """Sorted runs of (node, slice) from the sorted runs of their children: exchanged by slice, in order of the digest, equal digests merged."""
    slice_of = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int") % SLICES
    ordered = runs.withColumn("slice", slice_of).repartition(*NODE, "slice").sortWithinPartitions(*NODE, "slice", *KEY)
    return ordered.groupBy(*NODE, "slice", *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size")).drop("slice")


def rounds_of(most: int, fan_bits: int) -> int:
    """Rounds that leave one of the nodes 0..most."""
    return ceil(most.bit_length() / fan_bits)


def merge_runs(rows: DataFrame, keep: str = "smallest", fan_bits: int = FAN_BITS) -> tuple[DataFrame, int]:
    """(part, run, digest and checks, best, size) for each digest of each run of ``rows``, a staged table, and the number of rounds."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    leaves = rows.groupBy(*NODE, *KEY).agg(F.min(_best(keep)).alias("best"), F.count(F.lit(1)).alias("size"))
    most = rows.agg(F.max("run").alias("run"), F.max("part").alias("part")).first()
    level, rounds = leaves, 0
    for name in ("run", "part"):
        for _ in range(rounds_of(most[name] or 0, fan_bits)):
            level = _merge(level.withColumn(name, F.shiftright(name, fan_bits)))
            rounds += 1
            if rounds % 4 == 0:  # a very deep tree doesn't pile up its plan
                level = stage(level, "dedup-level")
    return leaves.select(*NODE, *KEY).join(level.drop(*NODE), KEY), rounds


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_bits: int = FAN_BITS, normalise=ascii_lower, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary), check, length."""
    rows = stage(digests(docs, id_col, text_col, normalise, run_rows), "dedup-digests")
    decided = merge_runs(rows, keep, fan_bits)[0].withColumnsRenamed({"part": "of_part", "run": "of_run"})
    same = [F.col(f"r.{k}") == F.col(f"m.{k}") for k in KEY]
    best = F.col("m.best.rank") if keep == "smallest" else F.bitwise_not("m.best.rank")
    return (
        rows.alias("r")
        .join(decided.alias("m"), [F.col("r.part") == F.col("m.of_part"), F.col("r.run") == F.col("m.of_run"), *same])
        .select(
            F.col("r.id").alias("id"),
            best.alias("keep_id"),
            F.col("m.size").alias("group_size"),
            (F.col("r.row") == F.col("m.best.row")).alias("kept"),
            *[F.col(f"r.{k}").alias(k) for k in KEY],
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_bits: int = FAN_BITS, normalise=ascii_lower) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows are met again by digest and a hash of the identifier, so texts are shuffled once; of rows that share both, one stays.
    """
    found = find_copies(docs, id_col, text_col, keep, fan_bits, normalise)
    names = [f"__{k}" for k in KEY]
    stays = found.where("kept").select(F.xxhash64("id").alias("__of"), *[F.col(k).alias(n) for k, n in zip(KEY, names, strict=True)])
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.withColumns({n: c for n, c in zip(names, _digest(norm), strict=True)} | {"__of": F.xxhash64(id_col)})
    return own.join(stays, ["__of", *names], "left_semi").dropDuplicates(["__of", *names]).select(*[F.col(f"`{c}`") for c in docs.columns])
