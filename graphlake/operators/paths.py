"""Shortest paths with all ties, single-source lengths, all simple paths, all-pairs hop counts."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.graph import Graph, cost
from graphlake.plans.iterate import grow
from graphlake.plans.numbering import dense_index
from graphlake.plans.staging import discard, stage


def _lengths(graph: Graph, directed: bool, weight: str | None, zero_weight: str) -> DataFrame:
    arcs = graph.arcs(directed).select("src", "dst", "pos", cost(weight, zero_weight).alias("w"))
    arcs = stage(arcs, "path-arcs")
    if weight is not None and not arcs.where("w < 0").isEmpty():
        raise ValueError("a negative weight")
    return arcs


def _settle(graph: Graph, source, arcs: DataFrame, max_rounds: int) -> DataFrame:
    """(id, length) by rounds of relaxation: a round joins only the vertices that the last one improved."""
    best = graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("length"))
    short = stage(arcs.groupBy("src", "dst").agg(F.min("w").alias("w")), "path-short")
    state = stage(best.withColumn("new", F.lit(True)), "path")
    for _ in range(max_rounds):
        offered = state.where("new").withColumnRenamed("id", "src").join(short, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("length") + F.col("w")).alias("other"))
        both = state.select("id", "length").join(offered, "id", "full")
        better = F.col("length").isNull() | (F.col("other") < F.col("length"))
        last, state = state, stage(both.select("id", F.least("length", "other").alias("length"), F.coalesce(F.col("other").isNotNull() & better, F.lit(False)).alias("new")), "path")
        discard(last)
        if state.where("new").isEmpty():
            return state.select("id", "length")
    raise RuntimeError(f"lengths do not settle in {max_rounds} rounds: a cycle of negative length?")


def shortest_lengths(graph: Graph, source, directed: bool = False, weight: str | None = None, zero_weight: str = "one", max_rounds: int = 100_000) -> DataFrame:
    """(id, length) of the vertices that ``source`` reaches."""
    return _settle(graph, source, _lengths(graph, directed, weight, zero_weight), max_rounds)


def shortest_paths(graph: Graph, source, directed: bool = False, weight: str | None = None, zero_weight: str = "one", targets: list | None = None, multi: bool = False) -> DataFrame:
    """(id, length, rank, path): every shortest path to every vertex reached; rank 1 is the one preferred.

    Paths are compared from their target back: at each vertex the nearer predecessor goes first, of equally near ones the
    one placed later, then the edge placed first. Parallel edges that tie give one path, or several with ``multi``.
    """
    arcs = _lengths(graph, directed, weight, zero_weight)
    found = stage(_settle(graph, source, arcs, 100_000), "path-settled")
    place = graph.vertices.select("id", "pos")
    near = found.join(place, "id")
    tight = arcs.join(near.select(F.col("id").alias("src"), F.col("length").alias("ls"), F.col("pos").alias("ps")), "src").join(found.select(F.col("id").alias("dst"), F.col("length").alias("ld")), "dst")
    tight = tight.where((F.col("ls") + F.col("w") == F.col("ld")) & (F.col("w") > 0)).select("src", "dst", "ls", "ps", "pos")
    if not multi:
        tight = tight.groupBy("src", "dst", "ls", "ps").agg(F.min("pos").alias("pos"))
    if targets is not None:  # only what leads to a target
        back = grow(
            lambda frontier, seen, i: frontier.select(F.col("id").alias("dst")).join(tight, "dst").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti"),
            found.where(F.col("id").isin(targets)).select("id"),
            label="path-back",
        )
        tight = tight.join(back.withColumnRenamed("id", "dst"), "dst", "left_semi")
    tight = stage(tight, "path-tight")
    empty = F.array().cast("array<struct<length:double,pos:bigint,edge:bigint>>")
    first = found.where(F.col("id") == source).select("id", F.array("id").alias("path"), empty.alias("by"))

    def longer(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        step = frontier.withColumnRenamed("id", "src").join(tight, "src")
        key = F.struct(F.col("ls").alias("length"), (-F.col("ps")).alias("pos"), F.col("pos").alias("edge"))
        return step.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), F.concat(F.array(key), F.col("by")).alias("by"))

    ways = grow(longer, first, label="path-ways").join(found, "id")
    if targets is not None:
        ways = ways.where(F.col("id").isin(targets))
    return ways.select("id", "length", F.row_number().over(Window.partitionBy("id").orderBy("by")).alias("rank"), "path")


def shortest_path(graph: Graph, start, end, directed: bool = False, weight: str | None = None) -> DataFrame:
    """(length, rank, path) of all shortest paths from ``start`` to ``end``."""
    return shortest_paths(graph, start, directed, weight, targets=[end]).select("length", "rank", "path")


def sssp(graph: Graph, source, weight: str | None = None, unreachable: float | None = None) -> DataFrame:
    """(target, distance, predecessor) of every vertex along directed edges; the predecessor is the tight one of least position.

    Vertices out of reach have distance ``unreachable`` and no predecessor; neither has the source.
    """
    arcs = _lengths(graph, True, weight, "one")
    found = stage(_settle(graph, source, arcs, 100_000), "path-settled")
    near = found.join(graph.vertices.select("id", "pos"), "id")
    tight = arcs.join(near.select(F.col("id").alias("src"), F.col("length").alias("ls"), F.col("pos").alias("ps")), "src").join(found.select(F.col("id").alias("dst"), F.col("length").alias("ld")), "dst")
    by = tight.where(F.col("ls") + F.col("w") == F.col("ld")).groupBy("dst").agg(F.min_by("src", "ps").alias("predecessor"))
    out = graph.vertices.select("id").join(found, "id", "left").join(by, F.col("id") == F.col("dst"), "left")
    return out.select(F.col("id").alias("target"), F.coalesce("length", F.lit(unreachable).cast("double")).alias("distance"), F.when(F.col("id") != source, F.col("predecessor")).alias("predecessor"))


def simple_paths(graph: Graph, start, end, directed: bool = False, max_hops: int | None = None) -> DataFrame:
    """(path): every simple path from ``start`` to ``end``; [start] if they are equal. Parallel edges count once.

    Only vertices that reach ``end`` are walked.
    """
    arcs = graph.arcs(directed).where("src <> dst").select("src", "dst").distinct()
    back = grow(
        lambda frontier, seen, i: frontier.select(F.col("id").alias("dst")).join(arcs, "dst").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti"),
        graph.vertices.where(F.col("id") == end).select("id"),
        label="path-back",
    )
    arcs = stage(arcs.join(back.select(F.col("id").alias("dst")), "dst", "left_semi").where(F.col("src") != end), "path-arcs")
    first = graph.vertices.where(F.col("id") == start).select(F.col("id").alias("last"), F.array("id").alias("path"))
    if start == end:
        return first.select("path")

    def longer(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        step = frontier.withColumnRenamed("last", "src").join(arcs, "src").where(~F.array_contains("path", F.col("dst")))
        return step.select(F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))

    return grow(longer, first, max_hops, "path-ways").where(F.col("last") == end).select("path")


#: A row of ``all_pairs_hops`` holds a set of 64 * WORDS sources.
WORDS = 64

#: Heads in a list of ``all_pairs_hops``, about, if a vertex has an edge to every other.
HEADS = 1 << 16

#: Vertices of a tile of ``all_pairs_hops``; their places in it fit 16 bits. A task holds two sets for each.
TILE = 1 << 15

#: Heads in a row that goes to NumPy, arcs that it sorts at once, and sets that it gathers at once.
ROW_HEADS, ARCS, SETS = 1 << 12, 1 << 21, 1 << 10


def _unite(into: np.ndarray, heads: np.ndarray, rows: np.ndarray, sets: np.ndarray, most: int) -> None:
    """into[heads[k]] |= sets[rows[k]] for all k. Heads with equally many rows are taken together, about ``most`` sets at once."""
    order = np.argsort(heads, kind="stable")
    heads, rows = heads[order], rows[order]
    starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
    counts = np.diff(np.r_[starts, len(heads)])
    for n in np.unique(counts).tolist():
        at = starts[counts == n]
        step = max(1, most // n)
        for i in range(0, len(at), step):
            part = at[i : i + step]
            for k in range(0, n, most):
                taken = np.take(sets, rows[part + np.arange(k, min(n, k + most))[:, None]].ravel(), axis=0, mode="clip")
                into[heads[part]] |= np.bitwise_or.reduce(taken.reshape(-1, len(part) * sets.shape[1]), axis=0).reshape(len(part), -1)


def _fresh(words: int, tile: int, sources: int, arcs: int, most: int):
    """The sets of sources that reach a vertex for the first time, and whether all of the block have come now. From rows (tile, block, at,
    bits, heads) sorted by tile and block: first sets seen at a vertex of the tile, without heads, or null for all sources; then sets for heads."""

    def run(batches):
        seen, met, touched = np.zeros((tile, words), np.uint64), np.zeros((tile, words), np.uint64), np.zeros(tile, bool)
        last = mask = full = None

        def flush():
            at = np.flatnonzero(touched)
            new = met[at] & ~seen[at]
            some = new.any(axis=1)
            whole = ((new | seen[at]) == mask).all(axis=1)[some]
            seen[at], met[at], touched[at] = 0, 0, False
            new, at = new[some], at[some]
            if len(at):
                bits = pa.ListArray.from_arrays(np.arange(0, new.size + 1, words, dtype=np.int32), new.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(at + last[0] * tile), pa.array(np.full(len(at), last[1])), bits, pa.array(whole)], ["place", "block", "bits", "whole"])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                here = tuple(key[:, lo].tolist())
                if here != last:
                    if last is not None:
                        yield from flush()
                    last, full = here, None
                    mask = np.array([(1 << min(max(sources - 64 * (here[1] * words + k), 0), 64)) - 1 for k in range(words)], np.uint64)
                at, bits, lists = batch.slice(lo, hi - lo).columns[2:]
                sets = bits.flatten().to_numpy().view(np.uint64).reshape(-1, words)
                given = bits.is_valid().to_numpy(zero_copy_only=False)
                row = np.cumsum(given) - 1
                known = lists.is_null().to_numpy(zero_copy_only=False)
                at = at.to_numpy()
                touched[at[known]] = True
                if (known & given).any():
                    _unite(seen, at[known & given], row[known & given], sets, most)
                seen[at[~given]] = mask
                if known.all():
                    continue
                if full is None:  # there nothing can be new
                    full = (seen == mask).all(axis=1)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                heads, ends = lists.flatten().to_numpy(), np.cumsum(sizes, dtype=np.int64)
                i = 0
                while i < len(ends):
                    first = ends[i] - sizes[i]
                    j = max(i + 1, int(np.searchsorted(ends, first + arcs, "right")))
                    some, rows = heads[first : ends[j - 1]], np.repeat(row[i:j], sizes[i:j])
                    unmet = ~full[some]
                    some, rows = some[unmet], rows[unmet]
                    if len(some):
                        touched[some] = True
                        _unite(met, some, rows, sets, most)
                    i = j
        if last is not None:
            yield from flush()

    return run


def all_pairs_hops(graph: Graph, directed: bool = False, max_hops: int | None = None) -> DataFrame:
    """(src, dst, dist): hop counts of all pairs that reach each other, 0 to itself. Weights don't count.

    Sources walk together: a row (place, block) has a bit for each source of the block that reaches the vertex of this place in a round.
    Sources with their least head in common share blocks. A vertex's heads are lists by tiles of places; a round sends a vertex's set
    once to each tile where it has heads, and there the sets are united in memory, for each tile and block apart. Sets become pairs at the end.
    """
    ends = graph.edges.where("src <> dst").select(F.col("src").alias("mid"), "dst")
    if directed:
        ends = ends.distinct()
    else:  # an edge once whatever its direction, then both ways
        ends = ends.select(F.least("mid", "dst").alias("mid"), F.greatest("mid", "dst").alias("dst")).distinct()
        ends = ends.select(F.inline(F.array(F.struct("mid", "dst"), F.struct(F.col("dst").alias("mid"), F.col("mid").alias("dst")))))
    lists = F.pmod(F.xxhash64("dst"), F.lit(1 + graph.vertices.count() // HEADS))
    arcs = stage(ends.groupBy("mid", lists.alias("list")).agg(F.collect_list("dst").alias("heads")).drop("list"), "hops-arcs")
    near = arcs.groupBy(F.col("mid").alias("id")).agg(F.min(F.array_min("heads")).alias("near"))
    others = arcs.select("mid") if not directed else arcs.select(F.explode("heads"))  # ends of edges may be no vertices
    ids = graph.vertices.select("id", F.lit(True).alias("source")).union(others.withColumn("source", F.lit(False))).groupBy("id").agg(F.max("source").alias("source"))
    places = stage(dense_index(ids.join(near, "id", "left"), [~F.col("source"), "near", "id"], "place").select("place", "id", "source"), "hops-places")
    n, sources = places.agg(F.count(F.lit(1)), F.count_if("source")).first()
    place, block, tile = places.select("place", "id"), 64 * WORDS, F.floor(F.col("place") / TILE).alias("tile")
    heads = arcs.select("mid", F.explode("heads").alias("id")).join(place, "id").groupBy("mid", tile).agg(F.collect_list((F.col("place") % TILE).cast("short")).alias("heads"))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("heads") - 1) / ROW_HEADS)), lambda k: F.slice("heads", k * ROW_HEADS + 1, F.lit(ROW_HEADS))))
    heads = stage(heads.withColumnRenamed("mid", "id").join(place, "id").select("place", "tile", cut.alias("heads")), "hops-heads")
    word, bit = F.floor(F.col("place") % block / 64), F.call_function("shiftleft", F.expr("1L"), (F.col("place") % 64).cast("int"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.when(k == word, bit).otherwise(F.lit(0).cast("long")))
    first = places.where("source").select("place", F.floor(F.col("place") / block).alias("block"), bits.alias("bits"), F.lit(False).alias("whole"), F.lit(0).alias("dist"))
    tasks = 4 * (1 + n // TILE) * (1 + sources // block)
    dealt = ["tile", "block"] if tasks > 1_000 else [tasks, "tile", "block"]
    one = _fresh(WORDS, min(TILE, n), sources, ARCS, SETS)

    def level(frontier: DataFrame, seen: DataFrame, i: int) -> DataFrame:
        # a row for each tile and block whose pairs are all found: up to TILE * 64 * WORDS pairs each
        done = seen.where("whole").groupBy(tile, "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.least(F.lit(TILE), n - F.col("tile") * TILE))
        met = frontier.select("place", "block", "bits").join(heads, "place").select("tile", "block", F.lit(0).cast("long").alias("at"), "bits", "heads")
        known = seen.select(tile, "block", F.col("place") % TILE, F.when(~F.col("whole"), F.col("bits")), F.lit(None).cast("array<smallint>"))
        rest = known.union(met).toDF("tile", "block", "at", "bits", "heads").join(F.broadcast(done), ["tile", "block"], "left_anti")
        rest = rest.repartition(*dealt).sortWithinPartitions("tile", "block", F.col("heads").isNotNull())
        return rest.mapInArrow(one, "place long, block long, bits array<long>, whole boolean").withColumn("dist", F.lit(i))

    found = grow(level, first, max_hops, "hops")
    names = place.groupBy(F.floor(F.col("place") / block).alias("block"), word.alias("word")).agg(F.sort_array(F.collect_list(F.struct("place", "id")))["id"].alias("ids"))  # up to 64
    names = stage(names.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("word", "ids")))["ids"].alias("names")), "hops-names")  # up to WORDS
    sets = found.join(place.withColumnRenamed("id", "dst"), "place").join(names, "block").select("dst", "dist", "names", F.posexplode("bits").alias("k", "set")).where("set <> 0")
    pairs = sets.select("dst", "dist", "set", F.posexplode(F.col("names")[F.col("k")]).alias("at", "src"))
    return pairs.where(F.getbit("set", "at") == 1).select("src", "dst", "dist")
