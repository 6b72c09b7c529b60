"""Near-duplicates by one-permutation hashing with optimal densification.

A document's set is its distinct w-word shingles (the whole sequence as one, if it has fewer words), as 52-bit hashes. One hash per shingle fills
``bands * rows`` bins with their minima; an empty bin copies a bin chosen by a fixed random sequence of its own, so
two documents with empty bins agree with the probability of their similarity. Bands of bins are bucket keys.

Documents with equal word sequences are one class, whose representative is the least identifier. Candidates are
stars: in each bucket every representative is joined to its centre, never to all others, so there are at most
``bands * stars`` candidates per representative whatever the bucket's size. Stars are laid in rounds: the centre of
the first is the least identifier, those of later ones are least by another hash per band, and a later star is only
verified between different components. Members of a bucket that are in different components after the last star, and of
which none was a centre, have not been compared: those outside the bucket's largest component are held against all its members, block by
block, and only pairs that sizes and parity bitmaps of the sets (which never rule out a link) leave possible become
candidates. Each candidate is confirmed on the full sets, so every link between two documents that share a bucket counts. A block is one
task; a bucket beyond ``BLOCK_ROWS`` members or ``BLOCK_SHINGLES`` shingles is cut into chunks, of which every two meet.

Sets travel only for documents in some bucket with another, told by a Bloom filter of fixed size (``kernel.BLOOM_WORDS``
64-bit words): where it is full it passes more rows, never fewer.

Null, empty and white-space texts have the empty set and are linked with nothing. Rows that share an identifier are
one node. Null identifiers are never representatives of a class that has another, and are not linked further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import kernel as K
from graphlake.operators.components import star_contract
from graphlake.plans.staging import stage

WORDS = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 32, 4
STARS = 3
BITS = 52
BITS_PER, LEAST_BITMAP = 4, 256  # bits of a bitmap for each shingle, and the fewest
BLOCK_ROWS, BLOCK_SHINGLES = 8192, 8 << 20  # of a crowded bucket's members that one task compares


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, w: int = WORDS) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """Sorted distinct (row << 52 | shingle) of a block, the offset of each row's set, and the words."""
    words = K.words(raw, offsets)
    rows = len(offsets) - 1
    count = np.diff(words.first)
    grams = K.windows(words.hash, w) >> np.uint64(64 - BITS)
    if len(grams):
        own = words.row[: len(grams)] == words.row[w - 1 :]
        keys = grams[own] | (words.row[: len(grams)][own].astype(np.uint64) << np.uint64(BITS))
    else:
        keys = grams
    short = np.flatnonzero((count > 0) & (count < w))
    if len(short):
        whole = K.sequence_hash(words.hash, words.first, 7)[short] >> np.uint64(64 - BITS)
        keys = np.concatenate([keys, whole | (short.astype(np.uint64) << np.uint64(BITS))])
    keys = np.sort(keys)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(BITS)), words


def signatures(keys: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """rows x bins minima, densified; rows without shingles are all zero."""
    rows = len(first) - 1
    shift = np.uint64(BITS) - np.uint64(int(bins).bit_length() - 1)
    row = (keys >> np.uint64(BITS)).astype(np.int64)
    value = keys & np.uint64((1 << BITS) - 1)
    at = row * bins + (value >> shift).astype(np.int64)
    head = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool)
    sig, full = np.zeros(rows * bins, np.uint64), np.zeros(rows * bins, bool)
    sig[at[head]], full[at[head]] = value[head], True
    sig, full = sig.reshape(rows, bins), full.reshape(rows, bins)
    r, b = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt = np.uint64(0)
    while len(r):
        to = (K.mix(b.astype(np.uint64) + (attempt << np.uint64(20)) + np.uint64(0xA5A5)) % np.uint64(bins)).astype(np.int64)
        found = full[r, to]
        sig[r[found], b[found]] = sig[r[found], to[found]]
        r, b = r[~found], b[~found]
        attempt += np.uint64(1)
    return sig


def _sketch(bands: int, rows: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column("text"))
            for lo, hi in K.blocks(offsets):
                at = offsets[lo : hi + 1]
                keys, first, words = shingle_sets(raw[at[0] : at[-1]], at, w)
                n = np.diff(first)
                sig = signatures(keys, first, bands * rows).reshape(hi - lo, bands, rows)
                band = np.zeros((hi - lo, bands), np.uint64)
                for j in range(rows):
                    band = band * np.uint64(0xD6E8FEB86659FD93) + K.mix(sig[:, :, j] + np.uint64(j + 1))
                band = K.mix(band + np.arange(bands, dtype=np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(band.ravel()))
                d1, d2 = (K.sequence_hash(words.hash, words.first, s).view(np.int64) for s in (11, 13))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), lists], ["id", "n", "d1", "d2", "bands"]
                )

    return run


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, w: int) -> DataFrame:
    """(id, set) with the set as 7 bytes per shingle, in order, of documents that ``wanted`` (id) may hold."""
    table = docs.sparkSession.sparkContext.broadcast(K.bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(K.bloom_has(table.value, batch.column("id").to_numpy(zero_copy_only=False))))
            raw, offsets = K.text_bytes(batch.column("text"))
            for lo, hi in K.blocks(offsets):
                at = offsets[lo : hi + 1]
                keys, first, _ = shingle_sets(raw[at[0] : at[-1]], at, w)
                values = keys & np.uint64((1 << BITS) - 1)
                packed = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
                sets = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * 7).astype(np.int32)), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), sets], ["id", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, set binary")


def _unpack(column: pa.Array) -> list[np.ndarray]:
    out = []
    for x in column:
        b = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 7)
        wide = np.zeros((len(b), 8), np.uint8)
        wide[:, :7] = b
        out.append(wide.view("<u8").ravel())
    return out


def _confirm(threshold: int):
    """Keeps (u, v) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for i, (a, b) in enumerate(zip(_unpack(part.column("a")), _unpack(part.column("b")), strict=True)):
                    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
                        continue
                    both = np.sort(np.concatenate([a, b]))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[lo + i] = 100 * common >= threshold * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bits) of sets: the parity of how many shingles fall on each bit, at least ``BITS_PER`` bits a shingle.

    Two bitmaps differ in at most as many bits as shingles are in one set only.
    """
    for batch in batches:
        out = []
        for x in _unpack(batch.column("set")):
            size = max(LEAST_BITMAP, 1 << (BITS_PER * len(x) - 1).bit_length())
            at = (K.mix(x) & np.uint64(size - 1)).astype(np.int64)
            out.append(np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "bits"])


def _near_in_block(ids: np.ndarray, roots: np.ndarray, n: np.ndarray, chunk: np.ndarray, bits: list[np.ndarray], cross: bool, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) of different components that neither sizes nor bitmaps rule out; with ``cross``, of different chunks only."""
    by = np.lexsort((ids, n))
    ids, roots, n, chunk = (x[by] for x in (ids, roots, n, chunk))
    bits = [bits[i] for i in by.tolist()]
    width = np.array([len(x) for x in bits])
    levels = {}  # bitmaps of one width, and those of twice the width folded to it
    for k in np.unique(width).tolist():
        rows = np.flatnonzero((width == k) | (width == 2 * k))
        levels[k] = np.stack([x if len(x) == k else x[:k] ^ x[k:] for x in (bits[i] for i in rows.tolist())]), rows
    name, inverse, times = np.unique(roots, return_inverse=True, return_counts=True)
    asks = inverse != np.argmax(times)  # within the largest component nothing is left to find
    start, stop = np.searchsorted(n, -(-threshold * n // 100)), np.searchsorted(n, 100 * n // threshold, "right")
    first, second = [ids[:0]], [ids[:0]]
    for r in np.flatnonzero(asks).tolist():
        for k in (len(bits[r]), len(bits[r]) // 2):
            if k not in levels:
                continue
            table, rows = levels[k]
            a, b = np.searchsorted(rows, (start[r], stop[r]))
            other = rows[a:b]
            fine = (roots[other] != roots[r]) & (~asks[other] | (other < r))  # a pair that both ask for is found once
            if k < len(bits[r]):
                fine &= width[other] == k
            if cross:
                fine &= chunk[other] != chunk[r]
            fine = np.flatnonzero(fine)
            if not len(fine):
                continue
            other = other[fine]
            own = bits[r] if len(bits[r]) == k else bits[r][:k] ^ bits[r][k:]
            apart = np.bitwise_count(table[a:b][fine] ^ own).sum(axis=1, dtype=np.int64)
            both = n[other] + n[r]
            # the threshold is reached only by sets that differ in at most this many shingles
            fine = apart <= both - 2 * -(-threshold * both // (100 + threshold))
            first.append(np.full(int(fine.sum()), ids[r]))
            second.append(ids[other[fine]])
    u, v = np.concatenate(first), np.concatenate(second)
    return np.maximum(u, v), np.minimum(u, v)


def _near(threshold: int):
    """(u, v) from rows in order of (bucket, i, j), a block after the other."""
    names = ["bucket", "i", "j"]

    def block(table: pa.Table) -> pa.RecordBatch:
        ids, roots, n, chunk = (table.column(c).to_numpy() for c in ("rep", "root", "n", "chunk"))
        bits = [np.frombuffer(x.as_buffer(), np.uint64) for part in table.column("bits").chunks for x in part]
        u, v = _near_in_block(ids, roots, n, chunk, bits, table.column("i")[0] != table.column("j")[0], threshold)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a block that may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            cut = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])).tolist()
            for lo, hi in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                key = tuple(keys[:, lo].tolist())
                if held and key != last:
                    yield block(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def _unmet_pairs(rest: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(u, v) of different components that share a bucket in ``rest`` (bucket, rep, n, root) and can reach the threshold.

    A bucket is one block of rows, or, beyond ``BLOCK_ROWS`` rows or ``BLOCK_SHINGLES`` shingles, chunks by hash of which every two meet in a block.
    """
    size = rest.groupBy("bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("m"))
    bitmaps = stage(sets.mapInArrow(_bitmaps, "id long, bits binary"), "minhash-bitmaps")
    rows = rest.join(size, "bucket").join(bitmaps.withColumnRenamed("id", "rep"), "rep")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    kept = ["bucket", "i", "j", "rep", "root", "n", "chunk", "bits"]
    whole = rows.where("m = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}).select(kept)
    parts = rows.where("m > 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    parts = parts.withColumns({"i": F.least("chunk", "k"), "j": F.greatest("chunk", "k")}).select(kept)
    blocks = whole.unionByName(parts).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return blocks.mapInArrow(_near(threshold), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", w: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, stars: int = STARS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept. Identifiers are integers."""
    if bands * rows & (bands * rows - 1):
        raise ValueError("bands * rows must be a power of two")
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = stage(narrow.mapInArrow(_sketch(bands, rows, w), "id long, n long, d1 long, d2 long, bands array<long>"), "minhash-sketch")
    filled = sketch.where("n > 0")
    # equal word sequences: one class, named by its least identifier
    classes = stage(filled.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.min_by("bands", F.col("id")).alias("bands")).where("rep is not null"), "minhash-classes")
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))  # the band is part of the key
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), *[F.min(_order(s)).alias(f"o{s}") for s in range(stars)])
    crowded = stage(crowded.where("members > 1").drop("members"), "minhash-buckets")
    met = banded.join(crowded, "bucket")
    star = F.explode(F.array(*[F.struct(F.lit(s).alias("star"), _centre(s).alias("v")) for s in range(stars)]))
    pairs = met.select(F.col("rep").alias("u"), F.col("n").alias("un"), star.alias("x")).select("u", "un", "x.*").where("u <> v")
    pairs = pairs.groupBy("u", "un", "v").agg(F.min("star").alias("star"))
    # sizes alone rule a link out where one is too small for the other
    pairs = pairs.join(classes.select(F.col("rep").alias("v"), F.col("n").alias("vn")), "v").where(F.least("un", "vn") * 100 >= F.greatest("un", "vn") * threshold)
    pairs = pairs.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.min("star").alias("star"))
    pairs = stage(pairs, "minhash-pairs")
    involved = pairs.select("u").union(pairs.select("v")).distinct()
    sets = stage(_sets(docs, id_col, text_col, involved, w).join(involved.withColumnRenamed("u", "id"), "id", "left_semi"), "minhash-sets")
    known: DataFrame | None = None  # (node, root)
    links: DataFrame | None = None
    for s in range(stars):
        todo = pairs.where(F.col("star") == s).select("u", "v")
        if known is not None:
            root = known.select(F.col("node"), F.col("root"))
            todo = todo.join(root.withColumnsRenamed({"node": "u", "root": "ru"}), "u", "left").join(root.withColumnsRenamed({"node": "v", "root": "rv"}), "v", "left")
            todo = todo.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")
        true = _true(todo, sets, threshold)
        edges = true if links is None else true.unionByName(links)
        known = star_contract(edges, "u", "v")
        links = known.select(F.col("node").alias("u"), F.col("root").alias("v"))
    # members of a bucket that were never compared: no centres, of different components
    rest = met.where(~F.col("rep").isin(*[_centre(s) for s in range(stars)])).select("bucket", "rep", "n")
    rest = rest.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("root", "rep").alias("root"))
    apart = rest.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    rest = stage(rest.join(apart, "bucket", "left_semi"), "minhash-rest")
    if not rest.isEmpty():
        wanted = rest.select(F.col("rep").alias("id")).distinct()
        lacking = wanted.join(involved.withColumnRenamed("u", "id"), "id", "left_anti")  # sizes ruled all their centres out
        left = sets.join(wanted, "id", "left_semi").unionByName(_sets(docs, id_col, text_col, lacking, w).join(lacking, "id", "left_semi"))
        left = stage(left, "minhash-rest-sets")
        todo = stage(_unmet_pairs(rest, left, threshold), "minhash-rest-pairs")
        known = star_contract(_true(todo, left, threshold).unionByName(links), "u", "v")
    own = classes.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("root", "rep").alias("component"))
    out = sketch.select("id", "n", "d1", "d2").join(own, ["d1", "d2", "n"], "left")
    component = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _true(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    full = pairs.join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v").join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u")
    return full.select("u", "v", "a", "b").mapInArrow(_confirm(threshold), "u long, v long")


def _order(s: int):
    """The order in which a bucket chooses the centre of its star s: the identifier itself, or with bits flipped by bucket and star."""
    return F.col("rep") if s == 0 else F.col("rep").bitwiseXOR(F.xxhash64("bucket", F.lit(s)))


def _centre(s: int):
    """The identifier whose order was least."""
    return F.col("o0") if s == 0 else F.col(f"o{s}").bitwiseXOR(F.xxhash64("bucket", F.lit(s)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which no other document with a smaller identifier is in the same component."""
    stays = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("id").alias("__id")).distinct()
    return docs.join(stays, F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left_semi")
