"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences at ``.``, ``!``, ``?`` and line ends; a sentence of more than ``LONG`` words is cut further after the words whose
hash is least among ``LONG`` consecutive ones, which depends on the words alone, so a passage that starts within a sentence or
has no punctuation is cut alike wherever it stands. A span is a run of at least ``run`` consecutive sentences and at least
``least_words`` words. Spans of all documents are hashed and joined; the first document of a span is the one with the
least identifier, and within a document its first place. Sentences covered by any other occurrence are removed.

Words are compared lower-cased (A-Z), white space does not matter. A document with fewer sentences than a run but
enough words is one span. Null and empty texts have no sentences and stay as they are. Rows that share an identifier count as one
document: spans they share with each other stay. A null identifier comes last. Other columns pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import kernel as K
from graphlake.llm.text import free_name, row_key
from graphlake.plans.staging import stage

RUN, LEAST_WORDS, LONG = 3, 12, 9
LAST = 2**63 - 1

_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray]:
    """Words of a block and the index of the first word of each sentence, in order."""
    w = K.words(raw, offsets)
    n = len(w.hash)
    if not n:
        return w, np.empty(0, np.int64)
    lines = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LINE[raw], out=lines[1:])
    last = np.ones(n, bool)  # the word ends a sentence
    last[:-1] = (w.row[1:] != w.row[:-1]) | _STOP[raw[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.end[:-1]])
    if n >= LONG:
        which = np.zeros(n, np.int64)
        np.cumsum(last[:-1], out=which[1:])
        low = w.hash
        width = 1
        while width < LONG:  # least of LONG consecutive hashes, by doubling
            step = min(width, LONG - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        inside = which[: len(low)] == which[LONG - 1 :]
        least = np.where(inside, low, np.uint64(0))
        for j in range(LONG):
            last[j : j + len(low)] |= least == w.hash[j : j + len(low)]
    first = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
    return w, first


def spans(w: K.Words, first: np.ndarray, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentence after the last, hash) of every span of a block, in order."""
    n = len(first)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    bound = np.append(first, len(w.hash))  # word at which each sentence starts
    row = w.row[first]
    head = np.searchsorted(first, w.first)  # first sentence of each row
    stop = head[row + 1]  # sentence after the row's last
    at = np.arange(n)
    to = np.maximum(np.minimum(at + run, stop), np.searchsorted(bound, first + least_words))
    whole = (at == head[row]) & (stop - at < run)  # a short document is one span
    fine = (to <= stop) & ((at + run <= stop) | whole)
    at, to = at[fine], to[fine]
    return at, to, K.range_hash(w.hash, bound[at], bound[to], 9)


def _table(run: int, least_words: int):
    """(id, key, bounds, starts, ends, hashes): byte bounds of sentences, and the document's spans."""

    def work(batches):
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column("text"))
            for lo, hi in K.blocks(offsets):
                at = offsets[lo : hi + 1]
                block = raw[at[0] : at[-1]]
                w, first = sentences(block, at)
                a, b, h = spans(w, first, run, least_words)
                head = np.searchsorted(first, w.first)
                row = w.row[first] if len(first) else np.empty(0, np.int64)
                start = (w.start[first] if len(first) else first) - (at[:-1] - at[0])[row]
                cut = np.searchsorted(a, head)
                local = lambda x: pa.array((x - head[:-1][row[a]] if len(a) else x).astype(np.int32))
                lists = lambda index, values: pa.ListArray.from_arrays(pa.array(index.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo), lists(head, pa.array(start.astype(np.int32))), lists(cut, local(a)), lists(cut, local(b)), lists(cut, pa.array(h.view(np.int64)))],
                    ["id", "key", "starts", "a", "b", "hashes"],
                )

    return work


def _occurrences(batches):
    """(hash, id): each span of a document once."""
    for batch in batches:
        lists = batch.column("hashes")
        h, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(batch.column("id").to_numpy(), n))], ["hash", "id"])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, key, sentences, removed: array of sentence numbers, spans: array of (start, end) in bytes) of every document.

    ``key`` is ``text.row_key`` of the text. A span's end is the start of the next sentence, or null at the text's end.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    table = stage(rows.mapInArrow(_table(run, least_words), "id long, key long, starts array<int>, a array<int>, b array<int>, hashes array<long>"), "repeats-spans")
    seen = table.select("id", "hashes").mapInArrow(_occurrences, "hash long, id long")
    shared = seen.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("hash", "first")
    shared = stage(shared, "repeats-shared")
    known = docs.sparkSession.sparkContext.broadcast(K.bloom(shared.select("hash")))

    def candidates(batches):
        for batch in batches:
            lists = batch.column("hashes")
            h, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            keep = K.bloom_has(known.value, h)
            out = [h, np.repeat(batch.column("id").to_numpy(), n), np.repeat(batch.column("key").to_numpy(), n), batch.column("a").flatten().to_numpy(), batch.column("b").flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out], ["hash", "id", "key", "a", "b"])

    some = table.select("id", "key", "a", "b", "hashes").mapInArrow(candidates, "hash long, id long, key long, a int, b int")
    later = some.join(shared, "hash").where("id > first").select("id", "key", "a", "b").distinct()
    later = later.groupBy("id", "key").agg(F.collect_list("a").alias("ra"), F.collect_list("b").alias("rb"))
    joined = table.join(later, ["id", "key"], "left")

    def removed(batches):
        for batch in batches:
            got = batch.to_pydict()
            out = {"id": [], "key": [], "sentences": [], "removed": [], "spans": []}
            for i in range(batch.num_rows):
                n = len(got["starts"][i])
                gone = np.zeros(n + 1, np.int64)
                for a, b in zip(got["ra"][i] or (), got["rb"][i] or (), strict=True):
                    gone[a] += 1
                    gone[b] -= 1
                seen: set[int] = set()
                if len(set(got["hashes"][i])) < len(got["hashes"][i]):  # places of a span after its first
                    for a, b, h in zip(got["a"][i], got["b"][i], got["hashes"][i], strict=True):
                        if h in seen:
                            gone[a] += 1
                            gone[b] -= 1
                        seen.add(h)
                which = np.flatnonzero(np.cumsum(gone)[:n] > 0).tolist()
                parts: list[dict] = []
                for s in which:
                    end = got["starts"][i][s + 1] if s + 1 < n else None
                    if parts and parts[-1]["end"] == got["starts"][i][s]:
                        parts[-1]["end"] = end
                    else:
                        parts.append({"start": got["starts"][i][s], "end": end})
                for k, v in (("id", got["id"][i]), ("key", got["key"][i]), ("sentences", n), ("removed", which), ("spans", parts)):
                    out[k].append(v)
            kind = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("sentences", pa.int64()), ("removed", pa.list_(pa.int32())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
            yield pa.RecordBatch.from_pydict(out, kind)

    return joined.mapInArrow(removed, "id long, key long, sentences long, removed array<int>, spans array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, **options) -> DataFrame:
    """``docs`` with the repeated sentences cut out of their texts; ``counts`` adds n_removed (with an underscore after it where ``docs`` has that column).

    Only rows that a Bloom filter of fixed size names are shuffled with their texts; all others are passed on.
    """
    found = stage(find_repeats(docs, id_col, text_col, **options), "repeats-found")
    hit = found.where("size(removed) > 0").select("id", "key", "removed", "spans").dropDuplicates(["id", "key"])
    known = docs.sparkSession.sparkContext.broadcast(K.bloom(hit.select("key")))
    own = docs.withColumn("__key", row_key(F.col(text_col)))

    def split(want: bool):
        def work(batches):
            for batch in batches:
                yield batch.filter(pa.array(K.bloom_has(known.value, batch.column(batch.num_columns - 1).to_numpy()) == want))

        return work

    hit = hit.select(F.col("id").alias("__id"), F.col("key").alias("__of"), F.col("removed").alias("__removed"), F.col("spans").alias("__spans"))
    some = own.mapInArrow(split(True), own.schema)
    some = some.join(hit, (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col("__id")) & (F.col("__key") == F.col("__of")), "left").drop("__id", "__of")
    at = own.columns.index(text_col)
    result = own.drop("__key").schema.fieldNames()
    n_removed = free_name("n_removed", docs.columns)

    def cut(batches):
        for batch in batches:
            texts, where = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for text, parts in zip(texts, where, strict=True):
                if parts:
                    data, kept, last = text.encode(), [], 0
                    for p in parts:
                        kept.append(data[last : p["start"]])
                        last = len(data) if p["end"] is None else p["end"]
                    text = b"".join([*kept, data[last:]]).decode()
                out.append(text)
            n = pa.array([len(x or ()) for x in batch.column(batch.num_columns - 2).to_pylist()], pa.int64())
            columns = [pa.array(out, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(result))]
            yield pa.RecordBatch.from_arrays([*columns, n], [*result, n_removed])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("__key").schema.fields) + f", `{n_removed}` long"
    cleaned = some.drop("__key").mapInArrow(cut, schema)
    rest = own.mapInArrow(split(False), own.schema).drop("__key").withColumn(n_removed, F.lit(0).cast("long"))
    both = cleaned.unionByName(rest)
    return both if counts else both.drop(n_removed)
