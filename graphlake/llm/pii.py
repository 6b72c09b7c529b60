"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and telephone numbers that patterns find, and secrets: long runs of letters
and digits whose characters carry much information (``secret``). A term reveals an entity to the degree that seeing the
term makes the entity likely: with document counts over the whole corpus,
disclosure(t, e) = PMI(t; e) / IC(e) = 1 + log2 P(e | t) / log2 (N / n(e)), 1 if the term only occurs with the entity. e is

* a value, such as one address. Terms whose disclosure reaches ``threshold`` in at least ``support`` documents reveal it, if the documents that hold
  both are no near-copies of one another, in which every word meets every value: they must differ in ``APART`` of their marks, on the average;
* a kind, for which nothing is known of the values. As a rare term may meet a kind by chance, it must also be so improbable that less than ``CHANCE`` of
  all terms of the corpus would: by Chernoff's bound, m * KL(P(e | t) || P(e)) bits, with m from the number of different values
  met, so that copies of a document count once.

Revealing terms are spans of kind ``term`` wherever they stand, in every document. ``sanitise`` generalises a span to the name of
its kind or removes it.

Null and empty texts have no spans. Rows that share an identifier are told apart by their text; equal rows get equal spans and all
count as documents, but not as separate ones. Other columns pass through ``sanitise`` untouched, whatever their names.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import kernel as K
from graphlake.llm.text import row_key
from graphlake.llm.toxicity import MEMBER
from graphlake.plans.staging import stage

KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET, TERM = 4, 5
MARKS = tuple(f"c{i}" for i in range(8))  # least hashes of a document's pairs of words, by which documents are told from near-copies
APART = 0.4  # least share of marks in which documents that count as separate differ
FREQUENT = 1 << 16  # most frequent terms whose counts rule pairs out early
THRESHOLD, SUPPORT = 0.8, 3
CHANCE = 1 / 128  # expected number of terms that seem to reveal a kind by chance
LEAST_BITS = 2.5  # information of a secret's character by its own frequencies

_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a run of digits is tried from its first digit only: the others fail alike
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
_KEY_ID = re.compile(rb"AKIA[0-9A-Z]{16}")  # fixed format of access key identifiers
_SWITCH = re.compile(rb"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(x: bytes) -> bytes:
    return b"".join(_DIGIT.findall(x))


def secret(run: bytes) -> bool:
    """Whether letters and digits alternate as in random strings and the characters carry at least LEAST_BITS bits."""
    if _KEY_ID.fullmatch(run):
        return True
    if len(_SWITCH.findall(run)) < 1 + len(run) / 8:
        return False
    share = np.unique(np.frombuffer(run, np.uint8), return_counts=True)[1] / len(run)
    return float(-(share * np.log2(share)).sum()) >= LEAST_BITS


def base_spans(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, kind, normalised value) of every entity, in order; texts are separated by line feeds, which no pattern crosses.
    A run that overlaps one of another kind is no secret."""
    found = []
    free = 0
    for m in _DOMAIN.finditer(data):
        s = m.start()
        while s > free and data[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            found.append((s, m.end(), 0, data[s : m.end()].lower()))
            free = m.end()
    for m in _IP.finditer(data):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m.group().split(b".")):
            found.append((m.start(), m.end(), 1, m.group()))
    for m in _CARD.finditer(data):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), 2, d))
    for m in _PHONE.finditer(data):
        if 10 <= len(d := _digits(m.group())) <= 15:
            found.append((m.start(), m.end(), 3, d))
    found.sort(key=lambda x: (x[0], x[2]))
    runs = [m for m in _RUN.finditer(data) if secret(m.group())]
    if runs:
        start, stop = np.array([x[0] for x in found], np.int64), np.maximum.accumulate(np.array([x[1] for x in found] or [0], np.int64))
        for m in runs:
            before = int(np.searchsorted(start, m.end()))  # entities that start before the run ends
            if not before or stop[before - 1] <= m.start():
                found.append((m.start(), m.end(), SECRET, m.group()))
        found.sort(key=lambda x: (x[0], x[2]))
    return found


def _joined(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a line feed after each, and where each starts."""
    at = at - at[0]
    start = at[:-1] + np.arange(len(at) - 1)
    out = np.full(len(raw) + len(at) - 1, 10, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = raw
    return out, start


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.int64())])
MENTIONS = "array<struct<kind:int,start:bigint,end:bigint,entity:bigint>>"


def _holders(raw: np.ndarray, at: np.ndarray):
    """(row, entities in code points, hashes of the words outside them, marks) of each text of a block that has an entity."""
    data, start = _joined(raw, at)
    found = base_spans(data.tobytes())
    if not found:
        return
    ends = np.append(start[1:], len(data))
    point = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])
    row = np.searchsorted(start, np.array([f[0] for f in found]), "right") - 1
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])).tolist()  # entities are in order of their rows
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        r, own = int(row[lo]), found[lo:hi]
        s, e = int(start[r]), int(ends[r])
        w = K.words(data[s:e], np.array([0, e - s]), MEMBER)
        ws, we = w.start + s, w.end + s
        free = np.ones(len(ws), bool)
        for a, b, _, _ in own:
            free[np.searchsorted(we, a, "right") : np.searchsorted(ws, b, "left")] = False
        h = w.hash[free]
        pairs = K.windows(h, 2) if len(h) > 1 else K.sequence_hash(h, np.array([0, len(h)]))
        marks = {c: int(K.mix(pairs + np.uint64(i)).min().view(np.int64)) for i, c in enumerate(MARKS)}
        mentions = []
        for a, b, kind, value in own:
            entity = int.from_bytes(blake2b(bytes([kind]) + value, digest_size=8).digest(), "little", signed=True)
            mentions.append({"kind": kind, "start": int(point[a] - point[s]), "end": int(point[b] - point[s]), "entity": entity})
        yield r, mentions, h, marks


def _mentions(batches):
    """(id, key, mentions, marks) of every document; offsets are code points, and only documents with mentions have marks."""
    for batch in batches:
        raw, offsets = K.text_bytes(batch.column("text"))
        for lo, hi in K.blocks(offsets):
            at = offsets[lo : hi + 1]
            out: list[list[dict]] = [[] for _ in range(hi - lo)]
            marks: list[list[int]] = [[] for _ in range(hi - lo)]
            for r, mentions, _, own in _holders(raw[at[0] : at[-1]], at):
                out[r] = mentions
                marks[r] = list(own.values())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo), pa.array(out, pa.list_(_MENTION)), pa.array(marks, pa.list_(pa.int64()))], ["id", "key", "mentions", "marks"])


def _often(frequent, h: np.ndarray) -> np.ndarray:
    """Documents of each term as far as ``frequent`` (sorted terms, and their counts) tells; 0 for others."""
    terms, n = frequent.value
    if not len(terms):
        return np.zeros(len(h))
    ix = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[ix] == h, n[ix], 0)


def _most(n: int, total: int, threshold: float) -> float:
    """Documents that a term revealing an entity of n documents can have, as at most n of them are the entity's."""
    return n * (total / n) ** (1 - threshold) * (1 + 1e-9)


def _kind_terms(frequent, counts: dict[int, int], total: int, threshold: float):
    """(kind, value, term): each kind of entity in a document with each distinct word outside entities that can reveal it."""

    def work(batches):
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column("text"))
            for lo, hi in K.blocks(offsets):
                at = offsets[lo : hi + 1]
                out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
                for _, mentions, words, _ in _holders(raw[at[0] : at[-1]], at):
                    h = np.unique(words.view(np.int64))
                    often = _often(frequent, h)
                    for kind in {m["kind"] for m in mentions}:
                        mine = h[often <= _most(counts[kind], total, threshold)]
                        value = min(m["entity"] for m in mentions if m["kind"] == kind)
                        out.append((np.full(len(mine), kind), np.full(len(mine), value), mine))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["kind", "value", "term"])

    return work


def _known_words(known):
    """(id, key, term, start, end) of every word that ``known`` may hold; offsets are code points."""

    def work(batches):
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column("text"))
            for lo, hi in K.blocks(offsets):
                at = offsets[lo : hi + 1]
                block = raw[at[0] : at[-1]]
                w = K.words(block, at, MEMBER)
                keep = K.bloom_has(known.value, w.hash.view(np.int64))
                row = w.row[keep]
                point = np.zeros(len(block) + 1, np.int64)
                np.cumsum((block & 0xC0) != 0x80, out=point[1:])
                base = point[at[:-1] - at[0]][row]
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("key").take(take), pa.array(w.hash[keep].view(np.int64)), pa.array(point[w.start[keep]] - base), pa.array(point[w.end[keep]] - base)], ["id", "key", "term", "start", "end"])

    return work


def _document_terms(frequent, total: int, threshold: float):
    """(id, key, entity, the marks of the document, term): each known entity of a document with each distinct word outside entities that can reveal it."""

    def work(batches):
        for batch in batches:
            entities_of, spans_of = (batch.column(c).to_pylist() for c in ("entities", "spans"))
            raw, offsets = K.text_bytes(batch.column("text"))
            for r in range(batch.num_rows):
                w = K.words(raw[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]), MEMBER)
                point = np.zeros(offsets[r + 1] - offsets[r] + 1, np.int64)
                np.cumsum((raw[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80, out=point[1:])
                ws, we, free = point[w.start], point[w.end], np.ones(len(w.hash), bool)
                for x in spans_of[r]:
                    free[np.searchsorted(we, x["start"], "right") : np.searchsorted(ws, x["end"], "left")] = False
                h = np.unique(w.hash[free].view(np.int64))
                often = _often(frequent, h)
                for e in entities_of[r]:
                    mine = h[often <= _most(e["n_entity"], total, threshold)]
                    at = pa.array(np.full(len(mine), r))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("key").take(at), *[pa.array(np.full(len(mine), e[c], np.int64)) for c in ("entity", *MARKS)], pa.array(mine)], ["id", "key", "entity", *MARKS, "term"])

    return work


def _document_counts():
    def work(batches):
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column("text"))
            for lo, hi in K.blocks(offsets):
                at = offsets[lo : hi + 1]
                w = K.words(raw[at[0] : at[-1]], at, MEMBER)
                _, pick = np.unique(K.mix(w.hash ^ K.mix(w.row.astype(np.uint64))), return_index=True)
                term, n = np.unique(w.hash[pick], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return work


def _separate():
    """How many of a group's documents but one are separate, at most: mean different values of a mark, less one, over APART."""
    return ((sum((F.count_distinct(c) for c in MARKS), F.lit(0)) / len(MARKS) - 1) / APART + 1e-9).alias("separate")


def _revealing_kinds(rows: DataFrame, table: DataFrame, term_docs: DataFrame, frequent, total: int, threshold: float) -> DataFrame:
    """(term) that reveal a kind of entity."""
    kinds = table.select(F.explode(F.array_distinct(F.transform("mentions", lambda m: m["kind"]))).alias("kind")).groupBy("kind").count()
    counts = {r["kind"]: r["count"] for r in kinds.collect()}  # at most as many rows as kinds
    if not counts:
        return term_docs.select("term").where(F.lit(False))
    types = term_docs.count()
    met = rows.select("text").mapInArrow(_kind_terms(frequent, counts, total, threshold), "kind long, value long, term long")
    pairs = met.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n_both"), F.count_distinct("value").alias("values")).join(term_docs, "term")
    known = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n / total)) for k, n in sorted(counts.items())])
    pairs = pairs.withColumns({"p": known, "q": F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))}).where("p < 1 and q > p")
    rest = F.when(F.col("q") < 1, (1 - F.col("q")) * F.log2((1 - F.col("q")) / (1 - F.col("p")))).otherwise(F.lit(0.0))
    bits = F.col("values") / F.col("q") * (F.col("q") * F.log2(F.col("q") / F.col("p")) + rest)
    disclosure = 1 - F.log2("q") / F.log2("p")
    return pairs.where((disclosure >= threshold) & (bits >= log2(types * len(counts) / CHANCE))).select("term")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """One row per document: id, key, spans: array of (start, kind, end) in order, with kind an index into KINDS."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), row_key(text).alias("key"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    table = stage(rows.mapInArrow(_mentions, f"id {kind}, key long, mentions {MENTIONS}, marks array<long>"), "pii-mentions")
    total = table.count()
    values = F.explode(F.array_distinct(F.transform("mentions", lambda m: m["entity"]))).alias("entity")
    mentions = table.select("id", "key", values, *[F.get("marks", F.lit(i)).alias(c) for i, c in enumerate(MARKS)]).distinct()
    entities = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), _separate())
    entities = stage(entities.where(F.col("separate") >= support - 1).drop("separate"), "pii-entities")  # the others have no term of that support
    per_row = mentions.join(entities, "entity").groupBy("id", "key").agg(F.collect_list(F.struct("entity", "n_entity", *MARKS)).alias("entities"))
    spans = F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("spans")
    per_row = per_row.withColumnsRenamed({"id": "of", "key": "of_key"}).join(table.select("id", "key", spans).dropDuplicates(["id", "key"]), F.col("of").eqNullSafe(F.col("id")) & (F.col("of_key") == F.col("key"))).drop("id", "key")
    per_row = stage(per_row, "pii-entities")
    some = sc.broadcast(K.bloom(per_row.select("of_key")))  # texts travel only for documents that hold such an entity

    def holding(batches):
        for batch in batches:
            yield batch.filter(pa.array(K.bloom_has(some.value, batch.column("key").to_numpy(zero_copy_only=False))))

    holders = rows.mapInArrow(holding, rows.schema).dropDuplicates(["id", "key"]).join(per_row, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))).drop("of", "of_key")
    term_docs = stage(rows.select("text").mapInArrow(_document_counts(), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term")), "pii-terms")
    top = term_docs.orderBy(F.desc("n_term"), "term").limit(FREQUENT).toArrow().sort_by("term")
    frequent = sc.broadcast((top.column("term").to_numpy(), top.column("n_term").to_numpy()))
    met = holders.mapInArrow(_document_terms(frequent, total, threshold), f"id {kind}, key long, entity long, {', '.join(c + ' long' for c in MARKS)}, term long")
    pairs = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), _separate())
    pairs = pairs.where((F.col("separate") >= support - 1) & (F.col("separate") >= F.col("n_both") - 1))
    pairs = pairs.join(entities, "entity").join(term_docs, "term")
    carried = F.log2(F.lit(float(total)) / F.col("n_entity"))
    disclosure = F.when(carried > 0, 1 + F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))) / carried).otherwise(F.lit(0.0))
    revealing = pairs.where(disclosure >= threshold).select("term").unionByName(_revealing_kinds(rows, table, term_docs, frequent, total, threshold))
    revealing = stage(revealing.distinct(), "pii-revealing")
    words = rows.mapInArrow(_known_words(sc.broadcast(K.bloom(revealing))), f"id {kind}, key long, term long, start long, end long")
    extra = words.join(revealing, "term", "left_semi").select("id", "key", F.struct("start", F.lit(TERM).alias("kind"), "end").alias("span")).distinct()
    extra = extra.groupBy(F.col("id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_list("span").alias("more"))
    joined = table.join(extra, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    clear = lambda x: ~F.exists("mentions", lambda m: (m["start"] < x["end"]) & (x["start"] < m["end"]))
    base = F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    more = F.coalesce(F.filter("more", clear), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return joined.select("id", "key", F.sort_array(F.concat(base, more)).alias("spans"))


def sanitise(docs: DataFrame, how: str = "generalise", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span replaced by ``<KIND>`` (how="generalise") or by nothing (how="remove")."""
    if how not in ("generalise", "remove"):
        raise ValueError("how is 'generalise' or 'remove'")
    found = find(docs, id_col, text_col, **options).where("size(spans) > 0").dropDuplicates(["id", "key"]).select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (row_key(F.col(text_col)) == F.col("__key")), "left")
    names = F.array(*[F.lit(f"<{k.upper()}>" if how == "generalise" else "") for k in KINDS])
    text = F.col(text_col)
    done = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.when(x["start"] < s["to"], s).otherwise(
        F.struct(F.concat(s["out"], F.substr(text, (s["to"] + 1).cast("int"), (x["start"] - s["to"]).cast("int")), F.element_at(names, x["kind"] + 1)).alias("out"), x["end"].alias("to"))
    )
    cut = F.aggregate("__spans", done, step, lambda s: F.concat(s["out"], F.substr(text, (s["to"] + 1).cast("int"), F.length(text)))) 
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(cut)).drop("__id", "__key", "__spans")
