"""Language-model scores by Katz back-off over trigrams (or, with order 2, bigrams).

p(w | u v) = d_r * r / (c(u v) + 1) for a trigram seen r times in training, where d_r is the Good-Turing discount of its order (r <= 5; 1
beyond), and otherwise alpha(u v) * p(w | v), with alpha the mass that the discounts leave, one pseudo-count included, over the
probability, by the next lower order, of all words not seen after u v: every history sums to 1 exactly. p(w | v) is made in the same way of bigrams and
p(w), and the recursion ends at p(w) = (c(w) + 1) / (N + V + 1), of which one share is that of all unknown words. A history that
training lacks backs off with weight 1. A text is its words and an end token; the first word's history is a start token alone.

Execution: the most frequent words in training (at most 2**19 of them, so their table is broadcast) are told by
rank, all others by hash. An occurrence (word before the last, last word, word, document) is shuffled once to the partition of the last word before it,
packed by blocks of text; one whose word is rare goes by the partition of the word first, where its count is looked
up. A partition then has the bigrams after its words and the trigrams over them: counts of counts are summed over all partitions, and the same exchange
is read again to score, so what is shuffled and held grows in proportion to the input and nothing but the frequent words is
broadcast. A word with more occurrences than ``GROUP`` is split by the word before it (the start token: by the word after it), so that the trigrams of a history
stay together; its bigrams, counted per split, are summed by (word, next word), and their probabilities go back to the splits.

Blocks of documents have a number made of their rows, by which the shares that partitions return, packed as well, meet the documents again; a block that
gets none (an input that isn't the same when read twice) is an error.

Nulls are empty texts, of the end token alone. Repeated rows are scored each. Without training
rows all words are unknown.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm import kernel as K
from graphlake.llm.text import row_key
from graphlake.plans.staging import stage

FREQUENT_BITS = 19
GROUP = 750_000  # occurrences in a partition, about
K_MAX = 5  # counts above are not discounted
START = 1 << FREQUENT_BITS
RARE = np.uint64(1 << 63)
END = np.uint64(0x5851F42D4C957F2D)

#: Kinds of what is packed. An occurrence's document is its row in its block, with the highest bit for one held out.
OCCURRENCE = ("<u8", "<u8", "<u8", "<u4", "<u2", "<u2")  # last word, word, word before the last, the word's count if it is rare, document, place of its block in the row's list
PARTIAL = ("<u8", "<u4", "<i8")  # word, its count if it is rare, times in training after a split word
GIVEN = ("<u8", "<f8")  # word, probability after a split word
SHARE = ("<u2", "<f8")  # document, score
BASE_SHARE = ("<u2", "<f8", "<u2")  # document, base score, known words
HELD = 1 << 15
BLOCK = 4 * K.BLOCK_BYTES
FLUSH = 1_500_000  # occurrences of many blocks that a task packs together


def pack(kinds: tuple, *arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes; the first is in order and kept as steps."""
    first = arrays[0].astype(kinds[0])
    step = first.copy()
    step[1:] -= first[:-1]
    planes = [np.ascontiguousarray(x.astype(k).view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"" for x, k in zip([step, *arrays[1:]], kinds, strict=True)]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(kinds: tuple, data: pa.Buffer, n: int) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(k).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


class Vocabulary:
    """Frequent words by rank, with their counts; totals of the training set; the splits of hot histories."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, types: int, texts: int, order: int):
        self.order = order
        by = np.lexsort((words, -counts))
        self.counts = np.append(counts[by], texts).astype(np.int64)  # START comes last
        rank = np.empty(len(words), np.int64)
        rank[by] = np.arange(len(words))
        order = np.argsort(words)
        self.words, self.rank = words[order], rank[order].astype(np.uint64)
        self.slots: np.ndarray | None = None
        self.tokens, self.types = tokens, types
        self.groups = max(1, -(-tokens // GROUP))
        splits = -(-self.counts // GROUP)
        self.splits = np.where(self.counts > GROUP // 2, splits, 0)  # 0: not hot
        self.first = self.groups + np.cumsum(self.splits) - self.splits

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return hashes | RARE
        bits = len(self.words).bit_length()
        shift, last = np.uint64(64 - bits), len(self.words) - 1
        if self.slots is None:  # the first word of each range of hashes, which has one on average at most
            self.slots = np.minimum(np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << shift), last).astype(np.int32)
        ix = self.slots[hashes >> shift]
        behind = np.flatnonzero(self.words[ix] < hashes)
        while len(behind := behind[ix[behind] < last]):
            ix[behind] += 1
            behind = behind[self.words[ix[behind]] < hashes[behind]]
        return np.where(self.words[ix] == hashes, self.rank[ix], hashes | RARE)

    def index(self, codes: np.ndarray) -> np.ndarray:
        """Place in ``counts`` of codes that are not rare."""
        return np.where(codes == START, len(self.counts) - 1, codes.astype(np.int64))

    def count(self, codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        known = (codes & RARE) == 0
        return np.where(known, self.counts[self.index(np.where(known, codes, np.uint64(START)))], rare)

    def buckets(self, h: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        known = (h & RARE) == 0
        at = self.index(np.where(known, h, np.uint64(START)))
        hot = known & (self.splits[at] > 0)
        plain = (K.mix(h) % np.uint64(self.groups)).astype(np.int64)
        by = np.where((h == START) | (self.order == 2), w, u)
        return np.where(hot, self.first[at] + (K.mix(by) % np.maximum(self.splits[at], 1).astype(np.uint64)).astype(np.int64), plain)

    def owner(self, bucket: int) -> int | None:
        """Place in ``counts`` of the word that a bucket has one of several splits of."""
        if bucket < self.groups:
            return None
        hot = np.flatnonzero(self.splits)
        own = int(hot[np.searchsorted(self.first[hot], bucket, "right") - 1])
        return own if self.splits[own] > 1 else None

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.tokens + self.types + 1.0)


def _token_hashes(raw, at):
    """(hash of every token, its row, first token of each row): the words of each row and an end."""
    w = K.words(raw, at)
    rows = len(at) - 1
    n = np.diff(w.first) + 1
    first = np.append(0, np.cumsum(n))
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(w.hash)) + w.row] = w.hash
    return out, np.repeat(np.arange(rows), n), first


def _counts(batches):
    """(word, n) of a partition's training rows, merged as they come."""
    words, counts, pending = np.empty(0, np.uint64), np.empty(0, np.int64), []

    def merged():
        every = [words, *[p[0] for p in pending]]
        w, inverse = np.unique(np.concatenate(every), return_inverse=True)
        return w, np.bincount(inverse, np.concatenate([counts, *[p[1] for p in pending]]), len(w)).astype(np.int64)

    for batch in batches:
        raw, offsets = K.text_bytes(batch.column("text"))
        for lo, hi in K.blocks(offsets):
            at = offsets[lo : hi + 1]
            pending.append(np.unique(_token_hashes(raw[at[0] : at[-1]], at)[0], return_counts=True))
            if sum(len(p[0]) for p in pending) > max(1_000_000, len(words)):
                words, counts = merged()
                pending = []
                if len(words) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])
                    words, counts = words[:0], counts[:0]
    if pending or len(words):
        words, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])


def _least_frequent(table: DataFrame, most: int) -> int:
    """The least count, to a sixteenth of its power of two, that no more than ``most`` words reach."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    bins = sorted(((int(r["b"]), r["k"], r["low"]) for r in table.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).collect()), reverse=True)  # at most 1,024 rows
    total, least = 0, 1 << 62
    for _, k, low in bins:
        total += k
        if total > most:
            break
        least = low
    return least


def fit_vocabulary(train: DataFrame, order: int = 2) -> tuple[DataFrame, Vocabulary]:
    """The staged table (word, n) of all training words, and the frequent ones with the totals."""
    table = stage(train.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "katz-words")
    end = int(END.astype(np.int64))
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types"), F.coalesce(F.max(F.when(F.col("word") == end, F.col("n"))), F.lit(0)).alias("texts")).first()
    least = _least_frequent(table, 1 << FREQUENT_BITS)
    frequent = table.where(F.col("n") >= least).toArrow()  # at most 2**FREQUENT_BITS rows
    v = Vocabulary(frequent.column("word").to_numpy().astype(np.int64).view(np.uint64), frequent.column("n").to_numpy().astype(np.int64), totals["tokens"], totals["types"], totals["texts"], order)
    return table.where(F.col("n") < least), v


PACKED = "bucket long, blocks array<long>, n int, data binary"
_PACKED = pa.schema([("bucket", pa.int64()), ("blocks", pa.list_(pa.int64())), ("n", pa.int32()), ("data", pa.binary())])
SHARES = "block long, kind int, n int, data binary"
_SHARES = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def _near(codes: np.ndarray) -> np.ndarray:
    """20 bits that put equal codes together: ranks as they are, of rare codes the highest bits."""
    return np.where(codes & RARE, np.uint64(START) | (codes & ~RARE) >> np.uint64(44), codes)


def _by_bucket(blocks: np.ndarray, bucket, h, w, u, c, d, b) -> pa.RecordBatch:
    """Packed rows (bucket, blocks, n, data) of occurrences; ``b`` is the place of an occurrence's block in ``blocks``."""
    out: dict = {"bucket": [], "blocks": [], "n": [], "data": []}
    order = np.argsort(bucket.astype(np.uint64) << np.uint64(40) | _near(h) << np.uint64(20) | _near(w))  # one key sorts far faster than three
    bucket, h, w, u, c, d, b = (x[order] for x in (bucket, h, w, u, c, d, b))
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        for at in range(lo, hi, 1 << 16):  # a row's list of blocks has 16-bit places
            to = min(hi, at + (1 << 16))
            held, own = np.unique(b[at:to], return_inverse=True)
            for k, x in (("bucket", int(bucket[at])), ("blocks", blocks[held].tolist()), ("n", to - at), ("data", pack(OCCURRENCE, h[at:to], w[at:to], u[at:to], c[at:to], d[at:to], own))):
                out[k].append(x)
    return pa.RecordBatch.from_pydict(out, _PACKED)


def _blocks(batch: pa.RecordBatch):
    """(rows, block number, token hashes, row of each, first token of each row) of a batch's blocks; the number is a hash of the rows' own."""
    raw, offsets = K.text_bytes(batch.column("text"))
    rids = batch.column("rid").to_numpy().view(np.uint64)
    for lo, hi in K.blocks(offsets, BLOCK):
        at = offsets[lo : hi + 1]
        number = int(K.sequence_hash(rids[lo:hi], np.array([0, hi - lo]), 5).view(np.int64)[0])
        yield lo, hi, number, *_token_hashes(raw[at[0] : at[-1]], at)


def _occurrences(vocabulary, rare: bool, word_groups: int):
    """Packed occurrences of frequent words by bucket of the history, or of rare ones by bucket of the word."""

    def work(batches):
        v = K.opened(vocabulary)
        numbers: list[int] = []
        parts: list[tuple] = []

        def packed():
            return _by_bucket(np.array(numbers), *[np.concatenate(x) for x in zip(*parts, strict=True)])

        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for lo, hi, number, hashes, row, first in _blocks(batch):
                w = v.codes(hashes)
                h = np.concatenate([[np.uint64(START)], w[:-1]])
                h[first[:-1]] = START
                if v.order == 3:
                    u = np.concatenate([[np.uint64(START)], h[:-1]])
                    u[first[:-1]] = START
                else:
                    u = np.zeros(len(h), np.uint64)
                mine = ((w & RARE) != 0) == rare
                h, w, u, row = h[mine], w[mine], u[mine], row[mine]
                bucket = (K.mix(w) % np.uint64(word_groups)).astype(np.int64) if rare else v.buckets(h, w, u)
                parts.append((bucket, h, w, u, np.zeros(len(h), np.uint32), (row + HELD * held[lo:hi][row]).astype(np.uint16), np.full(len(h), len(numbers), np.int32)))
                numbers.append(number)
                if sum(len(p[0]) for p in parts) > FLUSH:
                    yield packed()
                    numbers, parts = [], []
        if parts:
            yield packed()

    return work


def _documents(vocabulary):
    """(id, held, block, row, tokens, base, known): every document, with the base score of its frequent words."""

    def work(batches):
        v = K.opened(vocabulary)
        for batch in batches:
            for lo, hi, number, hashes, row, first in _blocks(batch):
                w = v.codes(hashes)
                frequent = (w & RARE) == 0
                base = np.where(frequent, np.log10(v.unigram(v.count(w, np.zeros(len(w), np.int64)))), 0.0)
                n = hi - lo
                columns = [batch.column("id").slice(lo, n), batch.column("held").slice(lo, n), pa.array(np.full(n, number)), pa.array(np.arange(n)), pa.array(np.diff(first)), pa.array(np.bincount(row, base, n)), pa.array(np.bincount(row, frequent, n).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "held", "block", "row", "tokens", "base", "known"])

    return work


def _gather(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All occurrences of a group, and its blocks' numbers; ``d`` is 2**16 times the place of the block plus the document."""
    lists = [np.array(x, np.int64) for x in table.column("blocks").to_pylist()]
    blocks = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)
    parts = [unpack(OCCURRENCE, data.as_buffer(), n) for data, n in zip(table.column("data"), table.column("n").to_pylist(), strict=True)]
    out = {k: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, (k, t) in enumerate(zip("hwuc", OCCURRENCE[:4], strict=True))}
    out["d"] = np.concatenate([p[4].astype(np.int64) + (np.searchsorted(blocks, x)[p[5]] << 16) for p, x in zip(parts, lists, strict=True)]) if parts else np.empty(0, np.int64)
    return out, blocks


def _to_blocks(d: np.ndarray, blocks: np.ndarray, kind: int, kinds: tuple, *values: np.ndarray) -> pa.Table:
    """Packed rows (block, kind, n, data) of sums by document."""
    docs, inverse = np.unique(d & ~HELD, return_inverse=True)
    sums = [np.bincount(inverse, x, len(docs)) for x in values]
    place = docs >> 16
    out: dict = {"block": [], "kind": [], "n": [], "data": []}
    cut = np.searchsorted(place, np.arange(len(blocks) + 1))
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            for k, x in (("block", int(blocks[i])), ("kind", kind), ("n", b - a), ("data", pack(kinds, docs[a:b] & (HELD - 1), *[x[a:b] for x in sums]))):
                out[k].append(x)
    return pa.Table.from_pydict(out, _SHARES)


def _look_up(vocabulary, base: bool):
    """Occurrences of rare words with the words' counts, by bucket of the history; or with ``base`` these words' shares in base scores."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        v = K.opened(vocabulary)
        o, blocks = _gather(left)
        words = right.column("word").to_numpy().view(np.uint64) | RARE
        order = np.argsort(words)
        words, counts = words[order], right.column("n").to_numpy()[order]
        if len(words):
            ix = np.minimum(np.searchsorted(words, o["w"]), len(words) - 1)
            c = np.where(words[ix] == o["w"], counts[ix], 0)
        else:
            c = np.zeros(len(o["w"]), np.int64)
        if base:
            return _to_blocks(o["d"], blocks, 1, BASE_SHARE, np.log10(v.unigram(c)), (c > 0).astype(float))
        batch = _by_bucket(blocks, v.buckets(o["h"], o["w"], o["u"]), o["h"], o["w"], o["u"], c, o["d"] & 0xFFFF, o["d"] >> 16)
        return pa.Table.from_batches([batch], _PACKED)

    return work


def _dense(codes: np.ndarray) -> np.ndarray:
    """The codes in the same order as numbers below 2**32: ranks as they are, the rare ones by their place among a group's."""
    out, rare = codes.copy(), np.flatnonzero(codes & RARE)
    out[rare] = np.uint64(START + 1) + np.unique(codes[rare], return_inverse=True)[1].astype(np.uint64)
    return out


class Grams:
    """The bigram table of a group: distinct (history, word), their counts in training, and sums by history."""

    def __init__(self, o: dict[str, np.ndarray], v: Vocabulary):
        n = len(o["h"])
        self.order = order = np.argsort(_dense(o["h"]) << np.uint64(32) | _dense(o["w"]))
        h, w = o["h"][order], o["w"][order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]]) if n else np.empty(0, bool)
        new = new_h | np.concatenate([[True], w[1:] != w[:-1]]) if n else new_h
        gram = np.cumsum(new) - 1
        train = (o["d"][order] & HELD) == 0
        self.times = np.bincount(gram, train, gram[-1] + 1 if n else 0).astype(np.int64)  # r of each bigram
        self.gram = np.empty(n, np.int64)
        self.gram[order] = gram
        head = np.flatnonzero(new)
        self.history = (np.cumsum(new_h) - 1)[head] if n else gram  # of each bigram
        self.codes = h[np.flatnonzero(new_h)]
        self.words, self.rare = w[head], o["c"][order][head]
        self.p = v.unigram(v.count(self.words, self.rare.astype(np.int64)))
        self.total = v.count(self.codes, np.bincount(self.history, self.times, len(self.codes)).astype(np.int64))  # c(h)


def _probabilities(times, history, total, lower, d) -> np.ndarray:
    """Katz probabilities of distinct n-grams from their counts, their histories (by place in ``total``) and the next lower order's probabilities."""
    n, seen = len(total), times > 0
    kept = np.where(times <= K_MAX, d[np.minimum(np.maximum(times, 1), K_MAX) - 1], 1.0)
    left_over = 1 + np.bincount(history, (1 - kept) * times, n)
    alpha = np.where(total > 0, left_over / ((total + 1.0) * np.maximum(1 - np.bincount(history, lower * seen, n), 1e-300)), 1.0)
    return np.where(seen, kept * times / (total[history] + 1.0), alpha[history] * lower)


def _trigrams(o: dict[str, np.ndarray], g: Grams) -> tuple[np.ndarray, ...]:
    """(occurrences, trigram of each, r of each trigram, its history, its bigram); the first words of texts have no trigram."""
    by = g.order[o["h"][g.order] != START]
    x = K.mix(K.mix(o["u"][by] + np.uint64(1)) + o["h"][by])  # a history
    by, x = by[at := np.argsort(x, kind="stable")], x[at]  # by history, then bigram
    gram = g.gram[by]
    n = len(by)
    new_x = np.concatenate([[True], x[1:] != x[:-1]]) if n else np.empty(0, bool)
    new = new_x | np.concatenate([[True], gram[1:] != gram[:-1]]) if n else new_x
    own = np.cumsum(new) - 1
    times = np.bincount(own, (o["d"][by] & HELD) == 0, own[-1] + 1 if n else 0).astype(np.int64)
    head = np.flatnonzero(new)
    return by, own, times, (np.cumsum(new_x) - 1)[head] if n else own, gram[head]


def _counts_of_counts(times: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(times, K_MAX + 2), minlength=K_MAX + 3)[1 : K_MAX + 2].tolist()


RANGE = range(1, K_MAX + 2)
STATS = "owner long, " + ", ".join(f"{k}{r} long" for k in "nt" for r in RANGE) + ", mass double"  # n: of bigrams, t: of trigrams


def _stats_table(rows: list[list]) -> pa.Table:
    names = [x.split()[0] for x in STATS.split(", ")]
    return pa.table({k: pa.array([r[i] for r in rows], pa.float64() if k == "mass" else pa.int64()) for i, k in enumerate(names)})


def _statistics(vocabulary):
    """Counts of counts of a group (owner -1); of a split word's bigrams ``_split_sums`` has them."""

    def work(table: pa.Table) -> pa.Table:
        v = K.opened(vocabulary)
        o, _ = _gather(table)
        g = Grams(o, v)
        none = [0] * len(RANGE)
        bigrams = none if v.owner(table.column("bucket")[0].as_py()) is not None else _counts_of_counts(g.times)
        return _stats_table([[-1, *bigrams, *(_counts_of_counts(_trigrams(o, g)[2]) if v.order == 3 else none), 0.0]])

    return work


PARTIALS = "owner long, part long, bucket long, n int, data binary"
_PARTIALS = pa.schema([("owner", pa.int64()), ("part", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])


def _split_bigrams(vocabulary):
    """Packed bigrams of a split of a word, with their counts there, by parts of the words after it."""

    def work(table: pa.Table) -> pa.Table:
        v = K.opened(vocabulary)
        bucket = table.column("bucket")[0].as_py()
        owner = v.owner(bucket)
        if owner is None:
            return _PARTIALS.empty_table()
        g = Grams(_gather(table)[0], v)
        part = K.mix(g.words) % np.uint64(v.splits[owner])
        rows = [(owner, int(k), bucket, int(np.count_nonzero(mine := part == k)), pack(PARTIAL, g.words[mine], g.rare[mine], g.times[mine])) for k in np.unique(part)]
        return pa.Table.from_pylist([dict(zip(_PARTIALS.names, r, strict=True)) for r in rows], _PARTIALS)

    return work


def _split_part(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(words, rare counts, times, each split's words) of a part of a split word's bigrams."""
    lists = [unpack(PARTIAL, data.as_buffer(), n) for data, n in zip(table.column("data"), table.column("n").to_pylist(), strict=True)]
    words, head, own = np.unique(np.concatenate([x[0] for x in lists]), return_index=True, return_inverse=True)
    times = np.bincount(own, np.concatenate([x[2] for x in lists]), len(words)).astype(np.int64)
    return words, np.concatenate([x[1] for x in lists])[head].astype(np.int64), times, [x[0] for x in lists]


def _split_sums(vocabulary):
    def work(table: pa.Table) -> pa.Table:
        v = K.opened(vocabulary)
        words, rare, times, _ = _split_part(table)
        return _stats_table([[table.column("owner")[0].as_py(), *_counts_of_counts(times), *[0] * len(RANGE), float(v.unigram(v.count(words, rare))[times > 0].sum())]])

    return work


RULES = "bucket long, " + ", ".join(f"{k}{r} long" for k in "nt" for r in RANGE) + ", n int, data binary"
_RULES = pa.schema([("bucket", pa.int64()), *[(f"{k}{r}", pa.int64()) for k in "nt" for r in RANGE], ("n", pa.int32()), ("data", pa.binary())])


def _split_given(vocabulary):
    """The probabilities of a part of a split word's bigrams, for each of its splits."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RULES.empty_table()
        v = K.opened(vocabulary)
        words, rare, times, lists = _split_part(left)
        rule = right.to_pylist()[0]
        d = discounts([rule[f"all{r}"] for r in RANGE])
        total = v.counts[left.column("owner")[0].as_py()]
        left_over = 1 + sum((1 - d[r - 1]) * r * rule[f"n{r}"] for r in range(1, K_MAX + 1))
        alpha = left_over / ((total + 1.0) * max(1 - rule["mass"], 1e-300)) if total > 0 else 1.0
        kept = np.where(times <= K_MAX, d[np.minimum(np.maximum(times, 1), K_MAX) - 1], 1.0)
        p = np.where(times > 0, kept * times / (total + 1.0), alpha * v.unigram(v.count(words, rare)))
        rows = [{"bucket": b, "n": len(w), "data": pack(GIVEN, w, p[np.searchsorted(words, w)])} for b, w in zip(left.column("bucket").to_pylist(), lists, strict=True)]
        return pa.Table.from_pylist(rows, _RULES)

    return work


def discounts(counts: list[int]) -> np.ndarray:
    """d_1 .. d_5 from the counts of counts n_1 .. n_6; 1 where the estimate makes no sense."""
    n = [float(x) for x in counts]
    out = np.ones(K_MAX)
    if n[0] <= 0:
        return out
    far = (K_MAX + 1) * n[K_MAX] / n[0]
    for r in range(1, K_MAX + 1):
        if n[r - 1] > 0 and far < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - far) / (1 - far)
            if 0 < d < 1:
                out[r - 1] = d
    return out


def _scores(vocabulary):
    """A group's shares in the documents' scores."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        v = K.opened(vocabulary)
        o, blocks = _gather(left)
        if not len(o["h"]):
            return _SHARES.empty_table()
        g = Grams(o, v)
        rows = right.to_pylist()
        rule = next(x for x in rows if x["data"] is None)
        if v.owner(left.column("bucket")[0].as_py()) is None:
            p = _probabilities(g.times, g.history, g.total, g.p, discounts([rule[f"n{r}"] or 0 for r in RANGE]))
        else:
            given = [unpack(GIVEN, pa.py_buffer(x["data"]), x["n"]) for x in rows if x["data"] is not None]
            words, p = (np.concatenate(x) for x in zip(*given, strict=True))
            words, p = words[at := np.argsort(words)], p[at]
            if not np.array_equal(words, g.words):
                raise ValueError("a split without its bigrams: the input was not read twice alike")
        out = np.log10(p)[g.gram]
        if v.order == 3:
            by, own, times, history, gram = _trigrams(o, g)
            total = np.bincount(history, times, history[-1] + 1 if len(history) else 0).astype(np.int64)
            out[by] = np.log10(_probabilities(times, history, total, p[gram], discounts([rule[f"t{r}"] or 0 for r in RANGE])))[own]
        return _to_blocks(o["d"], blocks, 0, SHARE, out)

    return work


def _totals(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the sums of their shares."""
    n = left.num_rows
    size = (max(left.column("row").to_pylist()) + 1) if n else 0
    score, base, known = np.zeros(size), np.zeros(size), np.zeros(size)
    for kind, k, data in zip(right.column("kind").to_pylist(), right.column("n").to_pylist(), right.column("data"), strict=True):
        got = unpack(BASE_SHARE if kind else SHARE, data.as_buffer(), k)
        if kind:
            base[got[0]] += got[1]
            known[got[0]] += got[2]
        else:
            score[got[0]] += got[1]
    if n and not score.any():
        raise ValueError("a block of documents without shares: the input was not read twice alike")
    row = left.column("row").to_numpy()
    times = max(int(np.count_nonzero(row == 0)), 1)  # blocks of the same rows throughout have one number and equal shares
    score, base, known = score / times, base / times, known / times
    return pa.table(
        {
            "id": left.column("id"),
            "held_out": left.column("held"),
            "n_tokens": left.column("tokens"),
            "n_known": pa.array(left.column("known").to_numpy() + known[row].astype(np.int64)),
            "base_score": pa.array(left.column("base").to_numpy() + base[row]),
            "score": pa.array(score[row]),
        }
    )


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from rows not held out; ``order`` is 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.xxhash64(F.col(id_col), row_key(text)).alias("rid"), text.alias("text"))
    rare_words, v = fit_vocabulary(rows.where("not held"), order)
    vocabulary = K.share(spark.sparkContext, v)
    word_groups = max(1, v.groups // 8)  # rare words are a small part
    frequent = rows.mapInArrow(_occurrences(vocabulary, False, word_groups), PACKED)
    rare = rows.mapInArrow(_occurrences(vocabulary, True, word_groups), PACKED).groupBy("bucket")
    # a table's words fall into the same groups as the codes of their occurrences
    mine = rare_words.mapInArrow(_word_groups(word_groups), "bucket long, word long, n long").groupBy("bucket")
    every = frequent.unionByName(rare.cogroup(mine).applyInArrow(_look_up(vocabulary, False), PACKED))
    stats = every.groupBy("bucket").applyInArrow(_statistics(vocabulary), STATS)
    hot = spark.createDataFrame([(int(v.first[i]), int(v.splits[i]), int(i)) for i in np.flatnonzero(v.splits).tolist()], "first long, splits long, owner long")  # a row for each hot word
    split = bool((v.splits > 1).any())
    if split:
        partials = every.groupBy("bucket").applyInArrow(_split_bigrams(vocabulary), PARTIALS)
        sums = partials.groupBy("owner", "part").applyInArrow(_split_sums(vocabulary), STATS)
        stats = stats.unionByName(sums)
    total = stats.agg(*[F.sum(f"{k}{r}").alias(f"{k}{r}") for k in "nt" for r in RANGE])
    parts = hot.select(F.explode(F.sequence("first", F.col("first") + F.col("splits") - 1)).alias("bucket"))
    groups = spark.range(v.groups).select(F.col("id").alias("bucket")).unionByName(parts)
    rules = groups.join(F.broadcast(total)).withColumns({"n": F.lit(None).cast("int"), "data": F.lit(None).cast("binary")})
    if split:
        own = sums.groupBy("owner").agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in RANGE], F.sum("mass").alias("mass"))
        every_part = hot.select("owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("part")).join(own, "owner")
        asked = every_part.join(F.broadcast(total.select(*[F.col(f"n{r}").alias(f"all{r}") for r in RANGE])))
        rules = rules.unionByName(partials.groupBy("owner", "part").cogroup(asked.groupBy("owner", "part")).applyInArrow(_split_given(vocabulary), RULES))
    shares = every.groupBy("bucket").cogroup(rules.groupBy("bucket")).applyInArrow(_scores(vocabulary), SHARES)
    shares = shares.unionByName(rare.cogroup(mine).applyInArrow(_look_up(vocabulary, True), SHARES))
    kind = rows.schema["id"].dataType.simpleString()
    own = rows.mapInArrow(_documents(vocabulary), f"id {kind}, held boolean, block long, row long, tokens long, base double, known long")
    out = own.groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(_totals, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(v.tokens)).cast("long"))


def _word_groups(groups: int):
    def work(batches):
        for batch in batches:
            code = batch.column("word").to_numpy().view(np.uint64) | RARE
            yield pa.RecordBatch.from_arrays([pa.array((K.mix(code) % np.uint64(groups)).astype(np.int64)), batch.column("word"), batch.column("n")], ["bucket", "word", "n"])

    return work
