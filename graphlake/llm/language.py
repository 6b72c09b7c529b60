"""Language identification by cross-parsing.

For each language a suffix automaton of a sample of labelled text recognises every substring of the sample. A text is
parsed greedily into the longest substrings the automaton knows; a phrase costs about the logarithm of the sample's length, and the
language with the fewest normalised phrases wins. Only letters and the breaks between them are
compared. Automata are dense tables over classes of bytes, and many stretches of text
step through all of them together, which are then joined into the parse of each whole text.

Only learning is bounded: ``pieces`` pieces of ``piece`` characters per language, of distinct documents, those of least hash, and at most
``MAX_LANGUAGES`` languages, which is checked. Every text is parsed whole.

A text that is null or has no letter is ``und`` with score 0, and so is every text when nothing was learned. Rows without a
language teach nothing. Equal counts go to the first language in code-point order.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm import kernel as K

MAX_LANGUAGES = 200
PIECES, PIECE = 16, 800
STRETCH = 2048
TEMPERATURE = 16.0


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased letters (A-Z and Latin-1), with one space for each run of anything else, and the new offsets."""
    offsets = offsets - offsets[0]
    if not len(raw):
        return raw, offsets
    letter = _LETTER[raw]
    out = np.where(letter, K.LOWER[raw], np.uint8(32))
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    out[after & (raw >= 0x80) & (raw <= 0x9E)] += 0x20
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    first = offsets[:-1][offsets[:-1] < len(raw)]
    keep[first] = letter[first]  # whatever the row before ends with
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Model:
    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        folded = {lang: letters(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for lang, x in samples.items()}
        used = sorted(set().union(*[set(x.tolist()) for x in folded.values()])) if samples else []
        self.classes = np.zeros(256, np.int32)  # class 0: bytes that no sample has
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        tables, self.base, size = [], [], 0
        for lang in self.languages:
            go = suffix_automaton(folded[lang].tobytes())
            table = np.zeros((len(go), self.width), np.int32)
            for s, edges in enumerate(go):
                for c, to in edges.items():
                    table[s, self.classes[c]] = size + to
            tables.append(table)
            self.base.append(size)
            size += len(go)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)  # 0: no transition; no edge leads to a root
        self.bits = np.array([log2(max(len(folded[lang]), 2)) for lang in self.languages])

    def phrases(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """rows x languages: phrases of each row's parse.

        Stretches are parsed side by side, each as if a phrase started where it does. A row's parse is that of its first stretch, which
        goes on into the next ones until it starts a phrase where theirs does too: from there on both are the same.
        """
        raw, offsets = letters(raw, offsets)
        rows, langs = len(offsets) - 1, len(self.languages)
        size = np.diff(offsets)
        lanes = -(-size // STRETCH)
        row = np.repeat(np.arange(rows), lanes)
        head = np.cumsum(lanes) - lanes
        start = offsets[row] + (np.arange(len(row)) - head[row]) * STRETCH
        long = np.minimum(offsets[row + 1] - start, STRETCH)
        cls = self.classes[raw]
        roots = np.array(self.base, np.int32)
        begins = np.zeros((langs, len(raw)), bool)  # a phrase of the stretch's own parse starts here
        by = np.argsort(-long, kind="stable")
        state = np.repeat(roots[:, None], len(row), axis=1)
        live = len(row)
        for t in range(int(long[by[0]]) if live else 0):
            while live and long[by[live - 1]] <= t:
                live -= 1
            at = start[by[:live]] + t
            state[:, :live], begins[:, at] = self._step(state[:, :live], cls[at], roots[:, None])
        ends = np.empty_like(state)
        ends[:, by] = state
        total = np.zeros((langs, len(raw) + 1), np.int32)
        np.cumsum(begins, axis=1, out=total[:, 1:])
        out = (total[:, offsets[1:]] - total[:, offsets[:-1]]).T.astype(np.int64)
        if len(row) > rows or (lanes > 1).any():
            joins, more = self._join(cls, begins, ends, row, start + long, offsets, roots)
            for r in np.flatnonzero(lanes > 1).tolist():
                for k in range(langs):
                    lane, at, n = int(head[r]), int(offsets[r]), 0
                    while True:
                        n += int(total[k, start[lane] + long[lane]] - total[k, at]) + int(more[k, lane])
                        at = int(joins[k, lane])
                        if at < 0:
                            break
                        lane = int(head[r]) + (at - int(offsets[r])) // STRETCH
                    out[r, k] = n
        return out

    def _step(self, now: np.ndarray, c: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a byte of each class, and whether it starts a phrase. A byte that the sample lacks is a phrase by itself."""
        to = self.table[now * self.width + c]
        stop = to == 0
        fresh = stop | (now == root)
        if stop.any():
            again = self.table[root * self.width + c]
            to = np.where(stop, np.where(again == 0, root, again), to)
        return to, fresh

    def _join(self, cls, begins, ends, row, stop, offsets, roots) -> tuple[np.ndarray, np.ndarray]:
        """languages x stretches: where a stretch's parse meets that of a later one (-1 at the text's end), and the phrases it starts before that."""
        joins, more = np.full(ends.shape, -1, np.int64), np.zeros(ends.shape, np.int64)
        lang, lane = np.nonzero(np.broadcast_to(stop < offsets[row + 1], ends.shape))
        now, at = ends[lang, lane], stop[lane].copy()
        while len(lang):
            to, fresh = self._step(now, cls[at], roots[lang])
            met = fresh & begins[lang, at]
            joins[lang[met], lane[met]] = at[met]
            more[lang, lane] += fresh & ~met
            goes = ~met & (at + 1 < offsets[row[lane] + 1])
            lang, lane, now, at = lang[goes], lane[goes], to[goes], at[goes] + 1
        return joins, more

    def identify(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of each row, and its share of the belief in all languages."""
        cost = self.phrases(raw, offsets) * self.bits
        best = np.argmin(cost, axis=1)
        gap = (cost - cost[np.arange(len(best)), best][:, None]) / TEMPERATURE
        return best, 1 / np.sum(np.exp2(-np.minimum(gap, 1000)), axis=1)


def fit(labelled: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> Model:
    """A model from (id, text, lang)."""
    rows = labelled.where("lang is not null and text is not null and length(text) > 0")
    order = F.xxhash64(F.col("id"), F.col("text"), F.lit(10))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model({})
    # candidates: about eight times as many rows of each language as it needs, by hash, so that no task orders a whole language
    share = rows.sparkSession.createDataFrame([(k, min(1.0, 8.0 * pieces / n)) for k, n in counts.items()], "of string, share double")
    some = rows.join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.shiftrightunsigned(order, 11) / float(2**53) < F.col("share"))
    at = F.pmod(F.shiftright(order, 7), F.greatest(F.length("text") - piece, F.lit(0)) + 1) + 1
    some = some.select("lang", F.substring(F.col("text"), at.cast("int"), F.lit(piece)).alias("piece"), order.alias("order"))
    some = some.groupBy("lang", "piece").agg(F.min("order").alias("order"))
    first = Window.partitionBy("lang").orderBy("order")
    taken = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= pieces).select("lang", "n", "piece").collect()  # at most pieces x languages
    texts: dict[str, list] = {}
    for r in sorted(taken, key=lambda r: (r["lang"], r["n"])):
        texts.setdefault(r["lang"], []).append(r["piece"])
    return Model({lang: "\n".join(x).encode() for lang, x in texts.items()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang, score (0 to 1)."""
    shared = K.share(docs.sparkSession.sparkContext, model)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches):
        m = K.opened(shared)
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for lo, hi in K.blocks(offsets, max((8 << 20) // max(len(m.languages), 4), 1 << 16)):
                at = offsets[lo : hi + 1]
                und = ~letters[lo:hi]
                if m.languages:
                    best, score = m.identify(raw[at[0] : at[-1]], at)
                else:
                    best, score, und = np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.ones(hi - lo, bool)
                best, score = np.where(und, len(names) - 1, best), np.where(und, 0.0, score)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["id", "lang", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang string, score double")
