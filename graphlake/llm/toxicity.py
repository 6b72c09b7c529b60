"""Toxic passages by maximum-scoring segments.

Learning: log-odds of the presence of each term in toxic against clean documents under a Dirichlet prior. Only terms with log-odds of at
least ``LEAST_ODDS`` either way are kept. Terms are words and, since
families of words share a stem, the first ``STEMS`` bytes of longer words. A word scores as the highest of its terms with
significant log-odds; without any it gets a small negative score, the drift. The lexicon has at most ``max_lexicon``
terms, the most significant ones. Scoring: one linear scan finds all maximal-scoring segments of a document's words
(positive words raise the running sum, all others lower it). Calibration: under the extreme-value law a clean text of n words
has segments of score s or more K*n*exp(-lambda*s) times. Lambda is the positive root of E[exp(lambda * score of a word)] = 1 over the words of clean
documents (a repeated one counts once in a document), and K their segments per word; segments that
chance explains less than ``significant`` times are toxic passages, and the log of their excess, summed, is the evidence that a
logistic curve turns into a probability.

Only learning is bounded: it uses at most ``max_rows`` labelled rows, those of least hash. The calibration is made on one half of
them by a lexicon of the other half; the lexicon for scoring is learned from both. Every document is scored whole.

Null, empty and wordless texts have no passage and the score of no evidence. Labels that are null don't count; of several
labels of a row, 1 wins. Copies and near-copies that
share all of three least shingle hashes count once in learning, with the text and the label of one of them. With no labels of one kind the score is the base
rate. Other columns pass through ``drop_toxic`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import kernel as K
from graphlake.plans.staging import stage

MAX_ROWS = 40_000
MAX_LEXICON = 50_000
PRIOR = 0.5  # pseudo-documents of each word, at least
DRIFT = 0.1
LEAST_Z = 3.0
LEAST_ODDS = 1.0  # log-odds under it, however certain, only tell languages and styles apart, and add up in long texts
STEMS = (3, 4, 5, 6)

#: Words are runs of ASCII letters and digits and non-ASCII bytes.
MEMBER = np.zeros(256, bool)
MEMBER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    hashes: np.ndarray  # sorted uint64
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    bias: float
    slope: float
    significant: float = 0.05


def segments(values: np.ndarray, at: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score), given the words with a value other than -drift.

    The words between those only lower the running sum, so the scan visits the words of positive value alone.
    """
    found: list[list[float]] = []  # left sum, right sum, first, last
    total, seen = 0.0, 0
    for v, i in zip(values.tolist(), at.tolist(), strict=True):
        total -= drift * (i - seen)
        seen = i + 1
        if v <= 0:
            total += v
            continue
        left, right, first = total, total + v, i
        total = right
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append([left, right, first, i])
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
            j -= 1
    return [(int(a), int(b), r - x) for x, r, a, b in found]


def _terms(raw: np.ndarray, w: K.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, hash) of every word, then of the stems of each length."""
    if not len(w.hash):
        return []
    up, down = K.powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(K._BYTE[K.LOWER[raw]] * up[: len(raw)], out=total[1:])
    out = [(np.arange(len(w.hash)), w.hash)]
    for n in STEMS:
        long = np.flatnonzero(w.end - w.start > n)
        at = w.start[long]
        out.append((long, K.mix((total[at + n] - total[at]) * down[at] + np.uint64(n))))
    return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean, half) counts of documents that hold the word, block by block."""
    for batch in batches:
        raw, offsets = K.text_bytes(batch.column("text"))
        label, half = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "half"))
        for lo, hi in K.blocks(offsets):
            at = offsets[lo : hi + 1]
            block = raw[at[0] : at[-1]]
            w = K.words(block, at, MEMBER)
            terms = _terms(block, w)
            h = np.concatenate([t for _, t in terms]) if terms else w.hash
            row = np.concatenate([w.row[i] for i, _ in terms]) if terms else w.row
            _, pick = np.unique(K.mix(h ^ K.mix(row.astype(np.uint64))), return_index=True)  # once per document
            h, row = h[pick], row[pick]
            for k in (0, 1):
                mine = half[lo:hi][row] == k
                word, inverse = np.unique(h[mine], return_inverse=True)
                toxic = np.bincount(inverse, label[lo:hi][row[mine]] == 1, len(word))
                every = np.bincount(inverse, minlength=len(word))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((every - toxic).astype(np.int64)), pa.array(np.full(len(word), k, np.int32))], ["word", "toxic", "clean", "half"])


def _evidence(scores: list[float], words: int, m: Model) -> float:
    base = log(max(m.k * max(words, 1), 1e-9))
    return sum(max(0.0, m.lam * s - base - log(1 / m.significant)) for s in scores)


def _score_block(raw: np.ndarray, at: np.ndarray, m: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], list[np.ndarray]]:
    w = K.words(raw, at, MEMBER)
    n = np.diff(w.first)
    found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(at) - 1)]
    values: list[np.ndarray] = [np.empty(0)] * (len(at) - 1)
    if len(w.hash) and len(m.hashes):
        value, known = np.full(len(w.hash), -np.inf), np.zeros(len(w.hash), bool)
        for at_word, h in _terms(raw, w):
            ix = np.minimum(np.searchsorted(m.hashes, h), len(m.hashes) - 1)
            hit = m.hashes[ix] == h
            at_word = at_word[hit]
            value[at_word] = np.maximum(value[at_word], m.scores[ix[hit]])
            known[at_word] = True
        known = np.flatnonzero(known)
        value, row = value[known], w.row[known]
        cut = np.searchsorted(row, np.arange(len(at)))
        positive = np.zeros(len(known) + 1, np.int64)
        np.cumsum(value > 0, out=positive[1:])
        for r in np.flatnonzero(positive[cut[1:]] > positive[cut[:-1]]).tolist():
            part = slice(cut[r], cut[r + 1])
            values[r] = value[part]
            found[r] = segments(value[part], known[part] - w.first[r], m.drift)
    return n, found, values


def _probability(evidence: np.ndarray, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m.bias + m.slope * np.log1p(evidence), -30, 30)))


def _scored(batch: pa.RecordBatch, m: Model, text_at: int) -> tuple[np.ndarray, list]:
    raw, offsets = K.text_bytes(batch.column(text_at))
    evidence, passages = np.zeros(batch.num_rows), []
    for lo, hi in K.blocks(offsets):
        at = offsets[lo : hi + 1]
        n, found, _ = _score_block(raw[at[0] : at[-1]], at, m)
        for r, segs in enumerate(found):
            evidence[lo + r] = _evidence([s for _, _, s in segs], int(n[r]), m)
            e = m.k * max(int(n[r]), 1)
            passages.append([{"first_word": a, "last_word": b, "score": s, "expected": min(e * exp(-m.lam * s), 1e9)} for a, b, s in segs if e * exp(-m.lam * s) < m.significant])
    return _probability(evidence, m), passages


PASSAGES = "array<struct<first_word:bigint,last_word:bigint,score:double,expected:double>>"
_PASSAGES = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, max_lexicon: int = MAX_LEXICON, least_z: float = LEAST_Z, drift: float = DRIFT) -> Model:
    """A model from (id, text, label)."""
    order = F.xxhash64(F.col("id"), F.lit(6))
    known = labelled.where("label is not null").select("id", "text", F.col("label").cast("int").alias("label"), order.alias("order"))
    total = known.count()
    # rows of least hash: the threshold lets a few more by than wanted, and only hashes are sorted
    wanted = min(1.0, 1.2 * max_rows / max(total, 1))
    known = known.where(F.col("order") < F.lit(int(min(-(2**63) + wanted * 2**64, 2**63 - 1))))
    cut = known.groupBy("order").count().orderBy("order").limit(max_rows).agg(F.max("order")).first()[0]
    sample = known.where(F.col("order") <= F.lit(cut)) if cut is not None else known
    sketched = sample.select("text", "label", "order").mapInArrow(_sketch, "text string, label int, order long, m0 long, m1 long, m2 long")
    alike = sketched.groupBy("m0", "m1", "m2").agg(F.min(F.struct("order", "text", "label")).alias("x")).select("x.*")  # text and label of one row
    sample = stage(alike.select("text", "label", F.pmod("order", F.lit(2)).cast("int").alias("half")), "toxicity-sample")
    counts = stage(sample.mapInArrow(_presence, "word long, toxic long, clean long, half int").groupBy("word", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-counts")
    first = _lexicon(counts.where("half = 0"), sample.where("half = 0"), max_lexicon, least_z, drift)
    model = _calibrate(sample.where("half = 1"), first)
    both = _lexicon(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), sample, max_lexicon, least_z, drift)
    model.hashes, model.scores = both.hashes, both.scores
    return model


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three least hashes of a text's five-word shingles, or of all its words if it has fewer."""
    for batch in batches:
        raw, offsets = K.text_bytes(batch.column("text"))
        for lo, hi in K.blocks(offsets):
            at = offsets[lo : hi + 1]
            w = K.words(raw[at[0] : at[-1]], at)
            grams = K.windows(w.hash, 5)
            whole = K.sequence_hash(w.hash, w.first)
            own = np.zeros(len(grams), bool) if not len(grams) else w.row[: len(grams)] == w.row[4:]
            row = w.row[: len(grams)][own]
            head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
            marks = []
            for k in range(3):
                mark = whole.copy()
                if len(row):
                    mark[row[head]] = np.minimum.reduceat(K.mix(grams[own] + np.uint64(k)), head)
                marks.append(pa.array(mark.view(np.int64)))
            rest = [batch.column(c).slice(lo, hi - lo) for c in ("text", "label", "order")]
            yield pa.RecordBatch.from_arrays([*rest, *marks], ["text", "label", "order", "m0", "m1", "m2"])


def _lexicon(counts: DataFrame, sample: DataFrame, most: int, least_z: float, drift: float) -> Model:
    """A model with the significant terms of (word, toxic, clean), not calibrated."""
    model = Model(np.empty(0, np.uint64), np.empty(0), drift, 1.0, 1.0, 0.0, 1.0)
    kinds = sample.agg(F.sum(F.col("label")).alias("a"), F.sum(1 - F.col("label")).alias("b")).first()
    n1, n0 = kinds["a"] or 0, kinds["b"] or 0
    if not n1 or not n0:
        return model
    prior = F.greatest(F.lit(PRIOR), (F.col("toxic") + F.col("clean")) / F.lit(float(n1 + n0)))
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(float(n)) + 2 * prior - F.col(y)))
    scored = counts.withColumn("score", odds("toxic", n1) - odds("clean", n0))
    z = F.col("score") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    top = scored.withColumn("z", F.abs(z)).where((F.col("z") >= least_z) & (F.abs("score") >= LEAST_ODDS)).orderBy(F.desc("z"), "word").limit(most).select("word", "score").toArrow()
    words = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(words)
    model.hashes, model.scores = words[by], top.column("score").to_numpy()[by]
    return model


def _calibrate(sample: DataFrame, m: Model) -> Model:
    def run(batches):
        for batch in batches:
            raw, offsets = K.text_bytes(batch.column("text"))
            for lo, hi in K.blocks(offsets):
                at = offsets[lo : hi + 1]
                n, found, values = _score_block(raw[at[0] : at[-1]], at, m)
                doubles = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array([[s for _, _, s in x] for x in found], doubles), pa.array([np.unique(v).tolist() for v in values], doubles), batch.column("label").slice(lo, hi - lo)], ["n", "scores", "values", "label"])

    got = sample.select("text", "label").mapInArrow(run, "n long, scores array<double>, values array<double>, label int").toArrow().to_pydict()  # at most max_rows rows
    label = np.array(got["label"], float)
    if len(label) == 0:
        m.bias = 0.0
        return m
    clean = np.flatnonzero(label == 0)
    total = max(sum(got["n"][i] for i in clean), 1)
    value = np.array([v for i in clean for v in got["values"][i]])
    low, high = 0.05, 3.0
    excess = lambda lam: float(np.exp(lam * value).sum()) + (total - len(value)) * exp(-lam * m.drift) - total
    if excess(high) > 0:
        for _ in range(60):  # the mean starts below 1 and is convex: one root
            mid = (low + high) / 2
            low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    m.lam = high
    m.k = max(sum(len(got["scores"][i]) for i in clean), 1) / total
    f = np.log1p([_evidence(s, k, m) for s, k in zip(got["scores"], got["n"], strict=True)])
    rate = min(max(float(label.mean()), 1e-4), 1 - 1e-4)
    a, b = log(rate / (1 - rate)), 0.0
    for _ in range(50):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(a + b * f, -30, 30)))
        g = np.array([np.sum(label - p), np.sum((label - p) * f) - 0.01 * b])
        w = p * (1 - p) + 1e-9
        h = np.array([[np.sum(w), np.sum(w * f)], [np.sum(w * f), np.sum(w * f * f) + 0.01]])
        step = np.clip(np.linalg.solve(h + 1e-9 * np.eye(2), g), -2, 2)
        a, b = a + step[0], b + step[1]
    m.bias, m.slope = a, max(b, 0.0)
    return m


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted, passages (word spans from 0, score and expected number by chance)."""
    shared = K.share(docs.sparkSession.sparkContext, model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        m = K.opened(shared)
        for batch in batches:
            p, passages = _scored(batch, m, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, _PASSAGES)], ["id", "score", "predicted", "passages"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int, passages {PASSAGES}")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    shared = K.share(docs.sparkSession.sparkContext, model)
    text_at = docs.columns.index(text_col)

    def run(batches):
        m = K.opened(shared)
        for batch in batches:
            p, _ = _scored(batch, m, text_at)
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)
