"""Toxic passages by maximum-scoring segments.

Words and their beginnings, which inflected forms share, have log-odds of toxic against clean documents under a Dirichlet
prior, less some standard errors towards zero; a word takes the most decided of its own. The model holds them by hash bucket, so
its size is fixed. One linear scan over a document's words finds all its maximal segments. The highest sum of n words follows an
extreme-value law under the words of clean documents, whose decay is fitted on their words and whose scale on the highest sums of
clean documents. A document's evidence adds up its r best segments by the law of such sums, for the r that says most, at a price
for each further segment; a logistic curve fitted on the training rows makes a chance of it. Segments that clean words
would hardly give are its passages.

Training reads at most `most_labelled` labelled documents, those with the smallest hashes of their ids.

Cases: null and empty texts have no words and get the score of no evidence; null labels are left out, a label says toxic if it is
above 0, a document with several labels is toxic if one says so; if one class has no training rows, each row gets the share of toxic labels; repeated rows
stay; null ids are held out like any id whose remainder is 0; an empty table gives no rows. A column of the input named toxicity is
replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import range_hashes, rows_of, stored, word_spans

BITS = 20
BUCKETS = 1 << BITS
#: What each word costs besides its score, and standard errors by which log-odds go towards 0.
_DRIFT, _SURE = 1.0, 1.0
_BINS, _STEP = 2048, 0.25
_NOTHING = -10.0
_FINE = 64  # bins of a word's score to a unit
_BEGINNINGS = (3, 4, 5, 6)  # bytes
_PARTS = bytes(c if chr(c).isalnum() or c > 127 else 0x20 for c in range(256))
SCORED = "struct<score:double,predicted:int,max_score:double,evidence:double,n_words:long,passages:array<struct<first_word:long,last_word:long,score:double>>>"


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(fold == 0))


def buckets(data: bytes | None) -> np.ndarray:
    """Hash buckets of each word and of its beginnings, a column for each; words are parted by white space and ASCII punctuation."""
    if not data:
        return np.zeros((0, 1 + len(_BEGINNINGS)), np.int64)
    values, starts, ends = word_spans(data.lower().translate(_PARTS))
    found = range_hashes(values, starts, ends, _BEGINNINGS) ^ np.array([[0], *([n] for n in _BEGINNINGS)], np.uint64)
    return (found.T * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def word_scores(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each word, the most decided of the scores of the word and its beginnings; 0 where it repeats the word before it."""
    if not len(at):
        return np.zeros(0)
    got = scores[at]
    got = got[np.arange(len(got)), np.abs(got).argmax(1)]
    got[1:][at[1:, 0] == at[:-1, 0]] = 0
    return got


@dataclass(frozen=True)
class Model:
    """Scores by bucket, the law of the highest sum under clean words, and the curve from evidence to chance."""

    scores: np.ndarray
    drift: float = _DRIFT
    decay: float = 1.0
    scale: float = 0.1
    slope: float = 1.0
    offset: float = 0.0
    fixed: float | None = None
    significant: float = float(np.log(100))

    def words(self, data: bytes | None) -> np.ndarray:
        return word_scores(self.scores, buckets(data)) - self.drift

    def evidence(self, sums: np.ndarray, words: int) -> float:
        """Minus the log of the chance that clean words give segments with such sums, over the number of the best ones that says
        most; each further segment costs the log of 2."""
        if not len(sums):  # no segment, which is sure to be
            return _NOTHING
        each = self.decay * np.sort(sums)[::-1] - float(np.log(self.scale * max(words, 1)))
        together = np.cumsum(each[: max(1, int((each > 0).sum()))])
        r = np.arange(1, len(together) + 1)
        log_factorial = np.cumsum(np.log(r))
        several = together - (r - 1) * np.log(2 * np.maximum(together, 1e-9)) + 2 * log_factorial - np.log(r)
        return float(several[(r == 1) | (together >= r * (r - 1))].max())  # beyond that the law of sums doesn't hold

    def evidence_of(self, scores: np.ndarray) -> float:
        return self.evidence(np.array([x[2] for x in maximal_segments(scores)]), len(scores))

    def passages(self, segments: list[tuple[int, int, float]], words: int) -> list[tuple[int, int, float]]:
        """The segments that are significant among so many words."""
        least = (self.significant + float(np.log(self.scale * max(words, 1)))) / self.decay
        return [x for x in segments if x[2] >= max(least, 0.0)]

    def chance(self, evidence: np.ndarray | float) -> np.ndarray | float:
        return self.fixed if self.fixed is not None else 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40)))


def highest_segment(scores: np.ndarray) -> float:
    """The highest sum of neighbouring scores, 0 at least."""
    if not len(scores):
        return 0.0
    sums = np.cumsum(scores)
    return max(0.0, float((sums - np.minimum(np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]])), 0)).max()))


def maximal_segments(scores: np.ndarray, least: float = 0.0) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of at least so much, as first, last and sum, in linear time: a stack of candidates with the
    running sums before and at the end of each, and its link to the nearest one before it whose sum before is less."""
    sums = np.cumsum(scores)
    firsts, lasts, lefts, rights, links = [], [], [], [], []
    at = np.flatnonzero(np.asarray(scores) > 0)
    for i, left, right in zip(at.tolist(), (sums[at] - scores[at]).tolist(), sums[at].tolist(), strict=True):
        first, j = i, len(lefts) - 1
        while j >= 0 and lefts[j] >= left:
            j = links[j]
        while j >= 0 and rights[j] < right:  # it grows back over that candidate and what came after it
            first, left, link = firsts[j], lefts[j], links[j]
            for x in (firsts, lasts, lefts, rights, links):
                del x[j:]
            j = link
        for x, value in zip((firsts, lasts, lefts, rights, links), (first, i, left, right, j), strict=True):
            x.append(value)
    return [(a, b, r - lo) for a, b, lo, r in zip(firsts, lasts, lefts, rights, strict=True) if r - lo >= least]


def fit_words(toxic: np.ndarray, clean: np.ndarray, prior: float = 500.0) -> Model:
    """Scores from document counts by bucket."""
    nt, nc = toxic.sum(), clean.sum()
    alpha = 0.5 + prior * (toxic + clean) / (nt + nc)
    total = alpha.sum()
    odds = np.log((toxic + alpha) / (nt + total - toxic - alpha)) - np.log((clean + alpha) / (nc + total - clean - alpha))
    doubt = _SURE * np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    return Model((np.sign(odds) * np.maximum(0, np.abs(odds) - doubt)).astype(np.float32))


def fit_law(model: Model, scores: np.ndarray, counts: np.ndarray) -> Model:
    """Drift and decay from the distribution of the words' scores in clean documents: the mean falls below 0, and the decay solves
    that the mean of exp(decay * score) is 1."""
    p = counts / counts.sum()
    drift = max(0.0, float(p @ scores)) + _DRIFT
    low, high = 0.0, 1.0
    with np.errstate(over="ignore"):
        while p @ np.exp(high * (scores - drift)) < 1 and high < 64:
            low, high = high, 2 * high
        for _ in range(60):
            decay = (low + high) / 2
            low, high = (decay, high) if p @ np.exp(decay * (scores - drift)) < 1 else (low, decay)
    return replace(model, drift=drift, decay=low or 1.0)


def fit_scale(model: Model, segments: float, expected: float) -> Model:
    """The scale at which the highest sums of clean documents are likeliest, from the number of those that have a segment and the
    sum over all of words times exp(-decay * highest sum)."""
    return replace(model, scale=float(np.clip(segments / expected, 1e-6, 1.0)) if segments and expected else 0.1)


def fit_curve(model: Model, evidence: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> Model:
    """The logistic curve from evidence to chance by Newton's steps on binned rows, with a weak prior."""
    n = toxic + clean

    def loss(c: np.ndarray) -> float:
        z = c[0] * evidence + c[1]
        return float((n * np.logaddexp(0, z) - toxic * z).sum() + 0.5 * (c @ c))

    c = np.array([0.1, -1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(c[0] * evidence + c[1], -40, 40)))
        w, x = n * p * (1 - p), np.stack([evidence, np.ones_like(evidence)])
        step = np.linalg.solve(x * w @ x.T + np.eye(2), x @ (n * p - toxic) + c)
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
    a, b = c.tolist()
    return replace(model, slope=max(a, 1e-3), offset=b)


def training_labels(labels: DataFrame, most_labelled: int, folds: int = 5) -> DataFrame:
    """doc_id and toxic (1 if a label of the document is above 0, else 0) of at most so many documents outside the held-out fold."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max((F.col("toxic").cast("double") > 0).cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 65536) -> Model:
    """A model from the documents that have labels; what comes to the driver is bounded by buckets and bins."""
    chosen = training_labels(labels, most_labelled).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    labelled = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("data")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = stored(labelled.select("data", "__toxic"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for x, t in rows_of(batches, "data", "__toxic"):
            seen[t, np.unique(buckets(x))] += 1
            n[t] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0, at], n[0]).astype(np.int64)), pa.array(np.append(seen[1, at], n[1]).astype(np.int64))], _NAMES)

    bucket, clean, toxic = _sums(rows, count)
    n_clean, n_toxic = (int(x[bucket == -1].sum()) for x in (clean, toxic))
    if not n_clean or not n_toxic:
        return Model(np.zeros(BUCKETS, np.float32), fixed=n_toxic / (n_clean + n_toxic) if n_clean + n_toxic else 0.0)
    full = np.zeros((2, BUCKETS))
    full[:, bucket[bucket >= 0]] = clean[bucket >= 0], toxic[bucket >= 0]
    model = fit_words(full[1], full[0])
    bins, clean, _ = _sums(rows, _histogram(rows, model, lambda m, x: word_scores(m.scores, buckets(x)), _FINE))
    model = fit_law(model, bins / _FINE, clean)
    model = _with_scale(rows, model)
    bins, clean, toxic = _sums(rows, _histogram(rows, model, lambda m, x: [m.evidence_of(m.words(x))], 1 / _STEP))
    return fit_curve(model, bins * _STEP, toxic, clean)


def _with_scale(rows: DataFrame, model: Model) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, expected = 0.0, 0.0
        for data, toxic in rows_of(batches, "data", "__toxic"):
            if not toxic:
                words = shared.value.words(data)
                highest = highest_segment(words)
                segments += highest > 0
                expected += len(words) * float(np.exp(-shared.value.decay * highest))
        yield pa.RecordBatch.from_arrays([pa.array([segments]), pa.array([expected])], ["segments", "expected"])

    found = rows.select("data", "__toxic").mapInArrow(count, "segments double, expected double").agg(F.sum("segments"), F.sum("expected")).first()
    return fit_scale(model, found[0] or 0.0, found[1] or 0.0)


_NAMES = ["bucket", "clean", "toxic"]


def _histogram(rows: DataFrame, model: Model, values: Callable, steps: float) -> Callable:
    """Counts by class of values of the rows, in bins of which `steps` make a unit; the bins are bounded."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2 * _BINS + 1), np.int64)
        for x, t in rows_of(batches, "data", "__toxic"):
            at = np.clip(np.rint(np.asarray(values(shared.value, x)) * steps).astype(np.int64) + _BINS, 0, 2 * _BINS)
            seen[t] += np.bincount(at, minlength=2 * _BINS + 1)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at - _BINS), pa.array(seen[0, at]), pa.array(seen[1, at])], _NAMES)

    return count


def _sums(rows: DataFrame, count: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counted = rows.select("data", "__toxic").mapInArrow(count, "bucket long, clean long, toxic long")
    got = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    return got["bucket"].to_numpy(), got["clean"].to_numpy().astype(float), got["toxic"].to_numpy().astype(float)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with struct column toxicity: score, predicted, max_score, evidence, n_words and the significant passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("max_score", pa.float64()), ("evidence", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())])))])

    def one(data: bytes | None) -> dict:
        m = shared.value
        scores = m.words(data)
        segments = maximal_segments(scores)
        sums = np.array([x[2] for x in segments])
        evidence = m.evidence(sums, len(scores))
        score = float(m.chance(evidence))
        found = [{"first_word": a, "last_word": b, "score": s} for a, b, s in m.passages(segments, len(scores))]
        return {"score": score, "predicted": int(score >= 0.5), "max_score": float(sums.max()) if len(sums) else 0.0, "evidence": evidence, "n_words": len(scores), "passages": found}

    @F.arrow_udf(SCORED)
    def score(texts: pa.Array) -> pa.Array:
        return pa.array((one(x.as_py()) for x in texts), kind)

    return docs.withColumn("toxicity", score(F.col("text").cast("binary")))
