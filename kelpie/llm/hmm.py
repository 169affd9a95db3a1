"""Scores of texts by a hidden Markov language model.

Tokens are words and one end. Each word has a class: frequent words and the end one of their own, others one by their ending.
Latent states emit classes, and a class emits its words by their counts in training texts, so the model's tables are of fixed
size while the vocabulary, which is never gathered, grows with the corpus. Baum-Welch counts of all training texts, gathered from
the partitions by a tree of sums, train the states over whole texts. They start from what classes share texts: each text is a sum
of fixed random directions, one a class, and classes are clustered by the mean of their texts' directions, which also is one sum
over all training texts. So the model doesn't depend on the partitions. A text's score is the exact likelihood of its sequence: the
scaled forward recursion over the whole text, and the chance of each word in its class.

Texts are first stored in blocks, each with a dictionary of its own words as 64-bit hashes in order. The dictionaries are cut
into ranges of the hash; a range of all blocks meets in one task, which counts its words and gives each block their counts in
the block's own order. A word is there once a block, however frequent it is. The base score is that of single words.

Cases: null and empty texts are an end alone; repeated rows stay and count as often; null ids are in training, since they are
in no fold; without training texts all words are unknown and all scores come from the smoothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import columns_of, mixed, range_hashes, rows_of, stored, word_spans

END = 0  # no word has this hash
_BLOCK = 1 << 23  # bytes of text to a block
_RANGE = 1 << 20  # dictionary entries to a range of the hash, about
_DIRECTIONS = 16
BLOCKS = "seq long, words binary, endings binary, counts binary, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary"
COUNTED = "block long, range int, counts binary, sums binary, top array<struct<word:long,c:long,ending:int>>"


def planes(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers as unsigned of a kind, their lowest bytes first, then the next, and so on: high bytes are mostly zero and pack well."""
    return numbers.astype(kind).view(np.uint8).reshape(len(numbers), np.dtype(kind).itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel().astype(np.int64)


def hash_range(words: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash among so many of even size; it grows with the hash."""
    return ((words >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(fold == 0))


@dataclass(frozen=True)
class Classes:
    """The class of a word: its own if it is frequent, else one of `tail` by its last three bytes."""

    own: np.ndarray  # hashes of the end and of the frequent words, in order
    tail: int

    @property
    def number(self) -> int:
        return len(self.own) + self.tail

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Classes of the end and of a dictionary's words."""
        words, endings = np.append(np.uint64(END), words), np.append(0, endings)
        at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
        return np.where(self.own[at] == words, at, len(self.own) + endings)


@dataclass(frozen=True)
class Chain:
    """First states, steps between states, and emissions (state x class)."""

    first: np.ndarray
    steps: np.ndarray
    emits: np.ndarray


def encoded(ids: list, held: list, texts: list[bytes | None], seq: int, tail: int) -> dict:
    """A block: the hashes of its distinct words in order, their endings and counts in training texts, and each text as numbers of
    these words from 1 on; 0 is the end."""
    hashes, endings, lengths = [], [], []
    for text in texts:
        values, starts, ends = word_spans((text or b"").lower())
        hashes.append(range_hashes(values, starts, ends) | np.uint64(1))
        last = [np.where(ends - k >= starts, values[np.maximum(ends - k, 0)], 0).astype(np.uint64) for k in (1, 2, 3)] if len(starts) else [np.zeros(0, np.uint64)] * 3
        endings.append((mixed(last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)) % np.uint64(tail)).astype(np.uint16))
        lengths.append(len(starts))
    words, first, numbers = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    counts = np.bincount(numbers[np.repeat(~np.asarray(held, bool), lengths)], minlength=len(words))
    tokens = np.insert(numbers + 1, np.cumsum(lengths), 0)  # an end after each text
    return {
        "seq": seq, "words": words.tobytes(), "endings": np.concatenate(endings)[first].tobytes(), "counts": planes(counts, "<u4"), "doc_ids": ids, "held": held,
        "lengths": [n + 1 for n in lengths], "tokens": planes(tokens, "<u4"),
    }


def blocks(docs: DataFrame, folds: int = 5, fold: int = 1, tail: int = 1024) -> DataFrame:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, rows, size = 0, [], 0

        def block() -> pa.RecordBatch:
            b = encoded(*map(list, zip(*rows, strict=True)), seq, tail)
            return pa.RecordBatch.from_arrays([pa.array([b[n]], k) for n, k in zip(names, kinds, strict=True)], names)

        for row in rows_of(batches, "doc_id", "held", "data"):
            rows.append(row)
            size += len(row[2] or b"")
            if size >= _BLOCK:
                yield block()
                seq, rows, size = seq + 1, [], 0
        if rows:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held"), F.col("text").cast("binary").alias("data"))
    numbered = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("seq")
    return stored(rows.mapInArrow(encode, BLOCKS).withColumn("block", numbered).drop("seq"), "blocks")


def counted(texts: DataFrame, frequent: int, tail: int) -> DataFrame:
    """Of each block and range of the hash the counts of its words in all training texts, in the block's order; and, with a null
    block, of each range its words, distinct words, both by ending, and its most frequent words. Stored."""
    entries = texts.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"] // 8
    ranges = max(1, -(-entries // _RANGE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, endings, counts in rows_of(batches, "block", "words", "endings", "counts"):
            words, endings, counts = np.frombuffer(words, np.uint64), np.frombuffer(endings, np.uint16), from_planes(counts, "<u4")
            edges = np.searchsorted(hash_range(words, ranges), np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(edges))
            spans = [(k, edges[k], edges[k + 1]) for k in some.tolist()]
            columns = [pa.array([block] * len(spans), pa.int64()), pa.array([k for k, *_ in spans], pa.int32())]
            made = [[words[s:e].tobytes() for _, s, e in spans], [endings[s:e].tobytes() for _, s, e in spans], [planes(counts[s:e], "<u4") for _, s, e in spans]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in made)], ["block", "range", "words", "endings", "counts"])

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
        each = np.concatenate([from_planes(x, "<u4") for x in table["counts"].to_pylist()])
        words, first, at = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        c = np.bincount(at, weights=each, minlength=len(words)).astype(np.int64)
        endings = np.frombuffer(b"".join(table["endings"].to_pylist()), np.uint16)[first]
        known = c > 0
        sums = np.concatenate([[c.sum(), known.sum()], np.bincount(endings, weights=c, minlength=tail), np.bincount(endings[known], minlength=tail)])
        top = np.lexsort((words.view(np.int64), -c))[:frequent]
        top = top[c[top] > 0]
        best = [{"word": w, "c": n, "ending": e} for w, n, e in zip(words.view(np.int64)[top].tolist(), c[top].tolist(), endings[top].tolist(), strict=True)]
        answers = [planes(x, "<u8") for x in np.split(c[at], np.cumsum([len(p) for p in parts])[:-1])]
        kind = pa.list_(pa.struct([("word", pa.int64()), ("c", pa.int64()), ("ending", pa.int32())]))
        k = len(answers)
        return pa.table(
            [pa.array([*table["block"].to_pylist(), None], pa.int64()), pa.array([*table["range"].to_pylist(), table["range"][0].as_py()], pa.int32()),
             pa.array([*answers, None], pa.binary()), pa.array([None] * k + [sums.astype(float).tobytes()], pa.binary()), pa.array([None] * k + [best], kind)],
            names=["block", "range", "counts", "sums", "top"],
        )

    requests = texts.select("block", "words", "endings", "counts").mapInArrow(cut, "block long, range int, words binary, endings binary, counts binary")
    return stored(requests.groupBy("range").applyInArrow(count, COUNTED), "counted")


# --- the chain --------------------------------------------------------------------------------


def expected_of_texts(texts: np.ndarray, lengths: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of first states, steps and emissions over whole texts (their classes one after another, and their
    lengths, none 0), and the log-likelihood. Texts run side by side, the longest first, and are laid out by position, so that a
    step reads one slice and nothing is padded."""
    states, number = chain.emits.shape
    if not len(lengths):
        return np.zeros(states), np.zeros((states, states)), np.zeros((states, number)), 0.0
    order = np.argsort(-lengths, kind="stable")
    ranked, begins = lengths[order], (np.cumsum(lengths) - lengths)[order]
    active = len(ranked) - np.searchsorted(ranked[::-1], np.arange(ranked[0]), "right")  # texts longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], active)
    classes = texts[begins[place] + np.repeat(np.arange(ranked[0]), active)]
    first, steps = chain.first.astype(np.float32), chain.steps.astype(np.float32)
    emits = np.ascontiguousarray((chain.emits * number).T.astype(np.float32))[classes]
    alpha, scale = np.empty_like(emits), np.empty(len(classes), np.float32)
    bounds = at.tolist()
    for t in range(len(bounds) - 1):
        low, high = bounds[t], bounds[t + 1]
        now = (alpha[bounds[t - 1] : bounds[t - 1] + high - low] @ steps if t else first) * emits[low:high]
        scale[low:high] = total = now.sum(1)
        alpha[low:high] = now / total[:, None]
    emits /= scale[:, None]
    back, backwards = np.zeros((bounds[1], states), np.float32), np.ascontiguousarray(steps.T)
    counted, width = np.zeros((states, states)), 0
    for t in range(len(bounds) - 2, -1, -1):
        low, high = bounds[t], bounds[t + 1]
        beta = np.ones((high - low, states), np.float32)  # of those that end here
        if width:
            counted += steps * (alpha[low : low + width].T @ back)
            beta[:width] = back @ backwards
        width = high - low
        alpha[low:high] *= beta
        back = emits[low:high] * beta
    emitted = np.stack([np.bincount(classes, weights=alpha[:, k], minlength=number) for k in range(states)])
    return alpha[: bounds[1]].sum(0, dtype=np.float64), counted, emitted, float(np.log(scale.astype(np.float64) / number).sum())


def updated(first: np.ndarray, steps: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Chain:
    """The chain of expected counts, emissions smoothed towards the shares of classes."""
    emits = emits + 5.0 * share + 1e-3 / emits.shape[1]
    steps, first = steps + 0.1, first + 0.1
    return Chain(first / first.sum(), steps / steps.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


def log10_likelihoods(texts: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """log10 of the chance of each text (their classes one after another, and their lengths, none 0) by the forward recursion, scaled
    at every eighth step and where texts end; they run side by side, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    ranked, begins = lengths[order], (np.cumsum(lengths) - lengths)[order]
    logs, alpha, active = np.zeros(len(lengths)), np.broadcast_to(chain.first, (len(lengths), len(chain.first))), len(lengths)
    emits, steps = np.ascontiguousarray(chain.emits.T), np.ascontiguousarray(chain.steps)

    def scaled(alpha: np.ndarray) -> np.ndarray:
        scale = alpha.sum(1)
        logs[: len(alpha)] += np.log10(scale)
        return alpha / scale[:, None]

    for t in range(int(ranked[0]) if len(ranked) else 0):
        if ranked[active - 1] <= t:  # some end here
            alpha = scaled(alpha)
            active = int(np.searchsorted(-ranked, -t, "left"))
        alpha = (alpha[:active] @ steps if t else alpha) * emits[texts[begins[:active] + t]]
        if t % 8 == 7:
            alpha = scaled(alpha)
    if len(ranked):
        scaled(alpha)
    out = np.zeros(len(lengths))
    out[order] = logs
    return out


def _summed(partial: DataFrame, size: int) -> np.ndarray:
    """The sum of rows `sums` (packed doubles of one length) by a tree: 32 to 1 until few are left for the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for (sums,) in columns_of(batches, "sums"):
            for x in sums:
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    ways = max(1, partial.rdd.getNumPartitions() // 32)
    while True:
        partial = partial.repartition(ways).mapInArrow(add, "sums binary")
        if ways <= 8:
            break
        ways //= 32
    return np.sum([np.frombuffer(r["sums"]) for r in partial.collect()], axis=0)


def directions(number: int) -> np.ndarray:
    """A fixed random direction for each class."""
    return np.random.default_rng(21).normal(size=(number, _DIRECTIONS)).astype(np.float32)


def contexts(texts: np.ndarray, lengths: np.ndarray, weighed: np.ndarray) -> np.ndarray:
    """For each class the sum over its tokens of their texts' directions; the texts' are sums of their classes', of length 1."""
    sums = np.zeros((_DIRECTIONS, len(weighed)))
    if len(lengths):
        of_text = np.add.reduceat(weighed[texts], np.cumsum(lengths) - lengths, axis=0)
        of_text /= np.maximum(np.linalg.norm(of_text, axis=1, keepdims=True), 1e-9)
        for k in range(_DIRECTIONS):
            sums[k] = np.bincount(texts, weights=np.repeat(of_text[:, k], lengths), minlength=len(weighed))
    return sums


def start(means: np.ndarray, count: np.ndarray, states: int, rounds: int = 40) -> np.ndarray:
    """Expected emissions (state x class): classes dealt to clusters of their mean directions, softly."""
    weight = np.sqrt(count)
    centre = means[[int(np.argmax(weight * np.linalg.norm(means, axis=1)))]]
    while len(centre) < states:  # the farthest from those there are
        far = ((means[:, None] - centre) ** 2).sum(2).min(1)
        centre = np.concatenate([centre, means[[int(np.argmax(far * weight))]]])
    for _ in range(rounds):
        nearest = ((means[:, None] - centre) ** 2).sum(2).argmin(1)
        sums = np.stack([np.bincount(nearest, weights=weight * means[:, j], minlength=states) for j in range(means.shape[1])], 1)
        mass = np.bincount(nearest, weights=weight, minlength=states)
        centre = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centre)
    apart = ((means[:, None] - centre) ** 2).sum(2)
    wide = float((apart.min(1) * weight).sum() / max(weight.sum(), 1e-9)) + 1e-9
    near = np.exp(-(apart - apart.min(1, keepdims=True)) / wide)
    return (near / near.sum(1, keepdims=True) * count[:, None]).T


def trained(texts: DataFrame, classes: Classes, count: np.ndarray, states: int, rounds: int) -> Chain:
    """The chain after so many rounds of Baum-Welch over all training texts of the blocks, whole."""
    spark, number = texts.sparkSession, classes.number
    rows, known = texts.select("words", "endings", "tokens", "lengths", "held"), spark.sparkContext.broadcast(classes)

    def summed(one, size: int, given) -> np.ndarray:
        shared = spark.sparkContext.broadcast(given)  # states x classes

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for words, endings, tokens, lengths, held in rows_of(batches, "words", "endings", "tokens", "lengths", "held"):
                kind = known.value.of(np.frombuffer(words, np.uint64), np.frombuffer(endings, np.uint16)).astype(np.uint16)
                n, kept = np.asarray(lengths, np.int64), ~np.asarray(held, bool)
                sums += one(kind[from_planes(tokens, "<u4")][np.repeat(kept, n)], n[kept], shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        total = _summed(rows.mapInArrow(count, "sums binary"), size)
        shared.unpersist()
        return total

    def baum_welch(texts, lengths, chain):
        a, b, c, _ = expected_of_texts(texts, lengths, chain)
        return np.concatenate([a, b.ravel(), c.ravel()])

    share = (count + 0.5) / (count + 0.5).sum()
    weighed = directions(number) * np.minimum(1.0, 1e-3 / share).astype(np.float32)[:, None]  # frequent classes say little of a text
    total = summed(lambda t, n, given: contexts(t, n, given).ravel(), _DIRECTIONS * number, weighed).reshape(_DIRECTIONS, number).T
    seen = count > 0
    means = np.where(seen[:, None], total / np.maximum(count, 1)[:, None] - total.sum(0) / max(count.sum(), 1), 0.0)
    emits = start(means, count, states)
    lasting = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    chain = updated(emits.sum(1), lasting * 1000, emits, share)
    for _ in range(rounds):
        total = summed(baum_welch, states + states * states + states * number, chain)
        chain = updated(total[:states], total[states : states + states**2].reshape(states, states), total[states + states**2 :].reshape(states, number), share)
    return chain


def score(docs: DataFrame, states: int = 8, rounds: int = 3, frequent: int = 4096, tail: int = 1024, folds: int = 5, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    if frequent + tail >= 1 << 16:
        raise ValueError("fewer than 65536 classes")
    spark = docs.sparkSession
    texts = blocks(docs, folds, fold, tail)
    found = counted(texts, frequent, tail)
    in_ranges = _summed(found.filter("sums is not null").select("sums"), 2 + 2 * tail)
    ends = int(texts.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("n")).first()["n"])
    total, distinct = int(in_ranges[0]) + ends, int(in_ranges[1]) + (ends > 0)
    best = found.select(F.explode("top").alias("w")).select("w.*").orderBy(F.desc("c"), "word").limit(frequent).collect()
    own = np.array([r["word"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(own)
    classes = Classes(np.append(np.uint64(END), own[order]), tail)
    c, ending = (np.array([r[n] for r in best], np.int64)[order] for n in ("c", "ending"))
    count = np.concatenate([[ends], c, in_ranges[2 : 2 + tail] - np.bincount(ending, weights=c, minlength=tail)])
    size = np.concatenate([[int(ends > 0)], np.ones(len(c)), in_ranges[2 + tail :] - np.bincount(ending, minlength=tail)])
    chain = spark.sparkContext.broadcast(trained(texts, classes, count, states, rounds))
    known, room = spark.sparkContext.broadcast(classes), count + 0.5 * (size + 1)  # at most `frequent` words

    def with_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            kinds = [planes(known.value.of(np.frombuffer(column["words"][k].as_py(), np.uint64), np.frombuffer(column["endings"][k].as_py(), np.uint16)), "<u2") for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([column["block"], pa.array(kinds, pa.binary()), *(column[n] for n in _KEPT)], ["block", "kinds", *_KEPT])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, ids, held, lengths, tokens, answers in rows_of(batches, "kinds", *_KEPT, "answers"):
            c = np.concatenate([np.zeros(0, np.int64), *(from_planes(a["counts"], "<u8") for a in sorted(answers or [], key=lambda a: a["range"]))])
            c, kind, at = np.append(ends, c), from_planes(kinds, "<u2"), from_planes(tokens, "<u4")
            n = np.asarray(lengths, np.int64)
            starts = np.cumsum(n) - n
            base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            inside = np.log10((c + 0.5) / room[kind])
            one = log10_likelihoods(kind[at], n, chain.value) + np.add.reduceat(inside[at], starts)
            columns = [(n, pa.int64()), (np.add.reduceat((c > 0)[at].astype(np.int64), starts), pa.int64()), ([total] * len(n), pa.int64()), (np.add.reduceat(base[at], starts), pa.float64()), (one, pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), *(pa.array(x, kind) for x, kind in columns)], _SCORED)

    coded = texts.select("block", "words", "endings", *_KEPT).mapInArrow(with_kinds, "block long, kinds binary, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary")
    answers = found.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("range", "counts")).alias("answers"))  # a block's own words
    whole = coded.join(answers, "block", "left").select("kinds", *_KEPT, "answers")
    return whole.mapInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_KEPT = ("doc_ids", "held", "lengths", "tokens")
_SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
