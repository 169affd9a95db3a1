"""Packing token sequences into windows by best-fit decreasing.

Documents longer than a window are cut into full windows first; what remains of each, and the shorter documents, are packed
by best-fit decreasing over all of them at once. Pieces of one length are alike to that rule, so it runs on the histogram
of lengths: a segment tree over remaining capacities finds the tightest open window, and each step places as many pieces
of a length as that capacity's windows hold. Histogram and plan are bounded by the window, whatever the number of
documents; only they pass through the driver. Pieces then look up their place by length and rank.

Cases: null text is empty; an empty text still has its end id and is one piece; repeated rows and ids are packed each by
itself; null ids stay null; an empty table gives no rows; a text of any length is cut into windows. Columns of the input
other than id and text are not looked at. Ties go by the order in which the pieces were stored.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm.common import rows_of, stored
from kelpie.llm.encoder import encoder

_HELD = 1 << 18  # ids to a batch
PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids array<int>, rank_in_part long"


class OpenWindows:
    """Windows by remaining capacity under a segment tree that tells which capacities have any."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)
        self.groups: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _update(self, capacity: int) -> None:
        node = capacity + self.leaves
        self.any[node] = bool(self.groups[capacity])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def put(self, capacity: int, first: int, number: int) -> None:
        if number and capacity:
            self.groups[capacity].append((first, number))
            self._update(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        group = self.groups[capacity].popleft()
        self._update(capacity)
        return group

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least so much that has a window."""
        node = least + self.leaves
        while not self.any[node]:
            while node & 1:  # up while it is a right child
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, per_window, first_window, offset): pieces of that length and rank go, per_window at a
    time, to the windows from first_window on, from that offset on."""
    plan, open_, windows = [], OpenWindows(window), 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = open_.tightest(length)
            if room is None:
                room, first, number = window, windows, -(-left // (window // length))
                windows += number
            else:
                first, number = open_.take(room)
            fit = room // length
            full = min(number, left // fit)
            rest = min(left - full * fit, fit) if full < number else 0
            for begin, count, each in ((first, full, fit), (first + full, 1 if rest else 0, rest)):
                if count:
                    plan.append((length, rank, rank + count * each, each, begin, window - room))
                    rank += count * each
                    left -= count * each
                    open_.put(room - each * length, begin, count)
            used = full + (1 if rest else 0)
            open_.put(room, first + used, number - used)
    return plan


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int = 0) -> DataFrame:
    """Each document's ids, with end_id after them, cut into full windows and what remains; stored, with a rank among the
    pieces of the same length and part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer).encode, Counter()
        rows, parts, held = [], [], 0

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            return pa.RecordBatch.from_arrays([*cols[:5], lists, cols[5]], ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "rank_in_part"])

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            tokens = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
            for start in range(0, len(tokens), window):
                part = tokens[start : start + window]
                rows.append((doc_id, start, len(part), len(tokens), zlib.crc32(part.tobytes()), seen[len(part)]))
                parts.append(part.view("<i4"))
                seen[len(part)] += 1
                held += len(part)
                if held >= _HELD:
                    yield batch()
                    rows, parts, held = [], [], 0
        if rows:
            yield batch()

    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, PIECES)
    return stored(cut_up.withColumn("part", F.spark_partition_id()), "pieces")


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, ids, sequence_id, offset.

    Sequences hold at most window ids and fill from offset 0 without gaps.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, window, end_id)
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    plan = spark.createDataFrame(
        best_fit_plan(histogram, window),
        "plan_length long, rank_from long, rank_to long, per_window long, first_window long, first_offset long",
    )
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    turn = F.col("rank") - F.col("rank_from")
    return ranked.join(  # the plan is bounded by the window's size
        F.broadcast(plan),
        (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    ).select(
        "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids",
        (F.col("first_window") + F.floor(turn / F.col("per_window"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (turn % F.col("per_window")) * F.col("length")).cast("long").alias("offset"),
    )
