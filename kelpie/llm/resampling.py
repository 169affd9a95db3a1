"""Importance resampling towards a target distribution over hashed n-grams.

Texts are cut into chunks at word boundaries. A chunk owns the features that start at its words and carries the n - 1 words after
them, so that no feature is lost or counted twice at a cut. The one chunk of a short text is counted where it was read; the chunks of
long texts are dealt out to all tasks first. What is kept of a chunk is the count of each of its features' buckets. The corpus'
and the target's sums over buckets (a number of rows that doesn't grow) give each bucket a gain, the scaled log of the ratio of both
distributions, and chunks' counts and gains are summed by document. Documents with words enough are ranked by their mean gain
plus Gumbel noise from a hash of the id, which draws without replacement in proportion to the exponential of the gain, and a share
of them is drawn. Ranks come from one sort by ranges: each range's rows are numbered after the rows of the ranges before it.

Cases: null and empty texts and texts without words have no features and weight 0; rows with null ids have neither score nor rank
and don't count towards the number drawn, but their words count in the corpus; rows that share an id are separate rows with equal
noise, and equal rows take neighbouring ranks; empty tables count as nothing: without a target all its counts are 0, without
documents there are no rows. Columns other than id and text (of the target: text) are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import rows_of, stored

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_FIELDS = "part int, row long, doc_id long, piece binary, own int, words long, buckets binary, counts binary"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def chunks(data: bytes, n: int, window: int = 1 << 16) -> Iterator[tuple[list[bytes], int]]:
    """The chunks of a text in lower case: their words, with those carried, and how many of them are their own."""
    data, low, words = data.lower(), 0, []
    while low < len(data):
        edge = _BREAK.search(data, low + window) if low + window < len(data) else None
        high = edge.start() if edge else len(data)
        words += _WORD.findall(data, low, high)
        own = len(words) if high == len(data) else len(words) - (n - 1)
        if own > 0:
            yield words, own
            words = words[own:]
        low = high


def buckets_of(words: list[bytes], own: int, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the features that start at the first `own` words, and how often each was met."""
    seen: Counter = Counter()
    for size in range(1, n + 1):
        if size == 1:
            seen.update(words[:own])
        else:
            seen.update(b" ".join(words[k : k + size]) for k in range(min(own, len(words) - size + 1)))
    at = np.fromiter((zlib.crc32(f) % buckets for f in seen), np.int64, len(seen))
    found, where = np.unique(at, return_inverse=True)
    return found.astype("<i4"), np.bincount(where, np.fromiter(seen.values(), np.int64, len(seen)), len(found)).astype("<i8")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _batched(rows: Iterator[tuple], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield _batch(some)
            some, size = [], 0
    if some:
        yield _batch(some)


def counted(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """part and row (which tell rows apart), doc_id, words (own ones), buckets and counts of each chunk; stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for row, (doc_id, data) in enumerate(rows_of(batches, "doc_id", "data")):
                found = chunks(data or b"", n)
                first, second = next(found, ([], 0)), next(found, None)
                if second is None:
                    yield part, row, doc_id, None, None, first[1], *(x.tobytes() for x in buckets_of(*first, n, buckets))
                    continue
                for words, own in chain((first, second), found):
                    yield part, row, doc_id, b" ".join(words), own, own, None, None

        yield from _batched(rows())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part, row, doc_id, piece, own in rows_of(batches, "part", "row", "doc_id", "piece", "own"):
                yield part, row, doc_id, None, None, own, *(x.tobytes() for x in buckets_of(piece.split(b" "), own, n, buckets))

        yield from _batched(rows())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    pieces = stored(texts.mapInArrow(cut, _FIELDS), "pieces")
    kept = ("part", "row", "doc_id", "words", "buckets", "counts")
    long_ones = pieces.filter("piece is not null").repartition("part", "row", F.xxhash64("piece")).mapInArrow(count, _FIELDS)
    return pieces.filter("piece is null").select(*kept).union(stored(long_ones.select(*kept), "long"))


def sums(chunked: DataFrame, buckets: int) -> DataFrame:
    """bucket and n: one row for each bucket met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for at, n in rows_of(batches, "buckets", "counts"):
            total[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    return chunked.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from chunks of the corpus and of the target: an array of fixed length."""
    session = docs.sparkSession
    both = session.range(buckets).select(F.col("id").alias("bucket")).join(sums(docs, buckets).withColumnRenamed("n", "s"), "bucket", "left").join(sums(target, buckets).withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    rows = sorted((r["bucket"], r["s"], r["t"]) for r in both.collect())
    s_all, t_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    d = lambda x: F.col(x).cast("double")
    ratio = (d("t") + 1) * F.lit(float(s_all + buckets)) / ((d("s") + 1) * F.lit(float(t_all + buckets)))
    seen = session.createDataFrame(rows, "bucket long, s long, t long").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    return np.array([r["gain"] for r in sorted(seen.collect())], np.int64)


def weighed(chunked: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of the documents."""
    known = chunked.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of([batch], "buckets", "counts")
            made = [(int(c.sum()), int((known.value[np.frombuffer(b, "<i4")] * c).sum())) for b, c in ((b, np.frombuffer(c, "<i8")) for b, c in rows)]
            kept = [batch.column(batch.schema.get_field_index(name)) for name in ("part", "row", "doc_id", "words")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([m[k] for m in made], pa.int64()) for k in (0, 1))], ["part", "row", "doc_id", "words", "features", "gain"])

    by_chunk = chunked.mapInArrow(weigh, "part int, row long, doc_id long, words long, features long, gain long")
    by_row = by_chunk.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("words", "features", "gain")))
    mean = F.when(F.col("features") == 0, F.lit(0)).otherwise(F.expr("gain div features") - F.when(F.expr("gain % features < 0"), 1).otherwise(0))
    return by_row.select("doc_id", F.col("words").alias("n_words"), F.col("features").alias("n_features"), mean.cast("long").alias("weight"))


def numbered(rows: DataFrame, *order) -> DataFrame:
    """The rows with their place (rank, from 1) in the order, by one sort by ranges; the number of each range's rows reaches the driver."""
    low = F.lit((1 << 33) - 1)
    seen = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    sizes = seen.groupBy(F.shiftright("__at", 33).cast("int").alias("range")).agg(F.count("*").alias("n")).collect()
    before, total = {}, 0
    for r in sorted(sizes):
        before[r["range"]], total = total, total + r["n"]
    starts = rows.sparkSession.createDataFrame(sorted(before.items()), "__range int, __before long")
    placed = seen.join(F.broadcast(starts), F.shiftright("__at", 33).cast("int") == F.col("__range"))  # a row for each range
    return placed.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(low) + 1).drop("__at", "__range", "__before")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10000, least_words: int = 20, percent: int = 10, salt: str = "2024:") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document; rank is null for those not drawn."""
    corpus = counted(docs, n, buckets)
    wanted = counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets)
    rows = weighed(corpus, gains(corpus, wanted, buckets), n)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(rows.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    open_ = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = scored.filter(open_).count() * percent // 100
    ranked = numbered(scored.filter(open_), F.desc("score"), F.asc("doc_id")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~open_).withColumn("rank", F.lit(None).cast("long")))


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns; of rows that share an id all are there if one is drawn."""
    ids = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == F.col("__drawn"), "left_semi")


RESAMPLE_SQL = r"""
WITH RECURSIVE tab AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM tab WHERE k = 8),
w AS (SELECT doc_id, false AS target, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT NULL, true, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2*i+1]) * 16 + strpos('0123456789ABCDEF', x[2*i+2]) - 17)::BIGINT)),
  lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM v, crc),
f AS (SELECT doc_id, target, bucket, count(*) AS n FROM w JOIN b USING (word) GROUP BY ALL),
g AS (SELECT bucket, sum(n) FILTER (NOT target) AS s, sum(n) FILTER (target) AS t FROM f GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM g),
k AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)))) AS gain FROM g, a),
d AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM f JOIN k USING (bucket) WHERE NOT target GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  list_reduce(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1)::BIGINT), lambda x, y: 16 * x + y) AS h FROM documents LEFT JOIN d USING (doc_id)),
s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
