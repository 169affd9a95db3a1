"""Approximate nearest neighbours by multi-index hashing.

Codes are the signs of vectors under learned rotations: principal axes, turned so that signs lose least (iterative
quantization), several times from different starts so that a code may have more bits than the vectors have dimensions.
Each block of the index has its codes split into substrings and a directory for each. A code within Hamming radius r of a
query has, by the pigeonhole principle, a substring within r // m; probing all values so near in every directory retrieves
every code within r, and what is retrieved is ranked by the cosine of the original vectors in double precision. Where fewer
than k are within r, the radius grows until they are, so no query lacks answers.

Rotations and radius are learned on at most `most_sampled` vectors; the radius covers `cover` of the sample's own nearest
neighbours, which are farther than those among all rows. Every row is indexed. Blocks of queries meet blocks of the index.

Cases: vectors that are null, zero, of another than the commonest length or hold null or non-finite numbers take no part, nor
do rows with null ids; rows with the query's id are its own; ties go to the smaller id, equal rows are both answers; with
fewer candidates than k all are answers; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

_SUB = 16  # bits of a substring
_ONES = np.array([bin(i).count("1") for i in range(1 << _SUB)], np.uint8)


@dataclass(frozen=True)
class Codes:
    """Rotations (dimensions x bits) and the radius."""

    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings; rows needn't be normed."""
        return np.packbits(vectors @ self.rotation >= 0, axis=1).view(np.uint16)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _rotation(sample: np.ndarray, bits: int, rounds: int = 20) -> np.ndarray:
    dims = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    parts, rng = [], np.random.default_rng(5)
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        seen = sample @ axes
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(seen @ turn >= 0, 1.0, -1.0).T @ seen)
            turn = (left @ right).T
        parts.append(axes @ turn)
    return np.concatenate(parts, 1)[:, :bits]


def learn(sample: np.ndarray, k: int, bits: int = 256, cover: float = 0.985, probes: int = 512) -> Codes:
    """Codes from a sample of vectors, one at least."""
    sample = unit(sample)
    codes = Codes(_rotation(sample, bits), 0)
    if len(sample) < 2:
        return codes
    step = max(1, len(sample) // probes)
    asked = np.arange(0, len(sample), step)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    of = codes.of(sample)
    apart = _ONES[of[asked][:, None, :] ^ of[best]].sum(-1, dtype=np.int64)
    return Codes(codes.rotation, int(np.quantile(apart, cover)))


#: All differences of substrings, the smallest first, and how many are within each distance.
_BALL = np.argsort(_ONES, kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(_ONES, minlength=_SUB + 1))


class Block:
    """A multi-index over codes: for each substring a directory, in which a value is looked up in constant time."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.parts = codes, codes.shape[1]
        self.rows = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(self.parts)]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << _SUB))]).astype(np.int32) for j in range(self.parts)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius. With r = m * s + a, a + 1 substrings are probed to distance s and the others to
        s - 1, each at all values so near: a code that is farther in all of them is farther in sum."""
        s, a = divmod(radius, self.parts)
        seen = np.zeros(len(self.codes), bool)
        for j in range(self.parts):
            reach = min(s if j <= a else s - 1, _SUB)
            if reach < 0:
                continue
            probed = _BALL[: _WITHIN[reach]] ^ code[j]
            starts = self.starts[j][probed]
            count = self.starts[j][probed.astype(np.int64) + 1] - starts
            hit = np.flatnonzero(count)
            starts, count = starts[hit], count[hit]
            if len(hit):
                at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
                seen[self.rows[j][at]] = True
        rows = np.flatnonzero(seen)
        return rows[_ONES[self.codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & (F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0), F.lit(False))


def search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", most_sampled: int = 8192, block: int = 8192, query_block: int = 1 << 18, bits: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of each query. Each shard of the index, of about `block` rows, is built
    once for each `query_block` queries, which then stream past it."""

    def real(rows: DataFrame) -> DataFrame:
        kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return kept.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(usable(F.col("vec")))

    spark, rows, asked = index.sparkSession, real(index), real(queries)
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (x.filter(F.size("vec") == common["d"]) for x in (rows, asked))
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(most_sampled).collect()], np.float64)
    codes = spark.sparkContext.broadcast(learn(sample, k, bits))  # dimensions x bits
    shards, parts = -(-common["n"] // block), -(-max(asked.count(), 1) // query_block)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int")).withColumn("part", numbers(parts)).withColumn("asks", F.lit(False))
    right = asked.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(parts)).cast("int")).withColumn("shard", numbers(shards)).withColumn("asks", F.lit(True))

    def answers(ids: np.ndarray, x: np.ndarray, long_x: np.ndarray, index_: Block, own: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        found = []
        for vector, code, query in zip(q, codes.value.of(q), own.tolist(), strict=True):
            radius = codes.value.radius
            while True:
                near = index_.within(code, radius)
                near = near[ids[near] != query]
                if len(near) >= k or radius >= bits:
                    break
                radius = min(bits, radius + max(4, bits // 32))
            score = x[near] @ vector / (long_x[near] * np.linalg.norm(vector))
            top = np.lexsort((ids[near], -score))[:k]
            found += [(query, i, s) for i, s in zip(ids[near][top].tolist(), score[top].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query_id", "vec_id", "score"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come by shard and part, those of the index before the queries."""
        at, have, built = None, [], None
        for batch in batches:
            shard, part, asks, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "part", "asks", "id"))
            vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            edges = np.flatnonzero(np.diff(shard) | np.diff(part) | np.diff(asks.astype(np.int8))) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if (shard[low], part[low]) != at:
                    at, have, built = (shard[low], part[low]), [], None
                if not asks[low]:
                    have.append((ids[low:high], vectors[low:high]))
                elif have:
                    if built is None:
                        x = np.concatenate([v for _, v in have])
                        built = (np.concatenate([i for i, _ in have]), x, np.linalg.norm(x, axis=1), Block(codes.value.of(x)))
                    yield answers(*built, ids[low:high], vectors[low:high])

    keys = ["shard", "part"]
    dealt = left.unionByName(right).repartition(shards * parts, *keys).sortWithinPartitions(*keys, "asks")
    found = dealt.select(*keys, "asks", "id", "vec").mapInArrow(nearest, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows for each block of the index
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
