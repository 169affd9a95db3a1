"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label whose cosine is at least the limit are, as unit vectors, within a distance epsilon. Distinct vectors are
projected on the leading principal axes, where no distance grows, and sorted by label and the cells of a grid of width epsilon. The
sequence is cut into blocks, and intervals of 16 blocks, of 16 such intervals and so on are described by their box on the axes,
a centre and a radius. Pairs of intervals are joined recursively from the longest down, a level for each join: a pair whose boxes are
farther apart than epsilon holds no link and is left; a pair so close that all its vectors must be linked is settled as a whole; any
other pair is split. Only pairs of blocks that remain meet in a task, where the recursion goes on over halves of both until they are
short enough for one product of matrices in double precision.

What a task gives is the number of links of each vector and links that connect what is connected, never all pairs. Components come
from these by rounds of stars. A group of copies is one vector with a weight. Axes are learned on at most `most_sampled` vectors of
the commonest length; they decide how much is skipped, not what is found. A group of n vectors that are all linked but too wide to be
settled as a whole is compared in blocks, n / block rows for each vector: that is the price of exact numbers of links.

Cases: vectors that are null, zero or hold null or non-finite numbers, and rows whose id or label is null, link with nothing (n_links 0);
their component is their own id, and they are kept. Vectors of differing lengths are never linked. Labels are equal if they
are as strings. Each row counts: equal vectors are linked with each other, rows that repeat an id are rows of their own, and a
component is named by the smallest id in it. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import rows_of, stored
from kelpie.llm.neardup import components
from kelpie.llm.resampling import numbered

_FAN = 16  # children of an interval
_SLACK = 1e-9  # distances are known better than that
_LEAF = 64  # vectors of an interval that is not halved


def usable(vec: Column) -> Column:
    """Whether all numbers of a vector are finite and one is not 0."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, so that no square is too large or small; cosines stay as they are."""
    _, power = np.frexp(np.abs(vectors).max(1))
    return np.ldexp(vectors, -power[:, None])


def axes_of(sample: np.ndarray, dims: int) -> np.ndarray:
    """The leading principal axes of unit vectors, as columns."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :dims]


def on_axes(unit: np.ndarray, axes: np.ndarray | None, dims: int) -> np.ndarray:
    """Coordinates on the axes, or the first ones of vectors of another length, filled up with 0."""
    seen = unit @ axes if axes is not None and len(axes) == unit.shape[1] else unit[:, :dims]
    return np.pad(seen, ((0, 0), (0, dims - seen.shape[1])))


def _gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    return float(np.sqrt((np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum()))


class Interval:
    """A run of the sequence as vectors, lengths and coordinates."""

    def __init__(self, vectors: np.ndarray, seen: np.ndarray, norms: np.ndarray) -> None:
        self.vectors, self.seen, self.norms = vectors, seen, norms

    def __len__(self) -> int:
        return len(self.vectors)

    def halves(self) -> list[tuple[int, Interval]]:
        mid = len(self) // 2
        return [(0, self.part(0, mid)), (mid, self.part(mid, len(self)))]

    def part(self, low: int, high: int) -> Interval:
        return Interval(self.vectors[low:high], self.seen[low:high], self.norms[low:high])


def join(a: Interval, b: Interval, limit: float, out: np.ndarray, same: bool = False) -> None:
    """Mark in `out` which vectors of a and b are linked; of an interval and itself what is on and above the diagonal will do."""
    epsilon = (2 - 2 * limit) ** 0.5
    if not same and _gap(a.seen.min(0), a.seen.max(0), b.seen.min(0), b.seen.max(0)) > epsilon + _SLACK:
        return
    if max(len(a), len(b)) <= _LEAF:
        out |= a.vectors @ b.vectors.T / (a.norms[:, None] * b.norms) >= limit
        return
    for i, x in a.halves() if len(a) > _LEAF else [(0, a)]:
        for j, y in b.halves() if len(b) > _LEAF else [(0, b)]:
            if not same or i <= j:
                join(x, y, limit, out[i : i + len(x), j : j + len(y)], same and i == j)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the rows of a symmetric matrix as all of them do."""
    open_, found = linked.sum(1) > linked.diagonal(), []
    while open_.any():
        reached = np.array([int(open_.argmax())])
        open_[reached] = False
        while len(reached):
            new = linked[reached] & open_
            fresh = np.flatnonzero(new.any(0))
            found += zip(reached[new[:, fresh].argmax(0)].tolist(), fresh.tolist(), strict=True)
            open_[fresh] = False
            reached = fresh
    return found


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _box(rows: DataFrame, dims: int) -> list[Column]:
    low = F.array(*(F.min(F.col("low")[k]) for k in range(dims))).alias("low")
    return [low, F.array(*(F.max(F.col("high")[k]) for k in range(dims))).alias("high")]


def _parents(nodes: DataFrame, dims: int) -> DataFrame:
    """The intervals of 16 nodes each: weight, first number, box, centre and radius, from at most 16 rows a group."""
    grouped = nodes.groupBy("grp", F.floor(F.col("node") / _FAN).alias("node")).agg(
        F.sum("weight").alias("weight"), F.min("leader").alias("leader"), *_box(nodes, dims), F.collect_list(F.struct("centre", "radius")).alias("parts")
    )
    added = F.aggregate("parts", F.transform(F.col("parts")[0]["centre"], lambda _: F.lit(0.0)), lambda s, p: F.zip_with(s, p["centre"], lambda x, y: x + y))
    centred = grouped.withColumn("centre", F.transform(added, lambda x: x / F.size("parts")))
    radius = F.array_max(F.transform("parts", lambda p: _distance(F.col("centre"), p["centre"]) + p["radius"]))
    return centred.withColumn("radius", radius).drop("parts")


def _judged(pairs: DataFrame, epsilon: float) -> DataFrame:
    """Pairs a, b of nodes (structs) whose boxes are near, and whether all their vectors must be linked."""
    gap = F.aggregate(
        F.zip_with(F.zip_with("a.low", "b.high", lambda x, y: x - y), F.zip_with("b.low", "a.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))),
        F.lit(0.0), lambda s, x: s + x * x,
    )
    near = pairs.filter(gap <= (epsilon + _SLACK) ** 2)
    return near.withColumn("whole", _distance(F.col("a.centre"), F.col("b.centre")) + F.col("a.radius") + F.col("b.radius") <= epsilon - _SLACK)


def interval_pairs(blocks: DataFrame, levels: int, dims: int, epsilon: float) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The pairs of blocks (grp, a, b) to be compared, and for each level the pairs of nodes that are linked as wholes."""
    tree = [blocks]
    for _ in range(levels):
        tree.append(stored(_parents(tree[-1], dims), "intervals"))
    node = F.struct("node", "weight", "leader", "low", "high", "centre", "radius")
    open_ = tree[-1].select("grp", node.alias("a"), node.alias("b"))
    wholes = []
    for level in range(levels, -1, -1):
        seen = stored(_judged(open_, epsilon).select("grp", F.struct("a.node", "a.weight", "a.leader").alias("a"), F.struct("b.node", "b.weight", "b.leader").alias("b"), "whole"), "pairs")
        wholes.append((level, seen.filter("whole")))
        rest = seen.filter("not whole").select("grp", F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        if level == 0:
            return rest, wholes
        kids = tree[level - 1].select("grp", F.floor(F.col("node") / _FAN).alias("above"), node.alias("node"))
        left = rest.join(kids.select("grp", F.col("above").alias("a"), F.col("node").alias("x")), ["grp", "a"])
        both = left.join(kids.select("grp", F.col("above").alias("b"), F.col("node").alias("y")), ["grp", "b"])
        open_ = both.filter("x.node <= y.node").select("grp", F.col("x").alias("a"), F.col("y").alias("b"))
    raise AssertionError


def _sequence(vectors: DataFrame, axes: dict[int, np.ndarray], dims: int, epsilon: float, block: int) -> DataFrame:
    """The distinct vectors in grid order: grp, one and two (hashes), weight, least (id), data, number and block; stored."""
    learned = vectors.sparkSession.sparkContext.broadcast(axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [v for (v,) in rows_of([batch], "vec")]
            size = np.array([len(v) for v in rows])
            data, cells = [b""] * len(rows), [[]] * len(rows)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d).tolist()
                some = scaled(np.array([rows[k] for k in at], np.float64))
                seen = on_axes(some / np.linalg.norm(some, axis=1, keepdims=True), learned.value.get(d), dims)
                for k, vector, cell in zip(at, some, np.floor(seen / epsilon).astype(np.int64).tolist(), strict=True):
                    data[k], cells[k] = vector.astype("<f8").tobytes(), cell
            names = ["grp", "one", "two", "weight", "least"]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(data, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], [*names, "data", "cells"])

    kinds = "grp string, one long, two long, weight long, least long, data binary, cells array<long>"
    distinct = vectors.groupBy("grp", "one", "two", "vec").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    placed = stored(distinct.mapInArrow(place, kinds), "placed")
    order = ["grp", *(F.col("cells")[k] for k in range(dims)), "one", "two"]
    counted = numbered(placed, *order).withColumnRenamed("rank", "number").drop("cells")
    return stored(counted.withColumn("block", F.floor(F.col("number") / block)), "sequence")


def _blocks(sequence: DataFrame, axes: dict[int, np.ndarray], dims: int) -> DataFrame:
    """The blocks as nodes of level 0; stored."""
    learned = sequence.sparkSession.sparkContext.broadcast(axes)

    def describe(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["data"].to_pylist()), "<f8").reshape(table.num_rows, -1)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        seen, centre = on_axes(unit, learned.value.get(x.shape[1]), dims), unit.mean(0)
        radius = float(np.linalg.norm(unit - centre, axis=1).max())
        row = {"grp": table["grp"][0].as_py(), "node": table["block"][0].as_py(), "weight": sum(table["weight"].to_pylist()), "leader": min(table["number"].to_pylist())}
        return pa.Table.from_pylist([row | {"low": seen.min(0).tolist(), "high": seen.max(0).tolist(), "centre": centre.tolist(), "radius": radius}])

    kinds = "grp string, node long, weight long, leader long, low array<double>, high array<double>, centre array<double>, radius double"
    return stored(sequence.select("grp", "block", "weight", "number", "data").groupBy("grp", "block").applyInArrow(describe, kinds), "blocks")


def _compared(sequence: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], dims: int, limit: float) -> DataFrame:
    """number and links (weights of the vectors linked) of each vector in a pair of blocks, and the other end of links that connect."""
    learned = sequence.sparkSession.sparkContext.broadcast(axes)

    def answer(rows: list[tuple], one: int, two: int) -> pa.RecordBatch:
        number, weight, block = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        x = np.frombuffer(b"".join(r[3] for r in rows), "<f8").reshape(len(rows), -1)
        norms = np.linalg.norm(x, axis=1)
        whole = Interval(x, on_axes(x / norms[:, None], learned.value.get(x.shape[1]), dims), norms)
        first = int((block == one).sum())
        linked = np.zeros((len(rows), len(rows)), bool)
        if one == two:
            join(whole, whole, limit, linked, same=True)
            np.fill_diagonal(linked, True)
        else:
            join(whole.part(0, first), whole.part(first, len(rows)), limit, linked[:first, first:])
        linked |= linked.T
        sums = linked.astype(np.float64) @ weight
        met = np.flatnonzero(sums)
        ends = spanning(linked)
        near, far = [number[[e[k] for e in ends]].tolist() if ends else [] for k in (0, 1)]
        numbers = [*number[met].tolist(), *near]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([*sums[met].astype(np.int64).tolist(), *[None] * len(ends)], pa.int64()), pa.array([*[None] * len(met), *far], pa.int64())], ["number", "links", "other"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for grp, one, two, *row in rows_of(batches, "grp", "one", "two", "number", "weight", "block", "data"):
            if (grp, one, two) != at:
                if rows:
                    yield answer(rows, *at[1:])
                at, rows = (grp, one, two), []
            rows.append(tuple(row))
        if rows:
            yield answer(rows, *at[1:])

    ends = pairs.select("grp", F.col("a").alias("block"), F.col("a").alias("one"), F.col("b").alias("two"))
    ends = ends.union(pairs.filter("a < b").select("grp", F.col("b").alias("block"), F.col("a").alias("one"), F.col("b").alias("two")))
    keys = ["grp", "one", "two"]
    dealt = sequence.select("grp", "block", "number", "weight", "data").join(ends, ["grp", "block"]).select(*keys, "block", "number", "weight", "data")
    return stored(dealt.repartition(*keys).sortWithinPartitions(*keys, "number").mapInArrow(compare, "number long, links long, other long"), "compared")


def _settled(sequence: DataFrame, blocks: DataFrame, wholes: list[tuple[int, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """What the pairs that are linked as wholes add to each vector's links (number, links), and their links (a, b)."""
    added, links = [], []
    for level, pairs in wholes:
        ends = pairs.select("grp", F.col("a.node").alias("node"), F.col("b.weight").alias("add"), F.col("a.leader").alias("leader"))
        ends = ends.union(pairs.filter("a.node < b.node").select("grp", "b.node", "a.weight", "b.leader"))
        marks = ends.groupBy("grp", "node").agg(F.sum("add").alias("add"), F.min("leader").alias("leader"))
        below = blocks.select("grp", F.floor(F.col("node") / _FAN**level).alias("node"), F.col("node").alias("block"))
        added.append(below.join(marks, ["grp", "node"]).select("grp", "block", "add", "leader"))
        links.append(pairs.select(F.col("a.leader").alias("a"), F.col("b.leader").alias("b")))
    each = sequence.select("grp", "block", "number").join(reduce(DataFrame.union, added), ["grp", "block"])
    return each.select("number", F.col("add").alias("links")), reduce(DataFrame.union, links).union(each.select(F.col("leader").alias("a"), F.col("number").alias("b")))


def near_duplicates(vectors: DataFrame, limit: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", dims: int = 16, block: int = 1024, most_sampled: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    epsilon = (2 - 2 * limit) ** 0.5
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    takes_part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))
    # Distinct vectors are told apart by 128 bits.
    keyed = rows.select("id", F.when(takes_part, F.concat(F.size("vec").cast("string"), F.lit(":"), "label")).alias("grp"), F.xxhash64("vec").alias("one"), F.xxhash64(F.lit(1), "vec").alias("two"), "vec")
    real = keyed.filter("grp is not null")
    common = real.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    own = keyed.select("id", "grp", "one", "two")
    if common is None:
        return own.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sample = real.filter(F.size("vec") == common["d"]).select("one", "id", "vec").orderBy(F.xxhash64("id"), "id", "one").limit(most_sampled)
    unit = scaled(np.array([r["vec"] for r in sample.collect()], np.float64))
    axes = {common["d"]: axes_of(unit / np.linalg.norm(unit, axis=1, keepdims=True), dims)}
    sequence = _sequence(real, axes, dims, epsilon, block)
    blocks = _blocks(sequence, axes, dims)
    last, levels = blocks.agg(F.max("node")).first()[0], 0
    while last >= _FAN**levels:
        levels += 1
    pairs, wholes = interval_pairs(blocks, levels, dims, epsilon)
    compared = _compared(sequence, pairs, axes, dims, limit)
    added, links = _settled(sequence, blocks, wholes)
    counts = compared.filter("links is not null").select("number", "links").union(added).groupBy("number").agg(F.sum("links").alias("links"))
    comps = stored(components(compared.filter("other is not null").select(F.col("number").alias("a"), F.col("other").alias("b")).union(links)).distinct(), "components")
    named = sequence.select("grp", "one", "two", "number", "least").join(counts, "number", "left").join(comps, sequence["number"] == comps["doc_id"], "left")
    named = stored(named.select("grp", "one", "two", "least", "links", F.coalesce("comp", "number").alias("comp")), "named")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "comp").select("grp", "one", "two", "links", "component_id")
    seen = own.join(classes, ["grp", "one", "two"], "left")
    found = seen.select("id", F.coalesce(F.col("links") - 1, F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


VECTOR_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
