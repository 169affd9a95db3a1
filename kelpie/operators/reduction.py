"""Fitting a reduction of vectors to a few dimensions, in which near neighbours stay near.

Affinities of nearest neighbours are an edge table, made symmetric and of sum 1. Points start on the leading principal axes, which
come from one d x d sum. Each round lowers the cross entropy between the edges' affinities and those of the reduced points (of
Student's kernel, over all pairs) by a step along its gradient.

What pairs give besides their affinities depends smoothly on their distance alone. So it is summed through a grid that is fine against the kernel's
width of 1: points are dealt to grid places by polynomials of degree 13, the grid's sums are convolutions, and points take theirs from the places by
the same polynomials. That leaves out no pair and equals the plain sums to some 1e-12 of the kernel; the work is that of points and edges. Few points,
those too far apart for a grid and those of over three dimensions are compared pair by pair. Edges stay packed where they lie, and
the driver knows the points' places. Beyond `MOST_POINTS` points are packed in blocks instead, a task has a pair of blocks and the edges between
them, and the work is that of all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.operators import partition
from kelpie.operators.neighbours import unit_rows
from kelpie.plans.storage import cut

#: Fixed values of the fit.
ROUNDS, RATE, PATIENCE, LEAST = 150, 0.05, 20, 1e-6
#: Beyond so many points their places aren't known to all; up to so many all is summed by pairs; tasks share the work beyond so many; a grid has
#: at most so many places with those that keep its ends apart, in steps of so much, and a point so many of them in each direction.
MOST_POINTS, FEW_POINTS, ALONE, MOST_PLACES, STEP, NODES = 1 << 21, 1024, 1 << 14, 1 << 22, 1 / 20, 14


def affinities(near: DataFrame, least: float = LEAST) -> DataFrame:
    """i, j and p of both directions of each pair of neighbours (id, other, distance): exp(-d / 2 s^2), s being the deviation of a point's
    distances to its neighbours, half the sum of both directions, over the sum of all."""
    spread = F.greatest(F.stddev_pop("distance").over(Window.partitionBy("id")), F.lit(least))
    one = cut(near.select(F.col("id").alias("i"), F.col("other").alias("j"), F.exp(-F.col("distance") / (2 * spread * spread)).alias("a")))
    both = one.union(one.select("j", "i", "a")).groupBy("i", "j").agg((F.sum("a") / 2).alias("a"))
    total = both.agg(F.greatest(F.sum("a"), F.lit(least)).alias("total"))
    return both.crossJoin(F.broadcast(total)).select("i", "j", (F.col("a") / F.col("total")).alias("p"))  # one row


def principal_axes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes (columns) of unit vectors (v): the sums of the vectors and of their products, d x d, are all that
    reaches the driver. An axis points to where its largest component is positive."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for some in batches:
            if len(some):
                x = np.stack(some.v.to_list())
                x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"at": np.arange(len(total)), "row": list(total)})

    parts = vectors.select("v").mapInPandas(add, "at int, row array<double>")
    each = parts.select("at", F.posexplode("row").alias("to", "x")).groupBy("at", "to").agg(F.sum("x").alias("x"))
    rows = each.toPandas()  # (d + 1) x (d + 1) numbers
    d = int(rows["at"].max())
    whole = np.zeros((d + 1, d + 1))
    whole[rows["at"], rows["to"]] = rows["x"]
    n, mean = whole[d, d], whole[d, :d] / whole[d, d]
    axes = np.linalg.eigh(whole[:d, :d] - n * np.outer(mean, mean))[1][:, ::-1][:, :dims]
    return mean, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def pair_sums(y: np.ndarray, z: np.ndarray, p: np.ndarray, same: bool, total: float, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Of points y against z with affinities p: for each of y the sums over z of G N^2 (y - z) and N^2 (y - z), and over all pairs the sum
    of G N and the loss. N is the kernel, G the loss's slope by the share N / total."""
    i, j = np.nonzero(p)
    mine, _, share, loss = both_sums(y, z, i, j, p[i, j], same, total, least)
    return mine[:, : y.shape[1]], mine[:, y.shape[1] :], share, loss


def both_sums(y: np.ndarray, z: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, same: bool, total: float, least: float = LEAST, step: int = 128) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The sums of `pair_sums` for each of y, and for each of z against y, side by side. Affinities a of the pairs (i, j), each once, are added
    to what pairs without any give. Some points of y are looked at at once, so that their products stay in the processor's cache."""
    d = y.shape[1]
    order = np.argsort(i, kind="stable")
    i, j, a = i[order], j[order], a[order]
    mine, theirs, share, loss = np.zeros((len(y), 2 * d)), np.zeros((len(z), 2 * d)), 0.0, 0.0
    for at in range(0, len(y), step):
        some = y[at : at + step]
        kernel = _kernel(some, z, False, least)
        own = (np.arange(len(some)), np.arange(at, at + len(some)))
        if same:
            kernel[own] = 0
        q = kernel / total
        q += least
        np.clip(q, least, 1 - least, out=q)
        rest = 1 + least - q
        slope = (1 - least) / rest - least / q
        loss -= least * np.log(q).sum() + (1 - least) * np.log(rest).sum()
        of = slice(*np.searchsorted(i, [at, at + len(some)]))
        pair, more = (i[of] - at, j[of]), a[of]
        slope[pair] -= more * (1 / q[pair] + 1 / rest[pair])
        loss -= (more * (np.log(q[pair]) - np.log(rest[pair]))).sum()
        if same:
            slope[own] = 0
        share += np.vdot(slope, kernel)
        square = kernel * kernel
        for k, force in enumerate((slope * square, square)):
            side = slice(k * d, (k + 1) * d)
            mine[at : at + step, side] = some * force.sum(1)[:, None] - force @ z
            theirs[:, side] += z * force.sum(0)[:, None] - force.T @ some
    return mine, theirs, float(share), float(loss)


def _kernel(y: np.ndarray, z: np.ndarray, same: bool, least: float) -> np.ndarray:
    far = np.maximum((y * y).sum(1)[:, None] + (z * z).sum(1) - 2 * y @ z.T, 0)
    kernel = 1 / (1 + far + least)
    if same:
        np.fill_diagonal(kernel, 0)
    return kernel


def _of_kernel(kernel: np.ndarray, total: float, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The slope of pairs without affinity, by their kernel, and their loss above that of pairs far apart."""
    x = np.minimum(kernel / total, 1 - 2 * least)
    over = x / least
    return over / (1 + over) + (x - least) / (1 - x), -least * np.log1p(over) - (1 - least) * np.log1p(-x)


def _edge_sums(row: partition.Row, y: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Nodes of a row of links and what their affinities add to `both_sums`: the first sums of each, the share, the loss above that of links
    far apart, and the affinities' sum."""
    node, other, a = row.ends()
    apart = y[node] - y[other]
    kernel = 1 / (1 + (apart * apart).sum(1) + LEAST)
    x = np.minimum(kernel / total, 1 - 2 * LEAST)
    slope = -a * (1 / (x + LEAST) + 1 / (1 - x))
    first = np.append(0, row.upto[:-1])
    return row.node, np.add.reduceat((slope * kernel * kernel)[:, None] * apart, first, axis=0), float(slope @ kernel), float(-(a @ (np.log1p(x / LEAST) - np.log1p(-x)))), float(a.sum())


def _weights(t: np.ndarray) -> np.ndarray:
    """The polynomials of the NODES places 0, 1 and so on at a place t past the last one left of the middle."""
    k = np.arange(NODES)
    x = (t + NODES // 2 - 1)[:, None] - k
    before, after = np.ones_like(x), np.ones_like(x)
    np.cumprod(x[:, :-1], axis=1, out=before[:, 1:])
    after[:, :-1] = np.cumprod(x[:, :0:-1], axis=1)[:, ::-1]
    scale = np.array([np.prod([c - j for j in k if j != c], dtype=float) for c in k])
    return before * after / scale


def _cells(y: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.floor((y - low) / STEP).astype(np.int64)


def _in_cells(y: np.ndarray, low: np.ndarray):  # noqa: ANN202
    """Slices of points that come cell by cell, each cell and its points' weights: those of the first two directions together, and of the last."""
    cell = _cells(y, low)
    starts = np.flatnonzero((np.diff(cell, axis=0, prepend=-1) != 0).any(1)).tolist()
    one, two, three = (_weights(x) for x in ((y - low) / STEP - cell).T)
    for at, upto in zip(starts, [*starts[1:], len(y)], strict=True):
        of = slice(at, upto)
        yield of, cell[at], (one[of, :, None] * two[of, None, :]).reshape(upto - at, -1), three[of]


def _spread(y: np.ndarray, low: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """How much of the points is at each place."""
    grid = np.zeros(shape)
    for _, (a, b, c), first, last in _in_cells(y, low):
        grid[a : a + NODES, b : b + NODES, c : c + NODES] += (first.T @ last).reshape(NODES, NODES, NODES)
    return grid


def _taken(y: np.ndarray, low: np.ndarray, grids: np.ndarray) -> np.ndarray:
    """The grids' values at the points, side by side."""
    out = np.zeros((len(y), len(grids)))
    for of, (a, b, c), first, last in _in_cells(y, low):
        some = grids[:, a : a + NODES, b : b + NODES, c : c + NODES].reshape(len(grids), NODES * NODES, NODES)
        out[of] = np.einsum("gnk,nk->ng", first @ some, last)
    return out


class _Points:
    """Sums over all pairs of points, each known by its place, without their affinities."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.shape, self.kernels = spark, None, {}

    def each(self, work, y: np.ndarray, *known: object) -> list:  # noqa: ANN001
        """What the work says of parts of the points in their order."""
        if len(y) <= ALONE:
            return [work(y, *known)]
        block = ALONE // 4
        shared = self.spark.sparkContext.broadcast((y, known))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            points, rest = shared.value
            for some in batches:
                for at in some["id"].tolist():
                    yield pd.DataFrame({"at": [at], "v": [pickle.dumps(work(points[at * block : (at + 1) * block], *rest))]})

        blocks = -(-len(y) // block)
        said = sorted(self.spark.range(0, blocks, 1, min(blocks, 4096)).mapInPandas(run, "at long, v binary").collect())
        shared.destroy()
        return [pickle.loads(r["v"]) for r in said]

    def look(self, y: np.ndarray) -> float:
        """Know these places; the sum of the kernel over all pairs."""
        n, d = y.shape
        self.y, self.grid = y, None
        low, high = (np.pad(x, (0, max(0, 3 - d))) for x in (y.min(0), y.max(0)))
        whole = _whole(2 * int(np.floor((high - low).max() / STEP) + NODES + 1))
        if n <= FEW_POINTS or d > 3 or whole**3 > MOST_PLACES:
            return float(sum(self.each(lambda some, all_: sum(_kernel(some[a : a + 128], all_, False, LEAST).sum() for a in range(0, len(some), 128)), y, y))) - n / (1 + LEAST)
        place = np.pad(y, ((0, 0), (0, 3 - d)))
        self.low, self.order = low, np.lexsort(_cells(place, low).T[::-1])
        self.sorted, self.whole = place[self.order], whole
        half = (whole // 2,) * 3
        self.grid = np.fft.rfftn(sum(self.each(_spread, self.sorted, low, half)), (whole,) * 3, (0, 1, 2))
        if self.shape != whole:
            far = np.minimum(np.arange(whole), whole - np.arange(whole)) * STEP
            side = np.where(np.arange(whole) < whole // 2, far, -far)
            self.shape, self.side = whole, side
            self.kernel = 1 / (1 + far[:, None, None] ** 2 + far[None, :, None] ** 2 + far**2 + LEAST)
            self.squares = [np.fft.rfftn(self._along(self.kernel**2, k)) for k in range(3)]
            self.whole_kernel = np.fft.rfftn(self.kernel)
        return self._over_pairs(self.whole_kernel) - n / (1 + LEAST)

    def _along(self, x: np.ndarray, k: int) -> np.ndarray:
        """The numbers by distance times the distance in a direction."""
        return x * self.side.reshape([-1 if k == j else 1 for j in range(3)])

    def _over_pairs(self, spectrum: np.ndarray) -> float:
        power = spectrum.real * (self.grid.real**2 + self.grid.imag**2)
        twice = power[:, :, 1 : -1 if self.whole % 2 == 0 else None].sum()
        return float(power.sum() + twice) / self.whole**3

    def sums(self, total: float) -> tuple[np.ndarray, float, float]:
        """`both_sums` of all points against all, the loss above that of points far apart."""
        n, d = self.y.shape
        if self.grid is None:
            none = np.zeros(0, int)
            said = self.each(lambda some, all_: both_sums(some, all_, none, none, np.zeros(0), False, total), self.y, self.y)
            share, loss = (sum(s[k] for s in said) for k in (2, 3))
            loss += n * n * LEAST * np.log(LEAST)
            mine = np.concatenate([s[0] for s in said])
        else:
            slope, losses = _of_kernel(self.kernel, total)
            share, loss = (self._over_pairs(np.fft.rfftn(x)) for x in (slope * self.kernel, losses))
            spectra = [np.fft.rfftn(self._along(slope * self.kernel**2, k)) for k in range(d)] + self.squares[:d]
            half = slice(0, self.whole // 2)
            fields = np.stack([np.fft.irfftn(x * self.grid, (self.whole,) * 3, (0, 1, 2))[half, half, half] for x in spectra])
            mine = np.zeros((n, 2 * d))
            mine[self.order] = np.concatenate(self.each(_taken, self.sorted, self.low, fields))
        slope, losses = _of_kernel(np.array(1 / (1 + LEAST)), total)
        return mine, float(share - n * slope / (1 + LEAST)), float(loss - n * losses)  # each with itself counts as far apart


def _whole(least: int) -> int:
    """The next even number that has no large prime factors."""
    at = least + least % 2
    while True:
        rest = at
        for f in (2, 3, 5):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return at
        at += 2


def _known_rounds(spark: SparkSession, y: np.ndarray, edges: partition.Level, rounds: int, rate: float, patience: int) -> tuple[np.ndarray, list[float]]:
    """Places after the rounds, and the losses. What a round gains is far less than the loss of many points, so what doesn't change is added
    only to tell it."""
    points, d = _Points(spark), y.shape[1]
    best, stalled, losses = float("inf"), 0, []
    for _ in range(rounds):
        total = max(points.look(y), LEAST)
        mine, share, loss = points.sums(total)
        affinity = 0.0
        for node, more, more_share, more_loss, sum_ in edges.each(_edge_sums, y, total):
            mine[node, :d] += more
            share, loss, affinity = share + more_share, loss + more_loss, affinity + sum_
        losses.append(float(loss - (len(y) ** 2 * LEAST + affinity) * np.log(LEAST)))
        best, stalled = (loss, 0) if loss < best else (best, stalled + 1)
        y = y + 4 * rate * (mine[:, :d] / total - share / total**2 * mine[:, d:])
        if stalled >= patience:
            break
    return y, losses


@dataclass(frozen=True)
class Fit:
    """Points (id, vector, reduced) and the loss before each round's step."""

    model: DataFrame
    losses: list[float]


def _stacked(column: pd.Series) -> list[np.ndarray]:
    return [np.stack(list(x)) for x in column]


def _packed(points: DataFrame) -> DataFrame:
    """Blocks with their points' positions in order of their place; as many as a block holds meet in one row."""
    return points.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "id", "y"))).alias("points"))


def _rounds(points: DataFrame, pairs: DataFrame, dims: int, rounds: int, rate: float, patience: int) -> tuple[DataFrame, list[float]]:
    """Points after the rounds, and the losses; pairs (one, two, i, j, p) are packed edges between blocks, each two blocks being there once, and
    each block with itself. Affinities and kernel are symmetric, so that two blocks' sums are made at once for both."""
    names = [f"{n}{k}" for n in "ab" for k in range(dims)]
    sums = ", ".join(f"{name} double" for name in names)

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            found = [_kernel(y, z, one == two, LEAST).sum() * (1 if one == two else 2) for y, z, one, two in zip(_stacked(some.y), _stacked(some.z), some.one, some.two, strict=True)]
            yield pd.DataFrame({"total": found})

    def slopes(total: float):  # noqa: ANN202
        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in batches:
                for row, y, z in zip(some.itertuples(), _stacked(some.y), _stacked(some.z), strict=True):
                    same = row.one == row.two
                    mine, theirs, share, loss = both_sums(y, z, np.asarray(row.i, int), np.asarray(row.j, int), np.asarray(row.p, float), same, total)
                    for ids, found in ((row.ids, mine),) if same else ((row.ids, mine), (row.others, theirs)):
                        one_row = np.arange(len(found)) == 0
                        yield pd.DataFrame(found, columns=names).assign(id=np.asarray(ids), share=np.where(one_row, share, 0.0), loss=np.where(one_row, loss, 0.0))

        return look

    best, stalled, losses = float("inf"), 0, []
    for _ in range(rounds):
        packed = _packed(points)
        y = F.transform("points", lambda x: x["y"])
        left = packed.select(F.col("block").alias("one"), y.alias("y"), F.transform("points", lambda x: x["id"]).alias("ids"))
        met = pairs.join(left, "one").join(packed.select(F.col("block").alias("two"), y.alias("z"), F.transform("points", lambda x: x["id"]).alias("others")), "two")
        total = max(met.select("one", "two", "y", "z").mapInPandas(kernels, "total double").agg(F.sum("total")).first()[0], LEAST)
        by_pair = met.mapInPandas(slopes(total), f"{sums}, id long, share double, loss double")
        each = cut(by_pair.groupBy("id").agg(*(F.sum(c).alias(c) for c in (*names, "share", "loss"))))
        share, loss = each.agg(F.sum("share"), F.sum("loss")).first()
        losses.append(loss)
        best, stalled = (loss, 0) if loss < best else (best, stalled + 1)
        push = share / total**2
        step = F.array(*(-4 * rate * (F.col(f"a{k}") / total - push * F.col(f"b{k}")) for k in range(dims)))
        points = cut(points.join(each, "id").withColumn("y", F.zip_with("y", step, lambda a, b: a - b)).select("id", "block", "at", "y"))
        if stalled >= patience:
            break
    return points, losses


def fitted(vectors: DataFrame, near: DataFrame, id_col: str, vec_col: str, dims: int = 3, rounds: int = ROUNDS, rate: float = RATE, patience: int = PATIENCE, block: int = 1024) -> Fit:
    """The reduction of vectors given their neighbours (id, other, distance).

    Vectors that can't be compared by angle aren't in the model; one vector alone, or none, is reduced to zeros. It stops early after
    `patience` rounds without a better loss. The forces between two points cancel out, so the points' mean stays 0."""
    rows = unit_rows(vectors, id_col, vec_col)
    n = rows.count()
    if n < 2:
        return Fit(rows.select("id", F.col("v").alias("vector"), F.array_repeat(F.lit(0.0), dims).alias("reduced")), [])
    mean, axes = principal_axes(rows, dims)
    blocks = -(-n // block)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))

    def start(axis: np.ndarray) -> Column:
        along = F.aggregate(F.zip_with("v", F.array(*map(F.lit, axis.tolist())), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
        return along / length - float(mean @ axis)

    first = F.array(*(start(axes[:, k]) for k in range(axes.shape[1])), *(F.lit(0.0) for _ in range(dims - axes.shape[1])))
    if n <= MOST_POINTS:
        return _known_fit(rows.withColumn("y", first), affinities(near), rounds, rate, patience)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("y", first)
    place = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1  # of a block's points
    points = cut(dealt.select("id", "block", place.alias("at"), "y"))
    edges = affinities(near)
    at = lambda side, name: points.select(F.col("id").alias(side), F.col("block").alias(name), F.col("at").alias(f"{side}_at"))
    placed = edges.join(at("i", "one"), "i").join(at("j", "two"), "j")
    listed = placed.filter("one <= two").groupBy("one", "two").agg(F.collect_list(F.struct("i_at", "j_at", "p")).alias("e"))  # a point has few neighbours
    numbers = points.sparkSession.range(blocks).select(F.col("id").cast("int").alias("one"))
    every = numbers.select("one", F.explode(F.sequence("one", F.lit(blocks - 1))).alias("two")).join(listed, ["one", "two"], "left")
    part = lambda name: F.coalesce(F.transform("e", lambda x: x[name]), F.array())
    pairs = cut(every.select("one", "two", part("i_at").cast("array<int>").alias("i"), part("j_at").cast("array<int>").alias("j"), part("p").cast("array<double>").alias("p")).repartition("one", "two"))
    points, losses = _rounds(points, pairs, dims, rounds, rate, patience)
    return Fit(rows.join(points, "id").select("id", F.col("v").alias("vector"), F.col("y").alias("reduced")), losses)


def _known_fit(points: DataFrame, edges: DataFrame, rounds: int, rate: float, patience: int) -> Fit:
    """Of points (id, v, y) whose places all can know."""
    spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
    there = points.select(F.col("id").cast("long").alias("id"), *(F.col("y")[k].alias(f"y{k}") for k in range(len(points.select("y").first()[0])))).toArrow()
    ids = there["id"].to_numpy()
    order = np.argsort(ids)
    ids, y = ids[order], np.column_stack([c.to_numpy()[order] for c in there.columns[1:]])
    known = points.select(F.col("id").alias("i"))
    once = edges.filter("i < j").join(known, "i", "left_semi").join(known.withColumnRenamed("i", "j"), "j", "left_semi")
    links = partition.level_of(cut(once.select(F.col("i").alias("first_id"), F.col("j").alias("second_id"), F.col("p").alias("weight"))), ids, np.ones(len(ids)))
    y, losses = _known_rounds(spark, y, links, rounds, rate, patience)
    found = spark.createDataFrame(pa.table({"id": ids, **{f"y{k}": y[:, k] for k in range(y.shape[1])}}))
    reduced = found.select(F.col("id").cast(kind), F.array(*(f"y{k}" for k in range(y.shape[1]))).alias("reduced"))
    return Fit(points.select("id", F.col("v").alias("vector")).join(reduced, "id"), losses)
