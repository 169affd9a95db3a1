"""Graphs as edge tables: first_id, second_id, weight."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.vectors import cosine_distance
from kelpie.operators import partition
from kelpie.operators.neighbours import nearest, unit_rows
from kelpie.plans.storage import cut


def pair_weights(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links counted by unordered pair, self-links left out."""
    pairs = links.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("first_id"), F.greatest(a, b).alias("second_id"))
    return pairs.groupBy("first_id", "second_id").agg(F.count("*").alias("weight"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("first_id").alias("id"), F.col("second_id").alias("other"), "weight").union(edges.select(F.col("second_id").alias("id"), F.col("first_id").alias("other"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return _ends(edges).groupBy("id").agg(F.sum("weight").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("first_id")), "first_id", "left_semi").join(nodes.select(F.col("id").alias("second_id")), "second_id", "left_semi")


def centrality(edges: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """The members (id, cluster) with most weight to members of their own cluster, ties by id."""
    own = members.select("id", "cluster")
    other = members.select(F.col("id").alias("other"), F.col("cluster").alias("theirs"))
    weight = _ends(edges).join(own, "id").join(other, "other").filter("cluster = theirs").groupBy("id").agg(F.sum("weight").alias("score"))
    scored = own.join(weight, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= most)


def assigned(edges: DataFrame, members: DataFrame) -> DataFrame:
    """For each node with edges, the cluster of most summed weight among its neighbours, ties by cluster."""
    votes = _ends(edges).join(members.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id", "cluster").agg(F.sum("weight").alias("votes"))
    place = Window.partitionBy("id").orderBy(F.desc("votes"), "cluster")
    return votes.filter("votes > 0").withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that edges lead to from the seeds (id), seeds included; each step is a table of its own, and it ends when nothing is
    new. Edges lead both ways, so a step meets nodes of the last two steps only, besides new ones."""
    steps = _ends(edges).select("id", "other")
    frontier = seen = cut(seeds.select("id").distinct())
    last = frontier.limit(0)
    while not frontier.isEmpty():
        known = frontier.union(last)
        last, frontier = frontier, cut(steps.join(frontier, "id", "left_semi").select(F.col("other").alias("id")).distinct().join(known, "id", "left_anti"))
        seen = seen.union(frontier)
    return seen


def kept_nodes(nodes: DataFrame, threshold: int) -> DataFrame:
    """Nodes (id, bucket, degree, pinned) to show: of a bucket with more than `threshold`, those of at least ceil(n / threshold)
    links, and pinned ones."""
    n = F.count("*").over(Window.partitionBy("bucket"))
    return nodes.withColumn("__n", n).filter((F.col("__n") <= threshold) | F.col("pinned") | (F.col("degree") >= F.ceil(F.col("__n") / threshold))).drop("__n")


def centroids(members: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean vector and number of members of each group; rows without a vector take no part."""
    there = members.filter(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("pos", "x"))
    means = there.groupBy(group, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    listed = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("dims"), F.max("n").alias("members"))
    return listed.select(group, F.transform("dims", lambda d: d["x"]).alias("centroid"), "members")


def nearest_of_all(vectors: DataFrame, id_col: str, vec_col: str, k: int, block: int = 16384) -> DataFrame:
    """id, other, distance and place of the k nearest others of each vector by cosine distance to nine places, ties by id.

    Exact; a task compares about `block` vectors with a slice of all. Vectors that can't be compared take no part."""
    kept = unit_rows(vectors, id_col, vec_col)
    return nearest(None, kept.withColumn("id", F.col("id").cast("long")), k, block)


def similarity_edges(near: DataFrame, vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Edges between all of a row and its neighbours (id, other: a bounded number for each id), weighed by similarity, none below 0.

    A row's vector goes to the groups it is in, where a group's products are made at once; pairs meet again by their first id, to which a
    group sends its other ids and weights in one row."""
    kind = near.schema["id"].dataType.simpleString()

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            unit = [None if v is None else _unit_or_zero(v) for v in some.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("other"), pa.array([None if u is None else u.tobytes() for u in unit], pa.binary())], names=["other", "v"])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for size, alike in some.groupby(some.g.map(len)):
                if size < 2:
                    continue
                ids = np.array([[m["other"] for m in g] for g in alike.g])
                x = np.frombuffer(b"".join(m["v"] for g in alike.g for m in g)).reshape(len(ids), size, -1)
                weight = np.maximum(np.minimum(x @ x.transpose(0, 2, 1), 1.0), 0.0)
                for at in range(size - 1):
                    yield pd.DataFrame({"first_id": ids[:, at], "others": list(ids[:, at + 1 :]), "weights": list(weight[:, at, at + 1 :])})

    members = near.select("id", "other").union(near.select("id", F.col("id").alias("other")).distinct())
    named = vectors.select(F.col(id_col).cast(kind).alias("other"), F.col(vec_col).cast("array<double>").alias("v")).filter("other is not null and v is not null").mapInArrow(as_bytes, f"other {kind}, v binary")
    groups = members.join(named, "other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "v"))).alias("g")).select("g")
    sent = groups.mapInPandas(multiply, f"first_id {kind}, others array<{kind}>, weights array<double>").repartition("first_id")
    each = sent.select("first_id", F.explode(F.arrays_zip("others", "weights")).alias("e")).select("first_id", F.col("e.others").alias("second_id"), F.col("e.weights").alias("weight"))
    return each.groupBy("first_id", "second_id").agg(F.max("weight").alias("weight"))


def _unit_or_zero(vector: list[float]) -> np.ndarray:
    x = np.array(vector, float)
    length = np.linalg.norm(x)
    return x / length if length > 0 else x


def matched(pairs: DataFrame, floor: float) -> DataFrame:
    """Greedy one-to-one matching of pairs (a, b, score) of at least the floor, best first, ties by a and b. Each round takes all
    pairs that are the best of both their ends, which gives the same matching."""
    left = cut(pairs.filter(F.col("score") >= floor).select("a", "b", "score"))
    order, taken = [F.desc("score"), F.col("a"), F.col("b")], []
    while not left.isEmpty():
        ranked = left.withColumns({f"__{end}": F.row_number().over(Window.partitionBy(end).orderBy(*order)) for end in ("a", "b")})
        ranked = ranked.withColumn("hit", (F.col("__a") == 1) & (F.col("__b") == 1))
        gone = [F.max("hit").over(Window.partitionBy(end)) for end in ("a", "b")]
        round_ = cut(ranked.withColumn("gone", gone[0] | gone[1]).filter("hit or not gone").select("a", "b", "score", "hit"))
        taken.append(round_.filter("hit").drop("hit"))
        left = round_.filter("not hit").drop("hit")
    out = left
    for t in taken:
        out = out.union(t)
    return out


def unit_choice(id_: Column) -> Column:
    """A number from 0 to 1 that only an id decides: a linear congruence of it as 64 bits without sign, in millionths."""
    whole = F.lit(Decimal(2**64))
    bits = id_.cast("decimal(20,0)") + F.when(id_ < 0, whole).otherwise(Decimal(0))
    return ((bits.cast("decimal(20,0)") * F.lit(Decimal(2862933555777941757)) + F.lit(Decimal(3037000493))) % whole % F.lit(Decimal(1000000))).cast("double") / 1000000


#: Up to so many links a level of communities is kept in one partition, where its joins need no shuffles.
_FEW_LINKS = 1 << 16


def _kept(frame: DataFrame, small: bool) -> DataFrame:
    """The frame as a stored table, of a small level in one partition."""
    return cut(frame.coalesce(1)).coalesce(1) if small else cut(frame)


def _pulls(nodes: DataFrame, both: DataFrame, group: str) -> DataFrame:
    """id, target and w: the weight of a node's links into each group that it has links into."""
    other = nodes.select(F.col("id").alias("other"), F.col(group).alias("target"))
    return both.hint("merge").join(other, "other").groupBy("id", "target").agg(F.sum("weight").alias("w"))


def _settled(best: DataFrame, resolution: float, least: float) -> DataFrame:
    """id and target of those moves (id, own, size, target, gain) that can be made at once, so that together they raise the quality.

    A group gives if the best move out of it is above the best into it, else it takes, so the best move of all is always made. Of
    the moves of one group, each has to gain after the sizes of those before it are charged, as if they weren't linked to it; so the
    sum of the charged gains is a lower bound, and no round need be put back."""
    key = F.struct("gain", -F.col("id"))
    sides = best.select(key.alias("key"), F.posexplode(F.array("own", "target")).alias("into", "side"))
    ends = sides.groupBy("side").agg(*(F.max(F.when(F.col("into") == k, F.col("key"))).alias(name) for k, name in enumerate(("out", "in"))))
    roles = ends.select("side", F.coalesce(F.col("out") > F.col("in"), F.col("in").isNull()).alias("gives"))
    chosen = best.hint("merge").join(roles.filter("gives").select(F.col("side").alias("own")), "own", "left_semi").hint("merge").join(roles.filter("not gives").select(F.col("side").alias("target")), "target", "left_semi")
    before = [F.coalesce(F.sum("size").over(Window.partitionBy(c).orderBy(F.desc("gain"), "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in ("own", "target")]
    return chosen.withColumn("before", before[0] + before[1]).filter(F.col("gain") - resolution * F.col("size") * F.col("before") > least).select("id", "target")


def _best_moves(nodes: DataFrame, both: DataFrame, resolution: float, least: float) -> DataFrame:
    """Each node's best move (id, own, size, target, gain) to the community of a neighbour, where it gains by one."""
    total = nodes.groupBy("comm").agg(F.sum("size").alias("total"))
    own = nodes.hint("merge").join(total.withColumnRenamed("total", "own_total"), "comm")
    pull = _pulls(nodes, both, "comm").hint("merge").join(own, "id").hint("merge").join(total.withColumnRenamed("comm", "target"), "target")
    within = F.coalesce(F.max(F.when(F.col("target") == F.col("comm"), F.col("w"))).over(Window.partitionBy("id")), F.lit(0.0))
    gain = F.col("w") - within - resolution * F.col("size") * (F.col("total") - F.col("own_total") + F.col("size"))
    better = pull.withColumn("gain", gain).filter((F.col("target") != F.col("comm")) & (F.col("gain") > least))
    best = better.groupBy("id", "comm", "size").agg(F.max_by("target", F.struct("gain", -F.col("target"))).alias("target"), F.max("gain").alias("gain"))
    return best.withColumnRenamed("comm", "own")


def _quality(nodes: DataFrame, both: DataFrame, resolution: float) -> float:
    """The weight within communities less the resolution times the pairs of sizes in them, the sizes' own squares included."""
    ends = both.hint("merge").join(nodes.select("id", "comm"), "id").hint("merge").join(nodes.select(F.col("id").alias("other"), F.col("comm").alias("far")), "other")
    within = ends.filter("comm = far").agg((F.coalesce(F.sum("weight"), F.lit(0.0)) / 2).alias("v"))
    pairs = nodes.groupBy("comm").agg(F.sum("size").cast("double").alias("total")).agg((F.coalesce(F.sum(F.col("total") * F.col("total")), F.lit(0.0)) * (-resolution / 2)).alias("v"))
    return sum(r["v"] for r in within.union(pairs).collect())


def _drawn(candidates: DataFrame, theta: float) -> DataFrame:
    """id, target and gain of one candidate (id, target, gain) of each id, with odds exp(gain / theta), by the number its id decides."""
    odds = candidates.withColumn("odds", F.exp(F.col("gain") / max(theta, 1e-6)))
    running = F.sum("odds").over(Window.partitionBy("id").orderBy("target").rowsBetween(Window.unboundedPreceding, 0))
    seen = odds.withColumn("running", running).hint("merge").join(odds.groupBy("id").agg(F.sum("odds").alias("all")), "id")
    reached = F.col("running") >= unit_choice(F.col("id")) * F.col("all")
    pick = F.coalesce(F.min(F.when(reached, F.struct("target", "gain"))), F.max(F.struct("target", "gain")))
    return seen.groupBy("id").agg(pick.alias("pick")).select("id", "pick.target", "pick.gain")


def _mergers(nodes: DataFrame, inside: DataFrame, members: DataFrame, resolution: float, theta: float, least: float, small: bool) -> DataFrame:
    """id and target of single nodes that join a part of their community: nodes (id, size, comm, part) and their links within communities.
    Both have to be linked well enough to the rest of the community, and the target is drawn."""
    parts = nodes.groupBy("part").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.first("comm").alias("comm"))
    degree = inside.groupBy("id").agg(F.sum("weight").alias("links"))
    single = nodes.hint("merge").join(parts.filter("n = 1").select("part"), "part", "left_semi").hint("merge").join(members, "comm").hint("merge").join(degree, "id")
    asks = single.filter(F.col("links") + least >= resolution * F.col("size") * (F.col("all") - 1)).select("id", "size")
    ends = inside.hint("merge").join(nodes.select("id", F.col("part").alias("one")), "id").hint("merge").join(nodes.select(F.col("id").alias("other"), F.col("part").alias("two")), "other")
    border = ends.filter("one <> two").groupBy(F.col("one").alias("part")).agg((F.sum("weight") / 2).alias("border"))
    takes = parts.hint("merge").join(members, "comm").hint("merge").join(border, "part").filter(F.col("border") + least >= resolution * F.col("total") * (F.col("all") - F.col("n")))
    pull = _pulls(nodes, inside, "part").filter("id <> target").hint("merge").join(asks, "id").hint("merge").join(takes.select(F.col("part").alias("target"), "total"), "target")
    gains = pull.withColumn("gain", F.col("w") - resolution * F.col("size") * F.col("total")).filter(F.col("gain") > least)
    best = _drawn(gains.select("id", "target", "gain"), theta).hint("merge").join(nodes.select("id", "size"), "id")
    return _settled(_kept(best.withColumn("own", F.col("id")), small), resolution, least)


def _refined(nodes: DataFrame, both: DataFrame, resolution: float, theta: float, least: float, small: bool) -> DataFrame:
    """id, size, comm and part: within each community, nodes start alone and single ones join parts, until none does."""
    ends = both.hint("merge").join(nodes.select("id", "comm"), "id").hint("merge").join(nodes.select(F.col("id").alias("other"), F.col("comm").alias("far")), "other")
    inside = _kept(ends.filter("comm = far").select("id", "other", "weight"), small)
    members = _kept(nodes.groupBy("comm").agg(F.count("*").alias("all")), small)
    parts = nodes.withColumn("part", F.col("id"))
    while True:
        joined = _mergers(parts, inside, members, resolution, theta, least, small)
        changed = _kept(parts.hint("merge").join(joined, "id", "left").select("id", "size", "comm", F.coalesce("target", "part").alias("part"), F.col("target").isNotNull().alias("moved")), small)
        if changed.filter("moved").isEmpty():
            return parts
        parts = changed.drop("moved")


def _all_moved(nodes: DataFrame, both: DataFrame, resolution: float, least: float, small: bool) -> tuple[DataFrame, bool]:
    """The nodes after rounds of moves, until none gains, and whether any moved.

    Of the nodes that gain a share by hash moves at once. Moves at once may hinder each other, so such a round counts only if the quality
    rose; else the share is halved, and below an eighth those moves are made that can't hinder each other."""
    any_moved, share, turn, before = False, 2, 0, None
    while True:
        best = _kept(_best_moves(nodes, both, resolution, least), small)
        if best.isEmpty():
            return nodes, any_moved
        before = _quality(nodes, both, resolution) if before is None else before
        while True:
            turn += 1
            bold = share <= 8
            moves = best.filter(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(share)) == 0).select("id", "target") if bold else _settled(best, resolution, least)
            changed = _kept(nodes.hint("merge").join(moves, "id", "left").select("id", "size", F.coalesce("target", "comm").alias("comm")), small)
            after = _quality(changed, both, resolution)
            if not bold or after > before + least:
                share = 4 if not bold else max(share // 2, 2)
                break
            share *= 2
        nodes, any_moved, before = changed, True, after


def _known_communities(edges: DataFrame, ids: np.ndarray, resolution: float, theta: float, least: float, most_levels: int) -> DataFrame:
    """The communities of a graph of at most partition.MOST_NODES nodes."""
    kind = edges.schema["first_id"].dataType.simpleString()
    found = partition.partitioned(edges, ids, resolution, theta, least, most_levels)
    _, first, group, n = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
    kept = n[group] > 1
    rows = pd.DataFrame({"id": ids[kept], "community_id": ids[first[group]][kept]})
    named = edges.sparkSession.createDataFrame(rows, "id long, community_id long")
    return named.select(*(F.col(c).cast(kind).alias(c) for c in named.columns))


def communities(edges: DataFrame, resolution: float = 0.05, theta: float = 0.01, least: float = 1e-7, most_levels: int = 64) -> DataFrame:
    """id and community_id (its smallest member) of nodes in communities of two or more, under the constant Potts model.

    Nodes move to the community of a neighbour that raises the quality most, until none gains, so that quality only rises and the
    moves end. Within each community nodes then start alone and join parts drawn by their gains; the
    parts are the nodes of the next level, in the communities found, and move as wholes, until refining joins nothing. All levels
    are gone through again from the communities found, until no single node gains by moving, so that neither a node nor a part of the
    last level does in the end. Parallel edges count together, self-links and those without positive weight are left out. Up to
    partition.MOST_NODES nodes the links stay packed and only the nodes' places are sent out; beyond, rounds are joins, many moves in each.
    Results can differ from those of sequential sweeps where several partitions are stable."""
    plain = edges.filter("first_id <> second_id and weight > 0").select(F.least("first_id", "second_id").alias("first_id"), F.greatest("first_id", "second_id").alias("second_id"), F.col("weight").cast("double").alias("weight"))
    plain = cut(plain)
    nodes = plain.select(F.explode(F.array("first_id", "second_id")).alias("id")).select(F.col("id").cast("long")).distinct()
    if nodes.count() <= partition.MOST_NODES:
        return _known_communities(plain, np.sort(nodes.toArrow()["id"].to_numpy()), resolution, theta, least, most_levels)
    links = cut(_ends(plain).groupBy("id", "other").agg(F.sum("weight").alias("weight")))
    small = links.count() <= _FEW_LINKS
    links = links.coalesce(1) if small else links
    found = _kept(links.select("id").distinct().select("id", F.lit(1).cast("long").alias("size"), F.col("id").alias("comm")), small)
    while True:
        nodes, moved = _all_moved(found, links, resolution, least, small)
        if not moved:
            break
        members, both, few = nodes.select(F.col("id").alias("member"), "id"), links, small
        for _ in range(most_levels):
            parts = _refined(nodes, both, resolution, theta, least, few)
            if parts.filter("part <> id").isEmpty():
                break
            place = parts.select("id", "part")
            members = _kept(members.hint("merge").join(place, "id").select("member", F.col("part").alias("id")), small)
            ends = both.hint("merge").join(place, "id").hint("merge").join(place.select(F.col("id").alias("other"), F.col("part").alias("far")), "other").filter("part <> far")
            both = _kept(ends.groupBy(F.col("part").alias("id"), F.col("far").alias("other")).agg(F.sum("weight").alias("weight")), few)
            few = few or both.count() <= _FEW_LINKS
            both = both.coalesce(1) if few else both
            nodes = _kept(parts.groupBy("part").agg(F.sum("size").alias("size"), F.first("comm").alias("comm")).select(F.col("part").alias("id"), "size", "comm"), few)
            nodes, _ = _all_moved(nodes, both, resolution, least, few)
        found = _kept(members.hint("merge").join(nodes.select("id", "comm"), "id").select(F.col("member").alias("id"), F.lit(1).cast("long").alias("size"), "comm"), small)
    named = found.groupBy("comm").agg(F.min("id").alias("community_id"), F.count("*").alias("n")).filter("n > 1")
    return found.join(named, "comm").select("id", "community_id")


def folders(paths: DataFrame, path: str) -> DataFrame:
    """All folders above the paths, with depth, parent and the number of paths below."""
    parts = paths.select(F.split(F.trim(F.regexp_replace(path, "/+", "/")), "/").alias("p"))
    each = parts.select("p", F.explode(F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1))).alias("depth"))
    named = each.select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("folder"), "depth", F.array_join(F.slice("p", 1, F.col("depth") - 1), "/").alias("parent"))
    return named.groupBy("folder", "depth", "parent").agg(F.count("*").alias("files"))


def pairs_of(vectors: DataFrame, id_col: str, vec_col: str, ids: list[int]) -> DataFrame:
    """All unordered pairs of the given ids with the cosine of their vectors; as many rows as the list asks for."""
    some = vectors.filter(F.col(id_col).isin(ids))
    one, two = some.select(F.col(id_col).alias("first_id"), F.col(vec_col).alias("x")), some.select(F.col(id_col).alias("second_id"), F.col(vec_col).alias("y"))
    return one.join(two, F.col("first_id") < F.col("second_id")).select("first_id", "second_id", (1 - cosine_distance(F.col("x"), F.col("y"))).alias("weight"))


def with_fallback(rows: DataFrame, by_edge: DataFrame, by_centroid: DataFrame) -> DataFrame:
    """id, cluster and by: the cluster by edges (id, cluster), or else by centroids; null where neither says."""
    both = rows.join(by_edge.select("id", F.col("cluster").alias("__e")), "id", "left").join(by_centroid.select("id", F.col("cluster").alias("__c")), "id", "left")
    said = F.when(F.col("__e").isNotNull(), "edge").when(F.col("__c").isNotNull(), "centroid")
    return both.select("id", F.coalesce("__e", "__c").alias("cluster"), said.alias("by"))


def community_inputs(edges: DataFrame, members: DataFrame, claims: DataFrame) -> DataFrame:
    """Of each community (members: id, community) the weight and number of edges within it and the number of its nodes' claims."""
    first = members.select(F.col("id").alias("first_id"), "community")
    second = members.select(F.col("id").alias("second_id"), F.col("community").alias("__other"))
    inside = edges.join(first, "first_id").join(second, "second_id").filter("community = __other").groupBy("community").agg(F.sum("weight").alias("weight"), F.count("*").alias("edges"))
    told = claims.groupBy("id").agg(F.count("*").alias("n")).join(members, "id").groupBy("community").agg(F.sum("n").alias("claims"))
    return inside.join(told, "community")


def dimension_bounds(vectors: DataFrame, vec_col: str) -> DataFrame:
    """dim, low, high and signed, whether a number is negative, of each dimension."""
    each = vectors.select(F.posexplode(vec_col).alias("dim", "v")).select("dim", F.col("v").cast("double").alias("v"))
    return each.groupBy("dim").agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.min("v") < 0).alias("signed"))


def context(nodes: DataFrame, edges: DataFrame, claims: DataFrame, seeds: DataFrame, communities: list, most: tuple[int, int, int] = (18, 24, 24)) -> DataFrame:
    """kind, id and other of the context of seeds (id) and communities: their nodes (id, community, weight), seeds first and then the
    heaviest; the heaviest edges with both ends among these; and their claims (claim_id, id), the smallest ids first."""
    mine = nodes.join(seeds.select("id").distinct().withColumn("__seed", F.lit(1)), "id", "left").filter(F.col("__seed").isNotNull() | (F.col("community").isin(communities) if communities else F.lit(False)))
    chosen = cut(mine.orderBy(F.col("__seed").desc_nulls_last(), F.desc("weight"), "id").limit(most[0]).select("id"))
    links = induced(edges, chosen).orderBy(F.desc("weight"), "first_id", "second_id").limit(most[1])
    told = claims.join(F.broadcast(chosen), "id", "left_semi").orderBy("claim_id").limit(most[2])  # at most most[0] rows
    parts = [chosen.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("long").alias("other")), links.select(F.lit("edge"), "first_id", "second_id"), told.select(F.lit("claim"), "claim_id", "id")]
    return parts[0].union(parts[1]).union(parts[2])


def neighbours_of(vectors: DataFrame, id_col: str, vec_col: str, asked: int, k: int) -> DataFrame:
    """other and distance of the k nearest of one row, itself left out, ties by id."""
    one = vectors.filter(F.col(id_col) == asked).select(F.col(vec_col).alias("__q"))
    far = vectors.filter(F.col(id_col) != asked).crossJoin(F.broadcast(one)).select(F.col(id_col).alias("other"), cosine_distance(F.col(vec_col), F.col("__q")).alias("distance"))  # one row
    return far.orderBy("distance", "other").limit(k)


def continuity(old: DataFrame, new: DataFrame, vectors: DataFrame, vec_col: str) -> DataFrame:
    """a, b and score of the pairs of old and new clusters (id, cluster) that share members: 0.7 of the members they share among those of
    the smaller, and 0.3 of the cosine of their centroids, 0 at least."""
    both = old.select("id", F.col("cluster").alias("a")).join(new.select("id", F.col("cluster").alias("b")), "id").groupBy("a", "b").agg(F.count("*").alias("shared"))
    middle = lambda c, name: centroids(c.join(vectors.select("id", vec_col), "id"), "cluster", vec_col).select(F.col("cluster").alias(name), F.col("centroid").alias(f"c{name}"), F.col("members").alias(f"n{name}"))
    pairs = both.join(middle(old, "a"), "a").join(middle(new, "b"), "b")
    alike = F.greatest(1 - cosine_distance(F.col("ca"), F.col("cb")), F.lit(0.0))
    return pairs.select("a", "b", (0.7 * F.col("shared") / F.least("na", "nb") + 0.3 * alike).alias("score"))


def similarity_matrix(left: DataFrame, right: DataFrame, vec_col: str) -> DataFrame:
    """a, b and cosine of every row of one small set (id, vector) with every row of the other: as many rows as the matrix has."""
    one, two = left.select(F.col("id").alias("a"), F.col(vec_col).alias("x")), right.select(F.col("id").alias("b"), F.col(vec_col).alias("y"))
    return one.crossJoin(two).select("a", "b", (1 - cosine_distance(F.col("x"), F.col("y"))).alias("cosine"))


def overlay_links(links: DataFrame, shown: DataFrame) -> DataFrame:
    """Distinct links (owner, node_id) to nodes that are shown (node_id), with the number of the owner's links."""
    there = links.select("owner", "node_id").distinct().join(shown.select("node_id"), "node_id", "left_semi")
    return there.join(there.groupBy("owner").agg(F.count("*").alias("links")), "owner")


def leaf_weights(leaves: DataFrame, title: str, text: str, kind: str, rerank: str) -> DataFrame:
    """The leaves with weight: a base by kind, parts of the lengths of title and text, and up to twice that by the rerank score."""
    base = F.when(F.col(kind) == "overview", 42.0).when(F.col(kind) == "activity", 34.0).otherwise(22.0)
    size = base + 0.65 * F.least(F.length(title), F.lit(80)) + 0.18 * F.least(F.length(text), F.lit(260))
    return leaves.withColumn("weight", size * (1 + F.greatest(F.least(F.coalesce(F.col(rerank), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))))
