"""Refinement of communities: the number an id decides, the draw, parts, and stability of nodes and parts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from kelpie.operators import graph


def plain_unit(i: int) -> float:
    return (((i % 2**64) * 2862933555777941757 + 3037000493) % 2**64) % 1_000_000 / 1_000_000


def test_an_id_decides_its_number(spark):
    ids = [0, 1, 2, -1, -5, 7, 2**62, -(2**63), 2**63 - 1, 12345678901]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", graph.unit_choice(F.col("id")).alias("u")).collect()
    assert {r["id"]: r["u"] for r in rows} == {i: plain_unit(i) for i in ids}


def test_candidates_are_drawn_by_their_gains(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 10 * t, round(float(rng.random()) * 0.03, 4)) for i in range(40) for t in range(1 + i % 4)]
    rows += [(99, 5, 100.0), (99, 6, 1.0)]  # odds beyond all numbers
    want = {}
    for i in {r[0] for r in rows}:
        mine = sorted((t, g) for j, t, g in rows if j == i)
        odds = [math.exp(g / 0.01) if g < 7 else math.inf for _, g in mine]
        least, run = plain_unit(i) * sum(odds), 0.0
        for (t, _), o in zip(mine, odds, strict=True):
            run += o
            if run >= least:
                want[i] = t
                break
    drawn = graph._drawn(spark.createDataFrame(rows, "id long, target long, gain double"), 0.01)
    assert {r["id"]: r["target"] for r in drawn.collect()} == want


def both_of(spark, weight):
    n = len(weight)
    return spark.createDataFrame([(a, b, float(weight[a, b])) for a in range(n) for b in range(n) if weight[a, b] > 0], "id long, other long, weight double")


def test_parts_are_connected_within_their_communities(spark):
    """Two cliques that one community holds, without a link between them: no part spans both, none of their nodes stays alone (parts join in
    the next level), and a community's only node does."""
    weight = np.zeros((9, 9))
    for group in (range(4), range(4, 8)):
        for a in group:
            for b in group:
                weight[a, b] = float(a != b)
    nodes = spark.createDataFrame([(i, 1, 100 if i < 8 else 200) for i in range(9)], "id long, size long, comm long")
    parts = {r["id"]: r["part"] for r in graph._refined(nodes, both_of(spark, weight), 0.05, 0.01, 1e-7, True).collect()}
    assert parts[8] == 8
    groups = {p: {i for i in range(8) if parts[i] == p} for p in set(parts[i] for i in range(8))}
    assert all(g <= set(range(4)) or g <= set(range(4, 8)) for g in groups.values())
    assert all(len(g) > 1 and min(g) <= p <= max(g) for p, g in groups.items())


def test_no_node_and_no_part_gains_by_moving(spark):
    rng, n, resolution = np.random.default_rng(3), 60, 0.1
    weight = np.zeros((n, n))
    for a in range(n):
        for b in range(a):
            if rng.random() < (0.5 if a % 4 == b % 4 else 0.05):
                weight[a, b] = weight[b, a] = round(float(rng.random()), 3)
    edges = spark.createDataFrame([(a, b, float(weight[a, b])) for a in range(n) for b in range(a) if weight[a, b] > 0], "first_id long, second_id long, weight double")
    found = {r["id"]: r["community_id"] for r in graph.communities(edges, resolution).collect()}
    label = np.array([found.get(i, i) for i in range(n)])
    value = weight - resolution

    def gains(group: np.ndarray) -> float:
        """What the group gains by the best move to a community that it is linked to."""
        inside = np.isin(np.arange(n), group)
        linked = {c for c in set(label.tolist()) if weight[np.ix_(inside, ~inside & (label == c))].sum() > 0}
        score = {c: value[np.ix_(inside, ~inside & (label == c))].sum() for c in linked | {label[group[0]]}}
        return max(score.values()) - score[label[group[0]]]

    assert max(gains(np.array([v])) for v in range(n)) <= 1e-6
    assert all(found[k] == min(i for i in found if found[i] == found[k]) for k in found)
    nodes = spark.createDataFrame([(i, 1, int(label[i])) for i in range(n)], "id long, size long, comm long")
    parts = {r["id"]: r["part"] for r in graph._refined(nodes, both_of(spark, weight), resolution, 0.01, 1e-7, True).collect()}
    for p in set(parts.values()):
        group = np.array([i for i in range(n) if parts[i] == p])
        assert len(set(label[group].tolist())) == 1
        assert gains(group) <= 1e-6
