"""Neighbours through the index against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.operators import graph
from kelpie.operators.neighbours import VectorIndex, learned_probes


def frame_of(spark, vectors, more=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + list(more), "i long, v array<double>")


def plain(vectors, k):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    far = np.round(1 - unit @ unit.T, 9) + 0.0
    np.fill_diagonal(far, np.inf)
    return {(i, int(j)) for i in range(len(vectors)) for j in np.argsort(far[i], kind="stable")[:k]}


STRANGE = [(5000, [0.0] * 8), (5001, None), (5002, [1.0, 2.0]), (5003, [float("nan")] * 8), (None, [1.0] * 8)]


@pytest.mark.parametrize(("per_list", "piece"), [(1024, 4096), (40, 16)])
def test_all_lists_looked_through_are_exact(spark, tmp_path, per_list, piece):
    vectors = np.random.default_rng(1).normal(size=(90, 8))
    vectors[7] = vectors[3]
    index = VectorIndex(spark, str(tmp_path / "x"), piece).build(frame_of(spark, vectors, STRANGE), "i", "v", 4, per_list, cover=1.0)
    found = index.nearest_of_all(4)
    want = plain(vectors, 4)
    got = {(r["id"], r["other"]) for r in found.collect()}
    centres, probes = index.learned()
    assert got == want if probes == len(centres) else len(got & want) >= 0.97 * len(want)
    assert found.groupBy("id").count().filter("count <> 4").count() == 0


def test_recall_and_work_on_clusters(spark, tmp_path):
    """Recall at 45 is 0.9 or more, and of the lists only a share is looked through."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    vectors = np.concatenate([c + rng.normal(size=(50, 16)) * 0.3 for c in centres])
    index = VectorIndex(spark, str(tmp_path / "x")).build(frame_of(spark, vectors), "i", "v", 45, per_list=60)
    learned, probes = index.learned()
    assert len(learned) == 50 and probes <= 20
    got = {(r["id"], r["other"]) for r in index.nearest_of_all(45).collect()}
    want = plain(vectors, 45)
    assert len(got & want) >= 0.9 * len(want)
    one = [r["other"] for r in index.nearest_to(vectors[9].tolist(), 45, F.col("id") == 9).collect()]
    assert len(one) == 45 and len(set(one) & {b for a, b in want if a == 9}) >= 40
    plan = index.nearest_to(vectors[9].tolist(), 45)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_one_hot_list_is_looked_through_in_pieces(spark, tmp_path):
    vectors = np.concatenate([np.repeat(np.random.default_rng(3).normal(size=(1, 8)), 200, 0), np.random.default_rng(4).normal(size=(40, 8))])
    index = VectorIndex(spark, str(tmp_path / "x"), piece=32).build(frame_of(spark, vectors), "i", "v", 5, per_list=40, cover=1.0)
    got = {}
    for r in index.nearest_of_all(5).collect():
        got.setdefault(r["id"], []).append((r["distance"], r["other"]))
    assert sorted(got[0]) == [(0.0, j) for j in (1, 2, 3, 4, 5)]
    assert sorted(got[199]) == [(0.0, j) for j in (0, 1, 2, 3, 4)]


def test_nothing_to_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "x")).build(frame_of(spark, np.zeros((0, 8)), STRANGE[:2]), "i", "v")
    assert index.nearest_of_all(3).collect() == []
    assert index.nearest_to([1.0], 3).collect() == []


def test_probes_cover_the_sample():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(300, 8))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    assert learned_probes(sample, sample[:1], 5, 0.97) == 1
    assert 1 < learned_probes(sample, sample[:30], 5, 1.0) <= 30


def test_exact_neighbours_of_mixed_lengths(spark):
    vectors = np.random.default_rng(6).normal(size=(30, 8))
    frame = frame_of(spark, vectors, STRANGE)
    assert {(r["id"], r["other"]) for r in graph.nearest_of_all(frame, "i", "v", 3).collect()} == plain(vectors, 3)


def test_one_vector_finds_exactly_its_nearest_whatever_lists_are_probed(spark, tmp_path):
    """A sample's probes don't hold all neighbours; other lists are opened as long as they may hold a nearer one."""
    vectors = np.random.default_rng(8).normal(size=(400, 8))
    index = VectorIndex(spark, str(tmp_path / "x")).build(frame_of(spark, vectors), "i", "v", 5, per_list=20, cover=0.01)
    want, (learned, probes) = plain(vectors, 5), index.learned()
    assert probes < len(learned) == 20
    for one in (3, 77, 200):
        found = index.nearest_to(vectors[one].tolist(), 5, F.col("id") == one).collect()
        assert {(one, r["other"]) for r in found} == {(a, b) for a, b in want if a == one}
    asked = spark.createDataFrame([(i, (2 * vectors[i]).tolist()) for i in range(0, 400, 7)], "id long, v array<double>")
    assert {(r["id"], r["other"]) for r in index.nearest_of(asked, 5).collect()} == {(a, b) for a, b in want if a % 7 == 0}


def test_groups_and_slices_give_the_same_neighbours(spark):
    vectors = np.random.default_rng(9).normal(size=(130, 8))
    vectors[40:60] = vectors[3]
    for block in (130, 6):
        found = graph.nearest_of_all(frame_of(spark, vectors), "i", "v", 4, block).collect()
        assert {(r["id"], r["other"]) for r in found} == plain(vectors, 4)
        assert sorted(r["place"] for r in found if r["id"] == 50) == [1, 2, 3, 4]
