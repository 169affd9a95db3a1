"""A run of tags, carried over by the next, and rows that come later, one by one or all at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kelpie.operators import graph, ontology
from kelpie.operators.neighbours import VectorIndex
from kelpie.streaming import online

CENTRES = np.eye(8)[:3]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, vector array<double>")


def made(n=12, seed=1, start=0):
    rng = np.random.default_rng(seed)
    return [(start + i, CENTRES[i % 3] + rng.normal(size=8) * 0.05) for i in range(n)]


def edges_of(frame):
    near = graph.nearest_of_all(frame, "id", "vector", 3)
    return graph.similarity_edges(near, frame, "id", "vector")


def test_tags_are_carried_over(spark):
    first = vectors_of(spark, made(12))
    run = ontology.refreshed(edges_of(first), first, spark.createDataFrame([], "id long, tag long"), resolution=0.3)
    assert {(r["cluster"], r["tag"], r["members"], r["similarity"]) for r in run.candidates.collect()} == {(0, 1, 4, None), (1, 2, 4, None), (2, 3, 4, None)}
    assert {r["id"]: r["tag"] for r in run.members.collect()} == {i: i % 3 + 1 for i in range(12)}
    top = run.members.filter("place = 1").collect()
    sums = {r["id"]: r["degree"] for r in graph.degrees(edges_of(first)).collect()}
    assert all(sums[r["id"]] >= max(sums[i] for i in range(12) if i % 3 == r["cluster"]) - 1e-9 for r in top)

    # the next run: cluster 1's rows are gone, new ones of another kind are there; tags 1 and 3 stay, a new one is made
    other = [(100 + i, np.eye(8)[6] + np.random.default_rng(9 + i).normal(size=8) * 0.05) for i in range(4)]
    second = vectors_of(spark, [r for r in made(12) if r[0] % 3 != 1] + other)
    again = ontology.refreshed(edges_of(second), second, run.members.select("id", "tag"), resolution=0.3)
    tags = {r["cluster"]: (r["tag"], r["similarity"]) for r in again.candidates.collect()}
    assert (tags[0][0], tags[2][0], tags[100][0]) == (1, 3, 4)
    assert tags[0][1] > 0.99 and tags[100][1] is None


def test_numbers_follow_the_key(spark):
    rows = spark.range(0, 200, 2).withColumnRenamed("id", "k").repartition(7)
    assert {r["k"]: r["number"] for r in ontology.numbered(rows, "k").collect()} == {2 * i: i + 1 for i in range(100)}


def setup_run(spark, path):
    base = made(30)
    run = vectors_of(spark, base)
    members = spark.createDataFrame([(i, i % 3) for i, _ in base], "id long, cluster long")
    index = VectorIndex(spark, f"{path}/run").build(run, "id", "vector", 5)
    centroids = graph.centroids(members.join(run, "id"), "cluster", "vector")
    centres = VectorIndex(spark, f"{path}/centres").build(centroids, "cluster", "centroid", 1, cover=1.0)
    return index, centres, members


def test_any_split_into_batches_and_replays_give_the_batch_result(spark, tmp_path):
    index, centres, members = setup_run(spark, str(tmp_path))
    far = -CENTRES.sum(0) + np.eye(8)[5] * 0.1  # no neighbour is on its side: the nearest centroid
    new = made(20, seed=2, start=500) + [(900, far), (901, None), (902, np.zeros(8)), (3, CENTRES[0])]
    frame = vectors_of(spark, new)
    whole = {r["id"]: (r["cluster"], r["by"]) for r in ontology.assigned(frame, index, centres, members, 5).collect()}
    assert all(whole[500 + i] == (i % 3, "edge") for i in range(20))
    assert whole[900][1] == "centroid" and whole[901] == whole[902] == (None, None) and whole[3] == (0, "edge")

    schema, work = "id long, cluster long, by string", lambda b: ontology.assigned(b, index, centres, members, 5)
    for split in (1, 3):
        source, path = f"{tmp_path}/source{split}", f"{tmp_path}/online{split}"
        for k in range(split):
            frame.filter(F.abs(F.hash("id")) % split == k).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("id long, vector array<double>").option("maxFilesPerTrigger", 1).parquet(source)
            query = online.started(stream, path, work)
            query.awaitTermination()
            assert query.exception() is None
        got = online.state(spark, f"{path}/results", "id", schema)
        assert {r["id"]: (r["cluster"], r["by"]) for r in got.collect()} == whole
        # the first batch again
        online.by_batch(f"{path}/results", work)(frame.filter(F.abs(F.hash("id")) % split == 0), 0)
        again = online.state(spark, f"{path}/results", "id", schema)
        assert {r["id"]: (r["cluster"], r["by"]) for r in again.collect()} == whole
    assert online.state(spark, f"{tmp_path}/nowhere", "id", schema).collect() == []


def test_edges_of_groups_send_no_vector_for_each_pair(spark):
    """Vectors go to groups, so that the plan joins them once, and weights are those of the plain cosines."""
    frame = vectors_of(spark, made(30))
    near = graph.nearest_of_all(frame, "id", "vector", 3)
    edges = graph.similarity_edges(near, frame, "id", "vector")
    unit = {i: v / np.linalg.norm(v) for i, v in made(30)}
    group = {}
    for r in near.collect():
        group.setdefault(r["id"], {r["id"]}).add(r["other"])
    want = {(a, b): max(0.0, float(unit[a] @ unit[b])) for g in group.values() for a in g for b in g if a < b}
    got = {(r["first_id"], r["second_id"]): r["weight"] for r in edges.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(f"{join} ") for join in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) <= 2  # shown once or twice
