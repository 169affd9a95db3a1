"""Graph, merge, search and parsing operators on small fixtures and against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import text as tx
from kelpie.operators import analytics, graph, merge, search
from kelpie.plans import knowledge_queries


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "first_id long, second_id long, weight double")


def groups_of(frame):
    return {r["id"]: r["community_id"] for r in frame.collect()}


CLIQUES = [(a, b, 1) for base in (1, 5) for a in range(base, base + 4) for b in range(a + 1, base + 4)]


@pytest.mark.parametrize(
    ("rows", "resolution", "want"),
    [
        ([(1, 2, 1), (1, 3, 1), (2, 3, 1), (4, 5, 1), (4, 6, 1), (5, 6, 1)], 0.05, {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}),
        ([*CLIQUES, (4, 5, 1)], 0.5, {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5}),
        ([(21, 22, 1), (30, 31, 1), (7, 7, 5), (8, 9, 0)], 0.05, {21: 21, 22: 21, 30: 30, 31: 30}),
        ([], 0.05, {}),
    ],
)
def test_communities(spark, rows, resolution, want):
    assert groups_of(graph.communities(edges_of(spark, rows), resolution)) == want


def test_communities_are_stable(spark):
    """No single node gains by moving to another community."""
    rng = np.random.default_rng(3)
    weight = np.zeros((8, 8))
    for a in range(8):
        for b in range(a):
            weight[a, b] = weight[b, a] = rng.random() < (0.8 if a % 2 == b % 2 else 0.1)
    found = groups_of(graph.communities(edges_of(spark, [(a, b, weight[a, b]) for a in range(8) for b in range(a)]), 0.4))
    label = np.array([found.get(i, i) for i in range(8)])
    for v in range(8):
        others = np.arange(8) != v
        score = {c: (weight[v] - 0.4)[others & (label == c)].sum() for c in set(label.tolist())}
        assert score[label[v]] >= max(score.values()) - 1e-6


def test_nearest_of_all(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(90, 8))
    vectors[7] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(500, [0.0] * 8), (501, None)]
    frame = spark.createDataFrame(rows, "i long, v array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    far = np.round(1 - unit @ unit.T, 9)
    np.fill_diagonal(far, np.inf)
    want = {(i, int(j)) for i in range(90) for j in np.argsort(far[i], kind="stable")[:4]}
    for block in (2048, 20):
        assert {(r["id"], r["other"]) for r in graph.nearest_of_all(frame, "i", "v", 4, block).collect()} == want
    assert graph.nearest_of_all(frame.limit(0), "i", "v", 4).count() == 0


def test_greedy_matching(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), float(s)) for a in range(12) for b in range(10) for s in [rng.integers(0, 6) / 5]]
    want, used = set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if s >= 0.6 and ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.add((a, b))
    got = graph.matched(spark.createDataFrame(rows, "a long, b long, score double"), 0.6)
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, None, True)], "k long, summary string, done boolean")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "n")], "k long, summary string")
    got = merge.with_invalidation(old, new, "k", "summary", {"done": F.lit(False)})
    assert sorted(map(tuple, got.collect())) == [(1, "a", True), (2, "x", False), (3, None, True), (4, "n", False)]
    assert sorted(r["k"] for r in merge.inserted(old.select("k"), new.union(new).select("k"), ["k"]).collect()) == [1, 2, 3, 4]
    firsts = merge.first_wins([old.select("k", "summary"), new], "k", [F.col("summary")])
    assert {(r["k"], r["pass"]) for r in firsts.collect()} == {(1, 0), (2, 0), (3, 0), (4, 1)}


def test_validity_and_maps(spark):
    tags = spark.createDataFrame([(1, "2024-01-02", None), (2, "2024-01-01", "2024-01-03"), (3, "2024-01-04", None)], "id long, create_date string, delete_date string")
    assert sorted(r["id"] for r in analytics.valid_on(tags, F.lit("2024-01-03")).collect()) == [1, 2]
    days = spark.createDataFrame([("d", "zen", 1), ("d", None, 2), ("d", "Admin", 3)], "day string, tag string, seconds long")
    assert [t["label"] for t in analytics.day_tag_maps(days, F.col("tag")).first()["tags"]] == ["Admin", "zen", "Untagged"]


def test_search_parts(spark):
    docs = spark.createDataFrame([(1, "the quarterly Approval, done"), (2, "approval quarterly"), (3, None)], "id long, t string")
    assert [(r["id"], r["phrases"]) for r in search.phrase_hits(docs, "id", F.col("t"), ["quarterly approval", "export"]).collect()] == [(1, 1)]
    files = spark.createDataFrame([("notes/a.md", 1), ("b", 2), ("c.markdown", 3), ("b", 9)], "alias string, file_id long")
    links = spark.createDataFrame([("./notes/A.md",), ("x/b.txt",), ("c",), ("zzz",), (None,)], "dst string")
    assert {r["dst"]: r["file_id"] for r in search.resolved_links(links, "dst", files).collect()} == {"./notes/A.md": 1, "x/b.txt": 2, "c": 3, "zzz": None, None: None}


def test_parsers(spark):
    front = "---\ntitle: 'A b'\nkind: x\nkind: y\n- no\n---\nbody: z"
    row = spark.createDataFrame([("intro\nName: One \nSummary: two", 'say\n```json\n{"a": 1}\n```\nend', "30 MB", front)], "a string, b string, c string, d string")
    row = row.select(tx.labelled_line(F.col("a"), "Name"), tx.labelled_line(F.col("a"), "Other"), tx.fenced_json(F.col("b")), tx.human_size(F.lit("30MB")), tx.human_size(F.lit("x")), tx.frontmatter(F.col("d")), tx.frontmatter(F.lit("none")), tx.keywords(F.lit("The Q4 ledger a ledger"), ["the"])).first()
    assert tuple(row) == ("One", None, '{"a": 1}', 30 << 20, None, {"title": "A b", "kind": "y"}, {}, ["q4", "ledger"])


def test_many_rounds_of_communities_end(spark):
    """Sixty nodes in six groups with a few links between them: rounds stay cheap, and no two communities gain by joining."""
    rng = np.random.default_rng(5)
    weight = np.zeros((60, 60))
    for a in range(60):
        for b in range(a):
            weight[a, b] = weight[b, a] = rng.random() if rng.random() < (0.7 if a % 6 == b % 6 else 0.05) else 0
    found = groups_of(graph.communities(edges_of(spark, [(a, b, weight[a, b]) for a in range(60) for b in range(a)]), 0.2))
    label = np.array([found.get(i, i) for i in range(60)])
    for one in set(label.tolist()):
        for two in set(label.tolist()) - {one}:
            assert (weight - 0.2)[np.ix_(label == one, label == two)].sum() <= 1e-6
    assert 1 < len(set(label.tolist())) < 30


def test_graph_queries_read_the_whole_tables(spark, tmp_path):
    """Communities are of all embeddings, and the matching is of all suppliers and parts of lineitem."""
    rows = [(i, [1.0 if j == i % 3 else 0.01 * (i + j) / 9 for j in range(3)]) for i in range(9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    lines = [(a, b, float(1 + (a * 7 + b) % 5)) for a in range(40) for b in range(a, a + 3)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r["id"] for r in knowledge_queries.g1_communities(spark, str(tmp_path)).collect()} == set(range(9))
    got = knowledge_queries.g6_greedy_matching(spark, str(tmp_path)).collect()
    assert len(got) > 25 and len({r["a"] for r in got}) == len({r["b"] for r in got}) == len(got)


def test_far_nodes_and_descendants(spark):
    """A chain of over 64 steps is reached to its end, and a grandchild's score gets to the top; an unscored level between passes it on."""
    chain = edges_of(spark, [(i, i + 1, 1) for i in range(68)])
    got = [r["id"] for r in graph.reachable(chain, spark.createDataFrame([(0,)], "id long")).collect()]
    assert sorted(got) == list(range(69))
    scores = spark.createDataFrame([("top", 1.0), ("leaf", 9.0), ("child", 3.0)], "id string, score double")
    parents = spark.createDataFrame([("leaf", "mid"), ("mid", "top"), ("child", "top"), ("top", None)], "id string, parent string").filter("parent is not null")
    assert {r["id"]: r["score"] for r in search.rolled_up(scores, parents).collect()} == {"top": 9.0, "mid": 9.0, "leaf": 9.0, "child": 3.0}
