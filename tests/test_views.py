"""Views, extraction, notes and parsing on small fixtures and against plain versions."""

import datetime as dt
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from kelpie.functions import parsing as ps
from kelpie.operators import extraction, views
from kelpie.plans import view_queries
from kelpie.sources import notes


def estimate(text):
    return max(len(text.split()) * 4 // 3, len(text) // 4, 1)


def rendered(header, items):
    return "\n".join([header.strip(), "", *(f"### Evidence {i + 1}\n{x.strip()}" for i, x in enumerate(items))]).strip()


@pytest.mark.parametrize("header", ["Some header of words", ""])
def test_evidence_is_packed_as_whole_prompts_say(spark, header):
    draw, limit, instructions = random.Random(4), 60, "Be brief."
    rows = [(g, i, " ".join("w" * draw.randint(1, 9) for _ in range(draw.choice([1, 5, 12, 20])))) for g in ("a", "b", None) for i in range(30)]
    got = extraction.packed_evidence(spark.createDataFrame(rows, "g string, i long, t string"), "g", "i", "t", header, instructions, limit).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        prompts = []
        for text in (t for k, _, t in rows if k == g):
            if prompts and estimate(rendered(header, [*prompts[-1], text])) + estimate(instructions) <= limit:
                prompts[-1].append(text)
            else:
                prompts.append([text])
        mine = {}
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["prompt"], r["place"])):
            mine.setdefault(r["prompt"], []).append(r["text"])
        assert [mine[k] for k in sorted(mine)] == prompts


def test_long_evidence_is_cut_and_nothing_is_lost(spark):
    words, lines = " ".join(f"w{i}" for i in range(400)), "\n".join(f"line {i} of a text that goes on" for i in range(60))
    rows = [(1, 0, words), (1, 1, lines), (1, 2, "x" * 3000), (1, 3, None), (2, 0, "short")]
    got = extraction.packed_evidence(spark.createDataFrame(rows, "g long, i long, t string"), "g", "i", "t", "H", "", 80).orderBy("g", "prompt", "place").collect()
    said = [r["text"].removeprefix(extraction.PREFIX) for r in got]
    whole = " ".join(said)
    assert [w for w in whole.split() if w.startswith("w")] == words.split()
    assert all(x in said for x in lines.split("\n"))
    assert sum(len(x) for x in said if set(x) == {"x"}) == 3000
    prompts = {}
    for r in got:
        prompts.setdefault((r["g"], r["prompt"]), []).append(r["text"])
    assert all(estimate(rendered("H", p)) <= 80 for p in prompts.values())
    assert extraction.packed_evidence(spark.createDataFrame([], "g long, i long, t string"), "g", "i", "t", "H", "", 80).count() == 0


def test_answers_with_repeats_and_rubbish(spark):
    text = "name: before\n## Entities\nstray\nname: Acme\nname: Acme Two\ntype: Organization\ndescription:\nmakes: things\n---\n---\nname: Bo 1\ntype: person\ndescription: d\n more\nclaims:\n- a\n-b\n-  \n## Relationships\nsource: A\ntarget: B\ntype:\ndescription: x"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no sections")], "k long, t string")
    got = extraction.entities(rows, "k", "t").collect()
    assert [(r["id"], r["name"], r["description"], r["claims"]) for r in got] == [(1, "Bo 1", "d more", ["a"])]
    assert extraction.relationships(rows, "k", "t").count() == 0


def test_front_matter_with_lists(spark):
    texts = ["---\ntitle: 'A: b'\naliases: [x, \"y\"]\ntags:\n - one\n  - two\nother\n- lost\ntitle: last\nempty: []\n---\nbody", "none", None, "---\nopen: 1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ps.frontmatter_lists(F.col("t"))).collect()]
    assert got[0] == {"title": ["last"], "aliases": ["x", "y"], "tags": ["one", "two"], "empty": []}
    assert got[1] == {} and got[2] is None and got[3] == {}


def test_options_messages_and_prompts(spark):
    row = spark.range(1).select(
        ps.options(F.lit("a=1, b = two ,c,a=3")).alias("o"), ps.options(F.lit("a=")).alias("p"), ps.message(F.lit('{"importance": " High ", "content": 5}')).alias("m"),
        ps.message(F.lit('```\n{"importance": " High ", "content": " x "}\n```')).alias("n"), ps.prompt(F.lit("q"), F.lit("s" * 90), F.array(F.lit("t")), 8050).alias("long"),
        ps.prompt(F.lit("q"), F.lit(None).cast("string"), F.array(F.lit("t" * 5000), F.lit("u" * 5000)), 9000, (5000, 10)).alias("tight"),
    ).first()
    assert row["o"] == {"a": "3", "b": "two"} and row["p"] is None
    assert tuple(row["m"]) == (None, '{"importance": " High ", "content": 5}') and tuple(row["n"]) == ("high", "x")
    assert row["long"] is None and row["tight"] == "q\n\n" + "t" * 10 + "\n" + "u" * 10


def test_metadata_of_pages(spark):
    linked = '<script type="application/ld+json">[{"@type":"Person","name":"P"},{"@type":"NewsArticle","headline":"Head  line","author":[{"name":"A"},"B"],"datePublished":"2024-01-02"}]</script>'
    pages = [
        f'<head><title>T</title><link href="https://x.org/a" rel="canonical">{linked}</head>',
        '<meta property="og:title" content="O"><meta content="M" name="author"><title>T</title>',
        '<script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"G"}]}</script>',
        '<script type="application/ld+json">{broken</script><title> T\n2 </title>',
        None,
    ]
    got = [tuple(r["m"]) for r in spark.createDataFrame(list(enumerate(pages)), "i long, h string").orderBy("i").select(ps.page_metadata(F.col("h")).alias("m")).collect()]
    assert got[0] == ("https://x.org/a", "Head line", "A, B", "2024-01-02")
    assert got[1] == ("", "O", "M", "") and got[2] == ("", "G", "", "") and got[3] == ("", "T 2", "", "") and got[4] == ("", "", "", "")


def test_notes_are_written_in_order_and_stale_ones_found(spark, tmp_path):
    groups = spark.createDataFrame([(1, "One/a", "About"), (2, None, None)], "community_id long, name string, summary string")
    members = spark.createDataFrame([(1, i, f"m{i}", None) for i in range(300)] + [(2, 999, "far", "d")], "community_id long, node_id long, name string, description string")
    links = spark.createDataFrame([(0, 999, "knows"), (0, 1, None)], "node_id long, target_id long, type string")
    lines = notes.community_notes(groups, members, links, spark.createDataFrame([(999, "a.md")], "node_id long, path string"))
    folder = str(tmp_path / "vault")
    for _ in range(2):
        notes.write_notes(lines, folder)
    first = spark.read.text(f"{folder}/file=One a.md").collect()
    assert len(first) == 3 + 300 * 3 + 3
    assert {"- [m0 knows far](<Community 2.md#node-999>)", "- [m1](<#node-1>)"} <= {r[0] for r in first}
    parts = sorted(os.listdir(f"{folder}/file=One a.md"))
    whole = [x for p in parts if p.startswith("part") for x in open(f"{folder}/file=One a.md/{p}").read().splitlines()]
    assert whole[:3] == ["# One/a", "About", "## Members"] and [x for x in whole if x.startswith("### ")] == [f"### m{i}" for i in range(300)]
    known = spark.createDataFrame([("One a.md",), ("Gone.md",)], "file string")
    assert [r[0] for r in notes.stale(known, lines).collect()] == ["Gone.md"]


def test_pages_become_notes(spark):
    rows = [(1, "# A *fine*\nday", "https://x.org/p", 'Say "hi"'), (2, " ", "https://x.org/a/last/?q=1", None), (3, None, None, None)]
    pages = spark.createDataFrame([(i, m, u, t, dt.datetime(2024, 1, 2, 3, 4, 5)) for i, m, u, t in rows], "page_id long, markdown string, url string, title string, captured_at timestamp_ntz")
    got = {r["page_id"]: r for r in notes.page_notes(pages).collect()}
    assert [got[i]["file"] for i in (1, 2, 3)] == ["2024-01-02-030405-a-fine-day.md", "2024-01-02-030405-last.md", "2024-01-02-030405-page.md"]
    assert got[1]["text"] == "---\ntitle: \"Say 'hi'\"\nsource_url: \"https://x.org/p\"\ncaptured_at: \"2024-01-02T03:04:05Z\"\n---\n\n# A *fine*\nday\n"


def test_matrices_hold_every_vector(spark):
    frame = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(1000)], "id long, v array<float>")
    got = {i: struct.unpack_from("<2f", r["data"], 8 * n) for r in notes.matrices(frame, "id", "v", 2, 64).collect() for n, i in enumerate(r["ids"])}
    assert got == {i: (float(i), 0.5) for i in range(1000)}
    with pytest.raises(Exception, match="not of 3 numbers"):
        notes.matrices(frame, "id", "v", 3).collect()


def test_models_are_bounded_and_odd_vectors_null(spark, monkeypatch):
    model = spark.createDataFrame([(1, [1.0, 0.0], [5.0]), (2, [0.0, 1.0], [7.0])], "id long, vector array<double>, reduced array<double>")
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0])], "k long, v array<double>")
    got = {r["id"]: r["reduced"] for r in views.reduced_by_model(rows, model, "k", "v").collect()}
    assert round(got[1][0], 6) == 5.0 and round(got[2][0], 6) == 6.0 and [got[i] for i in (3, 4, 5)] == [None] * 3
    assert views.reduced_by_model(rows, model.limit(0), "k", "v").filter("reduced is not null").count() == 0
    monkeypatch.setattr(views, "MOST_MODEL_ROWS", 1)
    with pytest.raises(ValueError, match="at most"):
        views.reduced_by_model(rows, model, "k", "v")


def test_updates_and_links(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "k long, name string, size double")
    updates = spark.createDataFrame([(1, "name", "x", 1), (1, "name", None, 2), (2, "size", "4.5", 1), (2, "other", "z", 9)], "k long, column string, value string, at long")
    assert sorted(map(tuple, views.updated_columns(rows, updates, "k", ["name", "size"]).collect())) == [(1, None, 2.0), (2, "b", 4.5)]
    links = spark.createDataFrame([("edge", "a", "b", 1.0), ("edge", "b", "c", 1.0)], "kind string, source string, target string, weight double")
    assert views.links_of(links, None).count() == 0 and views.links_of(links, "b").count() == 2
    assert [r["target"] for r in views.links_of(links, "b", spark.createDataFrame([("b",), ("c",)], "id string")).collect()] == ["c"]


def test_rows_that_go_by_their_parents_id_meet_the_ids_gone_once(spark):
    """Lines have no id but their order's: one join says which stay, and rows without an id stay."""
    orders = spark.createDataFrame([(1, 10), (2, 20), (2, 30), (3, 30), (None, 10), (4, None)], "order_id long, customer long")
    lines = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (4,), (9,), (None,)], "order_id long")
    gone = spark.createDataFrame([(10,), (20,), (20,), (None,)], "customer long")
    kept = views.deleted_below([(orders, "order_id", "customer"), (lines, "order_id", "order_id")], gone)
    assert sorted(tuple(r) for r in kept[0].select("order_id", "customer").na.fill(-1).collect()) == [(-1, 10), (3, 30), (4, -1)]
    assert sorted(r[0] for r in kept[1].na.fill(-1).collect()) == [-1, 3, 3, 4, 9]
    one = views.deleted_below([(lines, "order_id", "order_id")], gone.withColumnRenamed("customer", "order_id"))[0]
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_links_of_the_graph_are_told_apart_by_bounded_tasks(spark, monkeypatch):
    """A task gets about so many links however well they are packed: the number of tasks goes with the rows."""
    monkeypatch.setattr(view_queries, "_LINKS_A_TASK", 500)
    edges = view_queries._graph(spark, "/root/testdata/sf0.001")[1]
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_suppkey <> l_partkey")
    assert sum(sizes) == li.select("l_suppkey", "l_partkey", F.col("l_quantity") > 40).distinct().count()
    assert len(sizes) > 8 and max(sizes) < 1000
