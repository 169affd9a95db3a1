"""Rules that SQL can't say, files and pages, and text functions, against plain versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import text as tx
from kelpie.functions import vectors as vx
from kelpie.operators import merge, search
from kelpie.sources import articles, files, html
from kelpie.streaming import ingest


def test_throttled_and_held(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 3), round(rng.random() * 40, 3)) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, user long, at double")
    got = {r["id"] for r in ingest.throttled(frame, "user").collect()}
    held = {r["id"] for r in ingest.held_shots(frame, "user").collect()}
    want, kept = set(), set()
    for u in range(4):
        last, buffer = None, []
        for at, i in sorted((at, i) for i, v, at in rows if v == u):
            if last is None or at - last >= 1:
                last = at
                want.add(i)
            buffer.append(i)
            if len(buffer) > 9:
                buffer.pop(max(1, len(buffer) // 2))
        kept |= set(buffer)
    assert got == want and held == kept
    assert ingest.throttled(frame.limit(0), "user").count() == 0


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>t</title><body><p>one</body></html>", "one"),
    ("<head><meta charset=x><p>two", "two"),
    ("<body><div><form><input>hidden</div><p>after</body>", "after"),
    ("<body><form>a<p>b</form>c", "c"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "| 1 | 2\n| 3"),
    ("<pre>a\n  b</pre>", "```\na\n  b\n```"),
    ("<ul><li>x<li>y</ul>z", "- x\n- y\n\nz"),
    ("<p>see <a href='u'>here", "see [here](u)"),
    ("<nav>no<p>menu</nav><h2>Head</h2>text<br>more", "## Head\n\ntext\n\nmore"),
])
def test_pages(page, want):
    assert html.to_markdown(page) == want


def test_preview_and_scan(spark, tmp_path):
    long = "é" * 3000
    frame = spark.createDataFrame([(1, bytearray(long.encode())), (2, bytearray(b"a\xff")), (3, bytearray(b"x" + long.encode())), (4, bytearray(b"")), (5, bytearray(b"ab\xc3"))], "id int, b binary")
    got = {r["id"]: r["p"] for r in frame.select("id", files.preview(F.col("b")).alias("p")).collect()}
    assert got == {1: "é" * 2048, 2: "[binary]", 3: "x" + "é" * 2047, 4: "", 5: "[binary]"}
    for name in ("a.md", ".hidden", ".git/x.md", "Pic.app/y.md", "Vault/z.md", "sub/b.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(name)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path)).collect()) == ["a.md", "b.md"]


def test_text_functions(spark):
    rows = [("The user is I am reading", "a/b", "../c.md#x", "one two three", "one two four five"), ("the USER was on", "a", "./d", "ab", "ab cd"), ("plain", "a", "http://x.y/z", "", "new"), ("Ｗｉｄｅ Éä ß", "a/b/c", "../../e", "same", "same"), (None, "a", "#top", "abc", "xyz")]
    frame = spark.createDataFrame(rows, "t string, folder string, target string, old string, new string")
    got = frame.select(tx.without_narration(F.col("t")), tx.normalized_name(F.col("t")), tx.resolved_path(F.col("folder"), F.col("target")), tx.lookup_key(F.col("target")), tx.transcript_delta(F.col("old"), F.col("new"))).collect()
    assert [r[0] for r in got[:3]] == ["I am reading", "On", "Plain"]
    said = [("The user manual lists",), ("this screenshot shows The user is typing",), ("an image of ",), ("THE USER APPEARS TO BE the user was asleep",), ("",), ("éa",)]
    bare = [r[0] for r in spark.createDataFrame(said, "t string").select(tx.without_narration(F.col("t"))).collect()]
    assert bare == ["The user manual lists", "Typing", "an image of ", "Asleep", "", "Éa"]
    assert got[3][1] == "wide ea ß"
    assert [r[2] for r in got] == ["a/c.md", "a/d", None, "a/e", None]
    assert [r[3] for r in got] == ["../c.md", "d", "http://x.y/z", "../../e", ""]
    assert [r[4] for r in got] == ["four five", "cd", "new", "", "xyz"]


def test_half_precision(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 5)).astype(np.float32)
    got = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<float>").select("i", vx.as_type(F.col("v"), "f16").alias("h"), vx.as_type(F.col("v"), "bf16").alias("b")).collect()
    for r in got:
        assert r["h"] == x[r["i"]].astype(np.float16).astype(float).tolist()
        assert all(abs(a - b) <= abs(b) * 2**-8 for a, b in zip(r["b"], x[r["i"]].tolist(), strict=True))
        assert all((np.float32(a).view(np.uint32) & 0xFFFF) == 0 for a in r["b"])
    bad = spark.createDataFrame([("[1,2,]",), ("[1,300]",), ("[1]",), ("x",), ("[1,2.5]",)], "t string").select(vx.parsed(F.col("t"), "u8", 2).alias("v")).collect()
    assert [r["v"] for r in bad] == [[1.0, 2.0], None, None, None, None]


def test_terms_keep_other_scripts(spark):
    docs = spark.createDataFrame([(1, "Été à la МОРЕ, naïve"), (2, "море été"), (3, None), (4, "mor")], "id long, text string")
    assert [r["t"] for r in docs.filter("id < 3").orderBy("id").select(tx.terms(F.col("text")).alias("t")).collect()] == [["Été", "à", "la", "МОРЕ", "naïve"], ["море", "été"]]
    assert {r["id"] for r in search.bm25(docs, "id", F.col("text"), ["море", "mor"]).collect()} == {2, 4}


def test_bindings_are_numbered_on(spark):
    old = spark.createDataFrame([("d1", 1, 5, "manual"), ("d1", 2, 6, "auto")], "day string, tag long, overview_id long, source string")
    wanted = spark.createDataFrame([("d2", 1), ("d1", 3), ("d1", 1)], "day string, tag long")
    got = {(r["day"], r["tag"]): r["overview_id"] for r in merge.ensured_bindings(old, wanted, wanted).collect()}
    assert got == {("d1", 1): 5, ("d1", 3): 7, ("d2", 1): 8}


def test_first_letters_as_the_sql_has_them(spark):
    """Every letter with an upper case of its own or of several letters, against DuckDB."""
    letters = [chr(i) for i in (*range(32, 0xD800), *range(0xE000, 0x1F000)) if chr(i).upper() != chr(i)]
    want = dict(duckdb.sql(f"SELECT c, upper(c) FROM (SELECT unnest([{', '.join(f'{chr(39)}{c}{chr(39)}' for c in letters)}]) AS c)").fetchall())
    frame = spark.createDataFrame([(c,) for c in letters], "c string")
    said = {r["c"]: r["t"] for r in frame.select("c", tx.without_narration(F.concat(F.lit("The uſer is "), "c", F.lit("x"))).alias("t")).collect()}
    assert said == {c: f"{u}x" for c, u in want.items()}
    assert said["ß"] == "ẞx"


def test_pages_go_to_python_some_at_a_time(spark):
    """Not in batches of thousands, in which a worker's memory would grow with its rows."""
    frame = spark.createDataFrame([(f"<article><p>{i}</p></article>", "http://a.b") for i in range(250)], "h string, u string").coalesce(1)
    for made in (html.markdown(F.col("h")), articles.article(F.col("h"), F.col("u"))):
        some = frame.select(made.alias("m"))
        assert sorted(int(r["m"]) for r in some.collect()) == list(range(250))
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
